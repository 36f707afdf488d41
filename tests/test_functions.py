import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import distance as d
from quillspark.functions import ime, normalize, rules
from quillspark.functions import predicates as p
from quillspark.functions import tokens as tk


@pytest.mark.parametrize(("a", "b", "n"), [("", "abc", 3), ("the", "teh", 1), ("receive", "recieve", 1), ("ca", "abc", 3), ("kitten", "sitting", 3), ("é", "e", 1), ("same", "same", 0)])
def test_osa_values(a, b, n):
    assert d.osa(a, b) == n and d.osa(b, a) == n and d.osa(a, b, 1) == min(n, 2)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7), st.text("abcd", max_size=7), st.integers(0, 4))
def test_osa_laws(a, b, c, most):
    n = d.osa(a, b)
    assert n == d.osa(b, a) and (n == 0) == (a == b) and abs(len(a) - len(b)) <= n <= max(len(a), len(b))
    assert d.osa(a, b, most) == min(n, most + 1)


def test_within_one_equals_osa(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abé", k=rnd.randrange(5))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", d.within_one(F.col("a"), F.col("b")).alias("near"), d.osa_distance("a", "b").alias("n")).collect()
    assert all(r.near == (d.osa(r.a, r.b) <= 1) and r.n == d.osa(r.a, r.b) for r in rows)


def test_length_limits(spark):
    got = spark.range(1, 15).select(d.limit_for(F.col("id")).alias("n")).collect()
    assert [r.n for r in got] == [1] * 4 + [2] * 8 + [3] * 2


def test_edit_slots_undo_the_difference():
    assert d.edit_slots(["a", "b", "c"], ["a", "x", "c", "d"]) == [("substitute", 1, "x"), ("insert", 3, "d")]
    assert d.edit_slots([], []) == [] and len(d.edit_slots(["a"], [])) == 1


@pytest.mark.parametrize(("typed", "word"), [("tieengs", "tiếng"), ("nguowif", "người"), ("hoaf", "hòa"), ("TIEENGS", "TIẾNG"), ("ddi", "đi")])
def test_telex(typed, word):
    assert ime.decode_telex(typed) == word


def test_vni_and_encoding():
    assert ime.decode_vni("tie6ng1") == "tiếng"
    assert ime.encode("trường học") == "truowngf hocj" and ime.encode("trường học", False) == "tru7o7ng2 hoc5"
    assert ime.encode("thành phố") == "thanhf phoos" and ime.encode("thành phố", False) == "thanh2 pho61"
    assert "tiếng" in ime.variants("tieengs") and ime.variants("abc") == ["abc"]


def test_normalizers_differ():
    text = "  Đường_Straße  Huệ!  "
    assert normalize.fold_term(text) == "đường strasse huệ" and normalize.lower_nfc(text) == "đường_straße huệ!"
    assert normalize.keep_case(text) == "Đường_Straße Huệ!" and normalize.fold_query(text) == "đường_strasse huệ!"
    assert normalize.fold_group("ﬁ  A") == "fi a" and normalize.plain("Đường huệ") == "Duong hue"


def test_plain_text_is_built_in_and_equal(spark):
    rows = spark.createDataFrame([("Đường huệ Straße ñ ç",), (None,)], "t string").select("t", normalize.plain_text(F.col("t")).alias("p"), normalize.lower_key("t").alias("k")).collect()
    assert rows[0].p == normalize.plain(rows[0].t) and rows[1].p is None and rows[1].k is None
    assert len(normalize.vowels_with_marks()) == 67 and all(unicodedata.is_normalized("NFC", c) for c in normalize.vowels_with_marks())


def test_tokens_and_sentences(spark):
    text = "Don’t stop! Go_on 3.5 … hà nội?yes . "
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "...")], "doc_id long, text string")
    got = {(r.doc_id, r.sentence_id): r.tokens for r in tk.sentences(docs).collect()}
    assert got == {(1, 0): ["don’t", "stop"], (1, 1): ["go_on", "3"], (1, 2): ["5", "hà", "nội"], (1, 3): ["yes"]}
    at = tk.positioned(docs).filter("doc_id = 1").orderBy("sentence_id", "position").collect()
    assert [(r.sentence_id, r.position, r.surface) for r in at][:4] == [(0, 0, "Don’t"), (0, 1, "stop"), (0, 2, "!"), (1, 0, "Go_on")]


def test_predicates(spark):
    words = ["a", "12", "½", "!?", "word", "ab1", "é" * 65, "a-b-c", "don't"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", p.blacklisted(F.col("w")).alias("b"), p.word_like(F.col("w")).alias("l")).collect()
    assert [r.w for r in rows if r.b] == ["a", "12", "½", "!?"] and [r.w for r in rows if r.l] == ["word", "don't"]


def said(spark, expression, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("ws", rules.words(F.lower("t")))
    return [r.said for r in rows.select("i", expression(F.col("t"), F.col("ws")).alias("said")).orderBy("i").collect()]


def test_target_rejection(spark):
    texts = ["x" * 101, "a " * 17, "call 0912 345 678", "see www.x.vn", "a b c a b d", "a b a b", "123 45", "plain words"]
    assert said(spark, lambda t, w: rules.target_rejection(t, w, False), texts) == ["too_long", "too_long", "phone_like", "url_like", "repeated_phrase", "repeated_phrase", "no_letters", None]
    assert said(spark, lambda t, w: rules.target_rejection(t, w, True), texts) == ["too_long", "too_long", "phone_like", "url_like", None, "repeated_phrase", None, None]


def test_query_quality(spark):
    texts = ["ab", "36 ngõ", "199 hồ", "quán ăn ngon", "bv bạch mai", "benh vien", "cho moi", "hà", "gần chợ", "đường láng,", "gọi 0912345678 nhé", "nhà gas t"]
    got = said(spark, rules.query_quality, texts)
    assert [g.split(":")[0] for g in got] == ["REJECTED_GARBAGE", "AMBIGUOUS_PREFIX", "AMBIGUOUS_PREFIX", "HIGH_CONFIDENCE_CLEAN", "CONTRADICTION_LANE2", "NOISY_TYPO", "NOISY_TYPO", "REJECTED_GARBAGE", "AMBIGUOUS_PREFIX", "AMBIGUOUS_PREFIX", "REJECTED_GARBAGE", "AMBIGUOUS_PREFIX"]
    assert got[4] == "CONTRADICTION_LANE2:contains_lane2_trigger_bv" and got[1].endswith("house_number_single_word_prefix")


def test_pair_contract(spark):
    pairs = [("a b", "a b", ""), ("", "x", "empty_source_or_target"), ("a", "привет", "invalid_script"), ("a a", "a a", "target_has_duplicate_consecutive_words"), ("x", "ubnd xã", "target_contains_unexpanded_ubnd"), ("d láng", "phố láng", "ambiguous_d_mapped_to_pho"), ("772 giải phóng", "77/2 giải phóng", "ill_posed_digit_merging"), ("ltk 5", "lý thường kiệt 5", "contextless_acronym_ltk"), ("q 1", "q 1", "target_has_unexpanded_prefix"), ("x", "cty abc", "target_has_unexpanded_business_abbrev"), ("x", "hà nội hà nội", "target_has_phrasal_duplicate_hà nội"), ("x", "w" + " w1 w2" * 13, "target_has_phrasal_duplicate_w1 w2 w1 w2")]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i long, s string, t string, want string").withColumns({"sw": rules.words(F.col("s")), "tw": rules.words(F.col("t"))})
    for r in rows.select("want", rules.pair_violation(F.col("s"), F.col("sw"), F.col("t"), F.col("tw")).alias("got")).collect():
        assert r.got == r.want
