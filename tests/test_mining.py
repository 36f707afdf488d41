import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import ime, predicates
from quillspark.functions.normalize import fold_query, plain
from quillspark.operators import curation as cu
from quillspark.operators import search, slots

NAMES = ["đường lý thường kiệt quận 1", "bệnh viện nhân dân 115", "12/3 nguyễn trãi", "a", "trường trung học phổ thông lê quý đôn"]


def test_pairs_are_judged_on_both_terms(spark):
    pairs = spark.createDataFrame([("street", "stret", 100, 1), ("a1b2", "a1b", 100, 1), ("word", "x", 50, 1)], "intended string, observed string, intended_count long, observed_count long")
    judged = search.minable_pairs(pairs)
    assert {r.intended: r.excluded for r in judged.collect()} == {"street": False, "a1b2": True, "word": True}
    triples = spark.createDataFrame([("street", "stret", 3)], "intended string, observed string, count long")
    assert search.mining_counters(judged, triples).collect() == [(1, 2, 1, 3)]
    assert search.mining_counters(judged.limit(0), triples.limit(0)).collect() == [(0, 0, 0, 0)]


def test_clean_queries(spark):
    rows = spark.createDataFrame([(1, ["so", "ok"]), (2, ["so", "zz"]), (3, ["12", "ok"]), (4, []), (5, None), (6, ["zz", "zz"])], "id long, ws array<string>")
    lexicon = spark.createDataFrame([("so",), ("ok",)], "term string")
    assert sorted(r.id for r in cu.clean_queries(rows, "id", "ws", lexicon).collect()) == [1, 3, 4, 5]


def test_dominant_takes_the_first_of_ties(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (2, "y", 5), (2, "x", 4), (3, None, 1)], "k long, label string, at long")
    assert {r.k: (r.label, r.n) for r in cu.dominant(rows, "k", "label", "at").collect()} == {1: ("a", 2), 2: ("x", 1), 3: (None, 1)}


def test_incomplete_and_composable(spark):
    rows = spark.createDataFrame([("Khám  bệnh V",), ("sân bay",), ("b",), ("",), (None,)], "q string")
    got = rows.select(predicates.looks_incomplete(F.col("q")).alias("i"), predicates.composable(F.col("q")).alias("c")).collect()
    assert [r.i for r in got] == [True, False, True, False, False]
    assert [r.c for r in got] == [False, True, False, False, None]


def test_composition_variants(spark):
    rows = spark.createDataFrame([("quận ba",), ("quan ba",), ("quận",), ("quận 3",), (None,)], "target string")
    got = {r.kind: r.input for r in cu.composition_variants(rows, "target", "s").collect()}
    assert got == {"missing_diacritics_only": "quan ba", "boundary_one_only": "quậnba", "missing_diacritics_boundary_one": "quanba", "missing_diacritics_boundary_all": "quanba"}


def test_acronyms_need_an_anchor_and_no_reserved_form(spark):
    texts = ["đường nguyễn an ninh", "xem nguyễn an ninh", "đường lý thường kiệt", "đường nguyễn 5 ninh", "đường", ""]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)] + [(9, None)], "id long, ws array<string>")
    got = {r.id: [tuple(c) for c in r.c] for r in rows.select("id", cu.acronym_candidates(F.col("ws")).alias("c")).collect() if r.c}
    assert got == {0: [("đường nan", "nan")]}


@pytest.mark.parametrize(("word", "telex", "vni"), [("thường", "thuwowngf", "thu7o7ng2"), ("đôn", "ddoon", "d9o6n"), ("Ắ", "aws", "a81"), ("ñu", "nux", "nu4"), ("abc", "abc", "abc")])
def test_typed_marks(spark, word, telex, vni):
    row = spark.createDataFrame([(word,)], "w string").select(ime.typed_marks(F.col("w"), True), ime.typed_marks(F.col("w"), False)).first()
    assert row[0] == (telex if word != "ñu" else "nux") and row[1] == vni


def test_token_family():
    cases = {("duong", "đường"): "missing_diacritics_full", ("đuòng", "đường"): "wrong_diacritic", ("dduowngf", "đường"): "telex_leak", ("d9u7o7ng2", "đường"): "vni_leak", ("đườg", "đường"): "keyboard_edit", ("duog", "đường"): "missing_diacritics_full"}
    assert {k: ime.token_family(*k) for k in cases} == cases


def test_slots_are_deterministic_distinct_and_ranked():
    for name in NAMES:
        made = slots.slot_variants(name, 1)
        assert made == slots.slot_variants(name, 1)
        keys = [fold_query(t) for _, _, t in made]
        assert len(set(keys)) == len(keys) and fold_query(name) not in keys and "" not in keys
        assert [r for r, _, _ in made] == sorted({r for r, _, _ in made})
        assert all(list(slots.SLOTS)[r - 1] == f for r, f, _ in made)
    assert len(slots.SLOTS) == 32 and {o for ops in slots.SLOTS.values() for o in ops} == set(slots.OPERATIONS)
    assert len(slots.slot_variants(NAMES[0], 1)) >= 25


def test_strict_slots_change_in_every_operation():
    rnd = random.Random(0)
    assert slots.OPERATIONS["missing_full"]("abc de", rnd) == "abc de"
    assert {"diacritics_boundary"} & {f for _, f, _ in slots.slot_variants("abc de", 1)} == set()  # equal to word_boundary
    families = {f for _, f, _ in slots.slot_variants("abc de", 1, strict=True)}
    assert "keyboard_diacritics" not in families and "word_boundary" in families


@pytest.mark.parametrize("name", NAMES)
def test_operations_do_what_they_say(name):
    for s in range(30):
        rnd = random.Random(s)
        op = {k: f(name, rnd) for k, f in slots.OPERATIONS.items()}
        letters = sum(c.isalpha() for c in name)
        assert len(op["keyboard_drop"]) == len(name) - 1 and len(op["keyboard_duplicate"]) == len(name) + 1
        assert sorted(op["keyboard_transpose"]) == sorted(name) and len(op["keyboard_insert"]) == len(name) + 1
        assert op["boundary_all"] == name.replace(" ", "") == op["boundary_one"].replace(" ", "")
        assert name.count(" ") - op["boundary_multi"].count(" ") == min(2, name.count(" "))
        assert plain(op["missing_partial"]) == plain(name) == op["missing_full"]
        assert unicodedata.normalize("NFC", op["wrong_diacritic"]) == op["wrong_diacritic"] and plain(op["wrong_diacritic"]) == plain(name)
        assert op["wrong_diacritic"] != name or not letters


def test_slotted_profiles_and_protection(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)] + [(90, None), (91, "")], "input_id long, target string")
    full = slots.slotted(rows, "target", "full", strict=False)
    small = slots.slotted(rows, "target", "small", strict=False)
    assert small.columns == ["input_id", "target", "rank", "family", "input"]
    assert sorted(small.collect()) == sorted(r for r in full.collect() if r["rank"] <= 8)
    kept = slots.slotted(rows, "target", protected=F.length("target") <= 3)
    assert {r.input_id for r in kept.collect()} == {0, 1, 2, 4}


def test_curriculum_and_self_supervised(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)] + [(90, None), (91, " ")], "k long, target string")
    made = slots.curriculum(rows, "target", sounds={"lý": ["lí"]}).collect()
    assert {r.stage for r in made} == {"base", "c1"}
    assert all((r.input == r.target) == (r.error_class == "clean") for r in made)
    assert sum(r.error_class == "clean" for r in made) == 4 * len(NAMES)
    assert any(r.error_class == "phonetic" and r.input == NAMES[0].replace("lý", "lí") for r in made)
    pairs = slots.self_supervised(rows, "target", "k", identity=0.5).collect()
    assert len(pairs) == len(NAMES)
    assert all(r.input == r.target for r in pairs if r.kind == "identity")
    assert all(r.input != r.target or plain(r.target) == r.target for r in pairs if r.kind == "denoising")
