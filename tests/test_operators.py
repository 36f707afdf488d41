import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import hashing
from quillspark.operators import alignment, channel, classifier, corpus, evaluation, noise, prepare, ranking, search
from quillspark.sources import files


def sentences_of(spark, texts):
    return spark.createDataFrame([(k, 0, t.split()) for k, t in enumerate(texts)], "doc_id long, sentence_id int, tokens array<string>")


def test_counts_of_small_corpus(spark):
    s = sentences_of(spark, ["the cat sat", "the dog"] * 4)
    vocab = {r.term: r["count"] for r in corpus.vocabulary(s).collect()}
    assert vocab == {"the": 8, "cat": 4, "sat": 4, "dog": 4}
    ids = [(r.id, r.term, r.frequency) for r in corpus.term_ids(corpus.vocabulary(s)).orderBy("id").collect()]
    assert ids == [(1, "the", 8), (2, "cat", 4), (3, "dog", 4), (4, "sat", 4), (5, "<s>", 0), (6, "</s>", 0), (7, "<unk>", 0)]
    two = {r.ngram: r["count"] for r in corpus.ngrams(s, 2, 2).collect()}
    assert two == {"<s> the": 8, "the cat": 4, "cat sat": 4, "sat </s>": 4, "the dog": 4, "dog </s>": 4}
    back = {r.ngram: r["count"] for r in corpus.ngrams(s, 2, 2, backward=True).collect()}
    assert back["<s> sat"] == 4 and back["the </s>"] == 8
    context = {(r.term, r.left, r.right): r["count"] for r in corpus.contexts(s).collect()}
    assert context[("the", "<b>", "cat")] == 4 and context[("dog", "the", "<b>")] == 4
    meta = corpus.metadata(s, 3).first()
    assert (meta.sentence_count, meta.token_count, meta.term_count, meta.forward_unigrams) == (8, 20, 4, 20 + 3 * 8)


def test_deletions(spark):
    row = spark.createDataFrame([("abc",)], "t string").select(corpus.deletions(F.col("t"), 1).alias("one"), corpus.deletions(F.col("t"), 2).alias("two")).first()
    assert set(row.one) == {"abc", "bc", "ac", "ab"} and set(row.two) == set(row.one) | {"a", "b", "c"}


@pytest.mark.parametrize("distance", [1, 2])
def test_index_equals_brute_force(spark, distance):
    from quillspark.functions.distance import osa

    rnd = random.Random(distance)
    words = sorted({"".join(rnd.choices("abcd", k=rnd.randrange(1, 9))) for _ in range(250)})
    vocab = spark.createDataFrame([(w, 5) for w in words], "term string, count long")
    got = {(r.observed, r.term) for r in search.close_terms(vocab.select("term"), vocab, distance).collect()}
    limit = lambda w: min(distance, 1 if len(w) <= 4 else 2)
    assert got == {(a, b) for a in words for b in words if osa(a, b) <= limit(a)}


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["please receive this"] * 20 + ["please recieve this"] * 2, [("receive", "recieve", 2)]),
        (["left hello right"] * 20 + ["left helo right"] * 2, [("hello", "helo", 2)]),
        (["a hello b"] * 12 + ["a hallo b"] * 12 + ["a hullo b"] * 1 + ["x hello y"] * 8, []),
    ],
)
def test_mined_triples(spark, texts, want):
    s = sentences_of(spark, texts)
    context = corpus.contexts(s)
    pairs = search.close_pairs(corpus.vocabulary(s), 10)
    assert [tuple(r) for r in search.error_triples(context, pairs, 10).collect()] == want


def test_stupid_backoff(spark):
    s = sentences_of(spark, ["a b c"] * 3 + ["a b d"])
    counts = ranking.counts_of(s, 3)
    asked = spark.createDataFrame([(1, ["a", "b"], "c"), (2, ["x", "b"], "d"), (3, ["x", "y"], "a"), (4, [], "zzz"), (5, ["b"], "c")], "i long, history array<string>, token string")
    got = {r.i: r.score for r in ranking.backoff_scores(asked, counts, 28, 3).collect()}
    assert got[1] == pytest.approx(math.log(3 / 4)) and got[2] == pytest.approx(math.log(0.4 * 1 / 4))
    assert got[3] == pytest.approx(math.log(0.4**2 * 4 / 28)) and got[4] == pytest.approx(math.log(1e-9)) and got[5] == pytest.approx(math.log(3 / 4))


def test_channel_learns_swaps(spark):
    learnt = channel.fitted(spark.createDataFrame([("the", "teh", 80), ("from", "form", 30), ("brown", "brwon", 10)], "intended string, observed string, count long"))
    assert learnt.counts[("he", "eh")] == 80 and learnt.counts[("t", "t")] == 90
    assert learnt.word("the", "teh") > learnt.word("the", "thx") and learnt.word("then", "tehn") > learnt.word("then", "thxn")
    score, parts = channel.best_parts("the", "teh", learnt.part)
    assert score == pytest.approx(learnt.word("the", "teh")) and "".join(a for a, _ in parts) == "the"
    assert channel.best_parts("", "", channel.first_guess) == (0.0, [])


def test_weights_ties_go_to_the_smaller(spark):
    rows = spark.createDataFrame([("o", "a", "a", -1.0, -1.0, 1, 5), ("o", "b", "a", -2.0, -2.0, 1, 5), ("p", "c", "d", 0.0, -9.0, 0, 5), ("p", "d", "d", -3.0, -1.0, 1, 5)], "observed string, term string, intended string, error_score double, lm_score double, distance int, frequency long")
    best = ranking.tune_weights(rows.withColumn("length", F.lit(1)), "observed", ["length"]).first()
    assert best.weight == 0.5 and best.mrr == 1.0


def test_decisions(spark):
    rows = spark.createDataFrame([(True, 0.9, "x", 0.9), (False, 0.1, "x", 0.9), (False, 0.9, None, 0.9), (False, 0.9, "x", 0.9), (False, 0.9, "x", 0.1)], "blacklisted boolean, spell_probability double, suggestion string, correct_probability double")
    got = [(r.action, r.correction) for r in ranking.decide(rows, 0.5, 0.5).collect()]
    assert got == [("keep", None), ("keep", None), ("flag", None), ("correct", "x"), ("flag", None)]


def test_logistic_separates_and_handles_constants(spark):
    rows = spark.createDataFrame([(float(k % 10), float(k), int(k % 10 > 4)) for k in range(200)], "a double, b double, y int")
    model = classifier.fit_logistic(rows, ["a", "b"], "y")
    wrong = rows.select(((model.probability() > 0.5) != (F.col("y") == 1)).alias("wrong")).filter("wrong").count()
    assert wrong == 0
    flat = classifier.fit_logistic(rows.withColumn("y", F.lit(1)), ["a"], "y")
    assert rows.select(flat.probability().alias("p")).agg(F.min("p")).first()[0] > 0.999


def test_strict_join_and_card(spark):
    gold = spark.createDataFrame([("1", "teh", "the", "swap"), ("2", "ok", "ok", "clean"), ("3", "helo", "hello", "delete")], "query_id string, input string, expected string, error_type string")
    pred = spark.createDataFrame([("1", "the", ["the"]), ("2", "ok", ["ok"]), ("3", "help", ["help", "hello"])], "query_id string, output string, hypotheses array<string>")
    card = {r.error_type: r for r in evaluation.score_card(evaluation.strict_join(gold, pred)).collect()}["all"]
    assert (card.tp, card.exact_noisy, card.clean_preservation) == (2, 0.5, 1.0)
    assert card.recall_1 == pytest.approx(2 / 3) and card.recall_3 == 1.0
    for bad in (pred.filter("query_id <> '1'"), pred.union(pred.limit(1)), pred.withColumn("input", F.lit("x"))):
        with pytest.raises(ValueError):
            evaluation.strict_join(gold, bad)


def test_quantiles_and_latency(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3)] + [("b", float(v)) for v in range(4)], "g string, v double")
    lat = {r.g: r for r in evaluation.latency_summary(rows, "v", "g").collect()}
    assert lat["a"].p95 == pytest.approx(2.9) and lat["a"].mean == 2.0
    near = {r.g: (r.q10, r.q50, r.q90) for r in evaluation.nearest_rank(rows, "v", "g").collect()}
    assert near == {"a": (1.0, 2.0, 3.0), "b": (0.0, 2.0, 3.0)}


def test_gate_fails_on_one_metric(spark):
    metrics = spark.createDataFrame([("a", 0.9), ("b", 0.2)], "metric string, value double")
    limits = spark.createDataFrame([("a", 0.8, True), ("b", 0.1, False), ("c", 0.1, True)], "metric string, limit double, at_least boolean")
    got = {r.metric: (r.passed, r.all_passed) for r in evaluation.gate(metrics, limits).collect()}
    assert got == {"a": (True, False), "b": (False, False), "c": (False, False)}


def test_samples_do_not_depend_on_order(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 3)
    pr = hashing.hash60("s", F.col("id"))
    one = {r.id for r in prepare.stratified(rows, ["g"], 7, pr, F.col("id")).collect()}
    two = {r.id for r in prepare.stratified(rows.orderBy(F.rand(3)).repartition(11), ["g"], 7, pr, F.col("id")).collect()}
    assert one == two and len(one) == 21
    assert prepare.quotas(11, ["a", "b", "c"]) == {"a": 4, "b": 4, "c": 3}


def test_alignment(spark):
    assert alignment.align(["haf", "nooij"], ["ha", "noi"]) == [("haf", "ha"), ("nooij", "noi")]
    assert alignment.align(["sanbay", "x"], ["san", "bay", "x"])[-1] == ("x", "x")
    rows = alignment.aligned(spark.createDataFrame([(1, "a b c d", "a x c d"), (2, "", None)], "i long, o string, t string"), "o", "t", ["i"])
    got = {r.position: (r.observed, r.intended, r.left, r.right) for r in rows.collect()}
    assert got[1] == ("b", "x", ["a"], ["c", "d"]) and got[0][2] == [] and got[3] == ("d", "d", ["b", "c"], [])
    assert [tuple(r) for r in alignment.triples(rows).collect()] == [("x", "b", 1)]


def test_noise_is_deterministic_and_changes_the_text(spark):
    rows = spark.createDataFrame([(1, "thành phố hà nội"), (2, "a"), (3, None), (4, "")], "i long, t string")
    one = sorted(map(str, noise.noisy(rows, "t", 6, 3).collect()))
    two = sorted(map(str, noise.noisy(rows.repartition(3), "t", 6, 3).collect()))
    assert one == two and len(one) >= 6
    assert all(r.noisy != r.t for r in noise.noisy(rows, "t", 6, 3).collect())
    assert noise.corrupted("some words here", "s", 0.0) == "some words here" and noise.corrupted("ab " * 200, "s") == noise.corrupted("ab " * 200, "s")


def test_bundle_and_files(spark, tmp_path):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "term string, count long")
    files.save_bundle({"vocab": vocab}, f"{tmp_path}/bundle", {"order": 3})
    loaded = files.load_bundle(spark, f"{tmp_path}/bundle", {"order": 3})["vocab"]
    assert files.fingerprint(loaded) == files.fingerprint(vocab.orderBy(F.desc("term")))
    with pytest.raises(ValueError):
        files.load_bundle(spark, f"{tmp_path}/bundle", {"order": 2})
    vocab.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/bundle/vocab")
    with pytest.raises(ValueError):
        files.load_bundle(spark, f"{tmp_path}/bundle")
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.txt").write_text("1\n2\n3\n")
    (tmp_path / "c.txt").write_text("1\n2\n")
    assert [tuple(r) for r in files.parallel(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt").orderBy("line_no").collect()] == [(0, "one", "1"), (1, "two", "2"), (2, "three", "3")]
    with pytest.raises(ValueError):
        files.parallel(spark, f"{tmp_path}/a.txt", f"{tmp_path}/c.txt")
    (tmp_path / "d.csv").write_text('user_query,corrected_query,corrected_query_ctr\n"a ""x""",b,0.5\n')
    rows = files.csv(spark, f"{tmp_path}/d.csv", ["user_query"])
    assert files.click_pairs(rows.withColumn("corrected_query_ctr", F.col("corrected_query_ctr").cast("double")), 0.4).first().user_query == 'a "x"'
    with pytest.raises(ValueError):
        files.csv(spark, f"{tmp_path}/d.csv", ["absent"])
    (tmp_path / "e.jsonl").write_text('{"query_id":"1"}\n{"query_id":"1"}\n')
    with pytest.raises(ValueError):
        files.jsonl(spark, f"{tmp_path}/e.jsonl", "query_id string")
    tags = spark.createDataFrame([("n1", {"name": "A; B", "alt": "B;C"}), ("n2", {})], "entity_id string, tags map<string,string>")
    assert [tuple(r) for r in files.entity_values(tags, ["name", "alt"]).collect()] == [("n1", ["A", "B", "C"])]
    with pytest.raises(ValueError):
        files.require_filled(vocab.withColumn("term", F.lit(" ")), ["term"])


def test_channel_rounds_drop_the_prior(spark):
    triples = spark.createDataFrame([("the", "teh", 80), ("then", "tehn", 5), ("a", "a", 0)], "intended string, observed string, count long")
    again = channel.fitted(triples, rounds=2)
    assert again.counts[("he", "eh")] == 85 and sum(again.totals.values()) < sum(channel.fitted(triples).totals.values())
    assert again.word("the", "teh") > again.word("the", "thx")


def test_substitution_keys(spark):
    row = spark.range(1).select(corpus.substitution_keys(F.lit("abc")).alias("a"), corpus.substitution_keys(F.lit("axc")).alias("b"), corpus.substitution_keys(F.lit("")).alias("c")).first()
    assert set(row.a) & set(row.b) == {"a\0c"} and row.c == []


def test_leaks_are_replaced_by_unused_rows(spark):
    rows = spark.createDataFrame([(k, "leak" if k < 3 else "fine") for k in range(10)], "id long, t string")
    spare = spark.createDataFrame([(k, "leak" if k == 20 else "fine") for k in range(5, 30)], "id long, t string")
    got = prepare.leaks_replaced(rows, F.col("t") == "leak", spare, "id", F.col("id"))
    assert sorted(r.id for r in got.collect()) == [3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
