from pyspark.sql import functions as F

from quillspark.operators import ranking

TEXTS = [["a", "b", "a", "b"], ["b"], [], ["a", "b", "c"], ["c", "b", "a"]]


def test_wanted_counts_are_those_of_all_ngrams(spark, monkeypatch):
    """Only n-grams asked for are counted, in either direction, and the total is that of all."""
    rows = spark.createDataFrame([(t,) for t in TEXTS if t], "tokens array<string>")
    asked = ["a", "b", "a b", "b a", "a b a", "a b c", "c b", "z", "z a", None, "a b"]
    wanted = spark.createDataFrame([(g,) for g in asked], "ngram string")
    every = {b: {r.ngram: r["count"] for r in ranking.counts_of(rows, 3, b).collect()} for b in (False, True)}
    total = sum(n for g, n in every[False].items() if " " not in g)
    for most in (ranking.MOST_GRAMS, 0):
        monkeypatch.setattr(ranking, "MOST_GRAMS", most)
        counts, n = ranking.wanted_counts(spark.createDataFrame([(t,) for t in TEXTS], "tokens array<string>"), wanted, 3)
        assert n == total
        assert {r.ngram: r["count"] for r in counts.collect()} == {g: every[False][g] for g in asked if g in every[False]}
        assert all(every[True][r.ngram] == r["count"] for r in ranking.turned(counts).collect())
    assert ranking.wanted_counts(rows.limit(0), wanted, 3)[1] == 0


def test_backoff_asks_for_each_gram_and_its_history(spark):
    row = spark.createDataFrame([(["x", "y"], "z"), ([], "z")], "history array<string>, token string")
    got = [r.asDict() for r in row.select(*[c.alias(n) for n, c in ranking.asked_grams(3).items()], F.size("history").alias("n")).collect()]
    assert got[0] == {"g1": "z", "h1": None, "g2": "y z", "h2": "y", "g3": "x y z", "h3": "x y", "n": 2}
    assert got[1]["g2"] is None and got[1]["h3"] is None and got[1]["g1"] == "z"
