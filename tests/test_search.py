from pyspark.sql import functions as F

from quillspark.operators import corpus, search

WORDS = ["street", "stret", "streat", "strete", "tsreet", "house", "hous", "a", "b"]


def sentences(spark, n=40):
    rows = [(["the", w if i % 11 == 0 else "street", "is"],) for i in range(n) for w in WORDS] + [(["so", "house", x, "x"],) for x in WORDS] + [([],), (["a"],)]
    return spark.createDataFrame(rows, "tokens array<string>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_deletion_key_is_broadcast(spark):
    """The keys look as small as their terms to Spark; hashes of counted keys alone may be sent."""
    vocab = corpus.vocabulary(sentences(spark))
    joins = [line for line in plan(search.close_pairs(vocab)).splitlines() if "Join" in line]
    assert [line for line in joins if "delete_key" in line and "SortMergeJoin" in line]
    assert not [line for line in joins if "delete_key" in line and "Broadcast" in line]


def test_close_pairs_equal_brute_force_with_and_without_hashes(spark, monkeypatch):
    vocab = corpus.vocabulary(sentences(spark))
    counts = {r.term: r["count"] for r in vocab.collect()}
    close = {(r.observed, r.term) for r in search.close_terms(vocab, vocab).collect()}
    want = {(i, o, counts[i], counts[o]) for o, i in close if o != i and counts[i] >= 10 * counts[o] and counts[i] >= 10}
    assert want and {tuple(r) for r in search.close_pairs(vocab).collect()} == want
    monkeypatch.setattr(search, "MOST_HASHES", 0)
    monkeypatch.setattr(search, "FEW_TERMS", 0)
    assert {tuple(r) for r in search.close_pairs(vocab).collect()} == want
    assert {(r.observed, r.term) for r in search.close_terms(vocab, vocab).collect()} == close


def test_triples_of_mined_contexts_are_those_of_all_contexts(spark, monkeypatch):
    rows = sentences(spark)
    pairs = search.close_pairs(corpus.vocabulary(rows))
    every = corpus.contexts(rows)
    want = sorted(map(tuple, search.error_triples(every, pairs).collect()))
    assert want
    for most in (corpus.MOST_HASHES, 0):
        monkeypatch.setattr(corpus, "MOST_HASHES", most)
        mined = corpus.mined_contexts(rows, pairs, search.LEAST_CONTEXT)
        assert sorted(map(tuple, search.error_triples(mined, pairs).collect())) == want
        totals = {(r.left, r.right): r["count"] for r in corpus.context_totals(every).collect()}
        assert all(totals[r.left, r.right] == r["count"] for r in corpus.context_totals(mined).collect())
        assert mined.filter(F.col("left") == "so").isEmpty()
