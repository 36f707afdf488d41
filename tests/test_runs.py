import pytest

from quillspark.plans import builds, mining


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, "eins zwei drei vier fünf\nhallo welt\n\n \nwort"), (2, "zwei drei vier"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


RUNS = {"eins zwei drei", "zwei drei vier", "drei vier fünf", "hallo welt", "wort"}


def test_targets_are_the_runs_from_every_word(spark, folder):
    got = [r.target for r in mining.targets(spark, folder).collect()]
    assert sorted(t for t in got if t) == sorted(RUNS)


def test_ranked_corpora_have_every_run(spark, folder):
    pairs = builds.corpora(spark, folder).filter("lane = 'clean'").collect()
    held = {t for t in RUNS if builds_held(spark, t)}
    assert sorted(r.target for r in pairs) == sorted(RUNS - held) and len(held) < 3
    counted = builds.ranked_corpora(spark, folder).filter("lane = 'clean'").collect()
    assert sum(r.targets for r in counted) == len(RUNS - held)


def builds_held(spark, text):
    from pyspark.sql import functions as F
    from quillspark.functions.hashing import hash60

    return spark.range(1).select(hash60("held", F.lit(text)) % 50 == 0).first()[0]
