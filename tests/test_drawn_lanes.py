import pytest
from pyspark.sql import functions as F

from quillspark.functions.normalize import lower_key
from quillspark.operators import builds
from quillspark.plans import builds as plans
from quillspark.plans import mining

WORDS = ["đường", "nguyễn", "bridge", "street", "ngõ", "market", "river", "số", "12/3", "x1", "Zürich", "CAFÉ", "a b", " ", "phở", "long\x1fer"]
LINES = [" ".join(WORDS[(i * k + j * j) % len(WORDS)] for j in range(9)) for i in range(1, 13) for k in (1, 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("drawn"))
    rows = [(i, "\n".join(LINES[i : i + 3]) + "\n\n ") for i in range(len(LINES))] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_runs_are_normalized_by_line_as_each_would_be(spark, folder):
    want = mining.targets(spark, folder).select("target", lower_key("target").alias("key")).collect()
    got = mining.normalized_runs(spark, folder).distinct().collect()
    assert {r.target for r in got} == {r.key for r in want if r.key} and len(got) > 50
    assert {r.target for r in got if r.as_is} == {r.key for r in want if r.key and r.key == r.target} != {r.target for r in got}


@pytest.mark.parametrize("weights", [{"identity": 7, "missing": 4, "keyboard": 6, "word": 3}, {"address": 1, "keyboard": 9}])
def test_drawn_lanes_are_those_of_all_pairs(spark, folder, weights):
    queries = mining.normalized_runs(spark, folder).withColumn("held", F.col("as_is") & plans.held_out(F.col("target")))
    assert queries.filter("held").count()
    got = builds.drawn_lanes(queries, weights, 60, share=2**-7)
    want = builds.production_lanes(plans.corpora(spark, folder), weights, 60).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lanes_make_few_of_the_pairs(spark, monkeypatch):
    """What a lane takes comes from the first places; the others' variants are not made."""
    sizes = []
    ranked = builds.ranked_corpora
    monkeypatch.setattr(builds, "ranked_corpora", lambda targets, *a: sizes.append(targets.count()) or ranked(targets, *a))
    queries = spark.range(20_000).select(F.concat(F.lit("street no "), F.translate(F.lower(F.conv("id", 10, 26)), "0123456789", "qrstuvwxyz")).alias("target"), F.lit(False).alias("held"))
    got = builds.drawn_lanes(queries, {"identity": 1, "keyboard": 1}, 100, share=2**-7).collect()
    assert len(got) == len({(r.target, r.family) for r in got}) == 100 and len(sizes) == 1 and sizes[0] < 2_500
