import pytest
from pyspark.sql import functions as F

from quillspark.functions import editing
from quillspark.operators import curation as cu


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("UBND  quận 1", "ủy ban nhân dân quận 1"),
        ("bv bạch mai", "bệnh viện bạch mai"),
        ("q 1 tp hcm", "quận 1 thành phố hồ chí minh"),
        ("đ. láng", "đường láng"),
        ("p 12", "phường 12"),
        ("hà nội hà nội", "hà nội"),
        ("quận 7 thành phố hồ chí minh thành phố hồ chí minh", "quận 7 thành phố hồ chí minh"),
        ("12 34 12 34", "12 34 12 34"),
        (",.- cà phê -", "cà phê"),
        ("", ""),
    ],
)
def test_canonical_targets(text, want):
    assert editing.canonical(text) == want and editing.canonical(want) == want


def test_built_in_edits(spark):
    row = spark.createDataFrame([("teh quik fox", ["a", "a", "b", "a"])], "t string, w array<string>")
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("the").alias("correction")), F.struct(F.lit(4).alias("start"), F.lit(8).alias("end"), F.lit("quick").alias("correction")))
    got = row.select(editing.spliced(F.col("t"), edits).alias("s"), editing.adjacent_removed(F.col("w")).alias("a"), editing.case_signature(F.lit("Ab")).alias("c"), editing.match_ratio(F.lit("abcd"), F.lit("bcde")).alias("r")).first()
    assert got.s == "the quick fox" and got.a == ["a", "b", "a"] and got.c == [0, 0, 1, 1, 0] and got.r == 0.75


def test_keyboard_neighbour(spark):
    pairs = [("hat", "hst", True), ("hat", "hpt", False), ("hat", "ha", False), ("hat", "hat", False), ("a b", "a n", True)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", editing.one_neighbour_key(F.col("a"), F.col("b")).alias("got")).collect())


def test_safe_and_bootstrap(spark):
    texts = [("quán ăn", True), ("gọi 0912 345 678", False), ("me@host.vn", False), ("x" * 101, False)]
    rows = spark.createDataFrame(texts, "t string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", cu.safe(F.col("t")).alias("got")).collect())
    gains = spark.range(400).select(F.col("id"), (F.col("id") % 2).cast("double").alias("g"))
    one, two = cu.paired_bootstrap(gains, "id", "g").first(), cu.paired_bootstrap(gains.repartition(5), "id", "g").first()
    assert one == two and 0.43 < one.low < 0.5 < one.high < 0.57 and one["mean"] == 0.5
