"""Query op7_imatch: fingerprints of each document and of its edited text.

The next document in descending order of ids stands beside each by one exchange of the
texts: ids are cut into ranges, a range's documents are one window, and the first document
of a range is sent to the range before it as well (that of the first range to the last).
There is a range for so much text, and for each partition at least.

Defined cases: ids are integers, null ones come last; equal ids, and null ones, stand in
the order of a hash of their texts, by which they are dealt over ranges too; a null or
empty text has no characters and is edited to itself; very long texts are read whole;
repeated rows are each reported; a single document is its own next one; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import imatch
from quillspark.llm._shared import documents, written


#: Characters of text in a range, on average.
RANGE_CHARS = 32_000_000


def with_range(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` with ``range``, which rises along the order, and ``tie``, which orders equal ids.

    Ranges are cut by a number that falls in step with the order: the id, and below it the
    tie's place among all ties, so that rows of one id are cut as well.
    """
    tied = docs.withColumn("tie", F.xxhash64("text"))
    # the ids descend from range to range and null ids follow in ranges of their own; ties ascend within an id
    spread = lambda known: tied.filter(F.col("doc_id").isNotNull() if known else F.col("doc_id").isNull())
    at = [k / ranges for k in range(1, ranges)]
    accuracy = max(10_000, 10 * ranges)
    ids = spread(True).agg(F.percentile_approx("doc_id", at, accuracy)).first()[0] or []
    counted = Counter(ids)
    # an id at which several cuts fall is cut among its ties
    cuts = [(c, t) for c in sorted(counted, reverse=True) for t in (ties(counted[c]) if counted[c] > 1 else [None])]
    nulls = spread(False).count()
    above = F.lit(0)
    if cuts:
        listed = F.array(*[F.struct(F.lit(c).cast("bigint").alias("id"), F.lit(t).cast("bigint").alias("tie")) for c, t in cuts])
        after = lambda c: (F.col("doc_id") < c["id"]) | F.coalesce((F.col("doc_id") == c["id"]) & (F.col("tie") >= c["tie"]), F.lit(False))
        above = F.size(F.filter(listed, after))
    pieces = ties(max(1, -(-nulls * ranges // max(1, nulls + sum(counted.values()))))) if nulls else []
    last = F.lit(len(cuts) + 1)
    among_nulls = last + F.size(F.filter(F.array(*[F.lit(t).cast("bigint") for t in pieces]), lambda t: F.col("tie") >= t)) if pieces else last
    return tied.withColumn("range", F.when(F.col("doc_id").isNull(), among_nulls).otherwise(above))


def ties(n: int) -> list[int]:
    """``n`` cuts through the range of a 64-bit hash."""
    return [-(1 << 63) + ((1 << 64) // (n + 1)) * k for k in range(1, n + 1)]


def beside_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows of ``docs`` in windows with the document after them; ``guest`` rows only serve the one before."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranged = with_range(docs, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS))
    firsts = ranged.groupBy("range").agg(F.max_by(F.struct("doc_id", "tie"), F.struct("doc_id", -F.col("tie").cast("decimal(20,0)"))).alias("f"))
    listed = sorted((r.range, r.f.doc_id, r.f.tie) for r in firsts.collect())  # a row per range
    moved = [(i, t, listed[k - 1][0]) for k, (_, i, t) in enumerate(listed)]
    guests = F.broadcast(spark.createDataFrame(moved, "g_id long, g_tie long, g_range int"))
    own = ranged.withColumn("guest", F.lit(0))
    # one row of a range's first id and text is enough
    sent = ranged.join(guests, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie")))
    sent = sent.groupBy("g_range", "doc_id", "tie").agg(F.first("text").alias("text")).withColumn("range", F.col("g_range")).withColumn("guest", F.lit(1))
    cols = ["doc_id", "text", "range", "tie", "guest"]
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie"))
    return own.select(*cols).union(sent.select(*cols)), order


def imatch_rows(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = imatch.lexicon_table(written(imatch.lexicon(docs), "lexicon"))
    rows, order = beside_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("after"), F.lit(1), half))
    rows = rows.withColumn("after", F.lead("text").over(order)).withColumn("edited", edited)
    both = F.transform(F.array(imatch.terms(F.col("text")), imatch.terms(F.coalesce("edited", F.lit("")))), lambda t: imatch.hashes(t, table))
    rows = rows.select("doc_id", "range", "guest", "tie", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), both.alias("both"))
    rows = rows.withColumn("next", F.lead(F.col("both")[0]).over(order)).filter("guest = 0")
    own, changed = F.col("both")[0], F.col("both")[1]
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        imatch.printed(own).alias("fingerprint"),
        imatch.printed(changed).alias("edited_fingerprint"),
        imatch.likeness(own, changed).alias("near_edited"),
        imatch.likeness(own, F.col("next")).alias("near_next"),
    )


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_rows(documents(spark, sf_dir))
