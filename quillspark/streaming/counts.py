"""Incremental corpus counts as a stream.

Sentences of newly arrived documents are counted per batch and merged into a table of
counts.  Each batch writes its own folder, named by the batch's number, so a batch that is
run again after a failure replaces itself and nothing is counted twice; the current counts
are the sum over the folders, and ``compacted`` rewrites them as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.tokens import sentences
from quillspark.operators.corpus import vocabulary


def count_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start counting the terms of a stream of documents (doc_id, text) into ``path``; stops when all that is there is counted."""

    def merge(batch: DataFrame, number: int) -> None:
        vocabulary(sentences(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, path: str) -> DataFrame:
    """term and count over all batches."""
    return spark.read.parquet(path).groupBy("term").agg(F.sum("count").alias("count"))


def compacted(spark: SparkSession, path: str, target: str) -> None:
    counts(spark, path).write.parquet(f"{target}/batch=0")


def corrected_stream(queries: DataFrame, corrections: DataFrame) -> DataFrame:
    """A stream of (query_id, token) with the correction of each token from a static table (observed, correction)."""
    known = corrections.select(F.col("observed").alias("token"), "correction")
    return queries.join(F.broadcast(known) if known.count() <= 200_000 else known, "token", "left")
