"""Query op4_toxicity: toxicity score of each document, learnt from two thirds of the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import toxicity
from quillspark.llm._shared import documents, fat_rows

THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classifier(spark: SparkSession, sf_dir: str, held: bool = True) -> toxicity.Classifier:
    """Fitted to the labelled documents of ``sf_dir``, without those held out."""
    fat_rows(spark)
    rows = toxicity.labelled(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.fit(rows.filter(~held_out()) if held else rows)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), classifier(spark, sf_dir), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
