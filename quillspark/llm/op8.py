"""Query op8_pii_pseudonyms: each document's text with pseudonyms, and how many values of each kind it had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import pii
from quillspark.llm._shared import documents

KEY = "quillspark-demonstration-key"


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.replace(documents(spark, sf_dir), ["doc_id"], KEY)
    counts = [F.size(F.filter("found", of_kind(k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return rows.select("doc_id", "text", *counts, F.size("found").cast("bigint").alias("n_found"))
