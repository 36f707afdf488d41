"""A training corpus from raw documents: five stages, each over all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import stages
from quillspark.llm._shared import documents, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("secrets", stages.redact_secrets),
    ("mixing", stages.mix_sources),
    ("bpe", stages.encode),
]

#: No SQL: the language models, the fingerprints and the tokenizer are beyond it; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
