"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import builds, corpus, curation, evaluation, mining, pipelines, prepare, quality, ranking

FLAGSHIP = "error_triples"
MODULES = (corpus, prepare, quality, ranking, evaluation, curation, mining, builds, pipelines)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
