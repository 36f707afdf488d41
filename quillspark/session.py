"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("quillspark")
    for key, value in (DEFAULTS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
