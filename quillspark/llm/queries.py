"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import op1, op3, op5
from quillspark.llm.op1 import op1_license_scan
from quillspark.llm.op2 import op2_source_mix
from quillspark.llm.op3 import op3_quality_rules
from quillspark.llm.op4 import op4_toxicity
from quillspark.llm.op5 import op5_secret_scan
from quillspark.llm.op6 import op6_simhash
from quillspark.llm.op7 import op7_imatch
from quillspark.llm.op8 import op8_pii_pseudonyms
from quillspark.llm.op9 import op9_token_files
from quillspark.llm.op10 import op10_bpe_round_trip

QUERIES = [op1_license_scan, op2_source_mix, op3_quality_rules, op4_toxicity, op5_secret_scan, op6_simhash, op7_imatch, op8_pii_pseudonyms, op9_token_files, op10_bpe_round_trip]
SQL: dict[str, str] = {"op1_license_scan": op1.SQL, "op3_quality_rules": op3.SQL, "op5_secret_scan": op5.SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*QUERIES, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
