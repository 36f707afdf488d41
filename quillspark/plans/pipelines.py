"""Queries of generators, alignment, files and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import distance, ime
from quillspark.functions.normalize import arrow
from quillspark.operators import alignment, noise
from quillspark.plans import corpus as pc
from quillspark.plans.evaluation import predictions
from quillspark.sources import files
from quillspark.storage import shared_dir, table
from quillspark.streaming import counts


def noisy_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("term"))
    return noise.noisy(rows, "term", 8)


def ime_round_trip(spark, sf_dir):
    """Words of the documents typed and read again: what comes back equal by either method."""
    words = pc.vocabulary(spark, sf_dir).filter(F.col("term").rlike(r"^\p{L}+$"))
    typed = words.select("term", arrow(lambda t: ime.encode(t, True))("term").alias("telex"), arrow(lambda t: ime.encode(t, False))("term").alias("vni"))
    return typed.select("term", "telex", "vni", (arrow(ime.decode_vni)("vni") == F.col("term")).alias("vni_back"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("query_id", "input", "expected", "output")


def token_align(spark, sf_dir):
    return alignment.aligned(pairs(spark, sf_dir), "output", "expected", ["query_id"])


def aligned_triples(spark, sf_dir):
    return alignment.triples(alignment.aligned(pairs(spark, sf_dir), "input", "expected", ["query_id"]))


def alignment_diagnostics(spark, sf_dir):
    return alignment.diagnostics(token_align(spark, sf_dir), "query_id")


def edit_slots(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("query_id", F.split("input", " ").alias("a"), F.split("output", " ").alias("b"))
    return rows.select("query_id", distance.token_edit_slots("a", "b").alias("slots"), distance.token_distance("a", "b").alias("n"))


def osa_distances(spark, sf_dir):
    return pairs(spark, sf_dir).select("query_id", distance.osa_distance("input", "expected").alias("distance"))


def corrupted_documents(spark, sf_dir):
    """The benchmark's texts with one character in fifty disturbed."""

    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([noise.corrupted(t or "", f"9:{i}") for i, t in zip(ids, texts, strict=True)])

    return table(spark, sf_dir, "benchmark").select("item_id", F.pandas_udf(run, "string")("item_id", "text").alias("text"))


def staged_mix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return noise.retained(rows, ["en", "fr", "es"], "lang", {"en": 2, "fr": 1, "es": 2}, "doc_id", 600)


def bundle_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}/bundle"
    files.save_bundle({"vocabulary": pc.vocabulary(spark, sf_dir)}, path, {"order": pc.ORDER})
    return files.load_bundle(spark, path, {"order": pc.ORDER})["vocabulary"]


def parallel_text(spark, sf_dir):
    """Part names and their noisy forms written as two text files and zipped again by line."""
    path = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}"
    rows = pairs(spark, sf_dir).repartitionByRange(3, "query_id").sortWithinPartitions("query_id")
    for name, col in (("src", "input"), ("tgt", "expected")):
        rows.select(col).write.text(f"{path}/{name}")
    return files.parallel(spark, f"{path}/src", f"{path}/tgt")


def stream_vocabulary(spark, sf_dir):
    path = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source.select("doc_id", "text").repartition(3).write.parquet(f"{path}/arriving")
    arriving = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(f"{path}/arriving")
    counts.count_stream(arriving, f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    return counts.counts(spark, f"{path}/counts")


QUERIES = [noisy_variants, ime_round_trip, token_align, aligned_triples, alignment_diagnostics, edit_slots, osa_distances, corrupted_documents, staged_mix, bundle_round_trip, parallel_text, stream_vocabulary]

from quillspark.plans.evaluation import GOLD  # noqa: E402

SQL = {
    "bundle_round_trip": pc.SQL["vocabulary"],
    "stream_vocabulary": pc.SQL["vocabulary"],
    "parallel_text": f"WITH {GOLD} SELECT row_number() OVER (ORDER BY query_id) - 1 AS line_no, input, expected FROM gold",
    "osa_distances": f"WITH {GOLD} SELECT query_id, CAST(CASE WHEN input = expected THEN 0 ELSE 1 END AS INTEGER) AS distance FROM gold",
    "staged_mix": """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY CAST('0x' || substr(sha256('mix' || chr(31) || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT), doc_id) - 1 AS n, count(*) OVER (PARTITION BY lang) AS size,
CASE lang WHEN 'fr' THEN 120 ELSE 240 END AS want FROM documents WHERE lang IN ('en', 'fr', 'es'))
SELECT doc_id, lang, unnest(range(1, (want - n - 1) // size + 2)) AS copy FROM r WHERE n < want""",
}
