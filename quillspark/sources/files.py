"""Readers with checked schemas, parallel text, and bundles of tables with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.corpus import numbered
from quillspark.storage import materialized

#: Columns of the file kinds.
NOISY_PAIRS = "noisy_query string, correct_query string, entity_id string, group_id string, term_role string, noise_source string, error_type string, variant_id string"
CLICKS = "user_query string, corrected_query string, corrected_query_ctr double"
PHONETIC = "correct_word string, phonetic_variant string"
SCHEMA_VERSION = 1


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    empty = [F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in columns]
    bad = empty[0]
    for e in empty[1:]:
        bad = bad | e
    if not df.filter(bad).isEmpty():
        raise ValueError(f"empty values in {', '.join(columns)}")
    return df


def csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file of strings; quotes, line breaks in fields and the header are honoured."""
    return require_columns(spark.read.csv(path, header=True, multiLine=True, escape='"'), required)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, in the order of files and of lines in them) and value: a corpus of a text per line."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"))
    return numbered(materialized(raw, "lines"), F.col("f"), F.col("m"), name="line_no", start=0).select("line_no", "value")


def parallel(spark: SparkSession, source: str, target: str) -> DataFrame:
    """line_no, input and expected of two text files with as many lines."""
    a, b = lines(spark, source), lines(spark, target).select(F.col("line_no").alias("__n"), F.col("value").alias("expected"))
    both = a.join(b, F.col("line_no") == F.col("__n"), "full_outer")
    if not both.filter("line_no is null or __n is null").isEmpty():
        raise ValueError("the files have unlike numbers of lines")
    return both.select("line_no", F.col("value").alias("input"), "expected")


def jsonl(spark: SparkSession, path: str, schema: str, key: str = "query_id") -> DataFrame:
    """JSON lines of a given schema; the key must be there once per row."""
    rows = require_columns(spark.read.schema(schema).json(path), [key])
    if not rows.filter(F.col(key).isNull() | (F.col(key) == "")).isEmpty() or not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is missing or not unique")
    return rows


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and a hash of all of them that does not depend on their order."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")).first()
    return row[0], row[1]


def save_bundle(tables: dict[str, DataFrame], path: str, settings: dict) -> None:
    """Tables as Parquet under ``path``, then the manifest, whose presence makes the bundle whole."""
    spark = next(iter(tables.values())).sparkSession
    entries = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        rows, digest = fingerprint(spark.read.parquet(f"{path}/{name}"))
        entries[name] = {"rows": rows, "hash": digest, "schema": df.schema.simpleString()}
    manifest = json.dumps({"version": SCHEMA_VERSION, "settings": settings, "tables": entries}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str, settings: dict | None = None) -> dict[str, DataFrame]:
    """The tables of a bundle; raises if rows, contents, schema, version or settings are not those of the manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["version"] != SCHEMA_VERSION:
        raise ValueError(f"bundle of version {manifest['version']}")
    if settings is not None and manifest["settings"] != settings:
        raise ValueError("bundle made with other settings")
    out = {}
    for name, entry in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if df.schema.simpleString() != entry["schema"] or fingerprint(df) != (entry["rows"], entry["hash"]):
            raise ValueError(f"table {name} is not as it was written")
        out[name] = df
    return out


def phonetic_variants(rows: DataFrame) -> DataFrame:
    """Each word with its different variants, sorted."""
    return rows.groupBy("correct_word").agg(F.array_sort(F.collect_set("phonetic_variant")).alias("variants"))


def click_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Corrections that were clicked often enough."""
    return rows.filter(F.col("corrected_query_ctr") >= least).select("user_query", "corrected_query")


def entity_values(tags: DataFrame, keys: list[str]) -> DataFrame:
    """entity_id and names: values of the tags in the given order of keys, split at semicolons, different ones only."""
    value = lambda k: F.split(F.coalesce(F.element_at("tags", F.lit(k)), F.lit("")), ";")
    names = F.array_distinct(F.filter(F.transform(F.flatten(F.array(*map(value, keys))), lambda v: F.trim(v)), lambda v: v != ""))
    return tags.select("entity_id", names.alias("names")).filter(F.size("names") > 0)
