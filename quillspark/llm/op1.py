"""Query op1_license_scan: licence notices in each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import licenses
from quillspark.llm._shared import documents


def labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    share = F.array_max(F.transform("found", lambda x: x["share"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(share, F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    posted = ", ".join(f"('{w}', {k}, {i - t.key_at}, {t.key_at <= i < t.key_at + len(t.key.split())})" for k, t in enumerate(licenses.TEMPLATES) for i, w in enumerate(t.words))
    sizes = ", ".join(f"({k}, '{t.label}', {t.base}, {len(t.words)}, {len(t.key.split())})" for k, t in enumerate(licenses.TEMPLATES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT rid, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM d),
posted(word, k, rel, in_key) AS (VALUES {posted}),
sizes(k, label, base, size, key_size) AS (VALUES {sizes}),
votes AS (SELECT rid, k, place - rel AS start, count(*) AS n, count(*) FILTER (WHERE in_key) AS key_n FROM w JOIN posted USING (word) GROUP BY ALL),
found AS (SELECT rid, start, label, base, n / size AS share FROM votes JOIN sizes USING (k) WHERE key_n = key_size),
per AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN per USING (rid)
"""


SQL = _sql()
