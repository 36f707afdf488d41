"""Query op5_secret_scan: spans of secrets in each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import secrets
from quillspark.llm._shared import documents


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan(docs, ["doc_id"])
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    counts = [F.size(F.filter("spans", secrets.of_rank(k))).cast("bigint").alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.described(base), 256).alias("base_sha256"), secrets.described(F.col("spans")).alias("spans"))


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    one = []
    for k, r in enumerate(secrets.RULES):
        p = quoted(r.pattern)
        one.append(
            f"SELECT rid, {k} AS k, '{r.kind}' AS kind, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, {p}) AS m, "
            f"regexp_extract_all(t, {p}, {r.group}) AS g, regexp_split_to_array(t, {p}) AS b FROM d WHERE regexp_matches(t, {p}))"
        )
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(secrets.RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(one)}),
spans AS (
  SELECT rid, k, kind, length(m[i]) AS n,
         list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM hits WHERE length(g[i]) >= CASE k {least} END),
named AS (SELECT rid, k, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS s FROM spans),
per AS (
  SELECT rid, {", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(secrets.BASE))},
         string_agg(s, ',' ORDER BY start, k) FILTER (WHERE k < {len(secrets.BASE)}) AS base, string_agg(s, ',' ORDER BY start, k) AS spans
  FROM named GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""


SQL = _sql()
