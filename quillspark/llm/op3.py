"""Query op3_quality_rules: counts and verdict of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import quality
from quillspark.llm._shared import documents


def quality_rows(docs: DataFrame) -> DataFrame:
    judged = quality.quality(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rows(documents(spark, sf_dir))


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part} * 10000) // {whole} ELSE 0 END"


def _sql() -> str:
    names = list(quality.MEASURES)
    shares = ", ".join(f"{_share(p, w)} AS s_{m}" for m, (p, w, _) in quality.MEASURES.items())
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, s_{m} AS v, CAST({f} AS BIGINT) AS least FROM shares" for m, (_, _, f) in quality.MEASURES.items())

    def fence(by: str, name: str) -> str:
        keys = f"{by}, " if by else ""
        return f"""{name}_r AS (SELECT {keys}measure, least, bucket, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total
  FROM (SELECT {keys}measure, least, bucket, sum(n) AS n FROM sketch GROUP BY ALL)),
{name} AS (SELECT {keys}measure, max(total) AS total, max(least) AS least, min(bucket) FILTER (WHERE upto * 4 >= total) AS q25, min(bucket) FILTER (WHERE upto * 4 >= total * 3) AS q75 FROM {name}_r GROUP BY ALL),
{name}_f AS (SELECT {keys}measure, total, q75 + greatest((q75 - q25) * {quality.WIDTH}, least) AS fence FROM {name})"""

    limit = f"CASE WHEN o.total >= {quality.MIN_ROWS} THEN o.fence WHEN l.total >= {quality.MIN_ROWS} THEN l.fence ELSE e.fence END"
    pivot = ", ".join(f"max(fence) FILTER (WHERE measure = '{m}') AS max_{m}" for m in names)
    failed = ", ".join(f"CASE WHEN s_{m} > max_{m} THEN '{m}' END" for m in names)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT *, row_number() OVER () AS rid,
         list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams
  FROM w),
gram AS (SELECT rid, grams[i] AS gram, i FROM (SELECT rid, grams, unnest(range(1, len(grams) + 1)) AS i FROM g)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM gram) WHERE n > 1),
reps AS (SELECT rid, count(DISTINCT place) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY rid),
counts AS (
  SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '[!-/:-@\[-`{{-~]', '', 'g')) AS BIGINT) AS n_marks,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM g LEFT JOIN reps USING (rid)),
shares AS (SELECT *, {shares} FROM counts),
stacked AS ({stacked}),
sketch AS (SELECT lang, source, measure, least, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket, count(*) AS n FROM stacked GROUP BY ALL),
{fence("lang, source", "o")},
{fence("lang", "l")},
{fence("", "e")},
limits AS (SELECT lang, source, {pivot} FROM (
  SELECT o.lang, o.source, o.measure, {limit} AS fence
  FROM o_f o JOIN l_f l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN e_f e ON o.measure = e.measure) GROUP BY lang, source),
verdict AS (
  SELECT s.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {failed}) AS failed
  FROM shares s LEFT JOIN limits t ON s.lang IS NOT DISTINCT FROM t.lang AND s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM verdict
"""


SQL = _sql()
