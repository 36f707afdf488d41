"""Queries of text rules over the lines of documents, conversations and part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import normalize as nm
from quillspark.functions import rules as ru
from quillspark.plans.prepare import turns
from quillspark.storage import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line, its words ``ws`` and these in lower case ``lw``, of every line that is not empty.

    The words leave the explode as columns: an expression would be put into the lambdas of
    the rules and made anew for every word.
    """
    docs = table(spark, sf_dir, "documents")
    each = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), ru.words(x).alias("ws"), ru.words(F.lower(x)).alias("lw")))
    return docs.select("doc_id", F.posexplode(each).alias("line_no", "p")).select("doc_id", "line_no", "p.line", "p.ws", "p.lw").filter("line <> ''")


def reject_reasons(spark, sf_dir):
    rows = lines(spark, sf_dir)
    said = lambda strict: F.coalesce(ru.target_rejection(F.col("line"), F.col("lw"), strict), F.lit("kept"))
    return rows.select(said(False).alias("first_rules"), said(True).alias("later_rules")).groupBy("first_rules", "later_rules").agg(F.count("*").alias("n"))


def protection_reasons(spark, sf_dir):
    rows = lines(spark, sf_dir)
    said = lambda strict: F.coalesce(ru.protection(F.col("line"), F.col("ws"), strict), F.lit("none"))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), said(False).alias("first_rules"), said(True).alias("later_rules")).filter("first_rules <> 'none' or later_rules <> 'none'")


def repeated_phrases(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), ru.repeats_anywhere(F.col("lw")).alias("anywhere"), ru.repeats_adjacent(F.col("lw")).alias("adjacent")).filter("anywhere or adjacent")


def script_valid(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(ru.script_valid(F.col("line"))).alias("valid"), F.count("*").alias("lines"))


def query_quality(spark, sf_dir):
    """Quality class and reason of two-line queries: normalized lines of the documents by class."""
    rows = lines(spark, sf_dir).select(nm.lower_key("line").alias("q"))
    rows = rows.withColumn("ws", ru.words(F.col("q")))
    return rows.select(ru.query_quality(F.col("q"), F.col("ws")).alias("said")).groupBy("said").agg(F.count("*").alias("n"))


def contract_audit(spark, sf_dir):
    rows = turns(spark, sf_dir).select(nm.lower_key("source").alias("s"), nm.lower_key("target").alias("t"))
    rows = rows.withColumn("sw", ru.words(F.col("s"))).withColumn("tw", ru.words(F.col("t")))
    reason = ru.pair_violation(F.col("s"), F.col("sw"), F.col("t"), F.col("tw"))
    return rows.select(F.regexp_replace(reason, "phrasal_duplicate_.*", "phrasal_duplicate").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def normalized_groups(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(nm.lower_key("line").alias("key")).agg(F.count("*").alias("n"), F.count_distinct(nm.strict_key("line")).alias("forms"))


def diacritic_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(nm.plain_text(F.lower("text")).cast("binary"), 256).alias("plain_sha256"))


def part_name_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("line"))
    rows = rows.withColumn("ws", ru.words(F.lower("line")))
    return rows.select("p_partkey", F.coalesce(ru.target_rejection(F.col("line"), F.col("ws"), True), F.lit("kept")).alias("said"), F.size("ws").cast("bigint").alias("n_words"))


QUERIES = [reject_reasons, protection_reasons, repeated_phrases, script_valid, query_quality, contract_audit, normalized_groups, diacritic_fold, part_name_rules]

_LINES = r"""ln AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) WHERE ls[i] <> ''),
w AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM ln),
l AS (SELECT *, list_transform(ws, lambda x: lower(x)) AS lw FROM w)"""


def _runs(n: int) -> str:
    return f"list_transform(range(1, len(lw) - {n} + 2), lambda i: array_to_string(lw[i:i + {n - 1}], ' '))"


_ANY = " OR ".join(f"(len(lw) > {n} AND len(list_distinct({_runs(n)})) < len({_runs(n)}))" for n in (2, 3, 4))
_NEXT = " OR ".join(f"(len(lw) >= {2 * n} AND len(list_filter(range(1, len(lw) - {2 * n} + 2), lambda i: lw[i:i + {n - 1}] = lw[i + {n}:i + {2 * n - 1}])) > 0)" for n in range(1, 9))
_PLACE = " OR ".join(f"contains(array_to_string(lw, ' '), '{p}')" for p in ("hà nội thành phố hà nội", "hồ chí minh thành phố hồ chí minh", "thành phố hồ chí minh thành phố hồ chí minh"))
_HEAD = r"""CASE WHEN length(line) > 100 OR len(ws) > 16 THEN 'too_long' WHEN regexp_matches(replace(line, ' ', ''), '(^|[^0-9])(\+?84|0)[0-9]{8,10}([^0-9]|$)') THEN 'phone_like' WHEN regexp_matches(line, '(?i)https?://|www\.') THEN 'url_like' """
_SHORT = r"""WHEN length(regexp_replace(line, '[ \t\n\x0B\f\r]', '', 'g')) <= 3 THEN 'short_ambiguous' WHEN len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}') AND regexp_matches(x, '\p{Nd}'))) > 0 THEN 'alphanumeric_code'
WHEN regexp_matches(line, '\p{L}') AND upper(line) = line AND lower(line) <> line THEN 'uppercase_name' ELSE 'none' END"""
SQL = {
    "reject_reasons": f"WITH {_LINES} SELECT {_HEAD} WHEN {_ANY} THEN 'repeated_phrase' WHEN NOT regexp_matches(line, '\\p{{L}}') THEN 'no_letters' ELSE 'kept' END AS first_rules, {_HEAD} WHEN {_NEXT} OR {_PLACE} THEN 'repeated_phrase' ELSE 'kept' END AS later_rules, count(*) AS n FROM l GROUP BY ALL",
    "protection_reasons": f"WITH {_LINES}, r AS (SELECT doc_id, line_no, CASE {_SHORT} AS first_rules, CASE WHEN NOT regexp_matches(line, '\\p{{L}}') THEN 'numeric_or_symbol' {_SHORT} AS later_rules FROM w) SELECT * FROM r WHERE first_rules <> 'none' OR later_rules <> 'none'",
    "repeated_phrases": f"WITH {_LINES}, r AS (SELECT doc_id, line_no, {_ANY} AS anywhere, {_NEXT} AS adjacent FROM l) SELECT * FROM r WHERE anywhere OR adjacent",
    "script_valid": rf"WITH {_LINES} SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(line, '[\x{{0400}}-\x{{04FF}}\x{{0E00}}-\x{{0E7F}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}\x{{1100}}-\x{{11FF}}\x{{3130}}-\x{{318F}}\x{{1D00}}-\x{{1D7F}}\x{{1F000}}-\x{{1FFFF}}\x{{2600}}-\x{{27FF}}\x{{FE00}}-\x{{FE0F}}]')) AS valid, count(*) AS lines FROM ln GROUP BY doc_id",
    "normalized_groups": rf"WITH {_LINES}, k AS (SELECT nfc_normalize(array_to_string(lw, ' ')) AS key, nfc_normalize(array_to_string(ws, ' ')) AS form FROM l) SELECT key, count(*) AS n, count(DISTINCT form) AS forms FROM k GROUP BY key",
    "diacritic_fold": "SELECT doc_id, sha256(replace(strip_accents(lower(text)), 'đ', 'd')) AS plain_sha256 FROM documents",
    "part_name_rules": f"WITH w AS (SELECT p_partkey, p_name AS line, string_split(p_name, ' ') AS ws, string_split(lower(p_name), ' ') AS lw FROM part) SELECT p_partkey, {_HEAD} WHEN {_NEXT} OR {_PLACE} THEN 'repeated_phrase' ELSE 'kept' END AS said, len(ws) AS n_words FROM w",
}
