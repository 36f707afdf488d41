"""Queries of data preparation over documents, conversations, orders and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import hashing as h
from quillspark.functions.tokens import tokens
from quillspark.operators import prepare as pr
from quillspark.storage import table

SPLITS = {"train": 0.8, "dev": 0.1, "test": 0.1}
WIDTH = 8


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def text_group() -> F.Column:
    """Equal texts are one group and never divided between splits."""
    return F.sha2(F.col("text").cast("binary"), 256)


def hash_split_counts(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", h.split_of("seed-1", text_group(), SPLITS).alias("split"))
    return rows.groupBy("lang", "split").agg(F.count("*").alias("n"))


def cv_folds(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", h.fold_of("seed-2", text_group(), 5).alias("fold"))


def split_overlap(spark, sf_dir):
    """Texts that are in two splits when documents are split by id instead of by text."""
    rows = docs(spark, sf_dir).select(text_group().alias("g"), h.split_of("seed-1", F.col("doc_id"), SPLITS).alias("split"))
    return pr.split_overlap(rows, "g", "split")


def bottom_k_sample(spark, sf_dir):
    return pr.bottom_k(docs(spark, sf_dir).select("doc_id", "lang", h.hash60("seed-3", F.col("doc_id")).alias("priority")), 200, F.col("priority"), F.col("doc_id"))


def stratified_sample(spark, sf_dir):
    return pr.stratified(docs(spark, sf_dir).select("doc_id", "lang"), ["lang"], 25, h.hash60("seed-3", F.col("doc_id")), F.col("doc_id"))


def topped_up_sample(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", h.hash60("seed-4", F.col("doc_id")).alias("priority"))
    return pr.stratified_with_top_up(rows, "lang", 430, ["de", "en", "es", "fr"], "doc_id", F.col("priority"))


def nested_subsets(spark, sf_dir):
    """The smallest of three nested subsets, each balanced by label, that a document is in."""
    from pyspark.sql import Window

    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.row_number().over(Window.partitionBy("quality").orderBy(h.hash60("seed-5", F.col("doc_id")), "doc_id"))
    rows = labels.withColumn("n", n).withColumn("subset", F.when(F.col("n") <= 10, 10).when(F.col("n") <= 25, 25).when(F.col("n") <= 50, 50))
    return rows.filter("subset is not null").select("doc_id", "quality", "subset")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines as query keys with their frequency."""
    line = F.explode(F.split(F.lower("text"), "\n"))
    rows = docs(spark, sf_dir).select(line.alias("line")).select(F.col("line").alias("key"))
    return rows.filter("key <> ''").groupBy("key").agg(F.count("*").alias("frequency"))


def strata_queue(spark, sf_dir):
    key = F.col("key")
    strata = [("marked", key.rlike(r"[^a-z ]"), 60), ("short", F.length(key) <= 8, 50), ("frequent", F.col("frequency") >= 3, 40), ("rest", F.lit(True), 30)]
    return pr.strata_queue(keys(spark, sf_dir), strata, "key", "frequency")


def head_tail_mixture(spark, sf_dir):
    from quillspark.storage import materialized

    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("frequency"))
    rows = pr.head_tail(materialized(orders, "orders"), "frequency", "o_custkey")
    return pr.mixture(rows, "bucket", 200, {"head": 0.9, "tail": 0.1}, h.hash60("seed-6", F.col("o_custkey")), "o_custkey")


def first_wins_dedupe(spark, sf_dir):
    return pr.first_wins(docs(spark, sf_dir).select("doc_id", "lang", text_group().alias("g")), ["g"], F.col("doc_id")).select("doc_id", "lang")


def take_by_source(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", text_group().alias("g"))
    order = {"fr": 0, "de": 1, "es": 2, "en": 3}
    priority = F.element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    return pr.take_by_source(rows, "g", "lang", priority, {"fr": 100, "de": 60, "es": 40, "en": 150}, F.col("doc_id")).select("doc_id", "lang")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the one after it, as a pair of source and target."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("text").alias("target"))
    return c.join(after, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2"))).select("conv_id", "turn", F.col("text").alias("source"), "target")


def contradictions(spark, sf_dir):
    return pr.contradictions(turns(spark, sf_dir), "source", "target")


def leak_audit_exact(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("key")).filter("key <> ''")
    held = table(spark, sf_dir, "benchmark").select(F.col("text").alias("key"))
    return pr.leaks_exact(lines, held, "key").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def leak_audit_phrase(spark, sf_dir):
    held = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), tokens(F.lower("text")).alias("words"))
    return pr.leaks_by_phrase(docs(spark, sf_dir), "doc_id", tokens(F.lower("text")), held, WIDTH)


def stable_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", h.stable_id("q-", F.col("source"), F.coalesce("text", F.lit(""))).alias("stable_id"))


def manifest(spark, sf_dir):
    """Counters of a parallel corpus: rows, identical pairs, their share, different groups."""
    rows = turns(spark, sf_dir)
    same = F.col("source") == F.col("target")
    return rows.agg(F.count("*").alias("rows"), F.count_if(same).alias("identical"), (F.count_if(same) / F.count("*")).alias("identical_share"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


QUERIES = [hash_split_counts, cv_folds, split_overlap, bottom_k_sample, stratified_sample, topped_up_sample, nested_subsets, strata_queue, head_tail_mixture, first_wins_dedupe, take_by_source, contradictions, leak_audit_exact, leak_audit_phrase, stable_ids, manifest]


def _h(seed: str, part: str) -> str:
    return f"CAST('0x' || substr(sha256('{seed}' || chr(31) || {part}), 1, 15) AS BIGINT)"


def _split(seed: str, part: str) -> str:
    at = f"{_h(seed, part)} % 1000000"
    return f"CASE WHEN {at} < 800000 THEN 'train' WHEN {at} < 900000 THEN 'dev' ELSE 'test' END"


_TURNS = "t AS (SELECT a.conv_id, a.turn, a.text AS source, b.text AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS key FROM documents)"
_ID = "CAST(doc_id AS VARCHAR)"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_ \t\n\x0B\f\r]')"
SQL = {
    "hash_split_counts": f"SELECT lang, split, count(*) AS n FROM (SELECT lang, {_split('seed-1', 'sha256(text)')} AS split FROM documents) GROUP BY ALL",
    "cv_folds": f"SELECT doc_id, CAST({_h('seed-2', 'sha256(text)')} % 5 AS INTEGER) AS fold FROM documents",
    "split_overlap": f"WITH p AS (SELECT DISTINCT sha256(text) AS g, {_split('seed-1', _ID)} AS split FROM documents) SELECT a.split, b.split AS other, count(*) AS n_groups FROM p a JOIN p b ON a.g = b.g AND a.split < b.split GROUP BY ALL",
    "bottom_k_sample": f"SELECT doc_id, lang, {_h('seed-3', _ID)} AS priority FROM documents ORDER BY priority, doc_id LIMIT 200",
    "stratified_sample": f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_h('seed-3', _ID)}, doc_id) <= 25",
    "topped_up_sample": f"""WITH r AS (SELECT doc_id, lang, {_h('seed-4', _ID)} AS priority FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY priority, doc_id) AS n FROM r)
SELECT doc_id, lang, priority FROM n ORDER BY n <= CASE WHEN lang IN ('de', 'en') THEN 108 ELSE 107 END DESC, priority, doc_id LIMIT 430""",
    "nested_subsets": f"WITH n AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_h('seed-5', _ID)}, doc_id) AS n FROM labels) SELECT doc_id, quality, CASE WHEN n <= 10 THEN 10 WHEN n <= 25 THEN 25 ELSE 50 END AS subset FROM n WHERE n <= 50",
    "strata_queue": f"""WITH {_LINES}, k AS (SELECT key, count(*) AS frequency FROM (SELECT lower(key) AS key FROM ln) WHERE key <> '' GROUP BY key),
a AS (SELECT *, 'marked' AS stratum FROM k WHERE regexp_matches(key, '[^a-z ]') ORDER BY frequency DESC, key LIMIT 60),
b AS (SELECT *, 'short' AS stratum FROM k WHERE length(key) <= 8 AND key NOT IN (SELECT key FROM a) ORDER BY frequency DESC, key LIMIT 50),
c AS (SELECT *, 'frequent' AS stratum FROM k WHERE frequency >= 3 AND key NOT IN (SELECT key FROM a UNION ALL SELECT key FROM b) ORDER BY frequency DESC, key LIMIT 40),
d AS (SELECT *, 'rest' AS stratum FROM k WHERE key NOT IN (SELECT key FROM a UNION ALL SELECT key FROM b UNION ALL SELECT key FROM c) ORDER BY frequency DESC, key LIMIT 30)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""",
    "head_tail_mixture": f"""WITH o AS (SELECT o_custkey, count(*) AS frequency FROM orders GROUP BY o_custkey), r AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY frequency DESC, o_custkey) <= (SELECT count(*) FROM o) / 2.0 THEN 'head' ELSE 'tail' END AS bucket FROM o)
SELECT o_custkey, frequency, bucket FROM r QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY {_h('seed-6', 'CAST(o_custkey AS VARCHAR)')}, o_custkey) <= CASE bucket WHEN 'head' THEN 180 ELSE 20 END""",
    "first_wins_dedupe": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "take_by_source": """WITH p AS (SELECT doc_id, lang, sha256(text) AS g FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END, doc_id) = 1)
SELECT doc_id, lang FROM p QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id, g) <= CASE lang WHEN 'fr' THEN 100 WHEN 'de' THEN 60 WHEN 'es' THEN 40 ELSE 150 END""",
    "contradictions": f"WITH {_TURNS} SELECT source, count(DISTINCT target) AS n_targets, count(*) AS n_rows FROM t GROUP BY source HAVING count(DISTINCT target) > 1",
    "leak_audit_exact": f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines FROM ln WHERE key <> '' AND key IN (SELECT text FROM benchmark) GROUP BY doc_id",
    "leak_audit_phrase": f"""WITH d AS (SELECT doc_id, {_TOK} AS w FROM documents), b AS (SELECT item_id, {_TOK} AS w FROM benchmark),
dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS run FROM d),
br AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS run FROM b)
SELECT DISTINCT doc_id, item_id AS phrase_id FROM dr JOIN br USING (run)""",
    "stable_ids": "SELECT doc_id, 'q-' || substr(sha256(source || chr(0) || coalesce(text, '')), 1, 16) AS stable_id FROM documents",
    "manifest": f"WITH {_TURNS} SELECT count(*) AS rows, count(*) FILTER (WHERE source = target) AS identical, count(*) FILTER (WHERE source = target) / count(*) AS identical_share, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM t",
}
