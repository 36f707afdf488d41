"""Queries of curation over documents, part names and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import editing
from quillspark.functions.hashing import hash60
from quillspark.functions.normalize import plain_text
from quillspark.functions.tokens import tokens
from quillspark.operators import curation as cu
from quillspark.operators import evaluation as ev
from quillspark.plans import corpus as pc
from quillspark.plans.evaluation import GOLD, gold, predictions
from quillspark.plans.prepare import docs
from quillspark.plans.quality import _LINES as _RAW_LINES
from quillspark.plans.quality import lines
from quillspark.storage import materialized, table


def safe_queries(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(cu.safe(F.col("line"))).alias("safe"), F.count("*").alias("n"))


def token_compatible(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.groupBy("error_type").agg(F.count("*").alias("n"), F.count_if(cu.token_compatible(F.col("output"), F.col("expected"), F.col("error_type"))).alias("kept"))


def zero_click_counts(spark, sf_dir):
    log = lines(spark, sf_dir).select("line", F.lower("line").alias("k"), (F.col("doc_id") * 100_000 + F.col("line_no")).alias("at"))
    return cu.zero_click(log, "line", F.col("k"), "at")


def unique_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lower("p_name").alias("folded"))
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.lower(F.upper("p_name")).alias("folded"))
    return cu.unique_match(asked, names, "folded").select("query_id", "target")


def blocked_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    queries = gold(spark, sf_dir).select(F.col("input").alias("query")).distinct()
    return cu.blocked_match(queries, names).select("query", "name", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"))


def clear_winner(spark, sf_dir):
    vocab = materialized(pc.vocabulary(spark, sf_dir), "vocabulary")
    offers = vocab.select(plain_text(F.col("term")).alias("token"), "term", F.col("count").alias("frequency"))
    return cu.clear_winner(offers, "token", "frequency")


def held_out_runs(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", tokens(F.lower("text")).alias("ws"))
    rows = rows.select("doc_id", F.explode(F.array("ws")).alias("ws"))
    return cu.held_out_runs(rows, "doc_id", "ws", [["all", "rights", "reserved"], ["mit", "license"]])


def adjacent_removed(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "line_no", "lw")
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), (F.size("lw") - F.size(editing.adjacent_removed(F.col("lw")))).cast("bigint").alias("removed")).filter("removed > 0")


def spliced_text(spark, sf_dir):
    """The second and third characters of every part name put in capitals by two edits."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("t"))
    edit = lambda k: F.struct(F.lit(k).alias("start"), F.lit(k + 1).alias("end"), F.concat(F.lit("<"), F.substring("t", k + 1, 1), F.lit(">")).alias("correction"))
    return rows.select("p_partkey", editing.spliced(F.col("t"), F.array(edit(1), edit(3))).alias("text"))


def case_insensitive_recall(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("hypotheses", F.transform("hypotheses", lambda h: F.upper(h)))
    rank = ev.rank_of(F.transform("hypotheses", lambda h: F.lower(h)), F.lower("expected"), 10)
    return rows.select("error_type", rank.alias("r")).groupBy("error_type").agg(*[(F.count_if(F.col("r") <= k) / F.count("*")).alias(f"recall_{k}") for k in (1, 2, 3)])


def keyboard_neighbours(spark, sf_dir):
    rows = gold(spark, sf_dir)
    return rows.select("query_id", editing.one_neighbour_key(F.col("input"), F.col("expected")).alias("neighbour"))


def brier_gain(spark, sf_dir):
    from quillspark.plans.evaluation import scored

    rows = scored(spark, sf_dir)
    y = F.col("label").cast("double")
    base = rows.agg(F.avg(y)).first()[0] or 0.0
    gain = (F.lit(base) - y) * (F.lit(base) - y) - (F.col("probability") - y) * (F.col("probability") - y)
    return cu.paired_bootstrap(rows.select("doc_id", gain.alias("gain")), "doc_id", "gain")


def boosted_trees(spark, sf_dir):
    """Boosted trees on query flags against the hash folds: how often they are right on the held-out third."""
    rows = ev.flags(predictions(spark, sf_dir)).select("query_id", F.col("before").cast("double").alias("before"), F.col("chars").cast("double").alias("chars"), F.col("changed").cast("double").alias("changed"), F.col("exact").cast("double").alias("label"), (hash60("gbt", F.col("query_id")) % 3 == 0).alias("held"))
    rows = materialized(rows, "flags")
    model = cu.boosted_trees(rows.filter("not held"), ["before", "chars", "changed"], "label")
    return model.transform(rows.filter("held")).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def canonical_targets(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
    return rows.select("doc_id", "line_no", F.length(editing.canonical_target("line")).cast("bigint").alias("n_chars"))


def pair_features(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.select("query_id", F.round(editing.match_ratio("input", "output"), 6).alias("ratio"), editing.case_signature("input").alias("case"))


QUERIES = [safe_queries, token_compatible, zero_click_counts, unique_match, blocked_match, clear_winner, held_out_runs, adjacent_removed, spliced_text, case_insensitive_recall, keyboard_neighbours, brier_gain, boosted_trees, canonical_targets, pair_features]

_WORDS = r"len(list_filter(regexp_split_to_array({c}, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"
SQL = {
    "safe_queries": rf"WITH {_RAW_LINES} SELECT doc_id, count(*) FILTER (WHERE length(line) <= 100 AND NOT regexp_matches(line, '(^|[^0-9])(\+?84|0)([ .\-]?[0-9]){{8,10}}([^0-9]|$)') AND NOT regexp_matches(line, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}')) AS safe, count(*) AS n FROM ln GROUP BY doc_id",
    "token_compatible": f"WITH {GOLD} SELECT error_type, count(*) AS n, count(*) FILTER (WHERE {_WORDS.format(c='output')} > 0 AND {_WORDS.format(c='output')} = {_WORDS.format(c='expected')}) AS kept FROM pred GROUP BY error_type",
    "zero_click_counts": f"WITH {_RAW_LINES} SELECT lower(line) AS key, count(*) AS frequency, arg_min(line, doc_id * 100000 + line_no) AS form FROM ln GROUP BY 1",
    "unique_match": "WITH n AS (SELECT lower(p_name) AS f, min(p_name) AS target FROM part GROUP BY 1 HAVING count(DISTINCT p_name) = 1) SELECT p_partkey AS query_id, target FROM part JOIN n ON lower(upper(p_name)) = f",
    "blocked_match": f"""WITH {GOLD}, q AS (SELECT DISTINCT input AS query FROM gold), n AS (SELECT DISTINCT lower(p_name) AS name FROM part),
m AS (SELECT query, name, 1 - levenshtein(query, name) / greatest(length(query), length(name)) AS score FROM q JOIN n ON substr(query, 1, 3) = substr(name, 1, 3) AND abs(length(query) // 5 - length(name) // 5) <= 1),
r AS (SELECT *, row_number() OVER w AS k, score - coalesce(lead(score) OVER w, 0) AS gap FROM m WINDOW w AS (PARTITION BY query ORDER BY score DESC, name)) SELECT query, name, round(score, 6) AS score, round(gap, 6) AS gap FROM r WHERE k = 1 AND score >= 0.85 AND gap >= 0.03""",
    "clear_winner": f"""WITH {pc.SENTENCES}, r AS (SELECT replace(strip_accents(term), 'đ', 'd') AS token, term, count AS frequency, row_number() OVER w AS k, coalesce(lead(count) OVER w, 0) AS rival FROM vocab WINDOW w AS (PARTITION BY replace(strip_accents(term), 'đ', 'd') ORDER BY count DESC, term))
SELECT token, term, frequency, rival FROM r WHERE k = 1 AND frequency >= 50 AND frequency >= 5 * rival""",
    "held_out_runs": f"WITH {pc.SENTENCES}, s AS (SELECT doc_id, chr(1) || array_to_string(list_transform(ts, lambda t: lower(t)), chr(1)) || chr(1) AS x FROM raw) SELECT doc_id FROM s WHERE contains(x, chr(1) || 'all' || chr(1) || 'rights' || chr(1) || 'reserved' || chr(1)) OR contains(x, chr(1) || 'mit' || chr(1) || 'license' || chr(1))",
    "adjacent_removed": f"WITH {_RAW_LINES} SELECT doc_id, line_no, len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) AS removed FROM l WHERE len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) > 0",
    "spliced_text": "SELECT p_partkey, substr(p_name, 1, 1) || '<' || substr(p_name, 2, 1) || '>' || substr(p_name, 3, 1) || '<' || substr(p_name, 4, 1) || '>' || substr(p_name, 5) AS text FROM part",
    "case_insensitive_recall": f"""WITH {GOLD}, r AS (SELECT error_type, CASE WHEN output = expected THEN 1 WHEN input = expected THEN 2 WHEN m <> 0 THEN CASE WHEN output = input THEN 2 ELSE 3 END END AS r FROM pred)
SELECT error_type, count(*) FILTER (WHERE r <= 1) / count(*) AS recall_1, count(*) FILTER (WHERE r <= 2) / count(*) AS recall_2, count(*) FILTER (WHERE r <= 3) / count(*) AS recall_3 FROM r GROUP BY error_type""",
    "keyboard_neighbours": f"""WITH {GOLD} SELECT query_id, error_type = 'replace' AND substr(expected, 1, 1) IN ('a', 's', 'd', 'z', 'c') AS neighbour FROM gold""",
}
