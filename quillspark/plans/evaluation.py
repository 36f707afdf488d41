"""Queries over predictions, made from part names, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import evaluation as ev
from quillspark.storage import table

#: The made-up benchmark: every fourth part name is clean, the others have one edit; one output in three is unchanged.
GOLD = """
gold AS (SELECT p_partkey AS query_id, lower(p_name) AS expected,
  CASE p_partkey % 4 WHEN 0 THEN lower(p_name) WHEN 1 THEN substr(lower(p_name), 1, 1) || substr(lower(p_name), 3)
    WHEN 2 THEN substr(lower(p_name), 2, 1) || substr(lower(p_name), 1, 1) || substr(lower(p_name), 3) ELSE 'x' || substr(lower(p_name), 2) END AS input,
  CASE p_partkey % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'delete' WHEN 2 THEN 'swap' ELSE 'replace' END AS error_type FROM part),
pred AS (SELECT query_id, input, expected, error_type,
  CASE WHEN query_id % 11 = 0 THEN expected || ' x' WHEN query_id % 3 = 0 THEN input ELSE expected END AS output, query_id % 7 AS m FROM gold)"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.lower("p_name")
    rest = lambda n: F.substring(name, F.lit(n), F.length(name))
    noisy = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.substring(name, 1, 1), rest(3))).when(k % 4 == 2, F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), rest(3))).otherwise(F.concat(F.lit("x"), rest(2)))
    kind = F.element_at(F.array(*map(F.lit, ("clean", "delete", "swap", "replace"))), (k % 4 + 1).cast("int"))
    return part.select(k.alias("query_id"), name.alias("expected"), noisy.alias("input"), kind.alias("error_type"))


def predictions(spark: SparkSession, sf_dir: str, modulus: int = 3) -> DataFrame:
    rows = gold(spark, sf_dir)
    k = F.col("query_id")
    output = F.when(k % 11 == 0, F.concat("expected", F.lit(" x"))).when(k % modulus == 0, F.col("input")).otherwise(F.col("expected"))
    rows = rows.withColumn("output", output)
    return rows.withColumn("hypotheses", F.when(k % 7 == 0, F.array("output", "input")).otherwise(F.array("output", "input", "expected")))


def strict_join(spark, sf_dir):
    joined = ev.strict_join(gold(spark, sf_dir), predictions(spark, sf_dir))
    return joined.select("query_id", "input", "expected", "error_type", "output")


def query_flags(spark, sf_dir):
    return ev.flags(predictions(spark, sf_dir)).select("query_id", "noisy", "changed", "exact", "before", "after", F.coalesce(F.col("rank"), F.lit(0)).cast("bigint").alias("rank"))


def score_card(spark, sf_dir):
    return ev.score_card(predictions(spark, sf_dir))


def regressions(spark, sf_dir):
    return ev.flags(predictions(spark, sf_dir)).filter("after > before").select("query_id", "input", "expected", "output")


def error_taxonomy(spark, sf_dir):
    return ev.error_taxonomy(predictions(spark, sf_dir)).groupBy("error_type", "kind").agg(F.count("*").alias("n"))


def two_by_two(spark, sf_dir):
    ok = lambda m: predictions(spark, sf_dir, m).select("query_id", (F.col("output") == F.col("expected")).alias("ok"))
    return ev.two_by_two(ok(3), ok(5), "query_id")


def parity(spark, sf_dir):
    return ev.parity(predictions(spark, sf_dir), predictions(spark, sf_dir, 5), "query_id")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    action = F.when(F.col("query_id") % 5 == 0, "flag").when(F.col("output") == F.col("input"), "keep").otherwise("correct")
    return rows.select((F.col("input") != F.col("expected")).alias("misspelled"), action.alias("action"), F.col("output").alias("correction"), F.col("expected").alias("intended"))


def token_error_classes(spark, sf_dir):
    return ev.token_error_classes(decisions(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels with a made-up probability, from the id's hash and the label."""
    labels = table(spark, sf_dir, "labels")
    base = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 6), 16, 10).cast("bigint")
    p = (F.pmod(base, F.lit(700)) + 300 * F.col("quality")) / 1000.0
    return labels.select("doc_id", (F.col("quality") == 1).alias("label"), p.alias("probability"), p.alias("score"), F.pmod(F.col("doc_id"), F.lit(3)).alias("rank"))


def best_f1_threshold(spark, sf_dir):
    return ev.best_f1_threshold(scored(spark, sf_dir))


def probability_metrics(spark, sf_dir):
    return ev.probability_metrics(scored(spark, sf_dir))


def calibration_bins(spark, sf_dir):
    return ev.calibration_bins(scored(spark, sf_dir))


def rank_prior(spark, sf_dir):
    """Smoothed share of positives at each rank: (positives + 1) / (n + 2)."""
    return scored(spark, sf_dir).groupBy("rank").agg(F.count("*").alias("n"), ((F.count_if("label") + 1) / (F.count("*") + 2)).alias("prior"))


def classifier_prf(spark, sf_dir):
    rows = scored(spark, sf_dir).select("label", (F.col("score") >= 0.5).alias("said"))
    one = rows.agg(F.count_if(F.col("label") & F.col("said")).alias("tp"), F.count_if(~F.col("label") & F.col("said")).alias("fp"), F.count_if(F.col("label") & ~F.col("said")).alias("fn"))
    c = F.col
    return one.withColumns({"precision": ev.ratio(c("tp"), c("tp") + c("fp")), "recall": ev.ratio(c("tp"), c("tp") + c("fn")), "f1": ev.ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))})


def latency_summary(spark, sf_dir):
    return ev.latency_summary(table(spark, sf_dir, "events"), "value", "event_type")


def nearest_rank_quantiles(spark, sf_dir):
    return ev.nearest_rank(table(spark, sf_dir, "events"), "value", "event_type")


def score_gap_features(spark, sf_dir):
    """Each candidate's gaps to its neighbours and to the first, in the order of a query's scores."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    return rows.select(
        "event_id",
        F.row_number().over(w).cast("bigint").alias("rank"),
        (F.lag("value").over(w) - F.col("value")).alias("gap_before"),
        (F.col("value") - F.lead("value").over(w)).alias("gap_after"),
        (F.first("value").over(w) - F.col("value")).alias("gap_first"),
    )


def gate_check(spark, sf_dir):
    card = ev.score_card(predictions(spark, sf_dir)).filter("error_type = 'all'")
    names = ("clean_preservation", "exact_noisy", "cer_after", "recall_5")
    metrics = card.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")
    limits = spark.createDataFrame([("clean_preservation", 0.9, True), ("exact_noisy", 0.5, True), ("cer_after", 0.5, False), ("absent", 0.1, True)], "metric string, limit double, at_least boolean")
    return ev.gate(metrics, limits)


QUERIES = [strict_join, query_flags, score_card, regressions, error_taxonomy, two_by_two, parity, token_error_classes, best_f1_threshold, probability_metrics, calibration_bins, rank_prior, classifier_prf, latency_summary, nearest_rank_quantiles, score_gap_features, gate_check]

_FLAGS = f"""{GOLD},
fl AS (SELECT *, input <> expected AS noisy, output <> input AS changed, output = expected AS exact, levenshtein(input, expected) AS before, levenshtein(output, expected) AS after,
  CASE WHEN output = expected THEN 1 WHEN input = expected THEN 2 WHEN m <> 0 THEN CASE WHEN output = input THEN 2 ELSE 3 END END AS rank FROM pred)"""
_CARD = f"""{_FLAGS},
agg AS (SELECT CASE WHEN grouping(error_type) = 1 THEN 'all' ELSE error_type END AS error_type, count(*) AS queries, count(*) FILTER (WHERE NOT noisy) AS clean,
  count(*) FILTER (WHERE noisy AND changed) AS tp, count(*) FILTER (WHERE NOT noisy AND changed) AS fp, count(*) FILTER (WHERE noisy AND NOT changed) AS fn, count(*) FILTER (WHERE NOT noisy AND NOT changed) AS tn,
  count(*) FILTER (WHERE noisy AND changed AND exact) AS corrected, count(*) FILTER (WHERE exact) AS ex, count(*) FILTER (WHERE noisy AND exact) AS exn,
  count(*) FILTER (WHERE after < before) AS improved, count(*) FILTER (WHERE after > before) AS regressed, sum(before) AS b, sum(after) AS a, sum(greatest(length(expected), 1)) AS c,
  avg(before / greatest(length(expected), 1)) AS cer_before_macro, avg(after / greatest(length(expected), 1)) AS cer_after_macro, avg(coalesce(1.0 / rank, 0)) AS mrr_10,
  {", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS h{k}" for k in (1, 3, 5, 10))}
  FROM fl GROUP BY GROUPING SETS ((), (error_type))),
card AS (SELECT error_type, queries, tp, fp, fn, tn, improved, regressed, CASE WHEN clean > 0 THEN tn / clean ELSE 0.0 END AS clean_preservation,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS detection_precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS detection_recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS detection_f1, CASE WHEN tp + fp > 0 THEN corrected / (tp + fp) ELSE 0.0 END AS correction_precision,
  CASE WHEN tp + fn > 0 THEN corrected / (tp + fn) ELSE 0.0 END AS correction_recall, CASE WHEN tp + fn > 0 THEN exn / (tp + fn) ELSE 0.0 END AS exact_noisy, ex / queries AS exact,
  {", ".join(f"h{k} / queries AS recall_{k}" for k in (1, 3, 5, 10))}, mrr_10, b / c AS cer_before, a / c AS cer_after, cer_before_macro, cer_after_macro FROM agg)"""
_SCORED = "sc AS (SELECT doc_id, quality = 1 AS label, (CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) % 700 + 300 * quality) / 1000.0 AS p, doc_id % 3 AS rank FROM labels)"
_P5 = "CASE WHEN query_id % 11 = 0 THEN expected || ' x' WHEN query_id % 5 = 0 THEN input ELSE expected END"
SQL = {
    "strict_join": f"WITH {GOLD} SELECT query_id, input, expected, error_type, output FROM pred",
    "query_flags": f"WITH {_FLAGS} SELECT query_id, noisy, changed, exact, CAST(before AS INTEGER) AS before, CAST(after AS INTEGER) AS after, CAST(coalesce(rank, 0) AS BIGINT) AS rank FROM fl",
    "score_card": f"WITH {_CARD} SELECT * FROM card",
    "regressions": f"WITH {_FLAGS} SELECT query_id, input, expected, output FROM fl WHERE after > before",
    "error_taxonomy": f"""WITH {GOLD}, k AS (SELECT error_type, CASE WHEN output = expected THEN 'right' WHEN input = expected THEN 'copy_broken' WHEN output = input THEN 'no_op'
WHEN regexp_replace(output, '[^a-z0-9 ]', '', 'g') = regexp_replace(expected, '[^a-z0-9 ]', '', 'g') THEN 'marks_only' WHEN len(string_split(output, ' ')) > len(string_split(expected, ' ')) THEN 'over_expansion'
WHEN len(string_split(output, ' ')) < len(string_split(expected, ' ')) THEN 'under_expansion' ELSE 'token_substitution' END AS kind FROM pred) SELECT error_type, kind, count(*) AS n FROM k GROUP BY ALL""",
    "two_by_two": f"WITH {GOLD} SELECT output = expected AS first_ok, {_P5} = expected AS second_ok, count(*) AS n FROM pred GROUP BY ALL",
    "parity": f"""WITH {GOLD}, b AS (SELECT query_id, output, {_P5} AS o2, CASE WHEN m = 0 THEN [output, input] ELSE [output, input, expected] END AS h FROM pred), c AS (SELECT *, list_concat([o2], h[2:]) AS h2 FROM b)
SELECT query_id, output = o2 AS same_output, h = h2 AS same_order, list_sort(list_distinct(h)) = list_sort(list_distinct(h2)) AS same_set FROM c""",
    "token_error_classes": f"""WITH {GOLD}, d AS (SELECT input <> expected AS bad, CASE WHEN query_id % 5 = 0 THEN 'flag' WHEN output = input THEN 'keep' ELSE 'correct' END AS act, output, expected FROM pred),
e AS (SELECT count(*) AS tokens, count(*) FILTER (WHERE bad) AS misspelled_tokens, count(*) FILTER (WHERE bad AND act = 'keep') AS e1, count(*) FILTER (WHERE bad AND act = 'flag') AS e2,
count(*) FILTER (WHERE bad AND act = 'correct' AND output <> expected) AS e3, count(*) FILTER (WHERE NOT bad AND act = 'flag') AS e4, count(*) FILTER (WHERE NOT bad AND act = 'correct') AS e5 FROM d)
SELECT *, (e1 + e2 + e3 + e4) / tokens AS cer, (e3 + e5) / tokens AS fer, (e1 + e2 + e3 + e4 + e5) / tokens AS ter FROM e""",
    "best_f1_threshold": f"""WITH {_SCORED}, per AS (SELECT p, count(*) FILTER (WHERE label) AS pos, count(*) AS n FROM sc GROUP BY p),
r AS (SELECT p, sum(pos) OVER w AS tp, sum(n) OVER w AS found, sum(pos) OVER () AS positives FROM per WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT p AS threshold, 2 * tp / (found + positives) AS f1, CAST(tp AS BIGINT) AS tp, CAST(found AS BIGINT) AS found, CAST(positives AS BIGINT) AS positives FROM r ORDER BY f1 DESC, p DESC LIMIT 1""",
    "probability_metrics": f"""WITH {_SCORED}, y AS (SELECT p, CAST(label AS INTEGER) AS y, greatest(least(p, 1 - 1e-12), 1e-12) AS q FROM sc),
b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM y GROUP BY 1)
SELECT count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss, avg(CAST(p >= 0.8 AS INTEGER)) AS share_from_08, (SELECT sum(n * abs(mp - my)) / sum(n) FROM b) AS ece_10 FROM y""",
    "calibration_bins": f"WITH {_SCORED} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_probability, avg(CAST(label AS INTEGER)) AS positive_share FROM sc GROUP BY 1",
    "rank_prior": f"WITH {_SCORED} SELECT rank, count(*) AS n, (count(*) FILTER (WHERE label) + 1) / (count(*) + 2) AS prior FROM sc GROUP BY rank",
    "classifier_prf": f"""WITH {_SCORED}, o AS (SELECT count(*) FILTER (WHERE label AND p >= 0.5) AS tp, count(*) FILTER (WHERE NOT label AND p >= 0.5) AS fp, count(*) FILTER (WHERE label AND p < 0.5) AS fn FROM sc)
SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM o""",
    "latency_summary": "SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, avg(value) AS mean, stddev_pop(value) AS deviation, count(*) * 1000 / sum(value) AS per_second FROM events GROUP BY event_type",
    "nearest_rank_quantiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS at_, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (WHERE at_ = round_even((n - 1) * 0.1, 0)) AS q10, max(value) FILTER (WHERE at_ = round_even((n - 1) * 0.5, 0)) AS q50, max(value) FILTER (WHERE at_ = round_even((n - 1) * 0.9, 0)) AS q90 FROM r GROUP BY event_type""",
    "score_gap_features": "SELECT event_id, row_number() OVER w AS rank, lag(value) OVER w - value AS gap_before, value - lead(value) OVER w AS gap_after, first_value(value) OVER w - value AS gap_first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)",
    "gate_check": f"""WITH {_CARD}, mt AS (SELECT unnest(['clean_preservation', 'exact_noisy', 'cer_after', 'recall_5']) AS metric, unnest([clean_preservation, exact_noisy, cer_after, recall_5]) AS value FROM card WHERE error_type = 'all'),
lm("metric", "limit", at_least) AS (VALUES ('clean_preservation', 0.9, true), ('exact_noisy', 0.5, true), ('cer_after', 0.5, false), ('absent', 0.1, true)),
j AS (SELECT lm.metric, CAST("limit" AS DOUBLE) AS "limit", at_least, value, coalesce(CASE WHEN at_least THEN value >= "limit" ELSE value <= "limit" END, false) AS passed FROM lm LEFT JOIN mt USING (metric))
SELECT *, bool_and(passed) OVER () AS all_passed FROM j""",
}
