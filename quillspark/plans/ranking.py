"""Queries of language models, candidate ranking and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import predicates, tokens as tk
from quillspark.functions.hashing import hash60
from quillspark.operators import channel, classifier, corpus, ranking, search
from quillspark.plans import corpus as pc
from quillspark.storage import materialized, table

ORDER = 3


def asked(spark: SparkSession, sf_dir: str, backward: bool = False) -> DataFrame:
    """Every token of the benchmark with the words before it (after it, nearest last, if ``backward``) in its sentence."""
    rows = tk.sentences(table(spark, sf_dir, "benchmark"), "item_id")
    words = F.reverse("tokens") if backward else F.col("tokens")
    rows = rows.select("item_id", "sentence_id", words.alias("ws"))
    rows = rows.select("item_id", "sentence_id", "ws", F.posexplode("ws").alias("at", "token"))
    history = F.when(F.col("at") > 0, F.slice("ws", F.greatest(F.col("at") - (ORDER - 2), F.lit(1)), F.least(F.col("at"), F.lit(ORDER - 1)))).otherwise(F.array().cast("array<string>"))
    position = F.size("ws") - 1 - F.col("at") if backward else F.col("at")
    return rows.select("item_id", "sentence_id", position.cast("bigint").alias("position"), "token", history.alias("history"))


def lm_scores(spark: SparkSession, sf_dir: str, *backward: bool) -> list[DataFrame]:
    """Scores in each of the directions, from one count of the n-grams that any of them asks for.

    Histories end at their sentence, so no padding is asked for, and an n-gram read backward
    occurs as often as its words turned round.
    """
    rows = [materialized(asked(spark, sf_dir, b), "asked") for b in backward]
    grams = [r.select(F.explode(F.array(*ranking.asked_grams(ORDER).values())).alias("ngram")) for r in rows]
    wanted = reduce(DataFrame.union, [ranking.turned(g) if b else g for g, b in zip(grams, backward, strict=True)])
    counts, total = ranking.wanted_counts(pc.sentences(spark, sf_dir), wanted, ORDER)
    return [ranking.backoff_scores(r, ranking.turned(counts) if b else counts, total, ORDER) for r, b in zip(rows, backward, strict=True)]


def backoff_scores(spark, sf_dir):
    (scores,) = lm_scores(spark, sf_dir, False)
    return scores.select("item_id", "sentence_id", "position", "token", F.round("score", 6).alias("score"))


def bidirectional_scores(spark, sf_dir):
    forward, back = lm_scores(spark, sf_dir, False, True)
    back = back.select(F.col("item_id").alias("i"), F.col("sentence_id").alias("s"), F.col("position").alias("p"), F.col("score").alias("back"))
    both = forward.join(back, (F.col("item_id") == F.col("i")) & (F.col("sentence_id") == F.col("s")) & (F.col("position") == F.col("p")))
    return both.select("item_id", "sentence_id", "position", F.round(F.col("score") + F.col("back"), 6).alias("score"))


def observed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = materialized(pc.vocabulary(spark, sf_dir), "vocabulary")
    terms = tk.sentences(table(spark, sf_dir, "benchmark"), "item_id").select(F.explode("tokens").alias("term")).distinct()
    return ranking.candidates(terms, vocab.filter(F.col("count") >= pc.INDEXED))


def candidate_preselect(spark, sf_dir):
    picked = ranking.preselected(observed_candidates(spark, sf_dir), -F.col("distance").cast("double") * 3, 20)
    return picked.select("observed", "term", "frequency", F.col("distance").cast("bigint").alias("distance"), F.round("pre_score", 6).alias("pre_score"), F.col("place").cast("bigint").alias("place"))


def mined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and error triples of the documents, written once."""
    vocab, pairs, context = pc.mining_tables(spark, sf_dir)
    return vocab, materialized(search.error_triples(context, pairs), "triples")


def intended_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every mined misspelling with the intended term, a distance channel and log frequency as language model."""
    vocab, triples = mined(spark, sf_dir)
    main = triples.groupBy("observed").agg(F.max_by("intended", F.struct("count", "intended")).alias("intended"))
    found = ranking.candidates(main.select(F.col("observed").alias("term")), vocab.filter(F.col("count") >= pc.INDEXED))
    rows = found.join(main, "observed").withColumn("error_score", -F.col("distance").cast("double") * 3)
    total = vocab.agg(F.sum("count")).first()[0] or 1
    return rows.withColumn("lm_score", F.ln(F.col("frequency") / total)).withColumn("length", F.least(F.length("observed"), F.lit(4)))


def ranked_candidates(spark, sf_dir):
    rows = ranking.ranked(intended_candidates(spark, sf_dir), ["observed"], F.lit(0.5))
    return rows.select("observed", "term", "intended", F.round("combined", 6).alias("combined"), F.col("rank").cast("bigint").alias("rank"))


def lambda_mrr(spark, sf_dir):
    tuned = ranking.tune_weights(intended_candidates(spark, sf_dir), "observed", ["length"])
    return tuned.select("length", "weight", F.round("mrr", 6).alias("mrr"), "n")


def channel_parts(spark, sf_dir):
    """The learnt table of the error channel."""
    _, triples = mined(spark, sf_dir)
    return channel.part_counts(triples)


def corrections(spark, sf_dir):
    """The whole of it on mined misspellings and as many frequent right terms: learnt channel, rank, features, three classifiers, decision.

    The terms are taken without their contexts, so that the sizes of these are 0.
    """
    vocab, triples = mined(spark, sf_dir)
    learnt = channel.fitted(triples)
    main = triples.groupBy("observed").agg(F.max_by("intended", F.struct("count", "intended")).alias("intended"))
    right = vocab.filter(F.col("count") >= 50).join(main.select(F.col("observed").alias("term")), "term", "left_anti").select(F.col("term").alias("observed"), F.col("term").alias("intended"))
    terms = materialized(main.unionByName(right), "terms")
    found = materialized(ranking.candidates(terms.select(F.col("observed").alias("term")), vocab.filter(F.col("count") >= pc.INDEXED)), "candidates")
    total = vocab.agg(F.sum("count")).first()[0] or 1
    scored = ranking.preselected(found, channel.channel_score(learnt, F.col("term"), F.col("observed")))
    scored = scored.withColumn("lm_score", F.ln(F.col("frequency") / total))
    rows = ranking.features(ranking.ranked(scored, ["observed"], F.lit(1.0)), ["observed"]).join(terms, "observed")
    rows = ranking.confidence_features(rows.withColumns({"left_length": F.lit(0), "right_length": F.lit(0)}))
    rows = materialized(rows.withColumns({"misspelled": (F.col("observed") != F.col("intended")).cast("int"), "top_right": F.coalesce((F.col("suggestion") == F.col("intended")).cast("int"), F.lit(0))}), "features")
    model = classifier.fit_confidence(rows, list(ranking.FEATURES), held=hash60("develop", F.col("observed")) % 5 == 0, steps=8)
    judged = model.judged(rows).withColumn("blacklisted", predicates.blacklisted(F.col("observed")))
    return ranking.decide(judged, F.col("spell_threshold"), F.col("correct_threshold")).select("observed", "intended", "suggestion", "action", "correction", F.round("spell_probability", 4).alias("spell_probability"), F.round("correct_probability", 4).alias("correct_probability"))


QUERIES = [backoff_scores, bidirectional_scores, candidate_preselect, ranked_candidates, lambda_mrr, channel_parts, corrections]


def _lm(name: str, backward: bool) -> str:
    order, sign = ("DESC", -1) if backward else ("ASC", 1)
    return f"""
{name}_s AS (SELECT list_concat(['<s>', '<s>'], list_append(list(term ORDER BY i {order}), '</s>')) AS p FROM lex GROUP BY doc_id, sentence_id),
{name}_c AS (SELECT g, count(*) AS c FROM (SELECT unnest(list_concat(list_concat(p, list_transform(range(1, len(p)), lambda k: array_to_string(p[k:k + 1], ' '))), list_transform(range(1, len(p) - 1), lambda k: array_to_string(p[k:k + 2], ' ')))) AS g FROM {name}_s) GROUP BY g),
{name}_t AS (SELECT sum(c) AS total FROM {name}_c WHERE NOT contains(g, ' ')),
{name}_q AS (SELECT item_id, sentence_id, position, term, lag(term) OVER w AS h1, lag(term, 2) OVER w AS h2 FROM bl WINDOW w AS (PARTITION BY item_id, sentence_id ORDER BY {sign} * position)),
{name} AS (SELECT item_id, sentence_id, position, term,
  CASE WHEN h2 IS NOT NULL AND g3.c IS NOT NULL THEN ln(g3.c / b3.c) WHEN h1 IS NOT NULL AND g2.c IS NOT NULL THEN ln(g2.c / b2.c) + (CASE WHEN h2 IS NULL THEN 0 ELSE 1 END) * ln(0.4)
    WHEN g1.c IS NOT NULL THEN ln(g1.c / total) + (CASE WHEN h2 IS NOT NULL THEN 2 WHEN h1 IS NOT NULL THEN 1 ELSE 0 END) * ln(0.4) ELSE ln(1e-9) END AS score
  FROM {name}_q CROSS JOIN {name}_t LEFT JOIN {name}_c g3 ON g3.g = h2 || ' ' || h1 || ' ' || term LEFT JOIN {name}_c b3 ON b3.g = h2 || ' ' || h1
  LEFT JOIN {name}_c g2 ON g2.g = h1 || ' ' || term LEFT JOIN {name}_c b2 ON b2.g = h1 LEFT JOIN {name}_c g1 ON g1.g = term)"""


_BENCH = rf"""
braw AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{pc.TOKENS}') AS ts FROM benchmark),
btok AS (SELECT item_id, i, ts[i] AS surface FROM (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM braw)),
bsid AS (SELECT *, coalesce(sum(CASE WHEN surface IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence_id FROM btok),
bl AS (SELECT item_id, sentence_id, lower(surface) AS term, row_number() OVER (PARTITION BY item_id, sentence_id ORDER BY i) - 1 AS position FROM bsid WHERE regexp_matches(surface, '[\p{{L}}\p{{N}}]'))"""
_KEYS = "list_append(list_transform(range(1, length(term) + 1), lambda i: substr(term, 1, i - 1) || substr(term, i + 1)), term)"
_ONE = """(a.term = b.term OR length(a.term) <> length(b.term) OR len(list_filter(range(1, length(a.term) + 1), lambda g: substr(a.term, 1, g - 1) || substr(a.term, g + 1) = substr(b.term, 1, g - 1) || substr(b.term, g + 1))) > 0
  OR len(list_filter(range(1, length(a.term)), lambda g: substr(a.term, 1, g - 1) || substr(a.term, g + 1, 1) || substr(a.term, g, 1) || substr(a.term, g + 2) = b.term)) > 0)"""


def _found(observed: str) -> str:
    return f"""
ok AS (SELECT DISTINCT term, unnest({_KEYS}) AS k FROM {observed}),
vk AS (SELECT DISTINCT term, count, unnest({_KEYS}) AS k FROM vocab WHERE count >= {pc.INDEXED}),
cmet AS (SELECT DISTINCT a.term AS observed, b.term, b.count AS frequency FROM ok a JOIN vk b ON a.k = b.k WHERE {_ONE}),
cand AS (SELECT observed, term, frequency, CASE WHEN observed = term THEN 0 ELSE 1 END AS distance FROM cmet
  UNION ALL SELECT term, term, 1, 0 FROM (SELECT DISTINCT term FROM {observed}) WHERE term NOT IN (SELECT observed FROM cmet WHERE observed = term))"""


_TRIPLES = pc.SQL["error_triples"]
_MAIN = f"""{_TRIPLES.rpartition("SELECT intended, observed, CAST")[0]},
trip AS (SELECT intended, observed, CAST(sum(oc) AS BIGINT) AS count FROM won WHERE ic = m AND ties = 1 AND m > oc GROUP BY ALL),
main AS (SELECT observed AS term, observed, arg_max(intended, (count, intended)) AS intended FROM trip GROUP BY observed), {_found("main")},
sc AS (SELECT c.observed, c.term, intended, frequency, distance, -3.0 * distance AS e, ln(frequency / (SELECT sum(count) FROM vocab)) AS lm FROM cand c JOIN main m ON c.observed = m.observed)"""
SQL = {
    "backoff_scores": f"WITH {pc.SENTENCES}, {_BENCH}, {_lm('f', False)} SELECT item_id, CAST(sentence_id AS INTEGER) AS sentence_id, position, term AS token, round(score, 6) AS score FROM f",
    "bidirectional_scores": f"WITH {pc.SENTENCES}, {_BENCH}, {_lm('f', False)}, {_lm('r', True)} SELECT item_id, CAST(sentence_id AS INTEGER) AS sentence_id, position, round(f.score + r.score, 6) AS score FROM f JOIN r USING (item_id, sentence_id, position)",
    "candidate_preselect": f"""WITH {pc.SENTENCES}, {_BENCH}, {_found("bl")}, s AS (SELECT *, ln(frequency) - 3.0 * distance AS pre FROM cand),
n AS (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY pre DESC, distance, frequency DESC, term) AS place FROM s) SELECT observed, term, frequency, CAST(distance AS BIGINT) AS distance, round(pre, 6) AS pre_score, place FROM n WHERE place <= 20 OR observed = term""",
    "ranked_candidates": f"{_MAIN} SELECT observed, term, intended, round(e + 0.5 * lm, 6) AS combined, row_number() OVER (PARTITION BY observed ORDER BY e + 0.5 * lm DESC, distance, frequency DESC, term) AS rank FROM sc",
    "lambda_mrr": f"""{_MAIN}, g AS (SELECT sc.*, l * 0.25 AS weight FROM sc, range(0, 41) r(l)),
n AS (SELECT *, row_number() OVER (PARTITION BY observed, weight ORDER BY -(e + weight * lm), distance, frequency DESC, term) AS rk FROM g),
k AS (SELECT least(length(observed), 4) AS length, weight, avg(1.0 / rk) AS mrr, count(*) AS n FROM n WHERE term = intended GROUP BY ALL)
SELECT CAST(length AS INTEGER) AS length, CAST(arg_max(weight, (round(mrr, 12), -weight)) AS DOUBLE) AS weight, round(max(mrr), 6) AS mrr, max(n) AS n FROM k GROUP BY length""",
}
