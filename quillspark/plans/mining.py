"""Queries of mining filters, clean queries, made-up pairs and their families."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import ime, predicates
from quillspark.functions import rules as ru
from quillspark.functions.hashing import hash60
from quillspark.functions.normalize import arrow, lower_nfc, plain_text
from quillspark.functions.rules import protection
from quillspark.operators import corpus, curation as cu, prepare as pr, search, slots
from quillspark.plans import corpus as pc
from quillspark.plans.evaluation import GOLD, gold
from quillspark.plans.quality import _LINES, lines
from quillspark.storage import materialized, table

#: Anchors of the documents' own languages: the default ones stand in no document of the test tables.
ANCHORS, GENERIC, RESERVED = ("the", "of", "la", "der"), ("and", "a", "to", "in"), ("tot", "ias")
LEAST = 20


def judged_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Contexts of observed terms, and close pairs with the verdict of the blacklist and the word test, each written once."""
    _, pairs, context = pc.mining_tables(spark, sf_dir)
    return context, materialized(search.minable_pairs(pairs), "judged")


def web_error_triples(spark, sf_dir):
    """Error triples of pairs whose terms are like words and not blacklisted."""
    context, judged = judged_pairs(spark, sf_dir)
    return search.error_triples(context, judged.filter("not excluded").drop("excluded"))


def mining_counters(spark, sf_dir):
    context, judged = judged_pairs(spark, sf_dir)
    return search.mining_counters(judged, search.error_triples(context, judged.filter("not excluded").drop("excluded")))


def clean_queries(spark, sf_dir):
    """Documents' lines of which every word is a term of at least INDEXED occurrences or has no letter."""
    vocab = pc.vocabulary(spark, sf_dir).filter(F.col("count") >= pc.INDEXED)
    rows = lines(spark, sf_dir).select(F.concat_ws("-", F.col("doc_id"), F.col("line_no")).alias("line_id"), "lw")
    return cu.clean_queries(materialized(rows, "lines"), "line_id", "lw", materialized(vocab, "lexicon"))


def composable_targets(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(predicates.composable(F.col("line"))).alias("composable"), F.count_if(predicates.looks_incomplete(F.col("line"), ENDINGS)).alias("incomplete"))


ENDINGS = (" a", " the", " de", " la", " un")


def dominant_return_flag(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("bigint").alias("at"))
    return cu.dominant(rows, "l_orderkey", "l_returnflag", "at")


def substitution_pairs(spark, sf_dir):
    """Pairs of vocabulary terms of equal length that differ in one character: an equi-join on keys with one character left open."""
    vocab = materialized(pc.vocabulary(spark, sf_dir).filter(F.col("count") >= LEAST), "lexicon")
    keys = vocab.select("term", F.explode(corpus.substitution_keys(F.col("term"))).alias("key"))
    other = keys.select(F.col("term").alias("other"), "key")
    return keys.join(other, "key").filter(F.col("term") < F.col("other")).select("term", "other")


def runs(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """Runs of three words of the documents' lines that begin ``step`` words apart; a shorter line is one run."""
    rows = lines(spark, sf_dir).select("lw")
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size("lw") - 2, F.lit(1)), F.lit(step)), lambda i: F.array_join(F.slice("lw", i, 3), " "))
    return rows.select(F.explode(made).alias("target"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of three words of the documents' lines, each once: short queries for the generators."""
    return runs(spark, sf_dir, 1).distinct()


def tidy_words(raw: str) -> str:
    """``lower_nfc`` of each of the words between line feeds; most lines stay as they are."""
    if raw == raw.lower() and unicodedata.is_normalized("NFC", raw) and raw.replace("\n", " ") == " ".join(raw.split()):
        return raw
    return "\n".join(map(lower_nfc, raw.split("\n")))


def normalized_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, as_is: every run of ``targets``, as often as it stands, with ``lower_key`` taken of it, and whether that changed nothing.

    The key is taken of the words of a line at once, not of each run: no mark joins over a space.
    """
    each = F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = table(spark, sf_dir, "documents").select(each.alias("line")).filter("line <> ''")
    rows = rows.select(F.array_join(ru.words(F.lower("line")), "\n").alias("raw")).withColumn("tidy", arrow(tidy_words)("raw"))
    rows = rows.select(F.split("raw", "\n").alias("ws"), F.split("tidy", "\n").alias("ts"), (F.col("raw") == F.col("tidy")).alias("same"))
    run = lambda c, i: F.slice(c, i, 3)
    target = lambda i: F.when(F.col("same"), F.array_join(run("ws", i), " ")).otherwise(F.array_join(F.filter(run("ts", i), lambda w: w != ""), " "))
    as_is = lambda i: F.col("same") | (F.array_join(run("ws", i), " ") == F.array_join(run("ts", i), " "))
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 2, F.lit(1))), lambda i: F.struct(target(i).alias("target"), as_is(i).alias("as_is")))
    return rows.select(F.explode(made).alias("r")).select("r.target", "r.as_is").filter("target <> ''")


def composition_variants(spark, sf_dir):
    """Compositions of the runs that its SQL takes: those that begin three words apart."""
    return cu.composition_variants(runs(spark, sf_dir, 3).distinct(), "target", "compositions")


def acronym_candidates(spark, sf_dir):
    """Lines of up to 16 words with a run of words behind an anchor replaced by its initials; longer lines are no queries."""
    rows = lines(spark, sf_dir).filter(F.size("lw") <= 16).select("doc_id", "line_no", "lw")
    found = F.explode(cu.acronym_candidates(F.col("lw"), ANCHORS, GENERIC, RESERVED))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), found.alias("c")).select("doc_id", "line_no", "c.input", "c.short")


def typed_marks(spark, sf_dir):
    """Terms with marks as another encoder types them, by letter keys and by numbers."""
    t = F.col("term")
    vocab = pc.vocabulary(spark, sf_dir).select("term").filter(plain_text(t) != t)
    return vocab.select("term", ime.typed_marks(t, True).alias("telex"), ime.typed_marks(t, False).alias("vni"))


def token_families(spark, sf_dir):
    """Families of pairs made from terms with marks: without marks, typed by either method, and with a letter twice."""
    from quillspark.functions.distance import paired

    t = F.col("term")
    vocab = pc.vocabulary(spark, sf_dir).select("term").filter(plain_text(t) != t)
    made = F.array(plain_text(t), ime.typed_marks(t, True), ime.typed_marks(t, False), F.concat(F.substring(t, 1, 1), t))
    rows = vocab.select("term", F.posexplode(made).alias("made", "query"))
    rows = rows.withColumn("family", paired(ime.token_family, "string")("query", "term"))
    return rows.groupBy("made", "family").agg(F.count("*").alias("n"))


def slot_variants(spark, sf_dir):
    """Strict variants of all 32 families of the benchmark names; protected ones get none."""
    rows = gold(spark, sf_dir).select("query_id", "expected")
    guarded = protection(F.col("expected"), F.split("expected", " "), False).isNotNull()
    return slots.slotted(rows, "expected", "full", strict=True, protected=guarded)


def slot_profile_8(spark, sf_dir):
    return slots.slotted(gold(spark, sf_dir).select("query_id", "expected"), "expected", "small", strict=False)


def slot_family_counts(spark, sf_dir):
    """How many of the documents' runs of words each family changes, and how many different inputs that gives."""
    made = slots.slotted(targets(spark, sf_dir), "target", "full", strict=False)
    return made.groupBy("rank", "family").agg(F.count("*").alias("n"), F.count_distinct("input").alias("inputs"))


def curriculum_counts(spark, sf_dir):
    rows = gold(spark, sf_dir).select("query_id", "expected")
    return slots.curriculum(rows, "expected").groupBy("stage", "error_class").agg(F.count("*").alias("n"))


def denoising_pairs(spark, sf_dir):
    """Kinds of the pairs made of the documents' runs of words, and how many are still equal to their target."""
    pairs = slots.self_supervised(targets(spark, sf_dir), "target", "target")
    return pairs.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("input") == F.col("target")).alias("equal"))


def leaks_replaced(spark, sf_dir):
    """Noisy pairs with those whose name begins with a held-out word replaced by unused pairs."""
    rows = gold(spark, sf_dir)
    chosen, spare = rows.filter("query_id % 2 = 0"), rows.filter("query_id % 2 = 1")
    leaking = F.col("expected").rlike("^(a|b|c)")
    out = pr.leaks_replaced(chosen, leaking, spare, "query_id", hash60("leaks", F.col("query_id")))
    return out.select("query_id", "expected")


QUERIES = [
    web_error_triples, mining_counters, clean_queries, composable_targets, dominant_return_flag, substitution_pairs, composition_variants, acronym_candidates,
    typed_marks, token_families, slot_variants, slot_profile_8, slot_family_counts, curriculum_counts, denoising_pairs, leaks_replaced,
]

_MINABLE = "length({t}) BETWEEN 2 AND 64 AND NOT regexp_matches({t}, '\\p{{Nd}}') AND length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) * 10 >= 8 * length({t}) AND NOT regexp_full_match({t}, '\\p{{N}}+') AND NOT regexp_full_match({t}, '[\\p{{P}}\\p{{S}}]+')"
_BOTH = f"{_MINABLE.format(t='intended')} AND {_MINABLE.format(t='observed')}"
_WEB = f"""WITH {pc.SENTENCES}, {pc.CONTEXTS}, {pc.PAIRS}, ok AS (SELECT * FROM pairs WHERE {_BOTH}),
usual AS (SELECT "left", "right" FROM ctx GROUP BY ALL HAVING sum(count) >= 10),
met AS (SELECT p.intended, o.term AS observed, o."left", o."right", o.count AS oc, c.count AS ic FROM ctx o JOIN usual USING ("left", "right") JOIN ok p ON p.observed = o.term
  JOIN ctx c ON c.term = p.intended AND c."left" = o."left" AND c."right" = o."right"),
top AS (SELECT *, max(ic) OVER (PARTITION BY observed, "left", "right") AS m FROM met),
won AS (SELECT *, count(*) FILTER (WHERE ic = m) OVER (PARTITION BY observed, "left", "right") AS ties FROM top),
tri AS (SELECT intended, observed, CAST(sum(oc) AS BIGINT) AS count FROM won WHERE ic = m AND ties = 1 AND m > oc GROUP BY ALL)"""
#: Letters as the engine takes their marks off: the built-in of DuckDB, and the letters that it knows no marks of.
_PLAIN = "replace(replace(strip_accents({t}), 'đ', 'd'), 'Đ', 'D')"
_TARGETS = f"{_LINES}, tg AS (SELECT DISTINCT target FROM (SELECT unnest(list_transform(range(1, greatest(len(lw) - 2, 1) + 1, 3), lambda i: array_to_string(lw[i:i + 2], ' '))) AS target FROM l))"
_TONED, _BARE, _WHICH, _SHAPED = ime.mark_tables()


def _typed_sql(telex: bool) -> str:
    keys = ime.TELEX_TONES if telex else ime.VNI_TONES
    out = f"translate(term, '{_TONED}', '{_BARE}')"
    for letter, by_letter, by_number in _SHAPED:
        out = f"replace({out}, '{letter}', '{by_letter if telex else by_number}')"
    return f"{_PLAIN.format(t=out)} || translate(regexp_replace(term, '[^{_TONED}]', '', 'g'), '{_TONED}', '{''.join(keys[int(k)] for k in _WHICH)}')"


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _runs(n: int) -> str:
    """Starts behind the first word, and the run of n words from there with its initials."""
    return f"SELECT doc_id, line_no, lw, {n} AS n, unnest(range(2, len(lw) - {n} + 2)) AS i FROM l WHERE len(lw) > {n} AND len(lw) <= 16"


SQL = {
    "web_error_triples": f"{_WEB} SELECT intended, observed, count FROM tri",
    "mining_counters": f"{_WEB} SELECT (SELECT count(*) FROM ok) AS close_pairs_scanned, (SELECT count(*) FROM pairs) - (SELECT count(*) FROM ok) AS blacklisted_pairs_excluded, count(*) AS triples_emitted, CAST(coalesce(sum(count), 0) AS BIGINT) AS triple_occurrences FROM tri",
    "clean_queries": f"""WITH {pc.SENTENCES}, {_LINES}, each AS (SELECT doc_id || '-' || line_no AS line_id, unnest(lw) AS x FROM l)
SELECT DISTINCT line_id FROM (SELECT doc_id || '-' || line_no AS line_id FROM l) WHERE line_id NOT IN (SELECT line_id FROM each WHERE regexp_matches(x, '\\p{{L}}') AND x NOT IN (SELECT term FROM vocab WHERE count >= {pc.INDEXED}))""",
    "composable_targets": rf"""WITH {_LINES} SELECT doc_id, count(*) FILTER (WHERE regexp_full_match(line, '\p{{L}}+( \p{{L}}+){{1,5}}')) AS composable,
count(*) FILTER (WHERE regexp_matches(' ' || trim(regexp_replace(lower(line), '[ \t\n\x0B\f\r]+', ' ', 'g')), '({"|".join(ENDINGS)})$')) AS incomplete FROM l GROUP BY doc_id""",
    "dominant_return_flag": "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, n FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f, l_returnflag) = 1",
    "substitution_pairs": f"""WITH {pc.SENTENCES}, v AS (SELECT term FROM vocab WHERE count >= {LEAST})
SELECT a.term, b.term AS other FROM v a JOIN v b ON length(a.term) = length(b.term) AND a.term < b.term AND len(list_filter(range(1, length(a.term) + 1), lambda i: substr(a.term, i, 1) <> substr(b.term, i, 1))) = 1""",
    "composition_variants": rf"""WITH {_TARGETS}, e AS (SELECT target, string_split(target, ' ') AS ws, {_PLAIN.format(t='target')} AS p FROM tg WHERE regexp_full_match(target, '\p{{L}}+( \p{{L}}+){{1,5}}') AND {_PLAIN.format(t='target')} <> target),
a AS (SELECT *, CAST(CAST('0x' || substr(sha256('compositions' || chr(31) || target), 1, 15) AS BIGINT) % (len(ws) - 1) AS INTEGER) + 1 AS k FROM e),
j AS (SELECT *, array_to_string(list_concat(list_append(ws[1:k - 1], ws[k] || ws[k + 1]), ws[k + 2:]), ' ') AS joined FROM a)
SELECT target, 'missing_diacritics_only' AS kind, p AS input FROM j UNION ALL SELECT target, 'boundary_one_only', joined FROM j
UNION ALL SELECT target, 'missing_diacritics_boundary_one', {_PLAIN.format(t='joined')} FROM j UNION ALL SELECT target, 'missing_diacritics_boundary_all', replace(p, ' ', '') FROM j""",
    "acronym_candidates": rf"""WITH {_LINES}, s AS ({_runs(4)} UNION ALL {_runs(3)}),
r AS (SELECT *, lw[i:i + n - 1] AS run, list_transform(lw[greatest(i - 5, 1):i - 1], lambda x: {_PLAIN.format(t='x')}) AS before FROM s),
c AS (SELECT *, array_to_string(list_transform(run, lambda x: substr({_PLAIN.format(t='x')}, 1, 1)), '') AS short FROM r)
SELECT doc_id, line_no, array_to_string(list_concat(list_append(lw[1:i - 1], short), lw[i + n:]), ' ') AS input, short FROM c
WHERE len(list_filter(run, lambda x: regexp_full_match(x, '\p{{L}}+'))) = n AND len(list_filter(run, lambda x: NOT list_contains({_listed(GENERIC)}, {_PLAIN.format(t='x')}))) >= 2
AND list_has_any(before, {_listed(ANCHORS)}) AND NOT list_contains({_listed(RESERVED)}, short)""",
    "typed_marks": f"WITH {pc.SENTENCES} SELECT term, {_typed_sql(True)} AS telex, {_typed_sql(False)} AS vni FROM vocab WHERE {_PLAIN.format(t='term')} <> term",
    "leaks_replaced": f"""WITH {GOLD}, bad AS (SELECT count(*) AS n FROM gold WHERE query_id % 2 = 0 AND regexp_matches(expected, '^(a|b|c)')),
spare AS (SELECT query_id, expected, row_number() OVER (ORDER BY CAST('0x' || substr(sha256('leaks' || chr(31) || CAST(query_id AS VARCHAR)), 1, 15) AS BIGINT), query_id) AS k FROM gold WHERE query_id % 2 = 1 AND NOT regexp_matches(expected, '^(a|b|c)'))
SELECT query_id, expected FROM gold WHERE query_id % 2 = 0 AND NOT regexp_matches(expected, '^(a|b|c)') UNION ALL SELECT query_id, expected FROM spare, bad WHERE k <= n""",
}
