"""Queries over corpus statistics and mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import tokens as tk
from quillspark.operators import corpus, search
from quillspark.storage import dropped, materialized, table

ORDER = 3
#: Terms of the deletion index occur at least so often.
INDEXED = 2

TOKENS = r"[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_ \t\n\x0B\f\r]"
SENTENCES = rf"""
raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKENS}') AS ts FROM documents),
tok AS (SELECT doc_id, i, ts[i] AS surface FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM raw)),
sid AS (SELECT *, coalesce(sum(CASE WHEN surface IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence_id FROM tok),
lex AS (SELECT doc_id, sentence_id, i, lower(surface) AS term FROM sid WHERE regexp_matches(surface, '[\p{{L}}\p{{N}}]')),
vocab AS (SELECT term, count(*) AS count FROM lex GROUP BY term)"""
CONTEXTS = """
ctx AS (SELECT term, "left", "right", count(*) AS count FROM (
  SELECT term, coalesce(lag(term) OVER w, '<b>') AS "left", coalesce(lead(term) OVER w, '<b>') AS "right"
  FROM lex WINDOW w AS (PARTITION BY doc_id, sentence_id ORDER BY i)) GROUP BY ALL)"""
PAIRS = """
keys AS (SELECT DISTINCT term, count, k FROM (SELECT term, count, unnest(list_append(list_transform(range(1, length(term) + 1), lambda i: substr(term, 1, i - 1) || substr(term, i + 1)), term)) AS k FROM vocab)),
near AS (SELECT DISTINCT b.term AS intended, a.term AS observed, b.count AS intended_count, a.count AS observed_count
  FROM keys a JOIN keys b ON a.k = b.k AND a.term <> b.term AND b.count >= 10 AND b.count >= 10 * a.count),
pairs AS (SELECT * FROM near WHERE length(intended) <> length(observed)
  OR len(list_filter(range(1, length(intended) + 1), lambda g: substr(intended, 1, g - 1) || substr(intended, g + 1) = substr(observed, 1, g - 1) || substr(observed, g + 1))) > 0
  OR len(list_filter(range(1, length(intended)), lambda g: substr(intended, 1, g - 1) || substr(intended, g + 1, 1) || substr(intended, g, 1) || substr(intended, g + 2) = observed)) > 0)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.sentences(table(spark, sf_dir, "documents"))


def doc_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ts = tk.tokens(F.col("text"))
    return docs.select("doc_id", F.size(ts).cast("bigint").alias("n_tokens"), F.size(F.filter(ts, tk.lexical)).cast("bigint").alias("n_lexical"))


def sentence_counts(spark, sf_dir):
    return sentences(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.size("tokens")).cast("bigint").alias("longest"))


def token_positions(spark, sf_dir):
    rows = tk.positioned(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.max("sentence_id").cast("bigint").alias("last_sentence"), F.max("position").cast("bigint").alias("last_position"), F.sum("position").alias("position_sum"))


def vocabulary(spark, sf_dir):
    return corpus.vocabulary(sentences(spark, sf_dir))


def term_ids(spark, sf_dir):
    return corpus.term_ids(materialized(vocabulary(spark, sf_dir), "vocabulary"))


def corpus_metadata(spark, sf_dir):
    return corpus.metadata(sentences(spark, sf_dir), ORDER)


def ngrams_forward_2(spark, sf_dir):
    return corpus.ngrams(sentences(spark, sf_dir), 2, ORDER)


def ngrams_backward_3(spark, sf_dir):
    return corpus.ngrams(sentences(spark, sf_dir), 3, ORDER, backward=True)


def contexts(spark, sf_dir):
    return corpus.contexts(sentences(spark, sf_dir))


def context_totals(spark, sf_dir):
    return corpus.context_totals(contexts(spark, sf_dir))


def delete_index_d1(spark, sf_dir):
    return corpus.delete_index(vocabulary(spark, sf_dir).filter(F.col("count") >= INDEXED), 1)


def delete_index_d2_counts(spark, sf_dir):
    index = corpus.delete_index(vocabulary(spark, sf_dir).filter(F.col("count") >= INDEXED), 2)
    return index.groupBy("delete_key").agg(F.count("*").alias("n_terms"), F.sum("count").alias("n_tokens"))


def close_pairs(spark, sf_dir):
    return search.close_pairs(materialized(vocabulary(spark, sf_dir), "vocabulary"))


def mining_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary, close pairs, and the contexts that can give an error triple, each written once; the texts are split once."""
    rows = materialized(sentences(spark, sf_dir).select("tokens"), "sentences")
    vocab = materialized(corpus.vocabulary(rows), "vocabulary")
    pairs = materialized(search.close_pairs(vocab), "pairs")
    context = materialized(corpus.mined_contexts(rows, pairs, search.LEAST_CONTEXT), "contexts")
    dropped(rows)
    return vocab, pairs, context


def error_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs, context = mining_tables(spark, sf_dir)
    return search.error_triples(context, pairs)


def lexical_filter(spark, sf_dir):
    """Vocabulary by kind of term: too short, numeric, marks only, word-like."""
    from quillspark.functions import predicates as p

    vocab = vocabulary(spark, sf_dir)
    return vocab.select("term", "count", p.blacklisted(F.col("term")).alias("blacklisted"), p.word_like(F.col("term")).alias("word_like"))


QUERIES = [doc_token_counts, sentence_counts, token_positions, vocabulary, term_ids, corpus_metadata, ngrams_forward_2, ngrams_backward_3, contexts, context_totals, delete_index_d1, delete_index_d2_counts, close_pairs, error_triples, lexical_filter]


def _ngram_sql(n: int, backward: bool) -> str:
    order = "DESC" if backward else "ASC"
    return f"""WITH {SENTENCES},
s AS (SELECT list_concat(['<s>', '<s>'], list_append(list(term ORDER BY i {order}), '</s>')) AS p FROM lex GROUP BY doc_id, sentence_id)
SELECT ngram, count(*) AS count FROM (SELECT unnest(list_transform(range(1, len(p) - {n} + 2), lambda k: array_to_string(p[k:k + {n - 1}], ' '))) AS ngram FROM s) GROUP BY ngram"""


_D1 = "list_append(list_transform(range(1, length({t}) + 1), lambda i: substr({t}, 1, i - 1) || substr({t}, i + 1)), {t})"
SQL = {
    "doc_token_counts": f"WITH {SENTENCES} SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, CAST(len(list_filter(ts, lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))) AS BIGINT) AS n_lexical FROM raw",
    "sentence_counts": f"WITH {SENTENCES} SELECT doc_id, count(*) AS n_sentences, max(n) AS longest FROM (SELECT doc_id, sentence_id, count(*) AS n FROM lex GROUP BY ALL) GROUP BY doc_id",
    "token_positions": f"WITH {SENTENCES} SELECT doc_id, CAST(max(sentence_id) AS BIGINT) AS last_sentence, max(position) AS last_position, CAST(sum(position) AS BIGINT) AS position_sum FROM (SELECT doc_id, sentence_id, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY i) - 1 AS position FROM sid) GROUP BY doc_id",
    "vocabulary": f"WITH {SENTENCES} SELECT term, count FROM vocab",
    "term_ids": f"WITH {SENTENCES} SELECT row_number() OVER (ORDER BY count DESC, term) AS id, term, count AS frequency FROM vocab UNION ALL SELECT (SELECT count(*) FROM vocab) + k, t, 0 FROM (VALUES (1, '<s>'), (2, '</s>'), (3, '<unk>')) v(k, t)",
    "corpus_metadata": f"WITH {SENTENCES}, s AS (SELECT count(*) AS n FROM lex GROUP BY doc_id, sentence_id) SELECT count(*) AS sentence_count, CAST(sum(n) AS BIGINT) AS token_count, CAST(sum(n + 3) AS BIGINT) AS forward_unigrams, (SELECT count(*) FROM vocab) AS term_count, CAST(sum(n + 3) AS BIGINT) AS backward_unigrams FROM s",
    "ngrams_forward_2": _ngram_sql(2, False),
    "ngrams_backward_3": _ngram_sql(3, True),
    "contexts": f'WITH {SENTENCES}, {CONTEXTS} SELECT term, "left", "right", count FROM ctx',
    "context_totals": f'WITH {SENTENCES}, {CONTEXTS} SELECT "left", "right", CAST(sum(count) AS BIGINT) AS count FROM ctx GROUP BY ALL',
    "delete_index_d1": f"WITH {SENTENCES} SELECT DISTINCT unnest({_D1.format(t='term')}) AS delete_key, term, count FROM vocab WHERE count >= {INDEXED}",
    "delete_index_d2_counts": f"WITH {SENTENCES}, one AS (SELECT DISTINCT unnest({_D1.format(t='term')}) AS k, term, count FROM vocab WHERE count >= {INDEXED}), two AS (SELECT DISTINCT unnest({_D1.format(t='k')}) AS delete_key, term, count FROM one) SELECT delete_key, count(*) AS n_terms, CAST(sum(count) AS BIGINT) AS n_tokens FROM two GROUP BY delete_key",
    "close_pairs": f"WITH {SENTENCES}, {PAIRS} SELECT intended, observed, intended_count, observed_count FROM pairs",
    "error_triples": f"""WITH {SENTENCES}, {CONTEXTS}, {PAIRS},
usual AS (SELECT "left", "right" FROM ctx GROUP BY ALL HAVING sum(count) >= 10),
met AS (SELECT p.intended, o.term AS observed, o."left", o."right", o.count AS oc, c.count AS ic FROM ctx o JOIN usual USING ("left", "right") JOIN pairs p ON p.observed = o.term
  JOIN ctx c ON c.term = p.intended AND c."left" = o."left" AND c."right" = o."right"),
top AS (SELECT *, max(ic) OVER w AS m FROM met WINDOW w AS (PARTITION BY observed, "left", "right")),
won AS (SELECT *, count(*) FILTER (WHERE ic = m) OVER (PARTITION BY observed, "left", "right") AS ties FROM top)
SELECT intended, observed, CAST(sum(oc) AS BIGINT) AS count FROM won WHERE ic = m AND ties = 1 AND m > oc GROUP BY ALL""",
    "lexical_filter": f"""WITH {SENTENCES} SELECT term, count, length(term) <= 1 OR regexp_full_match(term, '\\p{{N}}+') OR regexp_full_match(term, '[\\p{{P}}\\p{{S}}]+') AS blacklisted,
length(term) BETWEEN 2 AND 64 AND NOT regexp_matches(term, '\\p{{Nd}}') AND length(regexp_replace(term, '[^\\p{{L}}]', '', 'g')) * 10 >= 8 * length(term) AS word_like FROM vocab""",
}
