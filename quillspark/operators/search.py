"""Candidate search by a deletion index, and mining of likely errors from frequencies and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import predicates
from quillspark.functions.distance import limit_for, osa_distance, within_one
from quillspark.operators.corpus import MOST_HASHES, context_totals, delete_index
from quillspark.storage import materialized


#: Tokens around which a context stands before it can give an error triple.
LEAST_CONTEXT = 10
#: Asked terms whose deletion keys may be sent to all executors; their index is shuffled beyond.
FEW_TERMS = 20_000


def verified(pairs: DataFrame, distance: int) -> DataFrame:
    """Pairs of observed and term within the distance: one edit by built-in functions, more by a band of the built-in Levenshtein distance and then exactly."""
    if distance == 1:
        return pairs.filter(within_one(F.col("observed"), F.col("term")))
    limit = F.least(limit_for(F.length("observed")), F.lit(distance))
    band = pairs.filter(F.levenshtein(F.col("observed"), F.col("term"), 2 * distance) >= 0)
    return band.withColumn("distance", osa_distance("observed", "term")).filter(F.col("distance") <= limit)


def close_terms(observed: DataFrame, vocab: DataFrame, distance: int = 1) -> DataFrame:
    """observed, term, count: vocabulary terms within the distance of each observed term, itself included.

    Both sides meet under equal deletion keys, an equi-join in place of the product of the
    two; a pair that shares several keys is verified once.  The keys are many times their
    terms, which Spark's estimate of their size leaves out: only keys of terms counted
    before are broadcast.
    """
    index = delete_index(vocab, distance)
    asked = delete_index(observed.select(F.col("term"), F.lit(0).alias("count")), distance).select("delete_key", F.col("term").alias("observed"))
    few = observed.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    pairs = asked.hint("broadcast" if few else "merge").join(index, "delete_key").select("observed", "term", "count").distinct()
    return verified(pairs, distance)


def close_pairs(vocab: DataFrame, ratio: float = 10.0, distance: int = 1) -> DataFrame:
    """intended, observed and their counts: close terms of which one is ``ratio`` times as frequent.

    Only terms of at least ``ratio`` occurrences can be intended, which keeps the index to the
    frequent ones; keys that none of these has are left out by hashes, where they are few.  Counts are
    compared where the keys meet, in a shuffle join whatever the estimated size.
    """
    index = delete_index(vocab.filter(F.col("count") >= ratio), distance)
    asked = delete_index(vocab, distance).select(F.col("delete_key").alias("o_key"), F.col("term").alias("observed"), F.col("count").alias("observed_count"))
    hashes = materialized(index.select(F.xxhash64("delete_key").alias("__h")).distinct(), "hashes")
    if hashes.count() <= MOST_HASHES:
        asked = asked.withColumn("__h", F.xxhash64("o_key")).join(F.broadcast(hashes), "__h", "left_semi")
    met = (F.col("delete_key") == F.col("o_key")) & (F.col("observed") != F.col("term")) & (F.col("count") >= ratio * F.col("observed_count"))
    pairs = asked.join(index.hint("merge"), met).select("observed", "term", "count", "observed_count").distinct()
    return verified(pairs, distance).select(F.col("term").alias("intended"), "observed", F.col("count").alias("intended_count"), "observed_count")


def error_triples(context: DataFrame, pairs: DataFrame, least_context: int = LEAST_CONTEXT) -> DataFrame:
    """intended, observed, count: how often a term stands where one of its close, frequent terms is the only most frequent.

    A context in which the observed term, or two candidates, share the largest count gives nothing.
    ``context`` may be that of ``corpus.mined_contexts``.  Rare contexts go
    first, before either term is looked up.  The joins are shuffled whatever the estimated
    size, as pairs and contexts grow with the corpus.
    """
    usual = context_totals(context).filter(F.col("count") >= least_context).select("left", "right")
    kept = materialized(context.join(usual.hint("merge"), ["left", "right"]), "usual_contexts")
    pair = pairs.select("intended", "observed")
    own = kept.select(F.col("term").alias("observed"), "left", "right", F.col("count").alias("observed_count"))
    theirs = kept.select(F.col("term").alias("intended"), "left", "right", F.col("count").alias("intended_count"))
    met = own.join(pair.hint("merge"), "observed").join(theirs.hint("merge"), ["intended", "left", "right"])
    place = Window.partitionBy("observed", "left", "right")
    top = F.max("intended_count").over(place)
    ranked = met.withColumn("top", top).withColumn("ties", F.count_if(F.col("intended_count") == F.col("top")).over(place))
    winners = ranked.filter((F.col("intended_count") == F.col("top")) & (F.col("ties") == 1) & (F.col("top") > F.col("observed_count")))
    return winners.groupBy("intended", "observed").agg(F.sum("observed_count").alias("count"))


def minable_pairs(pairs: DataFrame) -> DataFrame:
    """Close pairs with ``excluded``: a term of the pair is blacklisted or not like a word."""
    ok = predicates.minable(F.col("observed")) & predicates.minable(F.col("intended"))
    return pairs.withColumn("excluded", ~ok)


def mining_counters(judged: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: pairs looked at and excluded, triples and their occurrences."""
    pairs = judged.agg(F.count_if(~F.col("excluded")).alias("close_pairs_scanned"), F.count_if("excluded").alias("blacklisted_pairs_excluded"))
    found = triples.agg(F.count("*").alias("triples_emitted"), F.coalesce(F.sum("count"), F.lit(0)).alias("triple_occurrences"))
    return pairs.join(found)
