"""Language-model scores and the ranking of candidates by a noisy channel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.search import close_terms
from quillspark.storage import materialized

BACKOFF = 0.4
UNSEEN = 1e-9


def counts_of(sentences: DataFrame, order: int, backward: bool = False) -> DataFrame:
    """ngram and count of all orders up to ``order``, as words with spaces between."""
    from quillspark.operators.corpus import ngrams

    out = ngrams(sentences, 1, order, backward)
    for n in range(2, order + 1):
        out = out.union(ngrams(sentences, n, order, backward))
    return out


def asked_grams(order: int) -> dict[str, Column]:
    """Of a row with history and token: ``g{n}``, its n-gram, and ``h{n}``, the history of that; null where the history is shorter."""
    out = {}
    for n in range(1, order + 1):
        history = F.when(F.size("history") >= n - 1, F.slice("history", F.size("history") - n + 2, n - 1) if n > 1 else F.array().cast("array<string>"))
        out[f"g{n}"] = F.when(history.isNotNull(), F.array_join(F.concat(history, F.array("token")), " "))
        out[f"h{n}"] = F.when(history.isNotNull(), F.array_join(history, " ")) if n > 1 else F.lit(None).cast("string")
    return out


#: N-grams that may be sent to all executors.
MOST_GRAMS = 500_000


def wanted_counts(sentences: DataFrame, wanted: DataFrame, order: int) -> tuple[DataFrame, int]:
    """``ngram`` and count of the n-grams of ``wanted`` up to ``order``, in the order of the text and without padding,
    and the number of unigrams, which counts the padding of models of ``order``.

    One pass over the sentences; n-grams that nobody asks for are left out before they are counted.
    """
    wanted = materialized(wanted.filter(F.col("ngram").isNotNull()).union(sentences.sparkSession.range(1).select(F.lit(""))).distinct(), "wanted")
    size = F.size("tokens")
    ahead = [F.slice("tokens", F.lit(n + 1), size).alias(f"w{n}") for n in range(order)]
    # the last array has one element: it is null in all rows of a sentence but the first
    rows = sentences.filter(size > 0).select(F.inline(F.arrays_zip(*ahead, F.array((size + order).cast("bigint")).alias("padded"))))
    grams, gram = [], F.col("w0")
    for n in range(order):
        gram = gram if n == 0 else F.concat(gram, F.lit(" "), F.col(f"w{n}"))
        grams.append(F.struct(gram.alias("ngram"), F.lit(1).cast("bigint").alias("n")))
    whole = F.struct(F.when(F.col("padded").isNotNull(), "").alias("ngram"), F.coalesce("padded", F.lit(0).cast("bigint")).alias("n"))
    few = wanted.count() <= MOST_GRAMS
    rows = rows.select(F.inline(F.array(*grams, whole))).join(wanted.hint("broadcast" if few else "merge"), "ngram", "left_semi")
    counts = materialized(rows.groupBy("ngram").agg(F.sum("n").alias("count")), "ngrams")
    total = counts.filter("ngram = ''").first()
    return counts.filter("ngram <> ''"), total["count"] if total else 0


def turned(grams: DataFrame) -> DataFrame:
    """N-grams with their words from last to first."""
    return grams.withColumn("ngram", F.array_join(F.reverse(F.split("ngram", " ")), " "))


def backoff_scores(asked: DataFrame, counts: DataFrame, total: int, order: int) -> DataFrame:
    """``asked`` (key columns, history array, token) with ``score``, the log of Stupid Backoff.

    The longest history whose n-gram was seen decides; each word less costs the factor
    BACKOFF.  Every order is one left join of the distinct keys, so the cost follows the
    different n-grams asked, not the places they are asked from.
    """
    keyed = asked.withColumns({f"__{name}": gram for name, gram in asked_grams(order).items()})
    out = keyed
    for n in range(1, order + 1):
        for part in ("g", "h") if n > 1 else ("g",):
            looked = counts.select(F.col("ngram").alias(f"__k{part}{n}"), F.col("count").alias(f"__c{part}{n}"))
            out = out.join(looked, F.col(f"__{part}{n}") == F.col(f"__k{part}{n}"), "left").drop(f"__k{part}{n}")
    score = F.lit(math.log(UNSEEN))
    longest = F.least(F.size("history"), F.lit(order - 1))
    for n in range(1, order + 1):
        base = F.col(f"__ch{n}") if n > 1 else F.lit(total)
        penalty = (longest - (n - 1)) * math.log(BACKOFF)
        score = F.when(F.col(f"__cg{n}") > 0, F.ln(F.col(f"__cg{n}") / base) + penalty).otherwise(score)
    return out.select(*asked.columns, score.alias("score"))


def candidates(observed: DataFrame, vocab: DataFrame, distance: int = 1) -> DataFrame:
    """observed, term, frequency, distance; the observed term is always among its own candidates, with frequency 1 at least."""
    found = close_terms(observed, vocab, distance).select("observed", "term", F.col("count").alias("frequency"))
    found = found.withColumn("distance", F.when(F.col("observed") == F.col("term"), 0).otherwise(F.lit(1)) if distance == 1 else F.levenshtein("observed", "term"))
    missing = observed.select(F.col("term").alias("observed")).distinct().join(found.filter("observed = term").select("observed"), "observed", "left_anti")
    own = missing.select("observed", F.col("observed").alias("term"), F.lit(1).cast("bigint").alias("frequency"), F.lit(0).alias("distance"))
    return found.unionByName(own)


def preselected(found: DataFrame, error_score: Column, k: int = 20) -> DataFrame:
    """The k best of each observed term by error score and frequency; ties by distance, frequency, term.  The observed term stays in any case."""
    scored = found.withColumn("error_score", error_score).withColumn("pre_score", F.col("error_score") + F.ln("frequency"))
    order = Window.partitionBy("observed").orderBy(F.col("pre_score").desc(), "distance", F.col("frequency").desc(), "term")
    return scored.withColumn("place", F.row_number().over(order)).filter((F.col("place") <= k) | (F.col("observed") == F.col("term")))


def ranked(scored: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """Rank by error score and weighted language-model score; ties by distance, frequency, term."""
    combined = scored.withColumn("combined", F.col("error_score") + weight * F.col("lm_score"))
    order = Window.partitionBy(*by).orderBy(F.col("combined").desc(), "distance", F.col("frequency").desc(), "term")
    return combined.withColumn("rank", F.row_number().over(order))


GRID = tuple(k * 0.25 for k in range(41))


def tune_weights(scored: DataFrame, key: str, bucket: list[str], grid: tuple[float, ...] = GRID) -> DataFrame:
    """The weight of the best mean reciprocal rank of the intended term in each bucket, ties to the smaller.

    The grid is a constant array: a row becomes one row per weight, and the rank of the
    intended term is one more than the number of candidates before it.
    """
    each = scored.filter(F.col("intended").isNotNull()).withColumn("weight", F.explode(F.array(*map(F.lit, grid))))
    sorting = F.struct(-(F.col("error_score") + F.col("weight") * F.col("lm_score")), F.col("distance"), -F.col("frequency"), F.col("term"))
    place = each.withColumn("k", sorting)
    own = F.max(F.when(F.col("term") == F.col("intended"), F.col("k"))).over(Window.partitionBy(key, "weight"))
    met = place.withColumn("own", own).filter(F.col("own").isNotNull())
    ranks = met.groupBy(key, *bucket, "weight").agg((1 / (1 + F.count_if(F.col("k") < F.col("own")))).alias("reciprocal"))
    mean = ranks.groupBy(*bucket, "weight").agg(F.avg("reciprocal").alias("mrr"), F.count("*").alias("n"))
    return mean.groupBy(*bucket).agg(F.max_by("weight", F.struct(F.round("mrr", 12), -F.col("weight"))).alias("weight"), F.max("mrr").alias("mrr"), F.max("n").alias("n"))


def features(rankings: DataFrame, by: list[str]) -> DataFrame:
    """Per observed term in its context: scores of the term itself, of the best and second suggestion, and their gaps."""
    own = F.col("observed") == F.col("term")
    suggestion = rankings.withColumn("s_rank", F.when(~own, F.row_number().over(Window.partitionBy(*by, own).orderBy("rank"))))
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    first, second = F.col("s_rank") == 1, F.col("s_rank") == 2
    cols = {f"{name}_{c}": pick(cond, c) for name, cond in (("own", own), ("first", first), ("second", second)) for c in ("error_score", "lm_score", "combined", "frequency", "distance")}
    rows = suggestion.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()], pick(first, "term").alias("suggestion"), F.count_if(~own).alias("n_suggestions"))
    return rows.withColumns({"gap_own": F.col("first_combined") - F.col("own_combined"), "gap_second": F.col("first_combined") - F.col("second_combined")})


#: What a decision looks at: the term itself, the first and second suggestion against it, its letters' case, and the sizes of what is around it.
FEATURES = (
    "own_error_score", "own_lm_score", "has_first", "first_error_delta", "first_lm_delta", "has_second", "second_error_delta", "second_lm_delta",
    "all_lower", "all_upper", "title", "first_upper", "mixed", "case_match", "n_suggestions", "observed_length", "left_length", "right_length",
)


def confidence_features(rows: DataFrame) -> DataFrame:
    """Rows of ``features`` with observed, left_length and right_length, and all of FEATURES as doubles; a suggestion that is not there gives zeros."""
    from quillspark.functions.editing import case_signature

    rows = rows.withColumns({"__case": case_signature("observed"), "__first_case": case_signature("suggestion")})
    new = {}
    for k in ("first", "second"):
        new[f"has_{k}"] = F.col(f"{k}_error_score").isNotNull()
        for score in ("error", "lm"):
            new[f"{k}_{score}_delta"] = F.coalesce(F.col(f"{k}_{score}_score") - F.col(f"own_{score}_score"), F.lit(0.0))
    new |= {name: F.get("__case", F.lit(i)) for i, name in enumerate(("all_lower", "all_upper", "title", "first_upper", "mixed"))}
    new |= {"case_match": F.coalesce(F.col("__case") == F.col("__first_case"), F.lit(False)), "observed_length": F.length("observed")}
    rows = rows.withColumns(new)
    return rows.withColumns({c: F.col(c).cast("double") for c in FEATURES}).drop("__case", "__first_case")


def decide(rows: DataFrame, spell: float | Column, correct: float | Column) -> DataFrame:
    """keep, flag or correct: by the blacklist, the probability of an error, whether there is a suggestion, and its probability."""
    action = (
        F.when(F.col("blacklisted"), "keep")
        .when(F.col("spell_probability") < spell, "keep")
        .when(F.col("suggestion").isNull(), "flag")
        .when(F.col("correct_probability") >= correct, "correct")
        .otherwise("flag")
    )
    return rows.withColumn("action", action).withColumn("correction", F.when(F.col("action") == "correct", F.col("suggestion")))
