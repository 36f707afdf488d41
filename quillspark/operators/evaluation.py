"""Scoring of predictions: strict join, score card, classifier metrics, calibration, latency, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.corpus import running


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def strict_join(gold: DataFrame, predictions: DataFrame, key: str = "query_id", same: tuple[str, ...] = ("input", "expected")) -> DataFrame:
    """Gold rows with their predictions; raises unless both have the same keys once and agree on ``same``."""
    for side, name in ((gold, "gold"), (predictions, "predictions")):
        bad = side.groupBy(key).count().filter(F.col("count") > 1)
        if not bad.isEmpty() or not side.filter(F.col(key).isNull()).isEmpty():
            raise ValueError(f"{name}: {key} is missing or not unique")
    other = predictions.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in predictions.columns if c != key])
    both = gold.join(other, gold[key] == other["__key"], "full_outer")
    checked = [c for c in same if c in gold.columns and c in predictions.columns]
    wrong = F.col(key).isNull() | F.col("__key").isNull()
    for c in checked:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    if not both.filter(wrong).isEmpty():
        raise ValueError("gold and predictions differ in their keys or fields")
    extra = [c for c in predictions.columns if c != key and c not in gold.columns]
    return both.select(*gold.columns, *[F.col(f"__{c}").alias(c) for c in extra])


def rank_of(hypotheses: Column, target: Column, k: int) -> Column:
    """Place of the target among the first k different hypotheses, or null."""
    at = F.array_position(F.slice(F.array_distinct(hypotheses), 1, k), target)
    return F.when(at > 0, at)


def flags(joined: DataFrame) -> DataFrame:
    """Per query: what it was, what was done to it, and the distances before and after."""
    source, target, output = (F.trim(F.regexp_replace(F.col(c), r"\s+", " ")) for c in ("input", "expected", "output"))
    rows = joined.withColumns({"input": source, "expected": target, "output": output})
    return rows.withColumns(
        {
            "noisy": F.col("input") != F.col("expected"),
            "changed": F.col("output") != F.col("input"),
            "exact": F.col("output") == F.col("expected"),
            "before": F.levenshtein("input", "expected"),
            "after": F.levenshtein("output", "expected"),
            "chars": F.greatest(F.length("expected"), F.lit(1)),
            "rank": rank_of(F.col("hypotheses"), F.col("expected"), 10),
        }
    )


def score_card(joined: DataFrame, by: str = "error_type") -> DataFrame:
    """The card over all queries (``by`` null) and for each error type, from one pass with grouping sets."""
    rows = flags(joined)
    n = lambda cond: F.count_if(cond)
    noisy, changed, exact = F.col("noisy"), F.col("changed"), F.col("exact")
    counts = {
        "queries": F.count("*"),
        "clean": n(~noisy),
        "tp": n(noisy & changed),
        "fp": n(~noisy & changed),
        "fn": n(noisy & ~changed),
        "tn": n(~noisy & ~changed),
        "corrected": n(noisy & changed & exact),
        "exact_n": n(exact),
        "exact_noisy_n": n(noisy & exact),
        "improved": n(F.col("after") < F.col("before")),
        "regressed": n(F.col("after") > F.col("before")),
        "before_sum": F.sum("before"),
        "after_sum": F.sum("after"),
        "chars_sum": F.sum("chars"),
        "cer_before_macro": F.avg(F.col("before") / F.col("chars")),
        "cer_after_macro": F.avg(F.col("after") / F.col("chars")),
        "mrr_10": F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))),
        **{f"hits_{k}": n(F.col("rank") <= k) for k in (1, 3, 5, 10)},
    }
    # all queries and each type: two grouping sets of one aggregation
    card = rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(*[c.alias(k) for k, c in counts.items()], F.grouping(by).alias("overall"))
    c = F.col
    return card.select(
        F.when(c("overall") == 1, F.lit("all")).otherwise(c(by)).alias(by),
        "queries", "tp", "fp", "fn", "tn", "improved", "regressed",
        ratio(c("tn"), c("clean")).alias("clean_preservation"),
        ratio(c("tp"), c("tp") + c("fp")).alias("detection_precision"),
        ratio(c("tp"), c("tp") + c("fn")).alias("detection_recall"),
        ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("detection_f1"),
        ratio(c("corrected"), c("tp") + c("fp")).alias("correction_precision"),
        ratio(c("corrected"), c("tp") + c("fn")).alias("correction_recall"),
        ratio(c("exact_noisy_n"), c("tp") + c("fn")).alias("exact_noisy"),
        ratio(c("exact_n"), c("queries")).alias("exact"),
        *[ratio(c(f"hits_{k}"), c("queries")).alias(f"recall_{k}") for k in (1, 3, 5, 10)],
        "mrr_10",
        ratio(c("before_sum"), c("chars_sum")).alias("cer_before"),
        ratio(c("after_sum"), c("chars_sum")).alias("cer_after"),
        "cer_before_macro", "cer_after_macro",
    )


def token_error_classes(rows: DataFrame) -> DataFrame:
    """E1 to E5 of token decisions (misspelled, action, correction, intended) and the rates made of them.

    E1 a misspelling kept, E2 flagged without a correction, E3 a wrong correction, E4 a right
    word flagged, E5 a right word changed.
    """
    bad, act = F.col("misspelled"), F.col("action")
    e = [
        F.count_if(bad & (act == "keep")),
        F.count_if(bad & (act == "flag")),
        F.count_if(bad & (act == "correct") & (F.col("correction") != F.col("intended"))),
        F.count_if(~bad & (act == "flag")),
        F.count_if(~bad & (act == "correct")),
    ]
    one = rows.agg(F.count("*").alias("tokens"), F.count_if(bad).alias("misspelled_tokens"), *[x.alias(f"e{k + 1}") for k, x in enumerate(e)])
    c = F.col
    return one.withColumns({"cer": ratio(c("e1") + c("e2") + c("e3") + c("e4"), c("tokens")), "fer": ratio(c("e3") + c("e5"), c("tokens")), "ter": ratio(c("e1") + c("e2") + c("e3") + c("e4") + c("e5"), c("tokens"))})


def best_f1_threshold(scored: DataFrame) -> DataFrame:
    """The threshold (a score, ties to the higher) with the best F1 of ``label`` by score >= threshold.

    Scores are counted first; the running sums go over ranges of distinct scores.
    """
    per = scored.groupBy("score").agg(F.count_if("label").alias("pos"), F.count("*").alias("n"))
    summed = running(per, [F.col("score").desc()], {"tp": "pos", "found": "n"})
    rows = summed.join(F.broadcast(summed.agg(F.sum("pos").alias("positives"))))
    rows = rows.withColumn("f1", ratio(2 * F.col("tp"), F.col("found") + F.col("positives")))
    return rows.orderBy(F.col("f1").desc(), F.col("score").desc()).limit(1).select(F.col("score").alias("threshold"), "f1", "tp", "found", "positives")


def calibration_bins(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Ten bins of probability, the last closed: size, mean probability and share of positives."""
    bin_ = F.least(F.floor(F.col("probability") * 10), F.lit(9)).cast("int")
    y = F.col("label").cast("double")
    return scored.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg(y).alias("positive_share"))


def probability_metrics(scored: DataFrame) -> DataFrame:
    """Brier score, log-loss, expected calibration error over ten bins, and the share of probabilities from 0.8."""
    y, p = F.col("label").cast("double"), F.least(F.greatest(F.col("probability"), F.lit(1e-12)), F.lit(1 - 1e-12))
    one = scored.agg(F.count("*").alias("n"), F.avg((F.col("probability") - y) * (F.col("probability") - y)).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg((F.col("probability") >= 0.8).cast("double")).alias("share_from_08"))
    gap = calibration_bins(scored).agg((F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("positive_share"))) / F.sum("n")).alias("ece_10"))
    return one.join(gap)


def latency_summary(times: DataFrame, column: str, by: str) -> DataFrame:
    """Interpolated percentiles, mean, population deviation and queries a second of milliseconds."""
    x = F.col(column)
    return times.groupBy(by).agg(
        F.count("*").alias("n"),
        *[F.percentile(x, q / 100).alias(f"p{q}") for q in (50, 95, 99)],
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("deviation"),
        ratio(F.count("*") * 1000, F.sum(x)).alias("per_second"),
    )


def nearest_rank(rows: DataFrame, column: str, by: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantiles at the nearest rank, halves to even: the value at round((n - 1) q).

    Equal values are counted first and the counts summed over ranges of all groups and values,
    so a large group is divided among tasks.  Null values come first; a null group is a group.
    """
    counts = rows.groupBy(by, column).agg(F.count("*").alias("__c"))
    summed = running(counts, [F.col(by).asc(), F.col(column).asc()], {"__upto": "__c"})
    whole = summed.groupBy(F.col(by).alias("__by")).agg(F.min(F.col("__upto") - F.col("__c")).alias("__start"), F.sum("__c").alias("__n"))
    placed = summed.join(whole, F.col(by).eqNullSafe(F.col("__by")))
    first, behind = F.col("__upto") - F.col("__c") - F.col("__start"), F.col("__upto") - F.col("__start")

    def at(q: float) -> Column:
        wanted = F.bround((F.col("__n") - 1) * q)
        return F.max(F.when((first <= wanted) & (wanted < behind), F.col(column)))

    return placed.groupBy(by).agg(*[at(q).alias(f"q{round(q * 100)}") for q in shares])


def retention_card(rows: DataFrame, names: tuple[str, ...], unknown: tuple[str, ...] = ("<unk>", " \u2047 ")) -> DataFrame:
    """One row: percentages of exact outputs, mean character errors, outputs with an unknown token, and held-out names kept.

    Of the ``names`` (a short, fixed list) the first that a target contains counts; 100 where no target has one.
    """
    target, out = F.col("expected"), F.col("output")
    held = F.get(F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(target, n)), F.lit(0))
    part = lambda hit, n: 100 * ratio(F.count_if(hit), n)
    lost = F.lit(False)
    for mark in unknown:
        lost = lost | F.contains(out, F.lit(mark))
    named = F.count(held)
    return rows.agg(
        F.count("*").alias("total"),
        part(out == target, F.count("*")).alias("exact_match"),
        (100 * F.coalesce(F.avg(F.levenshtein(target, out) / F.greatest(F.length(target), F.lit(1))), F.lit(0.0))).alias("cer"),
        part(lost, F.count("*")).alias("unk_rate"),
        F.when(named == 0, 100.0).otherwise(part(F.contains(out, held), named)).alias("brand_retention"),
    )


def gate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """metric, value, limit, at_least, passed, and whether all of them passed; a metric that is missing fails."""
    joined = limits.join(metrics, "metric", "left")
    ok = F.coalesce(F.when(F.col("at_least"), F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit")), F.lit(False))
    return joined.withColumn("passed", ok).withColumn("all_passed", F.bool_and("passed").over(Window.partitionBy()))


def two_by_two(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """How many items both, one or none of two systems got right (``ok``)."""
    other = second.select(F.col(key).alias("__k"), F.col("ok").alias("second_ok"))
    return first.join(other, first[key] == other["__k"]).groupBy(F.col("ok").alias("first_ok"), "second_ok").agg(F.count("*").alias("n"))


def parity(first: DataFrame, second: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Per item: equal outputs, equal first k hypotheses in order, and as sets."""
    other = second.select(F.col(key).alias("__k"), F.col("output").alias("__o"), F.col("hypotheses").alias("__h"))
    a, b = F.slice("hypotheses", 1, k), F.slice("__h", 1, k)
    rows = first.join(other, first[key] == other["__k"])
    return rows.select(key, (F.col("output") == F.col("__o")).alias("same_output"), (a == b).alias("same_order"), (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))).alias("same_set"))


def error_taxonomy(rows: DataFrame) -> DataFrame:
    """Kind of each wrong output: nothing done, a right query broken, only marks wrong, too long, too short, or other words."""
    fold = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", "")
    n = lambda c: F.size(F.split(c, " "))
    kind = (
        F.when(F.col("output") == F.col("expected"), "right")
        .when(F.col("input") == F.col("expected"), "copy_broken")
        .when(F.col("output") == F.col("input"), "no_op")
        .when(fold(F.col("output")) == fold(F.col("expected")), "marks_only")
        .when(n(F.col("output")) > n(F.col("expected")), "over_expansion")
        .when(n(F.col("output")) < n(F.col("expected")), "under_expansion")
        .otherwise("token_substitution")
    )
    return rows.withColumn("kind", kind)
