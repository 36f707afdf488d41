"""Alignment of noisy and right queries, word by word."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspark.functions.distance import osa

SCHEMA = "array<struct<observed:string,intended:string>>"


def price(a: str, b: str) -> float:
    """Of setting two words side by side: their share of edits if these are at most two, else as much as leaving both out."""
    d = osa(a, b, 2)
    return min(1.0, d / max(len(a), len(b), 1)) if d <= 2 else 2.0


def align(observed: list[str], intended: list[str]) -> list[tuple[str | None, str | None]]:
    """Pairs of words; of equally many words the first meets the first and so on."""
    if len(observed) == len(intended):
        return list(zip(observed, intended, strict=True))
    n, m = len(observed), len(intended)
    cost = [[float(i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + price(observed[i - 1], intended[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + price(observed[i - 1], intended[j - 1]):
            i, j = i - 1, j - 1
            out.append((observed[i], intended[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((observed[i], None))
        else:
            j -= 1
            out.append((None, intended[j]))
    return out[::-1]


def aligned(pairs: DataFrame, observed: str, intended: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with position, observed and intended word, and up to two words before and after on the observed side."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"observed": x, "intended": y} for x, y in align(p.split(), q.split())] for p, q in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=object)

    words = pandas_udf(run, SCHEMA)
    rows = pairs.select(*keep, words(observed, intended).alias("ws"), F.filter(F.split(observed, r"\s+"), lambda w: w != "").alias("os"))
    rows = rows.select(*keep, "os", F.posexplode("ws").alias("position", "w")).select(*keep, "os", "position", "w.observed", "w.intended")
    left = F.when(F.col("position") > 0, F.slice("os", F.greatest(F.col("position") - 1, F.lit(1)), F.least(F.col("position"), F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"left": left, "right": F.slice("os", F.col("position") + 2, 2)}).drop("os")


def triples(words: DataFrame) -> DataFrame:
    """intended, observed, count of the aligned words that differ."""
    wrong = words.filter("observed is not null and intended is not null and observed <> intended")
    return wrong.groupBy("intended", "observed").agg(F.count("*").alias("count"))


def diagnostics(words: DataFrame, key: str) -> DataFrame:
    """Counts over an alignment: pairs, words, equal, changed, left out on either side, pairs of unlike length."""
    gap = F.col("observed").isNull() | F.col("intended").isNull()
    per = words.groupBy(key).agg(F.max(gap.cast("int")).alias("gap"), F.count("*").alias("n"), F.count_if(F.col("observed") == F.col("intended")).alias("same"), F.count_if(F.col("observed").isNull()).alias("missing"), F.count_if(F.col("intended").isNull()).alias("extra"))
    return per.agg(F.count("*").alias("pairs"), F.sum("n").alias("words"), F.sum("same").alias("same"), F.sum(F.col("n") - F.col("same") - F.col("missing") - F.col("extra")).alias("changed"), F.sum("missing").alias("missing"), F.sum("extra").alias("extra"), F.sum("gap").cast("bigint").alias("unlike_pairs"))
