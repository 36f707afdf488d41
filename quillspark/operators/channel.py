"""The learnt error channel: how often a part of a word is written as another."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SMOOTHING, PRIOR = 0.1, 10
#: Rows of the learnt table that may be sent to the workers.
MOST_PARTS = 500_000


#: Steps through two words: so many characters of the intended and of the observed one make a part.
STEPS = [(a, b) for a in range(3) for b in range(3) if a or b]


def first_guess(source: str, target: str) -> float:
    """Before anything is learnt: equal parts cost nothing, a swap 1, others their longer length."""
    swap = len(source) == 2 and target == source[1] + source[0]
    return 0.0 if source == target else -1.0 if swap else -float(max(len(source), len(target)))


def best_parts(intended: str, observed: str, score: Callable[[str, str], float]) -> tuple[float, list[tuple[str, str]]]:
    """The cut of both words into parts of the highest score; among equals that of fewer parts, then of the first parts in order.

    ``rest[i, j]`` is the best first step of what remains behind place i and j, as (cost,
    parts, part): the order of whole cuts is that of their first parts, as their rests are
    the best of their kind already.  The words are read from their ends, then the steps followed.
    """
    ends = (len(intended), len(observed))
    rest: dict[tuple[int, int], tuple[float, int, tuple[str, str]]] = {ends: (0.0, 0, ("", ""))}
    for at in sorted(product(range(ends[0] + 1), range(ends[1] + 1)), reverse=True)[1:]:
        options = []
        for a, b in STEPS:
            if (behind := rest.get((at[0] + a, at[1] + b))) is not None:
                part = (intended[at[0] :][:a], observed[at[1] :][:b])
                options.append((behind[0] - score(*part), behind[1] + 1, part))
        rest[at] = min(options)
    total, parts, at = rest[0, 0][0], [], (0, 0)
    while at != ends:
        source, target = rest[at][2]
        parts.append((source, target))
        at = (at[0] + len(source), at[1] + len(target))
    return 0.0 - total, parts


def aligned_parts(triples: DataFrame, score: Callable[[str, str], float]) -> DataFrame:
    """source, target and n: the parts of the best cut of every triple, each as often as the triple."""

    def cut(intended: pd.Series, observed: pd.Series) -> pd.Series:
        return pd.Series([[{"source": s, "target": t} for s, t in best_parts(a, b, score)[1]] for a, b in zip(intended, observed, strict=True)], dtype=object)

    parts = pandas_udf(cut, "array<struct<source:string,target:string>>")
    return triples.filter("count > 0").select(F.explode(parts("intended", "observed")).alias("p"), F.col("count").cast("double").alias("n")).select("p.*", "n")


def part_counts(triples: DataFrame) -> DataFrame:
    """source, target and count over all triples (intended, observed, count), with a prior for parts that stay as they are."""
    aligned = aligned_parts(triples, first_guess)
    word = F.col("intended")

    def same(size: int) -> DataFrame:
        at = F.when(F.length(word) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - size + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(size))))
        return triples.filter("count > 0").select(F.explode(at).alias("source")).select("source", F.col("source").alias("target"), F.lit(float(PRIOR)).alias("n"))

    return aligned.union(same(1)).union(same(2)).groupBy("source", "target").agg(F.sum("n").alias("count"))


class Channel:
    """Log probability of an observed word given the intended one."""

    def __init__(self, counts: dict[tuple[str, str], float], smoothing: float = SMOOTHING):
        self.counts, self.smoothing = counts, smoothing
        self.totals: dict[str, float] = defaultdict(float)
        for (source, _), n in counts.items():
            self.totals[source] += n
        self.support = max(1, len({t for _, t in counts} | {""}) + 1)
        self.seen: dict[tuple[str, str], float] = {}

    def part(self, source: str, target: str) -> float:
        return math.log((self.counts.get((source, target), 0.0) + self.smoothing) / (self.totals.get(source, 0.0) + self.smoothing * self.support))

    def word(self, intended: str, observed: str) -> float:
        """The score of the best cut, remembered per pair of words."""
        pair = (intended, observed)
        if pair not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[pair] = self.highest(intended, observed)
        return self.seen[pair]

    def highest(self, intended: str, observed: str) -> float:
        """Only scores are kept, a row per character of the intended word: each is the best over the steps that end there."""
        heads: list[list[float]] = []
        for i in range(len(intended) + 1):
            sources = [intended[max(0, i - a) : i] for a in range(3)]
            heads.append([])
            for j in range(len(observed) + 1):
                reached = [heads[i - a][j - b] + self.part(sources[a], observed[j - b : j]) for a, b in STEPS if a <= i and b <= j]
                heads[i].append(max(reached, default=0.0))
        return heads[-1][-1]


def collected(counts: DataFrame) -> Channel:
    rows = counts.limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} pairs of parts: use fewer characters")
    return Channel({(r.source, r.target): r["count"] for r in rows})


def fitted(triples: DataFrame, rounds: int = 1) -> Channel:
    """The channel learnt from triples; its table is of pairs of parts of up to two characters and checked in size.

    Every further round cuts the triples anew by what is learnt and replaces the counts,
    the prior included.
    """
    learnt = collected(part_counts(triples))
    for _ in range(rounds - 1):
        learnt = collected(aligned_parts(triples, learnt.part).groupBy("source", "target").agg(F.sum("n").alias("count")))
    return learnt


def channel_score(channel: Channel, intended: Column, observed: Column) -> Column:
    """The channel over Arrow batches; ask it for distinct pairs."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([channel.word(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return pandas_udf(run, "double")(intended, observed)
