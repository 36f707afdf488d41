"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import drop_written, written


#: A round's table has a file for so many edges of the round before.
EDGES_PER_FILE = 250_000


def components(edges: DataFrame, label: str = "components", most_rounds: int = 200) -> DataFrame:
    """``node`` and ``root`` (the smallest node that it reaches) for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps: a large star ties each larger neighbour of
    a node to the smallest node in sight, a small star does so for the smaller ones, until
    no edge changes; a component is then a star around its smallest node.  Each step is a
    grouped minimum, combined on the map side, and a join, so a node with very many
    neighbours never meets them in one task's memory, and each step's edges are written to
    the shared folder, so that a lost executor costs no more than one step.
    """
    state = written(_oriented(edges.select("a", "b")), f"{label}-0")
    mark = _mark(state)
    for k in range(most_rounds):
        # no more files than the edges fill: a round of few edges should not write hundreds
        new = written(_small_star(_large_star(state)).coalesce(mark[0] // EDGES_PER_FILE + 1), f"{label}-{k + 1}")
        new_mark = _mark(new)
        drop_written(state)
        state = new
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges with the larger node first, loops dropped."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)
