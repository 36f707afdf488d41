"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the number of copies that the mix takes on average: of all
rates that meet the token constraints (every source's rates times sizes sum to its
target), those closest to a uniform pass in entropy, weighted by size.  They are the exponential of
one multiplier per constraint, and the multipliers minimise the convex dual

    D(m) = sum over documents of size exp(m_source) - sum over sources of m_source target

by Newton steps.  The documents enter through their sizes summed by source, combined on
the map side; every step is a pass over that table, in which each source has a row.

Rates are then rounded to copies: each document takes the whole part, and as many
documents of the source as fill what is missing take one more, in the order of a hash of
the document.  Where they end is found by sums over 4096 ranges of the hash; only the
documents of the one range in which a source's target falls are ordered.  So no task sees a
source whole, a source meets its target to within one document, copies are a function of
the document and its source's cut, and reruns agree.

Targets share the total of all sizes by weight; a target stops at ``MOST`` times its
source's size and the excess is shared by weight until none is above.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source
like any other, last in order; a source of no words has target 0; repeated rows are
separate documents that are rounded alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._shared import WORD, small, written

MOST = 3
WEIGHTS = (1, 2, 3)
#: A document's place is a number of so many bits, its range the upper ones of these.
PLACE_BITS, RANGE_BITS = 48, 12
TOLERANCE = 1e-12


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size), one row each, with ``weight`` and ``target``.

    Full sources are those of the smallest size per weight: with the first k of that order
    full, the rest share what remains by weight; k is the first for which the next source
    is not full at its share.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight.cast("bigint"))
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = ranked.withColumn("level", left / F.sum("weight").over(after))
    # the level of the first source that is not full
    fits = F.col("level") * F.col("weight") <= most * F.col("source_size")
    common = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("source_size") / F.col("weight"))).over(every)
    full = most * F.col("source_size").cast("double")
    return level.select("source", "source_size", "weight", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(full, F.col("weight") * common)).alias("target"))


def balance(constraints: DataFrame, most_steps: int = 60) -> DataFrame:
    """``constraints`` (source, source_size, target) with ``multiplier`` and ``rate`` = exp(multiplier).

    Newton on the dual from multiplier 0; gradient and Hessian of a source's multiplier are
    size exp(m) - target and size exp(m).  A step upwards is damped to 1, which the dual's
    curvature asks for; the loop ends when every constraint is met.
    """
    state = constraints.withColumn("multiplier", F.lit(0.0))
    mass = F.col("source_size") * F.exp("multiplier")
    open_ = (F.col("source_size") > 0) & (F.col("target") > 0)
    for _ in range(most_steps):
        gap = state.agg(F.max(F.when(open_, F.abs(mass - F.col("target")) / F.col("target")))).first()[0]
        if gap is None or gap < TOLERANCE:
            break
        step = (F.col("target") - mass) / mass
        state = written(state.coalesce(1).withColumn("multiplier", F.when(open_, F.col("multiplier") + F.least(step, F.lit(1.0)).cast("double")).otherwise(F.lit(0.0))), "multipliers")
    return state.withColumn("rate", F.when(open_, F.exp("multiplier")).otherwise(F.lit(0.0)))


def place(*cols: Column) -> Column:
    """A document's place in its source's order, a number of PLACE_BITS bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(7), *cols), 64 - PLACE_BITS)


def cuts(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """source, source_size, target, ``whole`` and ``cut``: each document is taken ``whole`` times, and once more where its place is at most ``cut``."""
    # the tolerance of the dual must not push a rate of a whole number below it
    rates = rates.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("bigint"))
    rates = written(rates.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("missing")), "rates")
    rows = sized.withColumn("range", F.shiftright("place", PLACE_BITS - RANGE_BITS))
    sums = written(rows.groupBy("source", "range").agg(F.sum("size").alias("in_range")), "ranges")
    before = F.coalesce(F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.withColumn("before", before)
    ahead = ahead.join(small(rates.select(F.col("source").alias("m_source"), "missing")), ahead["source"].eqNullSafe(F.col("m_source")))
    end = F.shiftleft(F.col("range") + 1, PLACE_BITS - RANGE_BITS) - 1
    full = ahead.groupBy("source").agg(F.max(F.when((F.col("missing") > 0) & (F.col("before") + F.col("in_range") <= F.col("missing")), end)).alias("full"))
    # the range in which a source's target falls: its documents are ordered
    border = ahead.filter("before < missing and before + in_range > missing").select(F.col("source").alias("b_source"), F.col("range").alias("b_range"), "before", "missing")
    inside = rows.join(small(border), rows["source"].eqNullSafe(F.col("b_source")) & (rows["range"] == F.col("b_range")))
    order = Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = inside.withColumn("upto", F.col("before") + F.sum("size").over(order))
    # the document that crosses the target is taken if that brings the sum closer
    closer = F.col("upto") - F.col("missing") <= F.col("missing") - (F.col("upto") - F.col("size"))
    inner = upto.filter((F.col("upto") <= F.col("missing")) | ((F.col("upto") - F.col("size") < F.col("missing")) & closer)).groupBy("source").agg(F.max("place").alias("inner"))
    out = rates
    for part, name in ((full, "full"), (inner, "inner")):
        part = part.select(F.col("source").alias(f"p_{name}"), name)
        out = out.join(part, out["source"].eqNullSafe(F.col(f"p_{name}")), "left")
    return out.select("source", "source_size", "target", "whole", F.coalesce("inner", "full", F.lit(-1).cast("bigint")).alias("cut"))


def taken(rows: DataFrame, cut: DataFrame, has_words: Column, at: Column, source_col: str = "source") -> DataFrame:
    """``rows`` with source_size, target and ``copies``."""
    cut = small(cut.select(F.col("source").alias("__source"), "source_size", "target", "whole", "cut"))
    joined = rows.join(cut, rows[source_col].eqNullSafe(F.col("__source")))
    return joined.withColumn("copies", F.when(has_words, F.col("whole") + (at <= F.col("cut")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))).drop("__source", "whole", "cut")


def fitted(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """The sizes (doc_id, source, size, place) and the cuts of their sources."""
    text = F.col(text_col)
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text).alias("size"), place(F.col(id_col), text).alias("place")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # these have a row per source
    return sized, written(cuts(sized, balance(written(targets(sources, weights, most), "targets"))).coalesce(1), "cuts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each document."""
    sized, cut = fitted(docs, id_col, text_col, source_col, weights, most)
    return taken(sized, cut, F.col("size") > 0, F.col("place")).drop("place")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it; texts move to no other task."""
    _, cut = fitted(docs, id_col, text_col, source_col, weights, most)
    names = docs.columns
    numbered = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    of = dict(zip(names, numbered.columns, strict=True))
    rows = taken(numbered, cut, F.coalesce(F.col(of[text_col]).rlike(WORD), F.lit(False)), place(F.col(of[id_col]), F.col(of[text_col])), of[source_col])
    many = rows.filter("copies > 0").select(*of.values(), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("__copy"))
    return many.select(*[F.col(c).alias(n) for n, c in of.items()])
