"""Corpus statistics: vocabulary, n-grams, contexts, deletion index.

All start from sentences as arrays and explode only what is counted, so each is one scan
and one aggregation whose partial counts are combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.tokens import BOUNDARY, START, STOP
from quillspark.storage import materialized

SPECIALS = (START, STOP, "<unk>")
#: Hashes that may be sent to all executors.
MOST_HASHES = 2_000_000


def vocabulary(sentences: DataFrame) -> DataFrame:
    """term and count."""
    return sentences.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("count"))


def numbered(df: DataFrame, *order: Column, name: str = "id", start: int = 1) -> DataFrame:
    """``df`` with dense numbers in the given total order.

    Rows are sorted in ranges, numbered within each, and shifted by the sizes of the ranges
    before; only these sizes, a row per range, meet in one place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    ranged = materialized(ranged, "ranged")
    ranged = ranged.withColumn("__part", F.shiftright("__m", 33)).withColumn("__at", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__part").alias("__p"), before.alias("__before"))
    return ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(name, F.col("__before") + F.col("__at") + start).drop("__m", "__part", "__at", "__p", "__before")


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with running totals, ``sums`` from their names to the columns summed, in the given total order of distinct rows.

    As ``numbered``: each range is summed by itself and shifted by the totals of the ranges before.
    """
    ranged = materialized(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    out = out.withColumns({n: F.col(f"__{n}") + F.sum(c).over(within) for n, c in sums.items()})
    return out.drop("__part", "__p", *[f"__{n}" for n in sums])


def term_ids(vocab: DataFrame) -> DataFrame:
    """id, term, frequency: dense by falling count, then term; the special terms follow with frequency 0."""
    ranked = numbered(vocab, F.col("count").desc(), F.col("term").asc()).select("id", "term", F.col("count").alias("frequency"))
    n = vocab.count()
    special = F.explode(F.array(*[F.struct(F.lit(n + k + 1).cast("bigint").alias("id"), F.lit(t).alias("term"), F.lit(0).cast("bigint").alias("frequency")) for k, t in enumerate(SPECIALS)]))
    return ranked.union(vocab.sparkSession.range(1).select(special.alias("s")).select("s.*"))


def padded(tokens: Column, order: int, backward: bool = False) -> Column:
    own = F.reverse(tokens) if backward else tokens
    return F.concat(F.array_repeat(F.lit(START), order - 1), own, F.array(F.lit(STOP)))


def ngrams(sentences: DataFrame, n: int, order: int, backward: bool = False) -> DataFrame:
    """``ngram`` (tokens with spaces between) and count, of sentences padded for models of ``order``."""
    row = sentences.select(padded(F.col("tokens"), order, backward).alias("p"))
    grams = F.transform(F.sequence(F.lit(1), F.size("p") - n + 1), lambda i: F.array_join(F.slice("p", i, n), " "))
    return row.filter(F.size("p") >= n).select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("count"))


def around(sentences: DataFrame) -> DataFrame:
    """term, left, right of every token; a sentence's ends are the boundary sentinel."""
    n = F.size("tokens")
    left = F.concat(F.array(F.lit(BOUNDARY)), F.slice("tokens", F.lit(1), n - 1))
    right = F.concat(F.slice("tokens", F.lit(2), n), F.array(F.lit(BOUNDARY)))
    rows = sentences.filter(n > 0).select(F.arrays_zip(F.col("tokens").alias("term"), left.alias("left"), right.alias("right")).alias("c"))
    return rows.select(F.inline("c"))


def contexts(sentences: DataFrame) -> DataFrame:
    """term, left, right and count; a sentence's ends are the boundary sentinel."""
    return around(sentences).groupBy("term", "left", "right").agg(F.count("*").alias("count"))


def mined_contexts(sentences: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Rows of ``contexts`` that can give error triples of ``pairs`` (intended, observed): those of every left and
    right around ``least`` tokens or more, one of them an observed term, and few others.

    Terms of no pair are one row of a context, with a null term, so that totals are whole.
    Terms and contexts are looked up by their hashes, so that no word travels but those of
    the rows returned; a hash that others share may leave other contexts in.
    """
    words = around(sentences).withColumn("__h", F.xxhash64("left", "right")).withColumn("__t", F.xxhash64("term"))
    sides = F.explode(F.array(F.struct(F.col("observed").alias("term"), F.lit(True).alias("rare")), F.struct(F.col("intended").alias("term"), F.lit(False).alias("rare"))))
    terms = materialized(pairs.select(sides.alias("s")).groupBy(F.xxhash64("s.term").alias("__t")).agg(F.max("s.rare").alias("rare")), "pair_terms")
    terms = terms.hint("broadcast" if terms.count() <= MOST_HASHES else "merge")
    counted = words.join(terms, "__t", "left").groupBy("__h").agg(F.count("*").alias("n"), F.max("rare").alias("rare"))
    often = materialized(counted.filter((F.col("n") >= least) & F.col("rare")).select("__h"), "often")
    often = often.hint("broadcast" if often.count() <= MOST_HASHES else "merge")
    kept = words.join(often, "__h", "left_semi").join(terms, "__t", "left")
    return kept.groupBy(F.when(F.col("rare").isNotNull(), F.col("term")).alias("term"), "left", "right").agg(F.count("*").alias("count"))


def context_totals(context: DataFrame) -> DataFrame:
    return context.groupBy("left", "right").agg(F.sum("count").alias("count"))


def metadata(sentences: DataFrame, order: int) -> DataFrame:
    """One row: sentence_count, token_count, term_count and the unigrams of a model, which count the padding."""
    size = F.size("tokens").cast("bigint")
    one = sentences.agg(F.count("*").alias("sentence_count"), F.coalesce(F.sum(size), F.lit(0)).alias("token_count"), F.coalesce(F.sum(size + order), F.lit(0)).alias("forward_unigrams"))
    types = vocabulary(sentences).agg(F.count("*").alias("term_count"))
    return one.join(types).withColumn("backward_unigrams", F.col("forward_unigrams"))


def deletions(term: Column, distance: int) -> Column:
    """All strings left by deleting up to ``distance`` characters, the term included."""
    one = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))
    out = F.array(term)
    for _ in range(distance):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def delete_index(vocab: DataFrame, distance: int) -> DataFrame:
    """delete_key, term, count."""
    return vocab.select(F.explode(deletions(F.col("term"), distance)).alias("delete_key"), "term", "count")


def substitution_keys(term: Column) -> Column:
    """The term with each character in turn replaced by a zero character: terms one substitution apart share a key."""
    at = F.sequence(F.lit(1), F.greatest(F.length(term), F.lit(1)))
    return F.when(F.length(term) > 0, F.transform(at, lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.lit("\0"), F.substring(term, i + 1, F.length(term))))).otherwise(F.array().cast("array<string>"))
