"""I-Match document fingerprints with DataFrame functions only.

Terms are the distinct lower-case words of a text.  The lexicon holds the terms whose
document frequency lies in a band of shares of all documents, that is, an inverse document
frequency band; at most (distinct terms of a document) / LOW terms can, whatever the size
of the corpus.  They are held as a constant of the plan, a table in which each term has
one of PROBES slots, so that a term is looked up in a few steps and no other term passes
(but for equal 64-bit hashes).

A fingerprint hashes the sorted terms of the lexicon that a text has, and those of several
randomised lexicons: COPIES times, LEVELS lexicons, each a random half of the one before.
The large ones tell texts apart by a single term, the small ones, in which a text has a
term or two, often survive an edit.  The likeness of two fingerprints is the share of
copies that agree on the smallest lexicon in which either text has a term, so about the
share of terms that the texts have in common.

Defined cases: null text counts as empty; a very long text is read whole; a text without
a term of the lexicon is hashed by all its terms; equal texts have equal fingerprints, the
likeness of equal ones is 1; repeated rows are each reported; columns of any name may be
kept; an empty table gives no rows.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import written

#: What stands between words.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Document frequencies of the lexicon's terms, as shares of all documents; and at least so many documents.
LOW, HIGH, LEAST = 0.002, 0.05, 2
#: Slots in which a term of the lexicon may stand.
PROBES = 3
COPIES, LEVELS = 8, 8
SEED = 11


def terms(text: Column) -> Column:
    """Hashes of the terms of a text, repeats included."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS)
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(F.lit(SEED), w))


def frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """term and df, the number of documents that have it."""
    return docs.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH, least: int = LEAST) -> DataFrame:
    """term, for each term of the band."""
    n = docs.count()
    return frequencies(docs, text_col).filter((F.col("df") >= max(least, low * n)) & (F.col("df") <= max(least, high * n))).select("term")


def slot(term: Column, probe: int, bits: int) -> Column:
    """A slot of a term in a table of 2^bits: other bits of its hash for each probe while these last, else a further hash."""
    if bits * PROBES <= 64:
        return F.shiftrightunsigned(term, 64 - bits * (probe + 1)).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")
    return F.xxhash64(F.lit(probe), term).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")


@dataclass
class Lexicon:
    bits: int
    table: Column  # array of 2^bits terms, 0 where a slot is free

    def has(self, term: Column) -> Column:
        return reduce(Column.__or__, [self.table[slot(term, k, self.bits)] == term for k in range(PROBES)])


def lexicon_table(rows: DataFrame) -> Lexicon:
    """The terms of ``rows``, no more than the band can have, as a constant."""
    bits = max(6, (2 * rows.count()).bit_length())
    listed = rows.filter("term <> 0").select("term", *[slot(F.col("term"), k, bits).alias(f"s{k}") for k in range(PROBES)]).orderBy("term").collect()
    table = placed([r[0] for r in listed], [r[1:] for r in listed], 1 << bits)
    # one string that the optimizer turns into an array once, not a node of the plan for each slot
    return Lexicon(bits, F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"))


def placed(terms_: list[int], slots: list[tuple[int, ...]], size: int) -> list[int]:
    """A table with each term in one of its slots; a term that finds none free takes one from another, which moves on."""
    owner = [-1] * size
    rnd = random.Random(SEED)
    for first in range(len(terms_)):
        k = first
        for _ in range(10_000):
            free = [s for s in slots[k] if owner[s] < 0]
            if free:
                owner[free[0]] = k
                break
            s = rnd.choice(slots[k])
            owner[s], k = k, owner[s]
        else:
            raise RuntimeError("the terms of the lexicon found no place in a table of twice their number")
    return [terms_[k] if k >= 0 else 0 for k in owner]


def held(found: Column, table: Lexicon) -> Column:
    """Those of the terms that the lexicon has."""
    return F.filter(found, table.has)


def hashes(found: Column, table: Lexicon) -> Column:
    """The hash of each lexicon's sorted terms among ``found``, 0 where there is none; the whole lexicon first."""

    def of_lexicons(own: Column) -> Column:
        lists = []
        for copy in range(COPIES):
            lists.append(F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.struct(own.alias("left"), F.array().cast("array<bigint>").alias("out")), halved(copy), lambda acc: acc["out"]))
        return F.concat(F.array(F.xxhash64(own)), *lists)

    listed = F.transform(F.array(found), lambda ts: F.struct(F.sort_array(F.array_distinct(held(ts, table))).alias("own"), ts.alias("all")))
    chosen = F.transform(listed, lambda x: F.when(F.size(x["own"]) > 0, of_lexicons(x["own"])).otherwise(F.concat(F.array(F.xxhash64(F.sort_array(F.array_distinct(x["all"])))), F.array_repeat(F.lit(0).cast("bigint"), COPIES * LEVELS))))
    return chosen[0]


def halved(copy: int):
    """A step to the next smaller lexicon of a copy: the terms with one more bit of their hash unset."""

    def step(acc: Column, level: Column) -> Column:
        left = F.filter(acc["left"], lambda t: F.call_function("shiftright", t, level + copy * LEVELS) % 2 == 0)
        out = F.when(F.size(left) > 0, F.xxhash64(left)).otherwise(F.lit(0).cast("bigint"))
        return F.struct(left.alias("left"), F.concat(acc["out"], F.array(out)).alias("out"))

    return step


def likeness(a: Column, b: Column) -> Column:
    """Share of copies that agree on their smallest lexicon in which either text has a term."""

    def agrees(x: Column, y: Column, copy: int) -> Column:
        # smallest lexicon first
        at = range(copy * LEVELS + LEVELS, copy * LEVELS, -1)
        return F.coalesce(*[F.when((x[k] != 0) | (y[k] != 0), (x[k] == y[k]).cast("int")) for k in at])

    def share(x: Column, y: Column) -> Column:
        votes = [agrees(x, y, c) for c in range(COPIES)]
        number = reduce(Column.__add__, [v.isNotNull().cast("int") for v in votes])
        same = reduce(Column.__add__, [F.coalesce(v, F.lit(0)) for v in votes])
        return F.when(x == y, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(same.cast("double"), number.cast("double")), F.lit(0.0)))

    # the variable of a lambda is evaluated once
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: share(s["a"], s["b"]))[0]


def printed(found: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits per lexicon."""
    return F.array_join(F.transform(found, lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def fingerprint(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``hashes`` of each text."""
    table = lexicon_table(written(lexicon(docs, text_col), "lexicon"))
    kept = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], hashes(terms(F.col(text_col)), table).alias("hashes"))
    return rows.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "hashes")
