"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give the probability of a word as the product
of its characters (bytes of UTF-8, A-Z in lower case) and of the mark that ends it, each
given the ORDER - 1 before it back to the mark that begins the word.  At each order, counts
are discounted absolutely and what that frees goes to the next shorter history.  The
longest order, and the beginnings of words, are counted by occurrence; shorter ones by the
Kneser-Ney continuation count, in how many different longer contexts a class has them; the
shortest backs off to one distribution that both classes share.  At each history both
classes leave the same mass to the shorter one, the larger of the two (all of it where a
class has not seen the history): without that, rare words would always speak for the class
with less text.  So a rare expression is judged by the longest stretches of it that both
classes know, and beyond them says nothing.

The log-likelihood ratio of a character is that of its longest known gram; written as a sum
over all its grams, each with what it adds to its suffix (``delta``), the ratio of a word
needs no order among them.  Grams that add nothing are not held: those that neither class
has seen more often than the discount.

A document's score is that of its worst passage: the largest log-likelihood ratio per word
over windows of so many words (a shorter text is one window of its own length), so a toxic
passage in a very long text is found and length alone raises nothing.  The window, of
``WINDOWS``, and a logistic curve (with one bend) that gives 0 to 1 are fitted to one
labelled row in SET_ASIDE, scored by a model that has not seen it.

Counts cover every labelled row and stay in tables; the probabilities of grams are computed
where they meet their suffixes, with which they share the last bytes.  Up to BLOCK grams go to the workers at once; a larger
model is applied block by block, each adding to the words' ratios, with the same result.

Defined cases: null and empty texts have no words and get the score of a zero ratio; a
very long text or word is read whole; rows without a label train nothing; a document
labelled more than once counts as toxic if half of its labels say so; repeated rows all
stay; columns of any name may be kept; without labels of both classes every score is the
share of toxic labels, or 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._shared import drop_written, written
from quillspark.llm.simhash import runs_of

#: Bytes of a gram, the last one given the others; a gram is held as one 64-bit number.
ORDER = 7
WINDOWS = (1, 2, 4, 8, 16, 32)
DISCOUNT = 3.0
#: A word's ratio stays within this, so that no single expression outweighs a passage without bound.
CLIP = 12.0
#: Grams of up to so many bytes have their probabilities computed in one place; longer ones where their last bytes meet.
SHORT = 2
#: Grams that are broadcast at once.
BLOCK = 4_000_000
#: Labels up to this many are joined by broadcast, more by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Words whose ratio a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 200_000
#: The mark between words.
MARK = b" "
#: ASCII letters (in lower case) and digits stay, other ASCII is space; bytes from 0x80 stay.
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: One labelled row in so many is kept from the first model, for the window and the curve.
SET_ASIDE = 4
#: Of the two models (of the other rows, of all rows): the classes by which toxic and ordinary text is counted.
SIDES = (((1,), (0,)), ((1, 3), (0, 2)))
WHOLE = 1
COUNTS = [f"{c}{m}" for m in range(len(SIDES)) for c in "to"]


Table = tuple[np.ndarray, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(SPLIT).split()


def codes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of each word and at the mark after it, as a number, and how many each word has."""
    joined = np.frombuffer(MARK + MARK.join(words) + MARK, np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    at, begins = np.arange(1, len(joined)), np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        inside = at - k >= begins
        codes[inside] |= joined[at[inside] - k] << np.uint64(8 * k)
    return codes, lengths


def word_counts(rows: DataFrame, text_col: str, class_col: str, n_classes: int) -> DataFrame:
    """word and its count n0, n1, ... in each class."""
    schema = T._parse_datatype_string("word string, " + ", ".join(f"n{c} bigint" for c in range(n_classes)))

    def flush(held: list[Counter]) -> pa.RecordBatch:
        words = list(set().union(*held))
        out = [pa.array(words, pa.binary()).cast(pa.string()), *(pa.array([c.get(w, 0) for w in words], pa.int64()) for c in held)]
        for c in held:
            c.clear()
        return pa.RecordBatch.from_arrays(out, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in range(n_classes)]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held[c].update(words_of(text))
                if sum(map(len, held)) > HELD_WORDS:
                    yield flush(held)
        yield flush(held)

    made = rows.select(text_col, class_col).mapInArrow(run, schema)
    return made.groupBy("word").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in range(n_classes)])


def gram_counts(words: DataFrame, n_classes: int) -> DataFrame:
    """code and the counts COUNTS of each gram of ORDER bytes and of each shorter one that begins a word."""
    schema = T._parse_datatype_string("code bigint, " + ", ".join(f"n{c} bigint" for c in range(n_classes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                codes, lengths = codes_of([w.encode() for w in part.column(0).to_pylist()])
                found, of = np.unique(codes, return_inverse=True)
                sums = [np.bincount(of, np.repeat(n.to_numpy(), lengths), len(found)).astype(np.int64) for n in part.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *map(pa.array, sums)], schema.names)

    made = words.select("word", *schema.names[1:]).mapInArrow(run, schema)
    sums = made.groupBy("code").agg(*[F.sum(n).alias(n) for n in schema.names[1:]])
    counts = {f"{c}{m}": reduce(Column.__add__, [F.col(f"n{k}") for k in side[i]]) for m, side in enumerate(SIDES) for i, c in enumerate("to")}
    return sums.select("code", *[counts[n].alias(n) for n in COUNTS])


def last_bytes(code: Column, n: int) -> Column:
    return code.bitwiseAND(F.lit((1 << 8 * n) - 1).cast("bigint"))


def counted(grams: DataFrame) -> DataFrame:
    """order, code and counts of every gram: continuation counts, but occurrences at ORDER and of grams that begin a word.

    The number of bytes of a code is told by its size, since no byte is 0.
    """
    bytes_ = sum((F.col("code") >= 1 << 8 * k).cast("int") for k in range(ORDER))
    suffixes = F.explode(F.array_distinct(F.array(*[last_bytes(F.col("code"), k) for k in range(1, ORDER)]))).alias("part")
    # which proper suffixes a model's class has; a gram that is a suffix begins no word
    seen = [F.max(F.col(n) > 0).alias(n) for n in COUNTS]
    parts = grams.select("code", suffixes, *COUNTS).filter("part <> code").groupBy(F.col("part").alias("code")).agg(*seen)
    every = grams.select("code", *[(F.col(n) > 0).alias(n) for n in COUNTS]).unionByName(parts).withColumn("order", bytes_).filter("order > 1")
    drop_first = F.expr("code & (shiftleft(1L, 8 * (order - 1)) - 1L)")
    kinds = every.groupBy(drop_first.alias("code")).agg(*[F.count_if(n).alias(n) for n in COUNTS])
    return grams.unionByName(kinds).withColumn("order", bytes_)


def probabilities(facts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Probabilities of grams of one order in each class and model, from the counts, sum_ and kept_ of each and the probabilities of their suffixes."""
    n, sums, kept = np.split(facts, 3, axis=1)
    with np.errstate(all="ignore"):
        left = np.where(sums > 0, 1 - kept / sums, 1.0)
        share = np.where(kept > 0, np.maximum(n - DISCOUNT, 0.0) / kept, 0.0)
    rest = np.maximum(left[:, 0::2], left[:, 1::2]).repeat(2, axis=1)
    return (1 - rest) * share + rest * low


def added(p: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What grams add to their suffixes' ratios in each model; a model that has not seen a byte says nothing of it."""
    with np.errstate(all="ignore"):
        ratio, below = (np.where((x[:, 0::2] > 0) & (x[:, 1::2] > 0), np.log(x[:, 0::2] / x[:, 1::2]), 0.0) for x in (p, low))
    return ratio - below


def chained(codes: np.ndarray, facts: np.ndarray, below: Table, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each order from ``first`` on: codes, sorted, their probabilities, what they add, and whether they are held.

    ``below`` are the codes, sorted, and probabilities of the order before; all suffixes are there.
    """
    for k in range(first, last + 1):
        rows = np.flatnonzero((codes >= np.uint64(1 << 8 * (k - 1))) & (codes < np.uint64(1 << 8 * k)))
        rows = rows[np.argsort(codes[rows])]
        if k == 1:
            both = facts[rows][:, 0 : 2 * len(SIDES) : 2] + facts[rows][:, 1 : 2 * len(SIDES) : 2]
            low = (both / np.maximum(both.sum(axis=0), 1)).repeat(2, axis=1)
        else:
            low = below[1][np.searchsorted(below[0], codes[rows] & np.uint64((1 << 8 * (k - 1)) - 1))] if len(rows) else np.zeros((0, 2 * len(SIDES)))
        p = probabilities(facts[rows], low)
        below = (codes[rows], p)
        yield codes[rows], p, added(p, low), facts[rows][:, : 2 * len(SIDES)].max(axis=1, initial=0) > DISCOUNT


def facts_of(columns: list[pa.ChunkedArray] | list[pa.Array]) -> np.ndarray:
    return np.stack([c.to_numpy().astype(float) for c in columns], axis=1) if columns else np.zeros((0, 3 * 2 * len(SIDES)))


def with_history(grams: DataFrame) -> DataFrame:
    """``grams`` with sum_ and kept_, the sums over the grams of one history before and after the discount."""
    kept = [F.sum(F.greatest(F.col(n) - DISCOUNT, F.lit(0.0))).alias(f"kept_{n}") for n in COUNTS]
    sums = grams.groupBy(F.shiftright("code", 8).alias("h")).agg(*[F.sum(n).alias(f"sum_{n}") for n in COUNTS], *kept)
    return grams.join(sums, F.shiftright("code", 8) == F.col("h")).drop("h")


def hashed(codes: np.ndarray, adds: np.ndarray) -> Table:
    """An open hash table of the codes, 0 where a slot is free, and what is added for each slot."""
    bits = max(4, (2 * len(codes)).bit_length())
    slots, values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
    left, at = np.arange(len(codes)), slot(codes, bits)
    while len(left):
        free = slots[at] == 0
        _, first = np.unique(at[free], return_index=True)
        placed = np.flatnonzero(free)[first]
        slots[at[placed]], values[at[placed]] = codes[left[placed]], adds[left[placed]]
        waits = np.ones(len(left), bool)
        waits[placed] = False
        left, at = left[waits], at[waits] + 1 & (1 << bits) - 1
    return slots, values


def slot(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def found(codes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the codes the table has, and the slots of these."""
    at = slot(codes, len(slots).bit_length() - 1)
    there = slots[at]
    hit, open_ = there == codes, np.flatnonzero((there != codes) & (there != 0))
    while len(open_):
        at[open_] = at[open_] + 1 & len(slots) - 1
        there = slots[at[open_]]
        hit[open_] = there == codes[open_]
        open_ = open_[(there != codes[open_]) & (there != 0)]
    return np.flatnonzero(hit), at[hit]


@dataclass
class Model:
    """code and d0, d1, ... of each gram held of more than SHORT bytes, their number, and the shorter grams."""

    table: DataFrame
    n: int
    short: Table

    def blocks(self, number: int) -> Iterator[Table]:
        """A hash table of what grams add in the model of that number, BLOCK grams or about as many at a time."""
        n_blocks = max(1, -(-self.n // BLOCK))
        for b in range(n_blocks):
            # no more than a block comes to the driver
            rows = self.table.filter(F.pmod(F.xxhash64("code"), F.lit(n_blocks)) == b).select("code", f"d{number}").toArrow()
            codes, adds = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
            if b == 0:
                codes, adds = np.concatenate([codes, self.short[0]]), np.concatenate([adds, self.short[1][:, number]])
            yield hashed(codes, adds)


def build(words: DataFrame, n_classes: int = 4) -> Model:
    """The models of SIDES, from the words and their counts in each class."""
    grams = written(gram_counts(words, n_classes), "grams")
    every = written(counted(grams), "orders")
    ready = written(with_history(every), "histories")
    names = [*COUNTS, *[f"sum_{n}" for n in COUNTS], *[f"kept_{n}" for n in COUNTS]]
    # no more than there are strings of SHORT bytes
    short = ready.filter(F.col("order") <= SHORT).select("code", *names).toArrow()
    parts = list(chained(short.column(0).to_numpy().view(np.uint64), facts_of(short.columns[1:]), (np.zeros(0, np.uint64), np.zeros((0, 2 * len(SIDES)))), 1, SHORT))
    below = ready.sparkSession.sparkContext.broadcast((parts[-1][0], parts[-1][1]))
    schema = T._parse_datatype_string("code bigint, " + ", ".join(f"d{m} float" for m in range(len(SIDES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, code, *columns) in runs_of(batches):
            for codes, _, adds, held in chained(code.to_numpy().view(np.uint64), facts_of(columns), below.value, SHORT + 1, ORDER):
                yield pa.RecordBatch.from_arrays([pa.array(codes[held].view(np.int64)), *[pa.array(adds[held, m].astype(np.float32)) for m in range(len(SIDES))]], schema.names)

    # a gram and its suffixes have the last bytes in common
    n_parts = int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longer = ready.filter(F.col("order") > SHORT).select(last_bytes(F.col("code"), SHORT + 1).alias("key"), "code", *names)
    table = written(longer.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(run, schema), "model")
    for t in (grams, every, ready):
        drop_written(t)
    own = [(codes[held], adds[held].astype(np.float32)) for codes, _, adds, held in parts]
    return Model(table, table.count(), (np.concatenate([c for c, _ in own]), np.concatenate([a for _, a in own])))


def word_ratios(words: list[bytes], table: Table) -> np.ndarray:
    """What a table's grams add to the ratio of each word."""
    codes, lengths = codes_of(words)
    slots, adds = table
    out = np.zeros(len(codes))
    for k in range(1, ORDER + 1):
        there = np.flatnonzero(codes >> np.uint64(8 * (k - 1)))
        hit, at = found(codes[there] & np.uint64((1 << 8 * k) - 1), slots)
        out[there[hit]] += adds[at]
    return np.add.reduceat(out, np.cumsum(lengths) - lengths)


class Ratios:
    """Ratios of words, computed for all new words of some texts at once; short words are remembered."""

    def __init__(self, table: Table):
        self.table, self.seen = table, {}

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Of each text the ratios of its words."""
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        seen = self.seen
        new = list(set().union(*texts).difference(seen))
        if new:
            seen.update(zip(new, word_ratios(new, self.table).tolist(), strict=True))
        out = [np.fromiter(map(seen.__getitem__, words), float, len(words)) for words in texts]
        for w in new:
            if len(w) > LONGEST:
                del seen[w]
        return out


def windows(ratios: np.ndarray) -> list[float]:
    """For each window, the largest sum over so many words in sequence, per word."""
    n = len(ratios)
    if not n:
        return [0.0] * len(WINDOWS)
    sums = np.concatenate([[0.0], np.cumsum(np.clip(ratios, -CLIP, CLIP))])
    return [float(sums[-1] / n if n <= w else (sums[w:] - sums[:-w]).max() / w) for w in WINDOWS]


def passages(rows: DataFrame, keep: list[str], text_col: str, model: Model, number: int = WHOLE) -> DataFrame:
    """The columns ``keep`` as c0, c1, ... and ``passages``, one ratio per window, by one of the models."""
    kept = [f"c{k}" for k in range(len(keep))]
    source = rows.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(text_col).alias("text"))
    n_blocks = max(1, -(-model.n // BLOCK))
    for b, block in enumerate(model.blocks(number)):
        last = b == n_blocks - 1
        source = rated(source, kept, block, first=b == 0, last=last)
        if not last:
            source = written(source, f"ratios-{b}")
    return source


def rated(source: DataFrame, kept: list[str], block: Table, first: bool, last: bool) -> DataFrame:
    """Adds a block to the ratios of each text's words; the last one gives ``passages`` in place of text and ratios."""
    held = source.sparkSession.sparkContext.broadcast(block)
    n = len(kept)
    made = [T.StructField("passages", T.ArrayType(T.DoubleType()))] if last else [source.schema.fields[n], T.StructField("ratios", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*source.schema.fields[:n], *made])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = Ratios(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sums = ratios.of([words_of(t) for t in part.column(n).to_pylist()])
                if not first:
                    sums = [f + np.array(r, float) for f, r in zip(sums, part.column(n + 1).to_pylist(), strict=True)]
                out = [windows(f) for f in sums] if last else [f.tolist() for f in sums]
                columns = part.columns[: n if last else n + 1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], names)

    return source.mapInArrow(run, schema)


def curve(bins: np.ndarray, bend: float = math.inf, penalty: float = 0.02) -> tuple[tuple[float, float, float], float]:
    """Slope, intercept and further slope above ``bend`` of a logistic curve through binned scores (rows of passage, toxic, n), and its log-loss."""
    x, y, w = bins.T
    if len(np.unique(y)) < 2:
        share = float((y * w).sum() / w.sum()) if len(w) else 0.0
        return (0.0, math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0), 0.0
    scale = max(float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))), 1e-6)
    features = np.stack([x / scale, np.ones(len(x)), np.maximum(x - bend, 0.0) / scale], axis=1)
    beta, ridge = np.zeros(3), np.array([penalty, 1e-9, penalty])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -35, 35)))
        gradient = features.T @ (w * (y - p)) - ridge * beta
        hessian = (features * (w * p * (1 - p))[:, None]).T @ features + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(features @ beta, -35, 35))), 1e-12, 1 - 1e-12)
    loss = float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    rises = beta[0] >= 0 and beta[0] + beta[2] >= 0
    return (float(beta[0] / scale), float(beta[1]), float(beta[2] / scale)), loss if rises or math.isinf(bend) else math.inf


def curves(bins: np.ndarray) -> tuple[tuple[float, float, float], float, float]:
    """The best curve over bends at the tenths of the toxic scores, its bend (infinite: none) and its log-loss."""
    toxic = bins[bins[:, 1] == 1]
    toxic = toxic[np.argsort(toxic[:, 0])]
    upto = np.cumsum(toxic[:, 2])
    bends = {float(toxic[np.searchsorted(upto, upto[-1] * k / 10), 0]) for k in range(1, 10)} if len(toxic) else set()
    (line, loss), bend = min(((curve(bins, b), b) for b in (math.inf, *sorted(bends))), key=lambda f: f[0][1])
    return line, bend, loss


@dataclass
class Classifier:
    model: Model
    window: int  # its number in WINDOWS
    slope: float
    intercept: float
    more: float = 0.0  # slope added above the bend
    bend: float = math.inf


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) that have a label, with ``toxic``."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.join(known, docs["doc_id"] == F.col("l_id")).drop("l_id")


def fit(training: DataFrame) -> Classifier:
    """Fit to ``training`` (doc_id, text, toxic)."""
    aside = (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SET_ASIDE)) == 0).cast("int")
    rows = training.select("text", "toxic", aside.alias("aside"))
    model = build(written(word_counts(rows.withColumn("class", (F.col("aside") * 2 + F.col("toxic")).cast("int")), "text", "class", 4), "words"))
    scored = passages(rows.filter("aside = 1"), ["toxic"], "text", model, 0)
    each = scored.select(F.col("c0").alias("toxic"), F.posexplode("passages").alias("window", "passage"))
    bins = each.groupBy("window", F.round("passage", 2).alias("passage"), "toxic").agg(F.count("*").alias("n")).collect()
    # no more rows than ratios have hundredths
    fits = [(*curves(np.array([r[1:] for r in bins if r.window == k], float).reshape(-1, 3)), k) for k in range(len(WINDOWS))]
    (slope, intercept, more), bend, _, window = min(fits, key=lambda f: (f[2], f[3]))
    return Classifier(model, window, slope, intercept, more, bend)


def score(docs: DataFrame, classifier: Classifier, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` and ``name``, the probability of the label 1."""
    rows = passages(docs, keep, text_col, classifier.model)
    x = F.col("passages")[classifier.window]
    z = x * classifier.slope + classifier.intercept
    if math.isfinite(classifier.bend):
        z = z + F.greatest(x - classifier.bend, F.lit(0.0)) * classifier.more
    probability = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], probability.alias(name))
