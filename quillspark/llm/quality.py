"""Quality rules with thresholds adapted to each language and source.

``measure`` counts per document; ``thresholds`` builds one quantile sketch per
(lang, source, measure) and derives an outlier fence from it; ``judge`` joins the
fences to the documents and gives a verdict.

The sketch is a histogram with 32 buckets for each power of two of a share in parts
per 10,000, so a quantile is off by 1/32 at most, a sketch has at most ~300 buckets,
and two sketches merge by adding counts: they are summed on the map side, a source with
a third of all rows sends no more than any other.  Sketches of a language merge those of
its sources, and one of all rows merges the languages; a group of fewer than
``min_rows`` documents takes the fence of its language, and that of all rows where the
language is small too.

A fence is q75 + max(6 (q75 - q25), floor): far outside of what is usual for the group,
so an ordinary document stays whatever its group, and the floor keeps a group whose
documents are all alike from turning on them.

Defined cases: null or empty text has no words and fails; null lang or source is a group
of its own; repeated rows count and are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._shared import small, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")

#: Measure -> (numerator, denominator, floor of the fence's width in parts per 10,000).
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 400),
    "marks": ("n_marks", "word_chars", 700),
    "upper": ("n_upper", "word_chars", 2500),
    "dup_lines": ("n_dup_lines", "n_lines", 3500),
    "repeats": ("n_repeat_words", "n_words", 3000),
}
WIDTH = 6
MIN_ROWS = 200
MIN_WORDS = 50


def byte_classes() -> np.ndarray:
    """Bit 0: starts a code point that is no space; 1: one of the symbols; 2: ASCII punctuation; 3: A-Z."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        start = not 0x80 <= b < 0xC0
        space = b == 0x20 or 0x09 <= b <= 0x0D
        mark = 0x21 <= b < 0x7F and not chr(b).isalnum()
        table[b] = (start and not space) | (b in b"#*$%&|<>") << 1 | mark << 2 | (0x41 <= b <= 0x5A) << 3
    return table


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, at, n = np.unique(pairs[:-1].astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    if not again.any():
        return 0
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[k : len(words) - 2 + k] |= again
    return int(marked.sum())


def measured(texts: pa.Array, classes: np.ndarray) -> list[pa.Array]:
    """The counts of COUNTS for each text of an Arrow string column."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    texts = pa.concat_arrays([texts])  # no slice offset
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1]
    data = texts.buffers()[2]
    raw = memoryview(data)[: ends[-1]] if data is not None else memoryview(b"")
    marks = classes[np.frombuffer(raw, dtype=np.uint8)]
    out: dict[str, list[int]] = {c: [] for c in COUNTS}
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        text, m = bytes(raw[a:b]), np.bincount(marks[a:b], minlength=16)
        words = text.split()
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        bit = lambda k: int(m[[v for v in range(16) if v >> k & 1]].sum())  # noqa: E731, B023
        for c, v in zip(COUNTS, (len(words), bit(0), bit(1), len(lines) - len(set(lines)), repeated_words(words), len(lines), bit(2), bit(3)), strict=True):
            out[c].append(v)
    return [pa.array(v, pa.int64()) for v in out.values()]


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of each document."""
    source = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *measured(part.column(len(keep)), classes)], names)

    return source.mapInArrow(run, schema)


def share(name: str) -> Column:
    """A measure in parts per 10,000, rounded down; 0 where there is nothing to measure."""
    part, whole, _ = MEASURES[name]
    return F.when(F.col(whole) > 0, F.expr(f"({part} * 10000) div {whole}")).otherwise(F.lit(0).cast("bigint"))


def bucket(value: Column) -> Column:
    """The lower end of the value's bucket: exact below 64, else its upper six bits."""
    width = F.length(F.bin(value))
    step = F.greatest(width - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, step), step)


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(share(m)).alias("bucket")) for m in MEASURES])
    return measures.select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """rows and fence per ``by`` and measure; ``sketch`` may hold finer groups, whose counts add up."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.select(*by, "measure", "bucket", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(group).alias("rows"))
    quantile = lambda part: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * part, F.col("bucket")))
    floor = F.create_map(*[x for m, (_, _, f) in MEASURES.items() for x in (F.lit(m), F.lit(f))])
    return (
        ranked.groupBy(*by, "measure")
        .agg(F.first("rows").alias("rows"), quantile(1).alias("q25"), quantile(3).alias("q75"))
        .select(*by, "measure", "rows", (F.col("q75") + F.greatest((F.col("q75") - F.col("q25")) * WIDTH, floor[F.col("measure")])).alias("fence"))
    )


def thresholds(measures: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """lang, source and a column max_<measure> for each measure."""
    sketch = written(sketches(measures), "sketches")
    own, lang, every = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch, [])
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.col("rows").alias("l_rows"), F.col("fence").alias("l_fence"))
    every = every.select(F.col("measure").alias("e_measure"), F.col("fence").alias("e_fence"))
    joined = own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]) & (own["measure"] == lang["l_measure"])).join(every, F.col("measure") == F.col("e_measure"))
    fence = F.when(F.col("rows") >= min_rows, F.col("fence")).when(F.col("l_rows") >= min_rows, F.col("l_fence")).otherwise(F.col("e_fence"))
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, fence)).alias(f"max_{m}") for m in MEASURES])


def judge(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """``measures`` with ``base_failed``, ``failed`` (array of the measures beyond their fence) and ``kept``."""
    # a row per language and source
    limits = small(written(limits, "fences")).select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"max_{m}" for m in MEASURES])
    joined = measures.join(limits, measures["lang"].eqNullSafe(F.col("t_lang")) & measures["source"].eqNullSafe(F.col("t_source")), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(share(m) > F.col(f"max_{m}"), F.lit(m)) for m in MEASURES]), lambda x: x.isNotNull())
    return joined.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("t_lang", "t_source")


def quality(docs: DataFrame, id_col: str = "doc_id", min_rows: int = MIN_ROWS) -> DataFrame:
    """All of it: id, counts, fences and verdict of each document."""
    measures = written(measure(docs, [id_col, "lang", "source"]), "measures")
    return judge(measures, thresholds(measures, min_rows))
