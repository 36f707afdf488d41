"""Token-ID output: Parquet list columns in document order.

``write`` encodes texts and writes one row per document, ascending by document id,
across part files whose order is the order of their names.  A file has the columns

* ``doc_id``, ``part`` (number of the file), ``part_start`` (ids of the documents
  before it in the file), ``n_tokens``: sorted or slowly changing numbers, delta encoded;
* ``ids`` array<int>: dictionary encoded, so an id takes the bits its vocabulary needs.

Row groups and pages have set sizes and every page has its entry in the page index, so
a reader that asks for a few documents, or for the metadata alone, touches only those
pages.  ``read`` adds ``start``, the ids of all documents before: the sums per file are
one row per file, and only those are accumulated in one place.

Texts are cut at spaces and line feeds, which no token of the tokenizer spans; words
already encoded by the tokenizers library are remembered in a bounded table per worker
(what it holds changes the time, never the result).

Defined cases: a null text is an empty document and has only the end id; null document
ids come first; rows with equal ids all stay, ordered by a hash of the text; an empty
table gives no rows.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a worker remembers per generation.
WORDS = 250_000
#: Bytes of text, at most (or one text), whose words are collected at once.
SLICE_BYTES = 6 << 20
#: Words that one call of the library encodes together.
TOGETHER = 256
#: Chunks of these characters keep their length and word borders when the tokenizer normalizes them.
SIMPLE = regex.compile(r"[!-~¡-¬®-ÿ]+")
#: Chunks that are one word, and one word and a mark, of letters among those characters.
ONE, TWO = (f"^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+{end}$" for end in ("", "[.,]"))
#: The word pattern of the tokenizer (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordCache:
    """Ids of texts, by way of their distinct chunks, by way of the distinct words in these.

    Unknown words go to the library many at a time, with spaces between; the ids of one
    word end with an id whose token ends a word.  Where the ends don't agree with the
    words, and for chunks of other characters, the library encodes each alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values(), default=0) + 2, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = list(dict.fromkeys(t.content[0] for t in self.library.get_added_tokens_decoder().values()))
        self.words: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def alone(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for group, encoded in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype="<u4")
            last = (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1) * 4
            if len(last) == len(group) and len(ids) * 4 == last[-1]:
                data, at = ids.tobytes(), 0
                for word, end in zip(group, last.tolist(), strict=True):
                    self.words[word] = data[at:end]
                    at = end
            else:
                self.words.update(zip(group, self.alone(group), strict=True))

    def pieces(self, chunk: str) -> list[str] | None:
        """The words of a chunk as the tokenizer normalizes and cuts it; None where the library must."""
        if not chunk.isascii() and not SIMPLE.fullmatch(chunk):
            return None
        if any(s in chunk for s in self.special) or not SIMPLE.fullmatch(chunk):
            return None
        return PATTERN.findall(chunk.lower())

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words that the tokenizer neither changes nor cuts."""
        if len(self.words) > WORDS:
            self.words, self.old = {"": b""}, self.words
        known, old = self.words, self.old
        out = list(map(known.get, words))
        missing = [k for k, e in enumerate(out) if e is None]
        self.learn([words[k] for k in missing if words[k] not in old])
        for k in missing:
            w = words[k]
            e = known.get(w)
            if e is None:
                e = known[w] = old[w]
            out[k] = e
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of other chunks."""
        cut = [self.pieces(c) for c in chunks]
        words = list({w: None for ws in cut if ws for w in ws})
        of = dict(zip(words, self.encode_words(words), strict=True))
        left = [k for k, ws in enumerate(cut) if ws is None]
        out = [b"".join(map(of.__getitem__, ws)) if ws else b"" for ws in cut]
        for at in range(0, len(left), 4096):
            some = left[at : at + 4096]
            for k, e in zip(some, self.alone([chunks[k] for k in some]), strict=True):
                out[k] = e
        return out

    def units(self, chunks: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of units, and each chunk's units as their numbers and how many: a word, a word and a mark, or the chunk."""
        one, two = (pc.match_substring_regex(chunks, p).to_numpy(zero_copy_only=False) for p in (ONE, TWO))
        plain = one | two
        words = pc.utf8_lower(pc.utf8_rtrim(chunks.filter(pa.array(plain)), ".,")).dictionary_encode()
        rest = chunks.filter(pa.array(~plain)).to_pylist()
        known = [*words.dictionary.to_pylist(), ".", ","]
        encoded = [*self.encode_words(known), *self.encode_chunks(rest)]
        count = 1 + two.astype(np.int32)
        first = np.cumsum(count) - count
        number = np.empty(int(count.sum()), dtype=np.int32)
        number[first[plain]] = words.indices.to_numpy()
        number[first[~plain]] = len(known) + np.arange(len(rest), dtype=np.int32)
        commas = pc.ends_with(chunks, ",").to_numpy(zero_copy_only=False)[two]
        number[first[two] + 1] = len(known) - 2 + commas
        return encoded, number, count

    def encode(self, texts: pa.Array, ending: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in sequence, each with ``ending``, and where each text's ids start and end."""
        chunks = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        encoded, number, count = self.units(coded.dictionary)
        bounds = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        # the ending is one more chunk of one more unit
        encoded, number, count = [*encoded, ending], np.append(number, np.int32(len(encoded))), np.append(count, np.int32(1))
        order = np.insert(coded.indices.to_numpy(), bounds[1:], len(count) - 1)
        units, ends = spread(number, count, order)
        table = np.frombuffer(b"".join(encoded), dtype="<u4")
        ids, upto = spread(table, np.array(list(map(len, encoded)), dtype=np.int32) // 4, units)
        return ids, upto[ends[bounds + np.arange(len(bounds))]]


def spread(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values``, of these sizes, in the given order, and where each starts and the last ends."""
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    n = sizes[order]
    upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    return values[np.repeat((starts[order] - upto[:-1]).astype(np.int32), n) + np.arange(upto[-1], dtype=np.int32)], upto


_loaded: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    if path not in _loaded:
        _loaded[path] = WordCache(path)
    return _loaded[path]


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of up to so many bytes of text, or one row."""
    size = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def encoded_rows(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in ascending order with ``part``, ``part_start``, ``n_tokens`` and ``ids``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select("doc_id", "text")
    ending = b"" if end_id is None else end_id.to_bytes(4, "little")
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("part int, part_start bigint, n_tokens bigint, ids array<int>").fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, before, part = word_cache(tokenizer_path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                ids, ends = cache.encode(some.column(1), ending)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(some.num_rows, part), pa.int32()), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), lists], names)
                before += int(ends[-1])

    return rows.mapInArrow(run, schema)


def write(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    *,
    end_id: int | None = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2000,
    codec: str = "zstd",
) -> None:
    """Write ``docs`` as token files at ``path``."""
    writer = encoded_rows(docs, tokenizer_path, end_id, id_col, text_col).write
    options = {
        "compression": codec,
        "parquet.compression.codec.zstd.level": 1,
        "parquet.writer.version": "v2",  # delta encoding where there is no dictionary
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part_start", "n_tokens")},
    }
    writer.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the token files at ``path``: doc_id, start, n_tokens, ids."""
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint")).alias("offset"))
    # one row per part file, which a reader's driver lists in any case
    return files.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids")
