"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into pre-tokens; the bytes of a pre-token are the leaves' symbols.
Leaf *i* of the tree holds the rank of the pair that starts at symbol *i*, an
inner node the smaller of its children with the left one winning ties, so the
root names the leftmost pair of the lowest rank.  A merge changes at most three
leaves, each a logarithmic update, until no mergeable pair remains: a pre-token
of n bytes costs O(n log n) whatever its length.

Encoded pre-tokens and chunks between spaces are remembered in bounded tables per
Python worker, which changes the time and never the result.

Defined cases: a null text counts as empty; an empty text has no ids and decodes
to the empty text; a very long text or pre-token is encoded whole; rows are kept one to one, repeated ones too; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The byte-level pre-token pattern (fixed value, equal to the tokenizer's).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: From here on the Unicode versions of two libraries may differ; such texts are cut by the tokenizer's own pre-tokenizer.
LATE = regex.compile(r"[^\u0000-ӿ]")
#: A space that always begins a pre-token: between two characters that no definition counts as white space; and signs of others.
BREAK = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
OTHER = regex.compile(r"^ | $|[\s\x1c-\x1f] | [\s\x1c-\x1f]")
#: Pre-tokens, and chunks of text between spaces, that a worker remembers per generation, and the longest of them.
PIECES, CHUNKS, LONGEST = 500_000, 300_000, 64
NO_PAIR = 1 << 62


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def merge_all(symbols: list[int], pair_ranks: dict[int, int]) -> list[int]:
    """Merge ``symbols`` until no pair is mergeable.

    ``pair_ranks`` maps ``left << 32 | right`` to ``rank << 32 | merged``.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NO_PAIR] * (2 * width)
    get = pair_ranks.get
    for i in range(n - 1):
        tree[width + i] = get(symbols[i] << 32 | symbols[i + 1], NO_PAIR)
    for k in range(width - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left <= right else right
    if tree[1] == NO_PAIR:
        return symbols
    symbols = symbols[:]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]

    def put(leaf: int, value: int) -> None:
        k = width + leaf
        tree[k] = value
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            best = left if left <= right else right
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1

    while (best := tree[1]) != NO_PAIR:
        k = 1
        while k < width:  # equal values: the left child first
            k = 2 * k if tree[2 * k] == best else 2 * k + 1
        i = k - width
        j = after[i]
        symbols[i] = best & 0xFFFFFFFF
        follow = after[i] = after[j]
        put(j, NO_PAIR) if j < n - 1 else None
        if follow >= 0:
            before[follow] = i
            put(i, get(symbols[i] << 32 | symbols[follow], NO_PAIR))
        else:
            put(i, NO_PAIR)
        if (h := before[i]) >= 0:
            put(h, get(symbols[h] << 32 | symbols[i], NO_PAIR))
    out, i = [], 0
    while i >= 0:
        out.append(symbols[i])
        i = after[i]
    return out


class Remembered(dict):
    """key -> ids as little-endian bytes, for up to twice ``most`` keys of up to LONGEST characters.

    When ``most`` keys are in, they become the old generation and replace the one
    before; a key found there moves back, so frequent keys stay.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST:
            return self.encode(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.encode(key)
        self[key] = got
        return got


class ByteBpe:
    """A byte-level BPE read from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.first = [vocab[letters[b]] for b in range(256)]
        self.pair_ranks: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pair_ranks.setdefault(vocab[left] << 32 | vocab[right], rank << 32 | vocab[left + right])
        back = {c: b for b, c in letters.items()}
        self.token_bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: s.encode() for s, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.cut_late = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.pieces = Remembered(self.encode_piece, PIECES)
        self.chunks = Remembered(self.encode_chunk, CHUNKS)

    def encode_piece(self, piece: str) -> bytes:
        first = self.first
        return array("I", merge_all([first[b] for b in piece.encode()], self.pair_ranks)).tobytes()

    def cut(self, text: str) -> list[str]:
        if LATE.search(text):
            return [text[a:b] for _, (a, b) in self.cut_late(text)]
        return self.words.findall(text)

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def encode_chunk(self, chunk: str) -> bytes:
        return self.encode_plain(f" {chunk}")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A space between two characters that are no white space always begins a pre-token, so
        a text is the sequence of its chunks between such spaces.  Beside other white space
        it may not: it then stays inside its chunk.
        """
        if self.special is not None and any(s in text for s in self.added):
            parts = self.special.split(text)
            return b"".join(self.added[p].to_bytes(4, "little") if p in self.added else self.encode_plain(p) for p in parts if p)
        first, *rest = BREAK.split(text) if OTHER.search(text) else text.split(" ")
        return self.encode_plain(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, numbers)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def id_list(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)], dtype=np.int64)
    values = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(values)).cast(pa.list_(pa.int32()))


def round_trip_batches(batches: Iterator[pa.RecordBatch], path: str, text: int, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[str]]]:
    """For each slice of a batch: the slice, the ids of its texts, and the texts that these decode to."""
    bpe = tokenizer(path)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            encoded = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
            yield part, encoded, [bpe.decode(e) for e in encoded]


def encode_decode(
    docs: DataFrame,
    path: str,
    *,
    keep: list[str] = ("doc_id",),
    text_col: str = "text",
    schema: str | None = None,
    finish: Callable[[list[bytes], list[str]], list[pa.Array]] | None = None,
) -> DataFrame:
    """Encode each text and decode the ids again.

    The result has the columns ``keep`` and then ``ids`` (array<int>) and ``decoded``
    (string).  With ``finish``, which makes Arrow columns from the ids and the decoded
    texts, the columns named in ``schema`` stand in their place, so that digests need
    not carry the ids out of the Python worker.
    """
    made = T._parse_datatype_string(schema) if schema else T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    finish = finish or (lambda encoded, decoded: [id_list(encoded), pa.array(decoded, pa.string())])
    keep = list(keep)
    source = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    out = T.StructType([*source.schema.fields[:-1], *made.fields])
    names = [f.name for f in out]

    def run(batches):
        for part, encoded, decoded in round_trip_batches(batches, path, len(keep)):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *finish(encoded, decoded)], names)

    return source.mapInArrow(run, out)
