"""SimHash near-duplicates with bit-sliced comparison.

``fingerprints`` gives each text 64 bits: bit k is set if it is set in over half of the
XXH64 hashes (seed 42) of its 4-word shingles, repeats included.

``links`` finds all pairs of distinct fingerprints within the radius.  The 64 bits are cut
into ``blocks`` blocks; two fingerprints that differ in ``radius`` bits agree on at least
``blocks - radius`` of them, so each choice of that many blocks gives a key under which
close fingerprints meet, none being missed.  The number of blocks follows the number of
fingerprints, so that keys stay longer than its logarithm and buckets stay small.
Within a sorted run of keys the fingerprints of 64 neighbours form a word per bit plane.
A fingerprint is compared with all lanes of a word at once: plane by plane the differing
lanes are added into carry-save bitwise counters, and a word is abandoned as soon as all
its lanes exceed the radius.  A bucket of any size is searched in full; in long ones what
is reached is compared with what is not yet.  One of more than BUCKET fingerprints is dealt
into pieces, and each two pieces meet in a task of their own, so no task holds more than
about two pieces whatever the bucket's size.

Equal fingerprints are one node, so copies cost nothing here; the component of a node is
found by star steps over the linked nodes only, and documents join their node's component.

Defined cases: null or empty text has no shingles and fingerprint zero, which is linked
like any other; a very long text is read whole; repeated rows and equal texts share a component; null ids never become a
component's name unless no other id is in it; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._shared import small, written
from quillspark.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
LANES = 64
#: Fingerprints of a bucket that one task searches; larger buckets are dealt into pieces.
BUCKET = 1 << 17
#: Longer runs are searched breadth first.
LONG_RUN = 256
EDGES = "a bigint, b bigint"
#: Comparisons of a fingerprint with a word of lanes that are held at once.
AT_ONCE = 1 << 18
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        grams = [joined[starts[i] : ends[i + shingle - 1] - 1] for i in range(len(words) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    return majority(shingle_hashes(text, shingle))


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another hash from each hash (the finalizer of a known 64-bit generator)."""
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """A fingerprint of ``words`` times 64 bits, from as many hashes of each shingle."""
    return b"".join(majority(remixed(hashes, k)).to_bytes(8, "little") for k in range(words))


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed 64-bit integer."""
    source = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("fp", T.LongType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t) for t in part.column(len(keep)).to_pylist()], dtype=np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps)], names)

    return source.mapInArrow(run, schema)


def keys_for(n: int, radius: int = RADIUS) -> list[int]:
    """The masks of bits that make up each key, for ``n`` fingerprints.

    As many blocks as give keys of more bits than log2(n), so a bucket holds a handful of
    unrelated fingerprints whatever their number.
    """
    blocks = radius + 1
    while blocks < 12 and (blocks - radius) * 64 // blocks < math.log2(max(n, 2)):
        blocks += 1
    ends = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(ends)]
    return [sum(parts[k] for k in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """planes[b][w]: bit b of the fingerprints 64 w to 64 w + 63, one per lane; a fingerprint is a row of words."""
    lanes = -(-len(fps) // LANES)
    padded = np.zeros((lanes * LANES, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return packed.view(np.uint64).reshape(64 * fps.shape[1], lanes)


def close_lanes(planes: np.ndarray, query: np.ndarray, word: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each comparison of a fingerprint with a word's ``wanted`` lanes: the lanes within the radius.

    Counters of as many bit slices as the radius has hold the differences per lane;
    ``beyond`` gathers the lanes that exceed it.  Returns the comparisons left and their lanes.
    """
    slices = max(1, radius.bit_length())
    counters = [np.zeros(len(query), np.uint64) for _ in range(slices)]
    beyond, left = ~wanted, np.arange(len(query))
    for b in range(len(planes)):
        flip = (np.uint64(0) - (query[:, b // 64] >> np.uint64(b % 64) & np.uint64(1))).astype(np.uint64)
        carry = planes[b][word] ^ flip
        for k in range(slices):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        beyond |= carry | exceeds(counters, radius)
        if b % 4 == 3:
            alive = ~beyond != 0
            if not alive.all():
                left, query, word, beyond = left[alive], query[alive], word[alive], beyond[alive]
                counters = [c[alive] for c in counters]
            if not len(left):
                break
    return left, ~beyond


def exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than the radius, compared from the highest slice down."""
    larger, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            larger |= equal & counters[k]
            equal &= ~counters[k]
    return larger


def links_of_runs(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of distinct fingerprints among those with equal keys; ``keys`` is sorted."""
    if len(fps) < 2:
        return
    fps = fps.reshape(len(fps), -1)
    planes = bit_planes(fps)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.repeat(np.append(new[1:], len(fps)), np.diff(np.append(new, len(fps))))
    rows = np.flatnonzero(np.arange(len(fps)) + 1 < ends)  # those with a later one in their run
    first, last = (rows + 1) // LANES, (ends[rows] - 1) // LANES
    spans = last - first + 1
    at = 0
    cumulative = np.cumsum(spans)
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(cumulative, (cumulative[at - 1] if at else 0) + AT_ONCE, side="right")))
        for lo in range(0, int(spans[at]) if upto == at + 1 else 1, AT_ONCE):
            some, n = rows[at:upto], spans[at:upto]
            if upto == at + 1:
                n = np.minimum(n - lo, AT_ONCE)
            query = np.repeat(some, n)
            word = np.repeat(first[at:upto] + lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            from_lane = np.clip(query + 1 - word * LANES, 0, LANES).astype(np.uint64)
            to_lane = np.clip(ends[query] - word * LANES, 0, LANES).astype(np.uint64)
            wanted = below(to_lane) & ~below(from_lane)
            left, lanes = close_lanes(planes, fps[query], word, wanted, radius)
            while len(left):
                lowest = lanes & (np.uint64(0) - lanes)
                other = word[left] * LANES + np.bitwise_count(lowest - np.uint64(1))
                yield query[left], other
                lanes = lanes ^ lowest
                more = lanes != 0
                left, lanes = left[more], lanes[more]
        at = upto


def below(n: np.ndarray) -> np.ndarray:
    """Words with the lowest n bits set, n from 0 to 64."""
    full = n >= np.uint64(64)
    return np.where(full, ~np.uint64(0), (np.uint64(1) << np.where(full, np.uint64(0), n)) - np.uint64(1))


def trees_of_run(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what all close pairs of one run connect, without listing these.

    Breadth first: what is reached is compared with what is not yet, which a large group of
    near copies soon leaves small, so the work does not grow with the square of the group.
    """
    fps = fps.reshape(len(fps), -1)
    rest = np.arange(len(fps))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            planes, lanes = bit_planes(fps[rest]), -(-len(rest) // LANES)
            last = below(np.array([len(rest) - (lanes - 1) * LANES], np.uint64))[0]
            parent = np.full(len(rest), -1)
            step = max(1, AT_ONCE // lanes)
            for at in range(0, len(front), step):
                some = front[at : at + step]
                query, word = np.repeat(some, lanes), np.tile(np.arange(lanes), len(some))
                wanted = np.where(word == lanes - 1, last, ~np.uint64(0))
                left, close = close_lanes(planes, fps[query], word, wanted, radius)
                bits = np.unpackbits(np.ascontiguousarray(close).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, lane = np.nonzero(bits)
                parent[word[left[which]] * LANES + lane] = query[left[which]]
            found = parent >= 0
            yield parent[found], rest[found]
            front, rest = rest[found], rest[~found]


def trees(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows to link so that within each run of equal keys the same rows are connected as by all close pairs."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(keys)))
    for start, size in zip(new[sizes > LONG_RUN].tolist(), sizes[sizes > LONG_RUN].tolist(), strict=True):
        for x, y in trees_of_run(fps[start : start + size], radius):
            yield start + x, start + y
    short = np.flatnonzero(np.repeat(sizes <= LONG_RUN, sizes))
    for x, y in links_of_runs(keys[short], fps[short], radius):
        yield short[x], short[y]


def runs_of(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Sorted batches, whose first column is the key, in pieces that cut no run: the keys and the columns."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < least:
                continue
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_numpy()
        done = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
        if done:
            yield keys[:done], [c.chunk(0) for c in table.slice(0, done).combine_chunks().columns]
        held = table.slice(done).to_batches()
        least = max(least, 2 * sum(b.num_rows for b in held))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct values of column ``fp``, with the same components as all pairs within the radius."""
    spark = nodes.sparkSession
    masks = [m - (1 << 64) if m >> 63 else m for m in keys_for(nodes.count(), radius)]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("key_no", "mask"))
    keyed = keyed.select("fp", F.xxhash64("key_no", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    keyed = dealt(keyed)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = keyed.repartition(parts, "key").sortWithinPartitions("key", "fp")
    runs = runs.select("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, (_, prints) in runs_of(batches):
            fps = prints.to_numpy()
            yield from edges(fps, trees(keys, fps.astype(np.uint64), radius))

    return runs.mapInArrow(run, EDGES).distinct()


def dealt(keyed: DataFrame) -> DataFrame:
    """``keyed`` (fp, key), where each two pieces of a bucket of more than BUCKET rows have a key of their own."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    hot = written(sizes.select(F.col("key").alias("hot_key"), F.ceil(F.col("n") / BUCKET).alias("pieces")), "hot_buckets")
    if hot.isEmpty():
        return keyed
    rows = keyed.join(small(hot), F.col("key") == F.col("hot_key"), "left")
    return rows.filter("hot_key is null").select("fp", "key").union(paired(rows.filter("hot_key is not null"), "fp").select("fp", "key"))


def paired(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (``value``, key, pieces of two or more) once for each two pieces of a key that the row's own is one of, under a key of these two."""
    own = F.pmod(F.xxhash64(F.lit(3), value), F.col("pieces")).alias("own")
    each = rows.select("*", own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("other")).filter("own <> other")
    return each.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))


def edges(nodes: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for x, y in found:
        yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest id that links lead to."""
    prints = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"]), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, radius), "simhash")
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(grouped, "groups")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "root").select(F.col("fp").alias("n_fp"), "component_id")
    return prints.join(by_fp, F.col("fp") == F.col("n_fp")).select("doc_id", "fp", "component_id")


#: Of ``representatives``: words per shingle, 64-bit words per fingerprint, and the least
#: similarity (shared among all shingles of two texts).
WIDE_SHINGLE, WIDE_WORDS, SIMILARITY = 5, 4, 0.8
#: Shingles are taken in rounds by their lowest byte, which end below these values.
KEY_ROUNDS = (4, 32, 256)
#: Candidates differ in at most so many standard deviations more bits than expected at SIMILARITY.
DEVIATIONS = 6
#: Bytes of shingles that one task compares; larger groups of candidates are dealt into pieces.
GROUP_BYTES = 1 << 26
#: Common shingles, which prefixes take last: counted in one of so many documents, those with a least count, at most so many.
SAMPLED, COMMON_LEAST, COMMON_MOST = 32, 4, 200_000


def wide_radius(similarity: float = SIMILARITY, words: int = WIDE_WORDS) -> int:
    """Differing bits expected of two texts of equal length and this similarity."""
    angle = math.acos(2 * similarity / (1 + similarity))
    return round(64 * words * angle / math.pi)


def candidate_radius(similarity: float = SIMILARITY, words: int = WIDE_WORDS) -> int:
    """Differing bits that candidates may have: texts of SIMILARITY have more in less than one of 10,000 cases."""
    expected = wide_radius(similarity, words) / (64 * words)
    return math.ceil(64 * words * expected + DEVIATIONS * math.sqrt(64 * words * expected * (1 - expected)))


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    return np.unique(shingle_hashes(text, WIDE_SHINGLE))


def common_shingles(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that are common in a sample of documents, and their ranks from the rarest, from 1.

    Only the order in which prefixes take shingles depends on it, not what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], ["shingle"])

    sample = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SAMPLED)) == 0).select(text_col)
    counts = sample.mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_LEAST)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).toPandas()
    hashes = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(hashes) - order


def prefix(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which sets of SIMILARITY or more share at least one.

    Such sets share at least SIMILARITY of each, so of the first of both, in one order for
    all sets, one is shared if these leave less than that share.
    """
    if not len(hashes):
        return hashes
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, ranks[at], 0)
    needed = math.ceil(round(SIMILARITY * len(hashes), 6))
    return hashes[np.lexsort((hashes, rank))[: len(hashes) - needed + 1]]


def wide_prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (its key), node (of the set of shingles), fp and prefix of each document."""
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.col(text_col).alias("__text"))
    made = [T.StructField("node", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("prefix", T.BinaryType())]
    schema = T.StructType([*source.schema.fields[:-1], *made])
    names = [f.name for f in schema]
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                nodes, fps, prefixes = [], [], []
                for text in part.column(2).to_pylist():
                    hashes = shingle_set(text)
                    nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                    fps.append(wide_fingerprint(hashes, WIDE_WORDS))
                    prefixes.append(prefix(hashes, *held.value).tobytes())
                node = pa.array(np.array(nodes, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], node, pa.array(fps, pa.binary()), pa.array(prefixes, pa.binary())], names)

    return source.mapInArrow(run, schema)


def wide_links(nodes: DataFrame, low: int, high: int) -> DataFrame:
    """Links (a, b) between the labels of ``nodes`` (node, fp, prefix, label) that meet in a shingle and are within the radius of candidates.

    Shingles are those of the prefix whose lowest byte is from ``low`` to below ``high``.
    """
    spark = nodes.sparkSession
    radius, parts = candidate_radius(), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column(1).to_pylist()
                key = np.frombuffer(b"".join(raw), np.uint64)
                node = np.repeat(part.column(0).to_numpy(), [len(r) // 8 for r in raw])
                place = key & np.uint64(255)
                taken = (place >= np.uint64(low)) & (place < np.uint64(high))
                yield pa.RecordBatch.from_arrays([pa.array(key[taken].view(np.int64)), pa.array(node[taken])], ["key", "node"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (_, node) in runs_of(batches):
            same = key[1:] == key[:-1]
            kept = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), node.filter(pa.array(kept))], ["key", "node"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (_, label, fp) in runs_of(batches):
            fps, labels = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(key), -1), label.to_numpy()
            for x, y in trees(key, fps, radius):
                apart = labels[x] != labels[y]
                yield from edges(labels, [(x[apart], y[apart])])

    keyed = nodes.select("node", "prefix").mapInArrow(keys, "key bigint, node bigint")
    buckets = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(met, "key bigint, node bigint")
    full = buckets.join(nodes.drop("prefix"), "node").select("key", "label", "fp")
    # the smallest label of a bucket comes first: trees under different keys share their links to it
    return full.repartition(parts, "key").sortWithinPartitions("key", "label").mapInArrow(linked, EDGES).distinct()


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set the number of the first one that links of SIMILARITY or more lead to, by exact counts of shared members."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    label, marked = np.arange(len(sets)), np.zeros(len(flat) + 1, bool)
    rest = np.arange(len(sets))
    # the members of the sets that are not reached yet, one set after the other
    members = flat
    while len(rest) > 1:
        first, front = rest[0], [rest[0]]
        members, rest = members[sizes[first] :], rest[1:]
        while front and len(rest):
            x = front.pop()
            own = flat[ends[x] - sizes[x] : ends[x]]
            marked[own] = True
            shared = np.add.reduceat(marked[members].astype(np.int64), np.cumsum(sizes[rest]) - sizes[rest])
            marked[own] = False
            close = shared >= SIMILARITY * (sizes[rest] + sizes[x] - shared) - 1e-9
            if close.any():
                found = rest[close]
                label[found] = first
                members, rest = members[~np.repeat(close, sizes[rest])], rest[~close]
                front.extend(found.tolist())
    return label


def verified(candidates: DataFrame) -> DataFrame:
    """node and label, one for what links of SIMILARITY or more connect, of ``candidates`` (root, node, text, pieces): links are looked for within a root.

    A root of several pieces is searched two pieces at a time; what these connect is then
    connected by star steps.
    """
    spark = candidates.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [shingle_set(t).tobytes() for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(made, pa.binary())], ["key", "node", "pieces", "set"])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, (_, node, shingles) in runs_of(batches, 1 << 12):
            nodes, starts = node.to_numpy(), np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
            for a, b in itertools.pairwise([*starts.tolist(), len(root)]):
                label = similar([np.frombuffer(s.as_buffer(), np.uint64) for s in shingles[a:b]])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a:b]), pa.array(nodes[a + label])], ["node", "label"])

    several = not candidates.filter("pieces > 1").isEmpty()
    made = candidates.select(F.col("root").alias("key"), "node", "pieces", "text").mapInArrow(sets, "key bigint, node bigint, pieces bigint, set binary")
    if several:
        made = made.filter("pieces = 1").unionByName(paired(made.filter("pieces > 1"), "node").select("key", "node", "pieces", "set"))
    found = made.select("key", "node", "set").repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(labelled, "node bigint, label bigint")
    if not several:
        return found
    found = written(found, "wide_pieces")
    roots = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")), "wide_pieces").select(F.col("node").alias("r_node"), "root")
    return found.select("node").distinct().join(roots, F.col("node") == F.col("r_node"), "left").select("node", F.coalesce("root", "node").alias("label"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near duplicates the row of the smallest id, with all its columns.

    Groups are the components of links between texts whose sets of WIDE_SHINGLE-word
    shingles have a Jaccard similarity of SIMILARITY or more.  Candidates share a shingle of
    their prefixes, which all such pairs do, and their fingerprints of WIDE_WORDS words lie
    within ``candidate_radius``; what candidates connect is then searched with exact counts
    of shared shingles.  Null and wordless texts have equal (empty) sets and are one group.
    """
    prints = written(wide_prints(docs, id_col, text_col), "wide_prints")
    alike = prints.groupBy("node").agg(F.min(F.struct("row", "fp", "prefix")).alias("first"))
    nodes = written(alike.select("node", "first.row", "first.fp", "first.prefix"), "wide_nodes")
    # a few shingles connect most of a large group, whose links under the others are then none between labels
    labels = nodes.select("node", "fp", "prefix", F.col("node").alias("label"))
    for k, (low, high) in enumerate(itertools.pairwise([0, *KEY_ROUNDS])):
        roots = components(wide_links(labels, low, high), f"wide-{k}")
        moved = labels.join(roots.select(F.col("node").alias("r_node"), "root"), F.col("label") == F.col("r_node"), "left")
        labels = written(moved.select("node", "fp", "prefix", F.coalesce("root", "label").alias("label")), f"wide_labels-{k}")
    # a prefix has one in five of a text's shingles
    amount = F.sum(F.octet_length("prefix") / (1 - SIMILARITY) + 8)
    several = labels.groupBy(F.col("label").alias("root")).agg(F.count("*").alias("n"), F.ceil(amount / GROUP_BYTES).alias("pieces")).filter("n > 1").drop("n")
    leaders = nodes.select("node", "row").join(labels.select("node", F.col("label").alias("root")), "node").join(several, "root")
    texts = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("t_row"), F.col(text_col).alias("text"))
    leaders = written(leaders, "wide_leaders")
    exact = verified(leaders.join(texts, F.col("row") == F.col("t_row")).select("root", "node", "text", "pieces"))
    # rows of one id and text give a node more than once, with one label
    exact = written(exact.groupBy(F.col("node").alias("v_node")).agg(F.min("label").alias("label")), "wide_groups")
    named = prints.select("doc_id", "row", "node").join(exact, F.col("node") == F.col("v_node"), "left").select("doc_id", "row", F.coalesce("label", "node").alias("label"))
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias("__kept_row"))
    names = docs.columns
    numbered = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], F.xxhash64(F.col(id_col), F.col(text_col)).alias("__row"))
    joined = numbered.join(kept, F.col("__row") == F.col("__kept_row"))
    # rows of one id and text are one document
    one = joined.withColumn("__n", F.row_number().over(Window.partitionBy("__kept_row").orderBy(F.lit(0)))).filter("__n = 1")
    return one.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
