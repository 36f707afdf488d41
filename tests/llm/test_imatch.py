import hashlib
import random
import re
import struct
from collections import Counter

import xxhash

from quillspark.llm import imatch, op7
from quillspark.llm.op7 import imatch_rows, op7_imatch


def made(n, seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfg" for b in range(600)]
    return [" ".join(rnd.choices(words, k=rnd.choice([5, 40, 200]))) for _ in range(n)]


def test_edits_and_likeness(spark, tmp_path):
    texts = made(120, 1) + [None, "", "x", "éé🙂", made(1, 9)[0] * 40]
    ids = random.Random(2).sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True)) + [(20_000, texts[0])]
    spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op7_imatch(spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == t:
            assert got[i].near_edited == 1.0
    assert got[20_000].fingerprint == got[ids[0]].fingerprint
    mean = lambda c: sum(getattr(r, c) for r in got.values()) / len(got)
    assert mean("near_edited") > 0.1 > 0.05 > mean("near_next")


def test_lexicon_band_and_subsets(spark):
    docs = spark.createDataFrame([(k, " ".join(["every", f"one{k}"] + (["some"] if k % 2 else []) + (["pair"] if k < 2 else []))) for k in range(100)], "doc_id long, text string")
    lexicon = imatch.lexicon(docs, low=0.3, high=0.6)
    assert lexicon.count() == 1
    table = imatch.lexicon_table(lexicon)
    kept = docs.select("doc_id", imatch.F.size(imatch.held(imatch.terms(imatch.F.col("text")), table)).alias("n")).collect()
    assert all(r.n == r.doc_id % 2 for r in kept)


def test_lexicon_is_exact(spark):
    rows = spark.range(20_000).select("id", imatch.F.xxhash64("id").alias("term"))
    table = imatch.lexicon_table(rows.filter("id < 10000"))
    found = rows.select("id", table.has(imatch.F.col("term")).alias("in")).collect()
    assert all(r["in"] == (r.id < 10_000) for r in found)
    for bits in (6, 30):  # beyond 21 bits further hashes name the slots
        slots = spark.range(50).select(*[imatch.slot(imatch.F.xxhash64("id"), k, bits).alias(f"s{k}") for k in range(imatch.PROBES)]).collect()
        assert all(0 <= x < 1 << bits for r in slots for x in r) and len({tuple(r) for r in slots}) > 40


def brute(texts):
    """Hashes of each text by the definition."""
    step = lambda seed, data: xxhash.xxh64_intdigest(data, seed)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    first = step(42, struct.pack("<i", imatch.SEED))

    def terms(text):
        return {signed(step(first, w.encode())) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())}

    def digest(found):
        seed = 42
        for t in sorted(found):
            seed = step(seed, struct.pack("<q", t))
        return signed(seed)

    df = Counter(t for x in texts for t in terms(x))
    lexicon = {t for t, n in df.items() if max(imatch.LEAST, imatch.LOW * len(texts)) <= n <= max(imatch.LEAST, imatch.HIGH * len(texts))}

    def hashes(text):
        own = terms(text) & lexicon
        if not own:
            return [digest(terms(text))] + [0] * (imatch.COPIES * imatch.LEVELS)
        out = [digest(own)]
        for copy in range(imatch.COPIES):
            left = own
            for level in range(imatch.LEVELS):
                left = {t for t in left if t >> level + copy * imatch.LEVELS & 1 == 0}
                out.append(digest(left) if left else 0)
        return out

    return hashes


def likeness(a, b):
    if a == b:
        return 1.0
    votes = []
    for copy in range(imatch.COPIES):
        at = range(1 + copy * imatch.LEVELS, 1 + (copy + 1) * imatch.LEVELS)
        either = [k for k in at if a[k] or b[k]]
        votes += [a[either[-1]] == b[either[-1]]] if either else []
    return sum(votes) / len(votes) if votes else 0.0


def test_query_equals_brute_force(spark):
    texts = [*made(90, 3), None, "", "x", "b1 c2", "B1, c2!", "éé b7 Éé"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "b9 c9 d9"), (None, "b9 c8"), (None, None)]
    hashes = brute([t for _, t in rows])
    printed = lambda h: "".join(f"{x & 0xFFFFFFFF:08x}" for x in h)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for ranges in (32_000_000, 3000):
        op7.RANGE_CHARS = ranges
        got = {r.doc_id: r for r in imatch_rows(docs).collect() if r.doc_id is not None}
        assert len(got) == len(texts)
        for k in range(1, len(texts)):
            own, after = texts[k] or "", texts[k - 1] or ""
            edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
            assert got[k].fingerprint == printed(hashes(own)) and got[k].edited_fingerprint == printed(hashes(edited))
            assert abs(got[k].near_edited - likeness(hashes(own), hashes(edited))) < 1e-9 and abs(got[k].near_next - likeness(hashes(own), hashes(after))) < 1e-9
    op7.RANGE_CHARS = 32_000_000


def test_equal_and_null_ids_are_dealt_over_ranges(spark):
    rows = [(None if k % 2 else 5, f"word{k} other{k}") for k in range(400)] + [(k, "x") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranged = op7.with_range(docs, 16).groupBy("range").count().collect()
    assert len(ranged) >= 12 and max(r["count"] for r in ranged) < 120
    got = imatch_rows(docs).collect()
    assert len(got) == len(rows)
    assert len({r.edited_sha256 for r in got}) > 390  # each has a next document of its own


def test_word_order_case_and_repeats_do_not_matter(spark):
    rows = [(1, "b1 c2 d3 e4"), (2, "D3 c2, b1 e4 e4!"), (3, "b1 c2 d3 x9"), (4, None), (5, "")] + [(10 + k, "b1 c2 d3 e4 x9 y" + str(k)) for k in range(4)]
    got = {r.doc_id: r.hashes for r in imatch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5]


def test_small_tables_ties_and_nulls(spark):
    docs = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert [r.near_next for r in imatch_rows(docs).collect()] == [1.0]
    assert imatch_rows(docs.limit(0)).count() == 0
    docs = spark.createDataFrame([(None, "abcd"), (1, "xyzw"), (1, "xyzw"), (1, "other"), (None, None)], "doc_id long, text string")
    assert imatch_rows(docs).count() == 5
