import random

import numpy as np
import xxhash
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import simhash
from quillspark.llm.components import components
from quillspark.llm.op6 import op6_simhash


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=60), st.text("aB c\n\x85é\x0b", max_size=60)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1)), min_size=2, max_size=200), st.integers(0, 6), st.randoms())
def test_bit_sliced_pairs_equal_popcount(rows, radius, rnd):
    near = [(k, f ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) & (2**64 - 1)) for k, f in rows]
    rows = sorted(set(rows + near))
    keys, fps = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.uint64)
    got = {(int(a), int(b)) for x, y in simhash.links_of_runs(keys, fps, radius) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if keys[i] == keys[j] and bin(rows[i][1] ^ rows[j][1]).count("1") <= radius}
    assert got == want


def joined(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3), st.integers(0, 12))
def test_trees_connect_like_all_pairs(seed, words, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, (4, words), dtype=np.uint64)
    fps = base[rng.integers(0, 4, 300)].copy()
    for row in fps:
        for b in rng.integers(0, 64 * words, rng.integers(0, 8)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    keys = np.sort(rng.integers(0, 3, 300))
    near = [(i, j) for i in range(300) for j in range(i) if keys[i] == keys[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius]
    for long_run in (5, 1000):
        old, simhash.LONG_RUN = simhash.LONG_RUN, long_run
        got = [(a, b) for x, y in simhash.trees(keys, fps, radius) for a, b in zip(x, y, strict=True)]
        simhash.LONG_RUN = old
        assert joined(300, got) == joined(300, near)


def test_representatives(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(2000)]
    rows, groups = [], []
    for g in range(60):
        text = rnd.choices(words, k=300)
        members = []
        for c in range(rnd.choice([1, 1, 2, 5])):
            t = list(text)
            for _ in range(0 if c == 0 else rnd.randrange(5)):
                t[rnd.randrange(300)] = "new"
            members.append((1000 - len(rows), " ".join(t), "x", None))
            rows.append(members[-1])
        groups.append(members)
    half = rnd.choices(words, k=300)
    apart = [(2000, " ".join(half + rnd.choices(words, k=300)), "x", 1), (2001, " ".join(half + rnd.choices(words, k=300)), "x", 2)]
    odd = [(3000, None, "x", 1), (3001, "", "x", 2), (3002, "", "x", 3), (3003, "one two", "x", 4), (3004, "ONE two", "x", 5), (rows[0][0], rows[0][1], "x", None)]
    docs = spark.createDataFrame(rows + apart + odd, "doc_id long, text string, fp string, node int")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted([min(m[0] for m in g) for g in groups] + [2000, 2001, 3000, 3003])
    assert simhash.representatives(docs.limit(0)).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("group_bytes", [1 << 26, 2000])
def test_representatives_equal_brute_force_around_the_threshold(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(simhash, "GROUP_BYTES", group_bytes)
    rnd = random.Random(21)
    words, rows = [f"w{k}" for k in range(3000)], []
    for g in range(250):
        text = rnd.choices(words, k=rnd.choice([9, 15, 60, 200, 400]))
        rows.append(" ".join(text))
        # a tail of other words: similarities from 0.7 to 0.95
        tail = round(len(text) * (1 / rnd.uniform(0.7, 0.95) - 1))
        rows.append(" ".join(text + rnd.choices(words, k=tail)))
        # both ends changed
        cut = max(1, round(len(text) * rnd.uniform(0.02, 0.16)))
        rows.append(" ".join(text[cut:] + rnd.choices(words, k=cut)))
        # a repeated passage adds hardly a shingle
        rows.append(" ".join(text + text[:50] * (g % 3)))
    sets = [shingles(t) for t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] & sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = sorted(set(joined(len(rows), near)))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == want


def test_similar_sets_equal_brute_force():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 2**63, 40).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([rng.choice(b, rng.integers(33, 41), replace=False), rng.integers(0, 2**63, rng.integers(0, 5)).astype(np.uint64)])) for b in base * 8]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert simhash.similar(sets).tolist() == joined(len(sets), near)


def test_large_bucket_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 3)
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 40, 700).astype(np.uint64) ** np.uint64(5))
    got = sum(len(x) for x, _ in simhash.links_of_runs(np.zeros(len(fps), int), fps, 4))
    assert got == sum(int(np.bitwise_count(a ^ b)) <= 4 for i, a in enumerate(fps) for b in fps[:i])


def test_keys_miss_no_pair():
    for n in (2, 10**5, 10**7, 10**10):
        masks = simhash.keys_for(n)
        rnd = random.Random(n)
        for _ in range(500):
            diff = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not m & diff for m in masks)


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(5)
    ids = list(range(1, 400))
    rnd.shuffle(ids)
    path, star, ring = ids[:150], ids[150:300], ids[300:]
    edges = list(zip(path, path[1:])) + [(star[0], x) for x in star[1:]] + list(zip(ring, [*ring[1:], ring[0]])) + [(7000, 7000), (8000, 8001), (8001, 8000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: min(g) for g in (path, star, ring, [8000, 8001]) for x in g}


@pytest.mark.parametrize("bucket", [1 << 17, 3])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.choice([3, 60, 150, 400]))) for _ in range(40)]
    texts = list(base)
    for t in base:
        for _ in range(rnd.randrange(5)):
            w = t.split()
            w[rnd.randrange(len(w))] = "changed"
            texts.append(rnd.choice([t, " ".join(w), t.upper(), t + " tail"]))
    texts += [None, "", " \n", "one", "ONE", "very long " * 30_000] + ["same text for many rows"] * 30
    rnd.shuffle(texts)
    rows = [(100 + k, t, "x") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash(spark, str(tmp_path)).collect()}
    prints = [brute_print(t) for t in texts]
    assert got == {100 + k: (f"{p:016x}", 100 + g) for k, (p, g) in enumerate(zip(prints, brute_groups(prints), strict=True))}


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "a b"), (None, "c"), (5, "a b")], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())))
    assert got == sorted(map(str, [(None, 5), (5, 5), (5, 5), (None, None)]))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
