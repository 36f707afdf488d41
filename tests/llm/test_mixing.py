import random
from collections import defaultdict

import pytest

from quillspark.llm import mixing
from quillspark.llm.op2 import op2_source_mix


def brute_targets(sizes, weights):
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = [s for s in sizes if s not in full]
        share = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        above = {s for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in full else share[s] for s in sizes}
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, tmp_path, seed):
    rnd = random.Random(seed)
    names = ["b", "a", "é", None, "z", "aa", "empty"]
    heavy = {n: rnd.choice([1, 3, 40, 300]) for n in names}
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 5, 60, 300])) if s != "empty" else " \n", s) for k, s in enumerate(s for s in names for _ in range(heavy[s]))]
    rows += [(9000, None, "a"), (None, "x y", "b"), (3, rows[3][1], rows[3][2])]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_source_mix(spark, str(tmp_path)).collect()
    again = op2_source_mix(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = lambda t: len((t or "").split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    ordered = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = brute_targets(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(ordered)})
    by_key = defaultdict(list)
    for i, t, s in rows:
        by_key[(i, size(t))].append(s)
    taken, biggest = defaultdict(int), defaultdict(int)
    for r in got:
        s = by_key[(r.doc_id, r.size)][0]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6


def test_dual_is_solved_and_small_tables(spark):
    made = spark.createDataFrame([("a", 100, 300.0), ("b", 1000, 10.0), ("c", 0, 0.0)], "source string, source_size long, target double")
    rates = {r.source: r.rate for r in mixing.balance(made).collect()}
    assert rates["a"] == pytest.approx(3) and rates["b"] == pytest.approx(0.01) and rates["c"] == 0
    docs = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.copies) for r in mixing.mix(docs).collect()] == [(3, 3.0, 1)]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_repeated_rows_follow_the_mix(spark):
    rows = [(k, "w " * (k % 7), f"s{k % 4}" if k % 5 else None, k) for k in range(300)] + [(0, "x", "s0", 1), (301, None, "s1", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, cut int")
    want = {(r.doc_id, r.size): r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = mixing.repeated(docs)
    assert got.schema == docs.schema
    counted = defaultdict(int)
    for r in got.collect():
        counted[(r.doc_id, len((r.text or "").split()))] += 1
    assert counted == want
