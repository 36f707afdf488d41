import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import toxicity
from quillspark.llm.op4 import op4_toxicity


def made(n, seed, toxic_share=0.2):
    rnd = random.Random(seed)
    syllables = ["ba", "ko", "ri", "te", "mu", "sa", "lo", "ne"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.choice([1, 2, 2, 3])))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rnd.choice([12, 60, 200]))]
        toxic = rnd.random() < toxic_share
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = "vex" + word()
        rows.append((k, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("toxic"))
    rows = made(900, 4)
    extra = [(5000, None, None), (5001, "", None), (5002, "!!! \n", None), (5003, "x" * 50_000 + " vexbako", None), (7, rows[7][1], None), (None, "vexba", None)]
    docs = [(i, t, "label leaks" if x else "none", "s", 1.0) for i, t, x in rows] + [(i, t, "n", "s", 0.0) for i, t, _ in extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, x) for i, _, x in rows if i % 5 < 4] + [(0, 1, rows[0][2]), (1, 1, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_held_out_accuracy_and_cases(spark, tables):
    folder, rows = tables
    got = op4_toxicity(spark, folder).collect()
    assert len(got) == 906 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    truth = {i: x for i, _, x in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == x for p, x in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score == by_id[5002].score < 0.5
    assert by_id[5003].predicted == 1


def test_held_out_labels_change_nothing(spark, tables, tmp_path):
    folder, _ = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    flipped = toxicity.F.when(toxicity.F.crc32(toxicity.F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic"))
    labels.withColumn("toxic", flipped).write.parquet(f"{tmp_path}/labels.parquet")
    scores = lambda d: sorted((str(r.doc_id), round(r.score, 9)) for r in op4_toxicity(spark, d).collect())
    assert scores(folder) == scores(str(tmp_path))


def brute_ratio(counts, word):
    """The log-likelihood ratio of a word by the definition: interpolated from the longest history down, one probability at a time."""
    seen = [Counter(), Counter()]  # occurrences of every stretch of up to ORDER bytes, and what stands before it
    before = [defaultdict(set), defaultdict(set)]
    for c in (0, 1):
        for w, n in counts[c].items():
            b = b" " + w.encode() + b" "
            for end in range(2, len(b) + 1):
                for size in range(1, min(toxicity.ORDER, end) + 1):
                    g = b[end - size : end]
                    seen[c][g] += n
                    if end - size > 0:
                        before[c][g].add(b[end - size - 1])
    every = set(seen[0]) | set(seen[1])

    def count(c, g):
        return seen[c][g] if len(g) == toxicity.ORDER or g[:1] == b" " and len(g) > 1 else len(before[c][g])

    def probability(g):
        siblings = [x for x in every if len(x) == len(g) and x[:-1] == g[:-1]]
        sums = [sum(count(c, x) for x in siblings) for c in (0, 1)]
        kept = [sum(max(count(c, x) - toxicity.DISCOUNT, 0) for x in siblings) for c in (0, 1)]
        low = probability(g[1:]) if len(g) > 1 else [(count(0, g) + count(1, g)) / sum(sums)] * 2
        rest = max(1 - kept[c] / sums[c] if sums[c] else 1 for c in (0, 1))
        return [(1 - rest) * max(count(c, g) - toxicity.DISCOUNT, 0) / kept[c] + rest * low[c] if kept[c] else rest * low[c] for c in (0, 1)]

    b, out = b" " + word.encode() + b" ", 0.0
    for end in range(2, len(b) + 1):
        g = b[max(0, end - toxicity.ORDER) : end]
        if g[-1:] in every:
            ordinary, toxic = probability(g)
            out += np.log(toxic / ordinary)
    return out


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_ratios_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rnd = random.Random(5)
    word = lambda letters: "".join(rnd.choices(letters, k=rnd.choice([1, 3, 6, 9])))
    counts = [Counter(word("abc") for _ in range(150)), Counter(word("abd") for _ in range(60))]
    counts[0]["é"], counts[1]["vexé"] = 9, 12
    rows = [(w, counts[0][w], counts[1][w], 0, 0) for w in set(counts[0]) | set(counts[1])]
    model = toxicity.build(spark.createDataFrame(rows, "word string, n0 long, n1 long, n2 long, n3 long"))
    tables = list(model.blocks(0))
    assert (len(tables) > 1) == (block == 40)
    asked = [*rnd.sample(sorted(set(counts[0]) | set(counts[1])), 25), "vexéa", "zz", "a" * 40, "bad", "é"]
    got = sum(toxicity.word_ratios([w.encode() for w in asked], t) for t in tables)
    assert got == pytest.approx([brute_ratio(counts, w) for w in asked], abs=1e-4)
    text = " ".join(asked)
    docs = spark.createDataFrame([(text,), (None,), ("vexé",)], "text string")
    found = {r.c0: r.passages for r in toxicity.passages(docs, ["text"], "text", model, 0).collect()}
    assert found[None] == [0.0] * len(toxicity.WINDOWS)
    clipped = np.clip(got, -toxicity.CLIP, toxicity.CLIP)
    assert found[text][0] == pytest.approx(max(clipped), abs=1e-4) and found[text][-1] == pytest.approx(clipped.mean(), abs=1e-4)
    assert found["vexé"][0] == pytest.approx(found["vexé"][-1])  # a short text is one window of its own length


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(1, 1 << 56, 5000).astype(np.uint64))
    slots, values = toxicity.hashed(codes[::2], np.arange(len(codes[::2]), dtype=np.float32))
    hit, at = toxicity.found(codes, slots)
    assert hit.tolist() == list(range(0, len(codes), 2)) and values[at].tolist() == list(range(len(codes[::2])))


def test_clashing_names_are_kept(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", *[toxicity.F.lit("x").alias(n) for n in ("c0", "model", "passages", "ratios", "__text")]).limit(5)
    training = spark.createDataFrame([(k, "vex bad" if k % 2 else "good", k % 2) for k in range(40)], "doc_id long, text string, toxic int")
    got = toxicity.score(docs, toxicity.fit(training), docs.columns).collect()
    assert len(got) == 5 and all(r.c0 == r.passages == "x" and 0 <= r.score <= 1 for r in got)


def test_no_labels_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = toxicity.fit(docs.limit(0).withColumn("toxic", toxicity.F.lit(1)))
    assert [r.score < 1e-6 for r in toxicity.score(docs, none, ["doc_id"]).collect()] == [True, True]
    one_class = toxicity.fit(docs.withColumn("toxic", toxicity.F.lit(1)))
    assert all(r.score > 0.99 for r in toxicity.score(docs, one_class, ["doc_id"]).collect())
    assert toxicity.score(docs.limit(0), none, ["doc_id"]).count() == 0
