import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import quality
from quillspark.llm.op3 import quality_rows

GAPS = set(" \t\n\x0b\x0c\r")


def brute(text):
    text, words, word = text or "", [], ""
    for c in [*text, " "]:
        if c in GAPS:
            words += [word] if word else []
            word = ""
        else:
            word += c
    marked = {p for i in range(len(words) - 2) for j in range(len(words) - 2) if i != j and words[i : i + 3] == words[j : j + 3] for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if set(x) - GAPS]
    dups = sum(x in lines[:k] for k, x in enumerate(lines))
    return [len(words), sum(c not in GAPS for c in text), sum(c in "#*$%&|<>" for c in text), dups, len(marked), len(lines), sum(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in text), sum("A" <= c <= "Z" for c in text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t#é\x85\x1cZ.", max_size=40), st.text(max_size=20)), max_size=6))
def test_counts_equal_brute_force(texts):
    got = quality.measured(pa.array(texts, pa.string()), quality.byte_classes())
    assert [list(r) for r in zip(*(c.to_pylist() for c in got), strict=True)] == [brute(t) for t in texts]


def test_bucket_is_close_and_ordered(spark):
    rows = spark.range(0, 10001).select("id", quality.bucket(quality.F.col("id")).alias("b")).orderBy("id").collect()
    assert all(r.b <= r.id <= r.b + max(r.b / 32, 0) for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_junk_goes_and_ordinary_stays(spark):
    clean = [(k, " ".join(f"w{(k * 31 + j * 17) % 997}" for j in range(80 + k % 9)), "en", "s1") for k in range(60)]
    junk = [(100, " | ".join(f"w{j}" for j in range(90)), "en", "s1"), (101, "LOUD " + " ".join(f"WORD{j}!!" for j in range(90)), "en", "s1"), (102, "\n".join(["same line of some words"] * 30), None, "s1")]
    odd = [(103, None, "en", None), (104, "", None, None), (105, "too short", "en", "s1"), (1, clean[1][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, 5) for r in clean + junk + odd], "doc_id long, text string, lang string, source string, n_words int")
    got = quality_rows(docs).collect()
    assert len(got) == len(clean) + len(junk) + len(odd)
    assert {r.doc_id for r in got if r.kept} == {r[0] for r in clean}
    assert {r.doc_id: r.failed for r in got}[100] == "symbols,marks"
    assert quality_rows(docs.limit(0)).count() == 0


def test_small_groups_take_wider_fences(spark):
    rows = [(k, f"{'#' * (k % 2 * 9)} " + " ".join(f"w{j + k}" for j in range(60)), "en", f"s{k % 2}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measures = quality.measure(docs, ["doc_id", "lang", "source"])
    wide = {r.source: r.max_symbols for r in quality.thresholds(measures, min_rows=1000).collect()}
    own = {r.source: r.max_symbols for r in quality.thresholds(measures, min_rows=10).collect()}
    assert wide["s0"] == wide["s1"] and own["s0"] < own["s1"]
