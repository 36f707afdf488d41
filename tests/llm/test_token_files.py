import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import token_files
from quillspark.llm.op9 import token_digests, with_crc

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["Hello, World!  it's\n\nDON'T", "", None, "É́ é ́x Σας", "<|endoftext|> a<|startoftext|>b", "a\x1cb\x85c　d\te", "z" * 9000, "漢字 12345 🙂", " \n ", "word " * 4000]


def expected(rows):
    out, start = [], 0
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_the_library_ids_in_order(spark):
    rows = [(3 * k, t) for k, t in enumerate(TEXTS * 5)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in reversed(rows)], "doc_id long, text string, ids int").repartition(7)
    got = sorted(tuple(r) for r in token_digests(docs).collect())
    assert got == expected(rows)


def test_layout_and_selective_read(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number {k} " * 50) for k in range(400)], "doc_id long, text string").coalesce(1)
    path = f"{tmp_path}/ids"
    token_files.write(docs, path, PATH, page_bytes=4096, page_rows=20)
    file = pq.ParquetFile(next(p for p in sorted((tmp_path / "ids").iterdir()) if p.suffix == ".parquet"))
    columns = {file.metadata.row_group(0).column(k).path_in_schema: file.metadata.row_group(0).column(k) for k in range(file.metadata.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert ids.has_offset_index and columns["doc_id"].has_column_index
    some = token_files.read(spark, path).filter("doc_id = 7")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in plan
    assert some.select("n_tokens").first()[0] == len(LIBRARY.encode("text number 7 " * 50).ids) + 1


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (1, None)], "doc_id long, text string")
    got = [tuple(r) for r in with_crc(token_files_rows(spark, docs)).collect()]
    assert sorted(g[1] for g in got) == sorted({g[1] for g in got}) and sum(g[2] for g in got) == 2 + 3 + 3 + 1
    assert next(g[1] for g in got if g[0] is None) == 0
    assert token_digests(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aB's,.é1 \n<|É½ªİß", max_size=40)), max_size=5))
def test_any_text_matches_the_library(texts):
    ids, ends = token_files.word_cache(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "t": ["aaa", None, "", "bbbbbbbbbb", "c", "d"]})
    parts = [p.column(0).to_pylist() for p in token_files.slices(batch, 1, 3)]
    assert parts == [[0, 1, 2], [3], [4, 5]]


def test_generations_keep_results(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 2)
    cache = token_files.WordCache(PATH)
    for text in ("one two three", "two four.", "five one two", "Two FOUR three,"):
        ids, _ = cache.encode(pa.array([text, None]), b"\1\0\0\0")
        assert ids.tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 1, 1]


def token_files_rows(spark, docs):
    from quillspark.llm._shared import table_path

    path = table_path(spark, "t")
    token_files.write(docs, path, PATH)
    return token_files.read(spark, path)
