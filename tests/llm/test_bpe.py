import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe
from quillspark.llm.op10 import round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CASES = [None, "", " ", "\n\n a  b\t\x1c\x85", "hello world's  end\n", "<|endoftext|>a <|endoftext|>", "a<|endoftext|", "ab" * 3000, " " * 500 + "x", "naïve ÉÉ ß 12345 ½", "՘՘b 漢字 कि 🙂🙂 é", "x" * 20001, "\n \xa0 \xa0\n", "a \xa0b \x1c c\u2003 d \t e", "a \u2003\u2003 b\xa0 ", ("z" * 90 + " ") * 3]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_cases_match_the_library(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(1, "", "x"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids), r.decoded) for r in bpe.encode_decode(docs, PATH).collect())
    want = sorted((i if i is not None else -1, *expected(t)) for i, t, _ in rows)
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n\t's1.é\x85", max_size=40), st.text("a \n", max_size=30), st.text("ab \xa0\u2003\t\n\x1c\x85\u200b'é1", max_size=30)))
def test_any_text_matches_the_library(text):
    own = bpe.tokenizer(PATH)
    got = own.encode(text)
    ids, decoded = expected(text)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == ids
    assert own.decode(got) == decoded


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.dictionaries(st.tuples(st.integers(0, 7), st.integers(0, 7)), st.integers(0, 7), max_size=20))
def test_tree_equals_rescanning(symbols, merges):
    ranks = {a << 32 | b: rank << 32 | made for rank, ((a, b), made) in enumerate(merges.items())}
    slow = symbols[:]
    while pairs := [(ranks[p] >> 32, i) for i in range(len(slow) - 1) if (p := slow[i] << 32 | slow[i + 1]) in ranks]:
        if len(slow) > 60:
            return
        _, i = min(pairs)
        slow[i : i + 2] = [ranks[slow[i] << 32 | slow[i + 1]] & 0xFFFFFFFF]
    assert bpe.merge_all(symbols, ranks) == slow


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "some text"), (8, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in round_trip(docs).collect()}
    assert got[8].n_tokens == 0 and got[8].ids_sha256 == got[8].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[7].decoded_sha256 == hashlib.sha256(b"some text").hexdigest()
    assert round_trip(docs.limit(0)).count() == 0


def test_generations_keep_results():
    asked = []
    table = bpe.Remembered(lambda k: asked.append(k) or k.encode(), 3)
    for k in "abcabdeafaaghia":
        assert table[k] == k.encode()
    assert len(table) <= 3 and asked.count("a") == 1


def test_many_random_texts_beside_white_space():
    rnd = random.Random(8)
    letters = "aab. \xa0\u2003\t\n\r\x0b\x1c\x1f\x85\u200b\u3000\ufeff'sé1  "
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(1, 14))) for _ in range(100_000)]
    own = bpe.tokenizer(PATH)
    wrong = [t for t, e in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != np.array(e.ids, "<u4").tobytes()]
    assert not wrong
