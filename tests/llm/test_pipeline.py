import json
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import queries, stages


def made(folder, spark):
    rnd = random.Random(11)
    syllables = ["ba", "ko", "ri", "te", "mu", "sa", "lo", "ne", "da"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.choice([2, 3, 4])))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(120)]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(6):
                words[rnd.randrange(len(words))] = "vexworm"
        if k % 10 == 1:
            words[5] = "token=abcdef123456"
        rows.append((k, " ".join(words), "en", f"s{k % 3}", 0))
        labels.append((k, 1, int(toxic)))
    copies = [(1000 + k, rows[k][1], "en", "s1", 0) for k in (1, 2, 3)] + [(2000, None, None, None, None), (2001, "", "en", "s0", 0)]
    spark.createDataFrame(rows + copies, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, copies


def test_every_stage_takes_effect(spark, tmp_path):
    rows, copies = made(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {r[0] for r in rows if "vexworm" in r[1]}
    clean = stages.drop_toxic(spark, docs, str(tmp_path))
    assert clean.schema == docs.schema
    left = {r.doc_id for r in clean.collect()}
    assert left == {r[0] for r in rows + copies} - toxic
    one = stages.keep_one_of_each_group(spark, clean, str(tmp_path))
    ids = {r.doc_id for r in one.collect()}
    assert ids == left - {1001, 1002, 1003, 2001} and one.columns == docs.columns
    redacted = stages.redact_secrets(spark, one, str(tmp_path))
    texts = {r.doc_id: r for r in redacted.collect()}
    assert redacted.columns == docs.columns and set(texts) == ids
    assert all("abcdef123456" not in (r.text or "") for r in texts.values()) and "[SECRET]" in texts[1].text
    assert texts[1].n_chars == len(texts[1].text)
    mixed = stages.mix_sources(spark, redacted, str(tmp_path))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= ids


def test_clashing_names_pass_through_every_stage(spark, tmp_path):
    made(tmp_path, spark)
    extra = ["c0", "c1", "key", "spans", "c_rules", "c_key", "found_key", "rules", "__text", "__spans", "__score", "model", "passages", "label", "fp", "row", "node", "root", "size", "place", "copies", "target", "cut", "__source", "ids", "decoded"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("*", *[F.col("doc_id").cast("string").alias(n) for n in extra])
    for stage in (stages.drop_toxic, stages.keep_one_of_each_group, stages.redact_secrets, stages.mix_sources):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == str(r.doc_id) for r in rows for n in extra)
    encoded = stages.encode(spark, docs, str(tmp_path))
    assert encoded.columns == ["doc_id", "source", "n_tokens", "ids", "exact"] and encoded.filter("exact").count() == docs.count()


def test_run_encodes_what_is_left(spark, tmp_path):
    made(tmp_path, spark)
    got = queries.queries()["pipeline"](spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got and all(r.exact and r.n_tokens == len(r.ids) for r in got)
    assert all("vexworm" not in library.decode(list(r.ids)) for r in got)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted(json.dumps([r.doc_id, r.source, list(r.ids)]) for r in rows)
    assert key(got) == key(again)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
