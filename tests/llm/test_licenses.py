import re

from quillspark.llm import licenses
from quillspark.llm.op1 import op1_license_scan

TEXTS = [
    None,
    "",
    "Released under the MIT License. MIT-License mit\nlicense permit license",
    "This work is licensed under the GNU General Public License, version 3. general public license",
    "Licensed under the Apache License, Version 2.0. All Rights Reserved; CC-BY-NC 4.0",
    "éMIT License MİT license public general license license public apache",
    "GNU Lesser General Public LICENSE and the Affero general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "x " * 30_000 + "apache license",
    "mit license " * 500,
]
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_equals_brute_force(spark, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], "y"), (None, TEXTS[4], "z")]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_license_scan(spark, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((i, *brute(t))) for i, t, _ in rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].labels == "all-rights-reserved,apache,cc-by-nc" and by_id[4].score == 1.0
    assert by_id[6].labels == "agpl,gpl,lgpl" and by_id[7].labels == "mit" and by_id[7].base_labels == "" and by_id[7].score == 1.0
    assert by_id[1].score == 0.0 and 0 < by_id[8].score < 0.5


def test_rarest_words_and_empty(spark):
    docs = spark.createDataFrame([(1, "license license public"), (2, "license general"), (3, "public license")], "doc_id long, text string")
    rows = licenses.indexed(docs, ["doc_id"], licenses.TEMPLATES)
    assert licenses.rarest(rows, licenses.TEMPLATES)[:3] == ["mit", "apache", "general"]
    assert licenses.scan(docs.limit(0), ["doc_id"]).count() == 0
    named = docs.selectExpr("doc_id", "text", "1 as c0", "2 as codes", "3 as words", "4 as present")
    assert licenses.scan(named, ["doc_id", "codes", "words", "c0", "present"]).select("c0", "codes", "words", "present").distinct().collect() == [(1, 2, 3, 4)]
    assert all(t.words[t.key_at : t.key_at + len(t.key.split())] == t.key.split() for t in licenses.TEMPLATES)


def test_only_places_of_the_rarest_words_meet_the_postings(spark):
    rows = [(k, "the license and the public license of the general public " * 40 + ("general public license apache license" if k == 3 else "mit")) for k in range(10)]
    found = licenses.indexed(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], licenses.TEMPLATES).filter("codes is not null")
    seeds = licenses.rarest(found, licenses.TEMPLATES)
    numbers = {w: k for k, w in enumerate(licenses.vocabulary(licenses.TEMPLATES), 1)}
    F = licenses.F
    one = found.select(F.sum(F.size(licenses.seed_places(F.col("codes"), [numbers[seeds[1]]]))).alias("rare"), F.sum(F.size(F.filter("codes", lambda c: c > 0))).alias("listed")).first()
    assert seeds[1] == "apache" and one.rare == 1 and one.listed > 3000
    # any word of a key phrase leads to the same matches
    results = [sorted(map(str, found.select("c0", licenses.matched(F.col("codes"), [t.key.split()[at % len(t.key.split())] for t in licenses.TEMPLATES], licenses.TEMPLATES).alias("m")).collect())) for at in (0, 1, -1)]
    assert results[0] == results[1] == results[2] and "apache" in results[0][3] and "gpl" in results[0][3]
