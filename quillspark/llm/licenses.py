"""Licence scans over a positional rare-token index, with DataFrame functions only.

A template is a licence notice as a list of words with a mandatory key phrase in it.  Its
positional postings say at which offsets it has each word.  One pass over the documents
keeps, of each, the number of words, which licence words it has, and, where all words of
some key phrase are there, the number of the licence word at each place.  Document
frequencies of the licence words over all documents then name the rarest word of each key
phrase, and only the file's places of these highest-IDF words are looked up in their
postings, which gives candidate starts (place minus offset).  At a candidate start the
other words of the key phrase are fetched by relative position; where all of them stand,
the template counts, with the share of its notice's words in place.  Since every place of
a phrase is a place of its rarest word, none is missed; a file's words stay in its row.

Defined cases: null text counts as empty; a very long text is read whole; repeated rows
are each reported; several licences in one file are all found; columns of any name may be
kept; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import lower_ascii, written

#: What stands between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str  # its mandatory phrase
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key_at(self) -> int:
        """Offset of the key phrase in the notice."""
        key = self.key.split()
        return next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)


#: Published notices of common licences, each word as it is indexed.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license", True),
    Template("apache", "licensed under the apache license version 2 0", "apache license", True),
    Template("gpl", "licensed under the gnu general public license version", "general public license", True),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("boost", "distributed under the boost software license version 1 0", "boost software license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("creative-commons", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def indexed(docs: DataFrame, keep: list[str], templates: tuple[Template, ...], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` as c0, c1, ..., n_words, ``present`` (licence words in the file) and ``codes``, where a key phrase may be.

    A code is the number of a licence word in the vocabulary, from 1, and 0 for other words.
    """
    listed = vocabulary(templates)
    words = F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), GAPS), "")
    kept = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], words.alias("words"))
    rows = rows.select(*kept, "words", F.array_intersect("words", strings(listed)).alias("present"))
    keys = {tuple(sorted(set(t.key.split()))) for t in templates}
    possible = F.size("present") >= min(map(len, keys))
    complete = reduce(Column.__or__, [F.size(F.array_intersect("present", strings(list(k)))) == len(k) for k in sorted(keys)])
    codes = F.transform("words", lambda w: F.array_position(strings(listed), w).cast("smallint"))
    return rows.select(*kept, F.size("words").cast("bigint").alias("n_words"), "present", F.when(possible & complete, codes).alias("codes"))


def rarest(rows: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """The word of each template's key phrase that the fewest documents of ``rows`` have."""
    # one row for each word of the fixed vocabulary at most
    df = dict(map(tuple, rows.select(F.explode("present").alias("word")).groupBy("word").count().collect()))
    return [min(t.key.split(), key=lambda w: (df.get(w, 0), w)) for t in templates]


def seed_places(codes: Column, seeds: list[int]) -> Column:
    """code and place of the words of these codes."""
    at = F.transform(codes, lambda c, i: F.when(F.array_contains(shorts(seeds), c), F.struct(c.alias("code"), i.alias("at"))))
    return F.filter(at, lambda x: x.isNotNull())


def shorts(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("smallint") for v in values])


def matched(codes: Column, seeds: list[str], templates: tuple[Template, ...]) -> Column:
    """start (of its key phrase), label, base and share of each template whose key phrase is whole, found from the ``seeds``, a word of each key phrase."""
    number = {w: k for k, w in enumerate(vocabulary(templates), 1)}
    posted: dict[int, list[tuple[int, int]]] = {}
    for k, (t, seed) in enumerate(zip(templates, seeds, strict=True)):
        posted.setdefault(number[seed], []).extend((k, i) for i, w in enumerate(t.key.split()) if w == seed)
    postings = F.create_map(*[x for c, of in sorted(posted.items()) for x in (F.lit(c).cast("smallint"), F.array(*[F.struct(F.lit(k).alias("template"), F.lit(i).alias("offset")) for k, i in of]))])
    facts = F.array(
        *[
            F.struct(
                shorts([number[w] for w in t.key.split()]).alias("key"),
                shorts([number[w] for w in t.words]).alias("words"),
                F.lit(t.key_at).alias("key_at"),
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
            )
            for t in templates
        ]
    )
    starts = F.transform(seed_places(codes, sorted(posted)), lambda s: F.transform(postings[s["code"]], lambda q: F.struct((s["at"] - q["offset"]).alias("start"), facts[q["template"]].alias("of"))))
    whole = F.filter(F.array_distinct(F.flatten(starts)), lambda c: F.when(c["start"] >= 0, F.slice(codes, c["start"] + 1, F.size(c["of"]["key"])) == c["of"]["key"]).otherwise(F.lit(False)))

    def notice(c: Column) -> Column:
        in_place = F.transform(c["of"]["words"], lambda w, i: F.coalesce((F.get(codes, c["start"] - c["of"]["key_at"] + i) == w).cast("int"), F.lit(0)))
        share = F.aggregate(in_place, F.lit(0), lambda a, x: a + x) / F.size(c["of"]["words"])
        return F.struct(c["start"].alias("start"), c["of"]["label"].alias("label"), c["of"]["base"].alias("base"), share.alias("share"))

    return F.array_sort(F.transform(whole, notice))


def scan(docs: DataFrame, keep: list[str], templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_words, and ``found``: start, label, base and share of each notice found, by start."""
    rows = written(indexed(docs, keep, templates, text_col), "licence_words")
    found = matched(F.col("codes"), rarest(rows, templates), templates)
    empty = F.array().cast("array<struct<start:int,label:string,base:boolean,share:double>>")
    kept = [f"c{k}" for k in range(len(keep))]
    done = rows.select(*kept, "n_words", F.coalesce(found, empty).alias("found"))
    return done.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "n_words", "found")
