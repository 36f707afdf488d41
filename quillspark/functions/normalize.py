"""Text normalizers, each with its own rule: they are not interchangeable.

Spark has no Unicode normalization and no case folding, so these are Arrow batches; what a
rule does beyond that stays a built-in expression around them.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def fold_term(text: str) -> str:
    """Term key: NFC, case folded, underscore as space, other marks but - and / as space, collapsed, stripped of space - and /."""
    text = unicodedata.normalize("NFC", text).casefold().replace("_", " ")
    return " ".join(re.sub(r"[^\w\s\-/]", " ", text).split()).strip(" -/")


def fold_group(text: str) -> str:
    """Group key: NFKC, case folded, collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def lower_nfc(text: str) -> str:
    """Lower case, NFC, collapsed."""
    return " ".join(unicodedata.normalize("NFC", text.strip().lower()).split())


def keep_case(text: str) -> str:
    """NFC, collapsed; case stays."""
    return " ".join(unicodedata.normalize("NFC", text).split())


def fold_query(text: str) -> str:
    """NFC, case folded, collapsed."""
    return " ".join(unicodedata.normalize("NFC", text).casefold().split())


def plain(text: str) -> str:
    """Without diacritics; đ as d."""
    out = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", out).replace("đ", "d").replace("Đ", "D")


def arrow(rule, kind: str = "string"):
    """A function of a column that runs a Python rule over Arrow batches; null stays null."""

    def column(text: Column | str) -> Column:
        def run(texts):
            return texts.map(rule, na_action="ignore")

        return pandas_udf(run, kind)(text)

    return column


term_key, group_key, lower_key, strict_key, query_key = map(arrow, (fold_term, fold_group, lower_nfc, keep_case, fold_query))


def accented_letters() -> tuple[str, str]:
    """All Latin letters with marks, and the letters below the marks, from the Unicode tables."""
    pairs = [(chr(c), plain(chr(c))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain_text(text: Column) -> Column:
    """``plain`` for composed text, by a built-in translation."""
    return F.translate(text, *accented_letters())


def vowels_with_marks() -> str:
    """Letters of Vietnamese words that show its diacritics, lower case: vowels by shape and tone, and đ."""
    shapes = "aăâeêioôơuưy"
    tones = ["", "̀", "́", "̉", "̃", "̣"]
    every = {unicodedata.normalize("NFC", s + t) for s in shapes for t in tones}
    return "".join(sorted(every - set("aeiouy") | {"đ"}))
