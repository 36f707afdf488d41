"""Rewrites of queries: canonical targets, repeated phrases, splices, and features of pairs."""

from __future__ import annotations

import difflib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.distance import paired
from quillspark.functions.normalize import arrow, lower_nfc

#: Short forms and what they stand for, as whole words; then marked and numbered prefixes.
WHOLE_WORDS = {
    "ubnd": "ủy ban nhân dân", "bv": "bệnh viện", "kcn": "khu công nghiệp", "đh": "đại học", "dh": "đại học", "thpt": "trung học phổ thông", "thcs": "trung học cơ sở",
    r"tp\s+hcm": "thành phố hồ chí minh", "tphcm": "thành phố hồ chí minh", "cty": "công ty", "kđt|kdt": "khu đô thị", "tttm": "trung tâm thương mại",
}
PREFIXES = {"đ|d|dg": "đường", "p|f": "phường", "q": "quận", "tp": "thành phố", "tx": "thị xã", "tt": "thị trấn"}
NUMBERED = {"p|f": "phường", "q": "quận"}


def without_repeats(words: list[str], widest: int = 5) -> list[str]:
    """Runs of up to ``widest`` words that follow themselves once, longer runs first, until nothing changes.

    Runs of two words and more count only in texts of four and more, and not if all are numbers.
    """
    changed = len(words) >= 4
    while changed:
        changed = False
        for k in range(min(widest, len(words) // 2), 1, -1):
            out, i = [], 0
            while i < len(words):
                run = words[i : i + k]
                again = len(run) == k and run == words[i + k : i + 2 * k] and not all(w.isdigit() for w in run)
                out += run if again else words[i : i + 1]
                i += 2 * k if again else 1
                changed = changed or again
            words = out
            if changed:
                break
    return [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]


def canonical(text: str) -> str:
    """The canonical form of a target: short forms written out, repeats and outer marks removed."""
    text = lower_nfc(text)
    for short, long in WHOLE_WORDS.items():
        text = re.sub(rf"\b(?:{short})\b", long, text)
    for short, long in PREFIXES.items():
        text = re.sub(rf"(?<!\w)(?:{short})\.\s*", f"{long} ", text)
    for short, long in NUMBERED.items():
        text = re.sub(rf"(?<!\w)(?:{short})\s+(\d+)\b", rf"{long} \1", text)
    for short, long in PREFIXES.items():
        text = re.sub(rf"\b(?:{short})\s+{long}\b", long, text)
    text = " ".join(without_repeats(text.split()))
    return lower_nfc(re.sub(r"[,\-/:;\s]+$", "", re.sub(r"^[,.\-/?!:;\s]+", "", text)))


canonical_target = arrow(canonical)
repeats_removed = arrow(lambda t: " ".join(without_repeats(t.split())))


def adjacent_removed(words: Column) -> Column:
    """An array without words equal to the one before: built-in."""
    return F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))


def spliced(text: Column, edits: Column) -> Column:
    """``text`` with each of ``edits`` (start, end, correction; in order, apart) put in its place."""

    def step(acc: Column, e: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, e["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], kept, e["correction"]).alias("out"), e["end"].cast("int").alias("at"))

    return F.aggregate(edits, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def case_flags(token: str) -> list[int]:
    """All lower, all upper, title, first upper, mixed."""
    inner = any(c.isupper() for c in token[1:]) and any(c.islower() for c in token)
    return [int(token.islower()), int(token.isupper()), int(token.istitle()), int(token[:1].isupper()), int(inner)]


case_signature = arrow(case_flags, "array<int>")
#: Share of matching runs, left to right: not symmetric.
match_ratio = paired(lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), "double")


def letters_only(text: str) -> bool:
    return bool(text) and all(unicodedata.category(c)[0] == "L" or c == " " for c in text)


def one_neighbour_key(a: Column, b: Column) -> Column:
    """Equal but for one key hit beside the right one."""
    from quillspark.operators.noise import KEYS, neighbours

    near = F.create_map(*[x for row in KEYS for c in row for x in (F.lit(c), F.lit(neighbours(c)))])
    differ = F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] != p["y"])
    only = F.get(differ, F.lit(0))
    return (F.length(a) == F.length(b)) & (F.size(differ) == 1) & F.coalesce(F.contains(F.element_at(near, only["x"]), only["y"]), F.lit(False))
