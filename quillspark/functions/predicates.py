"""Predicates on terms and queries, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blacklisted(term: Column) -> Column:
    """One character, a number, or marks only."""
    return (F.length(term) <= 1) | term.rlike(r"^\p{N}+$") | term.rlike(r"^[\p{P}\p{S}]+$")


def word_like(term: Column) -> Column:
    """2 to 64 characters, no digit, four fifths of them letters."""
    letters = F.length(F.regexp_replace(term, r"[^\p{L}]", ""))
    return F.length(term).between(2, 64) & ~term.rlike(r"\p{Nd}") & (letters * 10 >= 8 * F.length(term))


def minable(term: Column) -> Column:
    """May stand in a mined pair: word-like and not blacklisted."""
    return word_like(term) & ~blacklisted(term)


def composable(text: Column) -> Column:
    """2 to 6 words of letters alone, one space between them."""
    return text.rlike(r"^\p{L}+( \p{L}+){1,5}$")


#: How queries end that were cut while being typed, and last words that need another.
CUT_ENDINGS = (" b", " be", " ben", " bệnh v", " bệnh vi", " bệnh viê", " trường t", " trường th", " trường thc", " trường mầm", " sân b", " sân ba", " bến x", " trung t")
CUT_WORDS = ("v", "vi", "viê", "t", "th", "thc", "mầm", "ba", "x")


def looks_incomplete(query: Column, endings: tuple[str, ...] = CUT_ENDINGS) -> Column:
    """Ends, in lower case and with single spaces, with one of the endings; a space is put before the first word."""
    said = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")))
    return F.coalesce(F.regexp_extract(said, "(" + "|".join(endings) + ")$", 1) != "", F.lit(False))
