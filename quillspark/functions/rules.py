"""Ordered rules on queries and on pairs, each a list of (condition, reason) whose first hit decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.normalize import vowels_with_marks

#: Fixed values of the rules.
TRAILING_WORDS = ("ngõ", "ngách", "hẻm", "số", "đường", "phố", "khu", "chợ", "bến", "trường", "bệnh", "và", "ở", "gần", "tại", "cổng", "nhà", "khách", "tầng", "thôn", "xóm")
KNOWN_PREFIXES = ("199 hồ tùng", "khu nhà ở và trường", "khu nhà ở và trường học")
KNOWN_TYPOS = ("bên xe", "khách san", "quan an", "benh vien", "truong hoc", "nha hang", "sieu thi", "shoppe", "trasua", "cafe", "nhà gas")
EXPANDED_TOKENS = (
    "bv", "bv.", "d.", "đ.", "d", "đ", "q.", "q", "p.", "p", "tp.", "tp", "tx.", "tx", "tt.", "tt", "ql.", "ql", "tl.", "tl",
    "kdc.", "kdc", "kcn.", "kcn", "tp hcm", "tphcm", "hcm", "hn", "đn", "hp", "ct", "dhbk", "ubnd", "thpt",
)
EXPANDED_PARTS = ("tp hcm", "tphcm", "bv ", "d. ", "q. ", "p. ", "ql. ", "tx. ", "tt. ")
UNEXPANDED = ("ubnd", "bv", "kcn", "thpt", "thcs")
BARE_ACRONYMS = ("ltk", "dbp", "nct", "hbt", "pvh", "ntmk", "nvl")
CHAT = "zalo|viber|inbox|nhắn tin|chào anh|chào chị|em chào|liên hệ|sđt|hotline"
SAME_PLACE_TWICE = ("hà nội thành phố hà nội", "hồ chí minh thành phố hồ chí minh", "thành phố hồ chí minh thành phố hồ chí minh")
#: Blocks of other scripts, small capitals and pictures.
FOREIGN = r"[\x{0400}-\x{04FF}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{1D00}-\x{1D7F}\x{1F000}-\x{1FFFF}\x{2600}-\x{27FF}\x{FE00}-\x{FE0F}]"
PHONE = r"(?U)\b0\d{9,10}\b|\b0\d{3}\s+\d{3}\s+\d{3,4}\b"
LOCAL_PHONE = r"(^|[^0-9])(\+?84|0)[0-9]{8,10}([^0-9]|$)"
URL = r"(?i)https?://|www\."


def first_reason(rules: list[tuple[Column, str | Column]], otherwise: Column | None = None) -> Column:
    out = None
    for condition, reason in rules:
        value = reason if isinstance(reason, Column) else F.lit(reason)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def words(text: Column) -> Column:
    """Words between spaces; none in an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def repeats_anywhere(ws: Column) -> Column:
    """A run of 2, 3 or 4 words stands twice anywhere."""
    out = F.lit(False)
    for n in (2, 3, 4):
        runs = F.when(F.size(ws) > n, run_list(ws, n))
        out = out | F.coalesce(F.size(F.array_distinct(runs)) < F.size(runs), F.lit(False))
    return out


def run_list(ws: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))


def repeats_adjacent(ws: Column, widest: int = 8) -> Column:
    """A run of 1 to ``widest`` words is followed by itself."""
    out = F.lit(False)
    for n in range(1, widest + 1):
        out = out | ((F.size(ws) >= 2 * n) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(ws) - 2 * n + 1, F.lit(1))), same_run(ws, n)))
    return out


def same_run(ws: Column, n: int):
    return lambda i: F.slice(ws, i, n) == F.slice(ws, i + n, n)


def target_rejection(text: Column, ws: Column, strict: bool) -> Column:
    """Why a target is rejected, or null; ``ws`` are its words in lower case.

    ``strict`` is the later version: repeats only side by side, no rule on letters.
    """
    rules = [
        ((F.length(text) > 100) | (F.size(ws) > 16), "too_long"),
        (F.regexp_replace(text, " ", "").rlike(LOCAL_PHONE), "phone_like"),
        (text.rlike(URL), "url_like"),
    ]
    if strict:
        low = F.array_join(ws, " ")
        named = F.lit(False)
        for p in SAME_PLACE_TWICE:
            named = named | F.contains(low, F.lit(p))
        return first_reason([*rules, (repeats_adjacent(ws) | named, "repeated_phrase")])
    return first_reason([*rules, (repeats_anywhere(ws), "repeated_phrase"), (~text.rlike(r"\p{L}"), "no_letters")])


def protection(text: Column, ws: Column, strict: bool) -> Column:
    """Why a text must not be changed by noise, or null."""
    short = F.length(F.regexp_replace(text, r"\s", "")) <= 3
    code = F.exists(ws, lambda w: w.rlike(r"\p{L}") & w.rlike(r"\p{Nd}"))
    upper = text.rlike(r"\p{L}") & (F.upper(text) == text) & (F.lower(text) != text)
    rules = [(short, "short_ambiguous"), (code, "alphanumeric_code"), (upper, "uppercase_name")]
    return first_reason([(~text.rlike(r"\p{L}"), "numeric_or_symbol"), *rules] if strict else rules)


def in_list(w: Column, values: tuple[str, ...]) -> Column:
    return w.isin(*values)


def query_quality(q: Column, ws: Column) -> Column:
    """category:reason of a normalized query."""
    marks = f"[{vowels_with_marks()}]"
    last = F.element_at(ws, -1)
    bare = lambda w: F.regexp_replace(w, r"^[.,/\-]+|[.,/\-]+$", "")
    trigger = F.get(F.filter(ws, lambda w: in_list(w, EXPANDED_TOKENS) | in_list(bare(w), EXPANDED_TOKENS)), F.lit(0))
    say = lambda c, r: F.lit(f"{c}:{r}")
    garbage, prefix, clash, typo = "REJECTED_GARBAGE", "AMBIGUOUS_PREFIX", "CONTRADICTION_LANE2", "NOISY_TYPO"
    rules = [
        (F.length(q) < 3, say(garbage, "too_short_or_empty")),
        (F.size(ws) > 20, say(garbage, "query_too_long_chat_spam")),
        (q.rlike(PHONE), say(garbage, "contains_phone_number")),
        (q.rlike(rf"(?iU)\b(?:{CHAT})\b") & (F.size(ws) > 8), say(garbage, "chat_customer_service_message")),
        (q.rlike(r"[/,.\-:]$"), say(prefix, "incomplete_trailing_punctuation")),
        ((F.size(ws) < 2) & ~q.rlike(marks), say(prefix, "single_unaccented_token")),
        (F.size(ws) < 2, say(prefix, "single_bare_token")),
        (in_list(q, KNOWN_PREFIXES), say(prefix, "known_incomplete_prefix")),
        (q.rlike(r"^\p{Nd}+[a-zA-Z\p{Nd}/]*\s+[a-zà-ỹ]+$"), say(prefix, "house_number_single_word_prefix")),
        (in_list(last, TRAILING_WORDS), F.concat(F.lit(f"{prefix}:incomplete_trailing_word_"), last)),
        ((F.length(last) == 1) & ~last.rlike(r"\p{Nd}"), say(prefix, "trailing_single_letter")),
        (trigger.isNotNull(), F.concat(F.lit(f"{clash}:contains_lane2_trigger_"), trigger)),
        *[(F.contains(q, F.lit(p)), say(clash, f"contains_lane2_trigger_{p.strip()}")) for p in EXPANDED_PARTS],
        *[(F.contains(q, F.lit(t)), say(typo, f"contains_known_typo_{t}")) for t in KNOWN_TYPOS],
        (~q.rlike(marks) & ~q.rlike(r"\p{Nd}"), say(typo, "unaccented_query")),
        (F.exists(ws, lambda w: (F.length(w) > 15) & ~w.startswith("http")), say(typo, "excessively_long_token")),
    ]
    return first_reason(rules, F.lit("HIGH_CONFIDENCE_CLEAN:valid_vietnamese_query"))


def script_valid(text: Column) -> Column:
    return (text != "") & ~text.rlike(FOREIGN)


def pair_violation(source: Column, s: Column, target: Column, t: Column) -> Column:
    """Why a normalized pair breaks the contract, or an empty string; ``s`` and ``t`` are the words of its sides."""
    word = lambda w: rf"(?U)\b{w}\b"
    acronym = F.get(F.filter(s, lambda w: in_list(w, BARE_ACRONYMS)), F.lit(0))
    merged = F.exists(F.arrays_zip(F.regexp_extract_all(target, F.lit(SLASHES), F.lit(1)).alias("a"), F.regexp_extract_all(target, F.lit(SLASHES), F.lit(2)).alias("b")), lambda x: F.contains(source, F.concat(x["a"], x["b"])))
    twice = F.lit(None).cast("string")
    for k in (2, 3, 4, 5):
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - 2 * k + 1, F.lit(1))), repeated_words(t, k))
        hit = F.get(F.transform(at, phrase_at(t, k)), F.lit(0))
        twice = F.coalesce(F.when(F.size(t) >= max(4, 2 * k), hit), twice)
    rules = [
        ((source == "") | (target == ""), "empty_source_or_target"),
        (~script_valid(source) | ~script_valid(target), "invalid_script"),
        (repeats_adjacent(t, 1), "target_has_duplicate_consecutive_words"),
        *[(target.rlike(word(w)), f"target_contains_unexpanded_{w}") for w in UNEXPANDED],
        (F.get(s, F.lit(0)).isin("d", "đ", "dg") & (F.get(t, F.lit(0)) == "phố"), "ambiguous_d_mapped_to_pho"),
        (F.contains(target, F.lit("/")) & ~F.contains(source, F.lit("/")) & merged, "ill_posed_digit_merging"),
        (acronym.isNotNull(), F.concat(F.lit("contextless_acronym_"), acronym)),
        (target.rlike(r"(?U)(?<!\w)(?:d|đ|p|q|tp|tx|tt)\.(?=\s|$)|(?<!\w)(?:p|q)\s+\d+\b"), "target_has_unexpanded_prefix"),
        (target.rlike(r"(?U)\b(?:cty|kđt|kdt|tttm)\b"), "target_has_unexpanded_business_abbrev"),
        (twice.isNotNull(), F.concat(F.lit("target_has_phrasal_duplicate_"), twice)),
        (F.size(t) > 25, "target_too_long_chat_spam"),
        (target.rlike(PHONE), "target_contains_phone_number"),
        (target.rlike(rf"(?iU)\b(?:{CHAT})\b") & (F.size(t) > 8), "target_chat_spam"),
    ]
    return first_reason(rules, F.lit(""))


SLASHES = r"(?U)\b(\d+)/(\d+(?:/\d+)*[a-zA-Z]?)\b"


def repeated_words(t: Column, k: int):
    return lambda i: (F.slice(t, i, k) == F.slice(t, i + k, k)) & ~F.forall(F.slice(t, i, k), lambda w: w.rlike(r"^\p{Nd}+$"))


def phrase_at(t: Column, k: int):
    return lambda i: F.array_join(F.slice(t, i, k), " ")
