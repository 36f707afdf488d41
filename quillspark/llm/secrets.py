"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams is derived: segments that
every match contains, each a choice of strings, each string the trigrams in it.  Folding
A-Z to a-z makes the query a superset for either case.  ``postings`` lists, for the
trigrams that any rule asks for, the documents that contain them; ``candidates`` intersects
the postings of a string's trigrams, unites the strings of a segment and intersects the
segments of a rule.  ``scan`` verifies the rules' candidates with the expression itself.
A rule without a mandatory trigram is run over every document.

Positions come from the pieces between matches: the start of a match is the length of all
pieces and matches before it, in code points.

Documents are identified by a hash of id and text: rows that are equal share candidates,
and a chance collision only adds a candidate to verify.  The candidates' keys come to the
texts by broadcast while there are few, so that texts move to no other task; beyond
MOST_BROADCAST both sides are shuffled by key.

Defined cases: null text counts as empty and has no span; a very long text is scanned
whole; repeated rows are each reported; matches of one kind never overlap, of different
kinds may; columns of any name may be kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import written

MOST_STRINGS = 64
#: Keys of candidates are broadcast up to so many.
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # the common subset of the regular expression dialects; no flags
    group: int = 0  # this group must have at least ...
    least: int = 0  # ... so many characters, or the match is dropped


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base rules, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
#: Published formats of further credentials.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud", "AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("payment", "[sr]k_live_[0-9A-Za-z]+", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^ \n\t:/@]+:[^ \n\t:/@]+@"),
)
RULES = BASE + MORE


def fold(c: int) -> str:
    return chr(c).lower() if c < 128 else chr(c)


def mandatory(pattern: str) -> list[set[str]]:
    """Segments that every match of ``pattern`` contains, in folded case, each a set of strings of which one occurs."""
    segments: list[set[str]] = []

    def flush(exact: set[str]) -> set[str]:
        if exact and min(map(len, exact)) >= 3:
            segments.append(exact)
        return {""}

    def exact_of(nodes) -> set[str] | None:
        """All strings of a sequence, or None if there are too many to list."""
        out = {""}
        for node in nodes:
            some = strings(node)
            if some is None or len(out) * len(some) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in some}
        return out

    def strings(node) -> set[str] | None:
        op, arg = node
        if op is C.LITERAL:
            return {fold(arg)}
        if op is C.IN:
            out: set[str] = set()
            for kind, value in arg:
                if kind is C.LITERAL:
                    out.add(fold(value))
                elif kind is C.RANGE and value[1] - value[0] < 8:
                    out |= {fold(c) for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out
        if op is C.SUBPATTERN:
            return exact_of(arg[-1])
        if op is C.BRANCH:
            parts = [exact_of(p) for p in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            one = exact_of(body) if high is not C.MAXREPEAT and high <= 4 else None
            if one is None:
                return None
            out, power = set(), {""}
            for k in range(high + 1):
                out |= power if k >= low else set()
                power = {a + b for a in power for b in one}
                if len(out) + len(power) > MOST_STRINGS:
                    return None
            return out
        return {""} if op is C.AT else None

    def walk(nodes) -> None:
        exact = {""}
        for node in nodes:
            some = strings(node)
            if some is not None and len(exact) * len(some) <= MOST_STRINGS:
                longer = {a + b for a in exact for b in some}
                # an optional part must not shorten what is sure already
                if min(map(len, some)) == 0 and min(map(len, exact)) >= 3:
                    exact = flush(exact)
                else:
                    exact = longer
                continue
            exact = flush(exact)
            op, arg = node
            if some is not None:
                exact = some
            elif op is C.SUBPATTERN:
                walk(arg[-1])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        flush(exact)

    walk(_parser.parse(pattern))
    return segments


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def trigram_queries(rules: tuple[Rule, ...]) -> dict[int, list[list[set[str]]]]:
    """rule number -> segments -> strings -> trigrams; rules without a segment are absent."""
    return {k: [[trigrams(s) for s in sorted(seg)] for seg in segments] for k, r in enumerate(rules) if (segments := mandatory(r.pattern))}


def row_key(id_col: str, text: Column) -> Column:
    return F.xxhash64(F.col(id_col), text)


def one_of(wanted: list[str]) -> str:
    """An expression that stands at each place where a trigram of ``wanted`` begins and takes the trigram as its group."""
    chars = lambda found: "[" + "".join(c if c.isalnum() else f"\\{c}" for c in sorted(found)) + "]"
    thirds: dict[str, dict[str, set[str]]] = {}
    for t in wanted:
        thirds.setdefault(t[0], {}).setdefault(t[1], set()).add(t[2])
    each = [re.escape(a) + "(?:" + "|".join(re.escape(b) + chars(c) for b, c in sorted(below.items())) + ")" for a, below in sorted(thirds.items())]
    return f"(?={chars(thirds)})(?=({'|'.join(each)}))"


def postings(docs: DataFrame, wanted: list[str], id_col: str, text: Column) -> DataFrame:
    """trigram and key, for the trigrams ``wanted``, found in one pass over a text."""
    if not wanted:
        return docs.select(row_key(id_col, text).alias("key"), F.lit("").alias("trigram")).limit(0)
    held = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(one_of(wanted)), F.lit(1)))
    return docs.select(row_key(id_col, text).alias("key"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text: Column) -> DataFrame:
    """key and ``rules``, the numbers of the rules whose trigram query it satisfies."""
    spark = docs.sparkSession
    queries = trigram_queries(rules)
    asked = [(t, r, s, a, len(grams)) for r, segments in queries.items() for s, seg in enumerate(segments) for a, grams in enumerate(seg) for t in grams]
    asked_df = spark.createDataFrame(asked, "trigram string, rule int, segment int, string int, n int")
    needs = spark.createDataFrame([(r, len(s)) for r, s in queries.items()], "need_rule int, segments int")
    listed = postings(docs, sorted({a[0] for a in asked}), id_col, text).distinct()
    # the rules' trigrams are a fixed, small table
    strings = listed.join(F.broadcast(asked_df), "trigram").groupBy("key", "rule", "segment", "string", "n").agg(F.count("*").alias("found")).filter("found = n")
    segments = strings.groupBy("key", "rule").agg(F.count_distinct("segment").alias("met"))
    whole = segments.join(F.broadcast(needs), F.col("rule") == F.col("need_rule")).filter("met = segments")
    return whole.groupBy("key").agg(F.collect_set("rule").alias("rules"))  # no more than there are rules


def matches(text: Column, rule: Rule) -> Column:
    """start and end (exclusive) of the rule's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(found.alias("m"), checked.alias("g"), F.slice(between, 1, F.size(found)).alias("b"))
    nothing = F.lit(None).cast("array<struct<start:int,end:int,size:int>>")
    none = F.coalesce(nothing, F.array().cast("array<struct<start:int,end:int,size:int>>"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.length(x["g"]).alias("size"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    kept = F.filter(walked, lambda s: s["size"] >= rule.least)
    return F.when(F.size(found) > 0, kept).otherwise(none)


def inside(head: str, run: str) -> bool:
    """Whether every character that ``head``, of literals and sets of characters, can have is one of the class ``run``."""
    for op, arg in _parser.parse(head):
        found = [(op, arg)] if op is C.LITERAL else arg if op is C.IN else [(None, None)]
        for kind, value in found:
            chars = range(value[0], value[1] + 1) if kind is C.RANGE else [value] if kind is C.LITERAL else None
            if chars is None or not all(re.fullmatch(run, chr(c)) for c in chars):
                return False
    return True


def prefiltered(rule: Rule) -> str:
    """The rule with its least length in place of +, where that finds the same matches.

    That holds for a run of characters at the end if the head before it consists of
    characters of the run: a match that is too short then holds no later head that leads
    further than it does.
    """
    parts = re.fullmatch(r"(.*)(\[[^\]]+\])\+", rule.pattern)
    if rule.group == 0 and rule.least and parts and inside(parts[1], parts[2]):
        return rule.pattern[:-1] + f"{{{rule.least - len(_parser.parse(parts[1]))},}}"
    return rule.pattern


def named(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def of_rank(rank: int):
    return lambda s: s["rank"] == rank


def scan(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", name: str = "spans") -> DataFrame:
    """The columns ``keep`` and ``name``: start, rank (the rule's number), kind and end of each match, in that order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = written(candidates(docs, rules, id_col, text).select(F.col("key").alias("found_key"), "rules"), "secret_candidates")
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], text.alias("text"), row_key(id_col, text).alias("key"))
    joined = rows.join(found, F.col("key") == F.col("found_key"), "left")
    filtered = trigram_queries(rules).keys()
    text = F.col("text")
    spans = []
    for k, rule in enumerate(rules):
        own = F.transform(matches(text, Rule(rule.kind, prefiltered(rule), rule.group, rule.least)), named(k, rule.kind))
        if k in filtered:
            own = F.when(F.array_contains("rules", k), own)
        spans.append(F.coalesce(own, F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))
    return joined.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], F.array_sort(F.concat(*spans)).alias(name))


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch covered by spans replaced by ``mark``; spans that touch or overlap give one mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] > acc["at"]
        first = (acc["at"] == 0) & (s["start"] == 0)
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).when(first, F.lit(mark)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(text)
