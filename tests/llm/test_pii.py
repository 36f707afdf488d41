import datetime
import hashlib
import re

import pytest

from quillspark.llm import pii
from quillspark.llm.op8 import KEY, op8_pii_pseudonyms

TEXTS = [
    None,
    "",
    "mail Jo.Ann+x@mail8.example.com, call +1 (614) 555-8001 or 614-555-8001; card 4111 1111 1111 1111!",
    "not valid: 4111111111111112 300.1.1.1 2023-02-30 000-12-3456 1.2.3.4.5 99/99/2020",
    "ip 42.144.35.254 and 42.144.35.254, born 1984-02-29 or 29/02/1984, 3/14/1999, 04/05/2001, ssn 078-05-1120",
    "x" * 40_000 + " 4111-1111-1111-1111 +442079460958 é🙂 a@b.co",
    "4111111111111111 4111111111111111x 14111111111111111",
]


def mixed(tweak, part, of):
    return int(hashlib.sha256(f"{KEY}|{tweak}|{part}".encode()).hexdigest()[:15], 16) % of


def feistel(left, right, m, n, tweak):
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            left = (left + mixed(f"{tweak}|{k}", right, m)) % m
        else:
            right = (right + mixed(f"{tweak}|{k}", left, n)) % n
    return left, right


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def permuted(d, kind):
    a = len(d) // 2
    x, y = feistel(int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a), f"{kind}|{len(d)}")
    return f"{x:0{a}d}{y:0{len(d) - a}d}"


def refill(v, d):
    it = iter(d)
    return "".join(next(it) if c in "0123456789" else c for c in v)


def day_of(v):
    try:
        if "-" in v:
            return datetime.date.fromisoformat(v), "%Y-%m-%d"
        a, b, y = map(int, v.split("/"))
        first = b > 12 >= a
        return datetime.date(y, *((a, b) if first else (b, a))), "m/d" if first else "d/m"
    except ValueError:
        return None, None


def brute(match):
    v = match[0]
    d = re.sub("[^0-9]", "", v)
    if "@" in v:
        n = hashlib.sha256(f"{KEY}|email|{v.lower()}".encode()).hexdigest()
        at = v.index("@")
        return n[: max(8, min(16, at))] + v[at:]
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v):
        o = list(map(int, v.split(".")))
        if max(o) > 255:
            return v
        x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", v) or "/" in v:
        day, style = day_of(v)
        n = day and (day - datetime.date(1900, 1, 1)).days
        if day is None or not 0 <= n < 271 * 270:
            return v
        x, y = feistel(n // 270, n % 270, 271, 270, "date")
        new = datetime.date(1900, 1, 1) + datetime.timedelta(x * 270 + y)
        if style == "%Y-%m-%d":
            return new.isoformat()
        w = 2 if re.match(r"\d\d/\d\d/", v) else 1
        first, second = (new.month, new.day) if style == "m/d" else (new.day, new.month)
        return f"{first:0{w}d}/{second:0{w}d}/{new.year:04d}"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", v):
        a, g, s = map(int, v.split("-"))
        if a in (0, 666) or a >= 900 or not g or not s:
            return v
        x, y = feistel((a - 1 - (a > 666)) * 99 + g - 1, s - 1, 898 * 99, 9999, "ssn")
        a = x // 99 + 1
        return f"{a + (a >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if v[0] == "+" or "(" in v or len(d) < 13:
        if not 8 <= len(d) <= 15:
            return v
        c = 1 if len(d) == 11 else 2 if v[0] == "+" else 0
        return refill(v, d[:c] + permuted(d[c:], "phone"))
    if not luhn(d):
        return v
    p = permuted(d[:-1], "card")
    return refill(v, p + next(c for c in "0123456789" if luhn(p + c)))


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], 1), (None, TEXTS[4], 1)]
    spark.createDataFrame(rows, "doc_id long, text string, found int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(str((r.doc_id, r.text)) for r in op8_pii_pseudonyms(spark, str(tmp_path)).collect())
    assert got == sorted(str((i, None if t is None else re.sub(pii.EVERY, brute, t))) for i, t, _ in rows)


def brute_beside(match):
    """As ``brute``, with the longest valid run of whole groups where all of them are no card."""
    v = match[0]
    if not re.fullmatch(r"[0-9][0-9 -]{13,}", v) or luhn(re.sub("[^0-9]", "", v)):
        return brute(match)
    groups = list(re.finditer("[0-9]+", v))
    runs = [(a.start(), b.end()) for k, a in enumerate(groups) for b in groups[k:]]
    size = lambda r: len(re.sub("[^0-9]", "", v[r[0] : r[1]]))
    cards = [r for r in runs if len(set(re.sub("[0-9]", "", v[r[0] : r[1]]))) < 2 and 13 <= size(r) <= 19 and luhn(re.sub("[^0-9]", "", v[r[0] : r[1]]))]
    if not cards:
        return v
    a, b = max(cards, key=lambda r: (size(r), -r[0]))
    d = re.sub("[^0-9]", "", v[a:b])
    p = permuted(d[:-1], "card")
    return v[:a] + refill(v[a:b], p + next(c for c in "0123456789" if luhn(p + c))) + v[b:]


def test_cards_beside_other_digits(spark, tmp_path):
    texts = ["4111 1111 1111 1111 12/27", "4111 1111 1111 1111 123", "order 12 4111 1111 1111 1111", "4111-1111-1111-1111 12-3 x", "4111111111111111 99", "4111 1111 1111 1112 12"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_pii_pseudonyms(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in got.items()} == {k: re.sub(pii.EVERY, brute_beside, t) for k, t in enumerate(texts)}
    assert all(got[k].n_card == 1 and "1111 1111" not in got[k].text and "1111-1111" not in got[k].text for k in range(4))


def test_kinds_and_links(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.replace(docs, ["doc_id"], "k").collect()}
    assert [x.kind for x in rows[2].found] == ["email", "phone", "phone", "card"] and rows[3].found == [] and rows[3].text == TEXTS[3]
    assert [x.kind for x in rows[4].found] == ["ip", "ip", "date", "date", "date", "date", "ssn"]
    a, b = rows[4].found[:2]
    assert a.pseudonym == b.pseudonym != a.value
    cards = {re.sub("[^0-9]", "", x.pseudonym) for r in rows.values() for x in r.found if x.kind == "card"}
    assert len(cards) == 1 and luhn(cards.pop())
    iso, slashed = (x.pseudonym for x in rows[4].found[2:4])
    assert datetime.date.fromisoformat(iso) == datetime.datetime.strptime(slashed, "%d/%m/%Y").date()
    assert pii.replace(docs.limit(0), ["doc_id"], "k").count() == 0


@pytest.mark.parametrize("kind", ["phone", "card"])
def test_permutation_is_one_to_one(spark, kind):
    out = spark.range(1000).select(pii.permuted_digits(pii.F.lpad(pii.F.col("id").cast("string"), 3, "0"), kind, "k").alias("p"))
    assert sorted(r.p for r in out.collect()) == [f"{k:03d}" for k in range(1000)]
