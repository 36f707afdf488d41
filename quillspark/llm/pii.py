"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

Values are found by one expression, leftmost and without overlap, validated by kind, and
replaced by a keyed permutation of the values of their own format: a Feistel network over
two numbers L and R whose ranges multiply to the number of valid values, so that a valid
value always becomes a valid one and the map is one to one.  The key and the kind are the
only other inputs: equal values stay equal across documents.

* card: 13 to 19 digits, maybe in groups, with a right check digit; the other digits are
  permuted and the check digit follows; where a match with groups beside the card (an expiry
  date, a code) has a wrong check digit, its longest valid run of whole groups, with one separator
  throughout, is the card;
* phone: the digits after a country code, separators stay;
* ssn: the numbers that can be issued;
* ip: IPv4 addresses;
* date: days of a window of 73,170 from 1900-01-01, written year-month-day or with slashes
  (day first unless the second number can only be a day), in the same style;
* email: the part before the @ becomes as many as eight or more letters and digits of a
  keyed hash; the domain stays.

What looks alike but is not valid (a number with a wrong check digit, 300.1.1.1) stays.

Defined cases: null text stays null; empty text stays; repeated rows are each reported;
equal texts give equal results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each kind is written.  Every pattern is tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.){1,8}[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[2-9][0-9]{1,2}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
EVERY = "|".join(PATTERNS.values())
ROUNDS = 8
#: Days from 1900-01-01: 271 x 270, so that a date is two numbers exactly.
DAYS = (271, 270)
FIRST_DAY = "1900-01-01"
#: Issued numbers: areas 001 to 899 without 666, groups 01 to 99; serials 0001 to 9999.
SSN = (898 * 99, 9999)


def mixed(key: str, tweak: Column, part: Column, of: Column) -> Column:
    """A keyed function of ``part``, from 0 to ``of`` - 1."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, part.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % of


def feistel(left: Column, right: Column, m: Column, n: Column, tweak: Column, key: str) -> tuple[Column, Column]:
    """A permutation of the pairs with 0 <= left < m and 0 <= right < n."""

    def step(acc: Column, k: Column) -> Column:
        t = F.concat_ws("|", tweak, k.cast("string"))
        turn = F.when(k % 2 == 0, (acc["l"] + mixed(key, t, acc["r"], m)) % m).otherwise(acc["l"])
        other = F.when(k % 2 == 1, (acc["r"] + mixed(key, t, acc["l"], n)) % n).otherwise(acc["r"])
        return F.struct(turn.alias("l"), other.alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    both = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return both["l"], both["r"]


def power(digits: Column) -> Column:
    """10 to the power of up to 18."""
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), digits)).cast("bigint")


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """A string of 2 or more digits for one of as many."""
    a = F.floor(F.length(digits) / 2).cast("int")
    b = F.length(digits) - a
    m, n = power(a), power(b)
    left, right = F.substring(digits, F.lit(1), a).cast("bigint"), F.substring(digits, a + 1, b).cast("bigint")
    x, y = feistel(left, right, m, n, F.concat_ws("|", F.lit(kind), F.length(digits).cast("string")), key)
    return F.concat(F.lpad(x.cast("string"), a, F.lit("0")), F.lpad(y.cast("string"), b, F.lit("0")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Sum of the digits, every second one doubled, from the right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(F.try_to_number(d, F.lit("9")).cast("int").alias("d"), i.alias("i")))
    odd = 0 if last_doubled else 1

    def weighted(acc: Column, x: Column) -> Column:
        d = F.coalesce(x["d"], F.lit(0))
        return acc + F.when(x["i"] % 2 == odd, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(each, F.lit(0), weighted)


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits`` in sequence."""
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step)["out"]


def parted(value: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(value, pattern, k) for k in (1, 2, 3)]


def number(text: Column) -> Column:
    return F.when(text != "", text).cast("bigint")


def date_of(value: Column) -> Column:
    """The day that a value of the date pattern names, or null."""
    y, m, d = map(number, parted(value, "^([0-9]{4})-([0-9]{2})-([0-9]{2})$"))
    a, b, z = map(number, parted(value, "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"))
    month_first = (b > 12) & (a <= 12)
    year, month, day = F.coalesce(y, z), F.coalesce(m, F.when(month_first, a).otherwise(b)), F.coalesce(d, F.when(month_first, b).otherwise(a))
    written = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date")


def day_number(value: Column) -> Column:
    return F.datediff(date_of(value), F.lit(FIRST_DAY).cast("date"))


def kind_of(value: Column) -> Column:
    """The kind of a match, or null if it is not valid."""
    digits = digits_of(value)
    octets = F.transform(F.split(value, r"\."), lambda o: F.when(o.rlike("^[0-9]{1,3}$"), o).cast("int"))
    day = day_number(value)
    area, group, serial = map(number, parted(value, "^([0-9]{3})-([0-9]{2})-([0-9]{4})$"))
    issued = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("email"))
        .when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(F.array_max(octets) <= 255, F.lit("ip")))
        .when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$|/"), F.when(day.between(0, DAYS[0] * DAYS[1] - 1), F.lit("date")))
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(issued, F.lit("ssn")))
        .when(value.rlike(r"^\+|\(") | (F.length(digits) < 13), F.when(F.length(digits).between(8, 15), F.lit("phone")))
        .otherwise(F.when(luhn_sum(digits, False) % 10 == 0, F.lit("card")))
    )


def card_within(value: Column) -> Column:
    """The longest, then leftmost, run of whole digit groups with one separator that is a card (``value``), and what is ``before`` it; null if none is."""
    parts = F.split(value, "(?<=[ -])")

    def run(i: Column, j: Column) -> Column:
        text = F.regexp_replace(F.array_join(F.slice(parts, i, j - i + 1), ""), "[ -]$", "")
        return F.struct((-F.length(digits_of(text))).alias("size"), i.alias("at"), text.alias("value"), F.array_join(F.slice(parts, F.lit(1), i - 1), "").alias("before"))

    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(i, F.size(parts)), lambda j: run(i, j))))
    # dates and other numbers beside each other mix separators
    one = r"^[0-9]+(?: [0-9]+)*$|^[0-9]+(?:-[0-9]+)*$"
    return F.array_min(F.filter(runs, lambda x: x["size"].between(-19, -13) & x["value"].rlike(one) & (luhn_sum(digits_of(x["value"]), False) % 10 == 0)))


def recognised(match: Column) -> Column:
    """value and kind (null if not valid) of a match, and what of the match is before and after the value."""
    kind = kind_of(match)
    whole = F.struct(match.alias("value"), kind.alias("kind"), F.lit("").alias("before"), F.lit("").alias("after"))
    card = card_within(match)
    after = F.substring(match, F.length(card["before"]) + F.length(card["value"]) + 1, F.length(match))
    part = F.struct(card["value"].alias("value"), F.lit("card").alias("kind"), card["before"].alias("before"), after.alias("after"))
    return F.when(kind.isNull() & match.rlike("^[0-9][0-9 -]{13,}$") & card.isNotNull(), part).otherwise(whole)


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value of the same format that stands for a valid one."""
    digits = digits_of(value)
    # card
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    moved = permuted_digits(payload, "card", key)
    card = refill(value, F.concat(moved, ((10 - luhn_sum(moved, True) % 10) % 10).cast("string")))
    # phone: a country code of 1 stays, of another its first two digits
    code = F.when(F.length(digits) == 11, 1).when(value.startswith("+"), 2).otherwise(0)
    national = F.substring(digits, code + 1, F.length(digits))
    phone = refill(value, F.concat(F.substring(digits, F.lit(1), code), permuted_digits(national, "phone", key)))
    # ssn
    area, group, serial = map(number, parted(value, "^([0-9]{3})-([0-9]{2})-([0-9]{4})$"))
    index = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    x, y = feistel(index, serial - 1, F.lit(SSN[0]), F.lit(SSN[1]), F.lit("ssn"), key)
    new_area = F.floor(x / 99) + 1
    new_area = new_area + F.when(new_area >= 666, 1).otherwise(0)
    ssn = F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((x % 99 + 1).cast("string"), 2, "0"), F.lpad((y + 1).cast("string"), 4, "0"))
    # ip
    octets = F.transform(F.split(value, r"\."), lambda o: F.when(o.rlike("^[0-9]{1,3}$"), o).cast("int"))
    octet = lambda k: F.get(octets, F.lit(k))
    x, y = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    ip = F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"), F.floor(y / 256).cast("string"), (y % 256).cast("string"))
    # date
    day = day_number(value)
    x, y = feistel(F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), F.lit("date"), key)
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (x * DAYS[1] + y).cast("int"))
    a, b, _ = map(number, parted(value, "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"))
    wide = value.rlike("^[0-9]{2}/[0-9]{2}/")
    slashes = F.when((b > 12) & (a <= 12), F.when(wide, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "M/d/yyyy"))).otherwise(F.when(wide, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "d/M/yyyy")))
    date = F.when(F.contains(value, F.lit("/")), slashes).otherwise(F.date_format(new, "yyyy-MM-dd"))
    # email
    name = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)).cast("binary"), 256)
    email = F.concat(F.substring(name, F.lit(1), F.greatest(F.lit(8), F.least(F.lit(16), F.instr(value, "@") - 1))), F.substring(value, F.instr(value, "@"), F.length(value)))
    out = F.lit(None).cast("string")
    for name_, made in {"card": card, "phone": phone, "ssn": ssn, "ip": ip, "date": date, "email": email}.items():
        out = F.when(kind == name_, made).otherwise(out)
    return out


def replace(docs: DataFrame, keep: list[str], key: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``found`` (kind, value and pseudonym of each valid value, in order) and ``text`` with the pseudonyms."""
    text = F.col(text_col)
    matches = F.when(F.coalesce(text, F.lit("")).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(EVERY), F.lit(0)))
    rows = docs.select(*keep, text.alias("__text"), matches.alias("__matches"))
    found = F.transform("__matches", recognised)
    rows = rows.select(*keep, "__text", F.when(F.size("__matches") > 0, found).alias("__found"))
    named = F.transform("__found", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym"), x["before"].alias("before"), x["after"].alias("after")))
    rows = rows.select(*keep, "__text", named.alias("__found"))
    put = F.transform("__found", lambda x: F.concat(x["before"], F.coalesce(x["pseudonym"], x["value"]), x["after"]))
    text = F.when(F.size("__found") > 0, F.array_join(F.zip_with(F.split("__text", EVERY, -1), put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(F.col("__text"))
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    shown = F.transform("__found", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["pseudonym"].alias("pseudonym")))
    valid = F.coalesce(F.filter(shown, lambda x: x["kind"].isNotNull()), none)
    return rows.select(*keep, valid.alias("found"), text.alias("text"))
