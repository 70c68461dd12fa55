"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame operations only.

Found are: payment cards (Luhn digit right), social security numbers (area,
group and serial in use), phone numbers, IPv4 addresses, calendar dates and
e-mail addresses.  What only looks like one, such as a card number with a
wrong Luhn digit or a 31st of June, stays as it is.

Each value is permuted within its own format by a keyed Feistel network, so
equal values get equal pseudonyms in every document, different values
different ones, and a pseudonym is a valid value of its kind:

- the value is a pair (l, r) of numbers below (a, b); rounds add a keyed hash
  of one half to the other, modulo a or b, which permutes the a * b pairs
  without a rejected value;
- cards: the digits before the Luhn digit, which is computed anew; phones: the
  digits behind the country code; social security numbers: (area, group) and
  serial among those in use; addresses: two octets each; dates: the day among
  the 146,097 = 189 * 773 days of 1800 to 2199 (others stay);
- separators, brackets and country codes stay where they are;
- of an e-mail address the part before the @ becomes ``u`` and a keyed hash of
  it in lower case; the host stays.

Slash dates are read as month/day/year, or day/month/year if that is no date.

Defined cases: null texts stay null with counts of 0, empty texts stay empty;
repeated rows are treated alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import table

KEY = "change-me"   # secret of the pseudonyms; give your own
ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# e-mail addresses in time linear in the text, without a group that backtracks: the local part starts where a run
# of its characters does, or at the end of the match before; labels are taken for good, and the last label that
# begins with two letters ends the address
_LOCAL, _LABEL = r"[\p{L}\p{N}._%+-]", r"[\p{L}\p{N}-]++"
_SHORT = rf"(?:\.(?!\p{{L}}{{2}}){_LABEL})*+"     # labels that can't end an address
_TOP = rf"{_SHORT}\.\p{{L}}{{2}}"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}(?:{_SHORT}\.{_LABEL}(?={_TOP}))*+{_TOP}\p{{L}}*+",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "date": r"(?<!\d)(?:\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4}|\d\d\.\d\d\.\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _long(x: Column) -> Column:
    return x.try_cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, kind: str, key: str, rounds: int = ROUNDS) -> Column:
    """The pair (left, right) permuted among the pairs below (a, b): struct(l, r)."""

    def add(half: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}"), r.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")

    def step(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(F.when(odd, F.pmod(s["l"] + F.pmod(add(s["r"], r), a), a)).otherwise(s["l"]).alias("l"),
                        F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(add(s["l"], r), b), b)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _permute_digits(d: Column, kind: str, key: str) -> Column:
    """A string of 2 to 18 digits permuted among those of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = feistel(F.substring(d, F.lit(1), u), F.substring(d, u + 1, n), ten(u), ten(n - u), kind, key)
    return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), u, F.lit("0")), F.lpad(p["r"].cast("string"), n - u, F.lit("0"))))


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.split(shape, ""), start, lambda s, c: F.when(
        c.rlike(r"^\d$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])


def _luhn_sum(d: Column, first_doubled: int) -> Column:
    """Luhn sum of a digit string; from the right, digit ``first_doubled`` (0 or 1) is the first to be doubled."""
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(
        i % 2 == first_doubled, F.get(F.array(*[F.lit(x * 2 - 9 * (x > 4)) for x in range(10)]), c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        body = _permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
        whole = _let(body, lambda p: F.concat(p, F.pmod(F.lit(10) - _luhn_sum(p, 0) % 10, F.lit(10)).cast("string")))
        return F.when(_luhn_sum(d, 1) % 10 == 0, _fill(m, whole))
    return _let(_digits(m), valid)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^(\+\d{1,3}[ .-]?(?=\(|\d{3}[ .-]))?", 0)
    return _let(country, lambda c: F.concat(c, _let(F.substring(m, F.length(c) + 1, F.length(m)), lambda rest: _fill(
        rest, _permute_digits(_digits(rest), "phone", key)))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (_long(F.substring(m, i, n)) for i, n in ((1, 3), (5, 2), (8, 4)))
    # areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999 are in use
    place = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    pair = feistel(place, serial - 1, F.lit(898 * 99), F.lit(9999), "ssn", key)

    def write(p: Column) -> Column:
        a = F.floor(p["l"] / 99) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(p["l"] % 99 + 1, 2), pad(p["r"] + 1, 4))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _let(pair, write))


def _ip(m: Column, key: str) -> Column:
    o = lambda i: _long(F.get(F.split(m, r"\."), F.lit(i)))
    pair = feistel(o(0) * 256 + o(1), o(2) * 256 + o(3), F.lit(65536), F.lit(65536), "ip", key)
    return _let(pair, lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in (
        F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]))


def _date(m: Column, key: str) -> Column:
    def by(fmt: str, shape: str) -> Column:
        parsed = F.when(m.rlike(shape), F.try_to_date(m, fmt))

        def write(day: Column) -> Column:
            n = F.datediff(day, F.lit("1800-01-01").cast("date"))
            pair = feistel(F.floor(n / 773), n % 773, F.lit(189), F.lit(773), "date", key)
            return F.when((n >= 0) & (n < 146097), _let(pair, lambda p: F.date_format(
                F.date_add(F.lit("1800-01-01").cast("date"), (p["l"] * 773 + p["r"]).cast("int")), fmt)))

        return _let(parsed, write)

    return F.coalesce(by("yyyy-MM-dd", r"^\d{4}-"), by("dd.MM.yyyy", r"^\d\d\."), by("MM/dd/yyyy", r"^\d\d/\d\d/"),
                      by("dd/MM/yyyy", r"^\d\d/\d\d/"), by("M/d/yyyy", r"^\d\d?/\d\d?/"), by("d/M/yyyy", r"^\d\d?/\d\d?/"))


def _email(m: Column, key: str) -> Column:
    local = F.lower(F.substring_index(m, "@", 1))
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), local), 256), 1, 12), F.lit("@"), F.substring_index(m, "@", -1))


KINDS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str = KEY) -> Column:
    """struct(kind, value) of a match of ``ANY``; kind is null and value the match itself if it is not valid."""
    same = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))

    def named(kind: str) -> Column:
        return _let(KINDS[kind](m, key), lambda v: F.when(v.isNull(), same).otherwise(
            F.struct(F.lit(kind).alias("kind"), v.alias("value"))))

    out = same
    for kind in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), named(kind)).otherwise(out)
    return out


def pseudonymise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """One row per input row: id, text with pseudonyms, and how many values of each kind were replaced."""
    t = F.col(text_col)
    # a text without a digit or @ has no match; the others are searched once
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = df.select(F.col(id_col).alias("_id"), t.alias("_t"), F.coalesce(found, F.array().cast("array<string>")).alias("_m"))
    rows = rows.withColumn("_new", F.transform("_m", lambda m: pseudonym(m, key)))
    parts = F.split(F.col("_t"), ANY, -1)
    text = F.when(F.size("_m") == 0, F.col("_t")).otherwise(F.array_join(F.zip_with(
        parts, "_new", lambda p, n: F.concat(p, F.coalesce(n["value"], F.lit("")))), ""))
    count = lambda kind: F.size(F.filter("_new", lambda n: n["kind"] == kind)).alias(f"n_{kind}")
    return rows.select(F.col("_id").alias(id_col), text.alias("text"), *[count(k) for k in KINDS])


def op3_pii(spark, sf_dir):
    """Every document with pseudonyms for its personal numbers, dates and addresses."""
    return pseudonymise(table(spark, sf_dir, "documents"))
