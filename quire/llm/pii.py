"""Format-preserving pseudonyms for personal numbers and dates, in Spark SQL functions only.

A value is found by pattern, validated (Luhn, mod 97, calendar, number plan, octets), turned into a
number below the size of its format, permuted by a keyed Feistel network over exactly that size, and
written back into its own format with its check digits. So a card number stays a valid card number of the
same length and grouping, a date stays a date, and equal values get equal pseudonyms in every document,
whatever their grouping. Values that fail validation are left alone. The method has no numbers to
permute in an e-mail address; it gets a keyed digest as local part, and example.invalid as domain.

The network over Z_a x Z_b (a * b = the format's size) adds in turn a keyed hash of one half to the
other, so no cycle walking is needed. Each value is permuted; a value can by chance (1 in the size) be its
own pseudonym.

Found are e-mail and IPv4 addresses, account numbers (IBAN), card numbers, social security numbers,
international phone numbers with + and North American ones, and dates of digits with two-digit months
and days. Not found: IPv6, other national phone numbers, dates with month names or one-digit parts, names.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, named

ROUNDS = 8
#: Where a session names its key; pseudonyms can be undone by whoever has it, so none is in the code.
KEY_SETTING = "spark.quire.pseudonym.key"

BEFORE, AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "iban": BEFORE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + AFTER,
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}(?<d>[-/.])[0-9]{2}\k<d>[0-9]{2}|[0-9]{2}(?<e>[-/.])[0-9]{2}\k<e>[0-9]{4})(?![\p{L}\p{N}]|[-/.][0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}|[2-9][0-9]{2}(?<f>[.-])[2-9][0-9]{2}\k<f>[0-9]{4})" + AFTER,
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?<g>[ -])[0-9]{4}\k<g>[0-9]{4}\k<g>[0-9]{1,7}|3[0-9]{3}(?<h>[ -])[0-9]{6}\k<h>[0-9]{5})" + AFTER,
}
#: In one pattern, what stands first is what most places of a text fail fastest.
PATTERN = f"(?=[0-9+(])(?:{'|'.join(KINDS[k] for k in ('ip', 'date', 'ssn', 'phone', 'card'))})|(?=[A-Z][A-Z][0-9])(?:{KINDS['iban']})|{KINDS['email']}"
#: Every value has one of these letters; texts without any are passed on at once.
MARKS = "[0-9@]"

#: 400 Gregorian years, 189 * 773 days
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _permuted(value: Column, a: Column | int, b: Column | int, key: str, tag: Column) -> Column:
    """The image of value, 0 <= value < a * b, under the network."""
    given = F.struct(value.alias("v"), *((x if isinstance(x, Column) else F.lit(x).cast("long")).alias(n) for n, x in (("a", a), ("b", b))), tag.alias("t"))

    def network(x: Column) -> Column:
        def noise(half: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), x["t"], i.cast("string"), half.cast("string")), 256)
            return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

        def turn(at: Column, i: Column) -> Column:
            left, right = at["l"], at["r"]
            return F.when(i % 2 == 0, F.struct(((left + noise(right, i)) % x["a"]).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), ((right + noise(left, i)) % x["b"]).alias("r")))

        start = F.struct(_div(x["v"], x["b"]).alias("l"), (x["v"] % x["b"]).alias("r"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, lambda at: at["l"] * x["b"] + at["r"])

    return _let(given, network)


def _div(x: Column, y: Column) -> Column:
    """Whole-number quotient, exact for any long."""
    return F.call_function("div", x, y)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _long(text: Column) -> Column:
    return text.cast("long")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced, one by one, by `digits`."""
    return _let(digits, lambda d: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(d, F.length(_digits(F.substr(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""))


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _digit_string(digits: Column, key: str, tag: Column) -> Column:
    """A permutation of the digit strings of one length (2 to 18)."""

    def permuted(d: Column) -> Column:
        n = F.length(d)
        low = _div(n, F.lit(2)).cast("int")
        return F.lpad(_permuted(_long(d), _pow10(n - low), _pow10(low), key, F.concat(tag, n.cast("string"))).cast("string"), n, "0")

    return _let(digits, permuted)


def _luhn(digits: Column) -> Column:
    """The Luhn sum (mod 10) of a digit string."""
    n = F.length(digits)
    parts = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, _div(2 * c.cast("int"), F.lit(10)).cast("int") + (2 * c.cast("int")) % 10).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda x, y: x + y) % 10


def _mod97(text: Column) -> Column:
    """ISO 7064 remainder of an account number: its first four letters go last, letters count from 10."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda x, c: F.when(c.rlike("[0-9]"), (x * 10 + F.ascii(c) - 48) % 97).otherwise((x * 100 + F.ascii(c) - 55) % 97))


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = _digit_string(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
        checked = _let(body, lambda x: F.concat(x, ((10 - _luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
        return F.when(_luhn(d) == 0, _refill(m, checked))

    return _let(_digits(m), made)


def _iban(m: Column, key: str) -> Column:
    """The account's digits in two halves, each permuted with the other's result as tag."""
    plain = F.replace(m, F.lit(" "))
    tail = F.substr(plain, F.lit(5))

    def made(digits: Column) -> Column:
        k = _div(F.length(digits), F.lit(2)).cast("int")
        left, right = F.substr(digits, F.lit(1), k), F.substr(digits, k + 1)
        first = _digit_string(right, key, F.concat(F.lit("iban"), left))
        both = _let(first, lambda x: F.concat(_digit_string(left, key, F.concat(F.lit("iban"), x)), x))
        country = F.substr(plain, F.lit(1), F.lit(2))
        checked = _let(_refill(tail, both), lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0"), x))
        spaced = _let(checked, lambda new: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(new, F.length(F.replace(F.substr(m, F.lit(1), i + 1), F.lit(" "))), F.lit(1)))), ""))
        return F.when((_mod97(plain) == 1) & F.length(plain).between(15, 34) & (F.length(digits) >= 8), spaced)

    return _let(_digits(tail), made)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = F.forall(octets, lambda x: x <= 255)
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda x, y: x * 256 + y)
    new = _permuted(value, 65536, 65536, key, F.lit("ip"))
    return F.when(valid, _let(new, lambda x: F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])))


def _date(m: Column, key: str) -> Column:
    """Year first, or else day first, or else month first, as the calendar allows."""
    mark = F.regexp_extract(m, "[-/.]", 0)
    part = F.split(m, "[-/.]")
    first = F.length(part[0]) == 4

    def day(y: int, mo: int, d: int) -> Column:
        return F.concat_ws("-", part[y], part[mo], part[d]).try_cast("date")

    def moved(d: Column) -> Column:
        at = F.datediff(d, F.lit(FIRST_DAY).cast("date")).cast("long")
        new = _permuted(at, *DAYS, key, F.lit("date"))
        return F.when(at.between(0, DAYS[0] * DAYS[1] - 1), F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")))

    ymd, dmy, mdy = day(0, 1, 2), day(2, 1, 0), day(2, 0, 1)
    made = F.when(first & ymd.isNotNull(), _joined(moved(ymd), mark, "yyyy", "MM", "dd"))
    made = made.when(~first & dmy.isNotNull(), _joined(moved(dmy), mark, "dd", "MM", "yyyy"))
    return made.when(~first & mdy.isNotNull(), _joined(moved(mdy), mark, "MM", "dd", "yyyy"))


def _joined(day: Column, mark: Column, *fields: str) -> Column:
    return _let(day, lambda d: F.concat(*[x for f in fields for x in (F.date_format(d, f), mark)][:-1]))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (_long(F.split(m, "-")[i]) for i in range(3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    at = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    new = _permuted(at * 9999 + serial - 1, 898 * 99, 9999, key, F.lit("ssn"))

    def written(x: Column) -> Column:
        high = _div(x, F.lit(9999))
        a = _div(high, F.lit(99))
        a = a + F.when(a >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((high % 99 + 1).cast("string"), 2, "0"), F.lpad((x % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(new, written))


def _phone(m: Column, key: str) -> Column:
    """North American numbers within their plan; others keep their country code (the digits before the
    first mark, or one digit) and have the rest permuted."""
    d = _digits(m)
    own = F.when(~m.startswith("+"), d).when((F.length(d) == 11) & d.startswith("1"), F.substr(d, F.lit(2)))
    area, office, line = _long(F.substr(own, F.lit(1), F.lit(3))), _long(F.substr(own, F.lit(4), F.lit(3))), _long(F.substr(own, F.lit(7)))
    american = (F.length(own) == 10) & (area >= 200) & (office >= 200)
    new = _permuted(((area - 200) * 800 + office - 200) * 10_000 + line, 80_000, 80_000, key, F.lit("phone"))

    def written(x: Column) -> Column:
        high = _div(x, F.lit(10_000))
        return F.concat((_div(high, F.lit(800)) + 200).cast("string"), (high % 800 + 200).cast("string"), F.lpad((x % 10_000).cast("string"), 4, "0"))

    code = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})[ .(-]", 1))
    code = F.when(code > 0, code).otherwise(1)
    rest = _digit_string(F.substr(d, code + 1), key, F.concat(F.lit("phone"), F.substr(d, F.lit(1), code)))
    made = F.when(american, _refill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _let(new, written))))
    return made.when(m.startswith("+") & F.length(d).between(8, 15), _refill(m, F.concat(F.substr(d, F.lit(1), code), rest)))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 20), F.lit("@example.invalid"))


MAKERS: dict[str, Callable[[Column, str], Column]] = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value; the value itself if it is not valid.

    A match may have the form of several kinds; the first that validates it counts.
    """
    made = None
    for kind, pattern in KINDS.items():
        is_kind = m.rlike(f"^(?:{pattern})$")
        got = F.when(is_kind, MAKERS[kind](m, key))
        made = got if made is None else F.coalesce(made, got)
    return F.coalesce(made, m)


def session_key(spark: SparkSession) -> str:
    """The session's key (KEY_SETTING); where none is set, a random one, set for the rest of the session, so
    that equal values are linked within it."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def with_pseudonyms(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pii") -> DataFrame:
    """df with text_col pseudonymised, and count_col: how many values were replaced (None: no such column).

    All other columns and all rows are kept, whatever the columns' names (one called count_col is
    replaced); a null text stays null with count 0; repeated rows and an empty table stay as they are. One
    pass, no shuffle; texts of any length.
    """
    names = [c for c in df.columns if c != count_col]
    found_name, new_name = fresh(df.columns, "_pii_found"), fresh(df.columns, "_pii_new")
    text, found, new = named(text_col), F.col(found_name), F.col(new_name)
    matches = F.when(text.rlike(MARKS), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    made = df.withColumn(found_name, matches).withColumn(new_name, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    parts = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(parts, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    out = [F.when(new.isNull(), text).otherwise(joined).alias(c) if c == text_col else named(c) for c in names]
    return made.select(*out, *([F.when(new.isNull(), 0).otherwise(changed).alias(count_col)] if count_col else []))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and n_pii of every document, under the session's key; rules as in with_pseudonyms."""
    return with_pseudonyms(documents(spark, sf_dir), session_key(spark)).select("doc_id", "text", "n_pii")
