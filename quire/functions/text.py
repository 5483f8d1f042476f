"""Text helpers with the same meaning in Spark and in the SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware string stripping sees it, for use inside a character class.
SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = "一-鿿"


#: The characters of SPACE, one by one.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def count_letters(c: Column, letters: str) -> Column:
    """How many characters of c are in the character class `letters` ([..]). regexp_count makes an array of all
    matches; here runs are cut out."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{letters}+", ""))


def byte_truncate(c: Column, limit: int) -> Column:
    """The longest prefix of at most `limit` UTF-8 bytes that cuts no character."""
    head = F.substring(c, 1, limit)
    sizes = F.transform(F.split(head, ""), lambda x: F.octet_length(x))
    kept = F.aggregate(sizes, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")), lambda a, x: F.struct((a["bytes"] + x).alias("bytes"), F.when(a["bytes"] + x <= limit, a["n"] + 1).otherwise(a["n"]).alias("n")), lambda a: a["n"])
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.substr(c, F.lit(1), kept))


def one_decimal(c: Column) -> Column:
    """A number below 1000 with one decimal, half-way cases by the binary value."""
    return F.format_number(c, 1)


def has_upper_only(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")
