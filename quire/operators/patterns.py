"""Choosing heading patterns for each document from a library, towards an expected count.

A line's matches with the whole library are one bit mask; a document's lines are pre-aggregated by mask
(matches, end of the last one), so that any union of patterns is weighed without reading lines again.
The library is a short list of regular expressions, at most 31.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip
from .boundaries import drop_close
from .lines import with_offsets
from .titles import END_WORDS, is_end_marker

# fixed values
LIBRARY = [r"(?:제\s*)?\d+\s*화", r"\d+\s*화", r"\[\d+\]", r"Chapter\s*\d+"]
FLOOD_SHARE, FLOOD, ENOUGH, SLACK, COVERED, TAIL = 1.5, 1000, 0.95, 1.05, 0.99, 20_000
GAPS, RETRIES, CHUNK, CHUNKS = 3, 10, 20_000, 5


def relaxed(pattern: str) -> str:
    """The pattern with digits optional and numbers in brackets optional as wholes."""
    plain = pattern.replace(r"\d+", r"\d*")
    return re.sub(r"\\?\(\\d[+*]\\?\)", lambda m: r"(?:\(\d*\))?", plain)


def without_end_markers(pattern: str) -> str:
    """The pattern behind a look-ahead that rejects lines ending in an end word."""
    if "(?!" in pattern:
        return pattern
    return f"(?!.*(?:{'|'.join(map(re.escape, END_WORDS))})\\s*[>】\\])]*\\s*$){pattern}"


def pattern_of(title: Column) -> Column:
    """An expression for titles of the same shape: literal but for its numbers."""
    return F.regexp_replace(F.regexp_replace(title, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), "[0-9]+", r"\\d+")


def clean_matches(lines: DataFrame, pattern: str, gap: int = 500) -> DataFrame:
    """doc_id, line_num, pos of a pattern's matches, less end markers and those closer than `gap` characters."""
    body = strip(F.col("line"))
    found = with_offsets(lines).filter(F.col("line").rlike(pattern) & ~is_end_marker(body))
    return drop_close(found.select("doc_id", "line_num", F.col("char_pos").alias("pos")), gap=gap)


def auto_fixed(lines: DataFrame, expected: DataFrame, pattern: str) -> DataFrame:
    """doc_id, expected, plain (clean matches), relaxed (those of the relaxed pattern), is_relaxed, matches.

    The relaxed pattern is taken where the plain one finds under 95 % of what is expected, and it finds more,
    but no more than 105 %. expected: doc_id, expected.
    """

    def counted(p: str, name: str) -> DataFrame:
        return clean_matches(lines, p).groupBy("doc_id").agg(F.count("*").alias(name))

    out = expected.join(counted(pattern, "plain"), "doc_id", "left").join(counted(relaxed(pattern), "relaxed"), "doc_id", "left").fillna(0, ["plain", "relaxed"])
    better = (F.col("expected") > 0) & (F.col("plain") < F.col("expected") * ENOUGH) & (F.col("relaxed") > F.col("plain")) & (F.col("relaxed") <= F.col("expected") * SLACK)
    return out.withColumn("is_relaxed", better).withColumn("matches", F.when(better, F.col("relaxed")).otherwise(F.col("plain")))


def profiles(lines: DataFrame, library: list[str] = LIBRARY) -> DataFrame:
    """doc_id, size (bytes), masks: array of (mask, n, last) of the lines that any pattern matches."""
    rows = with_offsets(lines)
    bits = [F.when(F.col("line").rlike(p), 1 << i).otherwise(0) for i, p in enumerate(library)]
    mask = reduce(lambda a, b: a + b, bits)
    end = F.col("byte_pos") + F.octet_length("line")
    per_mask = rows.select("doc_id", mask.alias("mask"), "byte_pos", end.alias("end")).groupBy("doc_id", "mask").agg(F.count("*").alias("n"), F.max("byte_pos").alias("last"), F.max("end").alias("end"))
    return per_mask.groupBy("doc_id").agg(F.max("end").alias("size"), F.sort_array(F.collect_list(F.when(F.col("mask") > 0, F.struct("mask", "n", "last")))).alias("masks"))


def matches(masks: Column, chosen: Column) -> Column:
    """Lines that any of the chosen patterns (a mask) matches."""
    return F.aggregate(masks, F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(chosen) > 0, x["n"]).otherwise(0))


def last_match(masks: Column, chosen: Column) -> Column:
    return F.aggregate(masks, F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.when(x["mask"].bitwiseAND(chosen) > 0, x["last"]).otherwise(0)))


def best_patterns(profile: DataFrame, expected: DataFrame, library: list[str] = LIBRARY) -> DataFrame:
    """doc_id, expected, first (number of the pattern to start with, -1: none), chosen (mask), found, coverage, covered.

    The start is the pattern with the most matches among those that do not flood (more than 1.5 times what
    is expected, or 1000). Up to ten further patterns are added while the last match lies too early in the
    document and they move it on. expected: doc_id, expected.
    """
    m, k = F.col("masks"), F.col("expected")
    options = F.array(*[F.struct(matches(m, F.lit(1 << i)).alias("n"), F.lit(-i).alias("i")) for i in range(len(library))])
    fit = F.filter(options, lambda o: (o["n"] > 0) & ((k <= 0) | ((o["n"] <= k * FLOOD_SHARE) & (o["n"] <= FLOOD))))
    first = F.coalesce(-F.array_max(fit)["i"], F.lit(-1))
    rows = profile.join(expected, "doc_id").withColumn("first", first)

    def covers(last: Column) -> Column:
        return (last > F.col("size") * COVERED) | (F.col("size") - last < TAIL)

    start = F.struct(F.when(F.col("first") < 0, 0).otherwise(F.get(F.array(*[F.lit(1 << i) for i in range(len(library))]), F.col("first"))).alias("c"), F.lit(0).alias("tries"))

    def step(a: Column, bit: Column) -> Column:
        wider = a["c"].bitwiseOR(bit)
        takes = (a["c"] > 0) & (a["tries"] < RETRIES) & ~covers(last_match(m, a["c"])) & (last_match(m, wider) > last_match(m, a["c"]))
        return F.struct(F.when(takes, wider).otherwise(a["c"]).alias("c"), (a["tries"] + F.when(takes, 1).otherwise(0)).alias("tries"))

    chosen = F.aggregate(F.array(*[F.lit(1 << i) for i in range(len(library))]), start, step, lambda a: a["c"])
    out = rows.withColumn("chosen", chosen).withColumn("found", matches(m, F.col("chosen"))).withColumn("last", last_match(m, F.col("chosen")))
    return out.select("doc_id", "expected", "first", "chosen", "found", F.coalesce(F.col("last") / F.nullif("size", F.lit(0)), F.lit(0.0)).alias("coverage"), ((F.col("found") > 0) & covers(F.col("last"))).alias("covered"), "size", "masks")


def refined(best: DataFrame, library: list[str] = LIBRARY) -> DataFrame:
    """best_patterns with chosen and found moved towards what is expected: doc_id, expected, chosen, found.

    Too many matches: the first pattern that gives the exact count replaces the choice. Too few: up to three
    patterns that raise the count without passing what is expected are added; below 95 % one more may pass
    it by 5 %.
    """
    m, k, bits = F.col("masks"), F.col("expected"), F.array(*[F.lit(1 << i) for i in range(len(library))])
    exact = F.get(F.filter(bits, lambda b: matches(m, b) == k), F.lit(0))

    def grown(start: Column, most: int, upto: Column) -> Column:
        def step(a: Column, bit: Column) -> Column:
            wider = a["c"].bitwiseOR(bit)
            n = matches(m, wider)
            takes = (a["t"] < most) & (n > matches(m, a["c"])) & (n <= upto)
            return F.struct(F.when(takes, wider).otherwise(a["c"]).alias("c"), (a["t"] + F.when(takes, 1).otherwise(0)).alias("t"))

        return F.aggregate(bits, F.struct(start.alias("c"), F.lit(0).alias("t")), step, lambda a: a["c"])

    c = F.col("chosen")
    out = best.withColumn("chosen", F.when(F.col("found") > k, F.coalesce(exact, c)).when(F.col("found") < k, grown(c, GAPS, k)).otherwise(c))
    short = (k > 0) & (matches(m, F.col("chosen")) < k * ENOUGH)
    out = out.withColumn("chosen", F.when(short, grown(F.col("chosen"), 1, k * SLACK)).otherwise(F.col("chosen")))
    return out.select("doc_id", "expected", "chosen", matches(m, F.col("chosen")).alias("found"))


def line_chunks(lines: DataFrame, size: int = CHUNK, most: int | None = CHUNKS) -> DataFrame:
    """doc_id, chunk_no, first, upto (line numbers, upto not inside), chars: whole lines filled up to `size`
    characters a chunk, the first `most` chunks of a document, or all (a longer line is a chunk of its own)."""
    n = lines.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_num", (F.length("line") + 1).alias("n")))), lambda x: x["n"]).alias("n"))
    kind = "struct<done:array<struct<first:int,upto:int,chars:int>>,first:int,at:int,chars:int>"
    start = F.struct(F.array().cast("array<struct<first:int,upto:int,chars:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("chars")).cast(kind)

    def closed(a: Column) -> Column:
        return F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["at"].alias("upto"), a["chars"].alias("chars"))))

    def step(a: Column, x: Column) -> Column:
        full = (a["chars"] > 0) & (a["chars"] + x > size)
        over = F.size(a["done"]) >= most if most else F.lit(False)
        return F.when(over, a).when(full, F.struct(closed(a).alias("done"), a["at"].alias("first"), (a["at"] + 1).alias("at"), x.alias("chars")).cast(kind)).otherwise(F.struct(a["done"].alias("done"), a["first"].alias("first"), (a["at"] + 1).alias("at"), (a["chars"] + x).alias("chars")).cast(kind))

    cut = F.aggregate("n", start, step, lambda a: F.slice(F.when(F.size(a["done"]) < most, closed(a)).otherwise(a["done"]), 1, most) if most else closed(a))
    return n.select("doc_id", F.posexplode(cut).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.*")


def gap_titles(scored: DataFrame, gaps: DataFrame) -> DataFrame:
    """Lines (doc_id, line_num, byte_pos, confidence) that lie inside a gap (doc_id, start, end) of their
    document; a document has a few gaps."""
    inside = (scored["byte_pos"] > gaps["start"]) & (scored["byte_pos"] < gaps["end"])
    return scored.join(gaps, (scored["doc_id"] == gaps["doc_id"]) & inside, "left_semi")


# fixed values: attempts, what is looked at behind the last match, a general pattern and the share it must reach
ATTEMPTS, BEHIND, GENERAL, GENERAL_SHARE = 10, 30_000, r"[0-9]+\s*화", 0.9


def marks(lines: DataFrame, library: list[str] = LIBRARY) -> DataFrame:
    """doc_id, size (bytes), general (the last match of the general pattern) and marks: (pos, mask) of the lines that
    any pattern matches, by position; a document has one for each such line."""
    rows = with_offsets(lines)
    mask = reduce(lambda a, b: a + b, [F.when(F.col("line").rlike(p), 1 << i).otherwise(0) for i, p in enumerate(library)])
    if not any(re.search(r"\\[1-9k]", p) for p in library):  # references to groups would count those of other patterns
        mask = F.when(F.col("line").rlike("|".join(f"(?:{p})" for p in library)), mask).otherwise(0)
    mark = F.when(F.col("mask") > 0, F.struct(F.col("byte_pos").alias("pos"), "mask"))
    general = F.when(F.col("line").rlike(GENERAL.replace("\\s", f"[{SPACE}]")), F.col("byte_pos"))
    seen = rows.select("doc_id", "byte_pos", (F.col("byte_pos") + F.octet_length("line")).alias("end"), mask.alias("mask"), general.alias("g"))
    return seen.groupBy("doc_id").agg(F.max("end").alias("size"), F.coalesce(F.max("g"), F.lit(0)).alias("general"), F.sort_array(F.collect_list(mark)).alias("marks"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def adaptive(marked: DataFrame, start: Column, library: list[str] = LIBRARY, attempts: int = ATTEMPTS, behind: int = BEHIND, share: float = COVERED, tail: int = TAIL) -> DataFrame:
    """doc_id, chosen (a mask), attempts, last (where the last match lies), covered, general of documents with text.

    From the choice `start` (a mask, 0: none) matching goes on behind the last match: of the `behind` bytes after
    it the pattern with the most matches (the first of equals) is added, if the last match moves on. It ends
    when the last match lies behind `share` of the text or less than `tail` bytes before its end, or after
    `attempts`. Where nothing was chosen and the general pattern reaches far enough, general is true.
    """
    bits = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(-i).alias("at")) for i in range(len(library))])

    def last_of(mask: Column) -> Column:
        return F.aggregate("marks", F.lit(0).cast("long"), lambda a, m: F.when(m["mask"].bitwiseAND(mask) > 0, F.greatest(a, m["pos"])).otherwise(a))

    def reached(last: Column) -> Column:
        return (last > F.col("size") * share) | (F.col("size") - last < tail)

    def step(a: Column, _: Column) -> Column:
        near = F.filter("marks", lambda m: (m["pos"] > a["last"]) & (m["pos"] <= a["last"] + behind))
        count = _let(near, lambda near: F.transform(bits, lambda b: F.struct(F.size(F.filter(near, lambda m: m["mask"].bitwiseAND(b["bit"]) > 0)).alias("n"), b["at"].alias("at"), b["bit"].alias("bit"))))
        wider = _let(F.array_max(count), lambda best: F.when(best["n"] > 0, a["c"].bitwiseOR(best["bit"])).otherwise(a["c"]))

        def moved(wide: Column, further: Column) -> Column:
            takes = further > a["last"]
            return F.struct(F.when(takes, wide).otherwise(a["c"]).alias("c"), F.when(takes, further).otherwise(a["last"]).alias("last"), (a["tries"] + 1).alias("tries"))

        # the choice and its last match are named in each other: computed where they are named, a pass over the marks
        # was made for every mark
        return F.when(reached(a["last"]), a).otherwise(_let(wider, lambda wide: _let(last_of(wide), lambda further: moved(wide, further))))

    first = F.struct(start.alias("c"), last_of(start).alias("last"), F.lit(0).alias("tries"))
    end = marked.filter("size > 0").withColumn("_end", F.aggregate(F.sequence(F.lit(1), F.lit(attempts)), first, step))
    none = F.col("_end")["c"] == 0
    general = none & (F.col("general") > F.col("size") * GENERAL_SHARE)
    return end.select("doc_id", F.col("_end.c").alias("chosen"), F.col("_end.tries").alias("attempts"), F.col("_end.last").alias("last"), reached(F.col("_end.last")).alias("covered"), general.alias("general"))
