"""Reading parts of texts, lists of files, mapping files and sectioned prompt files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# fixed values
HEAD_BYTES, WHOLE, RANGE_PARTS, CHUNK, LEAST_BYTES = 20_480, 2 << 20, 10, 32_768, 512
SKIP_MARK = "\n\n[...RETRY_SAMPLE_SKIP...]\n\n"
NOT_LISTED = [".exe", ".bat", ".ps1", ".js", ".json", ".lnk", ".db"]


def head_bytes(text: Column, size: int = HEAD_BYTES) -> Column:
    """The whole characters in the first `size` UTF-8 bytes; null for null."""
    whole = text.cast("binary")
    return F.coalesce(*[F.try_validate_utf8(F.substring(whole, 1, size - cut).cast("string")) for cut in range(4)])


def tail_bytes(text: Column, size: int = HEAD_BYTES) -> Column:
    """The whole characters in the last `size` UTF-8 bytes; null for null."""
    whole = text.cast("binary")
    starts = [F.greatest(F.lit(1), F.octet_length(text) - size + 1 + cut) for cut in range(4)]
    return F.coalesce(*[F.try_validate_utf8(F.substr(whole, at).cast("string")) for at in starts])


def _after_line(text: Column, at: Column, size: Column) -> Column:
    """size characters behind the end of the line that holds place `at` (0-based); empty without such an end."""
    end = F.position(F.lit("\n"), text, (at + 1).cast("int"))
    return F.when(end > 0, F.substr(text, end + 1, size.cast("int"))).otherwise("")


def range_sample(text: Column, start: Column, length: Column | None = None, whole: int = WHOLE, chunk: int = CHUNK, parts: int = RANGE_PARTS) -> Column:
    """What is in `length` characters from `start` on (to the end without it), the cut line left out: all of it
    below `whole`, else `parts` evenly spaced chunks. Empty past the end, null for a null text."""
    left = F.length(text) - start
    size = left if length is None else F.when((length > 0) & (length < left), length).otherwise(left)
    step = F.floor(size / parts)
    pieces = [_after_line(text, start + step * i, F.lit(chunk)) for i in range(parts)]
    # the first piece stays, whatever is in it
    joined = reduce(lambda a, p: F.concat(a, F.when(p != "", F.concat(F.lit(SKIP_MARK), p)).otherwise("")), pieces[1:], pieces[0])
    return F.when(text.isNull(), None).when(size <= 0, "").when(size < whole, _after_line(text, start, size)).otherwise(joined)


def mapping_pairs(lines: DataFrame) -> DataFrame:
    """lines: doc_id, line_num, line. old and new of two-line records, the second line behind an arrow; blank
    lines and rules of `=` are passed over, and an arrow without an old line gives nothing."""
    body = lines.withColumn("line", strip(F.col("line"))).filter("line <> '' and not startswith(line, '=')")
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_num"))
    arrow = lambda c: F.startswith(c, F.lit("→"))
    pairs = body.withColumn("old", before).filter(arrow(F.col("line")) & F.col("old").isNotNull() & ~arrow(F.col("old")))
    return pairs.select("doc_id", "line_num", "old", strip(F.replace(F.col("line"), F.lit("→"), F.lit(""))).alias("new"))


def mapping_text(pairs: DataFrame, key: str) -> DataFrame:
    """key and text: the two-line records of each key's pairs (old, new), by old."""
    rows = F.sort_array(F.collect_list(F.struct("old", "new")))
    return pairs.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: F.concat(r["old"], F.lit("\n→ "), r["new"], F.lit("\n"))), "\n").alias("text"))


def sections(text: DataFrame, key: str) -> DataFrame:
    """key, kind (summary or plain), name and value of the sections `=== name ===` of text; of one name the last."""
    mark = "=== ([^\n]+) ==="
    names, values = F.regexp_extract_all("text", F.lit(mark), 1), F.split("text", mark, -1)
    flat = text.select(key, F.posexplode(F.arrays_zip(names.alias("name"), F.slice(values, 2, 1 << 20).alias("value"))).alias("pos", "s"))
    title = strip(F.col("s.name"))
    special = F.startswith(title, F.lit("summary_"))
    rows = flat.select(key, "pos", F.when(special, "summary").otherwise("plain").alias("kind"), F.when(special, F.replace(title, F.lit("summary_"), F.lit(""))).otherwise(title).alias("name"), strip(F.col("s.value")).alias("value"))
    return rows.groupBy(key, "kind", "name").agg(F.max_by("value", "pos").alias("value"))


def prompt_for(wanted: DataFrame, found: DataFrame, genre: str = "genre", general: str = "general") -> DataFrame:
    """wanted with `prompt`: the summary section of its genre (found: name, value), else the general one, else ''."""
    own = found.select(F.col("name").alias(genre), F.col("value").alias("_own"))
    usual = found.select(F.col("name").alias("_usually"), F.col("value").alias("_usual"))
    both = wanted.join(own, genre, "left").withColumn("_usually", F.lit(general)).join(usual, "_usually", "left")
    return both.withColumn("prompt", F.coalesce("_own", "_usual", F.lit(""))).drop("_own", "_usual", "_usually")


def listed(name: Column, size: Column) -> Column:
    """`name | size`: megabytes with up to two decimals from one on, else kilobytes with up to one."""
    shown = lambda unit, places: F.regexp_replace(F.bround(size / unit, places).cast("string"), r"\.0$", "")
    return F.concat(name, F.lit(" | "), F.when(F.bround(size / (1 << 20), 2) >= 1, F.concat(shown(1 << 20, 2), F.lit(" MB"))).otherwise(F.concat(shown(1 << 10, 1), F.lit(" KB"))))


def file_list(files: DataFrame) -> DataFrame:
    """The line of every file (file_name, ext, file_size) that is large enough and of no left-out kind."""
    return files.filter((F.col("file_size") >= LEAST_BYTES) & ~F.lower("ext").isin(NOT_LISTED)).withColumn("entry", listed(F.col("file_name"), F.col("file_size")))


def tags(text: Column) -> Column:
    """Tags of a JSON list, or of a list with commas; blank ones go. Null gives none."""
    given = F.coalesce(F.when(F.startswith(strip(text), F.lit("[")), F.from_json(strip(text), "array<string>")), F.split(F.coalesce(text, F.lit("")), ","))
    return F.filter(F.transform(given, strip), lambda t: t != "")


def chained(steps: DataFrame, key: str, order: list[str], result: Column, done: Column) -> DataFrame:
    """steps with `context`: the result of the step before, where that is done."""
    return steps.withColumn("context", F.lag(F.when(done, result)).over(Window.partitionBy(key).orderBy(*order)))


def completion(state: DataFrame, stages: list[str]) -> DataFrame:
    """Share of the rows that have each stage; 0 where there are none."""
    total = F.greatest(F.count("*"), F.lit(1))
    return state.agg(*[(F.coalesce(F.sum(s), F.lit(0)) / total).alias(s) for s in stages])
