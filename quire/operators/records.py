"""Small rules over catalogue records, scorer answers and displayed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip

# fixed values
FORBIDDEN = '\\\\/:*?"<>|'
PATH_LETTERS, BAR, CHAPTER_BYTES = 150, 40, 7500
PERMISSIVE = [".+", ".", ".*"]
SCORE = r"0?\.[0-9]+|1\.0|0|1"
NO_SCORE = 0.5


def sufficient(author: Column, genre: Column) -> Column:
    """Whether a record needs no look-up: an author or a genre that is neither blank nor unknown."""
    told = lambda c: F.coalesce((strip(c) != "") & ~F.contains(c, F.lit("Unknown")), F.lit(False))
    return told(author) | told(genre)


def count_confidence(expected: Column, found: Column) -> Column:
    return F.when((expected > 0) & (F.abs(expected - found) > 5), 0.5).otherwise(1.0)


def output_path(title: Column) -> Column:
    """A file name without forbidden characters, of at most 150 before its one extension."""
    plain = F.substring(strip(F.regexp_replace(title, f"[{FORBIDDEN}]", "")), 1, PATH_LETTERS)
    return F.when(F.endswith(plain, F.lit(".epub")), plain).otherwise(F.concat(plain, F.lit(".epub")))


def display_title(number: Column, title: Column) -> Column:
    return F.when(title.rlike("[0-9]"), title).otherwise(F.concat(F.lit("["), number.cast("string"), F.lit("] "), title))


def score_of(answer: Column) -> Column:
    """The first number from 0 to 1 in a free answer; one half if there is none."""
    found = F.nullif(F.regexp_extract(answer, SCORE, 0), F.lit("")).cast("double")
    # least and greatest pass over nulls, so a missing number is told first
    return F.when(found.isNull(), NO_SCORE).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), found)))


def unfenced(answer: Column) -> Column:
    """What stands in an answer's code fence, or the whole answer."""
    inside = F.regexp_extract(answer, "(?s)```(?:json)?[ \t\r\n]*(.*?)[ \t\r\n]*```", 1)
    return strip(F.coalesce(F.nullif(inside, F.lit("")), answer))


def salvaged(answer: Column, schema: str, fallback: Column, title: str = "title") -> Column:
    """The outermost object of a free answer, with missing ends added; one with only the title if it can't be read."""
    start = F.regexp_extract(answer, r"(?s)\{.*", 0)
    whole = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    text = F.when(whole != "", whole).otherwise(start)
    missing = F.length(F.regexp_replace(text, r"[^{]", "")) - F.length(F.regexp_replace(text, r"[^}]", ""))
    read = F.from_json(F.concat(text, F.repeat(F.lit("}"), F.greatest(F.lit(0), missing))), schema)
    return F.when((text != "") & read[title].isNotNull(), read).otherwise(F.from_json(F.to_json(F.struct(fallback.alias(title))), schema))


def size_shown(size: Column) -> Column:
    """Megabytes with two decimals, or kilobytes with one; further decimals are cut."""
    mb, kb = F.floor(size * 100 / (1 << 20)), F.floor(size * 10 / 1024)
    whole = lambda x, n: F.floor(x / n).cast("string")
    return F.when(size >= 1 << 20, F.concat(whole(mb, 100), F.lit("."), F.lpad((mb % 100).cast("string"), 2, "0"), F.lit(" MB"))).otherwise(F.concat(whole(kb, 10), F.lit("."), (kb % 10).cast("string"), F.lit(" KB")))


def bar(value: Column, most: Column) -> Column:
    n = F.coalesce(F.floor(value * BAR / F.nullif(most, F.lit(0))), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), BAR - n))


def estimated_chapters(size: Column) -> Column:
    return F.floor(size / CHAPTER_BYTES)


def outcome(answer: Column, reason: Column) -> Column:
    """What a scorer's answer counts as: censored, over the limit (to be tried again), empty or done."""
    return F.when(reason.isin("3", "5", "SAFETY"), "censored").when(F.contains(answer, F.lit("429")) | F.contains(F.lower(answer), F.lit("quota")), "retry").when(F.coalesce(strip(answer), F.lit("")) == "", "empty").otherwise("done")


def larger_cover(old: Column, new: Column) -> Column:
    """The size of the cover that stays: the new one unless it is under four fifths of the old."""
    return F.when(old.isNull() | (new >= 0.8 * old), new).otherwise(old)


def without_unknown(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "Unknown", c)


def hinted_range(span: Column, hint: Column) -> Column:
    return F.when(F.coalesce(span, F.lit("")).isin("", "Unknown"), F.coalesce(hint, without_unknown(span))).otherwise(span)


def line_of(positions: DataFrame, lines: DataFrame, also: tuple[str, ...] = (), of: tuple[str, ...] = ()) -> DataFrame:
    """positions: doc_id, pos; lines: doc_id, line_num, char_pos. The last line that starts at or before each
    position (one past the end is in the last line): both are put in one order, and lines are carried on. `also`
    are further columns of positions, `of` those of lines."""
    line = F.struct("line_num", *of)
    own, kinds = lines.select("doc_id", F.col("char_pos").alias("at"), F.lit(0).alias("kind"), line.alias("l")), dict(positions.dtypes)
    own = own.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in also])
    both = own.unionByName(positions.select("doc_id", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(own.schema["l"].dataType).alias("l"), *also))
    order = Window.partitionBy("doc_id").orderBy("at", "kind", F.col("l.line_num").asc_nulls_last())
    return both.withColumn("l", F.last("l", True).over(order)).filter("kind = 1").select("doc_id", F.col("at").alias("pos"), "l.*", *also)


def numbered_by_type(chapters: DataFrame, title: str = "title") -> DataFrame:
    """chapters: doc_id, cid, chapter_type, title. Types in the order in which they are first seen, chapters
    in theirs; `shown` is the title behind its number in that order."""
    first = F.min("cid").over(Window.partitionBy("doc_id", "chapter_type"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_first", "cid"))
    out = chapters.withColumn("_first", first).withColumn("number", number)
    digits = F.when(F.col("number") < 1000, F.lpad(F.col("number").cast("string"), 3, "0")).otherwise(F.col("number").cast("string"))
    return out.withColumn("shown", F.concat(digits, F.lit(". "), F.col(title))).drop("_first")


def decided(titles: DataFrame, decisions: DataFrame) -> DataFrame:
    """titles left joined with decisions (title, accepted, renamed): rejected ones go, renamed ones change."""
    d = decisions.select("title", "accepted", "renamed")
    return titles.join(d, "title", "left").filter(F.coalesce("accepted", F.lit(True))).withColumn("title", F.coalesce("renamed", "title")).drop("accepted", "renamed")


def renamed(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """names: id, name; dictionary: original, new. result: to rename, done (it has its new name) or unknown."""
    to, done = dictionary.select(F.col("original").alias("name"), "new"), dictionary.select(F.col("new").alias("name"), F.lit(True).alias("_done")).distinct()
    out = names.join(to, "name", "left").join(done, "name", "left")
    return out.select("id", "name", "new", F.when(F.col("new").isNotNull(), "rename").when(F.col("_done"), "done").otherwise("unknown").alias("result"))


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls: model, tokens; prices (a short list): prefix, price for 1000 tokens. The longest prefix counts."""
    models = calls.groupBy("model").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
    fits = models.join(prices, F.startswith(F.col("model"), F.col("prefix")), "left")
    best = fits.groupBy("model", "tokens", "calls").agg(F.max(F.struct(F.length("prefix").alias("n"), "price")).alias("b"))
    return best.select("model", "calls", "tokens", (F.col("tokens") * F.coalesce("b.price", F.lit(0.0)) / 1000).alias("cost"))


def upserted(existing: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """existing with the rows of scanned: a key's scanned row replaces the existing one. `change` says what happened."""
    old = existing.withColumn("_rank", F.lit(1))
    new = scanned.withColumn("_rank", F.lit(0))
    w = Window.partitionBy(key).orderBy("_rank")
    both = old.unionByName(new).withColumn("_n", F.row_number().over(w)).withColumn("_had", F.max("_rank").over(Window.partitionBy(key)))
    change = F.when((F.col("_rank") == 0) & (F.col("_had") == 1), "updated").when(F.col("_rank") == 0, "inserted").otherwise("kept")
    return both.filter("_n = 1").withColumn("change", change).drop("_rank", "_n", "_had")


def zipped_hints(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, line_num, line, hint. answers: doc_id, answer: a line a hint, `number | hint` for the line of that number
    (from 1), or without a number for the line at its own place. A numbered hint beats one by place, and of two
    the first counts; lines without a hint have null. Repeated lines keep their own hints.
    """
    said = answers.select("doc_id", F.posexplode(F.split("answer", "\n")).alias("place", "said")).filter(strip(F.col("said")) != "")
    cut = F.regexp_extract("said", f"^[{SPACE}]*([0-9]+)[{SPACE}]*[|](.*)$", 1)
    number = F.nullif(cut, F.lit("")).try_cast("int")
    hint = F.when(number.isNotNull(), strip(F.regexp_extract("said", "[|](.*)$", 1))).otherwise(strip(F.col("said")))
    each = said.select("doc_id", F.coalesce(number - 1, F.col("place")).alias("line_num"), F.struct(number.isNull().alias("by_place"), F.col("place").alias("place"), hint.alias("hint")).alias("h"))
    best = each.groupBy("doc_id", "line_num").agg(F.min("h").alias("h")).select("doc_id", "line_num", F.col("h.hint").alias("hint"))
    return lines.join(best, ["doc_id", "line_num"], "left").select("doc_id", "line_num", "line", "hint")


def cached(kept: DataFrame, schema: str) -> DataFrame:
    """kept (keys, value: JSON) with the fields of schema; a damaged value, and a field that is not there, is null."""
    got = kept.withColumn("_v", F.from_json("value", schema))
    return got.select(*[c for c in kept.columns if c != "value"], "_v.*")
