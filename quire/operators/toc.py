"""Tables of contents: finding the stretch of lines that lists chapters, and taking it out.

The lines are looked at through bounded frames (20 lines ahead for density, 8 for the end), all in one
order by document and line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.text import SPACE, strip
from .headings import TOC_WORDS, by_language, is_form
from .lines import before, by_line

FRAME, STEP, SCANNED, THRESHOLD, LONGEST = 20, 3, 500, 30.0, 300
DECORATION = f"[—\\-=_*#【】\\[\\]《》<>「」『』（）(){SPACE}]"


def _decorated(words: list[str]) -> Column:
    """Whether body is one of the words but for decoration. It is taken off only lines with all letters that the
    words share."""
    shared = sorted(set.intersection(*map(set, words)))
    return reduce(Column.__and__, [F.contains("body", F.lit(x)) for x in shared] + [F.regexp_replace("body", DECORATION, "").isin(words)])


def toc_lines(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, language. Every line (a last line end opens one more) with its cues."""
    rows = docs.select("doc_id", "language", F.posexplode(F.split("text", "\n")).alias("line_num", "line"))
    body = strip(F.col("line"))
    out = rows.withColumn("body", body).withColumn("size", F.length("body"))
    lang = F.col("language")
    words = by_language(lang, *(((F.length("body") <= max(map(len, TOC_WORDS[k]))) & F.lower("body").isin([w.lower() for w in TOC_WORDS[k]])) | _decorated(TOC_WORDS[k]) for k in ("chinese", "english")))
    chapter = is_form(F.col("body"), lang, "chapter") | is_form(F.col("body"), lang, "volume")
    return out.select("doc_id", "line_num", "body", "size", words.alias("is_word"), chapter.alias("is_chapter"), (chapter & (F.col("size") < 80)).alias("is_entry"), F.right("body", F.lit(1)).isin(*"0123456789").alias("has_page"))


def window_scores(lines: DataFrame) -> DataFrame:
    """doc_id, line_num, entries, longest_run, short_share, score of the frames that start at each third line."""
    w = by_line().rowsBetween(0, FRAME - 1)
    entry, short = F.col("is_entry").cast("int"), F.col("size").between(6, 79).cast("int")
    runs = F.array_join(F.collect_list(F.col("is_entry").cast("int").cast("string")).over(w), "")
    near = lines.filter(F.col("line_num") < SCANNED + FRAME).withColumns({
        "entries": F.sum(entry).over(w),
        "longest_run": F.array_max(F.transform(F.split(runs, "0+"), lambda x: F.length(x))),
        "chars": F.sum("size").over(w),
        "short_share": F.sum(short).over(w) / F.count("*").over(w),
        "has_pages": F.max("has_page").over(w),
    })
    density = F.when(F.col("chars") > 100, F.col("entries") * 1000 / F.col("chars")).otherwise(0.0)
    score = F.when(density > 100, density * 0.5).otherwise(0.0) + F.when(F.col("entries") >= 5, F.col("entries") * 2.0).otherwise(0.0) + F.when(F.col("longest_run") >= 3, F.col("longest_run") * 10.0).otherwise(0.0)
    score = score + F.when(F.col("short_share") > 0.6, F.col("short_share") * 20.0).otherwise(0.0) + F.when(F.col("has_pages"), 15.0).otherwise(0.0) + F.greatest(F.lit(0), 50 - F.col("line_num")) * 0.2
    return near.filter((F.col("line_num") < SCANNED) & (F.col("line_num") % STEP == 0)).select("doc_id", "line_num", "entries", "longest_run", "short_share", score.alias("score"))


def chapter_runs(lines: DataFrame) -> DataFrame:
    """Runs of entry lines: doc_id, first, last, run."""
    group = F.col("line_num") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_num"))
    return lines.filter("is_entry").withColumn("_g", group).groupBy("doc_id", "_g").agg(F.min("line_num").alias("first"), F.max("line_num").alias("last"), F.count("*").alias("run")).drop("_g")


def toc_regions(lines: DataFrame) -> DataFrame:
    """doc_id, toc_start, toc_end (both inside) of the documents that have one."""
    lines = written(lines.drop("body"), "toc-lines")  # read three times; cues of texts are made once
    named = lines.filter("is_word").groupBy("doc_id").agg(F.min("line_num").alias("named"))
    dense = window_scores(lines).filter(F.col("score") > THRESHOLD).groupBy("doc_id").agg((-F.max(F.struct("score", (-F.col("line_num")).alias("n")))["n"]).alias("dense"))
    starts = named.join(dense, "doc_id", "full").select("doc_id", F.coalesce("named", "dense").alias("toc_start"))

    # what a line is to the search of the end: blank, long or middling running text, anything else
    code = F.when(F.col("size") == 0, "b").when(~F.col("is_chapter") & (F.col("size") > 100), "A").when(~F.col("is_chapter") & (F.col("size") > 50), "L").when(~F.col("is_chapter") & (F.col("size") > 15), "m").otherwise("x")
    coded = lines.select("doc_id", "line_num", "is_chapter", "size", code.alias("code")).join(starts, "doc_id").filter(F.col("line_num").between(F.col("toc_start") - 10, F.col("toc_start") + LONGEST + 9))
    seen = F.last(F.when(F.col("size") > 0, F.col("line_num")), ignorenulls=True).over(before())
    coded = coded.withColumn("_text_before", seen)
    coded = coded.withColumns({
        "ahead": F.array_join(F.collect_list("code").over(by_line().rowsBetween(1, 8)), ""),
        "head": F.max(F.when(F.col("is_chapter") & (F.col("line_num") > F.col("toc_start")), F.struct("line_num", "_text_before"))).over(by_line().rowsBetween(-4, -1)),
    })
    i, start, head = F.col("line_num"), F.col("toc_start"), F.col("head")
    above = F.when(head["_text_before"] > F.greatest(start, head["line_num"] - 10), head["_text_before"]).otherwise(head["line_num"] - 1)
    blank = F.col("code") == "b"
    end = F.when(F.col("code") == "A", i - 1).when(blank & F.col("ahead").rlike("^b{0,3}[AL]"), i).when(blank & F.col("ahead").rlike("^b{0,3}mb{0,3}[ALm]"), F.coalesce(above, i)).when(i - start > LONGEST, i)
    ends = coded.filter(i > start).withColumn("_end", end).filter("_end is not null").groupBy("doc_id", "toc_start").agg(F.min(F.struct("line_num", "_end"))["_end"].alias("toc_end"))
    return ends.filter("toc_end > toc_start")


def without_toc(docs: DataFrame) -> DataFrame:
    """docs with text less its table of contents, and toc_start, toc_end (null where there is none)."""
    lines = F.split("text", "\n")
    rest = F.concat(F.slice(lines, F.lit(1), F.col("toc_start")), F.slice(lines, F.col("toc_end") + 2, F.size(lines)))
    return docs.join(toc_regions(toc_lines(docs)), "doc_id", "left").withColumn("text", F.when(F.col("toc_start").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")))
