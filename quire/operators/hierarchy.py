"""Volumes, chapters and sections of books, as nested running counts of heading lines.

Every step but the check of headings against the text around them works on one partitioning and order
by document and line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .headings import EMPTY, enhanced, form_title, is_form, is_genuine, name
from .lines import by_line, with_offsets


def volume_lines(docs: DataFrame) -> DataFrame:
    """Lines with char_pos, volume_no (0 before the first), is_volume, and from / upto: the characters of
    the volume's content."""
    cut = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    exploded = docs.filter("text is not null and text <> ''").select("doc_id", "language", F.posexplode(cut).alias("line_num", "line"))
    rows = with_offsets(exploded).drop("byte_pos")
    flagged = rows.withColumn("is_volume", is_form(F.col("line"), F.col("language"), "volume"))
    numbered = flagged.withColumn("volume_no", F.sum(F.col("is_volume").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy("doc_id", "volume_no")
    ends = F.col("char_pos") + F.length("line")
    return numbered.withColumns({"from": F.coalesce(F.max(F.when(F.col("is_volume"), ends)).over(part), F.lit(0)), "upto": F.max(ends + 1).over(part)})


def chapter_marks(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, line_num of genuine chapter headings among volume_lines."""
    found = rows.filter(~F.col("is_volume") & is_form(F.col("line"), F.col("language"), "chapter")).drop("language")
    at, end = F.col("char_pos"), F.col("char_pos") + F.length("line")
    first = F.greatest(F.col("from"), at - 30)
    before = F.substr("text", (first + 1).cast("int"), (at - first).cast("int"))
    after = F.substr("text", (end + 1).cast("int"), F.least(F.lit(300), F.col("upto") - end).cast("int"))
    around = found.join(docs, "doc_id").select("doc_id", "line_num", "line", "language", before.alias("before"), after.alias("after"), (at - F.col("from")).alias("at"), (F.col("upto") - F.col("from")).alias("size"))
    return around.filter(is_genuine(*(F.col(c) for c in ("line", "before", "after", "at", "size", "language")))).select("doc_id", "line_num")


def _joined(parts, keep=None):
    kept = F.filter(parts, keep) if keep else parts
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def _edges(c):
    return F.regexp_replace(c, "^[\n\r]+|[\n\r]+\\z", "")


def hierarchy(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, language -> doc_id, volume_no, volume_title, chapter_no, chapter_title, section_no,
    section_title, content; no document is without a row.

    A volume whose title was seen before goes, with its content; so does a section in its chapter. Text before
    the first volume, chapter or section becomes a preface. A chapter without sections has one row with
    section_no 0 and no section title.
    """
    rows = volume_lines(docs)
    marks = chapter_marks(rows, docs).withColumn("is_chapter", F.lit(True))
    lang = F.col("language")
    rows = rows.select("doc_id", "line_num", "line", "language", "is_volume", "volume_no").join(marks, ["doc_id", "line_num"], "left").withColumn("is_chapter", F.coalesce("is_chapter", F.lit(False)))
    volume, order = Window.partitionBy("doc_id", "volume_no"), Window.partitionBy("doc_id", "volume_no").orderBy("line_num").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"chapter_no": F.sum(F.col("is_chapter").cast("int")).over(order), "has_chapters": F.max("is_chapter").over(volume), "volume_title": F.max(F.when(F.col("is_volume"), form_title(F.col("line"), lang, "volume"))).over(volume), "has_volumes": F.max("is_volume").over(Window.partitionBy("doc_id"))})

    # sections: the first form that occurs in the chapter
    inside = F.col("has_chapters") & ~F.col("is_chapter") & ~F.col("is_volume")
    rows = rows.withColumns({"_s": inside & is_form(F.col("line"), lang, "section"), "_n": inside & is_form(F.col("line"), lang, "numbered")})
    chapter = Window.partitionBy("doc_id", "volume_no", "chapter_no")
    rows = rows.withColumn("_form", F.when(F.max("_s").over(chapter), 1).when(F.max("_n").over(chapter), 2).otherwise(0))
    rows = rows.withColumn("_sec", F.when(F.col("_form") == 1, F.col("_s")).when(F.col("_form") == 2, F.col("_n")).otherwise(F.lit(False)))
    rows = rows.withColumn("section_no", F.sum(F.col("_sec").cast("int")).over(chapter.orderBy("line_num").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_sec_title", F.when(F.col("_sec"), F.when(F.col("_form") == 1, form_title(F.col("line"), lang, "section")).otherwise(form_title(F.col("line"), lang, "numbered"))))

    head = F.col("is_chapter") | F.col("is_volume")
    per_section = rows.groupBy("doc_id", "volume_no", "chapter_no", "section_no").agg(
        F.first("language").alias("language"), F.first("volume_title").alias("volume_title"), F.first("has_chapters").alias("has_chapters"), F.first("has_volumes").alias("has_volumes"), F.max("_form").alias("_form"),
        F.max(F.when(F.col("is_chapter"), form_title(F.col("line"), lang, "chapter"))).alias("raw_title"), F.max("_sec_title").alias("section_title"),
        F.sort_array(F.collect_list(F.when(~head, F.struct("line_num", "line", (~F.col("_sec")).alias("plain"))))).alias("lines"),
    )
    per_chapter = per_section.groupBy("doc_id", "volume_no", "chapter_no").agg(
        *[F.first(c).alias(c) for c in ("language", "volume_title", "has_chapters", "has_volumes", "_form")], F.max("raw_title").alias("raw_title"),
        F.sort_array(F.collect_list(F.struct("section_no", "section_title", "lines"))).alias("parts"),
    )
    whole = _edges(_joined(F.flatten(F.col("parts")["lines"])))
    per_chapter = per_chapter.withColumn("whole", whole).withColumn("first_volume", F.min("volume_no").over(Window.partitionBy("doc_id", "volume_title")))
    blank = strip(F.col("whole")) == ""
    bare = F.col("chapter_no") == 0
    kept = (F.col("volume_title").isNull() | (F.col("first_volume") == F.col("volume_no"))) & (~bare | ~blank)
    title = (
        F.when(~bare, enhanced(F.col("raw_title"), F.col("whole"), lang))
        .when(F.col("has_chapters"), name(lang, "preface"))
        .when(F.col("has_volumes") & (F.col("volume_no") == 0), name(lang, "volume_preface"))
        .otherwise(name(lang, "content"))
    )
    content = F.when(bare, strip(F.col("whole"))).when(blank, name(lang, "empty_chapter")).otherwise(F.col("whole"))
    one = F.array(F.struct(F.lit(0).cast("long").alias("section_no"), F.lit(None).cast("string").alias("section_title"), content.alias("content")))
    made = F.transform("parts", lambda p: F.struct(p["section_no"].alias("section_no"), F.coalesce(p["section_title"], name(lang, "section_preface")).alias("section_title"), _edges(_joined(p["lines"], lambda x: x["plain"])).alias("content")))
    seen = F.filter(made, lambda p, i: F.when(p["section_no"] == 0, strip(p["content"]) != "").otherwise(~F.exists(F.slice(made, F.lit(1), i), lambda q: (q["section_no"] > 0) & (q["section_title"] == p["section_title"]))))
    many = F.transform(seen, lambda p: F.struct(p["section_no"].alias("section_no"), p["section_title"].alias("section_title"), F.when(p["section_no"] == 0, strip(p["content"])).when(strip(p["content"]) == "", name(lang, "empty_section")).otherwise(p["content"]).alias("content")))
    named = per_chapter.withColumns({"kept": kept, "chapter_title": title, "parts": F.when(F.col("_form") > 0, many).otherwise(one)})
    named = named.withColumns({"_any": F.max("kept").over(Window.partitionBy("doc_id")), "_first": F.row_number().over(Window.partitionBy("doc_id").orderBy("volume_no", "chapter_no")) == 1})
    out = named.filter("kept").select("doc_id", "volume_no", "volume_title", "chapter_no", "chapter_title", F.explode("parts").alias("p")).select("doc_id", "volume_no", "volume_title", "chapter_no", "chapter_title", "p.*")

    def placeholder(df: DataFrame, title, text) -> DataFrame:
        none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        return df.select("doc_id", zero.alias("volume_no"), none.alias("volume_title"), zero.alias("chapter_no"), title.alias("chapter_title"), zero.alias("section_no"), none.alias("section_title"), text.alias("content"))

    # text that is lost whole stood in volumes without content
    lost = placeholder(named.filter("not _any and _first and has_volumes"), name(lang, "unknown"), name(lang, "unparsed"))
    empty = placeholder(docs.filter(strip(F.coalesce("text", F.lit(""))) == ""), F.lit(EMPTY[0]), F.lit(EMPTY[1]))
    return out.unionByName(lost).unionByName(empty)
