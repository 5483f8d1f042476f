"""Chapters of documents where the number of chapters is known and no pattern finds them.

Lines with their offsets and scores are written once; every step reads that table and carries a candidate's
place along, so nothing is joined back to lines to find it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.text import strip
from . import boundaries, segment, structure, topics

# fixed values: candidates for each expected chapter, candidates scored, lines between a candidate and an
# anchor, least letters of a chapter, greatest share of shorter ones, least mean of letters, and of how many
# candidates for each expected chapter on no change of topic is looked for
PER_CHAPTER, SCORED, ANCHOR_LINES = 5, 300, 20
LEAST, SHORT_SHARE, LEAST_MEAN = 100, 0.1, 500
ENOUGH = 2

Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def neutral(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """The score of a scorer that does not answer; the order is that of the structural confidence."""
    return candidates.withColumn("ai_score", F.lit(0.5))


def sizes_of(lines: DataFrame) -> DataFrame:
    """doc_id and size: where the last line ends, in bytes."""
    return lines.groupBy("doc_id").agg(F.max(F.col("byte_pos") + F.octet_length("line")).alias("size"))


def escalated(docs: DataFrame, expected: DataFrame, scorer: Scorer = neutral, anchors: DataFrame | None = None, changes: bool | DataFrame = False, lines: DataFrame | None = None) -> DataFrame:
    """doc_id, cid, title, body, length, line_num of the documents that can be cut into exactly the
    expected number of chapters of sufficient length; others have no rows.

    expected: doc_id (once each), k; documents with no k, or k below 1, are left alone. scorer adds ai_score to
    doc_id, line_num, byte_pos, char_pos, text, confidence, and is given the lines. anchors: doc_id, line_num that are
    boundaries already (those on blank lines reject their document). changes: whether changes of topic are
    looked for (or doc_id, line_num, byte_pos, ai_score of them) where fewer than 2 * k candidates are left. lines: what
    structure.marked_lines gives for docs, if it is there. Repeated anchors and changes count once. Null and
    empty texts have none.
    """
    rows = lines if lines is not None else written(structure.marked_lines(docs), "marked-lines")
    sizes = written(sizes_of(rows).join(expected.filter("k > 0").select("doc_id", F.col("k").cast("long").alias("k")), "doc_id"), "sizes")
    by_place = Window.partitionBy("doc_id").orderBy("line_num")
    places = rows.select("doc_id", "line_num", "byte_pos", "char_pos", strip(F.col("line")).alias("text"), "confidence")
    found = places.filter(F.col("confidence") > structure.THRESHOLD).join(sizes.select("doc_id", "k"), "doc_id")
    capped = found.withColumn("r", F.row_number().over(by_place)).filter(F.col("r") <= PER_CHAPTER * F.col("k")).drop("r", "k")
    left = structure.spaced(capped, "line_num", structure.MIN_LINES)
    held = None
    if anchors is not None:
        held = written(places.join(anchors.select("doc_id", "line_num").distinct(), ["doc_id", "line_num"], "left_semi").select("doc_id", "line_num", "byte_pos"), "anchors")
        left = boundaries.without_near(left, held, "line_num", ANCHOR_LINES)
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "line_num"))
    left = written(left.withColumn("r", best).filter(F.col("r") <= SCORED).drop("r"), "candidates")
    scored = scorer(left, rows).select("doc_id", "line_num", "byte_pos", boundaries.combined_score(F.col("ai_score"), F.col("confidence")).alias("combined_score"))
    if changes is not False:
        counted = left.groupBy("doc_id").agg(F.count("*").alias("n"))
        few = sizes.join(counted, "doc_id", "left").filter(F.coalesce("n", F.lit(0)) < ENOUGH * F.col("k")).select("doc_id", "k")
        if changes is True:
            some = docs.join(few.select("doc_id"), "doc_id", "left_semi")
            turns = topics.topic_changes(some, few, rows, left)
        else:
            turns = changes.join(few, "doc_id", "left_semi").groupBy("doc_id", "line_num", "byte_pos").agg(F.max("ai_score").alias("ai_score"))
        more = turns.select("doc_id", "line_num", "byte_pos", boundaries.combined_score(F.col("ai_score"), F.lit(None).cast("double")).alias("combined_score"))
        scored = scored.unionByName(more.join(left, ["doc_id", "byte_pos"], "left_anti"))
    chosen = boundaries.select_boundaries(scored, sizes, F.col("k"), held, also=("line_num",))
    exact = F.count("*").over(Window.partitionBy("doc_id"))
    marks = chosen.withColumn("n", exact).join(sizes.select("doc_id", "k"), "doc_id").filter("n = k").select("doc_id", "line_num")
    return good_chapters(rows, marks)


def good_chapters(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Chapters at the marks, of the documents of which none has an empty title and lengths suffice."""
    of = lines.select("doc_id", "line_num", "line").join(marks.select("doc_id").distinct(), "doc_id", "left_semi")
    made = segment.split_at(of, marks).withColumn("body", strip(F.col("body"))).withColumn("length", F.length("body").cast("long"))
    whole = Window.partitionBy("doc_id")
    good = (F.min(F.length("title")).over(whole) > 0) & (F.avg((F.col("length") < LEAST).cast("int")).over(whole) <= SHORT_SHARE) & (F.avg("length").over(whole) >= LEAST_MEAN)
    return made.withColumn("good", good).filter("good").select("doc_id", "cid", "title", "body", "length", "line_num")


def matching(lines: DataFrame, pattern: str) -> Column:
    """Whether a line, stripped, is not blank and matches."""
    own = strip(lines["line"])
    return (own != "") & own.rlike(pattern)
