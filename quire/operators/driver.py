"""Splitting documents whose number of chapters is known: patterns, then titles, then escalation.

Rounds run over a set that shrinks. A round tries one way on the documents that are open, counts their
chapters, and settles those with exactly the expected number. The state of all documents after a round is a
written table, and the next round's lines are those of the documents that are still open. Documents whose last
counts stand still skip the rounds that only repeat patterns, and go on to escalation. It ends when no document is
open, or all rounds are done; what is left takes the attempt that came nearest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import boundaries, escalate, patterns, segment, structure

# fixed values: gaps that are searched, and how much larger than a chapter they are; the least confidence of a title
# in one; attempts and their spread by which counts stand still
GAPS, GAP_SHARE, TITLE = 10, 1.5, 0.7
STILL, SPREAD = 3, 2

Attempt = Callable[[DataFrame, DataFrame], DataFrame]


def by_pattern(pattern: str) -> Attempt:
    return lambda lines, state: segment.chapters_by_rules(lines, pattern)


def titles_in_gaps(lines: DataFrame, state: DataFrame, pattern: str) -> DataFrame:
    """doc_id, title: likely titles that lie in the largest gaps between lines that match."""
    matches = lines.filter(escalate.matching(lines, pattern)).select("doc_id", F.col("byte_pos").alias("pos"))
    sizes = escalate.sizes_of(lines).join(state.select("doc_id", "k"), "doc_id")
    least = GAP_SHARE * F.col("_size") / F.col("_k")
    spans = boundaries.gaps(matches, sizes.select("doc_id", "size"), F.lit(0), F.lit(0), GAPS)
    wide = spans.join(sizes.select("doc_id", F.col("size").alias("_size"), F.col("k").alias("_k")), "doc_id").filter(F.col("size") > least).select("doc_id", "start", "end")
    likely = lines.filter(F.col("confidence") >= TITLE).select("doc_id", "line_num", "byte_pos", "line")
    return patterns.gap_titles(likely, wide).select("doc_id", F.trim("line").alias("title")).filter("title <> ''").distinct()


def by_titles(library: list[str]) -> Attempt:
    """All patterns at once, and the titles that gaps hold."""
    pattern = "|".join(f"(?:{p})" for p in library)

    def attempt(lines: DataFrame, state: DataFrame) -> DataFrame:
        titles = written(titles_in_gaps(lines, state, pattern), "gap-titles")
        return segment.chapters_by_rules(lines, pattern, titles)

    return attempt


def by_escalation(library: list[str], docs: DataFrame, scorer: escalate.Scorer) -> Attempt:
    """Lines that match a pattern are anchors; scores and changes of topic give the rest."""
    pattern = "|".join(f"(?:{p})" for p in library)

    def attempt(lines: DataFrame, state: DataFrame) -> DataFrame:
        anchors = lines.filter(escalate.matching(lines, pattern)).select("doc_id", "line_num")
        some = docs.join(state.select("doc_id"), "doc_id", "left_semi")
        return escalate.escalated(some, state.select("doc_id", "k"), scorer, anchors, True, lines)

    return attempt


def split(docs: DataFrame, expected: DataFrame, library: list[str], scorer: escalate.Scorer = escalate.neutral) -> tuple[DataFrame, DataFrame]:
    """(state, chapters). state: doc_id, k, n, settled_by and attempts of each document of docs that has lines and an
    expected number k of 1 or more (expected: doc_id once each, k): settled_by is the round that gave k
    chapters, or `closest`, with the n of the attempt that came nearest (the first of equals; 0 if none gave any).
    chapters: doc_id, round, cid, title, body, length, line_num of the attempt that counts.

    Null and empty texts, documents with no k, and ids that are null have no row.
    """
    lines = written(structure.marked_lines(docs.filter("doc_id IS NOT NULL")), "marked-lines")
    state = lines.select("doc_id").distinct().join(expected.filter("k > 0").select("doc_id", F.col("k").cast("long").alias("k")), "doc_id")
    empty = F.array().cast("array<long>")
    state = written(state.select("doc_id", "k", empty.alias("history"), F.lit(None).cast("string").alias("settled_by")), "split-state")
    rounds = [(f"pattern {i}", by_pattern(p), False) for i, p in enumerate(library)] + [("titles", by_titles(library), False), ("escalated", by_escalation(library, docs, scorer), True)]
    tried: list[DataFrame] = []
    for name, attempt, last in rounds:
        still = F.size("history") >= STILL
        still &= boundaries.stagnant(F.col("history"), STILL, SPREAD)
        open_ = state.filter(F.col("settled_by").isNull() & (F.lit(last) | ~still))
        if open_.isEmpty():
            continue
        rows = lines.join(open_.select("doc_id"), "doc_id", "left_semi")
        made = written(attempt(rows, open_).withColumn("round", F.lit(name)), "split-round")
        tried.append(made)
        counts = made.groupBy("doc_id").agg(F.count("*").alias("n"))
        after = state.join(open_.select("doc_id", F.lit(True).alias("now")), "doc_id", "left").join(counts, "doc_id", "left")
        n = F.coalesce("n", F.lit(0).cast("long"))
        settled = F.coalesce("settled_by", F.when(F.col("now") & (n == F.col("k")), name))
        state = written(after.select("doc_id", "k", F.when(F.col("now"), F.concat("history", F.array(n))).otherwise(F.col("history")).alias("history"), settled.alias("settled_by")), "split-state")
    near = F.array_min(F.transform("history", lambda n, i: F.struct(F.abs(n - F.col("k")).alias("d"), i.alias("i"), n.alias("n"))))
    named = state.select("doc_id", "k", near["n"].alias("n"), F.coalesce("settled_by", F.lit("closest")).alias("settled_by"), F.size("history").cast("long").alias("attempts"))
    if not tried:
        return named, segment.split_at(lines.select("doc_id", "line_num", "line"), lines.select("doc_id", "line_num").limit(0)).select("doc_id", F.lit("").alias("round"), "cid", "title", "body", F.lit(0).cast("long").alias("length"), "line_num")
    every = reduce(DataFrame.unionByName, tried)
    order = {name: i for i, (name, *_) in enumerate(rounds)}
    at = F.create_map(*[x for name, i in order.items() for x in (F.lit(name), F.lit(i))])[F.col("round")]
    sizes = every.groupBy("doc_id", "round").agg(F.count("*").alias("n"), F.min(at).alias("at")).join(state.select("doc_id", "k"), "doc_id")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.abs(F.col("n") - F.col("k")), "at"))
    counts_ = sizes.withColumn("r", best).filter("r = 1").select("doc_id", "round")
    return named, every.join(counts_, ["doc_id", "round"], "left_semi").select("doc_id", "round", "cid", "title", "body", "length", "line_num")
