"""Choosing boundaries: anchors, gaps, close repeats, and spacing-constrained selection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip
from . import folds

AI_WEIGHT, CUE_WEIGHT = 0.7, 0.3
MIN_DISTANCE, DISTANCE_SHARE, RELAX, LAST_DISTANCE = 1000, 0.3, 0.5, 500


def combined_score(ai: Column, confidence: Column) -> Column:
    cue = F.coalesce(confidence, F.lit(0.5))
    return F.when(ai.isNull(), F.coalesce(confidence, F.lit(0.5))).otherwise(ai * AI_WEIGHT + cue * CUE_WEIGHT)


def without_near(candidates: DataFrame, anchors: DataFrame, position: str, distance: int) -> DataFrame:
    """Candidates with no anchor of their document nearer than `distance`.

    Positions are dealt into cells of that width; an anchor near enough lies in the same or a
    neighbouring cell, so the range condition is an equality join on cells.
    """
    cell = F.floor(F.col(position) / distance)
    c = candidates.withColumn("_c", cell)
    a = anchors.select("doc_id", F.col(position).alias("_a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    return c.join(a, (c["doc_id"] == a["doc_id"]) & (c["_c"] == a["_c"]) & (F.abs(c[position] - a["_a"]) < distance), "left_anti").drop("_c")


def without_near_marked(rows: DataFrame, anchor: Column, position: str, distance: int) -> DataFrame:
    """The rows that are no anchors (a condition on rows that is never null) with no anchor of their document nearer
    than `distance`: the nearest one on either side is carried along the order of positions, which a document
    has once each. Nothing is joined."""
    at = F.when(F.col("_anchor"), F.col(position))
    up, down = (Window.partitionBy("doc_id").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(position), F.desc(position)))
    seen = rows.withColumn("_anchor", anchor).withColumns({"_below": F.last(at, ignorenulls=True).over(up), "_above": F.last(at, ignorenulls=True).over(down)})
    far = (F.col("_below").isNull() | (F.col(position) - F.col("_below") >= distance)) & (F.col("_above").isNull() | (F.col("_above") - F.col(position) >= distance))
    return seen.filter(~F.col("_anchor") & far).drop("_anchor", "_below", "_above")


def drop_close(matches: DataFrame, position: str = "pos", gap: int = 500) -> DataFrame:
    """Keeps a match at least `gap` past the one before it (kept or not), and the first."""
    before = F.lag(position).over(Window.partitionBy("doc_id").orderBy(position))
    return matches.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(position) - F.col("_b") >= gap)).drop("_b")


def gaps(matches: DataFrame, sizes: DataFrame, inner: Column, edge: Column, most: int, expected: Column | None = None) -> DataFrame:
    """Stretches without a match: between two, before the first (start 0) and after the last.

    sizes: doc_id, size; inner and edge are the least sizes reported; the `most` largest of a document.
    """
    ends = matches.select("doc_id", "pos", F.lit(1).alias("k")).unionByName(sizes.select("doc_id", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("k"))).unionByName(sizes.select("doc_id", F.col("size").alias("pos"), F.lit(2).alias("k")))
    w = Window.partitionBy("doc_id").orderBy("k", "pos")
    spans = ends.withColumns({"end": F.lead("pos").over(w), "k2": F.lead("k").over(w)}).filter("end is not null").withColumn("len", F.col("end") - F.col("pos")).join(sizes.select("doc_id", F.col("size").alias("_size")), "doc_id")
    kept = spans.filter(F.when((F.col("k") == 1) & (F.col("k2") == 1), F.col("len") > inner).otherwise(F.col("len") > edge))
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("len"), "pos"))
    return kept.withColumn("r", r).filter(F.col("r") <= most).select("doc_id", F.col("pos").alias("start"), "end", F.col("len").alias("size"))


def large_gaps(matches: DataFrame, sizes: DataFrame, expected: Column, least: int = 50_000, most: int = 10) -> DataFrame:
    """gaps of over `least` bytes and half as much again as a chapter; priority tells them in chapters.

    expected: the number of chapters, 1 at least, from the columns of sizes.
    """
    known = sizes.withColumn("expected", expected)
    found = gaps(matches, sizes, F.lit(least), F.lit(least), most).join(known.select("doc_id", (F.col("size") / F.col("expected")).alias("_mean")), "doc_id")
    return found.filter(F.col("size") > 1.5 * F.col("_mean")).select("doc_id", "start", "end", "size", (F.col("size") / F.col("_mean")).alias("priority"))


def select_boundaries(candidates: DataFrame, sizes: DataFrame, k: Column, anchors: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, byte_pos of the chosen boundaries, in three phases of falling distance, each from new; and the
    columns `also` of the candidates and anchors.

    candidates: doc_id, byte_pos, combined_score; sizes: doc_id, size. The first distance is a share of
    size / k; where fewer than k fit, half of it, then a fixed one. Anchors always stay, and candidates
    nearer to one than the first distance never do. At most max(k, anchors) boundaries come back. Equal
    positions are one: of an anchor the anchor, else the one with the best score.

    A document's candidates are seen in the order of their scores; the fold holds their positions.
    """
    known = sizes.select("doc_id", F.col("size").cast("long").alias("size"), k.cast("long").alias("k")).filter("k > 0")
    distance = F.greatest(F.lit(MIN_DISTANCE).cast("long"), F.floor(F.col("size") / F.col("k") * DISTANCE_SHARE))
    known = known.select("doc_id", "k", distance.alias("d"))

    def rows(of: DataFrame, kind: int, score: Column) -> DataFrame:
        return of.join(known, "doc_id").select("doc_id", F.lit(kind).alias("kind"), score.cast("double").alias("score"), F.col("byte_pos").cast("long").alias("byte_pos"), "k", "d", *also)

    every = rows(candidates, 1, -F.col("combined_score"))
    if anchors is not None:
        every = rows(anchors, 0, F.lit(0.0)).unionByName(every)
    out = every.select("doc_id", "byte_pos", *also)
    dealt = folds.dealt_by(every, ["doc_id"]).sortWithinPartitions("doc_id", "kind", "score", "byte_pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, points, need, near = None, {}, {}, 0, 0

        def done() -> list[tuple]:
            fixed, most = sorted(held), need - len(held)
            free = [p for p in points if p not in held and folds.far_from_all(fixed, p, near)]
            for d in (near, int(near * RELAX // 1), LAST_DISTANCE):
                taken = folds.chosen(free, most, d)
                if len(taken) >= most:
                    break
            return [(doc, p, *(held[p] if p in held else points[p])) for p in sorted([*fixed, *taken])]

        def made(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            fields = [schema.field("doc_id"), schema.field("byte_pos"), *(schema.field(c) for c in also)]
            columns = list(zip(*found)) if found else [[] for _ in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))

        schema = None
        for batch in batches:
            schema, found = batch.schema, []
            for head, kind, _, position, most, d, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if head != doc or not (held or points):
                    if held or points:
                        found += done()
                    doc, held, points, need, near = head, {}, {}, most, d
                (points if kind else held).setdefault(position, tuple(rest))
            if found:
                yield made(found, schema)
        if held or points:
            yield made(done(), schema)

    return dealt.mapInArrow(run, out.schema)


def topic_windows(docs: DataFrame, window: int = 2000, stride: int = 1500, most: int = 300) -> DataFrame:
    """doc_id, window_no, char_pos and text of a document's sliding windows."""
    n = F.greatest(F.lit(1), F.floor((F.length("text") - window) / stride) + 1).cast("int")
    step = F.when(n > most, F.floor((F.length("text") - window) / (most - 1))).otherwise(stride).cast("long")
    at = docs.filter("length(text) > 0").withColumn("_step", step).select("doc_id", "text", "_step", F.explode(F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1)).alias("window_no"))
    return at.select("doc_id", "window_no", (F.col("window_no") * F.col("_step")).alias("char_pos"), F.substr("text", (F.col("window_no") * F.col("_step") + 1).cast("int"), F.lit(window)).alias("text"))


def window_boundary(text: Column) -> Column:
    """Characters before a window's boundary: its first blank line, or else the first short line (under 50
    characters, neither the first nor the last), or else 0."""
    gap = F.regexp_substr(text, F.lit(f"\n[{SPACE}]*\n"))
    cut = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(-1).alias("found"))

    def step(a: Column, line: Column) -> Column:
        short = (a["found"] < 0) & (a["i"] > 0) & (a["i"] < F.size(cut) - 1) & (F.length(strip(line)) < 50)
        return F.struct((a["at"] + F.length(line) + 1).alias("at"), (a["i"] + 1).alias("i"), F.when(short, a["at"]).otherwise(a["found"]).alias("found"))

    return F.when(gap.isNotNull(), F.instr(text, gap) - 1).otherwise(F.greatest(F.lit(0), F.aggregate(cut, start, step, lambda a: a["found"])))


def stagnant(counts: Column, threshold: int = 3, spread: int = 2) -> Column:
    last = F.slice(counts, -threshold, threshold)
    return F.when(F.size(counts) < threshold, F.lit(False)).otherwise(F.array_max(last) - F.array_min(last) <= spread)
