"""Changes of topic: windows of a text whose words differ from those before them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boundaries
from .records import line_of

# fixed values: window, step, letters compared on either side, least change, windows for each expected chapter, and
# how near to a known candidate a window is left out
WINDOW, STRIDE, SAMPLE, LEAST, PER_CHAPTER, NEAR = 2000, 1500, 1000, 0.6, 3, 5000
WORD = r"[^\p{L}]+"


def windows(docs: DataFrame, expected: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """doc_id, window_no (from 1), char_pos, before and text of windows, three for each expected chapter at most
    (k of expected: doc_id, k); beyond that they lie further apart. The first window has nothing before it.

    existing: doc_id, char_pos of places; windows that begin less than NEAR letters from one are left out. A
    document's places, which are fewer than its letters, stand beside its text, so no window is shuffled.
    """
    size = F.length("text")
    n = F.greatest(F.lit(1), F.floor((size - WINDOW) / STRIDE) + 1)
    target = F.least(n, PER_CHAPTER * F.col("k")).cast("int")
    stride = F.when(target < n, F.greatest(F.lit(1), F.floor((size - WINDOW) / target))).otherwise(STRIDE).cast("int")
    at = F.col("window_no") * F.col("_step")
    rows = docs.join(expected.filter("k > 0").select("doc_id", "k"), "doc_id").withColumns({"_n": target, "_step": stride}).filter("_n > 1")
    numbers = F.filter(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: i * F.col("_step") < F.length("text"))
    if existing is not None:
        near = existing.filter("char_pos IS NOT NULL").groupBy("doc_id").agg(F.collect_set("char_pos").alias("_near"))
        rows = rows.join(near, "doc_id", "left")
        numbers = F.filter(numbers, lambda i: ~F.coalesce(F.exists("_near", lambda p: F.abs(p - i * F.col("_step")) < NEAR), F.lit(False)))
    rows = rows.select("doc_id", "text", "_step", F.explode(numbers).alias("window_no"))
    before = F.substr("text", F.greatest(F.lit(0), at - F.least(F.col("_step"), F.lit(SAMPLE))) + 1, F.least(at, F.least(F.col("_step"), F.lit(SAMPLE))))
    return rows.select("doc_id", "window_no", at.cast("long").alias("char_pos"), before.alias("before"), F.substr("text", at + 1, F.lit(WINDOW)).alias("text"))


def with_change(rows: DataFrame) -> DataFrame:
    """rows (doc_id, window_no, before, text, ...) with change: 1 less the cosine of the counts of words on both sides,
    of up to SAMPLE letters each. A side without words differs wholly.

    Words of both sides are numbered and counted for many windows at once, so a window needs no other row: nothing is
    exploded, grouped or joined. Sums of whole numbers alone are compared.
    """

    def words(c: str) -> Column:
        return F.regexp_replace(F.lower(F.substr(c, F.lit(1), F.lit(SAMPLE))), WORD, " ")

    # not deterministic: evaluated once, before a filter on change
    sums = F.arrow_udf(_sums, "struct<ab: long, aa: long, bb: long>").asNondeterministic()
    s = F.col("_sums")
    norm = F.sqrt((s["aa"] * s["bb"]).cast("double"))
    change = F.when(norm > 0, F.lit(1.0) - s["ab"] / norm).otherwise(1.0)
    return rows.withColumn("_sums", sums(words("before"), words("text"))).withColumn("change", change).drop("_sums")


def _sums(before: pa.Array, text: pa.Array) -> pa.Array:
    """ab, aa and bb of each pair of texts of words with blanks between them: sums over words of the products of their
    counts a and b. A null has no words."""
    sides = [pc.split_pattern(c, " ") for c in (before, text)]
    numbers = pa.concat_arrays([s.flatten() for s in sides]).dictionary_encode()
    width, blank = len(numbers.dictionary), pc.index(numbers.dictionary, "").as_py()
    codes, found, sums = numbers.indices.to_numpy(zero_copy_only=False).astype(np.int64), [], []
    for side, own in zip(sides, np.split(codes, [len(sides[0].flatten())])):
        keys = (pc.list_parent_indices(side).to_numpy(zero_copy_only=False).astype(np.int64) * width + own)[own != blank]
        found.append(np.unique(keys, return_counts=True))
    (a, na), (b, nb) = found
    both, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    for keys, products in ((both, na[at] * nb[bt]), (a, na * na), (b, nb * nb)):
        # sums of at most SAMPLE squared, which doubles hold exactly
        sums.append(np.bincount(keys // max(width, 1), weights=products, minlength=len(before)).astype(np.int64))
    return pa.StructArray.from_arrays([pa.array(x) for x in sums], names=["ab", "aa", "bb"])


def topic_changes(docs: DataFrame, expected: DataFrame, lines: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """doc_id, line_num, byte_pos, ai_score: the lines where windows that change the topic by LEAST or more have their
    boundary (a blank line, a short line, or the start); of several windows with one line the greatest change.

    lines: doc_id, line_num, byte_pos, char_pos. existing: doc_id, char_pos of candidates; windows that begin
    less than NEAR letters from one are left out. Null and empty texts have no window; documents are told apart
    by doc_id.
    """
    found = with_change(windows(docs, expected, existing)).filter(F.col("change") >= LEAST)
    places = found.select("doc_id", (F.col("char_pos") + boundaries.window_boundary(F.col("text"))).alias("pos"), "change")
    # places carry their change and lines their bytes, so windows are made once and lines are not joined back
    at = line_of(places, lines, ("change",), ("byte_pos",))
    return at.filter("line_num IS NOT NULL").groupBy("doc_id", "line_num", "byte_pos").agg(F.max("change").alias("ai_score"))
