"""Structural cues of chapter boundaries, their score, and the candidates it gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, has_upper_only
from . import folds
from .lines import explode_lines, with_neighbours, with_offsets

# fixed values
INDICATORS = ["^[第章]", r"^\s*[IVX]+\.", r"^\s*Chapter", r"^\s*Part\s+[0-9]+", r"^\s*===+", r"^\s*---+", r"^\s*\*\*\*+"]
TIME_PLACE = ["^\\s*[0-9]{4}년", "^\\s*[0-9]+월\\s+[0-9]+일", "^\\s*[一二三四五六七八九十]+年", r"^\s*\[.*?(?:년|월|일|time|place|location)\]", r"^\s*(?:서울|도쿄|뉴욕|런던|파리)"]
OPEN_QUOTES, CLOSE_QUOTES = "\"'「『“‘", "\"'」』”’"
SHORT, VERY_SHORT, LONG, THRESHOLD, MIN_LINES = 50, 30, 200, 0.3, 10


def any_of(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns, each of which begins with ^, matches. The ^ stands before all of them, so that a
    line is tried at its start alone."""
    assert all(p.startswith("^") for p in patterns)
    return c.rlike("(?i)^(?:" + "|".join(p[1:] for p in patterns) + ")")


def ends_in(b: Column, letters: str) -> Column:
    """Whether the last letter of b, which is stripped, is one of `letters`."""
    return F.right(b, F.lit(1)).isin(*letters)


def _cues(b: Column, all_words: bool = True) -> list[Column]:
    """Without all_words, the words of lines that are not in capitals are not counted (null); no score needs them."""
    indicator, words = any_of(b, INDICATORS), F.size(F.split(b, f"[{SPACE}]+")).cast("long")
    return [
        (F.length(b) < SHORT).alias("is_short"),
        (F.length(b) < VERY_SHORT).alias("is_very_short"),
        (F.col("blanks_before") >= 1).alias("has_blank_before"),
        F.col("blanks_before").cast("long").alias("blank_count_before"),
        indicator.alias("has_chapter_indicator"),
        any_of(b, TIME_PLACE).alias("has_time_place"),
        b.rlike("[0-9]").alias("has_number"),
        reduce(Column.__or__, [F.contains(b, F.lit(x)) for x in "[]【】"]).alias("has_brackets"),
        ends_in(b, ".!?。！？").alias("has_punctuation_end"),
        has_upper_only(b).alias("is_all_caps"),
        b.rlike(r"^\p{Lu}").alias("starts_with_caps"),
        (words if all_words else F.when(has_upper_only(b), words)).alias("word_count"),
        (b.rlike(f"^[{OPEN_QUOTES}].+[{CLOSE_QUOTES}]$") | b.rlike("^.{1,40}[?!？！]$")).alias("is_dialogue"),
        (b.rlike("[.。다요죠습]$") & ~indicator).alias("is_sentence"),
        F.coalesce((F.col("next_body") != "") & (F.length("next_body") > F.length(b) * 1.5), F.lit(False)).alias("longer_lines_after"),
        F.coalesce(F.length("prev_body") > LONG, F.lit(False)).alias("long_line_before"),
    ]


def features(lines: DataFrame, also: tuple[str, ...] = (), all_words: bool = True) -> DataFrame:
    """One row for each non-blank line but the first of a document, with its 16 features; and the columns `also`
    of lines."""
    b = F.col("body")
    return with_neighbours(lines).filter((F.col("line_num") > 0) & (b != "")).select("doc_id", "line_num", *also, b.alias("text"), *_cues(b, all_words))


def confidence() -> Column:
    """The clamped sum of cue weights, in fixed order so that floating point agrees everywhere."""
    weights = [
        (F.col("is_short"), 0.3), (F.col("is_very_short"), 0.2), (F.col("has_blank_before"), 0.2), (F.col("blank_count_before") >= 2, 0.1), (F.col("has_chapter_indicator"), 0.4),
        (F.col("has_number"), 0.15), (F.col("has_brackets"), 0.1), (F.col("has_time_place"), 0.2), (F.col("longer_lines_after"), 0.15), (F.col("long_line_before"), 0.1),
        (F.col("is_all_caps") & F.col("word_count").between(6, 14), 0.15), (F.col("is_dialogue"), -0.4), (F.col("is_sentence"), -0.3),
    ]
    total = reduce(lambda a, w: a + F.when(w[0], F.lit(w[1])).otherwise(0.0), weights, F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def scored_lines(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    return features(lines, also).withColumn("confidence", confidence())


def scored_places(docs: DataFrame) -> DataFrame:
    """doc_id, line_num, byte_pos, text and confidence of the scored lines: one explode, and one exchange and
    sort for offsets and features together."""
    return features(with_offsets(explode_lines(docs)), ("byte_pos",), False).withColumn("confidence", confidence()).select("doc_id", "line_num", "byte_pos", "text", "confidence")


def marked_lines(docs: DataFrame) -> DataFrame:
    """All lines, with doc_id, line_num, line, byte_pos, char_pos, and the confidence of those that have one."""
    b, scored = F.col("body"), (F.col("line_num") > 0) & (F.col("body") != "")
    rows = with_neighbours(with_offsets(explode_lines(docs)))
    return rows.select("doc_id", "line_num", "line", "byte_pos", "char_pos", scored.alias("_scored"), *_cues(b, False)).select("doc_id", "line_num", "line", "byte_pos", "char_pos", F.when(F.col("_scored"), confidence()).alias("confidence"))


def spaced(rows: DataFrame, position: str, distance: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows that are, from the left, at least `distance` past the last kept one (a fold, not a lag); of rows at
    one position the first stays."""
    return folds.kept(rows, list(keys), [position], [position], folds.spaced(distance))


def candidates(lines: DataFrame, most: int = 1000, threshold: float = THRESHOLD, distance: int = MIN_LINES) -> DataFrame:
    """The first `most` lines of a document above the threshold, thinned to `distance` lines apart."""
    found = scored_lines(lines).filter(F.col("confidence") > threshold)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_num"))
    return spaced(found.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r"), "line_num", distance)
