"""Documents as ordered lines, with offsets and neighbours.

All windows share one partitioning and one order, (doc_id, line_num), so a plan has one exchange
and one sort however many of them it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import strip


def by_line() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_num")


def before() -> WindowSpec:
    return by_line().rowsBetween(Window.unboundedPreceding, -1)



def explode_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_num (0-based), line; the piece after a last line end is no line."""
    # a filter on texts would be pushed below whatever makes them, and make them again
    cut = F.when(F.col("text") != "", F.split(F.regexp_replace("text", r"\n\z", ""), "\n"))
    return docs.select("doc_id", F.posexplode(cut).alias("line_num", "line"))


def with_offsets(lines: DataFrame) -> DataFrame:
    """byte_pos and char_pos of each line's start."""
    return lines.withColumns({"byte_pos": F.coalesce(F.sum(F.octet_length("line").cast("long") + 1).over(before()), F.lit(0)), "char_pos": F.coalesce(F.sum(F.length("line").cast("long") + 1).over(before()), F.lit(0))})


def with_neighbours(lines: DataFrame) -> DataFrame:
    """body (stripped), next_body, prev_body and blanks_before (line 0 is not looked at)."""
    body = lines.withColumn("body", strip(F.col("line")))
    last_text = F.last(F.when((F.col("body") != "") | (F.col("line_num") == 0), F.col("line_num")), ignorenulls=True).over(before())
    return body.withColumns({"next_body": F.lead("body").over(by_line()), "prev_body": F.lag("body").over(by_line()), "blanks_before": F.coalesce(F.col("line_num") - last_text - 1, F.lit(0))})


def nearby_lines(lines: DataFrame, radius: int = 5) -> DataFrame:
    """before and after: the non-blank lines among `radius` on either side."""
    text = F.when(strip(F.col("line")) != "", strip(F.col("line")))
    return lines.select("doc_id", "line_num", F.array_join(F.collect_list(text).over(by_line().rowsBetween(-radius, -1)), "\n").alias("before"), F.array_join(F.collect_list(text).over(by_line().rowsBetween(1, radius)), "\n").alias("after"))


def squeeze_blank_lines(lines: DataFrame, most: int = 2) -> DataFrame:
    """Drops blank lines beyond `most` in a row."""
    blank = strip(F.col("line")) == ""
    run = F.col("line_num") - F.coalesce(F.last(F.when(~blank, F.col("line_num")), ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    return lines.withColumn("_run", run).filter(F.col("_run") <= most).drop("_run")
