"""Duplicate files and ordered distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(files: DataFrame) -> DataFrame:
    """file_hash, copies and the first path of each hash that occurs more than once (combined before the shuffle)."""
    return files.groupBy("file_hash").agg(F.count("*").alias("copies"), F.min("file_path").alias("original")).filter("copies > 1")


def duplicate_flags(files: DataFrame) -> DataFrame:
    """is_duplicate and duplicate_of: the first path of a hash is the original."""
    first = files.groupBy("file_hash").agg(F.min(F.struct("file_path", "id")).alias("f"))
    joined = files.join(first, "file_hash")
    dup = F.col("id") != F.col("f.id")
    return joined.select("id", "file_path", dup.cast("int").alias("is_duplicate"), F.when(dup, F.col("f.id")).alias("duplicate_of"))


def ordered_distinct(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The first place of each value."""
    return rows.groupBy(value).agg(F.min(order).alias(order))


def collision_suffix(names: DataFrame, name: str = "name", order: str = "id", span: int = 1 << 16) -> DataFrame:
    """final_name: the name, with -01, -02, ... from its second row by `order` (a whole number) on.

    A name's rows are ranked inside spans of `order`, and spans are counted before they are put in order, so
    that a name that many rows have is ranked by many tasks.
    """
    cut = F.floor(F.col(order) / span)
    counts = names.groupBy(name, cut.alias("_span")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(name).orderBy("_span")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(name, "_span").orderBy(order)) - 1
    ranked = names.withColumn("_span", cut).withColumn("_place", place).join(before, [name, "_span"])
    n = F.col("_before") + F.col("_place")
    digits = F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return ranked.select(*names.columns, F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), digits)).alias("final_name"))
