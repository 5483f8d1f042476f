"""The catalogue: files, novels and processing state, and its queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(files: DataFrame, state: DataFrame, ready: Column, columns: list[str], limit: int | None = None) -> DataFrame:
    """Files of a state that are no copies, by id."""
    out = files.join(state, files["id"] == state["file_id"]).filter(ready & (F.col("is_duplicate") == 0)).orderBy("id")
    return (out.limit(limit) if limit else out).select(*columns)


def search(files: DataFrame, novels: DataFrame, state: DataFrame, text: str, page: int = 0, size: int = 15) -> DataFrame:
    joined = files.join(novels, files["novel_id"] == novels["novel_key"], "left").join(state, files["id"] == state["file_id"], "left")
    hit = F.contains(F.col("file_name"), F.lit(text)) | F.coalesce(F.contains(F.col("title"), F.lit(text)), F.lit(False)) | F.coalesce(F.contains(F.col("author"), F.lit(text)), F.lit(False))
    return joined.filter(hit).orderBy(F.desc("id")).offset(page * size).limit(size)


def stage_completion(state: DataFrame, stages: list[str]) -> DataFrame:
    total = F.count("*")
    return state.agg(total.alias("total"), *[F.sum(s).alias(s) for s in stages], F.count_if(F.col("last_error").isNotNull()).alias("errors"))


def missing_numbers(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found: doc_id, n; expected: doc_id, upto. Numbers 1 .. upto that were not found."""
    return expected.filter("upto > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("upto"))).alias("n")).join(found, ["doc_id", "n"], "left_anti")


def by_status(files: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """files with status: a row for each of the conditions that a file meets (a null condition is not met)."""
    met = F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in conditions.items()])
    return files.withColumn("status", F.explode(F.array_compact(met)))
