"""Incremental runs: each file of documents is worked on once, and a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "batch long, total long, success long, failed long"


def run_new_files(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "doc_id", log: str | None = None, failed: Column | None = None, files_per_batch: int | None = None) -> None:
    """Applies `work` to rows of files not seen before and writes results to `out`, without rows whose key is there.

    A batch that is run again (its results were written, but not that it ended) replaces its own results, so
    it looks at those of the other batches only. log: a folder that gets each batch's number of results, and of
    those for which `failed` (a condition on a result) holds; they are counted while the results are written,
    and stand under the batch's number, so a batch that is run again replaces its own counts too.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*")

    def batch(df: DataFrame, number: int) -> None:
        found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []
        others = [p for p in (f.getPath().toString() for f in found) if int(p.rpartition("=")[2]) != number]
        if others:
            df = df.join(spark.read.parquet(*others).select(key).distinct(), key, "left_anti")
        counts = Observation()
        bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
        rows = work(df)
        if log:
            rows = rows.observe(counts, F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("failed"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")
        if log:
            n = counts.get
            row = spark.createDataFrame([(number, n["total"], n["total"] - n["failed"], n["failed"])], LOG)
            row.coalesce(1).write.mode("overwrite").parquet(f"{log}/batch={number:09d}")

    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    stream.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_counts(spark: SparkSession, log: str) -> DataFrame:
    """One row: batches, total, success and failed of all batches of a run, restarts included."""
    rows = spark.read.schema(LOG).parquet(f"{log}/batch=*")
    return rows.agg(F.count(F.lit(1)).alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "success", "failed")])
