"""Tables in the shared folder, which cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its
    own; on a cluster that is an error, since executors would not see the driver's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"/tmp/quire-shared-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df as a table of its own, read again; with `by`, a folder for each value of that column (a few of them)."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quire-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def committed(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """The folders root/prefix* whose write was committed, in order of their names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix))
    return [f"{root}/{n}" for n in names if fs.exists(hadoop.Path(f"{root}/{n}/_SUCCESS"))]
