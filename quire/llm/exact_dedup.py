"""Exact deduplication by a stateful streaming query.

Arrivals (digest, id and content locator of each row, no texts) are dealt by rows and streamed in several micro-batches
through a keyed aggregation whose state lives in RocksDB files under the shared folder and never expires. The
state of a digest holds the id to keep, the locator of its content and the number of arrivals; each
micro-batch combines its arrivals before they are sent to a key's state, so a digest that a third of
all rows have reaches it as one row from each task.

A digest that arrived more than once is a hit. The content that the state's locator names is fetched for
each hit and compared, full bytes, with every other arrival of it. Where one digest stands for different
texts, its rows are classed by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, join_hot, materialize, named, shared_path, shuffle_partitions, without

#: State on disk; files take the space they need (no allocation ahead), and changes are logged.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A stream over a table takes so many micro-batches at least, and more where one would read more bytes of arrivals.
BATCHES, BATCH_BYTES = 4, 1 << 30


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def deal_arrivals(rows: DataFrame, path: str) -> DataFrame:
    """Writes the arrivals, dealt by rows to files of like size, whatever files they come from: so a stream over the
    table takes at least BATCHES micro-batches, each with its share of the rows (of BATCHES rows and more)."""
    files = max(shuffle_partitions(rows.sparkSession), 4 * BATCHES)
    rows.repartition(files, "locator").write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stream_state(arrivals: DataFrame, path: str, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Streams the table at `path` (new files only, if `checkpoint` was used before) into the keyed state.

    Returns the latest state of every digest that has arrived so far: digest, keep_id, locator and
    group_size. Run again after more files have come, it takes these alone and carries on.
    """
    spark = arrivals.sparkSession
    if not files_per_batch:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        held = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at)
        files_per_batch = max(1, held.getFileCount() // max(BATCHES, -(-held.getLength() // BATCH_BYTES)))
    old = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch)
        best = F.max(F.struct(F.col("id"), F.col("locator"))).alias("best")
        state = reader.parquet(path).groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
        out = f"{checkpoint}/changes"

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = f"digest string, best struct<id:{dict(arrivals.dtypes)['id']},locator:string>, group_size long"
    changes = spark.read.schema(schema + ", batch long").parquet(f"{out}/batch=*") if _any(spark, out) else spark.createDataFrame([], schema + ", batch long")
    # a group only grows, so its latest state is its largest
    latest = changes.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s"))
    return latest.select("digest", F.col("s.best.id").alias("keep_id"), F.col("s.best.locator").alias("locator"), F.col("s.group_size").alias("group_size"))


def _any(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def located(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a column of locators, and that column's name (one that df has not): file and row number
    of each row, the same whenever and wherever it is read.

    A frame that does not come straight from files is written as a table first.
    """
    name = fresh(df.columns, "_content_locator")
    at = F.concat_ws(":", F.col("_metadata.file_path"), F.format_string("%012d", F.col("_metadata.row_index"))).alias(name)
    if fresh(df.columns, "_metadata") == "_metadata":  # else a column hides where rows come from
        try:
            return df.select("*", at), name
        except AnalysisException:
            pass
    plain = materialize(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), "located")
    return plain.select("*", at).toDF(*df.columns, name), name


def _classes(placed: DataFrame, digest: Callable[[Column], Column], files_per_batch: int | None) -> DataFrame:
    """placed: id, text and locator; id, keep_id, group_size, kept, digest and locator of each row."""
    spark = placed.sparkSession
    path = shared_path(spark, "arrivals")
    digested = placed.withColumn("digest", digest(F.col("text")))
    arrivals = deal_arrivals(digested.select("id", "digest", "locator"), path)
    state = stream_state(arrivals, path, shared_path(spark, "dedup-state"), files_per_batch)
    state = materialize(state.withColumnRenamed("locator", "keep_locator"), "dedup-classes")

    # full bytes: the content kept for each hit, and all arrivals of it
    hits = materialize(state.filter("group_size > 1").select("digest", "keep_locator", "group_size"), "hits")
    members = materialize(join_hot(digested, hits, "digest", F.col("group_size"), texts=True), "hit-texts")
    contents = materialize(members.filter(F.col("locator") == F.col("keep_locator")).select("digest", F.col("text").alias("content"), "group_size"), "hit-contents")
    compared = join_hot(members.drop("group_size"), contents, "digest", F.col("group_size"))
    mixed = materialize(compared.filter(F.col("text") != F.col("content")).select("digest").distinct(), "mixed-digests")

    rows = join_hot(arrivals, state, "digest", F.col("group_size"))
    got = rows.select("id", "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept"), "digest", "locator")
    if mixed.isEmpty():
        return got
    # different texts with one digest: classed by their bytes; each task sends a text once
    apart = digested.join(mixed, "digest")
    texts = materialize(apart.groupBy("text").agg(F.max(F.struct("id", "locator")).alias("best"), F.count(F.lit(1)).alias("group_size")), "mixed-texts")
    apart = apart.join(texts, "text")
    apart = apart.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("best.locator")).alias("kept"), "digest", "locator")
    return got.join(mixed, "digest", "left_anti").select(*apart.columns).unionByName(apart)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, digest and locator.

    Of equal texts (null counts as empty) the row with the largest id is kept; among rows of the same
    id and text one is kept, the last by locator. A null id is below all others. An empty table gives an
    empty result; texts of any length are compared whole.
    """
    table, at = located(df)
    placed = table.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"), F.col(at).alias("locator"))
    return _classes(placed, digest, files_per_batch).toDF(id_col, "keep_id", "group_size", "kept", "digest", "locator")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with the columns of df; rules as in exact_duplicates."""
    table, at = located(df)
    placed = table.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"), F.col(at).alias("locator"))
    gone = _classes(placed, sha256, None).filter("not kept").select(F.col("locator").alias(at))
    return without(table, gone, at).select(*map(named, df.columns))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document; nulls, repeats, ties and empty
    tables as in exact_duplicates."""
    got = exact_duplicates(documents(spark, sf_dir))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE_SQL = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g USING (text)
    """
}
