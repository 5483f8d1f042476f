"""Helpers shared by the training-data operators.

Rules kept by every operator of this package:

* a null text counts as an empty text, a null id is an ordinary value that sorts first;
* repeated rows are kept, each gets its own result row;
* operators take the columns they need by name, quoted, and use names of their own only where no column of
  the table has them, so further columns (whatever their names) never clash;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Python step holds as objects at a time; very long texts are further split by SLICE_BYTES.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20
#: What the memos of one Python worker may hold each, and the longest key that they keep.
MEMO_BYTES, MEMO_KEY = 32 << 20, 256
#: Rows of one key beyond which a join deals them to several tasks.
HOT_ROWS = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(column: str) -> Column:
    """The column of this very name, whatever dots, blanks or back-ticks it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(columns: Iterable[str], base: str) -> str:
    """A name like `base` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its
    own; on a cluster it is an error, since executors would not see the driver's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"/tmp/quire-shared-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/quire-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Deletes all tables that this application put into the shared folder; frames that read them end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/quire-{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that carry whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def map_columns(df: DataFrame, schema: str, start: Callable[[], Callable[..., list]]) -> DataFrame:
    """Maps lists of column values to lists of output columns, Arrow batch by batch.

    start() runs once a task and returns the function that gets one Python list for each
    column of df and returns one list for each column of schema, or yields such lists again and again.
    """
    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, each = to_arrow_schema(out), None
        for batch in batches:
            each = each or start()
            at = 0
            while at < batch.num_rows:
                n = min(SLICE_ROWS, batch.num_rows - at)
                while n > 1 and batch.slice(at, n).get_total_buffer_size() and _bytes(batch, at, n) > SLICE_BYTES:
                    n = (n + 1) // 2
                part = batch.slice(at, n)
                made = each(*[c.to_pylist() for c in part.columns])
                for got in [made] if isinstance(made, list) else made:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(got, arrow, strict=True)], schema=arrow)
                at += n

    return df.mapInArrow(run, schema)


def _bytes(batch: pa.RecordBatch, at: int, n: int) -> int:
    return batch.slice(at, n).nbytes


class Memo(dict):
    """A memo bounded by bytes: computes what it misses, and does not keep keys longer than `longest`.

    An entry counts as `base` bytes and `each` for every letter (member) of its key; values must not take
    more. When the entries hold half of `limit`, they become the older generation, from which entries that
    are asked for again come back; the generation before is dropped.
    """

    def __init__(self, compute: Callable, limit: int = MEMO_BYTES, base: int = 180, each: int = 6, longest: int = MEMO_KEY):
        super().__init__()
        self.compute, self.limit, self.base, self.each, self.longest, self.held, self.older = compute, limit // 2, base, each, longest, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        self.held += self.base + self.each * len(key)
        if self.held > self.limit:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        return value


def narrow(table: DataFrame) -> DataFrame:
    """A table without texts, for joins with texts: one plan at every size. Both sides are dealt by the key, each
    task holds its part of the narrow side, and texts are neither sorted nor held."""
    return table.hint("shuffle_hash")


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: Column, share: int = HOT_ROWS, texts: bool = False) -> DataFrame:
    """rows joined with table (one row a key, of known size: a written table) on key.

    weight: how many of `rows` have the table's key. The rows of a key of more than `share` are dealt to
    several tasks, each with a copy of the key's row in table; there are at most one such key for each
    `share` rows. texts: rows have texts, table has none.
    """
    salt, parts = fresh([*rows.columns, *table.columns], "_salt"), fresh([*rows.columns, *table.columns], "_parts")
    hot = materialize(table.filter(weight > share).select(named(key), F.ceil(weight / share).cast("int").alias(parts)), "hot-keys")
    if hot.isEmpty():
        return rows.join(narrow(table) if texts else table, key)
    dealt = rows.join(hot, key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(parts)).cast("int"), F.lit(0))).drop(parts)
    copies = table.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    # written, so that Spark knows its size and chooses the join by it
    return dealt.join(materialize(copies, "salted"), [key, salt]).drop(salt)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of table whose key is not in gone (written first, as it is narrow and costs much to find)."""
    return table.join(narrow(materialize(gone, "gone")), key, "left_anti")


def number_rows(df: DataFrame, order: list[str], within: str | None = None, label: str = "numbered") -> tuple[DataFrame, int]:
    """df with `row_no`: the global 0-based position of each row by `order`, and with `within` (the
    first of `order`) also `rank_no`, the position inside its group; and the number of rows.

    Rows are range-partitioned and sorted; each knows its place in its partition, and the
    partitions' counts (one row each, per group of a fixed number of them) give the offsets. No group meets
    in one task: ties are told apart by the place in the input. Columns of df with these two names are
    replaced; no other name clashes, since columns go by their position in between.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("row_no", "rank_no")]
    by = [f"c{names.index(c)}" for c in order]
    plain = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)])
    group = F.col(f"c{names.index(within)}") if within else F.lit(0)
    placed = plain.withColumn("src", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *by, "src").sortWithinPartitions(*by, "src").withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.drop("src"), label)
    pid, local = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(pid.alias("p"), group.alias("g")).agg(F.count("*").alias("n"), F.min(local).alias("first")).collect()
    counts.sort(key=lambda r: (r["p"], r["first"]))
    total, before, rows = 0, {}, []
    for r in counts:
        rows.append((r["p"], r["g"], total - r["first"], before.get(r["g"], 0) - r["first"]))
        before[r["g"]] = before.get(r["g"], 0) + r["n"]
        total += r["n"]
    kind = df.schema[within].dataType.simpleString() if within else "int"
    # Spark knows the size of these rows and chooses the join by it
    offsets = spark.createDataFrame(rows, f"p long, g {kind}, whole long, own long")
    joined = placed.join(offsets, (pid == F.col("p")) & group.eqNullSafe(F.col("g")), "left")
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)] + [(F.col("whole") + local).alias("row_no")]
    return joined.select(*out, *([(F.col("own") + local).alias("rank_no")] if within else [])), total
