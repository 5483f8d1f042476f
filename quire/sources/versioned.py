"""Keyed tables with versions: what the catalogue writes to.

A table is dealt by the hash of its key to a fixed number of buckets, and a bucket is a folder of files that is
never changed. A change rewrites only the buckets that it touches, into new folders, and is committed by one
manifest, which names the folders of all tables: it is written beside and renamed last, so readers see all of
a change or nothing, and a change that is broken off leaves the version before it. Two changes made from one
version cannot both be committed.

A change that would leave all rows as they are writes nothing, so work that is done again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tables import written


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


class Tables:
    """The tables in the folder `root`, which all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        at = self._path("manifests")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """version, and for each table its key, schema and folders by bucket."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "tables": {}}
        stream = self.fs.open(self._path(f"manifests/{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Writes the manifest beside and renames it to its version, unless that is there."""
        at, beside = self._path(f"manifests/{manifest['version']:09d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self.fs.exists(at) or not self.fs.rename(beside, at):
            self.fs.delete(beside, False)
            raise Conflict(f"version {manifest['version']} is there already")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["tables"][name])

    def _rows(self, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        folders = sorted(f for b, f in entry["folders"].items() if buckets is None or int(b) in buckets)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def change(self) -> Change:
        return Change(self)


class Change:
    """Steps that are committed together. Each sees what the steps before it did."""

    def __init__(self, tables: Tables):
        self.of, self.spark = tables, tables.spark
        self.now = tables.manifest()
        self.base, self.changed = self.now["version"], False

    def read(self, name: str) -> DataFrame:
        return self.of._rows(self.now["tables"][name])

    def create(self, name: str, key: list[str], schema: str) -> Change:
        """An empty table, if it is not there."""
        if name not in self.now["tables"]:
            parsed = self.spark.createDataFrame([], schema).schema
            self.now["tables"][name] = {"key": key, "schema": parsed.jsonValue(), "folders": {}}
            self.changed = True
        return self

    def _bucket(self, entry: dict) -> Column:
        return F.pmod(F.xxhash64(*entry["key"]), F.lit(self.of.buckets)).cast("int")

    def _touched(self, entry: dict, keys: DataFrame) -> list[int]:
        """Numbers of buckets, of which there are a fixed number."""
        return [r["b"] for r in keys.select(self._bucket(entry).alias("b")).distinct().collect()]

    def _write(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        entry = self.now["tables"][name]
        columns = [f["name"] for f in entry["schema"]["fields"]]
        folder = f"data/{name}/{uuid.uuid4().hex}"
        dealt = rows.select(*columns, self._bucket(entry).alias("_bucket")).repartition(F.xxhash64("_bucket"))
        dealt.write.partitionBy("_bucket").parquet(f"{self.of.root}/{folder}")
        there = {s.getPath().getName() for s in self.of.fs.listStatus(self.of._path(folder))}
        for b in touched:
            entry["folders"].pop(str(b), None)
            if f"_bucket={b}" in there:
                entry["folders"][str(b)] = f"{folder}/_bucket={b}"
        self.changed = True

    def replace(self, name: str, rows: DataFrame) -> Change:
        """Rows take the place of all rows with their keys (a key may have several); columns that rows lack are
        null. Keys whose rows are just these already are not touched. Keys must not be null."""
        entry = self.now["tables"][name]
        schema, key = StructType.fromJson(entry["schema"]), entry["key"]
        full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        full = written(full, "change")  # a batch is made once, however often it is looked at
        old = self.of._rows(entry, self._touched(entry, full))
        # a key's rows as a bag: their number and two sums of their hashes
        every = F.struct(*[x for f in schema for x in (F.col(f.name), F.col(f.name).isNull())])
        bag = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(every).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(every, F.lit(1)).cast("decimal(38,0)")).alias("b")]
        had, got = old.groupBy(*key).agg(*bag), full.groupBy(*key).agg(*bag)
        differ = got.join(had, [*key, "n", "a", "b"], "left_anti").select(*key)
        touched = self._touched(entry, differ)
        if touched:
            kept = self.of._rows(entry, touched).join(differ, key, "left_anti")
            self._write(name, kept.unionByName(full.join(differ, key, "left_semi")), touched)
        return self

    def merge(self, name: str, rows: DataFrame, once: tuple[str, ...] = ()) -> Change:
        """replace, where columns that rows lack, and those of `once` in old rows, keep their values (rows: each key
        once, as in the table)."""
        entry = self.now["tables"][name]
        key = entry["key"]
        kept = [f["name"] for f in entry["schema"]["fields"] if f["name"] not in key and (f["name"] not in rows.columns or f["name"] in once)]
        old = self.read(name).select(*key, *[F.col(c).alias(f"_old_{c}") for c in kept], F.lit(True).alias("_had"))
        both = rows.join(old, key, "left")
        for c in kept:
            new = F.col(c) if c in rows.columns else F.lit(None)
            both = both.withColumn(c, F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(new))
        return self.replace(name, both.drop("_had", *[f"_old_{c}" for c in kept]))

    def delete(self, keys: DataFrame, names: list[str], column: str) -> Change:
        """Rows of the tables whose `column` (of the same meaning in all, or a table's own name as `table.column`) is
        among the keys go: a semi-join for each table finds the buckets, which are written without them."""
        at = written(keys.select(F.col(keys.columns[0]).alias("_gone")).distinct(), "gone")
        for spec in names:
            name, _, own = spec.partition(".")
            own = own or column
            entry = self.now["tables"][name]
            gone = self.read(name).join(at, F.col(own) == F.col("_gone"), "left_semi")
            touched = self._touched(entry, gone)
            if touched:
                self._write(name, self.of._rows(entry, touched).join(at, F.col(own) == F.col("_gone"), "left_anti"), touched)
        return self

    def commit(self) -> int:
        """The version that readers see from now on; the one before, if nothing changed."""
        if not self.changed:
            return self.base
        self.of.publish(self.now | {"version": self.base + 1})
        return self.base + 1


# --- the catalogue ---------------------------------------------------------------------------------
STAGES = ("stage1", "stage2", "stage3", "stage4", "stage5")
SCHEMAS = {
    "files": (["file_path"], "id long, novel_id long, file_path string, file_name string, file_size long, file_hash string, is_duplicate int, duplicate_of long"),
    "processing_state": (["file_id"], "file_id long, stage0 int, " + ", ".join(f"{s} int" for s in STAGES) + ", last_error string"),
    "episode_patterns": (["file_id"], "file_id long, pattern string, detected_start long, detected_end long, confidence double"),
    "rename_plan": (["file_id"], "file_id long, old_name string, new_name string, approved int, applied int"),
    "novels": (["title"], "id long, title string, author string, genre string"),
    "chapters": (["file_id"], "file_id long, cid int, title string, body string, length long, chapter_type string"),
    "batch_logs": (["batch_name"], "batch_name string, batch_type string, total_files long, processed long, success long, failed long"),
}


def catalogue(spark: SparkSession, root: str, buckets: int = 16) -> Tables:
    made = Tables(spark, root, buckets)
    reduce(lambda c, name: c.create(name, *SCHEMAS[name]), SCHEMAS, made.change()).commit()
    return made


def index_files(change: Change, scanned: DataFrame) -> Change:
    """scanned: id, file_path, file_name, file_size, file_hash, is_duplicate, duplicate_of, each path once. A known
    path keeps its id and work; a file whose row is new or differs starts over: its state is indexed and no more."""
    known = change.read("files").select("file_path", F.col("id").alias("_id"), F.col("novel_id"))
    rows = scanned.join(known, "file_path", "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
    old = change.read("files")
    same = reduce(lambda a, b: a & b, [F.equal_null(rows[c], old[c]) for c in old.columns])
    fresh = rows.join(old, same, "left_anti")
    state = fresh.select(F.col("id").alias("file_id"), F.lit(1).alias("stage0"), *[F.lit(0).alias(s) for s in STAGES])
    change.replace("processing_state", state)
    return change.replace("files", rows)


def link_novels(change: Change, found: DataFrame) -> Change:
    """found: file_path, title, author, genre. Novels that are not known are inserted (their id is the least id of
    their files); known ones are left as they are; files point to their novel."""
    files = change.read("files").select("file_path", F.col("id").alias("file_id"))
    rows = found.join(files, "file_path")
    fresh = rows.groupBy("title").agg(F.min("file_id").alias("id"), F.min("author").alias("author"), F.min("genre").alias("genre"))
    change.merge("novels", fresh, once=("id", "author", "genre"))
    novels = change.read("novels").select("title", F.col("id").alias("novel_id"))
    return change.merge("files", rows.join(novels, "title").select("file_path", "novel_id"))


def prune_missing(change: Change, present: DataFrame) -> Change:
    """Files whose path the folder (present: file_path) no longer has go, and with them what other tables have of them."""
    gone = change.read("files").join(present, "file_path", "left_anti").select("id")
    return change.delete(gone, ["processing_state", "episode_patterns", "rename_plan", "chapters", "files.id"], "file_id")
