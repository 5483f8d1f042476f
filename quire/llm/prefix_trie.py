"""Prefix trie of conversations by chained digests.

Each turn is digested by itself (role and text, SHA-256), so whole texts are read once and never shuffled.
A conversation's prefixes are chained: digest of depth d = SHA-256(digest of depth d - 1, digest of turn d).
Every prefix is exploded as a row, and the rows of one (depth, digest) are a node; members are combined
before the shuffle, so a first turn that a third of all conversations share is no hot key.

A node's representative is its least member, and whoever represents a node represents all nodes below it on
its own path. For subtree sums every node is exploded to all its ancestors: the nodes that one conversation
represents lie on one path, so it sends each ancestor the sum of those below it, once, and a path of d turns
costs d rows. Ancestors then add up by (depth, digest).

The digest of the conversations that end in a node runs over their ids in order: ids are sorted by range over
all tasks and packed into pieces of PIECE_BYTES, and only the pieces of a node meet in the task that hashes
them, one after the other, without holding them.

One conversation's turns are chained by one task, as a chain must be; it holds one turn at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, named, shuffle_partitions

ROOT = hashlib.sha256(b"").digest()
PIECE_BYTES = 64 << 10
#: Rebuilt conversations take so many first turns at most, less one, from the first of their block.
LEADS, BLOCK = 6, 100


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest and chars of each turn, in the order of turn_col (null first).

    Null roles and texts count as empty. Turns with one number are ordered by role and digest, repeated
    rows are turns of their own. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(named(c), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = df.select(named(conv_col).alias("conv_id"), named(turn_col).alias("turn"), role.alias("role"), F.unhex(F.sha2(F.encode(whole, "utf-8"), 256)).alias("digest"), F.length(text).cast("long").alias("chars")).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return slim.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "chars")


def leads(conv: Column) -> Column:
    """How many first turns a rebuilt conversation takes from the first of its block."""
    return F.crc32(F.encode(conv.cast("string"), "utf-8")) % LEADS


def rebuilt(ordered: DataFrame) -> DataFrame:
    """Conversations with the first turns of conversation c - c % 100 in place of as many of their own.

    A row for each turn, and one with part -1 for each conversation, which may have no turn at all.
    """
    ids = ordered.filter("pos = 1").select("conv_id")
    first = ordered.filter((F.col("pos") < LEADS) & (F.pmod("conv_id", F.lit(BLOCK)) == 0)).withColumnRenamed("conv_id", "base")
    own = F.col("conv_id")
    lead = ids.withColumn("base", own - F.pmod(own, F.lit(BLOCK))).join(first, "base").filter(F.col("pos") <= leads(own))
    rest = ordered.filter(F.col("pos") > leads(own))
    start = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return start.unionByName(lead.withColumn("part", F.lit(0)).drop("base")).unionByName(rest.withColumn("part", F.lit(1)))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent, chars and ends (whether the conversation ends here) of every prefix,
    that of no turn included."""
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, depth long, digest binary, parent binary, chars long, ends boolean"
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "part", "digest", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, of which the next one tells whether it ends
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv, part, turn, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None:
                    for column, value in zip(out, (*held, part < 0)):
                        column.append(value)
                held = (conv, 0, ROOT, None, 0) if part < 0 else (conv, held[1] + 1, hashlib.sha256(held[2] + turn).digest(), held[2], chars)
            yield made(out, batch.schema.field(0).type)
            ids = batch.schema.field(0).type
        if held is not None:
            yield made([[v] for v in (*held, True)], ids)

    def made(columns: list[list], ids: pa.DataType) -> pa.RecordBatch:
        kinds = (ids, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "depth", "digest", "parent", "chars", "ends"])

    return dealt.mapInArrow(run, schema)


def ends_digests(ends: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """node and ends_sha256 (over its ids in numerical order, comma-joined) of the rows node, conv_id."""
    n = shuffle_partitions(ends.sparkSession)
    ordered = ends.select("node", "conv_id").repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], names=["node", "first", "piece"])

        for batch in batches:
            for here, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (here != node or size > piece_bytes):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    node, first = here, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, digests = [], []
            for here, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if here == node:
                    state.update(b",")
                else:
                    if state is not None:
                        nodes.append(node)
                        digests.append(state.hexdigest())
                    node, state = here, hashlib.sha256()
                state.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    pieces = ordered.mapInArrow(pack, "node binary, first long, piece string")
    return pieces.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row a node of the trie over conversations given as `rebuilt` gives them: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. No conversation, no row."""
    paths = materialize(prefixes(rows), "prefixes").withColumnRenamed("digest", "node")
    nodes = paths.groupBy("depth", "node", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialize(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-children")

    # each node to all its ancestors: one row for each ancestor of a represented path, with the sum of what lies below
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    sums = paths.select("conv_id", "depth", "node").join(nodes.select("conv_id", "depth", "saved", "leaf"), ["conv_id", "depth"], "left")
    sums = sums.select("node", F.sum("saved").over(below).alias("saved"), F.sum("leaf").over(below).alias("leaves")).filter("leaves > 0 OR saved > 0")
    totals = sums.groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n")).filter("_n > 0")
    inner = join_hot(nodes.filter("depth > 0"), materialize(parents, "trie-parents"), "parent", F.col("_n")).drop("_n")
    linked = inner.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(dict(nodes.dtypes)["conv_id"])))
    ended = ends_digests(paths.filter("ends").select("node", F.col("conv_id").cast("long").alias("conv_id")))
    none = hashlib.sha256(b"").hexdigest()
    got = linked.join(totals, "node", "left").join(ended, "node", "left")
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations of `conversations`. Nulls, ties and repeated rows as in turns; an
    empty table gives no node."""
    ordered = materialize(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return trie(rebuilt(ordered))


ORACLE_SQL = {
    "op13_prefix_trie": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos,
                   coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END)), 4294967295) % 6 AS h FROM t),
        r AS (SELECT c.conv_id, 0 AS part, b.pos, b.role, b.text FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 100 AND b.pos <= c.h
              UNION ALL SELECT t.conv_id, 1, t.pos, t.role, t.text FROM t JOIN c ON c.conv_id = t.conv_id AND t.pos > c.h),
        p AS (SELECT conv_id, row_number() OVER w AS depth, list({'r': role, 't': text}) OVER w AS path, length(text) AS chars FROM r
              WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
              UNION ALL SELECT conv_id, 0, [], 0 FROM c),
        n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved FROM p GROUP BY depth, path),
        k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.path),
        u AS (SELECT path[:d] AS path, saved, (n_children = 0)::BIGINT AS leaf FROM (SELECT m.*, unnest(range(0, depth + 1)) AS d FROM m)),
        s AS (SELECT path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM u GROUP BY path),
        last AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
        e AS (SELECT p.path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM p JOIN last USING (conv_id, depth) GROUP BY p.path)
        SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves,
               s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
        FROM m JOIN s ON m.path = s.path LEFT JOIN e ON m.path = e.path LEFT JOIN m q ON m.depth > 0 AND q.path = m.path[:m.depth - 1]
    """
}
