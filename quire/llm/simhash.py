"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: 64 bits from the XXH64 values (seed 42) of word shingles, repeats included. Equal
fingerprints are merged first. Comparison is by tiles: fingerprints lie sorted by population count, a tile is
compared whole with another by exclusive-or and bit counts, and tile pairs whose counts differ by more than
the radius are skipped. Every pair that is compared, is compared so.

What is compared with what is first divided, exactly: two fingerprints within `radius` bits agree in at
least one of radius + 1 bands of their bits, so each band's value sends a fingerprint to one bucket and
tiles meet only inside buckets. A bucket of more than BLOCK fingerprints is divided again by bands of the
bits that its own band leaves, LEVELS times in all. What is still larger is dealt to parts by hash and every
two parts meet in a task of their own. So no pair is lost, and no task holds more than about 2 * BLOCK
fingerprints of a bucket.

A bucket returns only links that join its parts (fewer than its fingerprints). Up to FEW_LINKS links are
joined by one task; more of them by rounds of star contraction over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_hot, map_columns, materialize, named, shuffle_partitions, without
from .exact_dedup import located

SHINGLE = 3
RADIUS = 3
TILE = 256
BLOCK = 1 << 15
LEVELS = 3
FEW_LINKS = 1 << 20  # 16 MB
SEED = 42
STEP = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """0 for a text without words; fewer than `words` words make one shingle."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1)))[: len(found) - words + 1]
    ends = ends[words - 1 :]
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        h = np.fromiter([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """id_col and fp (the 64 bits as a long) of each row."""

    def start():
        def each(ids, texts):
            return [ids, np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)]

        return each

    rows = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return map_columns(rows, f"id {df.schema[id_col].dataType.simpleString()}, fp long", start).toDF(id_col, "fp")


class Parts:
    """Union-find over 0 .. n-1 whose roots are least members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(self, i: int, others: np.ndarray) -> None:
        at = self.find(i)
        for r in set(self.root[others].tolist()):
            r = self.find(r)
            if r != at:
                low, high = min(r, at), max(r, at)
                self.root[high] = low
                at = low
        self.root[others] = at

    def stars(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, the least value of its part) for all but that one."""
        touched = np.flatnonzero(self.root != np.arange(len(values)))
        roots = np.arange(len(values))
        roots[touched] = [self.find(i) for i in touched.tolist()]
        least = values.copy()
        np.minimum.at(least, roots, values)
        to = least[roots]
        return values[to != values], to[to != values]


def tile_pairs(values: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, tile: int = TILE, seen: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs within the radius, each pair once. values: distinct uint64 in a bucket, sorted
    by bucket and then by population count; bucket: the bucket's number, rising.

    seen counts the tile pairs that are compared and those that are skipped by their counts.
    """
    n, counts = len(values), np.bitwise_count(values)
    ends = np.searchsorted(bucket, bucket, side="right")  # where each place's bucket ends
    seen = {} if seen is None else seen
    for a in range(0, n, tile):
        last = min(n, a + tile) - 1
        left, rooms, most = values[a : last + 1, None], bucket[a : last + 1, None], int(counts[last]) + radius
        for b in range(a, int(ends[last]), tile):
            # beyond the first tile only the bucket of the last place goes on, in rising counts
            if b > a and counts[b] > most:
                seen["skipped"] = seen.get("skipped", 0) + -(-(int(ends[last]) - b) // tile)
                break
            seen["compared"] = seen.get("compared", 0) + 1
            near = np.bitwise_count(left ^ values[None, b : b + tile]) <= radius
            near &= rooms == bucket[None, b : b + tile]
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            if len(i):
                yield i + a, j + b


def bucket_links(values: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(value, least value) pairs that join, in each bucket, exactly the values reachable from each other by
    links of at most `radius` bits."""
    order = np.lexsort((values, np.bitwise_count(values), bucket))
    values, bucket = values[order], bucket[order]
    once = np.concatenate(([True], (values[1:] != values[:-1]) | (bucket[1:] != bucket[:-1])))[: len(values)]
    values, bucket = values[once], bucket[once]  # a value can be in a bucket twice
    parts = Parts(len(values))
    for i, j in tile_pairs(values, bucket, radius, tile):
        cuts = np.flatnonzero(np.diff(i)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
            parts.join(int(i[s]), j[s:e])
    return parts.stars(values)


def _bands(radius: int, width: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 bands of `width` bits."""
    cuts = [width * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _divided(rows: DataFrame, radius: int, width: int) -> DataFrame:
    """fp, path, rest of `width` bits -> a row for each band: path is joined by the band and its value, and
    rest is what the band leaves (bits - width holds how much that is)."""

    def bits(at: int, n: int) -> Column:
        whole = F.shiftrightunsigned("rest", at) if at else F.col("rest")
        return whole if at + n >= 64 else whole.bitwiseAND((1 << n) - 1)

    made = []
    for k, (at, n) in enumerate(_bands(radius, width)):
        above = width - at - n
        rest = bits(0, at) if at else F.lit(0).cast("long")
        if above:
            rest = F.shiftleft(bits(at + n, above), at).bitwiseOR(rest)
        # buckets that share a path by chance are compared together, which adds true links only
        path = F.xxhash64("path", F.lit(k), bits(at, n))
        made.append(F.struct(path.alias("path"), rest.alias("rest"), F.lit(width - n).alias("width")))
    return rows.select("fp", F.explode(F.array(*made)).alias("e")).select("fp", "e.*")


def dealt_bands(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """fp, path, cell: each fingerprint once in every bucket where its near ones may be, in cell 0; where the
    last level's buckets are of more than `block` fingerprints, once in the cell of its part and each other part."""

    def hot_of(rows: DataFrame) -> DataFrame:
        # a written table has a known size, by which Spark chooses between a broadcast and a shuffle
        hot = rows.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > block)
        return materialize(hot.select("path", F.ceil(F.col("n") / block).cast("int").alias("parts")), "hot-buckets")

    rows = _divided(fps.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest")), radius, 64)
    hot = hot_of(rows)
    done = None
    for _ in range(levels - 1):
        if hot.isEmpty():
            break
        cool = rows.join(hot, "path", "left_anti").select("fp", "path")
        done = cool if done is None else done.unionByName(cool)
        warm = rows.join(hot, "path", "left_semi")
        parted = [_divided(warm.filter(F.col("width") == w), radius, w) for w in _widths(warm)]
        rows = parted[0]
        for p in parted[1:]:
            rows = rows.unionByName(p)
        hot = hot_of(rows)
    parts = F.col("parts").cast("long")
    own = F.pmod(F.xxhash64("fp"), parts)
    meets = F.filter(F.sequence(F.lit(0).cast("long"), parts - 1), lambda other: other != own)
    cells = F.transform(meets, lambda other: F.least(own, other) * parts + F.greatest(own, other))
    cells = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells)
    last = rows.join(hot, "path", "left").select("fp", "path", F.explode(cells).alias("cell"))
    return last if done is None else last.unionByName(done.withColumn("cell", F.lit(0).cast("long")))


def _widths(rows: DataFrame) -> list[int]:
    """The few numbers of bits that the bands leave."""
    return sorted(r["width"] for r in rows.select("width").distinct().collect())


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """a, b: for distinct values of fp, pairs whose components are those of all links."""
    n = shuffle_partitions(fps.sparkSession)
    keyed = dealt_bands(fps, radius, block, levels).select("fp", F.xxhash64("path", "cell").alias("room"))
    dealt = keyed.repartition(n, "room").sortWithinPartitions("room")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def compared(fp: np.ndarray, room: np.ndarray) -> pa.RecordBatch:
            number = np.cumsum(np.concatenate(([0], np.diff(room) != 0)))
            a, b = bucket_links(fp.view(np.uint64), number, radius, tile)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, room = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            differs = np.flatnonzero(room != room[-1])
            cut = int(differs[-1]) + 1 if len(differs) else 0  # the last bucket may go on in the next batch
            if held and (cut or held[-1][1][-1] != room[0]):
                before = [np.concatenate(x) for x in zip(*held, (fp[:cut], room[:cut]))]
                held = []
                yield compared(*before)
            elif cut:
                yield compared(fp[:cut], room[:cut])
            held.append((fp[cut:], room[cut:]))
        if held:
            yield compared(*[np.concatenate(x) for x in zip(*held)])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _joined_by_one(now: DataFrame) -> DataFrame:
    """node, component by one task: for at most FEW_LINKS links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.arange(len(nodes))
        x, y = at[: len(a)], at[len(a) :]
        while True:  # least neighbours, then pointer jumping, until nothing changes
            low = np.minimum(root[x], root[y])
            was = root.copy()
            for k in (x, y):
                np.minimum.at(root, was[k], low)
                np.minimum.at(root, k, low)
            while (root != root[root]).any():
                root = root[root]
            if (root == was).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])

    return now.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, label: str = "components", few: int = FEW_LINKS) -> DataFrame:
    """node, component (the least node reachable) for every node of the links a, b.

    Up to `few` links are joined by one task. Else, each round points a node's larger neighbours at its
    least one, then its smaller ones (large and small stars); links only shrink towards the least node, and
    it ends when nothing changes, after about the logarithm of the longest chain in rounds.
    A hot node's links are combined before the shuffle: only minima are gathered, no neighbour lists.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), label)
    if now.count() <= few:
        return _joined_by_one(now)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = now.join(least, now["b"] == least["n"]).select("a", F.col("m").alias("b"))
        # b's least neighbour also replaces b itself, so that the chain b -> m is kept
        large = large.unionByName(least.filter("n != m").select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = materialize(small, label)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    node = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return node.unionByName(node.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id_col, fp, component_id: the least id among the rows reachable by links, itself included.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other; rows with a null
    id take part, and have a null component_id only if no row of their component has an id. Repeated rows
    get a result each; an empty table gives none.
    """
    docs = materialize(fingerprints(df, id_col, text_col, words).toDF("id", "fp"), "fingerprints")
    least = materialize(docs.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    comps = materialize(components(links(least.select("fp"), radius)), "fingerprint-components")
    owner = least.join(comps, least["fp"] == comps["node"], "left").select("fp", "least_id", "rows", F.coalesce("component", "fp").alias("c"))
    ids = owner.groupBy("c").agg(F.min("least_id").alias("component_id"))
    classes = materialize(owner.join(ids, "c").select("fp", "component_id", "rows"), "fingerprint-classes")
    return join_hot(docs, classes, "fp", F.col("rows")).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row of df: that with the least id, and of several with it the first by locator.

    A null id comes after all others. Rows are told apart by their place in their file, so repeated rows and
    rows without an id are near copies like any other.
    """
    table, at = located(df)
    key = F.struct(named(id_col).isNull().alias("none"), named(id_col).alias("id"), F.col(at).alias("at")).alias("key")
    found = near_duplicates(table.select(key, named(text_col).alias("text")), "key")
    gone = found.filter(F.col("key") != F.col("component_id")).select(F.col("key.at").alias(at))
    return without(table, gone, at).select(*map(named, df.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; nulls, repeats and empty tables as in near_duplicates."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
