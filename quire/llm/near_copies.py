"""Near copies for the pipeline: five-word shingles, SimHash search, Jaccard similarity of 0.8 or more.

A text's shingles are a set of XXH64 values; texts of equal sets are merged first. A set has a SimHash
of 128 bits, 64 from the values and 64 from the values mixed again. At similarity 0.8 about 19 bits
differ (and 24 for sets of four and five shingles); pairs within RADIUS bits are candidates, and each is
then checked on the two sets.

Which sets are compared at all is an equality join: a set goes to a room for each of its LEAST least values.
Two sets of similarity 0.8 share none of them with a chance of at most 0.2 ** LEAST (4e-9); sets of up to 55
shingles always share one, as the values below the first shared one are all in one set alone. In a room,
fingerprints lie sorted by size and are compared in tiles by exclusive-or and bit counts; tile pairs whose sizes
or population counts differ too much are skipped. Rooms of more than BLOCK sets are dealt to parts of which
every two meet in a task.

Rooms give only links that join their candidates. Sets that such links connect are a cluster, and the checks
are made cluster by cluster: a set's shingles are sent to its own cluster alone, and what is joined already needs
no check. A cluster of more than BLOCK_BYTES of shingles is cut into blocks, and every two blocks meet. So work
grows with the square only inside a room or a cluster, not with that of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, map_columns, materialize, named, narrow, shuffle_partitions, small_batches, without
from .exact_dedup import located
from .simhash import SEED, STEP, Parts, components

SHINGLE = 5
RADIUS, HALF = 36, 22  # of 128 bits, and of the first 64
LEAST = 12
TILE = 256
BLOCK = 1 << 15
BLOCK_BYTES = 32 << 20


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct values; none for a text without words; fewer than `words` words make one shingle."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1]
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, len(starts)))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(shingles: np.ndarray) -> tuple[int, int]:
    """The two halves of the SimHash, as signed longs."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(shingles), STEP):
        part = shingles[at : at + STEP]
        for k, h in enumerate((part, mixed(part))):
            ones[64 * k : 64 * k + 64] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    a, b = np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8").tolist()
    return a, b


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 4/5 at least."""
    if len(a) > len(b):
        a, b = b, a
    if 5 * len(a) < 4 * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 9 * both >= 4 * (len(a) + len(b))


def candidates(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in left, places in right) within the radius whose sizes allow similarity; each of
    left and right is (size, first half, second half), sorted by size. Without right, each pair of left once."""
    same = right is None
    (n, a0, a1), (m, b0, b1) = left, left if same else right
    for a in range(0, len(n), tile):
        rows, low, high = slice(a, a + tile), n[a], n[min(len(n), a + tile) - 1]
        for b in range(a if same else 0, len(m), tile):
            cols = slice(b, b + tile)
            if 4 * low > 5 * m[min(len(m), b + tile) - 1] or 4 * m[b] > 5 * high:
                continue
            apart = np.bitwise_count(a0[rows, None] ^ b0[None, cols])
            i, j = np.nonzero(apart <= HALF)
            keep = apart[i, j] + np.bitwise_count(a1[rows][i] ^ b1[cols][j]) <= RADIUS
            keep &= (5 * n[rows][i] >= 4 * m[cols][j]) & (5 * m[cols][j] >= 4 * n[rows][i])
            if same and a == b:
                keep &= i < j
            if keep.any():
                yield i[keep] + a, j[keep] + b


def room_links(room: np.ndarray, n: np.ndarray, f0: np.ndarray, f1: np.ndarray, digest: np.ndarray, tile: int = TILE, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(digest, least digest of its part) pairs that join what candidates connect in each room. Rows come sorted
    by room and then by n; f0 and f1 are unsigned. seen counts the tile pairs that are compared and skipped."""
    same = room[1:] == room[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(room) else np.zeros(0, bool)
    room, n, f0, f1, digest = (x[keep] for x in (room, n, f0, f1, digest))
    values, which = np.unique(digest, return_inverse=True)
    parts, seen = Parts(len(values)), {} if seen is None else seen
    number = np.cumsum(np.concatenate(([0], room[1:] != room[:-1])))[: len(room)]
    ends = np.searchsorted(number, number, side="right")  # where each place's room ends
    bits = np.bitwise_count(f0).astype(np.int64) + np.bitwise_count(f1)
    for a in range(0, len(room), tile):
        rows = slice(a, min(len(room), a + tile))
        last = rows.stop - 1
        for b in range(a, int(ends[last]), tile):
            cols = slice(b, min(len(room), b + tile))
            # beyond the first tile only the room of the last place goes on, in rising sizes
            if b > a and 4 * n[b] > 5 * n[last]:
                seen["skipped"] = seen.get("skipped", 0) + -(-(int(ends[last]) - b) // tile)
                break
            if number[a] == number[cols.stop - 1] and (bits[rows].min() > bits[cols].max() + RADIUS or bits[cols].min() > bits[rows].max() + RADIUS):
                seen["skipped"] = seen.get("skipped", 0) + 1
                continue
            seen["compared"] = seen.get("compared", 0) + 1
            apart = np.bitwise_count(f0[rows, None] ^ f0[None, cols])
            near = (apart <= HALF) & (number[rows, None] == number[None, cols])
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            within = apart[i, j] + np.bitwise_count(f1[rows][i] ^ f1[cols][j]) <= RADIUS
            within &= (5 * n[rows][i] >= 4 * n[cols][j]) & (5 * n[cols][j] >= 4 * n[rows][i])
            i, j = which[i[within] + a], which[j[within] + b]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
                if e > s:
                    parts.join(int(i[s]), j[s:e])
    return parts.stars(values)


def candidate_links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: digests, joined as the candidates of all rooms join them. sets: digest, n, f0, f1, least."""
    rows = sets.select("digest", "n", "f0", "f1", F.explode("least").alias("room"))
    size = F.count(F.lit(1))
    hot = materialize(rows.groupBy("room").agg(F.ceil(size / block).cast("long").alias("parts")).filter("parts > 1"), "hot-rooms")
    parts = F.col("parts")
    own = F.pmod(F.xxhash64("digest"), parts)
    meets = F.filter(F.sequence(F.lit(0).cast("long"), parts - 1), lambda other: other != own)
    cells = F.transform(meets, lambda other: F.least(own, other) * parts + F.greatest(own, other))
    cells = F.when(parts.isNull(), F.array(F.lit(-1).cast("long"))).otherwise(cells)
    dealt = rows.join(hot, "room", "left").select("room", "n", "f0", "f1", "digest", F.explode(cells).alias("cell"))
    dealt = dealt.withColumn("room", F.when(F.col("cell") < 0, F.col("room")).otherwise(F.xxhash64("room", "cell"))).drop("cell")
    dealt = dealt.repartition(shuffle_partitions(sets.sparkSession), "room").sortWithinPartitions("room", "n")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def compared(columns: list[np.ndarray]) -> pa.RecordBatch:
            room, n, f0, f1, digest = columns
            found = room_links(room, n, f0.view(np.uint64), f1.view(np.uint64), digest)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            room = columns[0]
            differs = np.flatnonzero(room != room[-1])
            cut = int(differs[-1]) + 1 if len(differs) else 0  # the last room may go on in the next batch
            if held and (cut or held[-1][0][-1] != room[0]):
                yield compared([np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns])])
                held = []
            elif cut:
                yield compared([c[:cut] for c in columns])
            held.append([c[cut:] for c in columns])
        if held:
            yield compared([np.concatenate(x) for x in zip(*held)])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def by_meeting(dealt: DataFrame, schema: pa.Schema, kinds: str, work: Callable) -> DataFrame:
    """work(columns, low == high) of each meeting's rows; columns by name, as arrays, rows by size."""
    keys = ["low", "high"]
    names = dealt.columns
    small_batches(dealt.sparkSession)
    dealt = dealt.repartition(shuffle_partitions(dealt.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            got = {c: t.column(c).to_pylist() if c == "shingles" else t.column(c).to_numpy() for c in names}
            found = work(got, got["low"][0] == got["high"][0])
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            low, high = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys)
            cuts = np.flatnonzero((np.diff(low) != 0) | (np.diff(high) != 0)) + 1
            if held and (held[-1].column("low")[0].as_py(), held[-1].column("high")[0].as_py()) != (low[0], high[0]):
                yield done()
                held = []
            at = 0
            for cut in [*cuts.tolist(), batch.num_rows]:
                held.append(batch.slice(at, cut - at))
                at = cut
                if cut < batch.num_rows:
                    yield done()
                    held = []
        if held:
            yield done()

    return dealt.mapInArrow(run, kinds)


def _sides(got: dict, same: bool) -> tuple[np.ndarray, np.ndarray | None, tuple, tuple | None]:
    """Places of the rows of the low and the high block (None if they are one), by size, and what is compared of them."""

    def of(places):
        places = places[np.argsort(got["n"][places], kind="stable")]
        return places, (got["n"][places].astype(np.int64), got["f0"][places].view(np.uint64), got["f1"][places].view(np.uint64))

    left, a = of(np.flatnonzero(got["own"] == got["low"]))
    if same:
        return left, left, a, None
    right, b = of(np.flatnonzero(got["own"] == got["high"]))
    return left, right, a, b


def _links(got: dict, same: bool) -> list[np.ndarray]:
    left, right, a, b = _sides(got, same)
    parts, sets = Parts(len(got["digest"])), [np.frombuffer(s, "<u8") for s in got["shingles"]]
    for i, j in candidates(a, b):
        i, j = left[i], right[j]
        ends = np.flatnonzero(np.diff(i)) + 1
        for s, e in zip([0, *ends.tolist()], [*ends.tolist(), len(i)]):
            at = int(i[s])
            # what is joined already needs no check
            for k in j[s:e][parts.root[j[s:e]] != parts.find(at)].tolist():
                if parts.find(k) != parts.find(at) and similar(sets[at], sets[k]):
                    parts.join(at, np.array([k]))
    return list(parts.stars(got["digest"]))


def near_copies(table: DataFrame, key_col: str, text_col: str, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key_col and component_id (the least key among the rows reachable by similar texts) of each row of
    table; a key is a struct whose member `at` no other row has. Texts without words are alike."""
    import xxhash

    def start():
        def each(keys, texts):
            sets = [shingle_set(t) for t in texts]
            both = [sketch(s) for s in sets]
            digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            return [keys, digests, [len(s) for s in sets], [a for a, _ in both], [b for _, b in both], [s[:LEAST].view(np.int64).tolist() for s in sets]]

        return each

    def again():
        def each(*values):
            *kept, texts = values
            return [*kept, [shingle_set(t).tobytes() for t in texts]]

        return each

    kind = dict(table.dtypes)[key_col]
    docs = materialize(map_columns(table.select(key_col, text_col), f"{key_col} {kind}, digest long, n long, f0 long, f1 long, least array<long>", start), "shingle-sketches")
    every = materialize(docs.groupBy("digest", "n", "f0", "f1", "least").agg(F.min(key_col).alias("least_key"), F.count(F.lit(1)).alias("rows")), "distinct-sets")
    clusters = materialize(components(candidate_links(every.filter("n > 0"), block), "candidate-links"), "candidate-clusters")
    near = every.join(clusters, every["digest"] == clusters["node"]).select("digest", "n", "f0", "f1", F.col("component").alias("cluster"), F.col("least_key.at").alias("_wanted_at"))
    near = materialize(near, "sets-in-clusters")
    blocks = near.groupBy("cluster").agg(F.ceil(F.sum(8 * F.col("n") + 64) / block_bytes).cast("int").alias("blocks"), F.count(F.lit(1)).alias("_sets"))
    wanted = materialize(join_hot(near, materialize(blocks, "cluster-blocks"), "cluster", F.col("_sets")).drop("_sets"), "wanted")
    texts = table.join(narrow(wanted), F.col(f"{key_col}.at") == F.col("_wanted_at")).select("digest", "n", "f0", "f1", "cluster", "blocks", text_col)
    near_sets = map_columns(texts, "digest long, n long, f0 long, f1 long, cluster long, blocks int, shingles binary", again)
    # a block's name; names that are equal by chance only bring more sets together
    own = F.xxhash64("cluster", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("cluster", b))
    dealt = near_sets.withColumn("own", own).withColumn("other", F.explode(others)).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    two = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    links = by_meeting(dealt.drop("other", "cluster", "blocks"), two, "a long, b long", _links).distinct()
    comps = materialize(components(links), "near-copy-components")
    owner = every.join(comps, every["digest"] == comps["node"], "left").select("digest", "least_key", "rows", F.coalesce("component", "digest").alias("c"))
    ids = owner.groupBy("c").agg(F.min("least_key").alias("component_id"), F.count(F.lit(1)).alias("_sets"))
    classes = materialize(join_hot(owner, materialize(ids, "near-copy-ids"), "c", F.col("_sets")).select("digest", "component_id", "rows"), "near-copy-classes")
    return join_hot(docs.select(key_col, "digest"), classes, "digest", F.col("rows")).select(key_col, "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Of each group of near copies one row of df: that with the least id (a null id comes last), and of
    several with it the first by locator."""
    table, at = located(df)
    key = F.struct(named(id_col).isNull().alias("none"), named(id_col).alias("id"), F.col(at).alias("at")).alias("key")
    found = near_copies(table.select(key, named(text_col).alias("text")), "key", "text", **sizes)
    gone = found.filter(F.col("key") != F.col("component_id")).select(F.col("key.at").alias(at))
    return without(table, gone, at).select(*map(named, df.columns))
