"""Collocations: phrases of 2 to 4 words that their words make up, by counts in perfect-hash slots.

Three passes over the texts, none of which shuffles them:

1. Words and word pairs are hashed; every mapper counts its hashes with numpy (bincount, unique) and sends them,
   packed and sorted, to the range of hashes that they lie in, where the counts of equal hashes are added up. A
   hash's count is no less than that of any phrase that has it.
2. Runs of three and four words whose pairs may all be frequent are counted likewise.
3. Phrases whose hash, and the hashes of all phrases inside them, reach the threshold are candidates (Apriori:
   nothing else can be frequent). Mappers count them exactly, over word numbers, once a task.

What mappers are told of the passes before is a bitmap of a fixed size (8 MB a level), whatever the input: it has a
bit for the first bits of each hash that reached the threshold. It spares work and decides nothing.

Candidates are dealt to shards, ranges of their 64-bit hash, several for each shuffle partition; each shard gets a
table: a minimal perfect hash, and the keys and their hashes in the order of the slots, by which every look-up is
verified. Two candidates of one hash would be told apart by nothing that is looked up by hash; a table that meets
two such keys is an error, never a wrong count (`seed` gives other hashes). Mappers send hashes and counts, packed,
to the tables, where they are added up in arrays by slot, several for a shard with many rows; the arrays of a
shard are summed by a tree. Counts of the parts that a phrase can be cut into are read from the parts' shards by
slot. A task holds one table at a time; nothing that grows with the input is broadcast.

Nearly every mapper has nearly every candidate, so what they send grows with both. It is compressed row by row:
keys in the order of their letters, hashes as differences, byte plane by byte plane. After the tables, phrases go
by their hashes, which no two candidates share, and by their words only where the result needs them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, named, shuffle_partitions, small_batches

LEAST, LONGEST, TOP = 30, 4, 2000
FAN_IN = 64
#: Rows of a shard for one task: packed counts, and single look-ups.
PACKED, SHARE = 1 << 10, 1 << 20
SEED = 42
#: How tables with phrases are written.
STORED = {"compression": "zstd"}


class Sizes(NamedTuple):
    """What mappers hold: bits of a level's bitmap (as a power of two), words and distinct words between two rounds
    of counting, the bytes that are split at a time, and the candidates that are counted before they are sent."""

    bits: int = 26
    words: int = 1 << 21
    distinct: int = 1 << 19
    slice: int = 4 << 20
    phrases: int = 1 << 20


#: Bits of a hash that are counted; counts stop at MOST.
KEPT, MOST = 48, (1 << 16) - 1
#: One byte for every mark that ends a piece; A-Z in lower case; blanks alike.
BREAK = b"."
FORM = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"......... ")


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def split_words(text: str, slice_bytes: int) -> Iterator[list[bytes]]:
    """The words of a text, and BREAK between pieces; a long text in several lists."""
    data = text.encode().translate(FORM).replace(BREAK, b" . ")
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + slice_bytes)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


class Words(dict):
    """Word -> number (from 1; 0 is the break), with each word's hash, for one language."""

    def __init__(self, lang: str):
        import xxhash

        super().__init__({BREAK: 0})
        self.seed, self.hashes, self.hashed = zlib.crc32(lang.encode()), [0], xxhash.xxh64_intdigest
        self.parts: list[np.ndarray] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(self.hashed(word, self.seed))
        return number

    def add(self, text: str, slice_bytes: int) -> int:
        n = 0
        for words in split_words(text, slice_bytes):
            self.parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            n += len(words)
        self.parts.append(np.zeros(1, np.int32))
        return n


class Bitmap:
    """A bit for the first `bits` bits of a hash."""

    def __init__(self, data: bytes, bits: int):
        self.data, self.shift = np.frombuffer(data, np.uint8), np.uint64(64 - bits)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & np.uint8(1) == 1


class Runs:
    """The runs of 1 to 4 words of one language's numbers: hashes by level, and which runs are whole."""

    def __init__(self, words: Words):
        self.ids = np.concatenate(words.parts)
        self.hashes = np.array(words.hashes, np.uint64)
        self.level = [self.hashes[self.ids]]
        self.whole = [self.ids != 0]

    def grow(self, k: int) -> None:
        while len(self.level) < k:
            j = len(self.level)
            self.level.append(mixed(self.level[-1][:-1], self.level[0][j:]))
            self.whole.append(self.whole[-1][:-1] & self.whole[0][j:])

    def candidates(self, filters: list[Bitmap]) -> list[np.ndarray]:
        """For each level of filters the mask of runs that may be frequent."""
        self.grow(len(filters))
        masks: list[np.ndarray] = []
        for k, bits in enumerate(filters, 1):
            if k == 1:
                mask = bits[self.hashes][self.ids] & self.whole[0]
            else:
                mask = masks[-1][:-1] & masks[-1][1:] & self.whole[k - 1]
                places = np.flatnonzero(mask)
                mask[places] = bits[self.level[k - 1][places]]
            masks.append(mask)
        return masks


def mapped(docs: DataFrame, schema: str, sizes: Sizes, start: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """docs: lang, text. start() gives, for each task, count(held) and last(), which give record batches; count gets
    the words by language whenever there are many, and in the end."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = start()
        held: dict[str, Words] = {}
        n = distinct = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                lang = "und" if lang is None else lang
                words = held.get(lang) or held.setdefault(lang, Words(lang))
                before = len(words)
                n += words.add(text or "", sizes.slice)
                distinct += len(words) - before
                if n > sizes.words or distinct > sizes.distinct:
                    yield from count(held)
                    held, n, distinct = {}, 0, 0
        if held:
            yield from count(held)
        yield from last()

    return docs.mapInArrow(run, schema)


def tree_sum(rows: DataFrame, keys: list[str], fan_in: int = FAN_IN) -> DataFrame:
    """keys and counts: int64 arrays of equal keys added up, fan_in leaves to a node in each round.
    rows: keys, leaf (a number from 0) and counts; a written table."""
    leaves = (rows.agg(F.max("leaf")).first()[0] or 0) + 1
    out = ", ".join(f"{c} {t}" for c, t in rows.select(*keys, "leaf", "counts").dtypes)
    while True:
        grouped = rows.select(*keys, F.floor(F.col("leaf") / fan_in).cast(dict(rows.dtypes)["leaf"]).alias("leaf"), "counts")
        dealt = grouped.repartition(shuffle_partitions(rows.sparkSession), *keys, "leaf").sortWithinPartitions(*keys, "leaf")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total, schema = None, None, None

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, total.tobytes()), schema)], schema=schema)

            for batch in batches:
                schema = batch.schema
                *heads, counts = (c.to_pylist() for c in batch.columns)
                for head, array in zip(zip(*heads), counts):
                    array = np.frombuffer(array, np.int64)
                    if head != now:
                        if now is not None:
                            yield done()
                        now, total = head, array
                    else:
                        total = total + array
            if now is not None:
                yield done()

        rows = dealt.mapInArrow(run, out)
        leaves = -(-leaves // fan_in)
        if leaves == 1:
            return rows.drop("leaf")
        rows = materialize(rows, "tree-sum")


def part_bits(spark: SparkSession, sizes: Sizes) -> int:
    """Hashes go to 2 ** part_bits ranges, several for each shuffle partition."""
    return min(sizes.bits - 3, (4 * shuffle_partitions(spark) - 1).bit_length())


COUNTED = "level int, part int, hashes binary, counts binary"


def hash_counts(docs: DataFrame, levels: tuple[int, ...], filters: list[bytes], sizes: Sizes = Sizes()) -> DataFrame:
    """Rows of a task's counts by level and range of hashes."""
    spark = docs.sparkSession
    sent, width = spark.sparkContext.broadcast(filters), part_bits(spark, sizes)  # bitmaps of a fixed size

    def start():
        bits = [Bitmap(f, sizes.bits) for f in sent.value]

        def packed(k: int, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            """values: rising, of KEPT bits."""
            parts = (values >> np.uint64(KEPT - width)).astype(np.int64)
            some, first = np.unique(parts, return_index=True)
            ends = [*first.tolist()[1:], len(values)]
            rows = [(values[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT // 8].tobytes(), np.minimum(counts[a:b], MOST).astype("<u2").tobytes()) for a, b in zip(first.tolist(), ends)]
            return made([k] * len(some), some.tolist(), [r[0] for r in rows], [r[1] for r in rows])

        def count(held: dict[str, Words]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {k: [] for k in levels}
            for w in held.values():
                runs = Runs(w)
                masks = runs.candidates(bits)
                for k in levels:
                    if k == 1:
                        n = np.bincount(runs.ids, minlength=len(runs.hashes))
                        found[k].append((runs.hashes[1:] >> np.uint64(64 - KEPT), n[1:]))
                        continue
                    runs.grow(k)
                    where = runs.whole[k - 1]
                    if masks:  # all shorter runs inside may be frequent
                        where = reduce(np.logical_and, [masks[-1][i : len(where) + i] for i in range(k - len(masks) + 1)], where)
                    found[k].append(np.unique(runs.level[k - 1][where] >> np.uint64(64 - KEPT), return_counts=True))
            for k, pairs in found.items():
                values, counts = (np.concatenate(x) for x in zip(*pairs))
                if len(values):
                    order = np.argsort(values, kind="stable") if k == 1 or len(pairs) > 1 else slice(None)
                    yield packed(k, values[order], counts[order])

        return count, lambda: iter(())

    def made(*columns: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["level", "part", "hashes", "counts"])

    return mapped(docs, COUNTED, sizes, start)


def bitmaps(counted: DataFrame, levels: tuple[int, ...], least: int, sizes: Sizes = Sizes()) -> list[bytes]:
    """A bitmap for each level, of the hashes that reach `least`. A task adds up one range of hashes at a time; the
    driver gets the bits alone, of a fixed number."""
    spark = counted.sparkSession
    width = part_bits(spark, sizes)
    size = 1 << (sizes.bits - width)
    dealt = counted.repartition(shuffle_partitions(spark), "level", "part").sortWithinPartitions("level", "part")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            packed = np.frombuffer(b"".join(h for h, _ in held), np.uint8).reshape(-1, KEPT // 8)
            values = np.zeros((len(packed), 8), np.uint8)
            values[:, : KEPT // 8] = packed
            values, counts = values.reshape(-1).view("<u8"), np.frombuffer(b"".join(c for _, c in held), "<u2").astype(np.int64)
            order = np.argsort(values, kind="stable")
            values = values[order]
            first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            frequent = values[first][np.add.reduceat(counts[order], first) >= least]
            bits = np.zeros(size, np.uint8)
            bits[(frequent >> np.uint64(KEPT - sizes.bits)).astype(np.int64) - now[1] * size] = 1
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["level", "part", "bits"])

        for batch in batches:
            for level, part, hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (level, part) != now:
                    if held:
                        yield done()
                    now, held = (level, part), []
                held.append((hashes, counts))
        if held:
            yield done()

    got = {(r["level"], r["part"]): bytes(r["bits"]) for r in dealt.mapInArrow(run, "level int, part int, bits binary").toLocalIterator()}
    return [b"".join(got.get((k, p), bytes(size // 8)) for p in range(1 << width)) for k in levels]


def candidate_counts(docs: DataFrame, filters: list[bytes], sizes: Sizes = Sizes(), seed: int = SEED) -> DataFrame:
    """shard, counts (packed, by rising hash) and keys (language, line feed, words with blanks): what a task counts of
    each candidate; and, with the shard -1, languages and their numbers of words. Hashes are not stored: they
    do not compress, and are made again from the keys."""
    import xxhash

    spark = docs.sparkSession
    sent, width, hashed = spark.sparkContext.broadcast(filters), part_bits(spark, sizes), xxhash.xxh64_intdigest

    def start():
        bits = [Bitmap(f, sizes.bits) for f in sent.value]
        total: dict[bytes, int] = {}
        words: dict[str, int] = {}

        def add(keys: list[bytes], n: np.ndarray) -> None:
            for key, k in zip(keys, n.tolist()):
                total[key] = total.get(key, 0) + k

        def packed() -> Iterator[pa.RecordBatch]:
            keys = list(total)
            h = np.fromiter((hashed(k, seed) for k in keys), np.uint64, len(keys))
            order = np.argsort(h, kind="stable")
            h, n = h[order], np.fromiter(total.values(), np.int64, len(keys))[order]
            total.clear()
            shards, first = np.unique((h >> np.uint64(64 - width)).astype(np.int64), return_index=True)
            for shard, a, b in zip(shards.tolist(), first.tolist(), [*first.tolist()[1:], len(h)]):
                names = pa.array([keys[i] for i in order[a:b].tolist()], pa.binary()).cast(pa.string())
                columns = [pa.array([shard], pa.int32()), pa.array([n[a:b].tobytes()]), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), names)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "counts", "keys"])

        def count(held: dict[str, Words]) -> Iterator[pa.RecordBatch]:
            for lang, w in held.items():
                runs, names, head = Runs(w), list(w), lang.encode() + b"\n"
                ids, masks = runs.ids, runs.candidates(bits)
                words[lang] = words.get(lang, 0) + int(np.count_nonzero(ids))
                ones = np.bincount(ids[masks[0]], minlength=1)
                some = np.flatnonzero(ones)
                add([head + names[i] for i in some.tolist()], ones[some])
                pair = np.full(len(ids), -1, np.int64)
                for k in range(2, LONGEST + 1):
                    at = np.flatnonzero(masks[k - 1])
                    if not len(at):
                        break
                    first, rest = (ids[at], ids[at + 1]) if k == 2 else (pair[at], ids[at + 2] if k == 3 else pair[at + 2])
                    _, places, which, n = np.unique((first.astype(np.int64) << 32) | rest, return_index=True, return_inverse=True, return_counts=True)
                    if k == 2:
                        pair[at] = which
                    rows = ids[at[places][:, None] + np.arange(k)].tolist()
                    add([head + b" ".join([names[i] for i in row]) for row in rows], n)
            if len(total) > sizes.phrases:
                yield from packed()

        def last() -> Iterator[pa.RecordBatch]:
            if total:
                yield from packed()
            if words:
                n = np.array(list(words.values()), np.int64)
                columns = [pa.array([-1], pa.int32()), pa.array([n.tobytes()]), pa.array([list(words)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "counts", "keys"])

        return count, last

    return mapped(docs, "shard int, counts binary, keys array<string>", sizes, start)


def hashes_of(keys: pa.Array, seed: int = SEED) -> np.ndarray:
    """The hashes of keys, as mappers make them."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys.cast(pa.binary()).to_pylist()), np.uint64, len(keys))


def with_hashes(counts: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, hashes and counts of the rows of candidate_counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([hashes_of(k.values, seed).tobytes() for k in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes, batch.column(1)], names=["shard", "hashes", "counts"])

    small_batches(counts.sparkSession)
    return counts.select("shard", "counts", "keys").mapInArrow(run, "shard int, hashes binary, counts binary")


def packed_keys(keys: pa.Array) -> tuple[int, int, bytes]:
    """Their number, and their lengths and letters, in the order of their letters: bytes, and compressed."""
    keys = keys.take(pc.sort_indices(keys))
    ends = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1)
    plain = np.diff(ends).astype("<u4").tobytes() + keys.buffers()[2].to_pybytes()[: ends[-1]]
    return len(keys), len(plain), pa.compress(plain, codec="zstd", asbytes=True)


def unpacked_keys(n: int, size: int, packed: bytes) -> pa.Array:
    plain = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(plain, "<u4", n)))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(plain[4 * n :]))


def packed_counts(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising hashes as differences, and counts, compressed byte plane by byte plane."""
    apart = np.diff(hashes, prepend=np.zeros(1, np.uint64))
    planes = [x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in (apart, np.ascontiguousarray(counts, np.int64))]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked_counts(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = np.frombuffer(pa.decompress(packed, decompressed_size=16 * n, codec="zstd", asbytes=True), np.uint8)
    apart, counts = (np.ascontiguousarray(x.reshape(8, n).T).reshape(-1) for x in (plain[: 8 * n], plain[8 * n :]))
    return np.cumsum(apart.view("<u8"), dtype=np.uint64), counts.view("<i8")


def sent_keys(local: DataFrame) -> DataFrame:
    """The keys of the rows of candidate_counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [packed_keys(k.values) for k in batch.column(1)]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["shard", "n", "size", "packed"])

    small_batches(local.sparkSession)
    return local.select("shard", "keys").mapInArrow(run, "shard int, n int, size long, packed binary")


def sent_counts(counted: DataFrame, seed: int = SEED) -> DataFrame:
    """The hashes and counts of the rows of candidate_counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(k) for k in batch.column(2)], pa.int32())
            rows = [packed_counts(hashes_of(k.values, seed), np.frombuffer(c.as_py(), np.int64)) for c, k in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(rows, pa.binary())], names=["shard", "n", "packed"])

    small_batches(counted.sparkSession)
    return counted.select("shard", "counts", "keys").mapInArrow(run, "shard int, n int, packed binary")


class PerfectHash:
    """Minimal perfect hash: bit arrays, level by level, of the places that one key alone has; a key's slot is the
    rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, self.placed = levels, [], 0
        for bits in levels:
            self.ranks.append(self.placed + np.cumsum(bits) - 1)
            self.placed += int(bits.sum())

    @staticmethod
    def places(h: np.ndarray, level: int, size: int) -> np.ndarray:
        """Places of the hashes; two that meet on one level are independent of each other on the next."""
        x = h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(h) and len(levels) < 64:
            size = 2 * len(h)
            at = cls.places(h, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            h = h[~bits[at]]
        if len(h):
            raise ValueError("hashes that no level tells apart")
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """A slot for every hash, whether it belongs to a key or not; -1 where no level has a bit."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = self.places(h[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out


class Table:
    """A perfect hash, and by slot its keys and their hashes, against which every look-up is verified."""

    def __init__(self, levels: PerfectHash, hashes: np.ndarray, keys: pa.Array | list[str]):
        self.levels, self.hashes, self.keys = levels, hashes, keys

    @classmethod
    def build(cls, keys: list[str], hashes: np.ndarray) -> Table:
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two phrases have one hash: another seed is needed")
        levels = PerfectHash.build(hashes)
        slots = levels.slots(hashes)
        ordered, at = np.empty(len(keys), object), np.empty(len(keys), np.uint64)
        ordered[slots], at[slots] = keys, hashes
        return cls(levels, at, ordered.tolist())

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for what is no key's."""
        got = self.levels.slots(hashes)
        if len(self.hashes):
            got[self.hashes[got] != hashes] = -1
        return got


def hash_of(key: Column, seed: int = SEED) -> Column:
    """The hash that mappers give a key, as a signed long (Spark's own has the seed 42)."""
    if seed != SEED:
        raise ValueError("look-ups by Spark's hash have its seed")
    return F.xxhash64(key)


def shard_of(hashed: Column, width: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - width).cast("int") if width else F.lit(0)


TABLE = "shard int, sizes array<int>, bits array<binary>, stored binary, keys array<string>"


def tables(local: DataFrame, seed: int = SEED) -> DataFrame:
    """A table for each shard, of the keys that its packed rows (shard, keys) hold between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done() -> pa.RecordBatch:
            t = Table.build(list(held.values()), np.fromiter(held, np.uint64, len(held)))
            levels = t.levels.levels
            columns = [[now], [[len(b) for b in levels]], [[np.packbits(b).tobytes() for b in levels]], [t.hashes.tobytes()], [t.keys]]
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "sizes", "bits", "stored", "keys"])

        for batch in batches:
            for shard, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if held:
                        yield done()
                    now, held = shard, {}
                keys = unpacked_keys(*packed)
                for h, key in zip(hashes_of(keys, seed).tolist(), keys.to_pylist()):
                    if held.setdefault(h, key) != key:
                        raise ValueError("two phrases have one hash: another seed is needed")
        if held:
            yield done()

    small_batches(local.sparkSession)
    dealt = sent_keys(local).repartition(shuffle_partitions(local.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, TABLE)


def word_totals(local: DataFrame) -> DataFrame:
    """lang and n, the words of each language, from the rows of the shard -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, langs in zip(*batch.columns):
                yield pa.RecordBatch.from_arrays([langs.values, pa.array(np.frombuffer(counts.as_py(), np.int64))], names=["lang", "n"])

    return local.filter("shard < 0").select("counts", "keys").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def at_tables(made: DataFrame, rows: DataFrame, schema: str, work: Callable, share: int, shards: DataFrame | None = None) -> DataFrame:
    """work(head, table, counts, columns) for the rows (shard and further columns) of each table, batch by batch, with
    the further columns by name; with None, it is the end of a table's rows. It yields record batches.

    made: shard, sizes, bits, stored and counts by slot (or null). The rows of a shard of more than `share` are dealt
    to several tasks, each with a copy of its table. shards: the shards of rows, where rows cost much to make.
    """
    n = shuffle_partitions(rows.sparkSession)
    table_columns, own = ["sizes", "bits", "stored", "slots"], [c for c in rows.columns if c != "shard"]
    parts = materialize((rows if shards is None else shards).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts")), "shard-parts")
    kinds = dict(made.dtypes)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int").alias("salt")
    salted = rows.join(parts, "shard").select("shard", salt, F.lit(1).alias("kind"), *own, *[F.lit(None).cast(kinds[c]).alias(c) for c in table_columns])
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "shard"]
    copies = made.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"), *none, *table_columns)
    both = copies.unionByName(salted).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts = head = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            edges = [0, *np.flatnonzero((kind[1:] == 0) | (kind[:-1] == 0)) + 1, batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                got = dict(zip(part.schema.names, part.columns))
                if kind[a] == 0:
                    if table is not None:
                        yield from work(head, table, counts, None)
                    head = (got["shard"][0].as_py(), got["salt"][0].as_py())
                    levels = [np.unpackbits(np.frombuffer(x, np.uint8), count=s).astype(bool) for x, s in zip(got["bits"][0].as_py(), got["sizes"][0].as_py())]
                    table, counts = Table(PerfectHash(levels), np.frombuffer(got["stored"][0].as_py(), np.uint64), []), got["slots"][0].as_py()
                    counts = np.zeros(len(table.hashes), np.int64) if counts is None else np.frombuffer(counts, np.int64)
                else:
                    yield from work(head, table, counts, got)
        if table is not None:
            yield from work(head, table, counts, None)

    return both.mapInArrow(run, schema)


def counts_by_slot(made: DataFrame, counted: DataFrame, share: int = PACKED) -> DataFrame:
    """made with `slots`, the counts of each table's slots. counted: rows of candidate_counts."""

    def work(head, table, counts, columns) -> Iterator[pa.RecordBatch]:
        if columns is None:
            yield pa.RecordBatch.from_arrays([pa.array([head[0]], pa.int32()), pa.array([head[1]], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["shard", "leaf", "counts"])
            return
        for row in zip(columns["n"].to_pylist(), columns["packed"].to_pylist()):
            hashes, n = unpacked_counts(*row)
            slots = table.slots(hashes)
            if (slots < 0).any():
                raise ValueError("a counted phrase is not among the candidates")
            counts[slots] += n  # a row has each hash once

    arrays = materialize(at_tables(made.withColumn("slots", F.lit(None).cast("binary")), sent_counts(counted), "shard int, leaf int, counts binary", work, share, counted.select("shard")), "slot-counts")
    return materialize(made.join(tree_sum(arrays, ["shard"]).withColumnRenamed("counts", "slots"), "shard"), "counted-tables", **STORED)


def frequent(counted: DataFrame, least: int) -> DataFrame:
    """key and a of the phrases that occur `least` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*batch.columns):
                n = np.frombuffer(counts.as_py(), np.int64)
                keep = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([keys.values.take(pa.array(keep)), pa.array(n[keep])], names=["key", "a"])

    return counted.select("keys", "slots").mapInArrow(run, "key string, a long")


def read_counts(counted: DataFrame, asked: DataFrame, share: int = SHARE) -> DataFrame:
    """of, value and n (the count of the key with hash h, read by its slot) of the rows shard, h, value, of."""

    def work(head, table, counts, columns) -> Iterator[pa.RecordBatch]:
        if columns is not None:
            slots = table.slots(columns["h"].to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([columns["of"], columns["value"], pa.array(np.where(slots < 0, 0, counts[slots]))], names=["of", "value", "n"])

    return at_tables(counted.drop("keys"), asked, "of long, value long, n long", work, share)


def language(key: Column) -> Column:
    return F.substring(key, F.lit(1), F.length(key) - F.length(phrase(key)) - 1)


def phrase(key: Column) -> Column:
    return F.substring_index(key, "\n", -1)


def _part(words: Column, at: Column | int, n: Column | int) -> Column:
    return F.concat(language(F.col("key")), F.lit("\n"), F.array_join(F.slice(words, F.lit(at) if isinstance(at, int) else at, F.lit(n) if isinstance(n, int) else n), " "))


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, packed: int = PACKED, share: int = SHARE, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases.

    A null language is `und`, null and empty texts have no words; repeated rows count again; a language
    without a frequent phrase has no row, so an empty table gives none. Phrases of one score and count are
    in the order of their bytes. Counts are whole numbers of 64 bits, products are decimals.
    """
    spark = df.sparkSession
    docs = df.select(named(lang_col).alias("lang"), named(text_col).alias("text"))
    if least > MOST:
        raise ValueError(f"counts of hashes stop at {MOST}")
    filters = bitmaps(hash_counts(docs, (1, 2), [], sizes), (1, 2), least, sizes)
    filters += bitmaps(hash_counts(docs, (3, 4), filters, sizes), (3, 4), least, sizes)
    width = part_bits(spark, sizes)
    local = materialize(candidate_counts(docs, filters, sizes), "candidate-counts", **STORED)
    counts = local.filter("shard >= 0")
    made = materialize(tables(counts), "phrase-tables", **STORED)
    counted = counts_by_slot(made, counts, packed)
    found = materialize(frequent(counted, least).withColumn("of", hash_of(F.col("key"))).withColumn("words", F.split(phrase(F.col("key")), " ")), "frequent-phrases")

    # the two parts of each cut: value is 2 * (words before the cut) for the first part, and one more for the rest
    size, words = F.size("words"), F.col("words")
    cuts = found.filter(size > 1).select("of", "key", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    halves = F.array(F.struct(_part(words, 1, F.col("k")).alias("part"), (2 * F.col("k")).cast("long").alias("value")), F.struct(_part(words, F.col("k") + 1, size - F.col("k")).alias("part"), (2 * F.col("k") + 1).cast("long").alias("value")))
    asked = cuts.select("of", F.explode(halves).alias("h")).select("of", hash_of(F.col("h.part")).alias("h"), "h.value").withColumn("shard", shard_of(F.col("h"), width))
    read = read_counts(counted, materialize(asked, "asked-parts"), share)
    sides = read.repartition("of").groupBy("of", F.floor(F.col("value") / 2).alias("k")).agg(F.max(F.when(F.col("value") % 2 == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("value") % 2 == 1, F.col("n"))).alias("r"))
    scored = sides.join(found.select("of", "key", "a"), "of").withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"))
    best = scored.groupBy("of", "key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the most frequent longer candidate around each phrase
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: _part(words, at, n))))
    around = found.filter(size > 2).select(F.explode(inner).alias("part"), "a").groupBy(hash_of(F.col("part")).alias("of")).agg(F.max("a").alias("outer"))
    kept = best.join(around, "of", "left").filter("outer IS NULL OR CAST(100 AS DECIMAL(3,0)) * outer < CAST(80 AS DECIMAL(2,0)) * a")
    named_ = kept.select(language(F.col("key")).alias("lang"), phrase(F.col("key")).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named_.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(word_totals(local), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language of `documents`; nulls, ties and empty tables as in collocations."""
    return collocations(documents(spark, sf_dir))


ORACLE_SQL = {
    "op11_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]'), lambda x: x <> '') AS w FROM p),
        n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
        f AS (SELECT lang, g, count(*) AS a FROM g GROUP BY lang, g HAVING count(*) >= 30),
        c AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
        s AS (SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
              FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        i AS (SELECT lang, g[j:j + m - 1] AS g, a FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS j FROM (SELECT lang, g, a, unnest(range(2, len(g))) AS m FROM f WHERE len(g) > 2))),
        o AS (SELECT lang, g, max(a) AS a FROM i GROUP BY lang, g),
        z AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.a IS NULL OR 100 * o.a < 80 * b.a),
        t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z)
        SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, n.n::BIGINT AS n, t.score::BIGINT AS score FROM t JOIN n ON n.lang = t.lang WHERE t.rank <= 2000
    """
}
