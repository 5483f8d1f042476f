"""Token-id shards as sorted-string tables.

A shard is a range of ids; its documents lie, in ascending id order, in one or more tables of about
TABLE_BYTES, each a file of its own:

    data blocks     entries whose keys share prefixes: shared, unshared and value lengths as varints,
                    the key's unshared bytes, the value; every RESTART-th key is stored whole; a
                    trailer of restart offsets; blocks are compressed with zlib
    index block     for each data block: last key, offset, stored length
    filter block    Bloom filter over the ids
    footer          offsets and lengths of index and filter, shard and table number, documents, tokens,
                    blocks, hashes of the filter, magic; the file ends with a line end

A key is the id as 8 bytes big-endian with the sign flipped (so that bytes sort as numbers; a null id has
the least), then the row's place in the input as 8 bytes, which tells repeats of an id apart. A value
holds the width of its ids and the token ids as little-endian unsigned 16-bit (32-bit if one needs it).
Spark's writer commits the files, so they survive lost tasks and reach any store. Numbers in file names rise as the
keys do: a lookup searches the files, then the index, then the block's restarts by halves, and reads
only footers, indexes, one filter and the blocks of that id.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MEMO_BYTES, Memo, documents, materialize, named, shared_path, shuffle_partitions, small_batches
from .token_counts import byte_letters

BLOCK = 64 << 10
TABLE_BYTES = 16 << 20
RESTART = 16
FOOTER = struct.Struct("<QQQQqqQQQI8s")
MAGIC = b"QSSTBL02"
BITS_PER_KEY = 10
NULL_KEY = -(1 << 63)
KEY = 16
ENTRY = KEY + 12


def prefix_of(doc_id: int | None) -> bytes:
    return struct.pack(">Q", (NULL_KEY if doc_id is None else doc_id) + (1 << 63))


def key_of(doc_id: int | None, place: int = 0) -> bytes:
    return prefix_of(doc_id) + struct.pack(">Q", place)


def id_of(key: bytes) -> int | None:
    doc_id = struct.unpack_from(">Q", key)[0] - (1 << 63)
    return None if doc_id == NULL_KEY else doc_id


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, bits: bytearray | bytes, hashes: int):
        self.bits, self.hashes = bits, hashes

    def places(self, key: bytes) -> Iterator[int]:
        a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
        return ((a + i * b) % (8 * len(self.bits)) for i in range(self.hashes))

    def add(self, key: bytes) -> None:
        for p in self.places(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key))


class TableWriter:
    """add() in key order; finish() returns the table."""

    def __init__(self, shard: int, part: int):
        self.shard, self.part, self.offset, self.docs, self.tokens = shard, part, 0, 0, 0
        self.stored, self.index, self.ids = [], [], []
        self.begin()

    def begin(self) -> None:
        self.block, self.restarts, self.last, self.count = bytearray(), [], b"", 0

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        shared = 0
        if self.count % RESTART:
            while shared < KEY and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(KEY - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.count += 1
        self.docs += 1
        self.tokens += tokens
        self.ids.append(key[:8])
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.count:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            stored = zlib.compress(raw, 1)
            self.index.append((self.last, self.offset, len(stored)))
            self.stored.append(stored)
            self.offset += len(stored)
            self.begin()

    def finish(self) -> bytes:
        self.flush()
        index = b"".join(k + struct.pack("<QI", o, n) for k, o, n in self.index)
        bloom = Bloom(bytearray(max(8, len(self.ids) * BITS_PER_KEY // 8 + 1)), 7)
        for k in set(self.ids):
            bloom.add(k)
        at = self.offset
        footer = FOOTER.pack(at, len(index), at + len(index), len(bloom.bits), self.shard, self.part, self.docs, self.tokens, len(self.index), bloom.hashes, MAGIC)
        return b"".join([*self.stored, index, bytes(bloom.bits), footer])


class TableReader:
    """fetch(offset, length) reads from a file of `size` bytes; the footer and the index are read at once,
    filter and blocks when they are asked for."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int):
        self.fetch = fetch
        # the last byte is a line end
        at, n, self.filter_at, self.filter_n, self.shard, self.part, self.docs, self.tokens, blocks, self.hashes, magic = FOOTER.unpack(fetch(size - 1 - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of this format")
        index = fetch(at, n)
        self.index = [struct.unpack_from("<QI", index, i + KEY) for i in range(0, n, ENTRY)]
        self.last_keys = [index[i : i + KEY] for i in range(0, n, ENTRY)]
        if len(self.index) != blocks:
            raise ValueError("the index is damaged")

    @classmethod
    def of(cls, data: bytes) -> TableReader:
        return cls(lambda at, n: data[at : at + n], len(data))

    def block(self, k: int) -> tuple[bytes, list[int]]:
        raw = zlib.decompress(self.fetch(*self.index[k]))
        (count,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * count
        return raw[:end], list(struct.unpack_from(f"<{count}I", raw, end))

    @staticmethod
    def entries(raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            more, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            at += more
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.entries(self.block(k)[0])

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of all rows with this id: filter, then the index by halves, then the block's restarts by halves."""
        prefix = prefix_of(doc_id)
        if prefix not in Bloom(self.fetch(self.filter_at, self.filter_n), self.hashes):
            return []
        found: list[bytes] = []
        first = bisect_left(self.last_keys, prefix)
        for k in range(first, len(self.index)):
            raw, restarts = self.block(k)
            low, high = 0, len(restarts) - 1
            while low < high:
                middle = (low + high + 1) // 2
                if next(self.entries(raw, restarts[middle]))[0] < prefix:
                    low = middle
                else:
                    high = middle - 1
            for key, value in self.entries(raw, restarts[low]):
                if key[:8] > prefix:
                    return found
                if key[:8] == prefix:
                    found.append(value)
        return found


def unpack_ids(value: bytes) -> np.ndarray:
    """A value is its ids' width (2 or 4) and the ids."""
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


#: The rules of the tokenizer file for which words can be encoded apart: fixed values of its format.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters, numerals and white space of lower-case Latin-1 as SPLIT sees them, and SPLIT for such texts.
LETTERS, NUMERALS, BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", " \t-\r\x85\xa0"
PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMERALS}]|[^{BLANKS}{LETTERS}{NUMERALS}]+")


@lru_cache(maxsize=2)
def encoder(path: str):
    """(text -> packed ids, ids -> packed ids, width) by the tokenizers library.

    The file's rules drop white space and never join what stands on its two sides, so texts can be
    encoded word by word. A Latin-1 text is its own canonical form: it is lower-cased and split as the rules
    say, and each piece goes to the library's model; pieces that recur are remembered. Other words, and
    words that could hold an added token (matched in the raw text), go to the library as they are. A file
    with other rules gets whole texts.
    """
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), byte_letters()
    model = tokenizer.model
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
    letter = "H" if width == 2 else "I"

    shapes = [struct.Struct(f"<{n}{letter}") for n in range(32)]

    def packed(ids: list[int]) -> bytes:
        n = len(ids)
        return shapes[n].pack(*ids) if n < 32 else struct.pack(f"<{n}{letter}", *ids)

    def whole(text: str) -> bytes:
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    known = spec.get("normalizer") == NORMALIZER and steps[0].get("pattern") == {"Regex": SPLIT} and [s["type"] for s in steps] == ["Split", "ByteLevel"]
    mark = "<|"
    if not known or any(t["normalized"] or not t["content"].startswith(mark) for t in spec["added_tokens"]):
        return whole, packed, width

    def latin(text: str) -> bool:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return True

    def compute(p: str) -> bytes:
        if not (p.isascii() and p.isalpha()):
            p = p.encode().decode("latin-1").translate(letters)
        return packed([t.id for t in model.tokenize(p)])

    piece = Memo(compute)

    def compute_word(w: str) -> bytes:
        if w.isalpha():
            return compute(w)
        return b"".join(map(piece.__getitem__, PIECES.findall(w)))

    word = Memo(compute_word, 3 * MEMO_BYTES)  # of lower-case Latin-1 words
    other = Memo(lambda w: encode(w) if mark not in w and latin(w) else whole(w))

    def encode(text: str) -> bytes:
        if mark not in text and latin(text):
            return b"".join(map(word.__getitem__, text.lower().replace("\n", " ").split(" ")))
        return b"".join(map(other.__getitem__, text.replace("\n", " ").split(" ")))

    return encode, packed, width


def write_tables(df: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, table_bytes: int = TABLE_BYTES) -> None:
    """Encodes each whole text (null: empty), appends end_id and writes the tables.

    Shards are ranges of ids; tables end after the document with which they reach table_bytes. Rows of one
    id are told apart by place in the input, and a shard may end between them. An empty table of
    documents writes no table. A task holds one table at a time.
    """
    spark = df.sparkSession
    keys = ["id", "place"]
    rows = df.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shards or shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).select("id", "place", "text", F.spark_partition_id().alias("shard"))
    schema = pa.schema([("value", pa.binary())])
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packed, width = encoder(tokenizer)
        writer, part = None, 0
        head, tail = bytes([width]), b"" if end_id is None else packed([end_id])

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], schema=schema)

        for batch in batches:
            for doc_id, place, text, shard in zip(*batch.columns):
                writer = writer or TableWriter(shard.as_py(), part)
                ids = encode(text.as_py() or "") + tail
                writer.add(key_of(doc_id.as_py(), place.as_py()), head + ids, len(ids) // width)
                if writer.offset >= table_bytes:
                    yield done()
                    writer, part = None, part + 1
        if writer is not None:
            yield done()

    # a row is a table, a table is a file; a binary value cast to string is written by the text sink byte for byte
    tables = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    tables.write.option("maxRecordsPerFile", 1).text(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """shard, part (table of the shard), doc_id, local_start (ids before it in its table), n_tokens and
    ids_crc32 of each document. A task holds one table at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")
    names = ["shard", "part", "doc_id", "local_start", "n_tokens", "ids_crc32"]
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                table, rows, at = TableReader.of(content.as_py()), [], 0
                for key, value in table:
                    ids = unpack_ids(value)
                    rows.append((table.shard, table.part, id_of(key), at, len(ids), zlib.crc32(ids)))
                    at += len(ids)
                if (len(rows), at) != (table.docs, table.tokens):
                    raise ValueError("a table does not hold what its footer says")
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

    return files.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files.

    The driver gets one row a shard; tables inside a shard are summed up there.
    """
    rows = materialize(read_tables(spark, path), "token-rows")
    tables = rows.groupBy("shard", "part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("shard").orderBy("part")) - F.col("tokens")
    tables = materialize(tables.withColumn("in_shard", before), "token-tables")
    starts, at = [], 0
    for r in sorted(tables.groupBy("shard").agg(F.sum("tokens").alias("n")).collect()):
        starts.append((r["shard"], at))
        at += r["n"]
    offsets = tables.join(spark.createDataFrame(starts, "shard long, first long"), "shard").select("shard", "part", (F.col("first") + F.col("in_shard")).alias("first"))
    return rows.join(offsets, ["shard", "part"]).select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_id: int | None) -> list[np.ndarray]:
    """The token ids of every row with this id (none: an empty list), by ranged reads from the driver."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # one entry a table
    files = sorted((*map(int, m.groups()), f.getLen(), f.getPath()) for f in store.listStatus(folder) if f.getLen() and (m := re.match(r"part-(\d+)-.*-c(\d+)", f.getPath().getName())))

    def table(k: int) -> TableReader:
        def fetch(at: int, n: int) -> bytes:
            stream = store.open(files[k][3])
            try:
                stream.seek(at)
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
            finally:
                stream.close()

        return TableReader(fetch, files[k][2])

    low, high, prefix = 0, len(files), prefix_of(doc_id)
    while low < high:
        middle = (low + high) // 2
        if table(middle).last_keys[-1] < prefix:
            low = middle + 1
        else:
            high = middle
    found: list[np.ndarray] = []
    for k in range(low, len(files)):
        values = table(k).get(doc_id)
        if not values:
            break
        found += map(unpack_ids, values)
    return found


def op5_sstables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document (null and empty texts have the end id alone,
    repeated rows a place each; no documents, no rows), read back from the tables just written."""
    import public_tokenizers

    path = shared_path(spark, "token-tables")
    write_tables(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_table(spark, path)
