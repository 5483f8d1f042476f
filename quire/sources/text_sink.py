"""Chapters as formatted text, and books as ordered text files of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip
from ..operators.folds import dealt_by
from ..operators.segment import LINE_ENDS

# fixed values: the box around a title, and blank lines in a row
WIDTH, RULE, ABOVE, BELOW, BLANKS = 60, "━", 7, 3, 2
BLANK = " \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"  # SPACE less what ends a line
FILE_BYTES = 8 << 20
# folders that files are dealt to; what write_books lists, and what read_books gives
SHELVES = 256
FILES = pa.schema([("book", pa.int64()), ("part", pa.int64()), ("file", pa.string()), ("bytes", pa.int64())])
BOOKS = pa.schema([("book", pa.int64()), ("files", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def boxed_title(title: Column) -> Column:
    """The title, centred between two rules; `Name12화` and `Name-12화` become `Name - 12화`."""
    c = F.regexp_replace(strip(title), "([가-힣a-zA-Z])-?([0-9]+화)", "$1 - $2")
    pad = F.greatest(F.lit(0), WIDTH - F.length(c))
    left = F.floor(pad / 2).cast("int")
    middle = F.concat(F.repeat(F.lit(" "), left), c, F.repeat(F.lit(" "), pad - left))
    return F.concat_ws("\n", F.lit("\n" * (ABOVE - 1)), F.lit(RULE * WIDTH), middle, F.lit(RULE * WIDTH), F.lit("\n" * (BELOW - 1)))


def clean_body(body: Column) -> Column:
    """Lines without blanks at their ends, at most BLANKS blank lines in a row; a last line end begins no line.

    Each step is one pass over the text: an array of lines would be made again wherever it is named.
    """
    c = F.regexp_replace(F.regexp_replace(body, LINE_ENDS, "\n"), "\n\\z", "")
    c = F.regexp_replace(c, f"(?<![{BLANK}])[{BLANK}]++(?=\n|\\z)", "")
    c = F.regexp_replace(c, f"(?<!\n)\n{{{BLANKS + 2},}}+(?=[^\n])", "\n" * (BLANKS + 1))
    c = F.regexp_replace(c, f"\\A\n{{{BLANKS + 1},}}+(?=[^\n])", "\n" * BLANKS)
    c = F.regexp_replace(c, f"(?<=[^\n])\n{{{BLANKS + 1},}}+\\z", "\n" * BLANKS)
    return F.regexp_replace(c, f"\\A\n{{{BLANKS},}}+\\z", "\n" * (BLANKS - 1))


def formatted(chapters: DataFrame) -> DataFrame:
    """doc_id, cid, text of chapters (doc_id, cid, title, body); null titles and bodies count as empty."""
    title, body = (F.coalesce(c, F.lit("")) for c in ("title", "body"))
    return chapters.select("doc_id", "cid", F.concat(boxed_title(title), clean_body(body), F.lit("\n")).alias("text"))


def _file(root: str, name: str):
    """The file system of a folder that all executors share, and a path in it."""
    kind, at = fs.FileSystem.from_uri(root)
    return kind, f"{at}/{name}"


def write_books(chapters: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes formatted chapters (doc_id, cid, text) as path/shelf=<n>/<doc_id>-<part>.txt, and the list of these files as
    the table path/files (book, part, file, bytes): in the order of part a book's files are its chapters in the
    order of cid. A part ends with the chapter that fills it. Texts end with a line feed, as formatted gives them
    (a text without gets one).

    Parts are dealt by hash, so a long book is written by several tasks; a task holds a chapter at a time. A task
    that is run again writes the same files again, and files count once the list is committed. There is no
    folder a book, and no commit a file.
    """
    before = Window.partitionBy("doc_id").orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("text").cast("long")).over(before), F.lit(0))
    shelf = F.pmod(F.xxhash64("doc_id"), F.lit(SHELVES)).cast("int")
    rows = chapters.select(F.col("doc_id").alias("book"), F.floor(at / file_bytes).alias("part"), shelf.alias("shelf"), "cid", "text")
    rows = dealt_by(rows, ["book", "part"]).sortWithinPartitions("book", "part", "cid").select("book", "part", "shelf", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, key, size, done = None, None, None, 0, []
        made: set[int] = set()

        def names(book: int | None, part: int, shelf: int) -> str:
            return f"shelf={shelf:03d}/{'none' if book is None else book}-{part:09d}.txt"

        def close() -> None:
            if out is not None:
                out.close()
                done.append((key[0], key[1], names(*key), size))

        def listed() -> pa.RecordBatch:
            columns = zip(*done)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FILES)], schema=FILES)
            done.clear()
            return batch

        for batch in batches:
            for book, part, shelf, text in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or (book, part, shelf) != key:
                    close()
                    key, size = (book, part, shelf), 0
                    store, name = _file(path, names(*key))
                    if shelf not in made:
                        store.create_dir(name.rpartition("/")[0], recursive=True)
                        made.add(shelf)
                    out = store.open_output_stream(name, buffer_size=1 << 16)
                data = (text or "").encode()
                data = data if data.endswith(b"\n") else data + b"\n"
                out.write(data)
                size += len(data)
            if done:
                yield listed()
        close()
        if done:
            yield listed()

    rows.mapInArrow(run, "book long, part long, file string, bytes long").write.parquet(f"{path}/files")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """book, files, bytes and sha256 of each book that write_books wrote, its files read in order, piece by piece."""
    rows = spark.read.parquet(f"{path}/files").select("book", "part", "file")
    rows = dealt_by(rows, ["book"]).sortWithinPartitions("book", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, files, size, digest = None, 0, 0, None

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), BOOKS)], schema=BOOKS)

        for batch in batches:
            found = []
            for b, _, file in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or b != book:
                    if digest is not None:
                        found.append((book, files, size, digest.hexdigest()))
                    book, files, size, digest = b, 0, 0, hashlib.sha256()
                store, name = _file(path, file)
                files += 1
                with store.open_input_stream(name) as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
                        size += len(piece)
            if found:
                yield made(found)
        if digest is not None:
            yield made([(book, files, size, digest.hexdigest())])

    return rows.mapInArrow(run, "book long, files long, bytes long, sha256 string")
