"""Segmentation: boundary flags, running counts, chapters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.text import strip
from .lines import by_line
from .records import PERMISSIVE

HEADING = "^.{1,29}$"
TITLE = 100
TAIL, SHORT = 20, 100
PROLOGUE = "Prologue (Pre-Match)"
# patterns that match any line, and what ends a line inside a text: fixed values
LINE_ENDS = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
INNER_ENDS = "[\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


GRAM, SHORT_GRAM = 8, 3
BITS = 24  # of a bitmap of pieces, as a power of two: 2 MB


def flagged(lines: DataFrame, pattern: str, titles: DataFrame | None = None) -> DataFrame:
    """is_boundary: the stripped line matches, or (with `titles`: title) holds one of them."""
    body = strip(F.col("line"))
    out = lines.withColumn("body", body).withColumn("is_boundary", (body != "") & body.rlike(pattern))
    if titles is None:
        return out
    held = holding(out.select("doc_id", "line_num", "body"), titles).withColumn("_held", F.lit(True))
    return out.join(held, ["doc_id", "line_num"], "left").withColumn("is_boundary", F.col("is_boundary") | F.coalesce("_held", F.lit(False))).drop("_held")


class Pieces:
    """Hashes of all pieces of given numbers of letters of many texts."""

    def __init__(self, texts: list[str], sizes: list[int]):
        joined = "".join(texts)
        self.letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        self.text = np.repeat(np.arange(len(texts)), lengths)
        self.left = np.repeat(ends, lengths) - np.arange(len(joined))  # letters from here to the text's end
        self.sizes = sizes

    def hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text number, hash) of the pieces of each size."""
        for n in self.sizes:
            if len(self.letters) < n:
                continue
            count = len(self.letters) - n + 1
            h = np.full(count, n, np.uint64)
            for i in range(n):
                h = (h ^ self.letters[i : count + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = self.left[:count] >= n
            yield self.text[:count][inside], h[inside].view(np.int64)


def slices(texts: list[str], letters: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The texts (numbers, texts) by parts of about so many letters; a longer text is cut, and its parts overlap."""
    numbers, some, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), letters):
            part = text[at : at + letters + GRAM - 1]
            if some and size + len(part) > letters:
                yield np.array(numbers), some
                numbers, some, size = [], [], 0
            numbers.append(i)
            some.append(part)
            size += len(part)
    if some:
        yield np.array(numbers), some


def size_of(title: str) -> int:
    return GRAM if len(title) >= GRAM else min(len(title), SHORT_GRAM)


def _bits(rows: DataFrame) -> np.ndarray:
    """A bitmap of a fixed size with a bit for each `piece`, however many: its words that are not zero are gathered."""
    place = F.pmod("piece", F.lit(1 << BITS))
    words = rows.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(piece, {1 << BITS}) % 64 as int))")).alias("bits"))
    got, bits = words.toPandas(), np.zeros(1 << BITS - 6, np.int64)
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return bits


def _known(bits: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    place = pieces & ((1 << BITS) - 1)
    return (bits[place >> 6] >> (place & 63)) & 1 != 0


def holding(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, line_num of the lines (doc_id, line_num, body) that hold one of the titles (title), however many.

    A title is looked for by one piece of it: of its pieces of GRAM letters (SHORT_GRAM, or all of it, if it is
    shorter) the one that the fewest lines have. Pieces of lines are hashed where the lines are. Of a first pass
    only counts of titles' pieces leave a task, of a second only lines with a bit of a title's rarest piece; these
    meet titles in an equality join, and are compared with them. A bitmap of a fixed size tells what a task
    lets through: it spares work and decides nothing. Null and empty titles are in no line.
    """
    known = titles.filter("title <> ''").select("title").distinct()
    title_schema = pa.schema([("title", pa.string()), ("size", pa.int32()), ("piece", pa.int64())])

    def of_titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_pylist()
            for n in sorted({size_of(t) for t in every}):
                some = [t for t in every if size_of(t) == n]
                for at, h in Pieces(some, [n]).hashes():
                    yield pa.RecordBatch.from_arrays([pa.array(some).take(pa.array(at)), pa.array(np.full(len(h), n, np.int32)), pa.array(h)], schema=title_schema)

    pieces = written(known.mapInArrow(of_titles, "title string, size int, piece long").distinct(), "title-pieces")
    sizes = sorted(r["size"] for r in pieces.select("size").distinct().collect())  # four lengths at most
    bits = _bits(pieces)
    body = lines.select("doc_id", "line_num", "body").filter("body IS NOT NULL")
    count_schema = pa.schema([("piece", pa.int64()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0).to_pylist()):
                for _, h in Pieces(texts, sizes).hashes():
                    found, n = np.unique(h[_known(bits, h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], schema=count_schema)

    common = body.select("body").mapInArrow(counted, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    rarest = pieces.join(common, "piece").groupBy("title").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    keyed = written(rarest, "title-keys")  # titles of which a piece is in no line are in none
    keys = _bits(keyed)

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, texts in slices(batch.column(2).to_pylist()):
                for at, h in Pieces(texts, sizes).hashes():
                    hit = _known(keys, h)
                    pairs = np.unique(np.stack([numbers[at[hit]], h[hit]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(pairs[:, 0])) for c in batch.columns), pa.array(pairs[:, 1])], names=["doc_id", "line_num", "body", "piece"])

    schema = body.withColumn("piece", F.lit(0).cast("long")).schema
    return body.mapInArrow(with_key, schema).join(keyed, "piece").filter(F.contains("body", "title")).select("doc_id", "line_num").distinct()


def chapters(flags: DataFrame, min_body: int = 1) -> DataFrame:
    """doc_id, cid, title, body, length, line_num: text before the first boundary is left out, and so
    are chapters whose body is shorter than min_body; cid counts those that stay."""
    seg = F.sum(F.col("is_boundary").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    numbered = flags.withColumn("seg", seg).filter("seg > 0")
    parts = F.sort_array(F.collect_list(F.struct("line_num", "line", "is_boundary")))
    grouped = numbered.groupBy("doc_id", "seg").agg(parts.alias("p"))
    made = grouped.select("doc_id", "seg", F.col("p")[0]["line_num"].alias("line_num"), F.substring(strip(F.col("p")[0]["line"]), 1, TITLE).alias("title"), F.array_join(F.transform(F.slice("p", 2, 1 << 30), lambda x: x["line"]), "\n").alias("body"))
    kept = made.withColumn("length", F.length("body").cast("long")).filter((F.length(strip(F.col("body"))) > 0) & (F.col("length") >= min_body))
    return kept.withColumn("cid", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")) - 1).select("doc_id", "cid", "title", "body", "length", "line_num")


TYPES = ["본편", "외전", "에필로그", "작가의 말", "기타"]


def chapter_type(title: Column) -> Column:
    # fixed values, first hit wins
    t = F.lower(title)
    return F.when(t.rlike("작가의 말|작가 후기|후기"), "작가의 말").when(t.rlike("에필로그|epilogue|후일담"), "에필로그").when(t.rlike("외전|번외|특별편|side story"), "외전").otherwise("본편")


def type_summary(chapters: DataFrame) -> DataFrame:
    """chapters: doc_id, cid, title. A row for each document and type, types without chapters included: n, and
    its first and last chapter from 1 on (0 without any); total counts all chapters of the document."""
    kind = chapter_type(F.col("title"))
    aggs = [F.struct(F.lit(t).alias("chapter_type"), F.count_if(kind == t).alias("n"), F.coalesce(F.min(F.when(kind == t, F.col("cid"))) + 1, F.lit(0)).cast("long").alias("first"), F.coalesce(F.max(F.when(kind == t, F.col("cid"))) + 1, F.lit(0)).cast("long").alias("last")) for t in TYPES]
    all_types = chapters.groupBy("doc_id").agg(F.count("*").alias("total"), F.array(*aggs).alias("t"))
    return all_types.select("doc_id", "total", F.explode("t").alias("t")).select("doc_id", "total", "t.*")


def _without(pattern: str) -> Column:
    """The body without the pieces that match."""
    return strip(F.array_join(F.filter(F.split("body", LINE_ENDS), lambda x: ~strip(x).rlike(pattern)), "\n"))


def chapters_by_rules(lines: DataFrame, pattern: str, titles: DataFrame | None = None) -> DataFrame:
    """doc_id, cid, title, body, length, line_num: chapters by a pattern and, with `titles` (doc_id, title),
    by the titles given for the document, which any line that holds one of them begins.

    A heading followed by more than TAIL letters is cut where the match ends, and what follows begins the
    body. A heading with [..] in its first 50 letters and the heading on the very next line are one title,
    joined by " | ". In bodies but a document's last, pieces that match the pattern go, and a chapter of
    fewer than SHORT letters whose title has no digit goes with its text. Given titles are taken whole; with
    a pattern that matches any line they alone count, and nothing is taken out. Text before the first
    heading is left out, as are chapters without text; null and empty texts have no chapters, repeated
    titles count once.
    """
    given, any_line = titles is not None, pattern in PERMISSIVE
    body = strip(F.col("line"))
    found, listed = body.rlike(pattern), F.lit(False)
    rows = lines.select("doc_id", "line_num", "line")
    if given:
        known = titles.filter("title is not null").groupBy("doc_id").agg(F.collect_set("title").alias("_titles"))
        rows = rows.join(known, "doc_id", "left")
        listed = F.coalesce(F.exists("_titles", lambda t: F.contains(body, t)), F.lit(False))
    mark = rows.select("doc_id", "line_num", "line", body.alias("own"), ((body != "") & (listed if given and any_line else found | listed)).alias("b"))
    short_title = strip(F.substring("own", 1, TITLE))
    head = F.when(F.col("b") & F.lit(not given), F.regexp_extract("own", f"^(?s:.*?)(?:{pattern})", 0))
    tail = F.when(head.isNotNull(), strip(F.substr("own", F.length(head) + 1)))
    cut = F.coalesce(F.length(tail) > TAIL, F.lit(False))
    opens = F.col("b") & F.lit(not given) & ~cut & F.substring("own", 1, 50).rlike(r"\[.*?\]")
    seen = mark.select("doc_id", "line_num", "line", "b", opens.alias("opens"), F.when(cut, strip(head)).otherwise(short_title).alias("name"), F.when(cut, tail).alias("tail"))
    # of a run of headings that open, each second one was joined to the one before
    run = F.col("line_num") - 1 - F.coalesce(F.last(F.when(~F.col("opens"), F.col("line_num")), ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    joined = seen.withColumn("joined", F.col("b") & (run % 2 == 1))
    begins = F.sum((F.col("b") & ~F.col("joined")).cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    second = F.when(F.lead("joined").over(by_line()), F.lead("name").over(by_line()))
    second_title = F.concat_ws(" | ", "name", second)
    parts = joined.withColumns({"seg": begins, "name": F.when(F.col("b") & ~F.col("joined"), F.when(second.isNull(), F.col("name")).otherwise(second_title))}).filter("seg > 0")
    piece = F.struct("line_num", F.when(F.col("b"), F.col("tail")).otherwise(F.col("line")).alias("t"))
    made = parts.groupBy("doc_id", "seg").agg(F.min("line_num").alias("line_num"), F.max("name").alias("title"), F.sort_array(F.collect_list(piece)).alias("p"), F.max(F.col("b") & F.col("tail").isNotNull()).alias("tails"))
    whole = strip(F.array_join(F.transform("p", lambda x: x["t"]), "\n"))  # headings without a tail are null and not joined
    made = made.select("doc_id", "seg", "line_num", "title", whole.alias("body"), "tails", (F.col("seg") == F.max("seg").over(Window.partitionBy("doc_id"))).alias("last"))
    if not (given and any_line):
        # a line that is no heading is blank or does not match; what may match is a tail, a piece between line ends
        # inside a line, or a blank piece
        may_match = F.col("tails") | F.col("body").rlike(INNER_ENDS) | F.lit("").rlike(pattern)
        made = made.withColumn("body", F.when(F.col("last") | ~may_match, F.col("body")).otherwise(_without(pattern)))
        made = made.filter(F.col("last") | (F.length("body") >= SHORT) | F.col("title").rlike(r"\p{Nd}"))
    cid = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")) - 1
    return made.filter("body <> ''").select("doc_id", cid.alias("cid"), "title", "body", F.length("body").cast("long").alias("length"), "line_num")


def chapters_with_prologue(lines: DataFrame, pattern: str) -> DataFrame:
    """doc_id, cid, title, body, length, line_num: what comes before the first heading is chapter 0, even
    without text; later chapters of fewer than SHORT letters go with their text, but for a document's last
    (which stays if a line follows its heading). Pieces that match the pattern go from all bodies but the
    last. A title is its whole line. Null and empty texts have no chapters."""
    own = strip(F.col("line"))
    mark = lines.select("doc_id", "line_num", "line", own.alias("own"), own.rlike(pattern).alias("b"))
    mark = mark.withColumn("seg", F.sum(F.col("b").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.struct("line_num", F.when(~F.col("b"), F.col("line")).alias("t"))
    made = mark.groupBy("doc_id", "seg").agg(F.min("line_num").alias("line_num"), F.max(F.when(F.col("b"), F.col("own"))).alias("title"), F.sort_array(F.collect_list(piece)).alias("p"))
    last = F.col("seg") == F.max("seg").over(Window.partitionBy("doc_id"))
    made = made.select("doc_id", "seg", "line_num", F.coalesce("title", F.lit(PROLOGUE)).alias("title"), strip(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("body"), F.exists("p", lambda x: x["t"].isNotNull()).alias("any"), last.alias("last"))
    made = made.withColumn("body", F.when(F.col("last"), F.col("body")).otherwise(_without(pattern)))
    own_row = F.when(F.when(F.col("last"), F.col("any")).otherwise((F.col("seg") == 0) | (F.length("body") >= SHORT)), F.struct("seg", "line_num", "title", "body"))
    none_before = F.when((F.col("seg") == 1) & (F.col("line_num") == 0), F.struct(F.lit(0).cast("long").alias("seg"), F.lit(0).alias("line_num"), F.lit(PROLOGUE).alias("title"), F.lit("").alias("body")))
    kept = made.select("doc_id", F.inline(F.array_compact(F.array(none_before, own_row))))
    cid = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")) - 1
    return kept.select("doc_id", cid.alias("cid"), "title", "body", F.length("body").cast("long").alias("length"), "line_num")


def split_at(lines: DataFrame, boundaries: DataFrame) -> DataFrame:
    """A chapter for each boundary (doc_id, line_num), empty bodies too; body lines lie strictly between."""
    marks = boundaries.select("doc_id", "line_num", F.lit(True).alias("is_boundary")).distinct()
    return _spans(lines.join(marks, ["doc_id", "line_num"], "left").withColumn("is_boundary", F.coalesce("is_boundary", F.lit(False))))


def _spans(flags: DataFrame) -> DataFrame:
    seg = F.sum(F.col("is_boundary").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    grouped = flags.withColumn("seg", seg).filter("seg > 0").groupBy("doc_id", "seg").agg(F.sort_array(F.collect_list(F.struct("line_num", "line"))).alias("p"))
    return grouped.select("doc_id", (F.col("seg") - 1).cast("int").alias("cid"), F.col("p")[0]["line_num"].alias("line_num"), strip(F.col("p")[0]["line"]).alias("title"), F.array_join(F.transform(F.slice("p", 2, 1 << 30), lambda x: x["line"]), "\n").alias("body"), (F.element_at("p", -1)["line_num"] + 1).alias("end_line"))


def merge_short(chaps: DataFrame, least: int = 100) -> DataFrame:
    """Short chapters go to the one before; leading short ones form a preface (group 0)."""
    group = F.sum((F.col("length") >= least).cast("int")).over(Window.partitionBy("doc_id").orderBy("cid").rowsBetween(Window.unboundedPreceding, 0))
    parts = F.sort_array(F.collect_list(F.struct("cid", "title", "body")))
    return chaps.withColumn("grp", group).groupBy("doc_id", "grp").agg(parts.alias("p")).select("doc_id", F.col("grp").cast("long").alias("grp"), F.col("p")[0]["title"].alias("title"), F.size("p").cast("long").alias("merged"), F.array_join(F.transform("p", lambda x: x["body"]), "\n").alias("body"))


def coverage(flags: DataFrame, ratio: float = 0.99, tail: int = 20_000) -> DataFrame:
    """How far into a document's bytes the last boundary lies; needs byte_pos."""
    out = flags.groupBy("doc_id").agg(F.count_if("is_boundary").alias("matches"), F.coalesce(F.max(F.when(F.col("is_boundary"), F.col("byte_pos"))), F.lit(0)).alias("last_pos"), F.max(F.col("byte_pos") + F.octet_length("line")).alias("size"))
    share = F.coalesce(F.col("last_pos") / F.nullif("size", F.lit(0)), F.lit(0.0))
    return out.withColumns({"coverage": share, "tail": F.col("size") - F.col("last_pos")}).withColumn("ok", (F.col("matches") > 0) & ((F.col("coverage") > ratio) | (F.col("tail") < tail)))
