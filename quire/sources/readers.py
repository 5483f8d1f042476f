"""Files and e-books as rows."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".txt", ".epub"]
LEAST_BYTES = 512
ENCODINGS = ["utf-8-sig", "utf-8", "cp949", "gb18030", "utf-16"]
SKIPPED = ("cover", "nav", "toc", "titlepage", "metadata")


def scan_folder(spark: SparkSession, path: str, least: int = LEAST_BYTES) -> DataFrame:
    """path, file_name, file_ext, length and content of the text and e-book files below a folder."""
    return _book_files(spark, [path], least)


def scan_folders(spark: SparkSession, folders: list[str | None], least: int = LEAST_BYTES) -> DataFrame:
    """scan_folder of several folders; empty names and folders that are not there are passed over."""

    def there(folder: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    found = [f for f in dict.fromkeys(folders) if f and there(f)]
    if not found:
        return spark.createDataFrame([], "path string, file_name string, file_ext string, length long, content binary")
    return _book_files(spark, found, least)


def _book_files(spark: SparkSession, paths: list[str], least: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.select("path", name.alias("file_name"), ext.alias("file_ext"), "length", "content").filter(F.col("file_ext").isin(EXTENSIONS) & (F.col("length") >= least))


def decode_text(data: bytes | None) -> tuple[str | None, str | None]:
    """(text, encoding): the first encoding that decodes with fewer than a tenth replaced."""
    for name in ENCODINGS if data is not None else []:
        if name == "utf-16" and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return data.decode(name), "utf-8" if name == "utf-8-sig" and data[:3] != b"\xef\xbb\xbf" else name
        except UnicodeDecodeError:
            continue
    if data is None:
        return None, None
    text = data.decode("utf-8", "replace")
    return (text, "utf-8") if text.count("�") < 0.1 * max(1, len(text)) else (None, None)


def with_text(files: DataFrame) -> DataFrame:
    schema = "path string, text string, encoding string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decode_text(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["path", "text", "encoding"])

    return files.select("path", "content").mapInArrow(run, schema)


def spine(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(position, name, html) of an e-book's documents in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("META-INF/container.xml"))
        opf = root.find(".//{*}rootfile").get("full-path")
        base = opf.rpartition("/")[0]
        package = ET.fromstring(z.read(opf))
        items = {i.get("id"): (i.get("href"), i.get("media-type")) for i in package.iterfind(".//{*}manifest/{*}item")}
        for n, ref in enumerate(package.iterfind(".//{*}spine/{*}itemref")):
            href, kind = items.get(ref.get("idref"), ("", ""))
            if kind == "application/xhtml+xml":
                yield n, href, z.read(f"{base}/{href}" if base else href).decode("utf-8", "replace")


def epub_items(files: DataFrame) -> DataFrame:
    """path, spine_pos, name, html of e-books; damaged ones give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rows = [(path, *x) for x in spine(data.as_py())]
                except (zipfile.BadZipFile, KeyError, AttributeError, ET.ParseError):
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "spine_pos", "name", "html"])

    return files.filter("file_ext = '.epub'").select("path", "content").mapInArrow(run, "path string, spine_pos int, name string, html string")


METADATA = "path string, title string, creator string, publisher string, language string, description string, subjects array<string>"


def package_metadata(data: bytes) -> tuple:
    """(title, creator, publisher, language, description, subjects) of an e-book's package; None where not given."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf = ET.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
        package = ET.fromstring(z.read(opf))
    dc = "{http://purl.org/dc/elements/1.1/}"
    first = [package.find(f".//{dc}{name}") for name in ("title", "creator", "publisher", "language", "description")]
    return (*[None if x is None else (x.text or "").strip() for x in first], [(x.text or "").strip() for x in package.iterfind(f".//{dc}subject")])


def epub_metadata(files: DataFrame) -> DataFrame:
    """One row for each e-book of files (path, content, file_ext); a damaged one has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.list_(pa.string())]
        names = [x.split()[0] for x in METADATA.split(", ")]
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rows.append((path, *package_metadata(data.as_py())))
                except (zipfile.BadZipFile, KeyError, AttributeError, TypeError, ET.ParseError):
                    rows.append((path, *[None] * 6))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return files.filter("file_ext = '.epub'").select("path", "content").mapInArrow(run, METADATA)


def chapters_only(items: DataFrame, least: int = 50) -> DataFrame:
    """Without covers, tables of contents and pages of little text (unless they hold an image)."""
    text = F.trim(F.regexp_replace("html", "<[^>]*>", ""))
    return items.filter(~F.lower("name").rlike("|".join(SKIPPED)) & ((F.length(text) >= least) | F.contains(F.lower("html"), F.lit("<img"))))


def sample_chunks(text, chunk: int = 32_768, parts: int = 30):
    """The whole text if short, else `parts` evenly spaced chunks from whole lines on."""
    step = F.floor(F.length(text) / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.when(i == 0, F.substr(text, F.lit(1), F.lit(chunk))).otherwise(F.regexp_replace(F.substr(text, i * step + 1, F.lit(chunk)), "(?s)^[^\n]*\n", "")))
    return F.when(F.length(text) <= chunk * parts, text).otherwise(F.array_join(cut, "\n[...SAMPLE_SKIP...]\n"))
