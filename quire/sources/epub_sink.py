"""E-book files from chapters."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SLICE_BYTES = 8 << 20  # of finished files in a batch


def build_epub(title: str, author: str, chapters: list[tuple[str, str]]) -> bytes:
    """A valid e-book: mimetype first and stored, chapters numbered from 1, fixed times."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, data: str, stored: bool = False) -> None:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
            z.writestr(info, data)

        put("mimetype", "application/epub+zip", True)
        put("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        names = [f"Text/chapter_{n:04d}.xhtml" for n in range(1, len(chapters) + 1)]
        for name, (head, body) in zip(names, chapters):
            paragraphs = "".join(f"<p>{escape(x.strip())}</p>" for x in (body or "").split("\n") if x.strip())
            put(f"OEBPS/{name}", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(head)}</title></head><body><h2>{escape(head)}</h2>{paragraphs}</body></html>')
        entries = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters))
        put("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{entries}</ol></nav></body></html>')
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
        put("OEBPS/content.opf", f'<?xml version="1.0"?><package version="3.0" xmlns="http://www.idpf.org/2007/opf" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>ko</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{refs}</spine></package>')
    return out.getvalue()


def epubs(chapters: DataFrame) -> DataFrame:
    """doc_id, title, chapters (their number) and epub (bytes) of each document's chapters (doc_id, cid, title, body)."""
    # a document's chapters come as one row, in their order, and a task builds rows one after another
    rows = chapters.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cid", "title", "body"))).alias("c"))
    schema = pa.schema([("doc_id", pa.int64()), ("title", pa.string()), ("chapters", pa.int64()), ("epub", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size = [], 0
            for doc, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                heads, bodies = (found.values.field(n).to_pylist() for n in ("title", "body"))
                title = f"document {'nan' if doc is None else doc}"
                done.append((doc, title, len(heads), build_epub(title, "", list(zip(heads, bodies)))))
                size += len(done[-1][3])
                if size > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, title string, chapters long, epub binary")
