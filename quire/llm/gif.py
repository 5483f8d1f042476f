"""GIF media columns.

frames_of() reads any GIF: LZW code streams (deferred clears included), global and local palettes,
interlacing, disposal methods and transparency, and gives timed frames as they are shown, one by one: a
task holds one screen at a time. encode() stores 8-bit samples without loss, as palette indices of a
grey palette. The frame table has a row for each frame: its time, place, pixels (one sample a pixel where
the screen is grey, three otherwise), where it is painted, and a colour histogram in three columns.

Damaged files: frames before the damage are returned, with the reason in `error`.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, documents, map_columns, materialize, named

CLEAR, END, TOP = 256, 257, 4096
WIDTH, MOST_ROWS = 64, 65_535
BINS = 8
GREY = bytes(v for i in range(256) for v in (i, i, i))
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "4", "parquet.page.size": str(4 << 20)}


def _widths(n: int, code_size: int, clear: int) -> np.ndarray:
    """Bits of the codes 0 .. n-1 after a clear: the table has one entry less than codes read."""
    entries = clear + 1 + np.maximum(np.arange(n), 1)
    bits = np.floor(np.log2(entries)).astype(np.int64) + 1
    return np.clip(bits, code_size + 1, 12)


_ENCODER_WIDTHS = _widths(TOP, 8, CLEAR)
_BITS = np.arange(16)


@functools.cache  # for each of the seven code sizes
def _decoder(code_size: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The first entries of a table, the widths of codes after a clear, and where these codes begin."""
    clear = 1 << code_size
    schedule = _widths(TOP - clear, code_size, clear)
    return [bytes([i]) for i in range(clear)] + [b"", b""], schedule, np.concatenate(([0], np.cumsum(schedule)))


def lzw_encode(data: bytes) -> bytes:
    """Code stream with 8-bit symbols; the table is cleared whenever it is full."""
    codes, lengths, table, since = [CLEAR], [], {}, 0
    following, append = CLEAR + 2, codes.append
    if data:
        prefix = data[0]
        for b in data[1:]:
            key = prefix << 8 | b
            code = table.get(key)
            if code is not None:
                prefix = code
                continue
            append(prefix)
            table[key] = following
            following += 1
            prefix = b
            if following == TOP:
                append(CLEAR)
                lengths.append(len(codes) - 1 - since)
                since = len(codes) - 1
                table.clear()
                following = CLEAR + 2
        append(prefix)
    append(END)
    # widths: each run after a clear counts from 0 again; the clear that ends a run belongs to it
    widths = np.concatenate([[9], *[_ENCODER_WIDTHS[:n] for n in lengths], _ENCODER_WIDTHS[: len(codes) - 1 - since]])
    # the 16 bits of each code, lowest first, of which the first `width` are kept
    bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[_BITS < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, code_size: int) -> bytes:
    """Symbols of a code stream; a stream that ends early gives what it held, a code beyond the
    table raises ValueError."""
    clear, end = 1 << code_size, (1 << code_size) + 1
    data = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, at, out = 8 * len(stream), 0, []
    roots, schedule, offsets = _decoder(code_size)
    full, step = 12, len(schedule)
    table, before, begun, append = list(roots), b"", 0, out.append
    while at < total:
        # codes up to the next clear or end: their widths depend only on how many came since the last one
        if begun < step:
            place, width = at + offsets[begun:-1] - offsets[begun], schedule[begun:]
        else:
            place, width = at + full * np.arange(4 * TOP), np.full(4 * TOP, full)
        inside = int(np.searchsorted(place + width, total, side="right"))  # codes lie one after the other
        place, width = place[:inside], width[:inside]
        if not inside:
            break
        byte = place >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (place & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        size = len(table)
        for code in codes[:n].tolist():
            if code < size:
                entry = table[code]
            elif code == size and before:
                entry = before + before[:1]
            else:
                raise ValueError("a code beyond the table")
            append(entry)
            if before and size < TOP:
                table.append(before + entry[:1])
                size += 1
            before = entry
        if not len(stops):
            at, begun = int(place[-1] + width[-1]), begun + n
            continue
        at = int(place[n] + width[n])
        if codes[n] == end:
            break
        table, before, begun = list(roots), b"", 0
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, delay: int = 10) -> bytes:
    """A GIF of 64 samples a row; more rows than a frame can have go on in further frames (each is cleared
    before the next)."""
    rows = [payload[i : i + WIDTH * MOST_ROWS] for i in range(0, len(payload), WIDTH * MOST_ROWS)]
    high = len(rows[0]) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, high, 0xF7, 0, 0), GREY]
    for part in rows:
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    transparent: int | None
    shown: np.ndarray  # the whole screen: height x width x 3; valid until the next frame is asked for
    covered: np.ndarray  # where the screen has been painted: height x width


class Damaged(ValueError):
    pass


def frames_of(data: bytes) -> Iterator[Frame]:
    """The frames one by one; Damaged is raised after the frames before the damage."""
    try:
        yield from _frames(data)
    except (ValueError, IndexError, struct.error) as e:
        raise Damaged(str(e) or type(e).__name__) from e


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    screen_width, screen_height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        if len(data) < at + 3 * n:
            raise ValueError("a cut palette")
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    common = None
    if flags & 0x80:
        common, at = palette(flags, at)
    screen = np.zeros((screen_height, screen_width, 3), np.uint8)
    covered = np.zeros((screen_height, screen_width), bool)
    delay, disposal, transparent = 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            block, at = sub_blocks(at + 1)
            if label == 0xF9 and len(block) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", block)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = common
        if flags & 0x80:
            colours, at = palette(flags, at)
        if colours is None:
            raise ValueError("no palette")
        code_size = data[at]
        if not 2 <= code_size <= 8:
            raise ValueError("a wrong code size")
        stream, at = sub_blocks(at + 1)
        samples = lzw_decode(stream, code_size)
        if len(samples) < width * height:
            raise ValueError("a cut frame")
        index = np.frombuffer(samples, np.uint8, width * height).reshape(height, width)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        if int(index.max(initial=0)) >= len(colours):
            raise ValueError("a sample beyond the palette")
        w, h = max(0, min(width, screen_width - left)), max(0, min(height, screen_height - top))
        area = (slice(top, top + h), slice(left, left + w))
        painted = index[:h, :w] != transparent if transparent is not None else np.ones((h, w), bool)
        kept = (screen[area].copy(), covered[area].copy())
        screen[area][painted] = colours[index[:h, :w][painted]]
        covered[area] |= painted
        yield Frame(left, top, width, height, delay, disposal, transparent, screen, covered)
        if disposal == 2:
            screen[area], covered[area] = 0, False
        elif disposal == 3:
            screen[area], covered[area] = kept
        delay, disposal, transparent = 0, 0, None


def histogram(frame: Frame, bins: int = BINS) -> list[int]:
    """Painted pixels in each of `bins` equal ranges of red, then green, then blue."""
    seen = frame.shown[frame.covered].astype(np.int64) * bins >> 8
    return np.concatenate([np.bincount(seen[:, k], minlength=bins) for k in range(3)]).tolist() if len(seen) else [0] * (3 * bins)


FRAME = "frame int, at int, delay int, disposal int, `left` int, top int, width int, height int, screen_width int, screen_height int, mode string, pixels binary, covered binary, red array<long>, green array<long>, blue array<long>"
TOTALS = "frames int, own_bytes long, own_sha256 string, own_tail_crc32 long, reds array<long>"


def gif_frames(df: DataFrame, keep: list[str], gif_col: str = "gif", pixels: bool = True) -> DataFrame:
    """One row a frame: the columns `keep`, then

    * frame, at (hundredths of a second from the start), delay, disposal, left, top, width, height (of the
      frame), screen_width, screen_height, mode (L: a sample a pixel, RGB: three), pixels (of the whole screen
      as shown) and covered (a bit for each pixel that is painted; null if all are); without `pixels` these two
      are null;
    * red, green and blue: painted pixels in BINS equal ranges;
    * in the file's last row, else null: frames, and own_bytes, own_sha256, own_tail_crc32 (of the last 64)
      of all frames' own rectangles put together, and reds, the sum of the red histograms;
    * error.

    A null, empty or damaged file gives a row with frame null and its error, after the frames before
    the damage. Repeated rows get frames each; an empty table gives none. A task holds one file and one
    screen at a time, and up to SLICE_BYTES of finished rows.
    """
    kinds = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    schema = f"{kinds}, {FRAME}, {TOTALS}, error string"
    n_frame, n_totals = FRAME.count(", ") + 1, TOTALS.count(", ") + 1

    def start():
        def rows_of(data: bytes) -> Iterator[list]:
            digest, total, tail, reds, at, number, row = hashlib.sha256(), 0, 0, np.zeros(BINS, np.int64), 0, 0, None
            try:
                for f in frames_of(data):
                    if row:
                        yield [*row, *[None] * n_totals, None]
                    grey = bool((f.shown == f.shown[..., :1]).all())
                    shown = f.shown[..., 0] if grey else f.shown
                    own = shown[f.top : f.top + f.height, f.left : f.left + f.width].tobytes()
                    bins = histogram(f)
                    red = bins[:BINS]
                    digest.update(own)
                    total, tail, reds = total + len(own), zlib.crc32(own[-WIDTH:]), reds + red
                    covered = np.packbits(f.covered).tobytes() if pixels and not f.covered.all() else None
                    row = [number, at, f.delay, f.disposal, f.left, f.top, f.width, f.height, f.shown.shape[1], f.shown.shape[0], "L" if grey else "RGB", shown.tobytes() if pixels else None, covered, red, bins[BINS : 2 * BINS], bins[2 * BINS :]]
                    at += f.delay
                    number += 1
                if row:
                    yield [*row, number, total, digest.hexdigest(), tail, reds.tolist(), None]
                else:
                    yield [*[None] * (n_frame + n_totals), "no frame"]
            except Damaged as e:
                if row:
                    yield [*row, number, total, digest.hexdigest(), tail, reds.tolist(), None]
                yield [*[None] * (n_frame + n_totals), str(e)]

        def each(*values):
            *keys, files = values
            done, size = [], 0
            for key, data in zip(zip(*keys), files):
                for row in rows_of(data or b""):
                    done.append((*key, *row))
                    size += 600 + (len(row[11] or b"") if pixels else 0)
                    if size > SLICE_BYTES:
                        yield [list(c) for c in zip(*done)]
                        done, size = [], 0
            if done:
                yield [list(c) for c in zip(*done)]

        return each

    rows = df.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], named(gif_col).alias("gif"))
    out = map_columns(rows, schema, start)
    return out.toDF(*keep, *out.columns[len(keep) :])


def pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and gif: the text's UTF-8 (null: none), padded with 0 to rows of 64 samples. Repeated
    rows are stored each; an empty table gives none; long texts go on in further frames."""

    def start():
        def each(ids, texts):
            data = [(t or "").encode() for t in texts]
            return [ids, [len(x) for x in data], [encode(pad(x)) for x in data]]

        return each

    rows = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return map_columns(rows, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, gif binary", start).toDF(id_col, "n_bytes", "gif")


def payload_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored GIFs into a stored frame table (timed frames, with their pixels and histograms), and from it one row a file: digests of the samples and of the file, and the frames' colour
    histogram. Repeated rows get a result each; an empty table gives none; a damaged file is an error."""
    files = media.select(named(id_col).alias("id"), "n_bytes", F.octet_length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"), "gif")
    table = materialize(gif_frames(files, ["id", "n_bytes", "media_bytes", "media_sha256"]), "gif-frames", **STORED)
    last = table.filter("frames is not null or error is not null")
    sound = F.when(F.col("error").isNull(), F.col("frames")).otherwise(F.raise_error(F.concat(F.lit("a stored GIF is damaged: "), F.col("error"))))
    bins = F.concat_ws(",", F.transform("reds", lambda b: b.cast("string")))
    feature = F.concat(F.lit("gif;"), "screen_width", F.lit("x"), "screen_height", F.lit(";frames="), sound, F.lit(";hist="), bins)
    return last.select(F.col("id").alias(id_col), "n_bytes", F.col("own_bytes").alias("payload_bytes"), F.col("own_sha256").alias("payload_sha256"), F.col("own_tail_crc32").alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every
    document: stored, read back and decoded; nulls, repeats and empty tables as in store."""
    return payload_features(materialize(store(documents(spark, sf_dir)), "gifs", **STORED))
