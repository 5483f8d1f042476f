import pytest

from quire.llm import common, gif


def test_stored_gifs_are_compressed(spark):
    gif.op9_gif(spark, "/root/testdata/sf0.001").count()
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(f"{common.shared_root(spark)}/quire-{spark.sparkContext.applicationId}/gifs-*/*.parquet")
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)]
    assert names and all(n.endswith(".zstd.parquet") for n in names)


def test_schedules_are_made_once_and_codes_are_unchanged():
    """Widths of codes, first entries and the palette were made for every file."""
    import random

    rng = random.Random(3)
    texts = [b"", b"a", b"ab" * 5000, bytes(rng.randrange(256) for _ in range(9000)), bytes(rng.choice(b"abc ") for _ in range(30_000))]
    gif._decoder.cache_clear()
    for data in texts:
        stream = gif.lzw_encode(data)
        # codes one by one, with the width that the table has when they are written
        held, table, bits, width, prefix, at = 0, {}, 0, 9, b"", 258
        codes = [(256, 9)]
        for b in data:
            if not prefix or prefix + bytes([b]) in table:
                prefix += bytes([b])
                continue
            codes.append((table.get(prefix, prefix[0]), width))
            table[prefix + bytes([b])] = at
            prefix, at = bytes([b]), at + 1
            if at == 4096:
                codes.append((256, 12))
                table, at, width = {}, 258, 9
            elif at > 1 << width:
                width += 1
        codes += [(table.get(prefix, prefix[0] if prefix else None), width)] if prefix else []
        end = width + (len(codes) > 1 and codes[-1][0] != 256 and at + 1 > 1 << width)
        for code, w in [*codes, (257, min(12, end))]:
            held |= code << bits
            bits += w
        assert stream == held.to_bytes((bits + 7) // 8, "little")
        assert gif.lzw_decode(stream, 8) == data
    assert gif._decoder.cache_info().misses == 1 and len(gif.GREY) == 768
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\x00\xff\xff\xff", 8)
