from pyspark.sql import functions as F

from quire.operators import boundaries, inputs
from quire.sources import epub_sink, readers
from quire.streaming import incremental


def test_bytes_of_texts(spark):
    texts = ["", None, "abc", "가나다라마", "aé🎉b", "🎉🎉🎉"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (4, 5, 6, 7, 9):
        got = df.select(inputs.head_bytes(F.col("t"), n), inputs.tail_bytes(F.col("t"), n)).collect()
        for t, (head, tail) in zip(texts, got):
            b = t.encode() if t is not None else None
            assert (head, tail) == ((None, None) if b is None else (b[:n].decode(errors="ignore"), b[-n:].decode(errors="ignore")))


def expected_sample(text, start, length, whole, chunk, parts):
    left = len(text) - start
    size = length if length and length < left else left
    if size <= 0:
        return ""

    def after(at, n):
        end = text.find("\n", at)
        return text[end + 1 : end + 1 + n] if end >= 0 else ""

    if size < whole:
        return after(start, size)
    pieces = [after(start + i * (size // parts), chunk) for i in range(parts)]
    return inputs.SKIP_MARK.join(pieces[:1] + [p for p in pieces[1:] if p])


def test_range_sample(spark):
    texts = ["", "one line", "a\nb", "\n".join(f"line 가 {i}" for i in range(100)), "x" * 300 + "\n" + "tail"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for start, length in ((0, None), (3, None), (3, 20), (50, 200), (2000, None)):
        c = inputs.range_sample(F.col("t"), F.lit(start), None if length is None else F.lit(length), 100, 30, 4)
        got = [r[0] for r in df.select(c).collect()]
        assert got == [expected_sample(t, start, length, 100, 30, 4) for t in texts] + [None]


def test_large_gaps(spark):
    m = spark.createDataFrame([(1, 10), (1, 300_000), (2, 5)], "doc_id long, pos long")
    z = spark.createDataFrame([(1, 400_000), (2, 40_000), (3, 60_000)], "doc_id long, size long")
    got = sorted(boundaries.large_gaps(m, z, F.lit(4)).collect())
    assert [(r.doc_id, r.start, r.end) for r in got] == [(1, 10, 300_000), (3, 0, 60_000)]
    assert got[0].priority == 299_990 / 100_000


def test_epub_metadata(spark):
    rows = [("a", epub_sink.build_epub("A & B", "who", [("1", "x")]), ".epub"), ("b", b"damaged", ".epub"), ("c", None, ".epub"), ("d", b"", ".txt")]
    got = readers.epub_metadata(spark.createDataFrame(rows, "path string, content binary, file_ext string")).collect()
    assert [tuple(r) for r in got] == [("a", "A & B", "who", None, "ko", None, []), ("b", *[None] * 6), ("c", *[None] * 6)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, line_num int, line string")
    assert inputs.mapping_pairs(none).count() == 0
    assert inputs.sections(spark.createDataFrame([(1, None), (2, "no mark")], "k long, text string"), "k").count() == 0
    wanted = spark.createDataFrame([("x",)], "genre string")
    assert inputs.prompt_for(wanted, spark.createDataFrame([], "name string, value string")).collect() == [("x", "")]
    assert inputs.completion(spark.createDataFrame([], "stage0 int"), ["stage0"]).first() == (0.0,)


def test_folders(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "deep" / "x.TXT").write_bytes("한글".encode("cp949") * 300)
    (tmp_path / "a" / "small.txt").write_bytes(b"x" * 511)
    (tmp_path / "a" / "enough.txt").write_bytes(b"x" * 512)
    (tmp_path / "a" / "other.pdf").write_bytes(b"x" * 900)
    got = readers.scan_folders(spark, [None, "", str(tmp_path / "none"), str(tmp_path / "a"), str(tmp_path / "a")])
    assert sorted(r.file_name for r in got.collect()) == ["enough.txt", "x.TXT"]
    assert {r.encoding: len(r.text) for r in readers.with_text(got).collect()} == {"utf-8": 512, "cp949": 600}
    assert readers.scan_folders(spark, [str(tmp_path / "none")]).count() == 0


def test_incremental_runs(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))

    def add(*keys):
        spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)

    def run():
        incremental.run_new_files(spark, source, "doc_id long, text string", lambda df: df.withColumn("n", F.length("text")), out, checkpoint)
        return sorted(r.doc_id for r in spark.read.parquet(f"{out}/batch=*").collect())

    add(1, 2)
    assert run() == [1, 2]
    add(2, 3)
    assert run() == [1, 2, 3] and run() == [1, 2, 3]
    # the last batch's results are there, but not that it ended: it runs again
    for f in (tmp_path / "state" / "commits").glob("*1*"):
        f.unlink()
    assert run() == [1, 2, 3]


def test_books_are_built_in_a_stream_of_rows(spark):
    rows = [(d, c, f"t{c}", None if c == 1 else f"body {c}\n<{d}>") for d in (1, 2, None) for c in (2, 0, 1)]
    made = epub_sink.epubs(spark.createDataFrame(rows, "doc_id long, cid int, title string, body string"))
    want = {d: epub_sink.build_epub(f"document {'nan' if d is None else d}", "", [(f"t{c}", "" if c == 1 else f"body {c}\n<{d}>") for c in range(3)]) for d in (1, 2, None)}
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: bytes(r.epub) for r in made.collect()} == want and {r.chapters for r in made.collect()} == {3}
