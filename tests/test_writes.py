"""Versioned tables, the catalogue's writes, and runs whose counts outlive a restart."""

import pytest
from pyspark.sql import functions as F

from quire.sources import text_sink, versioned
from quire.streaming import incremental

FILE = "id long, file_path string, file_name string, file_size long, file_hash string, is_duplicate int, duplicate_of long"


def files(spark, rows):
    return spark.createDataFrame([(i, f"/in/{p}", p, size, "h", 0, None) for i, p, size in rows], FILE)


def state(tables, version=None):
    return {r.file_id: (r.stage0, r.stage4) for r in tables.read("processing_state", version).collect()}


def test_upsert_keeps_ids_and_resets_what_changed(spark, tmp_path):
    tables = versioned.catalogue(spark, str(tmp_path), buckets=4)
    change = versioned.index_files(tables.change(), files(spark, [(1, "a", 10), (2, "b", 10), (3, "c", 10)]))
    change.merge("processing_state", spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "file_id long, stage4 int")).commit()
    assert state(tables) == {1: (1, 1), 2: (1, 1), 3: (1, 1)}
    # b has changed, d is new, and ids given to known paths do not count
    versioned.index_files(tables.change(), files(spark, [(11, "a", 10), (12, "b", 11), (4, "d", 5)])).commit()
    assert {r.file_name: (r.id, r.file_size) for r in tables.read("files").collect()} == {"a": (1, 10), "b": (2, 11), "c": (3, 10), "d": (4, 5)}
    assert state(tables) == {1: (1, 1), 2: (1, 0), 3: (1, 1), 4: (1, 0)}
    # older versions stay readable
    assert state(tables, tables.versions()[-2]) == {1: (1, 1), 2: (1, 1), 3: (1, 1)}


def test_second_run_changes_nothing(spark, tmp_path):
    tables = versioned.catalogue(spark, str(tmp_path), buckets=4)
    scanned = files(spark, [(i, f"f{i}", i) for i in range(50)])
    first = versioned.index_files(tables.change(), scanned).commit()
    folders = tables.manifest()["tables"]["files"]["folders"]
    assert versioned.index_files(tables.change(), scanned).commit() == first
    assert versioned.prune_missing(tables.change(), scanned.select("file_path")).commit() == first
    # one changed row rewrites one bucket
    versioned.index_files(tables.change(), scanned.withColumn("file_size", F.when(F.col("id") == 7, 99).otherwise(F.col("file_size")).cast("long"))).commit()
    now = tables.manifest()["tables"]["files"]["folders"]
    assert sum(now[b] != folders[b] for b in now) == 1 and tables.read("files").count() == 50


def test_novels_are_inserted_once_and_linked(spark, tmp_path):
    tables = versioned.catalogue(spark, str(tmp_path), buckets=2)
    found = spark.createDataFrame([("/in/a", "T", "x", None), ("/in/b", "T", "y", "g"), ("/in/c", "U", None, None)], "file_path string, title string, author string, genre string")
    change = versioned.index_files(tables.change(), files(spark, [(1, "a", 1), (2, "b", 1), (3, "c", 1), (4, "d", 1)]))
    versioned.link_novels(change, found).commit()
    assert {(r.id, r.title, r.author, r.genre) for r in tables.read("novels").collect()} == {(1, "T", "x", "g"), (3, "U", None, None)}
    assert {r.id: r.novel_id for r in tables.read("files").collect()} == {1: 1, 2: 1, 3: 3, 4: None}
    # a known novel stays as it is
    versioned.link_novels(tables.change(), spark.createDataFrame([("/in/d", "T", "z", "h")], found.schema)).commit()
    assert {(r.id, r.author) for r in tables.read("novels").filter("title = 'T'").collect()} == {(1, "x")}
    assert {r.id: r.novel_id for r in tables.read("files").collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_deletes_cascade(spark, tmp_path):
    tables = versioned.catalogue(spark, str(tmp_path), buckets=4)
    change = versioned.index_files(tables.change(), files(spark, [(i, f"f{i}", 1) for i in range(1, 9)]))
    change.replace("episode_patterns", spark.createDataFrame([(i, "p") for i in (2, 4, 6)], "file_id long, pattern string"))
    change.replace("chapters", spark.createDataFrame([(i, c, "t") for i in (1, 2) for c in range(3)], "file_id long, cid int, title string")).commit()
    present = spark.createDataFrame([(f"/in/f{i}",) for i in (1, 3, 4, 5)], "file_path string")
    versioned.prune_missing(tables.change(), present).commit()
    ids = {n: sorted({r[0] for r in tables.read(n).select("id" if n == "files" else "file_id").collect()}) for n in ("files", "processing_state", "episode_patterns", "chapters")}
    assert ids == {"files": [1, 3, 4, 5], "processing_state": [1, 3, 4, 5], "episode_patterns": [4], "chapters": [1]}


def test_rows_of_a_key_are_replaced_together(spark, tmp_path):
    tables = versioned.catalogue(spark, str(tmp_path), buckets=2)

    def put(rows):
        return tables.change().replace("chapters", spark.createDataFrame(rows, "file_id long, cid int, title string")).commit()

    put([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")])
    put([(1, 0, None)])
    assert sorted(((r.file_id, r.cid, r.title) for r in tables.read("chapters").collect()), key=str) == [(1, 0, None), (2, 0, "c")]
    # the same rows in another order, repeated rows as they are
    at = put([(3, 0, "x"), (3, 0, "x"), (3, 1, "y")])
    assert put([(3, 1, "y"), (3, 0, "x"), (3, 0, "x")]) == at and put([(3, 1, "y"), (3, 0, "x")]) == at + 1


def test_a_broken_off_change_leaves_the_version_before(spark, tmp_path, monkeypatch):
    tables = versioned.catalogue(spark, str(tmp_path), buckets=2)
    versioned.index_files(tables.change(), files(spark, [(1, "a", 1)])).commit()
    change = versioned.index_files(tables.change(), files(spark, [(1, "a", 2), (2, "b", 1)]))
    monkeypatch.setattr(versioned.Tables, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        change.commit()
    monkeypatch.undo()
    assert [(r.id, r.file_size) for r in tables.read("files").collect()] == [(1, 1)]
    # files were written, no manifest names them; the work done again takes its place
    versioned.index_files(tables.change(), files(spark, [(1, "a", 2), (2, "b", 1)])).commit()
    assert {(r.id, r.file_size) for r in tables.read("files").collect()} == {(1, 2), (2, 1)}


def test_two_changes_of_one_version(spark, tmp_path):
    tables = versioned.catalogue(spark, str(tmp_path), buckets=2)
    one = versioned.index_files(tables.change(), files(spark, [(1, "a", 1)]))
    two = versioned.index_files(tables.change(), files(spark, [(2, "b", 1)]))
    one.commit()
    with pytest.raises(versioned.Conflict):
        two.commit()
    assert [r.id for r in tables.read("files").collect()] == [1]


def test_counts_after_a_restart(spark, tmp_path):
    """Killed after the results of a batch were written and before its commit: the batch runs again, and counts once."""
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [(i, None if i % 4 == 0 else "text") for i in range(40)]
    spark.createDataFrame(rows[:25], "doc_id long, text string").repartition(3).write.parquet(str(source))

    def run(work=lambda df: df):
        incremental.run_new_files(spark, str(source), "doc_id long, text string", work, f"{out}/rows", f"{out}/checkpoint", log=f"{out}/log", failed=F.col("text").isNull(), files_per_batch=1)

    run()
    log = {r.batch: (r.total, r.failed) for r in spark.read.schema(incremental.LOG).parquet(f"{out}/log/batch=*").collect()}
    assert len(log) == 3 and sum(t for t, _ in log.values()) == 25 and sum(f for _, f in log.values()) == 7
    # as if killed before the last batch's commit
    last = max(int(f.name) for f in (out / "checkpoint" / "commits").iterdir() if f.name.isdigit())
    for f in (out / "checkpoint" / "commits").iterdir():
        if f.name in (str(last), f".{last}.crc"):
            f.unlink()
    spark.createDataFrame(rows[20:], "doc_id long, text string").repartition(1).write.mode("append").parquet(str(source))
    run()
    (total,) = incremental.run_counts(spark, f"{out}/log").collect()
    assert (total.total, total.success, total.failed) == (40, 30, 10)
    assert spark.read.parquet(f"{out}/rows/batch=*").count() == 40


def beautified(title, body):
    import re

    title = re.sub(r"([가-힣a-zA-Z])[-]?(\d+화)", r"\1 - \2", title.strip())
    lines, out, blank = body.splitlines(), [], 0
    for line in lines:
        blank = 0 if line.rstrip() else blank + 1
        if blank <= 2:
            out.append(line.rstrip())
    return "\n" * 7 + "━" * 60 + "\n" + title.center(60) + "\n" + "━" * 60 + "\n\n\n" + "\n".join(out) + "\n"


def test_formatted_text(spark):
    given = [("소설15화", "a  \n\n\n\n\nb\n"), (" x-3화 ", ""), ("t" * 70, "\n\n\n\n"), ("odd", "\n\n\na\r\nb\x85c\n\n\n\n"), ("", " \t "), ("가-1화 나2화", "x")]
    rows = [(1, i, t, b) for i, (t, b) in enumerate(given)] + [(2, 0, None, None)]
    got = {(r.doc_id, r.cid): r.text for r in text_sink.formatted(spark.createDataFrame(rows, "doc_id long, cid int, title string, body string")).collect()}
    assert got == {(1, i): beautified(t, b) for i, (t, b) in enumerate(given)} | {(2, 0): beautified("", "")}


def test_books_read_back_in_order(spark, tmp_path):
    import hashlib

    rows = [(d, c, f"chapter {c} of {d}\n" * (c % 7 + 1)) for d in range(4) for c in range(60)]
    text_sink.write_books(spark.createDataFrame(rows, "doc_id long, cid long, text string").repartition(5), f"{tmp_path}/books", 500)
    got = {r.book: r for r in text_sink.read_books(spark, f"{tmp_path}/books").collect()}
    for d in range(4):
        whole = "".join(t for k, _, t in rows if k == d).encode()
        assert (got[d].bytes, got[d].sha256) == (len(whole), hashlib.sha256(whole).hexdigest()) and got[d].files > 5


def test_books_share_folders_and_are_listed(spark, tmp_path):
    rows = [(d, c, "x" * 40 + "\n") for d in range(600) for c in range(2)]
    text_sink.write_books(spark.createDataFrame(rows, "doc_id long, cid long, text string"), f"{tmp_path}/books", 30)
    folders = [p for p in (tmp_path / "books").iterdir() if p.is_dir() and p.name != "files"]
    assert len(folders) <= text_sink.SHELVES  # a folder a book and one a part made 1,800
    listed = spark.read.parquet(f"{tmp_path}/books/files").collect()
    assert len(listed) == 1200 and all((tmp_path / "books" / r.file).stat().st_size == r.bytes == 41 for r in listed)
    assert {(r.files, r.bytes) for r in text_sink.read_books(spark, f"{tmp_path}/books").collect()} == {(2, 82)}


def test_logged_run_deals_more_files_than_batches(spark, monkeypatch):
    from quire.plans import writes

    seen = {}
    run = incremental.run_new_files

    def kept(session, source, *args, **options):
        seen.update(files=len(session.read.parquet(source).inputFiles()), each=options["files_per_batch"])
        return run(session, source, *args, **options)

    monkeypatch.setattr(writes.incremental, "run_new_files", kept)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        (r,) = writes.logged_run(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert r.total == r.success + r.failed == 200 and seen == {"files": 12, "each": 3}  # four files, whatever the size
