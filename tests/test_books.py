"""Book structure on small books, patterns as strings, and the folds against plain loops."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import headings, hierarchy, lines, patterns, reports, toc
from quire.queries import ORACLE_SQL, QUERIES

BOOK = "Words before.\n\nPart I: Dawn\n\nChapter 1\n\nThe sun is up. It was warm.\n\nChapter 2: Noon\n\nSection 1\nfirst\nSection 2\nsecond\nSection 1\nagain\n\nPart II\nplain text of the part\n\nPart I: Dawn\n\nChapter 9\nlost\n"


def test_hierarchy(spark):
    rows = [(1, BOOK, "english"), (2, None, "chinese"), (3, " \n ", "english"), (4, "Part I\nPart II\n", "english"), (5, "no headings", "english"), (6, "序\n\n第一章 山上的雪\n\n" + "他在山上。" * 90 + "\n第二章\n\n", "chinese")]
    got = {}
    for r in hierarchy.hierarchy(spark.createDataFrame(rows, "doc_id long, text string, language string")).orderBy("doc_id", "volume_no", "chapter_no", "section_no").collect():
        got.setdefault(r.doc_id, []).append((r.volume_title, r.chapter_title, r.section_title, r.content))
    assert got[1] == [
        (None, "Preface", None, "Words before."),
        ("Part I: Dawn", "Chapter 1: The sun is up", None, "The sun is up. It was warm."),
        ("Part I: Dawn", "Chapter 2: Noon", "Section 1", "first"),
        ("Part I: Dawn", "Chapter 2: Noon", "Section 2", "second"),
        ("Part II", "Content", None, "plain text of the part"),
    ]
    assert got[2] == got[3] == [(None, *headings.EMPTY[:1], None, headings.EMPTY[1])]
    assert got[4] == [(None, "Unknown Content", None, "Unable to parse document structure. Please check document format.")]
    assert got[5] == [(None, "Content", None, "no headings")]
    assert [(x[1], x[3][:5]) for x in got[6]] == [("前言", "序"), ("第一章 山上的雪", "他在山上。"), ("第二章", "此章节内容")]


def test_toc(spark):
    listed = "Title\n\nTable of Contents\n" + "".join(f"Chapter {i}\n" for i in range(1, 9)) + "\n"
    body = "Chapter 1\n\n" + "It was a long and quiet day on the hill above the sea. " * 4
    rows = [(1, listed + body, "english"), (2, body, "english"), (3, None, "english"), (4, "", "english"), (5, "Contents", "english")]
    got = {r.doc_id: r for r in toc.without_toc(spark.createDataFrame(rows, "doc_id long, text string, language string")).collect()}
    assert (got[1].toc_start, got[1].text.startswith("Title\n\n"), "Chapter 8" in got[1].text, body[11:] in got[1].text) == (2, True, False, True)
    assert all(got[i].text == t and got[i].toc_start is None for i, t, _ in rows[1:])


def test_pattern_strings(spark):
    assert patterns.relaxed(r"Chapter \d+") == r"Chapter \d*"
    assert patterns.relaxed(r"제목\(\d+\)") == r"제목(?:\(\d*\))?"
    p = patterns.without_end_markers(r"\d+화")
    assert re.match(p, "12화") and not re.match(p, "12화 끝") and not re.match(p, "12화 END>") and patterns.without_end_markers(p) == p
    made = spark.createDataFrame([("a.b [12] (3)",), ("$5^",)], "t string").select("t", patterns.pattern_of(F.col("t")).alias("p")).collect()
    assert all(re.fullmatch(r.p, r.t) for r in made)


def plain_fold(rows, k, size):
    def n(c):
        return sum(x for m, x, _ in rows if m & c)

    def last(c):
        return max((p for m, _, p in rows if m & c), default=0)

    def covered(c):
        return last(c) > size * 0.99 or size - last(c) < 20_000

    fit = [(n(1 << i), -i) for i in range(4) if 0 < n(1 << i) <= min(k * 1.5, 1000)]
    if not fit:
        return 0
    c = 1 << -max(fit)[1]
    for i in range(4):
        if not covered(c) and last(c | 1 << i) > last(c):
            c |= 1 << i
    return c


def test_search_against_loop(spark):
    rng, rows, want = random.Random(1), [], {}
    for doc in range(40):
        size, k = rng.choice([5000, 400_000]), rng.randint(1, 30)
        masks = [(m, rng.randint(1, 12), rng.randint(0, size)) for m in sorted(rng.sample(range(1, 16), rng.randint(0, 6)))]
        rows.append((doc, size, masks, k))
        want[doc] = plain_fold(masks, k, size)
    df = spark.createDataFrame(rows, "doc_id long, size long, masks array<struct<mask:int,n:long,last:long>>, k long")
    best = patterns.best_patterns(df.drop("k"), df.select("doc_id", F.col("k").alias("expected")))
    assert {r.doc_id: r.chosen for r in best.collect()} == want
    assert len(set(want.values())) > 4
    for r in patterns.refined(best).collect():
        assert r.found <= 1.05 * r.expected or r.chosen == want[r.doc_id]


def test_chunks_and_empty_tables(spark):
    text = "\n".join("x" * n for n in (5, 30, 3, 3, 3, 3, 3, 8))
    rows = lines.explode_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [(r.first, r.upto, r.chars) for r in patterns.line_chunks(rows, 12).orderBy("chunk_no").collect()] == [(0, 1, 6), (1, 2, 31), (2, 5, 12), (5, 7, 8), (7, 8, 9)]
    none = spark.createDataFrame([], "doc_id long, text string, language string")
    assert hierarchy.hierarchy(none).count() == toc.without_toc(none).count() == patterns.profiles(lines.explode_lines(none)).count() == 0


def test_empty_shelf(spark):
    rows = spark.createDataFrame([(1, "<a> & 'b'", None, "x"), (None, None, None, "y")], "id long, title string, author string, shelf string")
    got = {r.shelf: r.html for r in reports.library_pages(rows, "shelf").collect()}
    assert "&lt;a&gt; &amp; &#x27;b&#x27;" in got["x"] and "Unknown Author" in got["x"] and "No books yet" in got["y"]


def test_shelf_with_repeated_ids(spark):
    rows = spark.createDataFrame([(1, f"t{i}", None, "x") for i in range(30)] + [(2, "u", "v", "y")], "id long, title string, author string, shelf string")
    got = {r.shelf: r.html for r in reports.library_pages(rows, "shelf").collect()}
    assert got["x"].count("book-card") == 30 and got["y"].count("book-card") == 1  # a join by id gave 900


def test_contents_are_searched_in_a_table_of_lines(spark):
    text = "\n".join(["【目 录】", *[f"第{i}章 山路" for i in range(1, 9)], "", "长" * 120, "页 7"])
    docs = spark.createDataFrame([(1, text, "chinese"), (2, "-- Contents --\nChapter 1\nChapter 2\n\n" + "x" * 120, "english")], "doc_id long, text string, language string")
    rows = {(r.doc_id, r.line_num): r for r in toc.toc_lines(docs).collect()}
    assert rows[1, 0].is_word and rows[2, 0].is_word and not rows[1, 1].is_word and rows[1, 11].has_page and not rows[1, 10].has_page
    found = toc.without_toc(docs)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()  # lines are made once, before
    assert {r.doc_id: (r.toc_start, r.toc_end) for r in found.collect()} == {1: (0, 9), 2: (0, 3)}


def test_a_step_of_the_retry_names_the_marks_a_few_times(spark):
    docs = spark.createDataFrame([(1, "\n".join(["A1", "x" * 40, "B2", "x" * 40] * 200))], "doc_id long, text string")
    library = ["^A[0-9]+$", "^B[0-9]+$", "^(C)\\1$"]
    for some in (library, library[:2]):
        found = patterns.adaptive(patterns.marks(lines.explode_lines(docs), some), F.lit(0), some, behind=500, tail=10)
        plan = found.select("chosen")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("marks#") < 12
        assert [(r.chosen, r.covered) for r in found.collect()] == [(2, True)]


@pytest.mark.parametrize("name", ["heading_forms", "lines_explode", "blank_line_squeeze"])
def test_ends_of_texts_and_folded_letters(spark, tmp_path, name):
    # the list of contents before an empty text ends in two line ends, of which one ends the last line
    texts = ["", None, "\n", "a\n\n", "a\n\n\n", "a. \r", "a.\n\r", "a\n\u2028", "b. \u017fection 1. Boo\u212a I. Part \u017fix. Sect\u0131on 1", "\u7ae0 SECT\u0130ON"]
    rows = [(6 * i + j, t) for i, t in enumerate(texts) for j in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, got.collect())) == sorted(want.project(", ".join(got.columns)).fetchall())
