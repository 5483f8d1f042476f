import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import boundaries, escalate, lines, merge, segment, structure, titles
from quire.queries import ORACLE_SQL, QUERIES
from quire.sources import epub_sink, readers

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CLEAN = [
    ("마왕의 딸로 태어났습니다.txt", "마왕의 딸로 태어났습니다"),
    ("회귀했더니_최강검사.epub", "회귀했더니 최강검사"),
    ("##소설제목.txt", "소설제목"),
    ("마왕의 딸로 태어났습니다(1~370.연재).txt", "마왕의 딸로 태어났습니다"),
    ("소설제목(완결).txt", "소설제목"),
    ("소설제목(1-50).txt", "소설제목"),
    ("##소설_제목(완결).epub", "소설 제목"),
    ("소설   제목   테스트.txt", "소설 제목 테스트"),
]
RANGES = [("1~370화", 370), ("1-370화", 370), ("50~100", 100), ("321화", 321), ("100", 100), (None, None), ("", None), ("완결", None), ("총 1~370화", 370)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def key(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    assert key(got.select(*names).collect()) == key(want.project(", ".join(f'"{c}"' for c in names)).fetchall())


def test_titles(spark):
    df = spark.createDataFrame(CLEAN, "a string, b string")
    assert all(r[0] == r[1] for r in df.select(titles.clean_search_title(F.col("a")), "b").collect())
    df = spark.createDataFrame(RANGES, "a string, b long")
    assert all(r[0] == r[1] for r in df.select(titles.episode_range_numeric(F.col("a")), "b").collect())


def test_stagnation(spark):
    cases = [([10, 15, 20], False), ([10, 10, 10], True), ([10, 11, 10], True), ([80, 85, 87, 85], True), ([10, 10, 14], False), ([8, 10, 10, 10, 10], True), ([10, 10], False)]
    df = spark.createDataFrame(cases, "c array<int>, want boolean")
    assert all(r[0] == r[1] for r in df.select(boundaries.stagnant(F.col("c")), "want").collect())


def test_close_matches(spark):
    df = spark.createDataFrame([(1, p) for p in (0, 200, 10000, 10300, 20000)], "doc_id long, pos long")
    assert sorted(r.pos for r in boundaries.drop_close(df).collect()) == [0, 10000, 20000]


def test_merge(spark):
    one = "struct<title:string,author:string,genre:string,tags:array<string>,status:string,episode_range:string,rating:double,cover_url:string,platform:string,last_updated:string,official_url:string>"

    def rec(**k):
        return tuple(k.get(f) for f in "title author genre tags status episode_range rating cover_url platform last_updated official_url".split())

    rows = [
        (1, rec(author="작가1", platform="조아라", last_updated="2024-01-01"), rec(author="작가2", platform="노벨피아", last_updated="2024-01-01")),
        (2, rec(episode_range="1~100화", platform="리디"), rec(episode_range="1~200화", platform="리디")),
        (3, rec(last_updated="2024-01-01", genre="판타지"), rec(last_updated="2024-06-01", genre="로맨스")),
    ]
    got = {r.id: r for r in merge.merge_metadata(spark.createDataFrame(rows, f"id long, base {one}, extra {one}")).collect()}
    assert (got[1].author, got[1].platform) == ("작가2", "노벨피아")
    assert got[2].episode_range == "1~200화"
    assert (got[3].last_updated, got[3].genre) == ("2024-06-01", "로맨스, 판타지")


def greedy(points, k, size, anchors):
    d = max(1000, int(size / k * 0.3))
    free = [p for p in points if all(abs(p - a) >= d for a in anchors)]
    for gap in (d, int(d * 0.5), 500):
        got = []
        for p in free:
            if len(got) < k - len(anchors) and all(abs(p - q) >= gap for q in got):
                got.append(p)
        if len(got) >= k - len(anchors):
            break
    return sorted(set(got) | set(anchors))


def test_optimizer_against_model(spark):
    rng, rows, sizes, anchors, want = random.Random(3), [], [], [], {}
    for doc in range(25):
        size = rng.randint(3000, 60000)
        pts = rng.sample(range(size), 40)
        held = rng.sample(range(size), rng.randint(0, 3))
        order = [(rng.random(), p) for p in pts]
        rows += [(doc, p, s) for s, p in order]
        sizes.append((doc, size))
        anchors += [(doc, a) for a in held]
        want[doc] = greedy([p for s, p in sorted(order, reverse=True)], 8, size, sorted(held))
    got = boundaries.select_boundaries(spark.createDataFrame(rows, "doc_id long, byte_pos long, combined_score double"), spark.createDataFrame(sizes, "doc_id long, size long"), F.lit(8), spark.createDataFrame(anchors, "doc_id long, byte_pos long"))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append(r.byte_pos)
    assert {k: sorted(v) for k, v in found.items()} == want


def test_boundary_documents(spark):
    heads = ["프롤로그: 시작", "1화 평범한 시작", "[2화] 두 번째 이야기", "새로운 전개", "서울, 2024년 봄"]
    text = "\n\n" + "\n".join(f"{h}\n\n본문 문장입니다. 이어집니다.\n\n" for h in heads)
    rows = lines.explode_lines(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"))
    marks = rows.filter(F.trim("line").isin(heads)).select("doc_id", "line_num")
    got = segment.split_at(rows, marks).orderBy("cid").collect()
    assert [r.title for r in got] == heads and all(r.body.strip() for r in got)
    assert structure.candidates(rows).count() > 0


def test_epub_round_trip():
    data = epub_sink.build_epub("a & b", "", [("one", "x\n<y>"), ("two", "z")])
    found = list(readers.spine(data))
    assert [n for _, n, _ in found] == ["Text/chapter_0001.xhtml", "Text/chapter_0002.xhtml"] and "&lt;y&gt;" in found[0][2]


def test_encodings():
    assert readers.decode_text("한글".encode("cp949")) == ("한글", "cp949")
    assert readers.decode_text("한글".encode()) == ("한글", "utf-8")
    assert readers.decode_text(None) == (None, None)


def test_sample_chunks_of_small_pieces(spark, con):
    """With small pieces, so that texts are cut; the query has the operator's own, larger ones."""
    from quire.plans.core import docs, sample_sql

    got = docs(spark, FOLDER).select("doc_id", readers.sample_chunks(F.col("text"), 500, 4).alias("sample")).collect()
    want = con.sql(sample_sql("documents", 500, 4)).fetchall()
    assert key(got) == key(want) and any("SAMPLE_SKIP" in (r.sample or "") for r in got)


def test_collision_suffix_of_many(spark):
    from quire.operators import dedup

    names = spark.createDataFrame([(i, "a") for i in range(103)] + [(7, "b")], "id long, name string")
    got = {(r.name, r.id): r.final_name for r in dedup.collision_suffix(names, span=10).collect()}
    assert got == {("a", i): "a" if not i else f"a-{i:02d}" for i in range(103)} | {("b", 7): "b"}


RULE_TEXT = "앞글\n1화 시작\n본문 가\n\n[책 - 2화]\n제 2화 재회\n본문 나\n3화 여기에 제목이 아니라 긴 본문이 바로 이어져 나옵니다 참으로\n외전 막간\n짧은 글\n[가 - 4화]\n[나 - 5화]\n[다 - 6화]\n[라 - 7화]\n끝 글\n[마 - 8화]\n\n제 8화 따로\n글\n외전 끝\n짧다"
RULE_PATTERN = "(?:제 )?[0-9]+화|^외전"


def test_chapters_by_rules(spark):
    rows = lines.explode_lines(spark.createDataFrame([(1, RULE_TEXT), (2, ""), (3, None), (4, "글"), (5, "1화 시작"), (6, "막간\n\n")], "doc_id long, text string"))
    got = [(r.doc_id, r.cid, r.title, r.body, r.line_num) for r in segment.chapters_by_rules(rows, RULE_PATTERN).orderBy("doc_id", "cid").collect()]
    assert got == [
        (1, 0, "1화 시작", "본문 가", 1),
        (1, 1, "[책 - 2화] | 제 2화 재회", "본문 나", 4),
        (1, 2, "3화", "여기에 제목이 아니라 긴 본문이 바로 이어져 나옵니다 참으로", 7),
        (1, 3, "[다 - 6화] | [라 - 7화]", "끝 글", 12),
        (1, 4, "제 8화 따로", "글", 17),
        (1, 5, "외전 끝", "짧다", 19),
    ]
    titles_of = spark.createDataFrame([(1, "시작"), (1, "막간"), (1, "막간"), (1, None), (4, "1화"), (6, "막간")], "doc_id long, title string")
    got = [(r.cid, r.title, r.line_num) for r in segment.chapters_by_rules(rows, ".+", titles_of).orderBy("doc_id", "cid").collect()]
    assert got == [(0, "1화 시작", 1), (1, "외전 막간", 8)]
    got = [(r.doc_id, r.cid, r.title, r.body) for r in segment.chapters_by_rules(rows, "[0-9]+화", titles_of).orderBy("doc_id", "cid").collect()]
    assert got == [(1, 0, "1화 시작", "본문 가"), (1, 1, "제 2화 재회", "본문 나"), (1, 2, "[라 - 7화]", "끝 글"), (1, 3, "제 8화 따로", "글\n외전 끝\n짧다")]


def test_chapters_with_prologue(spark):
    long = "긴 본문. " * 20
    rows = lines.explode_lines(spark.createDataFrame([(1, f"1화\n{long}\n2화\n짧다\n3화\n4화\n{long}\n5화\n"), (2, ""), (3, None), (4, "글\n1화\n끝"), (5, "글")], "doc_id long, text string"))
    got = [(r.doc_id, r.cid, r.title, r.body, r.line_num) for r in segment.chapters_with_prologue(rows, "[0-9]화").orderBy("doc_id", "cid").collect()]
    assert got == [(1, 0, segment.PROLOGUE, "", 0), (1, 1, "1화", long.strip(), 0), (1, 2, "4화", long.strip(), 5), (4, 0, segment.PROLOGUE, "글", 0), (4, 1, "1화", "끝", 1), (5, 0, segment.PROLOGUE, "글", 0)]


def test_rules_meet_their_cases(spark):
    got = QUERIES["rule_segment_chapters"](spark, FOLDER).cache()
    assert got.filter("title like '% | %'").count() and got.filter("title rlike '^[0-9]+화$'").count()
    assert not got.filter("title = '외전 막간'").count()


def test_escalated(spark):
    body = "이 문장은 본문이며 길게 이어지는 이야기의 한 부분이다. " * 30
    text = "\n\n".join(f"제{i}화 만남\n\n" + "\n".join([body] * 25) for i in range(1, 5))
    docs = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, None), (5, "짧은 글")], "doc_id long, text string")
    expected = spark.createDataFrame([(1, 4), (2, 9), (3, 1), (4, 1), (5, 1), (6, None)], "doc_id long, k long")
    heads = [i * 28 for i in range(4)]
    # the first line of a text is no candidate: an anchor gives it
    anchors = spark.createDataFrame([(1, 0), (1, 0), (2, 0)], "doc_id long, line_num int")
    got = escalate.escalated(docs, expected, anchors=anchors).orderBy("doc_id", "cid").collect()
    assert [(r.doc_id, r.cid, r.title, r.line_num) for r in got] == [(1, i, f"제{i + 1}화 만남", heads[i]) for i in range(4)]
    assert all(r.length == len(r.body) and r.body.startswith("이 문장은") for r in got)
    # three candidates only: a change of topic is the fourth, where no anchor is given
    at = lines.with_offsets(lines.explode_lines(docs)).filter("doc_id = 1 AND line_num = 7").first()["byte_pos"]
    turns = spark.createDataFrame([(1, 7, at, 0.9), (1, 7, at, 0.9), (5, 0, 0, 0.9)], "doc_id long, line_num int, byte_pos long, ai_score double")
    got = escalate.escalated(docs, expected, changes=turns).orderBy("doc_id", "cid").collect()
    assert [(r.doc_id, r.line_num) for r in got] == [(1, 7), (1, 28), (1, 56), (1, 84)]


def test_escalation_meets_its_case(spark):
    got = QUERIES["escalated_chapters"](spark, FOLDER).groupBy("doc_id").count().collect()
    assert got and max(r["count"] for r in got) > 1


def test_letters_are_counted_without_their_matches(spark):
    from quire.functions.text import count_letters, strip
    from quire.operators import quality

    text = "a1 b 첫 章😀,，.\n"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = df.select(count_letters(F.col("t"), "[a-zA-Z0-9]").alias("n"), count_letters(F.col("t"), "[一-鿿]").alias("z"), strip(F.concat(F.lit("　 "), "t")).alias("s")).collect()
    assert [(r.n, r.z, r.s) for r in got] == [(3, 1, text[:-1]), (0, 0, ""), (None, None, None)]
    plan = quality.char_counts(df, F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan  # one array element a letter before


def test_titles_are_found_without_shuffled_pieces(spark):
    rng = random.Random(5)
    bodies = ["".join(rng.choice("ab 가😀") for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "가"]
    titles = sorted({b[i : i + n] for b in bodies if b and len(b) > 20 for i, n in ((rng.randint(0, 8), rng.randint(1, 14)),)})[::4] + ["never there at all", "", None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string").select("doc_id", F.lit(3).alias("line_num"), "body")
    df = segment.holding(rows, spark.createDataFrame([(t,) for t in titles], "title string"))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()  # a row for each piece of each line before
    assert sorted(r.doc_id for r in df.collect()) == [i for i, b in enumerate(bodies) if b and any(t and t in b for t in titles)]
    assert segment.holding(rows, spark.createDataFrame([], "title string")).count() == 0


def test_long_texts_are_cut_with_overlap():
    texts = ["", "abc", "x" * 5 + "needle78" + "y" * 30, "z"]
    cut = list(segment.slices(texts, 9))
    assert max(len(t) for _, some in cut for t in some) <= 9 + segment.GRAM - 1 and {i for n, _ in cut for i in n} == {0, 1, 2, 3}
    assert any("needle78" in t for n, some in cut for i, t in zip(n, some) if i == 2)


def test_near_anchors_in_one_order(spark):
    rng = random.Random(3)
    rows = [(d, p, rng.random() < 0.2) for d in range(20) for p in rng.sample(range(300), 40)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, anchor boolean")
    got = boundaries.without_near_marked(df, F.col("anchor"), "pos", 10)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.pos) for r in got.collect()} == {(d, p) for d, p, a in rows if not a and not any(b and e == d and abs(p - q) < 10 for e, q, b in rows)}
    plan = QUERIES["anchor_antijoin_lines"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") <= 2  # lines were made, scored and dealt twice, and joined
