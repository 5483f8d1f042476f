"""Scores asked once, topic changes, and the split driver on documents whose outcome is known."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators import driver, folds, lines, scorer, segment, structure, topics
from quire.plans.driver import LIBRARY
from quire.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def counting(folder, fail=None):
    """A model that writes a file for each prompt that it is asked."""

    def start():
        def model(prompts):
            import uuid

            for p in prompts:
                (folder / f"{p}-{uuid.uuid4().hex}").touch()
            if fail and any(fail in p for p in prompts):
                raise RuntimeError("no service")
            return [f"0.{len(p)}" for p in prompts]

        return model

    return start


def asked(folder):
    return collections.Counter(f.name.rsplit("-", 1)[0] for f in folder.iterdir())


def prompts(spark, names):
    return spark.createDataFrame([(n,) for n in names], "prompt string").withColumn("digest", F.sha2("prompt", 256))


def test_nothing_is_asked_twice(spark, tmp_path):
    calls, store = tmp_path / "calls", scorer.Answers(spark, f"{tmp_path}/answers")
    calls.mkdir()
    names = [f"p{i}" for i in range(200)]
    got = store.ask(prompts(spark, [*names[:120], *names[:50]]), counting(calls), waves=3)
    assert got.count() == 120 and asked(calls) == dict.fromkeys(names[:120], 1)
    got = store.ask(prompts(spark, names), counting(calls), waves=3)
    assert {r.answer for r in got.collect()} == {"0.2", "0.3", "0.4"} and asked(calls) == dict.fromkeys(names, 1)


def test_a_broken_off_run_goes_on(spark, tmp_path):
    """A wave whose commit is missing is asked again, the others are not."""
    calls, store = tmp_path / "calls", scorer.Answers(spark, f"{tmp_path}/answers")
    calls.mkdir()
    names = [f"p{i}" for i in range(60)]
    store.ask(prompts(spark, names), counting(calls), waves=4).collect()
    lost = tmp_path / "answers" / "wave=000000003"
    gone = {r.digest for r in spark.read.parquet(str(lost)).collect()}
    (lost / "_SUCCESS").unlink()
    assert store.known().count() == 60 - len(gone)
    assert store.ask(prompts(spark, names), counting(calls), waves=4).count() == 60
    assert sum(asked(calls).values()) == 60 + len(gone)


def test_errors_are_told_and_tried_again_later(spark, tmp_path):
    calls, store = tmp_path / "calls", scorer.Answers(spark, f"{tmp_path}/answers")
    calls.mkdir()
    frame = prompts(spark, ["good", "bad"]).repartition(1)
    got = {r.digest: r for r in store.ask(frame, counting(calls, "bad"), batch=1, tries=3, wait=0.01, waves=1).collect()}
    kinds = {(r.answer, r.error, r.tries) for r in got.values()}
    assert kinds == {("0.4", None, 1), (None, "RuntimeError: no service", 3)} and asked(calls) == {"good": 1, "bad": 3}
    got = store.ask(frame, counting(calls), waves=1).collect()
    assert {r.answer for r in got} == {"0.3", "0.4"} and asked(calls) == {"good": 1, "bad": 4}


def test_waits_grow_and_the_bucket_holds_back():
    slept, now = [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    def down(batch):
        raise OSError("x")

    assert scorer.asked(down, ["a", "b"], 4, 0.5, sleep) == [(None, "OSError: x", 4)] * 2 and slept == [0.5, 1.0, 2.0]
    assert scorer.asked(lambda b: ["1"], ["a", "b"], 1, 0, sleep)[0][1].startswith("ValueError")
    bucket = scorer.TokenBucket(10, 20, lambda: now[0], sleep)
    began = now[0]
    for _ in range(10):
        bucket.take(15)
    assert now[0] - began == pytest.approx((150 - 20) / 10)
    bucket.take(45)  # more than the bucket holds
    assert now[0] - began == pytest.approx((195 - 20) / 10)


def test_scores_and_errors_of_candidates(spark, tmp_path):
    docs = spark.createDataFrame([(1, "first\nA title\nsome text after it that is long enough\nends."), (2, None), (3, "")], "doc_id long, text string")
    rows = lines.explode_lines(docs)
    found = rows.select("doc_id", "line_num", F.col("line").alias("text"))
    store = scorer.Answers(spark, f"{tmp_path}/answers")
    got = {r.line_num: (r.ai_score, r.error) for r in scorer.scored(found, rows, store, scorer.offline).collect()}
    assert got[3] == (0.0, None) and got[1][0] > 0.4 and set(got) == {0, 1, 2, 3}
    odd = spark.createDataFrame([(9, "x" * 19)], "doc_id long, text string")
    (r,) = scorer.scored(lines.explode_lines(odd).withColumnRenamed("line", "text"), lines.explode_lines(odd), store, scorer.offline).collect()
    assert (r.ai_score, r.error) == (None, "no number in the answer")


def test_topic_changes_by_brute_force(spark):
    first, second = "the sea and the wind went over the old harbour again ", "les rois du pays lointain marchent encore dans la neige "
    texts = {1: first * 300, 2: (first * 200)[:8999] + "\n" + second * 150, 3: "short", 4: "", 5: None, 6: "12 34 " * 2000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = spark.createDataFrame([(i, 4) for i in range(1, 8)], "doc_id long, k long")
    got = {(r.doc_id, r.window_no): r.change for r in topics.with_change(topics.windows(docs, expected)).collect()}
    want = {}
    for i, t in texts.items():
        n = max(1, (len(t or "") - 2000) // 1500 + 1)
        target = min(n, 12)
        stride = max(1, (len(t) - 2000) // target) if target < n else 1500
        for w in range(1, target):
            at = w * stride
            a, b = (collections.Counter(x for x in re.split(r"[^a-z]+", s.lower()) if x) for s in (t[max(0, at - min(stride, 1000)) : at], t[at : at + 1000]))
            norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            want[i, w] = 1 - sum(n * b[x] for x, n in a.items()) / norm if norm else 1.0
    assert got == pytest.approx(want) and len(want) > 20
    marked = structure.marked_lines(docs)
    turns = topics.topic_changes(docs, expected, marked).collect()
    assert {r.doc_id for r in turns} == {2, 6} and all(r.ai_score >= 0.6 for r in turns)
    # the change lies where the words change
    assert [r.line_num for r in turns if r.doc_id == 2] == [1]
    near = spark.createDataFrame([(2, p) for p in range(0, 20_000, 4000)], "doc_id long, char_pos long")
    assert {r.doc_id for r in topics.topic_changes(docs, expected, marked, near).collect()} == {6}


def test_driver_settles_each_kind_in_its_round(spark):
    def state():
        return {r.doc_id: r for r in driver.split(docs, expected, LIBRARY)[0].collect()}

    body = ("Words of a tale that goes on and on without an end in sight, line for line. " * 3 + "\n") * 8
    korean = "".join(f"제 {i} 화\n{body}" for i in range(1, 7))
    english = "".join(f"Chapter {i}\n{body}" for i in range(1, 7))
    mixed = "".join(f"Chapter {i}\n{body}" if i % 4 else f"\n\n[Interlude {i}]\n\n{body}" for i in range(1, 13))
    docs = spark.createDataFrame([(1, korean), (2, english), (3, mixed), (4, body), (5, korean), (6, ""), (7, None), (8, korean), (None, korean)], "doc_id long, text string")
    expected = spark.createDataFrame([(1, 6), (2, 6), (3, 12), (4, 40), (5, 5), (6, 1), (7, 1), (8, None), (99, 3)], "doc_id long, k long")
    got = state()
    assert {i: (r.settled_by, r.n) for i, r in got.items()} == {1: ("pattern 0", 6), 2: ("pattern 1", 6), 3: ("titles", 12), 4: ("closest", 0), 5: ("closest", 6)}
    assert got[4].attempts == 4  # counts stand still: no round of titles
    chapters = driver.split(docs, expected, LIBRARY)[1]
    of = {r.doc_id: (r["round"], r.n) for r in chapters.groupBy("doc_id", "round").agg(F.count("*").alias("n")).collect()}
    assert of == {1: ("pattern 0", 6), 2: ("pattern 1", 6), 3: ("titles", 12), 5: ("pattern 0", 6)}
    none = driver.split(docs.filter("false"), expected, LIBRARY)
    assert [f.count() for f in none] == [0, 0] and none[1].columns == chapters.columns


def test_every_round_settles_some(spark):
    got = {r.settled_by for r in QUERIES["split_driver"](spark, "/root/testdata/sf0.01").select("settled_by").distinct().collect()}
    assert got >= {"pattern 0", "pattern 1", "pattern 2", "titles", "escalated", "closest"}


def test_folds():
    assert folds.chosen([100, 150, 0, 1000, 560], 3, 100) == [0, 100, 1000]
    assert folds.chosen([], 3, 1) == [] and folds.chosen([1], 0, 1) == []
    step = folds.spaced(10)()
    assert [p for p in (0, 3, 9, 10, 19, 20, 25, 30) if step(p)] == [0, 10, 20, 30]


def test_decisions_come_back_by_place(spark, tmp_path):
    from quire.operators import hybrid

    long_, short = "Word after word. " * 20, "few"
    rows = [(1, 0, "Same", short, 0.45), (1, 1, "Same", long_, 0.65), (1, 2, "Sure", long_, 0.8), (1, 3, "a" * 10, short, 0.4), (1, 4, "even", None, 0.4), (2, 0, "Same", short, 0.45), (2, 1, "Good", long_, 1.0)]
    chapters = spark.createDataFrame(rows, "doc_id long, cid int, title string, body string, confidence double")
    calls = tmp_path / "calls"
    calls.mkdir()

    def start():
        model = hybrid.offline()

        def counted(prompts):
            for i, p in enumerate(prompts):
                (calls / f"{abs(hash(p))}-{i}").touch()
            return model(prompts)

        return counted

    got = sorted(tuple(r) for r in hybrid.decided(chapters, scorer.Answers(spark, f"{tmp_path}/answers"), start).select("doc_id", "cid", "title", "asked").collect())
    # document 2 is sure on the whole; of two equal titles one is rejected; what is not understood stays
    assert got == [(1, 1, "Same", True), (1, 2, "Sure", False), (1, 3, "a" * 10, True), (2, 0, "Same", False), (2, 1, "Good", False)]
    assert len(list(calls.iterdir())) == 4
    assert hybrid.decided(chapters.filter("false"), scorer.Answers(spark, f"{tmp_path}/none"), start).count() == 0


def test_hybrid_meets_both_branches(spark):
    got = QUERIES["hybrid_chapters"](spark, "/root/testdata/sf0.01").groupBy("asked").count().collect()
    assert len(got) == 2 and all(r["count"] > 20 for r in got)
    assert QUERIES["hybrid_chapters"](spark, "/root/testdata/sf0.01").filter("title like 'Chapter: %'").count()


def test_retries_are_used_up(spark):
    got = {(r.attempts, r.covered) for r in QUERIES["adaptive_retry"](spark, "/root/testdata/sf0.01").collect()}
    assert {(0, True), (10, True), (10, False)} <= got


def test_titles_by_their_rarest_piece(spark):
    import random

    from quire.operators import segment

    rng = random.Random(9)
    rows = [(1, i, "".join(rng.choice("ab c가") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    titles = ["", None, "a", "가가", "ab c", "nowhere in it", *{rows[i][2][3:14] for i in range(40)}, "ab" * 6, "ab" * 6]
    for some in (titles, ["nowhere in it"], ["가a"]):
        got = {r.line_num for r in segment.holding(spark.createDataFrame(rows, "doc_id long, line_num int, body string"), spark.createDataFrame([(t,) for t in some], "title string")).collect()}
        assert got == {i for _, i, b in rows if any(t and t in b for t in some)}
    plan = segment.holding(spark.createDataFrame(rows, "doc_id long, line_num int, body string"), spark.createDataFrame([(t,) for t in titles], "title string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_change_of_topic_needs_no_other_row(spark):
    from quire.operators import topics

    given = [(1, 1, "the sea the hill", "The SEA a b"), (1, 2, "", ""), (1, 3, None, "x"), (1, 4, "a b", "c"), (2, 1, "x y", "y x")]
    df = topics.with_change(spark.createDataFrame(given, "doc_id long, window_no int, before string, text string"))
    plan = plan_of(df)
    assert "Exchange" not in plan and "Aggregate" not in plan and "Join" not in plan  # words were exploded, counted and joined
    got = {(r.doc_id, r.window_no): r.change for r in df.collect()}
    norm = (6 * 4) ** 0.5  # the 2, sea 1, hill 1; the 1, sea 1, a 1, b 1
    assert got[(1, 1)] == 1.0 - 3 / norm and got[(1, 2)] == got[(1, 3)] == got[(1, 4)] == 1.0 and abs(got[(2, 1)]) < 1e-12


def test_prompts_shuffle_lines_once(spark):
    rows = lines.explode_lines(spark.createDataFrame([(1, "a\n\nb\nc\nd\ne\nf\ng"), (2, "x")], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, 2, "b", 0.5), (2, 0, "x", 0.4), (2, 7, "no line", 0.4)], "doc_id long, line_num int, text string, confidence double")
    df = scorer.with_prompts(asked, rows)
    assert "Join" not in plan_of(df)  # all lines' neighbours were joined to the candidates
    got = {(r.doc_id, r.line_num): (r.confidence, r.prompt.partition("[before]")[2]) for r in df.collect()}
    assert got == {(1, 2): (0.5, "\na\n[line]\nb\n[after]\nc\nd\ne\nf\ng"), (2, 0): (0.4, "\n\n[line]\nx\n[after]\n")}


def test_windows_are_made_once_and_lines_are_not_joined_back(spark):
    text = "\n".join(["The red boat sailed over the sea."] * 80 + ["", "Numbers of taxes and law courts grow."] * 80)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = structure.marked_lines(docs)
    near = spark.createDataFrame([(1, 1500), (1, 1500)], "doc_id long, char_pos long")
    expected = spark.createDataFrame([(1, 3)], "doc_id long, k long")
    found = topics.topic_changes(docs, expected, rows, near)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(filter(") == plan.count("Generate explode(") == 1
    assert {r.window_no for r in topics.windows(docs, expected, near).collect()} == {w.window_no for w in topics.windows(docs, expected).collect() if abs(w.char_pos - 1500) >= topics.NEAR}


def test_bodies_lose_matching_pieces_inside_lines_and_tails(spark):
    text = ["Chapter 1", "a\rChapter 9\rb", "Chapter 2 Chapter 4 opens a tail of a heading", "text " * 30, "Chapter 3", "end"]
    docs = spark.createDataFrame([(1, "\n".join(text))], "doc_id long, text string")
    made = segment.chapters_by_rules(structure.explode_lines(docs), "^Chapter [0-9]+").orderBy("cid").collect()
    assert [r.body for r in made] == ["a\nb", ("text " * 30).strip(), "end"]


def test_words_are_counted_only_where_a_score_needs_them(spark):
    docs = spark.createDataFrame([(1, "x\nTHIS IS ALL IN CAPITALS NOW\nthis is not in capitals at all")], "doc_id long, text string")
    marked = structure.marked_lines(docs)
    few, every = (structure.features(structure.explode_lines(docs), (), all_words=x).orderBy("line_num").collect() for x in (False, True))
    assert [r.word_count for r in few] == [6, None] and [r.word_count for r in every] == [6, 7]
    whole = {r.line_num: r.confidence for r in structure.scored_lines(structure.explode_lines(docs)).collect()}
    assert {r.line_num: r.confidence for r in marked.collect() if r.confidence is not None} == whole


def test_words_of_windows_are_counted_once(spark):
    """A filter on the change made the counts of words twice, in nested arrays of rows."""
    texts = [("a b a", "A, b; c"), ("", "x"), (None, "x"), ("1 2 3", "..."), ("배 가 배", "배"), ("x " * 600, "x " * 600), ("İi ß", "i̇i ß")]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(texts)], "doc_id long, window_no int, before string, text string").repartition(1)
    found = topics.with_change(rows)
    plan = found.filter("change >= 0.6").select("doc_id", "change")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2 and "aggregate(" not in plan
    got = {r.window_no: r.change for r in found.collect()}
    assert got == {0: 1.0 - 3 / math.sqrt(5 * 3), 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0 - 2 / math.sqrt(5 * 1), 5: 0.0, 6: got[6]}
    assert topics.with_change(rows.limit(0)).collect() == [] and found.columns == [*rows.columns, "change"]


def test_a_wave_is_dealt_evenly_to_as_many_tasks_as_run(spark, tmp_path):
    """The rate holds for a task, so a wave takes as long as its largest part (one task had all of these before)."""
    at = tmp_path / "tasks"
    at.mkdir()

    def start():
        from pyspark import TaskContext

        task = TaskContext.get()

        def model(batch):
            with (at / f"{task.stageId()}-{task.partitionId()}").open("a") as f:
                f.write("x" * len(batch))
            return ["0.5"] * len(batch)

        return model

    store = scorer.Answers(spark, f"{tmp_path}/answers")
    assert store.ask(prompts(spark, [f"p{i % 4000}" for i in range(4100)]), start, waves=2).count() == 4000
    waves = collections.defaultdict(list)
    for f in at.iterdir():
        waves[f.name.split("-")[0]].append(f.stat().st_size)
    cores = spark.sparkContext.defaultParallelism
    assert len(waves) == 2 and sum(map(sum, waves.values())) == 4000
    assert all(len(n) == cores and max(n) < 1.3 * sum(n) / cores for n in waves.values())


def test_prompts_in_place(spark):
    text = "\n".join(["first", "", "A title", " ", "　two ", *[f"line {i}" for i in range(20)], "", "last"])
    rows = lines.explode_lines(spark.createDataFrame([(1, text), (2, "one"), (3, "\n"), (4, None)], "doc_id long, text string"))
    some = F.length("line") > 4
    found = rows.filter(some).select("doc_id", "line_num", strip(F.col("line")).alias("text"))
    want, got = (sorted(map(tuple, df.collect())) for df in (scorer.with_prompts(found, rows), scorer.in_place(rows, F.nullif(some, F.lit(False)))))
    assert got == want and len(got) == 23
    assert scorer.in_place(rows, some)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
