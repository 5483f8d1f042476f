"""Queries of the catalogue: joins, upserts, look-ups, scorer answers and displayed values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.text import strip
from ..operators import boundaries, catalog, lines, records, structure
from .core import CHAP, FILES, FLAGS, NOVELS, POS, SCORED, STATE, STRIP, L, S, _chapters, doc_lines, docs, files, flagged_files, novels, query, state, table
from .core import TOPIC as _TOPIC

FILES2 = f"{FILES}, F2 AS (SELECT *, CASE WHEN id % 11 = 0 THEN '.epub' ELSE '.txt' END AS ext, CASE WHEN id % 3 = 0 THEN concat('/out/', id, '.epub') END AS epub_path FROM FI)"


def files2(spark, d):
    i = F.col("id")
    return files(spark, d).withColumn("ext", F.when(i % 11 == 0, ".epub").otherwise(".txt")).withColumn("epub_path", F.when(i % 3 == 0, F.concat(F.lit("/out/"), i, F.lit(".epub"))))


# --- joins of files, state and novels ------------------------------------------------------------
@query(f"WITH {FILES}, {STATE}, {NOVELS} SELECT id, file_name, title, stage4 FROM FI JOIN ST ON id = file_id JOIN NV ON novel_id = novel_key WHERE stage1 = 1")
def files_state_novels(spark, d):
    f = files(spark, d).join(state(spark, d), F.col("id") == F.col("file_id"))
    return f.filter("stage1 = 1").join(novels(spark, d), F.col("novel_id") == F.col("novel_key")).select("id", "file_name", "title", "stage4")


@query(f"WITH {FILES}, {STATE}, {NOVELS} SELECT id, title, author, stage5 FROM FI JOIN ST ON id = file_id LEFT JOIN NV ON novel_id = novel_key WHERE stage3 = 1")
def files_state_left_novels(spark, d):
    f = files(spark, d).join(state(spark, d), F.col("id") == F.col("file_id"))
    return f.filter("stage3 = 1").join(novels(spark, d), F.col("novel_id") == F.col("novel_key"), "left").select("id", "title", "author", "stage5")


@query(f"WITH {FILES}, {NOVELS} SELECT novel_key, title, id FROM NV JOIN FI ON novel_id = novel_key WHERE novel_key = 3")
def files_of_novel(spark, d):
    return novels(spark, d).filter("novel_key = 3").join(files(spark, d), F.col("novel_id") == F.col("novel_key")).select("novel_key", "title", "id")


@query(f"WITH {FILES}, {NOVELS} SELECT novel_key, title FROM NV WHERE novel_key = (SELECT novel_id FROM FI WHERE id = 17)")
def novel_of_file(spark, d):
    return novels(spark, d).join(files(spark, d).filter("id = 17").select(F.col("novel_id").alias("novel_key")), "novel_key", "left_semi").select("novel_key", "title")


@query(f"WITH {FILES} SELECT id, file_name, file_hash FROM FI WHERE id = 42")
def find_by_id(spark, d):
    return files(spark, d).filter("id = 42").select("id", "file_name", "file_hash")


@query(f"WITH {FLAGS}, {STATE} SELECT id, file_name FROM FX JOIN ST ON id = file_id WHERE (stage4 = 1 OR id % 11 = 0) AND stage2 = 0 AND is_duplicate = 0")
def pending_verify_formats(spark, d):
    f = flagged_files(spark, d).withColumn("ext", F.when(F.col("id") % 11 == 0, ".epub").otherwise(".txt")).filter(F.col("ext").isin(".epub", ".txt"))
    ready = f.join(state(spark, d), F.col("id") == F.col("file_id")).filter("(stage4 = 1 or ext = '.epub') and stage2 = 0 and is_duplicate = 0")
    return ready.select("id", "file_name")


@query(f"WITH {FLAGS}, {STATE} SELECT id, stage4 FROM FX JOIN ST ON id = file_id WHERE stage1 = 1 AND is_duplicate = 0 ORDER BY stage4, id LIMIT 50")
def split_queue(spark, d):
    f = flagged_files(spark, d).join(state(spark, d), F.col("id") == F.col("file_id"))
    return f.filter("stage1 = 1 and is_duplicate = 0").orderBy("stage4", "id").select("id", "stage4").limit(50)


@query(f"WITH {FILES2}, {STATE} SELECT id, epub_path FROM F2 JOIN ST ON id = file_id WHERE stage5 = 1 AND epub_path IS NOT NULL ORDER BY id LIMIT 10")
def epub_candidates(spark, d):
    f = files2(spark, d).filter("epub_path is not null").join(state(spark, d), F.col("id") == F.col("file_id"))
    return f.filter("stage5 = 1").orderBy("id").select("id", "epub_path").limit(10)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_first(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate").limit(20)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY user_id")
def latest_of_each(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


# --- writes, as the tables that they leave -------------------------------------------------------
_OLD = "EX AS (SELECT file_hash, min(id) AS id FROM FI WHERE id % 3 > 0 GROUP BY file_hash), SC AS (SELECT file_hash, max(id) AS id FROM FI WHERE id % 2 = 0 GROUP BY file_hash)"


@query(f"WITH {FILES}, {_OLD} SELECT coalesce(SC.file_hash, EX.file_hash) AS file_hash, coalesce(SC.id, EX.id) AS id, CASE WHEN SC.id IS NULL THEN 'kept' WHEN EX.id IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM EX FULL JOIN SC ON SC.file_hash = EX.file_hash")
def catalogue_upsert(spark, d):
    f = files(spark, d)
    old = f.filter("id % 3 > 0").groupBy("file_hash").agg(F.min("id").alias("id"))
    scanned = f.filter("id % 2 = 0").groupBy("file_hash").agg(F.max("id").alias("id"))
    return records.upserted(old, scanned, "file_hash")


@query(f"WITH {FILES}, {NOVELS} SELECT DISTINCT concat('작품 ', novel_id) AS title FROM FI WHERE concat('작품 ', novel_id) NOT IN (SELECT title FROM NV)")
def novels_to_insert(spark, d):
    """Works of files that the catalogue has not: combined before the shuffle, then without those known."""
    found = files(spark, d).select(F.concat(F.lit("작품 "), "novel_id").alias("title")).distinct()
    return found.join(novels(spark, d).select("title"), "title", "left_anti")


@query(f"WITH {FILES}, {STATE}, DK AS (SELECT id FROM FI WHERE id % 13 > 0) SELECT FI.id, stage1, file_path FROM FI JOIN ST ON id = file_id WHERE id NOT IN (SELECT id FROM DK)")
def missing_files(spark, d):
    """Catalogue rows, with their state, whose file the folder no longer has."""
    f = files(spark, d)
    gone = f.join(f.filter("id % 13 > 0").select("id"), "id", "left_anti")
    return gone.join(state(spark, d), F.col("id") == F.col("file_id")).select("id", "stage1", "file_path")


@query(f"WITH {FILES}, {STATE}, {NOVELS} SELECT id, concat(file_path, ' -> ', title, '.txt') AS plan, 1 AS stage3 FROM FI JOIN ST ON id = file_id JOIN NV ON novel_id = novel_key WHERE stage1 = 1 AND stage3 = 0")
def rename_plan(spark, d):
    f = files(spark, d).join(state(spark, d).filter("stage1 = 1 and stage3 = 0"), F.col("id") == F.col("file_id")).join(novels(spark, d), F.col("novel_id") == F.col("novel_key"))
    return f.select("id", F.concat("file_path", F.lit(" -> "), "title", F.lit(".txt")).alias("plan"), F.lit(1).alias("stage3"))


# --- decisions and look-ups ----------------------------------------------------------------------
@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 8 = 1 THEN concat('새 ', p_name) ELSE p_name END AS title FROM part WHERE p_partkey % 4 <> 2")
def title_decisions(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("\x01", "p_name", "p_partkey").alias("title"), "p_name")
    k = F.col("p_partkey")
    made = p.filter(k % 4 > 0).select("title", (k % 4 != 2).alias("accepted"), F.when(k % 8 == 1, F.concat(F.lit("새 "), "p_name", F.lit("\x01"), k)).alias("renamed"))
    return records.decided(p.select("p_partkey", "title"), made).select("p_partkey", F.split("title", "\x01")[0].alias("title"))


@query("WITH N AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 2 THEN concat('new ', s_suppkey - 1) ELSE concat('old ', s_suppkey) END AS name FROM supplier), D AS (SELECT concat('old ', s_suppkey) AS original, concat('new ', s_suppkey) AS new FROM supplier WHERE s_suppkey % 3 = 1) SELECT id, name, D.new, CASE WHEN D.new IS NOT NULL THEN 'rename' WHEN name IN (SELECT new FROM D) THEN 'done' ELSE 'unknown' END AS result FROM N LEFT JOIN D ON name = original")
def rename_dictionary(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    names = s.select(k.alias("id"), F.when(k % 3 == 2, F.concat(F.lit("new "), k - 1)).otherwise(F.concat(F.lit("old "), k)).alias("name"))
    return records.renamed(names, s.filter(k % 3 == 1).select(F.concat(F.lit("old "), k).alias("original"), F.concat(F.lit("new "), k).alias("new")))


@query("SELECT l_orderkey AS book, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS subjects FROM lineitem GROUP BY l_orderkey")
def subjects_by_book(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("book")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")), ",").alias("subjects"))


# an answer for each document: by number, by place, out of order, twice, beyond the end, and none at all
_HINTS = "CASE line_num % 5 WHEN 0 THEN concat(line_num + 1, ' | ', left(line, 9)) WHEN 1 THEN concat('at its place ', length(line)) WHEN 2 THEN concat(line_num + 2, '|early ', length(line)) WHEN 3 THEN concat(' ', line_num * 7, ' | far ', length(line)) ELSE ' ' END"


@query(f"""WITH {L}, HA AS (SELECT doc_id, string_agg({_HINTS}, chr(10) ORDER BY line_num) AS answer FROM L GROUP BY doc_id),
  HS AS (SELECT doc_id, unnest(range(len(a))) AS place, unnest(a) AS said FROM (SELECT doc_id, string_split(answer, chr(10)) AS a FROM HA)),
  HN AS (SELECT doc_id, place, said, try_cast(nullif(regexp_extract(said, '^[{S}]*([0-9]+)[{S}]*[|](.*)$', 1), '') AS INT) AS n FROM HS WHERE {STRIP.format('said')} <> ''),
  HH AS (SELECT doc_id, coalesce(n - 1, place) AS line_num, CASE WHEN n IS NOT NULL THEN {STRIP.format("regexp_extract(said, '[|](.*)$', 1)")} ELSE {STRIP.format('said')} END AS hint, row_number() OVER (PARTITION BY doc_id, coalesce(n - 1, place) ORDER BY n IS NULL, place) AS r FROM HN)
  SELECT L.doc_id, L.line_num, line, hint FROM L LEFT JOIN HH ON HH.doc_id = L.doc_id AND HH.line_num = L.line_num AND r = 1""")
def hint_zip(spark, d):
    """Hints of an answer, put beside the lines that they are for."""
    rows = doc_lines(spark, d)
    said = rows.select("doc_id", "line_num", F.expr(_HINTS.replace("left(line, 9)", "substring(line, 1, 9)")).alias("said"))
    answers = said.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "said"))), lambda x: x["said"]), "\n").alias("answer"))
    return records.zipped_hints(rows, answers)


_ISBN = "BK AS (SELECT o_orderkey AS book, CASE WHEN o_orderkey % 3 > 0 THEN concat('978', o_custkey) END AS isbn13, CASE WHEN o_orderkey % 2 = 0 THEN concat('X', o_custkey) END AS isbn10, CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' ELSE concat('t', o_orderkey) END AS title, CASE WHEN o_orderkey % 5 > 0 THEN concat('a', o_orderkey) END AS author FROM orders), RF AS (SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN '978' ELSE 'X' END, c_custkey) AS isbn, c_name AS title, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS author, concat('/works/W', c_custkey) AS work, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS pages FROM customer)"


@query(f"WITH {_ISBN} SELECT book, coalesce(isbn13, isbn10) AS isbn, CASE WHEN BK.title = 'Unknown' THEN coalesce(RF.title, BK.title) ELSE BK.title END AS title, coalesce(BK.author, RF.author) AS author, nullif(regexp_extract(work, '/works/(.+)', 1), '') AS work, pages FROM BK LEFT JOIN RF ON RF.isbn = coalesce(isbn13, isbn10)")
def isbn_enrichment(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    books = table(spark, d, "orders").select(k.alias("book"), F.coalesce(F.when(k % 3 > 0, F.concat(F.lit("978"), c)), F.when(k % 2 == 0, F.concat(F.lit("X"), c))).alias("isbn"), F.when(k % 4 == 0, "Unknown").otherwise(F.concat(F.lit("t"), k)).alias("title"), F.when(k % 5 > 0, F.concat(F.lit("a"), k)).alias("author"))
    i = F.col("c_custkey")
    ref = table(spark, d, "customer").select(F.concat(F.when(i % 2 == 0, "978").otherwise("X"), i).alias("isbn"), F.col("c_name").alias("r_title"), F.when(i % 3 > 0, F.col("c_mktsegment")).alias("r_author"), F.concat(F.lit("/works/W"), i).alias("work"), F.when(i % 7 > 0, F.col("c_nationkey")).alias("pages"))
    title = F.when(F.col("title") == "Unknown", F.coalesce("r_title", "title")).otherwise(F.col("title"))
    return books.join(ref, "isbn", "left").select("book", "isbn", title.alias("title"), F.coalesce("author", "r_author").alias("author"), F.nullif(F.regexp_extract("work", "/works/(.+)", 1), F.lit("")).alias("work"), "pages")


_AUTHOR = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Unknown Author' ELSE c_name END"
_GENRE = "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' WHEN 2 THEN '' ELSE c_mktsegment END"


@query(f"SELECT c_custkey, coalesce(trim({_AUTHOR}) <> '' AND NOT contains({_AUTHOR}, 'Unknown'), false) OR coalesce(trim({_GENRE}) <> '' AND NOT contains({_GENRE}, 'Unknown'), false) AS sufficient FROM customer")
def metadata_sufficiency(spark, d):
    return table(spark, d, "customer").select("c_custkey", records.sufficient(F.expr(_AUTHOR), F.expr(_GENRE)).alias("sufficient"))


@query(f"SELECT c_custkey, nullif({_AUTHOR}, 'Unknown') AS author, nullif({_GENRE}, 'Unknown') AS genre, CASE WHEN coalesce({_GENRE}, '') IN ('', 'Unknown') THEN CASE WHEN c_custkey % 3 > 0 THEN '1~9화' ELSE nullif({_GENRE}, 'Unknown') END ELSE {_GENRE} END AS episode_range FROM customer")
def filename_hint_merge(spark, d):
    return table(spark, d, "customer").select("c_custkey", records.without_unknown(F.expr(_AUTHOR)).alias("author"), records.without_unknown(F.expr(_GENRE)).alias("genre"), records.hinted_range(F.expr(_GENRE), F.when(F.col("c_custkey") % 3 > 0, "1~9화")).alias("episode_range"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 OR o_custkey >= 0.8::DOUBLE * (o_orderkey % 1000) THEN o_custkey ELSE o_orderkey % 1000 END AS size FROM orders")
def cover_selection(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k, records.larger_cover(F.when(k % 6 > 0, k % 1000), F.col("o_custkey")).alias("size"))


# --- counts and sums -----------------------------------------------------------------------------
@query("SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS a, sum(o_orderkey)::BIGINT AS b FROM orders GROUP BY o_orderstatus")
def batch_stats(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("a"), F.sum("o_orderkey").alias("b"))


@query(f"WITH {FILES} SELECT count(*) AS total, ceil(count(*) / 15::DOUBLE)::BIGINT AS pages FROM (SELECT id FROM FI WHERE contains(file_name, 'src1'))")
def search_total(spark, d):
    hit = files(spark, d).filter(F.contains(F.col("file_name"), F.lit("src1")))
    return hit.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 15).alias("pages"))


@query(f"WITH {SCORED}, A AS (SELECT doc_id, sum(floor(confidence * 1000)::BIGINT) / count(*)::DOUBLE AS m FROM C GROUP BY doc_id) SELECT D.doc_id, coalesce(A.m, 0) AS confidence FROM documents D LEFT JOIN A ON A.doc_id = D.doc_id")
def overall_confidence(spark, d):
    """Mean confidence in thousandths (whole numbers, so that the sum's order does not matter); 0 without lines."""
    m = structure.scored_lines(doc_lines(spark, d)).groupBy("doc_id").agg((F.sum(F.floor(F.col("confidence") * 1000)) / F.count("*")).alias("m"))
    return docs(spark, d).select("doc_id").join(m, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(0.0)).alias("confidence"))


@query("WITH PR(prefix, price) AS (VALUES ('m-', 0.5::DOUBLE), ('m-1', 0.25::DOUBLE), ('big', 2::DOUBLE)), CL AS (SELECT CASE user_id % 4 WHEN 0 THEN 'm-2' WHEN 1 THEN 'm-1-mini' WHEN 2 THEN 'big' ELSE 'other' END AS model, event_id % 1000 AS tokens FROM events), M AS (SELECT model, count(*) AS calls, sum(tokens)::BIGINT AS tokens FROM CL GROUP BY model) SELECT model, calls, tokens, tokens * coalesce((SELECT arg_max(price, length(prefix)) FROM PR WHERE starts_with(M.model, prefix)), 0) / 1000 AS cost FROM M")
def usage_cost(spark, d):
    u = F.col("user_id") % 4
    calls = table(spark, d, "events").select(F.when(u == 0, "m-2").when(u == 1, "m-1-mini").when(u == 2, "big").otherwise("other").alias("model"), (F.col("event_id") % 1000).alias("tokens"))
    return records.usage_cost(calls, spark.createDataFrame([("m-", 0.5), ("m-1", 0.25), ("big", 2.0)], "prefix string, price double"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 7 > 0) AS done, count(*) FILTER (WHERE event_id % 7 = 0) AS failed FROM events")
def result_counters(spark, d):
    ok = F.col("event_id") % 7 > 0
    return table(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"))


# --- places, numbers and examples ----------------------------------------------------------------
@query(f"WITH {POS}, Q AS (SELECT doc_id, unnest([0, length(text) // 3, length(text) // 2, length(text) + 99]) AS pos FROM documents WHERE text <> '') SELECT DISTINCT Q.doc_id, Q.pos::BIGINT AS pos, max(P.line_num) AS line_num FROM Q JOIN P ON P.doc_id = Q.doc_id AND P.char_pos <= Q.pos GROUP BY Q.doc_id, Q.pos")
def position_to_line(spark, d):
    n = F.length("text")
    where = F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), n + 99)
    at = docs(spark, d).filter("text <> ''").select("doc_id", F.explode(F.array_distinct(where.cast("array<bigint>"))).alias("pos"))
    return records.line_of(at, lines.with_offsets(doc_lines(spark, d)).select("doc_id", "line_num", "char_pos"))


_TYPE = "CASE WHEN cid % 4 = 3 THEN '외전' WHEN cid % 5 = 0 THEN '작가의 말' ELSE '본편' END"


@query(f"WITH {CHAP}, TY AS (SELECT doc_id, cid, title, {_TYPE} AS t FROM CH), FT AS (SELECT *, min(cid) OVER (PARTITION BY doc_id, t) AS f FROM TY), NU AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, cid) AS number FROM FT) SELECT doc_id, cid::INT AS cid, number::INT AS number, concat(CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END, '. ', title) AS shown FROM NU")
def chapter_numbering(spark, d):
    typed = _chapters(spark, d).select("doc_id", "cid", "title", F.expr(_TYPE).alias("chapter_type"))
    return records.numbered_by_type(typed).select("doc_id", "cid", "number", "shown")


@query(f"WITH {CHAP} SELECT doc_id, cid::INT AS cid, CASE WHEN regexp_matches(title, '[0-9]') THEN title ELSE concat('[', cid, '] ', title) END AS shown FROM CH")
def display_titles(spark, d):
    return _chapters(spark, d).select("doc_id", "cid", records.display_title(F.col("cid"), F.col("title")).alias("shown"))


@query(f"WITH {CHAP}, N AS (SELECT doc_id, count(*) AS n FROM CH GROUP BY doc_id), E AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 12 ELSE 0 END AS expected FROM documents) SELECT E.doc_id, CASE WHEN expected > 0 AND abs(expected - coalesce(n, 0)) > 5 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS confidence FROM E LEFT JOIN N ON N.doc_id = E.doc_id")
def episode_count_confidence(spark, d):
    n = _chapters(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    expected = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 12).otherwise(0)
    return docs(spark, d).select("doc_id", expected.alias("e")).join(n, "doc_id", "left").select("doc_id", records.count_confidence(F.col("e"), F.coalesce("n", F.lit(0))).alias("confidence"))


@query(f"WITH {L}, X AS (SELECT regexp_extract(line, '^[^{S}]+', 0) AS head, doc_id, line_num FROM L), Y AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY doc_id, line_num) AS r FROM X WHERE head <> '') SELECT head, doc_id, line_num FROM Y WHERE r <= 10")
def first_examples(spark, d):
    rows = doc_lines(spark, d).select(F.regexp_extract("line", f"^[^{S}]+", 0).alias("head"), "doc_id", "line_num").filter("head <> ''")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("doc_id", "line_num"))).filter("r <= 10").drop("r")


@query(f"WITH {_TOPIC}, W1 AS (SELECT doc_id, window_no, window_no * step AS char_pos FROM TW), {SCORED}, CU AS (SELECT doc_id, line_num FROM C WHERE confidence > 0.6::DOUBLE), PP AS (SELECT doc_id, line_num, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_pos FROM L), EX AS (SELECT PP.doc_id, PP.char_pos FROM CU JOIN PP ON PP.doc_id = CU.doc_id AND PP.line_num = CU.line_num) SELECT doc_id, window_no FROM W1 WHERE NOT EXISTS (SELECT 1 FROM EX WHERE EX.doc_id = W1.doc_id AND abs(EX.char_pos - W1.char_pos) < 5000)")
def topic_without_overlap(spark, d):
    """Topic windows with no structural candidate within 5,000 characters."""
    w = boundaries.topic_windows(docs(spark, d)).select("doc_id", "window_no", "char_pos")
    at = lines.with_offsets(doc_lines(spark, d))
    strong = structure.scored_lines(at.select("doc_id", "line_num", "line")).filter("confidence > 0.6").select("doc_id", "line_num")
    existing = at.select("doc_id", "line_num", "char_pos").join(strong, ["doc_id", "line_num"]).select("doc_id", "char_pos")
    return boundaries.without_near(w, existing, "char_pos", 5000).select("doc_id", "window_no")


@query(f"WITH {SCORED}, {_TOPIC} SELECT doc_id, line_num AS place, 'structure' AS method, confidence FROM C WHERE confidence > 0.6::DOUBLE UNION ALL SELECT doc_id, window_no * step, 'topic', NULL FROM TW WHERE window_no > 0")
def candidate_union(spark, d):
    a = structure.scored_lines(doc_lines(spark, d)).filter("confidence > 0.6").select("doc_id", F.col("line_num").cast("long").alias("place"), F.lit("structure").alias("method"), "confidence")
    b = boundaries.topic_windows(docs(spark, d)).filter("window_no > 0").select("doc_id", F.col("char_pos").alias("place"), F.lit("topic").alias("method"))
    return a.unionByName(b, allowMissingColumns=True)


# --- answers and displayed values ----------------------------------------------------------------
_ANSWER = "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN concat('Score: 0.', event_id % 100, '.') WHEN 3 THEN '1.0' WHEN 4 THEN '.75' WHEN 5 THEN 'it is 1' ELSE '0 of 1' END"


@query(f"WITH A AS (SELECT event_id, nullif(regexp_extract({_ANSWER}, '0?\\.[0-9]+|1\\.0|0|1', 0), '')::DOUBLE AS n FROM events) SELECT event_id, CASE WHEN n IS NULL THEN 0.5::DOUBLE ELSE least(1::DOUBLE, greatest(0::DOUBLE, n)) END AS score FROM A")
def score_parse(spark, d):
    return table(spark, d, "events").select("event_id", records.score_of(F.expr(_ANSWER)).alias("score"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('t', event_id) WHEN 1 THEN concat('t', event_id) WHEN 2 THEN concat('t', event_id) ELSE concat('f', event_id) END AS title, CASE WHEN event_id % 5 IN (0, 2) THEN event_id END AS n FROM events")
def json_salvage(spark, d):
    """Answers: plain, cut before the end, inside talk, no object, damaged."""
    k = F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"title": "t'), k, F.lit('", "n": '), k, F.lit("}"))
    cut = F.concat(F.lit('{"title": "t'), k, F.lit('", "m": {"x": 1'))
    m = F.col("event_id") % 5
    answer = F.when(m == 0, whole).when(m == 1, cut).when(m == 2, F.concat(F.lit("Here: "), whole, F.lit(" as asked"))).when(m == 3, "I do not know").otherwise('{"title": ')
    got = records.salvaged(answer, "title string, n long, m struct<x: int>", F.concat(F.lit("f"), k))
    return table(spark, d, "events").select("event_id", got.alias("r")).select("event_id", "r.title", "r.n")


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id ELSE -1 END AS n FROM events")
def fenced_json(spark, d):
    k = F.col("event_id").cast("string")
    m = F.col("event_id") % 3
    answer = F.when(m == 0, F.concat(F.lit('```json\n{"n": '), k, F.lit("}\n``` done"))).when(m == 1, F.concat(F.lit(' {"n": '), k, F.lit("} "))).otherwise("```\nnothing\n```")
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json(records.unfenced(answer), "n long")["n"], F.lit(-1)).alias("n"))


_REASON = "CASE event_id % 6 WHEN 0 THEN '3' WHEN 1 THEN 'SAFETY' ELSE 'STOP' END"
_SAID = "CASE event_id % 6 WHEN 2 THEN 'Error: 429 Rate Limit' WHEN 3 THEN ' ' WHEN 4 THEN 'Quota exceeded' ELSE 'fine' END"


@query(f"SELECT event_id, CASE WHEN {_REASON} IN ('3', '5', 'SAFETY') THEN 'censored' WHEN contains({_SAID}, '429') OR contains(lower({_SAID}), 'quota') THEN 'retry' WHEN trim({_SAID}) = '' THEN 'empty' ELSE 'done' END AS outcome FROM events")
def answer_outcome(spark, d):
    return table(spark, d, "events").select("event_id", records.outcome(F.expr(_SAID), F.expr(_REASON)).alias("outcome"))


_PATH = "CASE p_partkey % 4 WHEN 0 THEN concat(' a/b:', p_name, '?.epub') WHEN 1 THEN concat(repeat('가', 200), p_name) WHEN 2 THEN concat(p_name, '<>|\"*') ELSE p_name END"


@query(f"WITH X AS (SELECT p_partkey, left(trim(regexp_replace({_PATH}, '[{records.FORBIDDEN}]', '', 'g')), 150) AS t FROM part) SELECT p_partkey, CASE WHEN ends_with(t, '.epub') THEN t ELSE concat(t, '.epub') END AS path FROM X")
def output_paths(spark, d):
    return table(spark, d, "part").select("p_partkey", records.output_path(F.expr(_PATH)).alias("path"))


@query(f"WITH {FILES}, X AS (SELECT id, file_size, file_size * 1000 AS large, 20000 AS most FROM FI) SELECT id, CASE WHEN large >= 1048576 THEN concat(large * 100 // 1048576 // 100, '.', lpad((large * 100 // 1048576 % 100)::VARCHAR, 2, '0'), ' MB') ELSE concat(large * 10 // 1024 // 10, '.', large * 10 // 1024 % 10, ' KB') END AS size, concat(repeat('#', least(40, floor(file_size * 40 / 20000::DOUBLE))::INT), repeat('-', 40 - least(40, floor(file_size * 40 / 20000::DOUBLE))::INT)) AS bar, floor(large / 7500::DOUBLE)::BIGINT AS chapters FROM X")
def shown_sizes(spark, d):
    size = F.col("file_size")
    return files(spark, d).select("id", records.size_shown(size * 1000).alias("size"), records.bar(F.least(size, F.lit(20_000)), F.lit(20_000)).alias("bar"), records.estimated_chapters(size * 1000).alias("chapters"))


@query(f"WITH {L} SELECT doc_id, line_num FROM L WHERE NOT regexp_matches(line, '(?i)the|http') AND {STRIP.format('line')} <> ''")
def ignored_lines(spark, d):
    """Lines that none of the ignore patterns (whatever the case of letters) matches."""
    return doc_lines(spark, d).filter(~F.col("line").rlike("(?i)the|http") & (strip(F.col("line")) != "")).select("doc_id", "line_num")


# patterns of parts: their types as they are, shortened to what matches any line, or with letters around it
_PATTERN = "CASE p_partkey % 7 WHEN 0 THEN '.+' WHEN 1 THEN '.' WHEN 2 THEN '.*' WHEN 3 THEN concat('^', p_type) WHEN 4 THEN concat('.+', p_size) WHEN 5 THEN ' .*' ELSE p_brand END"


@query(f"SELECT p_partkey, {_PATTERN} IN ('.+', '.', '.*') AS permissive FROM part")
def permissive_patterns(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(_PATTERN).isin(records.PERMISSIVE).alias("permissive"))


# --- what is left to do, and what was done -----------------------------------------------------------
_EXT = "CASE WHEN FX.id % 11 = 0 THEN '.epub' WHEN FX.id % 17 = 0 THEN '.zip' ELSE '.txt' END"


@query(f"WITH {FLAGS}, {STATE}, {NOVELS} SELECT FX.id, title, author FROM FX JOIN ST ON id = file_id LEFT JOIN NV ON novel_id = novel_key WHERE stage3 = 1 AND stage5 = 0 AND is_duplicate = 0 AND {_EXT} IN ('.txt', '.epub')")
def pending_epub(spark, d):
    """Files that have their name, no e-book yet, are no copies, and are of a kind that can become one; by id."""
    f = flagged_files(spark, d).withColumn("ext", F.expr(_EXT.replace("FX.", ""))).filter(F.col("ext").isin(".txt", ".epub"))
    work = catalog.pending(f, state(spark, d), F.expr("stage3 = 1 AND stage5 = 0"), ["id", "novel_id"])
    return work.join(novels(spark, d), F.col("novel_id") == F.col("novel_key"), "left").select("id", "title", "author")


_STATUS = {"completed": "stage5 = 1", "incomplete": "stage5 = 0", "error": "last_error IS NOT NULL"}


@query(f"WITH {FLAGS}, {STATE} SELECT status, count(*) AS n, min(id) AS first FROM FX LEFT JOIN ST ON id = file_id, (SELECT unnest({list(_STATUS)}) AS status) WHERE CASE status {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _STATUS.items())} END AND is_duplicate = 0 AND contains(file_name, '1') GROUP BY status")
def catalog_status_filters(spark, d):
    """The search's status filters, all at once: files that are no copies and whose name holds a text, by each status that they have."""
    f = flagged_files(spark, d).join(state(spark, d), F.col("id") == F.col("file_id"), "left").filter("is_duplicate = 0").filter(F.contains("file_name", F.lit("1")))
    return catalog.by_status(f, _STATUS).groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"WITH {FILES}, C AS (SELECT file_hash, min(id) AS id, min(file_size) AS size FROM FI GROUP BY file_hash) SELECT file_hash, CASE WHEN id % 6 > 0 THEN id END AS episodes, CASE WHEN id % 6 > 1 THEN concat('1~', size % 300) END AS detected FROM C")
def cached_results(spark, d):
    """Results kept as JSON by content, read back: some are damaged, some lack a field; these are null."""
    f = files(spark, d).groupBy("file_hash").agg(F.min("id").alias("id"), F.min("file_size").alias("size"))
    whole = F.to_json(F.struct(F.col("id").alias("episodes"), F.concat(F.lit("1~"), F.col("size") % 300).alias("detected")))
    kept = f.select("file_hash", F.when(F.col("id") % 6 == 0, "{\"episodes\": ").when(F.col("id") % 6 == 1, F.to_json(F.struct(F.col("id").alias("episodes")))).otherwise(whole).alias("value"))
    return records.cached(written(kept, "cache"), "episodes long, detected string").select("file_hash", "episodes", "detected")
