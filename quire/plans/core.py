"""The engine's queries over the tables of a folder, each beside SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, SPACE, byte_truncate, strip
from ..operators import boundaries, catalog, dedup, lines, merge, quality, segment, structure, titles
from ..sources import epub_sink, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.explode_lines(docs(spark, d))


# --- SQL shared by the oracles -------------------------------------------------------------------
S = SPACE
STRIP = f"regexp_replace({{}}, '^[{S}]+|[{S}]+$', '', 'g')"
L = "L AS (SELECT doc_id, unnest(range(len(a)))::INT AS line_num, unnest(a) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS a FROM documents WHERE text <> ''))"
TABLE_SQL = L
LB = f"{L}, B AS (SELECT *, {STRIP.format('line')} AS body FROM L)"
W = "(PARTITION BY doc_id ORDER BY line_num)"
WB = "(PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
POS = f"{L}, P AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER {WB}, 0)::BIGINT AS byte_pos, coalesce(sum(length(line) + 1) OVER {WB}, 0)::BIGINT AS char_pos FROM L)"


def _any(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("\\s", f"[{S}]").replace("'", "''")


_OPEN, _CLOSE = (x.replace("'", "''") for x in (structure.OPEN_QUOTES, structure.CLOSE_QUOTES))
FEATURES = f"""{LB}, N AS (SELECT *, lead(body) OVER {W} AS next_body, lag(body) OVER {W} AS prev_body,
  coalesce(line_num - max(CASE WHEN body <> '' OR line_num = 0 THEN line_num END) OVER {WB} - 1, 0) AS blanks FROM B),
F AS (SELECT doc_id, line_num, body AS text, length(body) < 50 AS is_short, length(body) < 30 AS is_very_short, blanks >= 1 AS has_blank_before, blanks::BIGINT AS blank_count_before,
  regexp_matches(body, '{_any(structure.INDICATORS)}') AS has_chapter_indicator, regexp_matches(body, '{_any(structure.TIME_PLACE)}') AS has_time_place,
  regexp_matches(body, '[0-9]') AS has_number, regexp_matches(body, '[\\[\\]【】]') AS has_brackets, regexp_matches(body, '[.!?。！？]$') AS has_punctuation_end,
  regexp_matches(body, '\\p{{Lu}}') AND NOT regexp_matches(body, '\\p{{Ll}}') AS is_all_caps, regexp_matches(body, '^\\p{{Lu}}') AS starts_with_caps,
  len(string_split(regexp_replace(body, '[{S}]+', ' ', 'g'), ' '))::BIGINT AS word_count,
  regexp_matches(body, '^[{_OPEN}].+[{_CLOSE}]$') OR regexp_matches(body, '^.{{1,40}}[?!？！]$') AS is_dialogue,
  regexp_matches(body, '[.。다요죠습]$') AND NOT regexp_matches(body, '{_any(structure.INDICATORS)}') AS is_sentence,
  coalesce(next_body <> '' AND length(next_body) > length(body) * 1.5, false) AS longer_lines_after, coalesce(length(prev_body) > 200, false) AS long_line_before
  FROM N WHERE line_num > 0 AND body <> '')"""
_W = [("is_short", .3), ("is_very_short", .2), ("has_blank_before", .2), ("blank_count_before >= 2", .1), ("has_chapter_indicator", .4), ("has_number", .15), ("has_brackets", .1), ("has_time_place", .2), ("longer_lines_after", .15), ("long_line_before", .1), ("is_all_caps AND word_count BETWEEN 6 AND 14", .15), ("is_dialogue", -.4), ("is_sentence", -.3)]
SCORED = FEATURES + ", C AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, 0::DOUBLE" + "".join(f" + CASE WHEN {c} THEN ({w})::DOUBLE ELSE 0::DOUBLE END" for c, w in _W) + ")) AS confidence FROM F)"


def _fold(source: str, distance: int) -> str:
    """Recursive counterpart of structure.spaced over a CTE `source` (doc_id, line_num)."""
    return f"""K AS (SELECT doc_id, line_num, row_number() OVER {W} AS rn FROM {source}),
  R AS (SELECT doc_id, rn, line_num AS last, true AS kept, line_num FROM K WHERE rn = 1 UNION ALL
  SELECT K.doc_id, K.rn, CASE WHEN K.line_num - R.last >= {distance} THEN K.line_num ELSE R.last END, K.line_num - R.last >= {distance}, K.line_num FROM R JOIN K ON K.doc_id = R.doc_id AND K.rn = R.rn + 1)"""


# --- lines ---------------------------------------------------------------------------------------
@query(f"WITH {L} SELECT doc_id, line_num, line FROM L")
def lines_explode(spark, d):
    return doc_lines(spark, d)


@query(f"WITH {POS} SELECT doc_id, line_num, byte_pos, char_pos FROM P")
def line_offsets(spark, d):
    return lines.with_offsets(doc_lines(spark, d)).select("doc_id", "line_num", "byte_pos", "char_pos")


@query(f"WITH {FEATURES} SELECT doc_id, line_num, blanks::INT AS blanks_before FROM N")
def blank_run_before(spark, d):
    return lines.with_neighbours(doc_lines(spark, d)).select("doc_id", "line_num", F.col("blanks_before").cast("int").alias("blanks_before"))


@query(f"""WITH {LB} SELECT doc_id, line_num,
  coalesce(array_to_string(list_filter(list(nullif(body, '')) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), chr(10)), '') AS before,
  coalesce(array_to_string(list_filter(list(nullif(body, '')) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), lambda x: x IS NOT NULL), chr(10)), '') AS after FROM B""")
def ai_context_window(spark, d):
    return lines.nearby_lines(doc_lines(spark, d))


@query(f"""WITH {LB}, R AS (SELECT *, line_num - coalesce(max(CASE WHEN body <> '' THEN line_num END) OVER (PARTITION BY doc_id ORDER BY line_num ROWS UNBOUNDED PRECEDING), -1) AS run FROM B)
  SELECT doc_id, line_num, line FROM R WHERE run <= 2""")
def blank_line_squeeze(spark, d):
    return lines.squeeze_blank_lines(doc_lines(spark, d)).select("doc_id", "line_num", "line")


# --- structure -----------------------------------------------------------------------------------
@query(f"WITH {FEATURES} SELECT * FROM F")
def structural_features(spark, d):
    return structure.features(doc_lines(spark, d))


@query(f"WITH {SCORED} SELECT doc_id, line_num, text, confidence FROM C")
def structural_confidence(spark, d):
    return structure.scored_lines(doc_lines(spark, d)).select("doc_id", "line_num", "text", "confidence")


@query(f"""WITH RECURSIVE {SCORED}, T AS (SELECT * FROM (SELECT *, row_number() OVER {W} AS r FROM C WHERE confidence > 0.3::DOUBLE) WHERE r <= 1000), {_fold('T', 10)}
  SELECT T.doc_id, T.line_num, T.text, T.confidence FROM T JOIN R USING (doc_id, line_num) WHERE R.kept""")
def structural_candidates(spark, d):
    return structure.candidates(doc_lines(spark, d)).select("doc_id", "line_num", "text", "confidence")


@query(f"""WITH RECURSIVE {LB}, T AS (SELECT doc_id, line_num FROM B WHERE length(body) BETWEEN 1 AND 59), {_fold('T', 10)} SELECT doc_id, line_num::BIGINT AS line_num FROM R WHERE kept""")
def min_distance_filter(spark, d):
    short = doc_lines(spark, d).filter(F.length(strip(F.col("line"))).between(1, 59))
    return structure.spaced(short.select("doc_id", F.col("line_num").cast("long").alias("line_num")), "line_num", 10)


@query(f"WITH {SCORED} SELECT doc_id, line_num, confidence, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, line_num) AS r FROM C) WHERE r <= 300")
def top_candidates_per_doc(spark, d):
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "line_num")
    return structure.scored_lines(doc_lines(spark, d)).select("doc_id", "line_num", "confidence", F.row_number().over(w).cast("long").alias("r")).filter("r <= 300")


# --- segmentation --------------------------------------------------------------------------------
FLAG = f"{LB}, G AS (SELECT *, body <> '' AND regexp_matches(body, '^.{{1,29}}$') AS b FROM B), Q AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY line_num ROWS UNBOUNDED PRECEDING) AS seg FROM G)"
CHAP = f"""{FLAG}, H AS (SELECT doc_id, seg, min(line_num) AS line_num, left(arg_min(body, line_num), 100) AS title, coalesce(string_agg(line, chr(10) ORDER BY line_num) FILTER (WHERE NOT b), '') AS body FROM Q WHERE seg > 0 GROUP BY doc_id, seg),
  CH AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS cid, title, body, length(body) AS length, line_num FROM H WHERE {STRIP.format('body')} <> '')"""


def _chapters(spark, d):
    return segment.chapters(segment.flagged(doc_lines(spark, d), segment.HEADING))


@query(f"WITH {CHAP} SELECT doc_id, cid::INT AS cid, title, body, length, line_num FROM CH")
def regex_segment_chapters(spark, d):
    return _chapters(spark, d)


@query(f"""WITH {FLAG}, T AS (SELECT doc_id, max(line_num) + 1 AS n FROM L GROUP BY doc_id) SELECT G.doc_id, G.line_num, coalesce(lead(G.line_num) OVER (PARTITION BY G.doc_id ORDER BY G.line_num), T.n)::INT AS end_line FROM G JOIN T USING (doc_id) WHERE G.b""")
def chapter_spans(spark, d):
    f = segment.flagged(doc_lines(spark, d), segment.HEADING)
    size = F.max("line_num").over(Window.partitionBy("doc_id")) + 1
    marks = f.withColumn("n", size).filter("is_boundary")
    return marks.select("doc_id", "line_num", F.coalesce(F.lead("line_num").over(lines.by_line()), F.col("n")).alias("end_line"))


@query(f"""WITH RECURSIVE {SCORED}, T AS (SELECT * FROM (SELECT *, row_number() OVER {W} AS r FROM C WHERE confidence > 0.3::DOUBLE) WHERE r <= 1000), {_fold('T', 10)}, M AS (SELECT doc_id, line_num FROM R WHERE kept),
  Q2 AS (SELECT B.*, M.line_num IS NOT NULL AS b, sum((M.line_num IS NOT NULL)::INT) OVER (PARTITION BY B.doc_id ORDER BY B.line_num ROWS UNBOUNDED PRECEDING) AS seg FROM B LEFT JOIN M ON M.doc_id = B.doc_id AND M.line_num = B.line_num)
  SELECT doc_id, (seg - 1)::INT AS cid, min(line_num) AS line_num, arg_min(body, line_num) AS title, coalesce(string_agg(line, chr(10) ORDER BY line_num) FILTER (WHERE NOT b), '') AS body, max(line_num) + 1 AS end_line FROM Q2 WHERE seg > 0 GROUP BY doc_id, seg""")
def boundary_split(spark, d):
    rows = doc_lines(spark, d)
    return segment.split_at(rows, structure.candidates(rows))


@query(f"""WITH {POS}, M AS (SELECT *, regexp_matches({STRIP.format('line')}, '^.{{1,29}}$') AS b FROM P), A AS (SELECT doc_id, count(*) FILTER (WHERE b) AS matches, coalesce(max(byte_pos) FILTER (WHERE b), 0) AS last_pos, max(byte_pos + strlen(line)) AS size FROM M GROUP BY doc_id),
  Z AS (SELECT *, coalesce(last_pos::DOUBLE / nullif(size, 0), 0) AS coverage, size - last_pos AS tail FROM A) SELECT *, matches > 0 AND (coverage > 0.99::DOUBLE OR tail < 20000) AS ok FROM Z""")
def pattern_coverage(spark, d):
    return segment.coverage(segment.flagged(lines.with_offsets(doc_lines(spark, d)), segment.HEADING))


@query(f"""WITH {CHAP}, E AS (SELECT *, sum((length >= 100)::INT) OVER (PARTITION BY doc_id ORDER BY cid ROWS UNBOUNDED PRECEDING) AS grp FROM CH) SELECT doc_id, grp::BIGINT AS grp, arg_min(title, cid) AS title, count(*) AS merged, string_agg(body, chr(10) ORDER BY cid) AS body FROM E GROUP BY doc_id, grp""")
def short_chapter_merge(spark, d):
    return segment.merge_short(_chapters(spark, d))


@query(f"""WITH {CHAP}, E AS (SELECT doc_id, cid, CASE WHEN regexp_matches(lower(title), '작가의 말|작가 후기|후기') THEN '작가의 말' WHEN regexp_matches(lower(title), '에필로그|epilogue|후일담') THEN '에필로그' WHEN regexp_matches(lower(title), '외전|번외|특별편|side story') THEN '외전' ELSE '본편' END AS t FROM CH)
  SELECT doc_id, t AS chapter_type, count(*) AS n, (min(cid) + 1)::BIGINT AS first, (max(cid) + 1)::BIGINT AS last FROM E GROUP BY doc_id, t""")
def chapter_type_summary(spark, d):
    return _chapters(spark, d).withColumn("chapter_type", segment.chapter_type(F.col("title"))).groupBy("doc_id", "chapter_type").agg(F.count("*").alias("n"), (F.min("cid") + 1).cast("long").alias("first"), (F.max("cid") + 1).cast("long").alias("last"))


@query(f"""WITH {CHAP} SELECT doc_id, count(*) AS n, avg((length < 100)::INT) AS short_share, avg(length) AS mean_length, avg((length < 100)::INT) <= 0.1::DOUBLE AND avg(length) >= 500 AS ok FROM CH GROUP BY doc_id""")
def chapter_quality_check(spark, d):
    a = _chapters(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg((F.col("length") < 100).cast("int")).alias("short_share"), F.avg("length").alias("mean_length"))
    return a.withColumn("ok", (F.col("short_share") <= 0.1) & (F.col("mean_length") >= 500))


@query(f"""WITH {CHAP}, N AS (SELECT doc_id, count(*) + 3 AS upto FROM CH GROUP BY doc_id), E AS (SELECT doc_id, unnest(range(1, upto + 1)) AS n FROM N) SELECT E.doc_id, E.n FROM E WHERE NOT EXISTS (SELECT 1 FROM CH WHERE CH.doc_id = E.doc_id AND CH.cid * 2 + 1 = E.n)""")
def missing_episodes(spark, d):
    ch = _chapters(spark, d)
    return catalog.missing_numbers(ch.select("doc_id", (F.col("cid") * 2 + 1).cast("long").alias("n")), ch.groupBy("doc_id").agg((F.count("*") + 3).alias("upto")))


@query(f"""WITH {LB}, T AS (SELECT DISTINCT left({STRIP.format('text')}, 12) AS title FROM benchmark WHERE length({STRIP.format('text')}) > 0) SELECT doc_id, line_num FROM B WHERE body <> '' AND EXISTS (SELECT 1 FROM T WHERE contains(B.body, T.title))""")
def title_candidate_semijoin(spark, d):
    t = table(spark, d, "benchmark").select(F.substring(strip(F.col("text")), 1, 12).alias("title")).filter("title <> ''")
    return segment.holding(doc_lines(spark, d).withColumn("body", strip(F.col("line"))), t)


# --- boundaries ----------------------------------------------------------------------------------
MATCH = f"{POS}, M AS (SELECT doc_id, line_num, byte_pos AS pos FROM P WHERE regexp_matches({STRIP.format('line')}, '^.{{1,29}}$')), Z AS (SELECT doc_id, max(byte_pos + strlen(line)) AS size FROM P GROUP BY doc_id)"


def _matches(spark, d):
    rows = lines.with_offsets(doc_lines(spark, d))
    m = segment.flagged(rows, segment.HEADING).filter("is_boundary").select("doc_id", "line_num", F.col("byte_pos").alias("pos"))
    return m, rows.groupBy("doc_id").agg(F.max(F.col("byte_pos") + F.octet_length("line")).alias("size"))


_GAPS = """, E AS (SELECT doc_id, pos, 1 AS k FROM M UNION ALL SELECT doc_id, 0, 0 FROM Z UNION ALL SELECT doc_id, size, 2 FROM Z),
  V AS (SELECT *, lead(pos) OVER w AS nxt, lead(k) OVER w AS k2 FROM E WINDOW w AS (PARTITION BY doc_id ORDER BY k, pos)),
  X AS (SELECT V.doc_id, V.pos AS start, V.nxt AS "end", V.nxt - V.pos AS size FROM V JOIN Z USING (doc_id) WHERE nxt IS NOT NULL AND CASE WHEN k = 1 AND k2 = 1 THEN nxt - pos > {inner} ELSE nxt - pos > {edge} END)
  SELECT doc_id, start, "end", size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, start) AS r FROM X) WHERE r <= {most}"""


@query(f"WITH {MATCH}" + _GAPS.format(inner=1000, edge=500, most=5))
def fixed_gaps(spark, d):
    m, z = _matches(spark, d)
    return boundaries.gaps(m, z, F.lit(1000), F.lit(500), 5)


@query(f"WITH {MATCH}" + _GAPS.format(inner="greatest(1.5::DOUBLE * Z.size / 10, 500::DOUBLE)", edge="greatest(1.5::DOUBLE * Z.size / 10, 500::DOUBLE)", most=10))
def dynamic_gaps(spark, d):
    m, z = _matches(spark, d)
    least = F.greatest(F.lit(1.5) * F.col("_size") / 10, F.lit(500.0))
    return boundaries.gaps(m, z, least, least, 10)


@query(f"WITH {MATCH}, Y AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM M) SELECT doc_id, line_num, pos FROM Y WHERE b IS NULL OR pos - b >= 500")
def close_duplicate_removal(spark, d):
    return boundaries.drop_close(_matches(spark, d)[0])


def _anchor(distance: int, pos: str) -> str:
    return f"WITH {SCORED}, PP AS (SELECT doc_id, line_num, coalesce(sum(strlen(line) + 1) OVER {WB}, 0)::BIGINT AS byte_pos FROM L), CC AS (SELECT C.doc_id, C.line_num, byte_pos, confidence FROM C JOIN PP USING (doc_id, line_num)), A AS (SELECT * FROM CC WHERE confidence >= 0.45::DOUBLE) SELECT doc_id, line_num, byte_pos FROM CC WHERE confidence < 0.45::DOUBLE AND NOT EXISTS (SELECT 1 FROM A WHERE A.doc_id = CC.doc_id AND abs(A.{pos} - CC.{pos}) < {distance})"


def _scored_at(spark, d):
    return structure.scored_places(docs(spark, d)).drop("text")


def _sizes(spark, d):
    """doc_id and size: where the last line ends, in bytes."""
    return docs(spark, d).filter("text <> ''").select("doc_id", F.octet_length(F.regexp_replace("text", r"\n\z", "")).cast("long").alias("size"))


@query(_anchor(20, "line_num"))
def anchor_antijoin_lines(spark, d):
    return boundaries.without_near_marked(_scored_at(spark, d), F.col("confidence") >= 0.45, "line_num", 20).select("doc_id", "line_num", "byte_pos")


@query(_anchor(1000, "byte_pos"))
def anchor_antijoin_bytes(spark, d):
    return boundaries.without_near_marked(_scored_at(spark, d), F.col("confidence") >= 0.45, "byte_pos", 1000).select("doc_id", "line_num", "byte_pos")


@query(f"WITH {SCORED} SELECT C.doc_id, line_num, CASE WHEN quality IS NULL THEN confidence ELSE quality::DOUBLE * 0.7::DOUBLE + confidence * 0.3::DOUBLE END AS combined_score FROM C LEFT JOIN labels ON labels.doc_id = C.doc_id")
def combined_score(spark, d):
    q = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("ai_score"))
    return structure.scored_lines(doc_lines(spark, d)).join(q, "doc_id", "left").select("doc_id", "line_num", boundaries.combined_score(F.col("ai_score"), F.col("confidence")).alias("combined_score"))


@query(f"""WITH RECURSIVE {SCORED}, PP AS (SELECT doc_id, line_num, coalesce(sum(strlen(line) + 1) OVER {WB}, 0)::BIGINT AS byte_pos, strlen(line) AS n FROM L), Z AS (SELECT doc_id, max(byte_pos + n) AS size FROM PP GROUP BY doc_id),
  O AS (SELECT doc_id, byte_pos, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, byte_pos) AS rn, greatest(1000, floor(size / 5::DOUBLE * 0.3::DOUBLE))::BIGINT AS d FROM C JOIN PP USING (doc_id, line_num) JOIN Z USING (doc_id)),
  PH AS (SELECT doc_id, ph, CASE ph WHEN 1 THEN d WHEN 2 THEN floor(d * 0.5::DOUBLE)::BIGINT ELSE 500 END AS dd FROM (SELECT DISTINCT doc_id, d FROM O), (VALUES (1), (2), (3)) v(ph)),
  R AS (SELECT doc_id, ph, 0::BIGINT AS rn, []::BIGINT[] AS got FROM PH UNION ALL
  SELECT R.doc_id, R.ph, O.rn, CASE WHEN len(got) < 5 AND len(list_filter(got, lambda q: abs(q - O.byte_pos) < PH.dd)) = 0 THEN list_append(got, O.byte_pos) ELSE got END FROM R JOIN PH USING (doc_id, ph) JOIN O ON O.doc_id = R.doc_id AND O.rn = R.rn + 1),
  T AS (SELECT doc_id, ph, arg_max(got, rn) AS got FROM R GROUP BY doc_id, ph),
  U AS (SELECT doc_id, coalesce(max(CASE WHEN ph = 1 AND len(got) >= 5 THEN got END), max(CASE WHEN ph = 2 AND len(got) >= 5 THEN got END), max(CASE WHEN ph = 3 THEN got END)) AS got FROM T GROUP BY doc_id)
  SELECT doc_id, unnest(got) AS byte_pos FROM U""")
def global_optimizer(spark, d):
    c = _scored_at(spark, d).withColumnRenamed("confidence", "combined_score")
    return boundaries.select_boundaries(c, _sizes(spark, d), F.lit(5))


TOPIC = "T AS (SELECT doc_id, text, greatest(1, floor((length(text) - 2000) / 1500::DOUBLE) + 1)::INT AS n FROM documents WHERE length(text) > 0), TW AS (SELECT doc_id, unnest(range(least(n, 300)))::INT AS window_no, CASE WHEN n > 300 THEN floor((length(text) - 2000) / 299::DOUBLE) ELSE 1500 END::BIGINT AS step, text FROM T)"


@query(f"WITH {TOPIC} SELECT doc_id, window_no, window_no * step AS char_pos, substring(text, window_no * step + 1, 2000) AS text FROM TW")
def topic_windows(spark, d):
    return boundaries.topic_windows(docs(spark, d))


@query(f"""WITH {TOPIC}, X AS (SELECT doc_id, window_no, window_no * step AS begin_at, substring(text, window_no * step + 1, 2000) AS t FROM TW), Y AS (SELECT *, string_split(t, chr(10)) AS a, nullif(regexp_extract(t, '\\n[{S}]*\\n'), '') AS gap FROM X),
  Z AS (SELECT *, list_min(list_filter(range(2, len(a)), lambda i: length({STRIP.format('a[i]')}) < 50)) AS short FROM Y)
  SELECT doc_id, window_no, begin_at + CASE WHEN gap IS NOT NULL THEN instr(t, gap) - 1 WHEN short IS NOT NULL THEN length(array_to_string(a[1:short - 1], chr(10))) + 1 ELSE 0 END AS boundary FROM Z""")
def topic_boundary_point(spark, d):
    w = boundaries.topic_windows(docs(spark, d))
    return w.select("doc_id", "window_no", (F.col("char_pos") + boundaries.window_boundary(F.col("text"))).alias("boundary"))


@query("""WITH C AS (SELECT user_id, count(*) AS n, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id) SELECT user_id, n, CASE WHEN len(v) < 3 THEN false ELSE list_max(v[-3:]) - list_min(v[-3:]) <= 2 END AS stagnant FROM C""")
def stagnation(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    # no more than the last three of a user are gathered
    last = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).filter("r <= 3")
    v = last.groupBy("user_id").agg(F.collect_list("value").alias("v"))
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return n.join(v, "user_id").select("user_id", "n", boundaries.stagnant(F.col("v")).alias("stagnant"))


@query("SELECT source, lang, count(*) AS votes FROM documents GROUP BY source, lang HAVING count(*) >= 2")
def consensus_vote(spark, d):
    return docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("votes")).filter("votes >= 2")


# --- files and duplicates ------------------------------------------------------------------------
FILES = "FI AS (SELECT doc_id AS id, concat('#', source, '_', doc_id, '(1~', 1 + doc_id % 400, '.연재).txt') AS file_name, concat('/in/', source, '/', lpad(doc_id::VARCHAR, 9, '0'), '.txt') AS file_path, md5(coalesce(text, '')) AS file_hash, strlen(coalesce(text, '')) AS file_size, doc_id % 7 AS novel_id, lang FROM documents)"
FLAGS = f"{FILES}, FF AS (SELECT file_hash, arg_min(id, file_path) AS first FROM FI GROUP BY file_hash), FX AS (SELECT FI.*, (id <> first)::INT AS is_duplicate, CASE WHEN id <> first THEN first END AS duplicate_of FROM FI JOIN FF USING (file_hash))"
STATE = "ST AS (SELECT doc_id AS file_id, 1 AS stage0, (doc_id % 3 > 0)::INT AS stage1, (doc_id % 4 = 0)::INT AS stage2, (doc_id % 5 = 0)::INT AS stage3, (doc_id % 2)::INT AS stage4, (doc_id % 10 = 0)::INT AS stage5, CASE WHEN doc_id % 97 = 0 THEN 'failed' END AS last_error FROM documents)"
NOVELS = "NV AS (SELECT k AS novel_key, concat('작품 ', k) AS title, CASE WHEN k % 2 = 0 THEN concat('작가', k) END AS author FROM (SELECT DISTINCT doc_id % 7 AS k FROM documents) WHERE k < 6)"


def files(spark, d):
    text = F.coalesce("text", F.lit(""))
    return docs(spark, d).select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("#"), "source", F.lit("_"), "doc_id", F.lit("(1~"), 1 + F.col("doc_id") % 400, F.lit(".연재).txt")).alias("file_name"),
        F.concat(F.lit("/in/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("file_path"),
        F.md5(text).alias("file_hash"), F.octet_length(text).cast("long").alias("file_size"), (F.col("doc_id") % 7).alias("novel_id"), "lang",
    )


def flagged_files(spark, d):
    f = files(spark, d)
    return f.join(dedup.duplicate_flags(f).drop("file_path"), "id")


def state(spark, d):
    i = F.col("doc_id")
    flag = lambda c: c.cast("int")
    return docs(spark, d).select(i.alias("file_id"), F.lit(1).alias("stage0"), flag(i % 3 > 0).alias("stage1"), flag(i % 4 == 0).alias("stage2"), flag(i % 5 == 0).alias("stage3"), flag(i % 2).alias("stage4"), flag(i % 10 == 0).alias("stage5"), F.when(i % 97 == 0, "failed").alias("last_error"))


def novels(spark, d):
    """The works that files name by novel_id, but for one that the catalogue has not."""
    k = F.col("novel_key")
    return docs(spark, d).select((F.col("doc_id") % 7).alias("novel_key")).distinct().filter("novel_key < 6").select(k.alias("novel_key"), F.concat(F.lit("작품 "), k).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("작가"), k)).alias("author"))


@query(f"WITH {FILES} SELECT id, file_path, file_size FROM FI WHERE file_size >= 512")
def size_filter(spark, d):
    return files(spark, d).filter("file_size >= 512").select("id", "file_path", "file_size")


@query(f"WITH {FILES} SELECT file_hash, count(*) AS copies, min(file_path) AS original FROM FI GROUP BY file_hash HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return dedup.duplicate_groups(files(spark, d))


@query(f"WITH {FLAGS} SELECT id, file_path, is_duplicate, coalesce(duplicate_of, -1) AS duplicate_of FROM FX")
def duplicate_flags(spark, d):
    return dedup.duplicate_flags(files(spark, d)).withColumn("duplicate_of", F.coalesce("duplicate_of", F.lit(-1)))


@query(f"WITH {FLAGS} SELECT id, file_hash FROM FX WHERE is_duplicate = 0")
def purge_duplicates(spark, d):
    return flagged_files(spark, d).filter("is_duplicate = 0").select("id", "file_hash")


@query(f"WITH {LB} SELECT body, doc_id, line_num FROM B WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, line_num) = 1")
def ordered_distinct(spark, d):
    rows = doc_lines(spark, d).select(strip(F.col("line")).alias("body"), F.struct("doc_id", "line_num").alias("place")).filter("body <> ''")
    return dedup.ordered_distinct(rows, "body", "place").select("body", "place.doc_id", "place.line_num")


@query("SELECT doc_id AS id, concat(source, '_', lang) AS name, CASE WHEN n = 0 THEN concat(source, '_', lang) ELSE concat(source, '_', lang, '-', CASE WHEN n < 10 THEN '0' ELSE '' END, n) END AS final_name FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS n FROM documents)")
def name_collision_suffix(spark, d):
    return dedup.collision_suffix(docs(spark, d).select(F.col("doc_id").alias("id"), F.concat_ws("_", "source", "lang").alias("name")))


@query(f"WITH {FLAGS} SELECT count(*) AS total, sum(is_duplicate)::BIGINT AS duplicates, sum(file_size)::BIGINT AS bytes FROM FX")
def file_stats(spark, d):
    return flagged_files(spark, d).agg(F.count("*").alias("total"), F.sum("is_duplicate").alias("duplicates"), F.sum("file_size").alias("bytes"))


@query(f"WITH {STATE} SELECT count(*) AS total, " + ", ".join(f"sum(stage{k})::BIGINT AS stage{k}" for k in range(6)) + ", count(*) FILTER (WHERE last_error IS NOT NULL) AS errors FROM ST")
def stage_completion(spark, d):
    return catalog.stage_completion(state(spark, d), [f"stage{k}" for k in range(6)])


PENDING = {
    "pending_metadata": "stage0 = 1 AND stage1 = 0",
    "pending_verify": "stage4 = 1 AND stage2 = 0",
    "pending_rename": "stage1 = 1 AND stage3 = 0",
    "pending_split": "stage1 = 1 AND stage4 IN (0, 1)",
    "pending_epub": "stage3 = 1 AND stage5 = 0",
}
for _name, _ready in PENDING.items():

    def _pending(spark, d, ready=_ready):
        return catalog.pending(flagged_files(spark, d), state(spark, d), F.expr(ready), ["id", "file_name"])

    _pending.__name__ = _name
    query(f"WITH {FLAGS}, {STATE} SELECT id, file_name FROM FX JOIN ST ON id = file_id WHERE {_ready} AND is_duplicate = 0")(_pending)


@query(f"WITH {FILES}, {STATE}, {NOVELS} SELECT id, file_name, title, author, stage5 FROM FI LEFT JOIN NV ON novel_id = novel_key LEFT JOIN ST ON id = file_id WHERE contains(file_name, 'src1') OR coalesce(contains(title, 'src1'), false) OR coalesce(contains(author, 'src1'), false) ORDER BY id DESC LIMIT 15 OFFSET 15")
def catalog_search_page(spark, d):
    return catalog.search(files(spark, d), novels(spark, d), state(spark, d), "src1", page=1).select("id", "file_name", "title", "author", "stage5")


# --- titles and names ----------------------------------------------------------------------------
NAME = "file_name"
CLEAN = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({NAME}, '(?i)\\.(txt|epub|pdf|doc|docx)$', ''), '^#+[{S}]*', ''), '\\([^)]*(?:[0-9]+[~\\-][0-9]+|[0-9]+화|완결|연재|휴재)[^)]*\\)', '', 'g'), '\\([{S}]*\\)', '', 'g')"""


@query(f"WITH {FILES} SELECT id, {STRIP.format(f'''regexp_replace(replace({CLEAN}, '_', ' '), '[{S}]+', ' ', 'g')''')} AS title FROM FI")
def clean_search_title(spark, d):
    return files(spark, d).select("id", titles.clean_search_title(F.col("file_name")).alias("title"))


@query(f"WITH {FILES} SELECT id, coalesce(try_cast(nullif(regexp_extract(file_name, '([0-9]+)[~-]([0-9]+)', 2), '') AS BIGINT), try_cast(nullif(regexp_extract(file_name, '([0-9]+)', 1), '') AS BIGINT)) AS episodes FROM FI")
def episode_range_numeric(spark, d):
    return files(spark, d).select("id", titles.episode_range_numeric(F.col("file_name")).alias("episodes"))


@query(f"WITH {FILES} SELECT id, CASE WHEN id % 2 = 0 THEN concat('1~', 1 + id % 400, '화') ELSE concat('1~', id % 50, '화') END AS hint FROM FI")
def filename_hint(spark, d):
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("가(1~"), 1 + F.col("id") % 400, F.lit(").txt"))).otherwise(F.concat(F.lit("나("), F.col("id") % 50, F.lit(").txt")))
    return files(spark, d).select("id", titles.filename_hint(name).alias("hint"))


@query(f"WITH {FILES} SELECT id, coalesce(try_cast(nullif(regexp_extract(file_name, '(?:~|-)([0-9]+)(?:화|회)?', 1), '') AS BIGINT), 0) AS strict, coalesce(try_cast(nullif(regexp_extract(file_name, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT), 0) AS loose FROM FI")
def expected_count(spark, d):
    n = F.col("file_name")
    return files(spark, d).select("id", titles.expected_count_strict(n).alias("strict"), titles.expected_count_loose(n).alias("loose"))


@query(f"WITH {FILES}, X AS (SELECT id, {STRIP.format('''regexp_replace(regexp_replace(file_name, '\\[.*?\\]|\\(.*?\\)|【.*?】', '', 'g'), '_[0-9]+$', '')''')} AS t FROM FI) SELECT id, t AS title FROM X")
def normalize_title(spark, d):
    return files(spark, d).select("id", titles.normalize_title(F.col("file_name")).alias("title"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN '완결,x,y' WHEN 'fr' THEN 'a,b' ELSE '19금,성인,z' END AS tags FROM documents")
def format_tags(spark, d):
    given = F.when(F.col("lang") == "en", F.split(F.lit("x,y,완결,w"), ",")).when(F.col("lang") == "fr", F.split(F.lit("a,b"), ",")).otherwise(F.split(F.lit("z,19금,성인"), ","))
    return docs(spark, d).select("doc_id", titles.format_tags(given).alias("tags"))


# what a record may hold, from the columns of orders: every branch of the rule is met
_RECORD = {
    "name": "CASE o_orderkey % 4 WHEN 0 THEN concat('가(1~', o_orderkey % 300, ').txt') WHEN 1 THEN concat('나(', o_orderkey % 50, ').txt') ELSE '다.txt' END",
    "title": "CASE o_orderkey % 3 WHEN 0 THEN concat('[출판] 제목 ', o_orderkey, ' (완결)') WHEN 1 THEN concat('책:  ', o_orderkey, '_12') ELSE concat(repeat('긴', 26 + o_custkey % 9), o_orderkey, ' 완결') END",
    "span": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '1~100화' WHEN 3 THEN concat('1~', o_custkey % 120, '화') ELSE 'Unknown' END",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN '연재중' ELSE NULL END",
    "chapters": "CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 120 END",
    "genre": "CASE o_custkey % 5 WHEN 0 THEN 'fantasy' WHEN 1 THEN '로맨스' WHEN 2 THEN 'Unknown' WHEN 3 THEN NULL ELSE 'x y' END",
    "author": "CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('작가: 김', o_custkey % 10) WHEN 2 THEN '' ELSE concat(repeat('저', o_custkey % 13), '/', o_custkey) END",
}
_FILE_TAGS = ["x,완결", "a,b,c,19금", None]
_LOOSE = "coalesce(try_cast(nullif(regexp_extract({}, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT), 0)"


def _cut(text: str, size: int) -> str:
    return f"left({text}, list_max(list_filter(range({size} + 1), lambda k: strlen(left({text}, k)) <= {size})))"


def _case(c: str, values: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {c} END"


@query(f"""WITH A AS (SELECT o_orderkey, {", ".join(f"{v} AS {k}" for k, v in _RECORD.items())}, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 5000) / 1000::DOUBLE END AS rating, CASE o_orderkey % 3 WHEN 0 THEN string_split('{_FILE_TAGS[0]}', ',') WHEN 1 THEN string_split('{_FILE_TAGS[1]}', ',') END AS tags FROM orders),
  B AS (SELECT *, CASE WHEN regexp_matches(name, '\\([0-9]+~[0-9]+\\)') THEN concat(regexp_extract(name, '\\(([0-9]+~[0-9]+)\\)', 1), '화') WHEN regexp_matches(name, '\\([0-9]+\\)') THEN concat('1~', regexp_extract(name, '\\(([0-9]+)\\)', 1), '화') END AS hint, {_LOOSE.format('span')} AS web,
    {STRIP.format("regexp_replace(title, '\\[.*?\\]|\\(.*?\\)|【.*?】', '', 'g')")} AS t0 FROM A),
  C AS (SELECT *, coalesce(hint, CASE WHEN chapters > 0 THEN concat('1~', chapters, '화') END, span) AS shown, coalesce(nullif(chapters, 0), CASE WHEN hint IS NOT NULL THEN {_LOOSE.format('hint')} END, 0) AS real, {STRIP.format(f"regexp_replace(regexp_replace(regexp_replace(t0, '_[0-9]+$', ''), '[{S}]+완결$', ''), '[{S}]+', ' ', 'g')")} AS t1, {STRIP.format(f"regexp_replace(author, '(?:작가|저자):[{S}]*', '', 'g')")} AS a1 FROM B),
  D AS (SELECT *, CASE WHEN web > 0 AND real > 0 AND web <> real THEN concat_ws('_', nullif(status, ''), concat('부분(', real, '_', web, '화)')) ELSE status END AS told FROM C),
  E AS (SELECT o_orderkey, [{_cut('t1', titles.TITLE_BYTES)}, concat_ws('_', coalesce(nullif(shown, ''), '단편'), nullif({_case('told', titles.STATUS)}, '')), CASE WHEN rating IS NOT NULL THEN concat('★', printf('%.1f', rating)) END,
    CASE WHEN coalesce(genre, '') = '' THEN '기타' ELSE {_case('genre', titles.GENRES)} END, CASE WHEN coalesce(author, '') = '' THEN '작가미상' ELSE {_cut('a1', titles.AUTHOR_BYTES)} END,
    nullif(array_to_string(list_concat(list_filter(tags, lambda x: x IN ('19금', '성인', '완결', '베스트')), list_filter(tags, lambda x: x NOT IN ('19금', '성인', '완결', '베스트')))[:3], ','), '')] AS f FROM D),
  G AS (SELECT o_orderkey, translate(array_to_string(list_filter(f, lambda x: x IS NOT NULL AND {STRIP.format('x')} <> '' AND NOT contains(x, 'Unknown')), '__'), '<>:"/\\|?*', '_________') AS n FROM E)
  SELECT o_orderkey, concat({_cut('n', titles.NAME_BYTES - 5)}, '.txt') AS name FROM G""")
def generate_filename(spark, d):
    k = F.col("o_orderkey")
    tags = F.when(k % 3 == 0, F.split(F.lit(_FILE_TAGS[0]), ",")).when(k % 3 == 1, F.split(F.lit(_FILE_TAGS[1]), ","))
    given = table(spark, d, "orders").select("o_orderkey", *[F.expr(v).alias(c) for c, v in _RECORD.items()], F.when(k % 7 > 0, (k % 5000) / 1000.0).alias("rating"), tags.alias("tags"))
    return titles.with_filename(given, F.lit(".txt")).select("o_orderkey", F.col("file_name").alias("name"))


@query("SELECT p_partkey, replace(replace(concat(replace(replace(p_name, ', ', '_'), ',', '_'), '_에필'), '_-_', '-'), '__', '_') AS name FROM part")
def postprocess_name(spark, d):
    return table(spark, d, "part").select("p_partkey", titles.postprocess_name(F.concat("p_name", F.lit(", 에필로그"))).alias("name"))


_ENDS = ["'끝'", "' (完)'", "'의 시작'", "' - fin>'", "''"]


@query(f"WITH {L}, E AS (SELECT doc_id, line_num, concat(line, CASE line_num % 5 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_ENDS)) + f" END) AS line FROM L) SELECT doc_id, line_num FROM E WHERE regexp_matches({STRIP.format('line')}, '(?:끝|완|END|end|fin|Fin|종료|끗|完)[{S}]*[>】\\])]*[{S}]*$')")
def end_markers(spark, d):
    """Lines of documents, of which every fifth gets each of five endings (three of them end marks)."""
    ending = F.expr("case line_num % 5 " + " ".join(f"when {k} then {x}" for k, x in enumerate(_ENDS)) + " end")
    return doc_lines(spark, d).withColumn("line", F.concat("line", ending)).filter(titles.is_end_marker(strip(F.col("line")))).select("doc_id", "line_num")


@query("WITH X AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat('é中', left(text, 3), '🎉ß', text) ELSE concat(left(text, 2), '한글', text) END AS t FROM documents) SELECT doc_id, left(t, list_max(list_filter(range(13), lambda k: strlen(left(t, k)) <= 12))) AS head FROM X")
def byte_safe_truncate(spark, d):
    """12 bytes of every text; two thirds of them begin with letters of two to four bytes that the limit cuts."""
    given = F.expr("case doc_id % 3 when 0 then text when 1 then concat('é中', substring(text, 1, 3), '🎉ß', text) else concat(substring(text, 1, 2), '한글', text) end")
    return docs(spark, d).select("doc_id", byte_truncate(given, 12).alias("head"))


# --- merge ---------------------------------------------------------------------------------------
def _platform(c: str) -> str:
    return f"CASE {c} % 4 WHEN 0 THEN '노벨피아' WHEN 1 THEN '리디' WHEN 2 THEN '조아라' ELSE 'other' END"


PRIORITY = "CASE {0} % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 6 ELSE 900 END"


@query(f"SELECT o_orderkey, {PRIORITY.format('o_custkey')} AS priority FROM orders")
def platform_priority(spark, d):
    return table(spark, d, "orders").select("o_orderkey", merge.platform_priority(F.expr(_platform("o_custkey"))).alias("priority"))


def _record(k: str, day: str, letter: str) -> dict[str, str]:
    """A varied record from a number and a date, in SQL that Spark and DuckDB share."""
    return {
        "title": f"CASE {k} % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('#{letter}', {k}) ELSE concat('{letter}', {k}) END",
        "author": f"CASE {k} % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('작가', {k} % 3) END",
        "genre": f"CASE {k} % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'g2,g1 , g2' WHEN 3 THEN '성인물' ELSE concat('g', {k} % 4) END",
        "status": f"CASE {k} % 5 WHEN 0 THEN NULL WHEN 1 THEN '완결(외전)' WHEN 2 THEN '' ELSE '연재' END",
        "episode_range": f"CASE {k} % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '외전' WHEN 3 THEN '0화' ELSE concat('1~', {k} % 10, '화') END",
        "platform": f"CASE {k} % 8 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE {_platform(k)} END",
        "rating": f"CASE {k} % 6 WHEN 0 THEN NULL WHEN 1 THEN 0e0 WHEN 2 THEN -1e0 ELSE ({k} % 20) / 16e0 END",
        "cover_url": f"CASE {k} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('http://{letter}/', {k}) END",
        "last_updated": f"CASE {k} % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE {day} END",
        "official_url": f"CASE {k} % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('http://{letter}.org/', {k}) END",
    }


_TAGS = "CASE {0} % 6 WHEN 0 THEN NULL WHEN 1 THEN {1}() WHEN 2 THEN {1}('19금', 'a') WHEN 3 THEN {1}('b', '성인소설') ELSE {1}(concat('t', {0} % 5), 'a') END"
_MERGE = ("SELECT o_orderkey, " + ", ".join(f"{v} AS {p}_{f}" for p, k, day in (("b", "(o_custkey % 1000)", "strftime(o_orderdate, '%Y-%m-%d')"), ("e", "(o_orderkey % 1000)", "strftime(o_orderdate + to_days((o_orderkey % 5 - 2)::INT), '%Y-%m-%d')")) for f, v in (_record(k, day, p) | {"tags": _TAGS.format(k, "list_value")}).items()) + " FROM orders")
_NUM = "nullif(coalesce(try_cast(nullif(regexp_extract({0}, '([0-9]+)[~-]([0-9]+)', 2), '') AS BIGINT), try_cast(nullif(regexp_extract({0}, '([0-9]+)', 1), '') AS BIGINT)), 0)"
_PRIO = "CASE WHEN coalesce({0}, '') = '' THEN 999 " + " ".join(f"WHEN contains({{0}}, '{p}') THEN {i}" for i, p in enumerate(merge.PLATFORMS)) + " ELSE 900 END"
_FLAT = "array_to_string(list_sort({0}), ',')"


@query(f"""WITH X AS ({_MERGE}), Y AS (SELECT *, {_PRIO.format('e_platform')} < {_PRIO.format('b_platform')} AS better, coalesce(e_last_updated, '') <> '' AND (coalesce(b_last_updated, '') = '' OR e_last_updated > b_last_updated) AS newer, {_NUM.format('b_episode_range')} AS br, {_NUM.format('e_episode_range')} AS er,
  CASE WHEN coalesce(e_genre, '') = '' OR b_genre = e_genre THEN b_genre WHEN coalesce(b_genre, '') = '' THEN e_genre ELSE array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(concat(b_genre, ',', e_genre), ','), lambda x: trim(x)), lambda x: x <> ''))), ', ') END AS genre0,
  coalesce(len(e_tags), 0) > 0 AS tagged, list_distinct(list_concat(coalesce(b_tags, list_value()), coalesce(e_tags, list_value()))) AS all_tags FROM X),
  Z AS (SELECT *, tagged AND regexp_matches(array_to_string(all_tags, ' '), '{"|".join(merge.ADULT)}') AS adult FROM Y)
  SELECT o_orderkey, CASE WHEN coalesce(e_title, '') <> '' AND (better OR newer OR coalesce(starts_with(b_title, '#'), false)) THEN e_title ELSE b_title END AS title,
  CASE WHEN coalesce(e_author, '') <> '' AND (coalesce(b_author, '') = '' OR better OR newer) THEN e_author ELSE b_author END AS author,
  CASE WHEN NOT adult THEN genre0 WHEN coalesce(genre0, '') = '' THEN '성인물' WHEN contains(genre0, '성인물') THEN genre0 ELSE concat('성인물, ', genre0) END AS genre,
  CASE WHEN coalesce(e_status, '') = '' THEN b_status WHEN contains(e_status, '완결') OR coalesce(contains(b_status, '완결'), false) THEN '완결' WHEN coalesce(b_status, '') = '' OR newer THEN e_status ELSE b_status END AS status,
  CASE WHEN coalesce(e_episode_range, '') = '' THEN b_episode_range WHEN br IS NOT NULL AND er IS NOT NULL THEN CASE WHEN er > br OR (er = br AND newer) THEN e_episode_range ELSE b_episode_range END WHEN coalesce(b_episode_range, '') = '' OR newer THEN e_episode_range ELSE b_episode_range END AS episode_range,
  CASE WHEN newer THEN e_last_updated ELSE b_last_updated END AS last_updated, CASE WHEN better THEN e_platform ELSE b_platform END AS platform,
  CASE WHEN e_rating > 0 AND (coalesce(b_rating, 0) = 0 OR e_rating > b_rating OR (newer AND abs(e_rating - b_rating) < 0.1::DOUBLE)) THEN e_rating ELSE b_rating END AS rating,
  CASE WHEN coalesce(e_cover_url, '') <> '' AND (coalesce(b_cover_url, '') = '' OR better OR newer) THEN e_cover_url ELSE b_cover_url END AS cover_url,
  CASE WHEN tagged THEN {_FLAT.format('all_tags')} ELSE {_FLAT.format('b_tags')} END AS tags,
  CASE WHEN coalesce(e_official_url, '') <> '' AND coalesce(b_official_url, '') = '' THEN e_official_url ELSE b_official_url END AS official_url FROM Z""")
def merge_metadata(spark, d):
    def record(k: str, day: str, letter: str) -> str:
        fields = _record(k, day, letter) | {"tags": f"cast({_TAGS.format(k, 'array')} as array<string>)"}
        return "named_struct(" + ", ".join(f"'{f}', {v}" for f, v in fields.items()) + ")"

    o = table(spark, d, "orders").selectExpr("o_orderkey", record("(o_custkey % 1000)", "date_format(o_orderdate, 'yyyy-MM-dd')", "b") + " as base", record("(o_orderkey % 1000)", "date_format(date_add(o_orderdate, cast(o_orderkey % 5 - 2 as int)), 'yyyy-MM-dd')", "e") + " as extra")
    return merge.merge_metadata(o).withColumn("tags", F.array_join(F.array_sort("tags"), ","))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([lang, source, 'x']))[1:15], ',') AS tags FROM documents")
def tag_union(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(merge.tag_union(F.array("lang", F.lit("x")), F.array("source", F.lit("x"))), ",").alias("tags"))


@query(r"SELECT page_id, CASE WHEN NOT regexp_matches(lower(url), '\.svg|\.ico|logo|icon|default|mark') THEN url END AS cover_url FROM pages")
def cover_url_filter(spark, d):
    return table(spark, d, "pages").select("page_id", merge.cover_url(F.col("url")).alias("cover_url"))


@query(r"SELECT page_id, regexp_matches(url, 'novelpia\.com|series\.naver\.com|ridibooks\.com|novel\.naver\.com|page\.kakao\.com|munpia\.com|joara\.com') AS hit FROM pages")
def priority_domain_filter(spark, d):
    return table(spark, d, "pages").select("page_id", merge.in_priority_domain(F.col("url")).alias("hit"))


# --- pages and quality ---------------------------------------------------------------------------
@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", quality.strip_tags(F.col("html")).alias("text"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<(?:h1|h2|title)[^>]*>(.*?)</(?:h1|h2|title)>', 1), '<[^>]*>', '', 'g')), ''), url) AS heading FROM pages")
def html_heading(spark, d):
    return table(spark, d, "pages").select("page_id", quality.heading(F.col("html"), F.col("url")).alias("heading"))


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), 'cover|nav|toc|titlepage|metadata') AND (length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) >= 50 OR contains(lower(html), '<img'))")
def epub_chapter_filter(spark, d):
    return readers.chapters_only(table(spark, d, "pages").withColumnRenamed("url", "name")).select("page_id")


@query("WITH E AS (SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents) SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: concat('<p>', x, '</p>')), chr(10)) AS html FROM E")
def paragraph_html(spark, d):
    return docs(spark, d).select("doc_id", quality.paragraphs(F.col("text")).alias("html"))


@query("SELECT conv_id, string_agg(text, '<hr>' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def spine_concat(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "<hr>").alias("body"))


COUNTS = f"""CO AS (SELECT doc_id, lang, text, len(regexp_extract_all(b, '[{CJK}]')) AS cjk, len(regexp_extract_all(b, '[a-zA-Z0-9]')) AS latin, len(regexp_extract_all(b, '[{quality.CJK_MARKS}]')) AS cjk_marks, len(regexp_extract_all(b, '[!-/:-@\\[-`{{-~]')) AS ascii_marks, length(b) AS total, length(text) AS original FROM (SELECT *, regexp_replace(text, '[{S}]+', '', 'g') AS b FROM documents))"""


@query(f"WITH {COUNTS} SELECT doc_id, cjk, latin, cjk_marks, ascii_marks, total, original FROM CO")
def char_class_counts(spark, d):
    return quality.char_counts(docs(spark, d), F.col("text")).select("doc_id", "cjk", "latin", "cjk_marks", "ascii_marks", "total", "original")


@query(f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR len(regexp_extract_all(text, '[{CJK}]')) > len(regexp_extract_all(text, '[a-zA-Z]')) * 0.5 OR len(regexp_extract_all(text, '[章节卷回部篇]')) > len(regexp_extract_all(lower(text), 'chapter|section|part|volume')) THEN 'chinese' ELSE 'english' END AS language FROM documents")
def language_detect_a(spark, d):
    return docs(spark, d).select("doc_id", quality.language_by_cues(F.col("text")).alias("language"))


@query(f"WITH {COUNTS} SELECT doc_id, CASE WHEN cjk::DOUBLE / nullif(cjk + latin, 0) > 0.3::DOUBLE THEN 'chinese' ELSE 'english' END AS language FROM CO")
def language_detect_b(spark, d):
    return quality.char_counts(docs(spark, d), F.col("text")).select("doc_id", quality.language_by_share(F.col("cjk"), F.col("latin")).alias("language"))


@query(f"WITH {COUNTS}, R AS (SELECT doc_id, coalesce((original - total) * 100::DOUBLE / nullif(original, 0), 0) AS rate FROM CO) SELECT doc_id, rate, CASE WHEN rate <= 0.5::DOUBLE THEN 'none' WHEN rate <= 1 THEN 'low' WHEN rate <= 2 THEN 'medium' ELSE 'high' END AS band FROM R")
def loss_rate(spark, d):
    c = quality.char_counts(docs(spark, d), F.col("text")).withColumn("rate", quality.loss_rate(F.col("original"), F.col("total")))
    return c.select("doc_id", "rate", quality.concern(F.col("rate")).alias("band"))


@query(f"WITH {COUNTS} SELECT doc_id, ((total > 100)::INT + (latin > 0)::INT + (original < 20000)::INT + (ascii_marks > 0)::INT) AS passed, (4 - ((total > 100)::INT + (latin > 0)::INT + (original < 20000)::INT + (ascii_marks > 0)::INT)) AS failed FROM CO")
def verifier_tally(spark, d):
    c = quality.char_counts(docs(spark, d), F.col("text"))
    checks = [F.col("total") > 100, F.col("latin") > 0, F.col("original") < 20_000, F.col("ascii_marks") > 0]
    passed = sum((x.cast("int") for x in checks[1:]), checks[0].cast("int"))
    return c.select("doc_id", passed.alias("passed"), (4 - passed).alias("failed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('978', lpad(p_partkey::VARCHAR, 10, '0')) WHEN p_partkey % 3 = 1 THEN concat(lpad(p_partkey::VARCHAR, 9, '0'), 'X') END AS isbn FROM part")
def isbn_extract(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("978-"), F.lpad(k.cast("string"), 10, "0"))).when(k % 3 == 1, F.concat(F.lit("ISBN:"), F.lpad(k.cast("string"), 9, "0"), F.lit("-x"))).otherwise(F.concat(F.lit("no "), k))
    return table(spark, d, "part").select("p_partkey", quality.isbn(raw).alias("isbn"))


def sample_sql(source: str, chunk: int, parts: int) -> str:
    return f"""WITH X AS (SELECT doc_id, text, floor(length(text) / {parts}::DOUBLE)::INT AS step FROM {source}) SELECT doc_id, CASE WHEN length(text) <= {chunk * parts} THEN text ELSE array_to_string(list_transform(range({parts}), lambda i: CASE WHEN i = 0 THEN substring(text, 1, {chunk}) ELSE regexp_replace(substring(text, i * step + 1, {chunk}), '(?s)^[^\\n]*\\n', '') END), concat(chr(10), '[...SAMPLE_SKIP...]', chr(10))) END AS sample FROM X"""


@query(sample_sql("documents", 32_768, 30))
def sample_chunks(spark, d):
    return docs(spark, d).select("doc_id", readers.sample_chunks(F.col("text")).alias("sample"))


@query()
def epub_from_chapters(spark, d):
    """Rows only: e-book bytes of each document's chapters."""
    made = epub_sink.epubs(_chapters(spark, d))
    return made.select("doc_id", "chapters", F.length("epub").alias("bytes"), F.sha2("epub", 256).alias("sha256"))
