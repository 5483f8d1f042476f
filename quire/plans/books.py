"""Queries of book structure: contents tables, volumes to sections, titles, patterns, reports.

The tables have no books, so each document is made into one: its sentences become lines, with volume,
chapter and section headings at fixed places (Chinese in every second document), and a list of
contents before two in three.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SPACE, strip
from ..operators import boundaries, escalate, headings, hierarchy, lines, patterns, quality, reports, segment, toc
from .core import CJK, SCORED, STRIP, TABLE_SQL, W, WB, _fold, doc_lines, docs, query, table

S, NL = SPACE, "\n"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- books made of documents, in both dialects ---------------------------------------------------
def _heading(div: str) -> str:
    made = f"""CASE WHEN doc_id % 2 = 1 THEN CASE WHEN i % 60 = 30 THEN concat('第', i {div} 60 % 2 + 1, '卷 甲{NL}') WHEN i % 12 = 6 THEN concat('{NL}第', i {div} 12 + 1, '章', CASE WHEN i % 24 = 6 THEN ' 故事' ELSE '' END, '{NL}') WHEN i % 24 IN (9, 11) THEN concat('第', i {div} 24 % 2 + 1, '节{NL}') ELSE '' END
    ELSE CASE WHEN i % 60 = 30 THEN concat('Part ', i {div} 60 % 2 + 1, ': Hills{NL}') WHEN i % 12 = 6 THEN concat('{NL}Chapter ', i {div} 12 + 1, CASE WHEN i % 24 = 6 THEN ': A tale' ELSE '' END, '{NL}') WHEN i % 24 = 9 THEN concat('Section ', i {div} 24 + 1, '{NL}') WHEN i % 36 = 20 THEN concat('1.', i, ' Sea{NL}') ELSE '' END END"""
    return made.replace("END\n    ELSE", "END ELSE")


_LIST = "".join(f"Chapter {i}: Start {10 * i}\n" for i in range(1, 8)) + "\n"
_ZH_LIST = "".join(f"第{i}章 起点 {10 * i}\n" for i in range(1, 8)) + "\n"
_FRONT = f"CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 1 THEN '【目录】{NL}{_ZH_LIST}' ELSE '--- Contents ---{NL}{_LIST}' END WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 1 THEN {q(_ZH_LIST)} ELSE {q(_LIST)} END ELSE '' END"
_LANGUAGE = "CASE WHEN coalesce(text, '') = '' OR len(regexp_extract_all(text, '[{CJK}]')) > len(regexp_extract_all(text, '[a-zA-Z]')) * 0.5 OR len(regexp_extract_all(text, '[章节卷回部篇]')) > len(regexp_extract_all(lower(text), 'chapter|section|part|volume')) THEN 'chinese' ELSE 'english' END".replace("{CJK}", CJK)
BOOKS = f"""BP AS (SELECT doc_id, string_split(replace(replace(text, chr(10), ' '), '. ', concat('.', chr(10))), chr(10)) AS p FROM documents),
  BT AS (SELECT doc_id, CASE WHEN p IS NOT NULL THEN concat({_FRONT}, array_to_string(list_transform(range(len(p)), lambda i: concat({_heading('//')}, p[i + 1])), chr(10))) END AS text FROM BP),
  BK AS (SELECT doc_id, text, {_LANGUAGE} AS language FROM BT)"""


def books(spark, d):
    made = docs(spark, d).selectExpr("doc_id", r"split(replace(replace(text, '\n', ' '), '. ', '.\n'), '\n') AS p")
    text = made.selectExpr("doc_id", f"CASE WHEN p IS NOT NULL THEN concat({_FRONT}, array_join(transform(p, (s, i) -> concat({_heading('div')}, s)), '\\n')) END AS text".replace(NL, "\\n"))
    return text.withColumn("language", quality.language_by_cues(F.col("text")))


# --- chapters by rules, over documents with numbered headings of several forms ---------------------
RULED = "(?:제 )?[0-9]+화|^외전"
_FORMS = f"""CASE i % 12 WHEN 0 THEN concat(i, '화 시작{NL}') WHEN 3 THEN concat('[책 - ', i, '화]{NL}제 ', i, '화 재회{NL}') WHEN 6 THEN concat(i, '화 ') WHEN 8 THEN concat('외전 막간{NL}짧은 글{NL}', i, '화 뒤{NL}') WHEN 10 THEN concat('[가 - ', i, '화]{NL}[나 - ', i, '화]{NL}[다 - ', i, '화]{NL}') ELSE '' END"""
RULED_LINES = f"""SP AS (SELECT doc_id, string_split(replace(replace(text, chr(10), ' '), '. ', concat('.', chr(10))), chr(10)) AS p FROM documents WHERE text <> ''),
  SA AS (SELECT doc_id, string_split(regexp_replace(array_to_string(list_transform(range(len(p)), lambda i: concat({_FORMS}, p[i + 1])), chr(10)), '\\n$', ''), chr(10)) AS a FROM SP),
  SL AS (SELECT doc_id, unnest(range(len(a)))::INT AS line_num, unnest(a) AS line, {STRIP.format("unnest(a)")} AS own FROM SA)"""


def _ruled_lines(spark, d):
    cut = docs(spark, d).filter("text <> ''").selectExpr("doc_id", r"split(replace(replace(text, '\n', ' '), '. ', '.\n'), '\n') AS p")
    return lines.explode_lines(cut.selectExpr("doc_id", f"array_join(transform(p, (s, i) -> concat({_FORMS}, s)), '\\n') AS text".replace(NL, "\\n")))


def _ends(body: str) -> str:
    return STRIP.format(f"array_to_string(list_filter(string_split_regex({body}, '{segment.LINE_ENDS}'), lambda x: NOT regexp_matches({STRIP.format('x')}, '{RULED}')), chr(10))")


# the joined headings one by one, in order: a heading that follows an open one is joined and opens nothing
@query(f"""WITH RECURSIVE {RULED_LINES}, SM AS (SELECT *, own <> '' AND regexp_matches(own, '{RULED}') AS b, regexp_extract(own, '^(?s:.*?)(?:{RULED})') AS head FROM SL),
  ST AS (SELECT *, {STRIP.format("substr(own, length(head) + 1)")} AS rest FROM SM WHERE b),
  SH AS (SELECT doc_id, line_num, CASE WHEN length(rest) > 20 THEN {STRIP.format('head')} ELSE {STRIP.format('left(own, 100)')} END AS name, CASE WHEN length(rest) > 20 THEN rest END AS tail,
    length(rest) <= 20 AND regexp_matches(left(own, 50), '\\[.*?\\]') AS opens, row_number() OVER {W} AS k FROM ST),
  SR AS (SELECT doc_id, k, line_num, name, tail, opens, false AS joined FROM SH WHERE k = 1 UNION ALL
    SELECT SH.doc_id, SH.k, SH.line_num, SH.name, SH.tail, SH.opens AND NOT (SR.opens AND SH.line_num = SR.line_num + 1), SR.opens AND SH.line_num = SR.line_num + 1 FROM SR JOIN SH ON SH.doc_id = SR.doc_id AND SH.k = SR.k + 1),
  SS AS (SELECT SL.doc_id, SL.line_num, CASE WHEN SR.k IS NULL THEN SL.line ELSE SR.tail END AS t, SR.name, sum(CASE WHEN NOT SR.joined THEN 1 ELSE 0 END) OVER (PARTITION BY SL.doc_id ORDER BY SL.line_num) AS seg FROM SL LEFT JOIN SR ON SR.doc_id = SL.doc_id AND SR.line_num = SL.line_num),
  SC AS (SELECT doc_id, seg, min(line_num) AS line_num, string_agg(name, ' | ' ORDER BY line_num) AS title, coalesce(string_agg(t, chr(10) ORDER BY line_num), '') AS body, seg = max(seg) OVER (PARTITION BY doc_id) AS final FROM SS WHERE seg > 0 GROUP BY doc_id, seg),
  SB AS (SELECT doc_id, seg, line_num, title, final, CASE WHEN final THEN {STRIP.format('body')} ELSE {_ends(STRIP.format('body'))} END AS body FROM SC)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1)::INT AS cid, title, body, length(body)::BIGINT AS length, line_num FROM SB WHERE body <> '' AND (final OR length(body) >= 100 OR regexp_matches(title, '[0-9]'))""")
def rule_segment_chapters(spark, d):
    return segment.chapters_by_rules(_ruled_lines(spark, d), RULED)


# every document's own titles: its lines that end in these words
_GIVEN = "(?:시작|막간)$"


@query(f"""WITH {RULED_LINES}, GT AS (SELECT DISTINCT doc_id, own AS title FROM SL WHERE regexp_matches(own, '{_GIVEN}')),
  GM AS (SELECT *, own <> '' AND EXISTS (SELECT 1 FROM GT WHERE GT.doc_id = SL.doc_id AND contains(SL.own, GT.title)) AS b FROM SL),
  GS AS (SELECT *, sum(b::INT) OVER {W} AS seg FROM GM),
  GC AS (SELECT doc_id, seg, min(line_num) AS line_num, {STRIP.format('left(arg_min(own, line_num), 100)')} AS title, {STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY line_num) FILTER (WHERE NOT b), '')")} AS body FROM GS WHERE seg > 0 GROUP BY doc_id, seg)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1)::INT AS cid, title, body, length(body)::BIGINT AS length, line_num FROM GC WHERE body <> ''""")
def title_segment_chapters(spark, d):
    rows = _ruled_lines(spark, d)
    own = strip(F.col("line"))
    return segment.chapters_by_rules(rows, ".+", rows.filter(own.rlike(_GIVEN)).select("doc_id", own.alias("title")))


@query(f"""WITH {RULED_LINES}, PM AS (SELECT *, regexp_matches(own, '{RULED}') AS b FROM SL), PS AS (SELECT *, sum(b::INT) OVER {W} AS seg FROM PM),
  PG AS (SELECT doc_id, seg, min(line_num) AS line_num, coalesce(arg_min(own, line_num) FILTER (WHERE b), '{segment.PROLOGUE}') AS title, {STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY line_num) FILTER (WHERE NOT b), '')")} AS body, count(*) FILTER (WHERE NOT b) AS n, seg = max(seg) OVER (PARTITION BY doc_id) AS final FROM PS GROUP BY doc_id, seg),
  PB AS (SELECT doc_id, seg, line_num, title, CASE WHEN final THEN body ELSE {_ends('body')} END AS body, n, final FROM PG),
  PK AS (SELECT doc_id, seg, line_num, title, body FROM PB WHERE CASE WHEN final THEN n > 0 ELSE seg = 0 OR length(body) >= 100 END UNION ALL SELECT doc_id, 0, 0, '{segment.PROLOGUE}', '' FROM SL WHERE line_num = 0 AND regexp_matches(own, '{RULED}'))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1)::INT AS cid, title, body, length(body)::BIGINT AS length, line_num FROM PK""")
def prologue_segment_chapters(spark, d):
    return segment.chapters_with_prologue(_ruled_lines(spark, d), RULED)


# --- known numbers of chapters: one for each 7,500 bytes -------------------------------------------
@query(f"""WITH RECURSIVE {SCORED}, EP AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER {WB}, 0)::BIGINT AS byte_pos FROM B), EZ AS (SELECT * FROM (SELECT doc_id, max(byte_pos + strlen(line)) AS size, floor(max(byte_pos + strlen(line)) / 7500::DOUBLE)::BIGINT AS k FROM EP GROUP BY doc_id) WHERE k > 0),
  T AS (SELECT * FROM (SELECT C.*, k, row_number() OVER (PARTITION BY C.doc_id ORDER BY line_num) AS r FROM C JOIN EZ USING (doc_id) WHERE confidence > 0.3::DOUBLE) WHERE r <= 5 * k), {_fold('T', 10)},
  EM AS (SELECT * FROM (SELECT R.doc_id, R.line_num, C.confidence, row_number() OVER (PARTITION BY R.doc_id ORDER BY C.confidence DESC, R.line_num) AS best FROM R JOIN C ON C.doc_id = R.doc_id AND C.line_num = R.line_num WHERE kept) WHERE best <= 300),
  EO AS (SELECT EM.doc_id, byte_pos, k, row_number() OVER (PARTITION BY EM.doc_id ORDER BY 0.5::DOUBLE * 0.7::DOUBLE + confidence * 0.3::DOUBLE DESC, byte_pos) AS rn, greatest(1000, floor(size / k::DOUBLE * 0.3::DOUBLE))::BIGINT AS d FROM EM JOIN EP ON EP.doc_id = EM.doc_id AND EP.line_num = EM.line_num JOIN EZ ON EZ.doc_id = EM.doc_id),
  EH AS (SELECT doc_id, k, ph, CASE ph WHEN 1 THEN d WHEN 2 THEN floor(d * 0.5::DOUBLE)::BIGINT ELSE 500 END AS dd FROM (SELECT DISTINCT doc_id, k, d FROM EO), (VALUES (1), (2), (3)) v(ph)),
  ER AS (SELECT doc_id, ph, 0::BIGINT AS rn, []::BIGINT[] AS got FROM EH UNION ALL
    SELECT ER.doc_id, ER.ph, EO.rn, CASE WHEN len(got) < EH.k AND len(list_filter(got, lambda q: abs(q - EO.byte_pos) < EH.dd)) = 0 THEN list_append(got, EO.byte_pos) ELSE got END FROM ER JOIN EH ON EH.doc_id = ER.doc_id AND EH.ph = ER.ph JOIN EO ON EO.doc_id = ER.doc_id AND EO.rn = ER.rn + 1),
  EG AS (SELECT doc_id, ph, arg_max(got, rn) AS got FROM ER GROUP BY doc_id, ph),
  EB AS (SELECT EG.doc_id, unnest(arg_min(got, EG.ph)) AS byte_pos FROM EG JOIN EZ ON EZ.doc_id = EG.doc_id WHERE len(got) = k GROUP BY EG.doc_id),
  ES AS (SELECT EP.doc_id, EP.line_num, EP.line, EP.body AS own, EB.byte_pos IS NOT NULL AS b, sum((EB.byte_pos IS NOT NULL)::INT) OVER (PARTITION BY EP.doc_id ORDER BY EP.line_num) AS seg FROM EP LEFT JOIN EB ON EB.doc_id = EP.doc_id AND EB.byte_pos = EP.byte_pos),
  EC AS (SELECT doc_id, (seg - 1)::INT AS cid, arg_min(own, line_num) AS title, {STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY line_num) FILTER (WHERE NOT b), '')")} AS body, min(line_num) AS line_num FROM ES WHERE seg > 0 GROUP BY doc_id, seg),
  EQ AS (SELECT doc_id FROM EC GROUP BY doc_id HAVING avg((length(body) < 100)::INT) <= 0.1::DOUBLE AND avg(length(body)) >= 500)
  SELECT doc_id, cid, title, body, length(body)::BIGINT AS length, line_num FROM EC JOIN EQ USING (doc_id)""")
def escalated_chapters(spark, d):
    from .core import _sizes

    return escalate.escalated(docs(spark, d), _sizes(spark, d).select("doc_id", F.floor(F.col("size") / 7500).alias("k")))


# --- shared SQL ----------------------------------------------------------------------------------
def _by(zh: str, en: str) -> str:
    return f"(CASE WHEN language = 'chinese' THEN {zh} ELSE {en} END)"


def _form(c: str, form: str) -> str:
    return _by(*(f"regexp_matches({c}, {q(headings.FORMS[k][form])})" for k in ("chinese", "english")))


def _title(c: str, form: str) -> str:
    return STRIP.format(_by(*(f"regexp_extract({c}, {q(headings.FORMS[k][form])}, 1)" for k in ("chinese", "english"))))


def _name(key: str) -> str:
    return _by(q(headings.NAMES["chinese"][key]), q(headings.NAMES["english"][key]))


def _bare(t: str) -> str:
    s = STRIP.format(f"coalesce({t}, '')")
    return f"(coalesce({t}, '') = '' OR {_by(f'''(regexp_matches({s}, {q(headings.ZH_SIMPLE)}) OR (length({s}) <= 5 AND contains({s}, '第') AND contains({s}, '章')))''', f'regexp_matches({s}, {q(headings.EN_SIMPLE)})')})"


def _squeeze(c: str) -> str:
    return f"regexp_replace({c}, '[{S}]+', ' ', 'g')"


def _titled(source: str, title: str, content: str) -> str:
    """CTEs T1 .. T4 over a source with language: T4 has all its columns, found and better (titles)."""
    breaks = " ".join(f"WHEN contains(zh_head, '{m}') THEN regexp_extract(zh_head, '(?s)^(.*){m}', 1)" for m in headings.ZH_BREAKS)
    first = "list_filter(list_transform(string_split_regex({0}, '{1}'), lambda x: " + STRIP.format("x") + "), lambda x: length(x) BETWEEN {2} AND 40 AND regexp_matches(x, {3}))[1]"
    return f"""T1 AS (SELECT *, {STRIP.format(f"coalesce({content}, '')")} AS t_body, regexp_replace({STRIP.format(f"coalesce({content}, '')")}, {q(headings.ZH_OPENERS)}, '') AS t_zh FROM {source}),
  T2 AS (SELECT *, {first.format('t_zh', '[。！？；]', 5, q('[的之在了是]'))} AS zh_s, {first.format('t_body', '[.!?;]', 10, q(headings.EN_LINKS))} AS en_s FROM T1),
  T3 AS (SELECT *, left(zh_s, 20) AS zh_head FROM T2),
  T4 AS (SELECT *, {STRIP.format(f'''coalesce({_by(f"""CASE WHEN zh_s IS NOT NULL THEN CASE WHEN length(zh_s) > 20 THEN CASE {breaks} ELSE zh_head END ELSE zh_s END
    WHEN length(t_zh) >= 5 THEN CASE WHEN length(t_zh) > 20 THEN coalesce(nullif(regexp_extract(left(t_zh, 20), '(?s)^(.+)[ ，。！？；：]', 1), ''), left(t_zh, 20)) ELSE t_zh END END""",
    f"""CASE WHEN en_s IS NOT NULL THEN {_squeeze(STRIP.format('left(en_s, 20)'))} WHEN length(t_body) >= 10 THEN regexp_replace({_squeeze(STRIP.format('left(t_body, 20)'))}, ' [^ ]*$', '') END""")}, '')''')} AS found FROM T3),
  T5 AS (SELECT *, CASE WHEN {_bare(title)} AND found <> '' THEN concat(coalesce(nullif({_by(f"regexp_extract({title}, {q(headings.ZH_LABEL)}, 1)", f"regexp_extract({title}, {q(headings.EN_LABEL)}, 1)")}, ''), {title}), {_by("' '", "': '")}, found) ELSE {title} END AS better FROM T4)"""  # fmt: skip


WD = "(PARTITION BY doc_id ORDER BY line_num)"
UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
VOLUMES = f"""{BOOKS}, BL AS (SELECT doc_id, language, text, unnest(range(len(a)))::INT AS line_num, unnest(a) AS line FROM (SELECT *, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS a FROM BK WHERE text <> '')),
  BV AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_pos, {_form('line', 'volume')} AS is_volume FROM BL),
  BN AS (SELECT *, sum(is_volume::INT) OVER (PARTITION BY doc_id ORDER BY line_num {UP})::BIGINT AS volume_no FROM BV),
  BW AS (SELECT *, coalesce(max(CASE WHEN is_volume THEN char_pos + length(line) END) OVER (PARTITION BY doc_id, volume_no), 0) AS v0, max(char_pos + length(line) + 1) OVER (PARTITION BY doc_id, volume_no) AS v1 FROM BN),
  BC AS (SELECT *, {STRIP.format('line')} AS t, substring(text, (greatest(v0, char_pos - 30) + 1)::BIGINT, (char_pos - greatest(v0, char_pos - 30))::BIGINT) AS pre, substring(text, (char_pos + length(line) + 1)::BIGINT, least(300, v1 - char_pos - length(line))::BIGINT) AS post FROM BW WHERE NOT is_volume AND {_form('line', 'chapter')}),
  BM AS (SELECT doc_id, line_num FROM BC WHERE NOT (char_pos - v0 < (v1 - v0) * 0.15::DOUBLE AND regexp_matches(left(post, 200), '(?s)^.{{0,149}}{headings.ZH_CHAPTER}')) AND length(t) <= 100 AND {_by(
    f"NOT regexp_matches(concat(right(pre, 20), left(t, 10)), {q(headings.ZH_REFERENCE)}) AND NOT regexp_matches(concat(right(pre, 10), left(t, 10)), {q(headings.ZH_LISTED)}) AND NOT regexp_matches(post, {q(headings.ZH_GOES_ON)}) AND NOT regexp_matches(left(post, 100), {q(headings.ZH_ANOTHER)}) AND len(regexp_extract_all(post, {q(headings.ZH_CHAPTER)})) < 2",
    f"NOT regexp_matches(concat(pre, left(t, 20)), {q(headings.EN_REFERENCE)}) AND NOT regexp_matches(post, {q(headings.EN_GOES_ON)}) AND NOT regexp_matches(left(post, 30), {q(headings.EN_ANOTHER)})")})"""  # fmt: skip
_EDGES = "regexp_replace({}, '^[\\n\\r]+|[\\n\\r]+$', '', 'g')"
HIERARCHY = f"""{VOLUMES},
  H1 AS (SELECT N.doc_id, N.line_num, N.line, N.language, is_volume, volume_no, BM.line_num IS NOT NULL AS is_chapter, CASE WHEN is_volume THEN {_title('line', 'volume')} END AS vt FROM BN N LEFT JOIN BM ON BM.doc_id = N.doc_id AND BM.line_num = N.line_num),
  H2 AS (SELECT *, sum(is_chapter::INT) OVER (PARTITION BY doc_id, volume_no ORDER BY line_num {UP})::BIGINT AS chapter_no, bool_or(is_chapter) OVER (PARTITION BY doc_id, volume_no) AS has_chapters, max(vt) OVER (PARTITION BY doc_id, volume_no) AS volume_title, bool_or(is_volume) OVER (PARTITION BY doc_id) AS has_volumes FROM H1),
  H3 AS (SELECT *, has_chapters AND NOT is_chapter AND NOT is_volume AND {_form('line', 'section')} AS s, has_chapters AND NOT is_chapter AND NOT is_volume AND {_form('line', 'numbered')} AS n FROM H2),
  H4 AS (SELECT *, CASE WHEN bool_or(s) OVER c THEN 1 WHEN bool_or(n) OVER c THEN 2 ELSE 0 END AS form FROM H3 WINDOW c AS (PARTITION BY doc_id, volume_no, chapter_no)),
  H5 AS (SELECT *, CASE form WHEN 1 THEN s WHEN 2 THEN n ELSE false END AS sec FROM H4),
  H6 AS (SELECT *, sum(sec::INT) OVER (PARTITION BY doc_id, volume_no, chapter_no ORDER BY line_num {UP})::BIGINT AS section_no FROM H5),
  H7 AS (SELECT doc_id, volume_no, chapter_no, any_value(language) AS language, any_value(volume_title) AS volume_title, any_value(has_chapters) AS has_chapters, any_value(has_volumes) AS has_volumes, max(form) AS form, max(CASE WHEN is_chapter THEN {_title('line', 'chapter')} END) AS raw_title,
    {_EDGES.format("coalesce(string_agg(line, chr(10) ORDER BY line_num) FILTER (WHERE NOT is_chapter AND NOT is_volume), '')")} AS whole FROM H6 GROUP BY doc_id, volume_no, chapter_no),
  {_titled('H7', 'raw_title', 'whole')},
  H8 AS (SELECT *, (volume_title IS NULL OR min(volume_no) OVER (PARTITION BY doc_id, volume_title) = volume_no) AND (chapter_no > 0 OR {STRIP.format('whole')} <> '') AS kept FROM T5),
  H9 AS (SELECT doc_id, volume_no, volume_title, chapter_no, form, language, CASE WHEN chapter_no > 0 THEN better WHEN has_chapters THEN {_name('preface')} WHEN has_volumes AND volume_no = 0 THEN {_name('volume_preface')} ELSE {_name('content')} END AS chapter_title,
    CASE WHEN chapter_no = 0 THEN {STRIP.format('whole')} WHEN {STRIP.format('whole')} = '' THEN {_name('empty_chapter')} ELSE whole END AS content FROM H8 WHERE kept),
  HS AS (SELECT doc_id, volume_no, chapter_no, section_no, max(CASE WHEN sec THEN CASE form WHEN 1 THEN {_title('line', 'section')} ELSE {_title('line', 'numbered')} END END) AS st, {_EDGES.format("coalesce(string_agg(line, chr(10) ORDER BY line_num) FILTER (WHERE NOT is_chapter AND NOT is_volume AND NOT sec), '')")} AS body FROM H6 WHERE form > 0 GROUP BY doc_id, volume_no, chapter_no, section_no),
  HT AS (SELECT *, min(section_no) OVER (PARTITION BY doc_id, volume_no, chapter_no, st) AS fs FROM HS),
  HR AS (SELECT doc_id, volume_no, volume_title, chapter_no, chapter_title, 0::BIGINT AS section_no, NULL::VARCHAR AS section_title, content FROM H9 WHERE form = 0
    UNION ALL SELECT H9.doc_id, H9.volume_no, volume_title, H9.chapter_no, chapter_title, HT.section_no, CASE WHEN HT.section_no = 0 THEN {_name('section_preface')} ELSE st END, CASE WHEN HT.section_no = 0 THEN {STRIP.format('body')} WHEN {STRIP.format('body')} = '' THEN {_name('empty_section')} ELSE body END
    FROM H9 JOIN HT ON HT.doc_id = H9.doc_id AND HT.volume_no = H9.volume_no AND HT.chapter_no = H9.chapter_no WHERE form > 0 AND CASE WHEN HT.section_no = 0 THEN {STRIP.format('body')} <> '' ELSE fs = HT.section_no END)
  SELECT * FROM HR UNION ALL SELECT doc_id, 0, NULL, 0, CASE WHEN {STRIP.format("coalesce(text, '')")} = '' THEN {q(headings.EMPTY[0])} ELSE {_name('unknown')} END, 0, NULL, CASE WHEN {STRIP.format("coalesce(text, '')")} = '' THEN {q(headings.EMPTY[1])} ELSE {_name('unparsed')} END FROM BK WHERE doc_id NOT IN (SELECT doc_id FROM HR)"""  # fmt: skip


# --- volumes, chapters, sections -----------------------------------------------------------------
@query(f"WITH {VOLUMES} SELECT doc_id, line_num, is_volume, {_form('line', 'chapter')} AS is_chapter, {_form('line', 'section')} AS is_section, {_form('line', 'numbered')} AS is_numbered FROM BV")
def heading_forms(spark, d):
    rows = hierarchy.volume_lines(books(spark, d))
    line, lang = F.col("line"), F.col("language")
    return rows.select("doc_id", "line_num", "is_volume", *[headings.is_form(line, lang, k).alias(f"is_{k}") for k in ("chapter", "section", "numbered")])


@query(f"WITH {VOLUMES} SELECT doc_id, line_num FROM BM")
def genuine_chapter_headings(spark, d):
    b = books(spark, d)
    return hierarchy.chapter_marks(hierarchy.volume_lines(b), b)


@query(f"WITH {HIERARCHY}")
def hierarchical_parse(spark, d):
    return hierarchy.hierarchy(books(spark, d))


_NAMED = "CASE doc_id % 6 WHEN 0 THEN concat('Chapter ', doc_id % 90) WHEN 1 THEN concat('第', doc_id % 90, '章') WHEN 2 THEN concat('', doc_id) WHEN 3 THEN 'Chapter 3: The hill' WHEN 4 THEN '番外 故事' ELSE concat('Ch. ', doc_id % 90) END"
TITLES = f"TI AS (SELECT doc_id, text, {_NAMED} AS title, CASE WHEN doc_id % 4 < 2 THEN 'chinese' ELSE 'english' END AS language FROM documents WHERE text IS NOT NULL)"


def _titles(spark, d):
    return docs(spark, d).filter("text is not null").selectExpr("doc_id", "text", f"{_NAMED} AS title", "CASE WHEN doc_id % 4 < 2 THEN 'chinese' ELSE 'english' END AS language")


@query(f"WITH {TITLES}, {_titled('TI', 'title', 'text')} SELECT doc_id, {_bare('title')} AS is_bare, found, better FROM T5")
def enhanced_titles(spark, d):
    t, lang = F.col("title"), F.col("language")
    return _titles(spark, d).select("doc_id", headings.is_bare(t, lang).alias("is_bare"), headings.found_title(F.col("text"), lang).alias("found"), headings.enhanced(t, F.col("text"), lang).alias("better"))


_D = "CASE WHEN {} THEN {}::DOUBLE ELSE 0::DOUBLE END"
_N = f"length({STRIP.format('text')})"


@query(f"""WITH {TITLES} SELECT doc_id, greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + {_by(_D.format("regexp_matches(title, '^第[一二三四五六七八九十百千万0-9]+章')", .2), _D.format(f"regexp_matches(title, '(?i)^Chapter[{S}]+[0-9IVX]')", .2))} + {_by(_D.format(f"regexp_matches(title, '^(?:{headings._ZH_SPECIAL})')", .15), '0::DOUBLE')}
  + (CASE WHEN {_N} > 1000 THEN 0.15::DOUBLE WHEN {_N} > 500 THEN 0.1::DOUBLE WHEN {_N} < 100 THEN -0.2::DOUBLE ELSE 0::DOUBLE END) + {_D.format('NOT ' + _bare('title'), .1)} + {_D.format(_by("regexp_matches(text, '[。！？；]')", f"regexp_matches(text, '[.!?][{S}]+[A-Z]')"), .05)})) AS confidence FROM TI""")  # fmt: skip
def chapter_confidence(spark, d):
    return _titles(spark, d).select("doc_id", headings.chapter_confidence(F.col("title"), F.col("text"), F.col("language")).alias("confidence"))


# --- contents tables -----------------------------------------------------------------------------
def _words(k: str) -> str:
    return f"(lower(body) IN ({', '.join(q(w.lower()) for w in headings.TOC_WORDS[k])}) OR regexp_replace(body, {q(toc.DECORATION)}, '', 'g') IN ({', '.join(q(w) for w in headings.TOC_WORDS[k])}))"


TOC = f"""{BOOKS}, O0 AS (SELECT doc_id, language, unnest(range(len(a)))::INT AS line_num, unnest(a) AS line FROM (SELECT *, string_split(text, chr(10)) AS a FROM BK)), O1 AS (SELECT *, {STRIP.format('line')} AS body FROM O0),
  O2 AS (SELECT *, length(body) AS size, {_by(_words('chinese'), _words('english'))} AS is_word, {_form('body', 'chapter')} OR {_form('body', 'volume')} AS is_chapter FROM O1), OL AS (SELECT *, is_chapter AND size < 80 AS is_entry FROM O2),
  O3 AS (SELECT *, sum(is_entry::INT) OVER w AS entries, list_max(list_transform(string_split_regex(array_to_string(list(CASE WHEN is_entry THEN '1' ELSE '0' END) OVER w, ''), '0+'), lambda x: length(x))) AS longest_run, sum(size) OVER w AS chars, (sum((size BETWEEN 6 AND 79)::INT) OVER w)::DOUBLE / count(*) OVER w AS short_share, bool_or(regexp_matches(body, '[0-9]$')) OVER w AS pages FROM OL WHERE line_num < 520 WINDOW w AS (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
  O4 AS (SELECT *, CASE WHEN chars > 100 THEN (entries * 1000)::DOUBLE / chars ELSE 0 END AS density FROM O3 WHERE line_num < 500 AND line_num % 3 = 0),
  OW AS (SELECT doc_id, line_num, entries::BIGINT AS entries, longest_run, short_share, (CASE WHEN density > 100 THEN density * 0.5::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN entries >= 5 THEN entries * 2::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN longest_run >= 3 THEN longest_run * 10::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN short_share > 0.6::DOUBLE THEN short_share * 20::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN pages THEN 15::DOUBLE ELSE 0::DOUBLE END) + greatest(0, 50 - line_num) * 0.2::DOUBLE AS score FROM O4)"""


@query(f"WITH {TOC} SELECT * FROM OW")
def toc_window_scores(spark, d):
    return toc.window_scores(toc.toc_lines(books(spark, d)))


@query(f"WITH {TOC}, G AS (SELECT *, line_num - row_number() OVER {WD} AS g FROM OL WHERE is_entry) SELECT doc_id, min(line_num) AS first, max(line_num) AS last, count(*) AS run FROM G GROUP BY doc_id, g")
def chapter_like_runs(spark, d):
    return toc.chapter_runs(toc.toc_lines(books(spark, d)))


@query(f"""WITH {TOC}, OS AS (SELECT doc_id, coalesce((SELECT min(line_num) FROM OL WHERE OL.doc_id = BK.doc_id AND is_word), (SELECT arg_max(line_num, struct_pack(s := score, n := -line_num)) FROM OW WHERE OW.doc_id = BK.doc_id AND score > 30)) AS st FROM BK),
  OC AS (SELECT OL.doc_id, line_num, st, is_chapter, CASE WHEN size = 0 THEN 'b' WHEN NOT is_chapter AND size > 100 THEN 'A' WHEN NOT is_chapter AND size > 50 THEN 'L' WHEN NOT is_chapter AND size > 15 THEN 'm' ELSE 'x' END AS code FROM OL JOIN OS ON OS.doc_id = OL.doc_id WHERE st IS NOT NULL),
  OA AS (SELECT *, array_to_string(list(code) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), '') AS ahead, max(CASE WHEN is_chapter AND line_num > st THEN line_num END) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS head FROM OC),
  OE AS (SELECT doc_id, line_num, st, CASE WHEN code = 'A' THEN line_num - 1 WHEN code = 'b' AND regexp_matches(ahead, '^b{{0,3}}[AL]') THEN line_num WHEN code = 'b' AND regexp_matches(ahead, '^b{{0,3}}mb{{0,3}}[ALm]') THEN CASE WHEN head IS NULL THEN line_num ELSE coalesce((SELECT max(X.line_num) FROM OL X WHERE X.doc_id = OA.doc_id AND X.size > 0 AND X.line_num < OA.head AND X.line_num > greatest(OA.st, OA.head - 10)), head - 1) END WHEN line_num - st > 300 THEN line_num END AS e FROM OA WHERE line_num > st),
  OR1 AS (SELECT doc_id, any_value(st) AS toc_start, arg_min(e, line_num) AS toc_end FROM OE WHERE e IS NOT NULL GROUP BY doc_id), OR2 AS (SELECT * FROM OR1 WHERE toc_end > toc_start)
  SELECT BK.doc_id, toc_start, toc_end, CASE WHEN toc_start IS NULL THEN text ELSE array_to_string(list_concat(list_slice(string_split(text, chr(10)), 1, toc_start), list_slice(string_split(text, chr(10)), toc_end + 2, 1000000000)), chr(10)) END AS text FROM BK LEFT JOIN OR2 ON OR2.doc_id = BK.doc_id""")
def toc_removal(spark, d):
    return toc.without_toc(books(spark, d)).select("doc_id", "toc_start", "toc_end", "text")


# --- patterns ------------------------------------------------------------------------------------
_MARKED = "CASE WHEN line_num % 3 = 0 THEN CASE (line_num {div} 3) % 4 WHEN 0 THEN concat('제 ', line_num, ' 화') WHEN 1 THEN concat('[', line_num, ']') WHEN 2 THEN concat('Chapter ', line_num) ELSE concat(line_num, '화 끝') END ELSE line END"
MARKED = f"""{TABLE_SQL}, ML AS (SELECT doc_id, line_num, {_MARKED.format(div='//')} AS line FROM L), MP AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_pos FROM ML)"""
PROFILE = f"""{MARKED}, MM AS (SELECT doc_id, byte_pos, byte_pos + strlen(line) AS e, {' + '.join(f"(CASE WHEN regexp_matches(line, {q(p)}) THEN {1 << i} ELSE 0 END)" for i, p in enumerate(patterns.LIBRARY))} AS m FROM MP), ZZ AS (SELECT doc_id, max(e) AS size, 1 + doc_id % 9 AS k FROM MM GROUP BY doc_id),
  CN AS (SELECT doc_id, c, count(*) FILTER (WHERE m & c > 0) AS n, coalesce(max(byte_pos) FILTER (WHERE m & c > 0), 0) AS last FROM MM, (SELECT unnest(range(16))::INT AS c) GROUP BY doc_id, c),
  P0 AS (SELECT ZZ.doc_id, size, k, coalesce((SELECT arg_max(i, struct_pack(n := n, i := -i)) FROM CN JOIN (SELECT unnest(range(4))::INT AS i) ON c = 1 << i WHERE CN.doc_id = ZZ.doc_id AND n > 0 AND n <= k * 1.5 AND n <= 1000), -1) AS first FROM ZZ), S0 AS (SELECT *, CASE WHEN first < 0 THEN 0 ELSE 1 << first END AS c FROM P0),
  {', '.join(f"S{i + 1} AS (SELECT S.doc_id, size, k, first, CASE WHEN S.c > 0 AND NOT (A.last > size * 0.99::DOUBLE OR size - A.last < 20000) AND B.last > A.last THEN S.c | {1 << i} ELSE S.c END AS c FROM S{i} S JOIN CN A ON A.doc_id = S.doc_id AND A.c = S.c JOIN CN B ON B.doc_id = S.doc_id AND B.c = S.c | {1 << i})" for i in range(4))},
  SB AS (SELECT S4.*, n, last FROM S4 JOIN CN ON CN.doc_id = S4.doc_id AND CN.c = S4.c)"""


def _marked(spark, d):
    return doc_lines(spark, d).selectExpr("doc_id", "line_num", f"{_MARKED.format(div='div')} AS line")


def _expected(spark, d):
    return docs(spark, d).filter("text <> ''").selectExpr("doc_id", "1 + doc_id % 9 AS expected")


def _best(spark, d):
    return patterns.best_patterns(patterns.profiles(_marked(spark, d)), _expected(spark, d))


@query(f"WITH {PROFILE} SELECT doc_id, k AS expected, first, c AS chosen, n AS found, coalesce(last::DOUBLE / nullif(size, 0), 0) AS coverage, n > 0 AND (last > size * 0.99::DOUBLE OR size - last < 20000) AS covered FROM SB")
def pattern_search(spark, d):
    return _best(spark, d).drop("size", "masks")


def _grow(name: str, source: str, most: int, upto: str, when: str) -> str:
    out, at = [], source
    for i in range(4):
        b = 1 << i
        out.append(f"{name}{i} AS (SELECT S.doc_id, k, first_n, CASE WHEN {'true' if i else when} THEN {'t' if i else '0'} ELSE 99 END + (CASE WHEN take THEN 1 ELSE 0 END) AS t, CASE WHEN take THEN S.c | {b} ELSE S.c END AS c FROM (SELECT S.*, ({'S.t' if i else '0'} < {most} AND ({'true' if i else when}) AND B.n > A.n AND B.n <= {upto}) AS take FROM {at} S JOIN CN A ON A.doc_id = S.doc_id AND A.c = S.c JOIN CN B ON B.doc_id = S.doc_id AND B.c = S.c | {b}) S)")
        at = f"{name}{i}"
    return ", ".join(out)


@query(f"""WITH {PROFILE}, X0 AS (SELECT doc_id, k, n AS first_n, 0 AS t, CASE WHEN n > k THEN coalesce((SELECT min(i) FROM CN JOIN (SELECT unnest(range(4))::INT AS i) ON CN.c = 1 << i WHERE CN.doc_id = SB.doc_id AND CN.n = k), -1) ELSE -1 END AS ex, c FROM SB), X1 AS (SELECT doc_id, k, first_n, t, CASE WHEN ex >= 0 THEN 1 << ex ELSE c END AS c FROM X0),
  {_grow('Y', 'X1', 3, 'k', 'first_n < k')}, YS AS (SELECT Y3.doc_id, k, n AS first_n, 0 AS t, Y3.c FROM Y3 JOIN CN ON CN.doc_id = Y3.doc_id AND CN.c = Y3.c), {_grow('V', 'YS', 1, 'k * 1.05::DOUBLE', 'first_n < k * 0.95::DOUBLE')}
  SELECT V3.doc_id, k AS expected, V3.c AS chosen, n AS found FROM V3 JOIN CN ON CN.doc_id = V3.doc_id AND CN.c = V3.c""")
def pattern_refinement(spark, d):
    return patterns.refined(_best(spark, d))


# --- matching that goes on behind the last match: headings of one letter for each stretch of six sentences ---------
RETRY = [f"^{chr(65 + i)}[0-9]+$" for i in range(16)]
_RETRY_AT = f"CASE WHEN i % 6 = 3 THEN concat(chr(65 + i {{div}} 6 % (16 + doc_id % 3)), i, '{NL}') ELSE '' END"
_RETRY_TEXT = f"""TP AS (SELECT doc_id, string_split(replace(replace(text, chr(10), ' '), '. ', concat('.', chr(10))), chr(10)) AS p FROM documents WHERE text <> ''),
  TT AS (SELECT doc_id, array_to_string(list_transform(range(len(p)), lambda i: concat({_RETRY_AT.format(div='//').replace('chr(65 + ', 'chr((65 + ').replace(' % 3))', ' % 3))::INT)')}, p[i + 1])), chr(10)) AS text FROM TP), """ + TABLE_SQL.replace("FROM documents", "FROM TT")
_RETRY_MASK = " + ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN {1 << i} ELSE 0 END" for i, p in enumerate(RETRY))
_LAST = "coalesce(list_max(list_transform(list_filter(m, lambda x: (x.mask & {0}) > 0), lambda x: x.pos)), 0)::BIGINT"
_REACHED = "(last > size * 0.99::DOUBLE OR size - last < 500)"


@query(f"""WITH RECURSIVE {_RETRY_TEXT}, TX AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER {WB}, 0)::BIGINT AS pos, ({_RETRY_MASK})::INT AS mask FROM L),
  TM AS (SELECT doc_id, max(pos + strlen(line)) AS size, coalesce(max(pos) FILTER (regexp_matches(line, '[0-9]+[{S}]*화')), 0) AS g, coalesce(list({{'pos': pos, 'mask': mask}} ORDER BY pos) FILTER (mask > 0), []) AS m, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS c FROM TX GROUP BY doc_id),
  TR AS (SELECT doc_id, size, g, m, c, {_LAST.format('c')} AS last, 0 AS t, 0 AS tries FROM TM WHERE size > 0 UNION ALL
    SELECT doc_id, size, g, m, CASE WHEN go AND further > last THEN wider ELSE c END, CASE WHEN go AND further > last THEN further ELSE last END, t + 1, tries + go::INT FROM (SELECT *, NOT {_REACHED} AS go, {_LAST.format('wider')} AS further FROM
      (SELECT *, CASE WHEN best.n > 0 THEN c | (1 << -best.i) ELSE c END AS wider FROM (SELECT *, list_max(list_transform(range(16), lambda i: {{'n': len(list_filter(m, lambda x: x.pos > last AND x.pos <= last + 1000 AND (x.mask & (1 << i)) > 0)), 'i': -i}})) AS best FROM TR WHERE t < 10))))
  SELECT doc_id, c::INT AS chosen, tries AS attempts, last, {_REACHED} AS covered, c = 0 AND g > size * 0.9::DOUBLE AS general FROM TR WHERE t = 10""")
def adaptive_retry(spark, d):
    cut = docs(spark, d).filter("text <> ''").selectExpr("doc_id", r"split(replace(replace(text, '\n', ' '), '. ', '.\n'), '\n') AS p")
    text = cut.selectExpr("doc_id", f"array_join(transform(p, (s, i) -> concat({_RETRY_AT.format(div='div')}, s)), '\\n') AS text".replace(NL, "\\n"))
    marked = patterns.marks(lines.explode_lines(text), RETRY)
    return patterns.adaptive(marked, F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1), RETRY, behind=1000, tail=500)


_AUTO = r"^[A-Z][a-z]+ \d+"


def _clean(name: str, pattern: str) -> str:
    end = f"regexp_matches({STRIP.format('line')}, '(?:{'|'.join(patterns.END_WORDS)})[{S}]*[>】\\])]*[{S}]*$')"
    return f"{name} AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, char_pos - lag(char_pos) OVER (PARTITION BY doc_id ORDER BY char_pos) AS g FROM MP WHERE regexp_matches(line, {q(pattern)}) AND NOT {end}) WHERE g IS NULL OR g >= 500 GROUP BY doc_id)"


@query(f"""WITH {MARKED}, {_clean('AP', _AUTO)}, {_clean('AR', patterns.relaxed(_AUTO))}, AX AS (SELECT D.doc_id, 1 + D.doc_id % 9 AS expected, coalesce(AP.n, 0) AS plain, coalesce(AR.n, 0) AS relaxed FROM documents D LEFT JOIN AP ON AP.doc_id = D.doc_id LEFT JOIN AR ON AR.doc_id = D.doc_id WHERE text <> ''),
  AY AS (SELECT *, plain < expected * 0.95::DOUBLE AND relaxed > plain AND relaxed <= expected * 1.05::DOUBLE AS is_relaxed FROM AX) SELECT *, CASE WHEN is_relaxed THEN relaxed ELSE plain END AS matches FROM AY""")
def auto_validate_fix(spark, d):
    return patterns.auto_fixed(_marked(spark, d), _expected(spark, d), _AUTO)


@query(f"""WITH RECURSIVE {TABLE_SQL}, R AS (SELECT doc_id, 0 AS line_num, 0 AS chunk_no, length(line) + 1 AS chars FROM L WHERE line_num = 0 UNION ALL SELECT L.doc_id, L.line_num, CASE WHEN R.chars + length(line) + 1 > 20000 THEN R.chunk_no + 1 ELSE R.chunk_no END, CASE WHEN R.chars + length(line) + 1 > 20000 THEN length(line) + 1 ELSE R.chars + length(line) + 1 END FROM R JOIN L ON L.doc_id = R.doc_id AND L.line_num = R.line_num + 1)
  SELECT doc_id, chunk_no, min(line_num) AS first, max(line_num) + 1 AS upto, max(chars)::INT AS chars FROM R GROUP BY doc_id, chunk_no""")
def title_search_chunks(spark, d):
    return patterns.line_chunks(doc_lines(spark, d), most=None)


@query(f"""WITH {MARKED}, SH AS (SELECT regexp_replace(regexp_replace({STRIP.format('line')}, '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g'), '[0-9]+', '\\\\d+', 'g') AS pattern FROM MP WHERE length({STRIP.format('line')}) BETWEEN 1 AND 20) SELECT pattern, count(*) AS examples FROM SH GROUP BY pattern""")
def patterns_from_titles(spark, d):
    body = strip(F.col("line"))
    return _marked(spark, d).filter(F.length(body).between(1, 20)).groupBy(patterns.pattern_of(body).alias("pattern")).agg(F.count("*").alias("examples"))


_GT = "(SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY k, pos) AS nxt, lead(k) OVER (PARTITION BY doc_id ORDER BY k, pos) AS k2 FROM GE)"


@query(f"""WITH {SCORED}, PP AS (SELECT doc_id, line_num, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_pos FROM L), GE AS (SELECT doc_id, byte_pos AS pos, 1 AS k FROM PP WHERE regexp_matches({STRIP.format('line')}, '^.{{1,29}}$') UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM PP UNION ALL SELECT doc_id, max(byte_pos + strlen(line)), 2 FROM PP GROUP BY doc_id),
  GG AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nxt - pos DESC, pos) AS r FROM {_GT} WHERE nxt IS NOT NULL AND CASE WHEN k = 1 AND k2 = 1 THEN nxt - pos > 1000 ELSE nxt - pos > 500 END) WHERE r <= 5)
  SELECT C.doc_id, C.line_num, byte_pos, confidence FROM C JOIN PP ON PP.doc_id = C.doc_id AND PP.line_num = C.line_num WHERE EXISTS (SELECT 1 FROM GG WHERE GG.doc_id = C.doc_id AND byte_pos > GG.pos AND byte_pos < GG.nxt)""")
def gap_title_candidates(spark, d):
    from .core import _matches, _scored_at

    m, z = _matches(spark, d)
    return patterns.gap_titles(_scored_at(spark, d), boundaries.gaps(m, z, F.lit(1000), F.lit(500), 5))


# --- reports -------------------------------------------------------------------------------------
_RULE = reports.RULE


@query(f"""WITH RC AS (SELECT conv_id AS doc_id, turn AS cid, role AS title, length(text) AS length, CASE WHEN turn % 2 = 0 THEN left(text, 40) ELSE '{reports.NO_SUMMARY}' END AS summary FROM conversations WHERE text IS NOT NULL)
  SELECT doc_id, concat('=== Novel Summary Report ===', chr(10), chr(10), string_agg(concat(chr(10), '{_RULE}', chr(10), '[', title, ']', chr(10), '{_RULE}', chr(10), summary, chr(10)), chr(10) ORDER BY cid, title, length, summary)) AS plain,
  concat('# Novel Summary Report', chr(10), chr(10), string_agg(concat(chr(10), '## ', title, chr(10), chr(10), summary, chr(10), chr(10), '---', chr(10)), chr(10) ORDER BY cid, title, length, summary)) AS markdown,
  concat('{{', chr(10), '  "title": "Novel Summary Report",', chr(10), '  "total_chapters": ', count(*), ',', chr(10), '  "chapters": [', chr(10), string_agg(concat('    {{', chr(10), '      "cid": ', cid, ',', chr(10), '      "title": ', to_json(title), ',', chr(10), '      "length": ', length, ',', chr(10), '      "summary": ', to_json(summary), chr(10), '    }}'), concat(',', chr(10)) ORDER BY cid, title, length, summary), chr(10), '  ]', chr(10), '}}') AS json FROM RC GROUP BY doc_id""")
def summary_report(spark, d):
    c = table(spark, d, "conversations").filter("text is not null")
    chapters = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("cid"), F.col("role").alias("title"), F.length("text").alias("length"))
    summaries = c.filter("turn % 2 = 0").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("cid"), F.substring("text", 1, 40).alias("summary"))
    return reports.summary_reports(chapters, summaries)


def _esc(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


_CARD = q(reports.CARD).replace("%1$s", "', id, '").replace("%2$s", f"', {_esc('title')}, '").replace("%3$s", f"', coalesce({_esc('author')}, 'Unknown Author'), '")


@query(f"""WITH LB AS (SELECT p_partkey AS id, concat(p_name, ' <"', p_brand, '"> & ''', p_type) AS title, CASE WHEN p_partkey % 3 > 0 THEN concat('Maker ', p_size) END AS author, p_brand AS shelf FROM part) SELECT shelf, concat('<main><div id="gallery">', string_agg(concat({_CARD}), '' ORDER BY id), '</div></main>') AS html FROM LB GROUP BY shelf""")
def library_page(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", "concat(p_name, ' <\"', p_brand, '\"> & \\'', p_type) AS title", "CASE WHEN p_partkey % 3 > 0 THEN concat('Maker ', p_size) END AS author", "p_brand AS shelf")
    return reports.library_pages(rows, "shelf")


_LR = {k: f"CASE WHEN a_{k} = 0 THEN 0 ELSE (a_{k} - b_{k})::DOUBLE / a_{k} * 100 END" for k in ("cjk", "latin", "total")}


def _row(k: str, strong: str = "") -> str:
    say = reports.LOSS["english"][k]
    cells = [f"format('{{:,}}', a_{k})", f"format('{{:,}}', b_{k})", f"concat(CASE WHEN b_{k} > a_{k} THEN '+' ELSE '' END, format('{{:,}}', b_{k} - a_{k}))"]
    last = f"'{strong}', CASE WHEN {_LR[k]} > 0 THEN concat(format('{{:.2f}}', {_LR[k]}), '%') ELSE '0%' END, '{strong}'" if k in _LR else "'-'"
    return f"'| {say} | ', " + ", ' | ', ".join(f"'{strong}', {c}, '{strong}'" for c in cells) + f", ' | ', {last}, ' |', chr(10)"


_SAY = reports.LOSS["english"]


@query(f"""WITH C0 AS (SELECT doc_id, regexp_replace(text, '[{S}]+', '', 'g') AS a, regexp_replace(regexp_replace(text, '[{S}]+', '', 'g'), CASE WHEN doc_id % 2 = 0 THEN '[0-9é]' ELSE 'e' END, '', 'g') AS b FROM documents WHERE text IS NOT NULL),
  CX AS (SELECT doc_id, {', '.join(f"len(regexp_extract_all({x}, '[{CJK}]')) AS {x}_cjk, len(regexp_extract_all({x}, '[a-zA-Z0-9]')) AS {x}_latin, len(regexp_extract_all({x}, '[{quality.CJK_MARKS}]')) + len(regexp_extract_all({x}, '[!-/:-@\\[-`{{-~]')) AS {x}_marks, length({x}) AS {x}_total" for x in 'ab')} FROM C0),
  CP AS (SELECT *, {_LR['cjk']} <= 1 AND {_LR['latin']} <= 2 AND {_LR['total']} <= 1 AS passed FROM CX)
  SELECT doc_id, passed, concat('# {_SAY['title']}', chr(10), chr(10), '## {_SAY['table']}', chr(10), chr(10), '{_SAY['headers']}', chr(10), '|------|--------|--------|------|--------|', chr(10), {_row('cjk')}, {_row('latin')}, {_row('marks')}, {_row('total', '**')}, chr(10), '## ', CASE WHEN passed THEN '{_SAY['pass']}' ELSE '{_SAY['fail']}' END) AS report FROM CP""")
def loss_report(spark, d):
    made = docs(spark, d).filter("text is not null").withColumn("_b", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[0-9é]", "")).otherwise(F.regexp_replace("text", "e", "")))
    both = quality.char_counts(quality.char_counts(made, F.col("text"), "a_"), F.col("_b"), "b_")
    marks = {f"{x}_marks": F.col(f"{x}_cjk_marks") + F.col(f"{x}_ascii_marks") for x in "ab"}
    return reports.loss_reports(both.withColumns(marks))
