"""Queries over parts of texts, file lists, mapping and prompt files, and e-book metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundaries, inputs, lines, segment, titles
from ..sources import epub_sink, readers
from .catalogue import FILES2, files2
from .core import CHAP, MATCH, STATE, _chapters, _matches, docs, query, state, table

_HEAD = ", ".join(f"try(decode(b[1:{inputs.HEAD_BYTES - k}]))" for k in range(4))
_TAIL = ", ".join(f"try(decode(b[greatest(1, n - {inputs.HEAD_BYTES - 1 - k}):]))" for k in range(4))


@query(f"WITH X AS (SELECT doc_id, encode(text) AS b, strlen(text) AS n FROM documents) SELECT doc_id, coalesce({_HEAD}) AS head, coalesce({_TAIL}) AS tail FROM X")
def head_tail_sample(spark, d):
    return docs(spark, d).select("doc_id", inputs.head_bytes(F.col("text")).alias("head"), inputs.tail_bytes(F.col("text")).alias("tail"))


_RANGE = "CASE WHEN {at} > 0 AND contains(substr(text, {at}), chr(10)) THEN left(substr(text, {at} + instr(substr(text, {at}), chr(10))), {n}) ELSE '' END"


@query(f"""WITH X AS (SELECT doc_id, text, length(text) - 200 AS n FROM documents), Y AS (SELECT *, n // 4 AS step FROM X), Z AS (SELECT doc_id, text, n, list_transform(range(4), lambda i: {_RANGE.format(at='(201 + i * step)::BIGINT', n='300')}) AS p FROM Y)
  SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN n <= 0 THEN '' WHEN n < 2000 THEN {_RANGE.format(at='201', n='n')} ELSE array_to_string(list_concat([p[1]], list_filter(p[2:], lambda x: x <> '')), '{inputs.SKIP_MARK}') END AS sample FROM Z""")
def range_sample(spark, d):
    """From the 200th character on: texts with fewer than 2000 behind it whole, longer ones as four pieces of 300."""
    return docs(spark, d).select("doc_id", inputs.range_sample(F.col("text"), F.lit(200), None, 2000, 300, 4).alias("sample"))


_MAP = "concat('==== ', s_suppkey, chr(10), chr(10), '→ lost', chr(10), ' ', s_name, '.txt ', chr(10), '→ ', s_name, '_1.txt', chr(10), 'left', chr(10), 'of ', s_name, chr(10), CASE WHEN s_suppkey % 2 = 0 THEN '→ b' ELSE '= c' END)"


@query("WITH X AS (SELECT s_suppkey AS doc_id, 4 AS line_num, concat(s_name, '.txt') AS old, concat(s_name, '_1.txt') AS new FROM supplier UNION ALL SELECT s_suppkey, 7, concat('of ', s_name), 'b' FROM supplier WHERE s_suppkey % 2 = 0) SELECT doc_id, line_num::INT AS line_num, old, new FROM X")
def mapping_file_pairs(spark, d):
    text = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.expr(_MAP.replace("chr(10)", "'\\n'")).alias("text"))
    return inputs.mapping_pairs(lines.explode_lines(text))


@query("SELECT n_regionkey, string_agg(concat(n_name, chr(10), '→ ', lower(n_name), chr(10)), chr(10) ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey")
def mapping_file_text(spark, d):
    return inputs.mapping_text(table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("old"), F.lower("n_name").alias("new")), "n_regionkey")


_PROMPTS = "concat('head', chr(10), '=== summary_general ===', chr(10), 'all ', r_regionkey, chr(10), '=== style ===', chr(10), ' plain', chr(10), chr(10), '=== summary_', lower(r_name), ' ===', chr(10), 'of ', r_name, chr(10), '=== style ===', chr(10), 'last')"


def _sections(spark, d):
    return inputs.sections(table(spark, d, "region").select("r_regionkey", F.expr(_PROMPTS.replace("chr(10)", "'\\n'")).alias("text")), "r_regionkey")


@query("SELECT r_regionkey, 'summary' AS kind, 'general' AS name, concat('all ', r_regionkey) AS value FROM region UNION ALL SELECT r_regionkey, 'plain', 'style', 'last' FROM region UNION ALL SELECT r_regionkey, 'summary', lower(r_name), concat('of ', r_name) FROM region")
def prompt_sections(spark, d):
    return _sections(spark, d)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'asia' ELSE lower(c_mktsegment) END AS genre, CASE WHEN c_custkey % 2 = 0 THEN 'of ASIA' ELSE (SELECT concat('all ', r_regionkey) FROM region WHERE r_name = 'ASIA') END AS prompt FROM customer")
def prompt_lookup(spark, d):
    """The sections of one prompt file, for each customer's genre."""
    one = table(spark, d, "region").filter("r_name = 'ASIA'").select("r_regionkey")
    found = _sections(spark, d).join(one, "r_regionkey").filter("kind = 'summary'")
    wanted = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "asia").otherwise(F.lower("c_mktsegment")).alias("genre"))
    return inputs.prompt_for(wanted, found).select("c_custkey", "genre", "prompt")


@query(f"WITH {FILES2}, X AS (SELECT id, CASE WHEN id % 5 = 0 THEN '.JSON' ELSE ext END AS ext, file_name, file_size * CASE WHEN id % 2 = 0 THEN 1 ELSE 321 END AS n FROM F2), Y AS (SELECT id, file_name, round_even(n / 1048576::DOUBLE, 2)::DOUBLE AS mb, round_even(n / 1024::DOUBLE, 1)::DOUBLE AS kb FROM X WHERE n >= 512 AND ext <> '.JSON') SELECT id, concat(file_name, ' | ', CASE WHEN mb >= 1 THEN concat(regexp_replace(mb::VARCHAR, '\\.0$', ''), ' MB') ELSE concat(regexp_replace(kb::VARCHAR, '\\.0$', ''), ' KB') END) AS entry FROM Y")
def file_list_entries(spark, d):
    even = F.col("id") % 2 == 0
    f = files2(spark, d).withColumn("ext", F.when(F.col("id") % 5 == 0, ".JSON").otherwise(F.col("ext"))).withColumn("file_size", F.when(even, F.col("file_size")).otherwise(F.col("file_size") * 321))
    return inputs.file_list(f).select("id", "entry")


_TAGS = "CASE event_id % 4 WHEN 0 THEN '[\"a b\", \"c\", \"\"]' WHEN 1 THEN concat(' x', event_id, ' ,y,, ') WHEN 2 THEN '' END"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a b|c' WHEN 1 THEN concat('x', event_id, '|y') ELSE '' END AS tags FROM events")
def tags_parsed(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(inputs.tags(F.expr(_TAGS)), "|").alias("tags"))


@query("SELECT conv_id, turn, text, lag(CASE WHEN length(text) > 40 THEN left(text, 20) END) OVER (PARTITION BY conv_id ORDER BY turn, text) AS context FROM conversations")
def context_chain(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return inputs.chained(c, "conv_id", ["turn", "text"], F.substring("text", 1, 20), F.length("text") > 40)


@query(f"WITH {STATE} SELECT " + ", ".join(f"sum(stage{k})::DOUBLE / greatest(count(*), 1) AS stage{k}" for k in range(6)) + " FROM ST")
def completion_ratios(spark, d):
    return inputs.completion(state(spark, d), [f"stage{k}" for k in range(6)])


@query(f"""WITH {MATCH}, Z2 AS (SELECT doc_id, size * 20 AS size FROM Z), E AS (SELECT doc_id, pos * 20 AS pos, 1 AS k FROM M UNION ALL SELECT doc_id, 0, 0 FROM Z2 UNION ALL SELECT doc_id, size, 2 FROM Z2),
  V AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY k, pos) AS nxt FROM E), X AS (SELECT doc_id, pos AS start, nxt AS "end", nxt - pos AS size, Z2.size AS whole, greatest(1, Z2.size // 7500) AS expected FROM V JOIN Z2 USING (doc_id) WHERE nxt IS NOT NULL),
  Y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, start) AS r FROM X WHERE size > greatest(1.5::DOUBLE * whole / expected, 50000::DOUBLE)) SELECT doc_id, start, "end", size, size / (whole::DOUBLE / expected) AS priority FROM Y WHERE r <= 10""")
def large_gaps(spark, d):
    """Gaps of over 50,000 bytes and half as much again as an expected chapter, one expected for each 7,500 bytes.
    No text of these tables has 50,000 bytes: places count twentyfold."""
    m, z = (x.withColumn(c, F.col(c) * 20) for x, c in zip(_matches(spark, d), ("pos", "size")))
    return boundaries.large_gaps(m, z, F.greatest(F.lit(1), F.floor(F.col("size") / 7500)))


@query(f"WITH {CHAP} SELECT doc_id, concat('document ', doc_id) AS title, '' AS creator, 'ko' AS language, NULL::VARCHAR AS publisher, '' AS subjects FROM CH GROUP BY doc_id")
def epub_metadata(spark, d):
    """Metadata read back from the e-books of all documents with chapters."""
    made = epub_sink.epubs(_chapters(spark, d)).select(F.col("doc_id").cast("string").alias("path"), F.col("epub").alias("content"), F.lit(".epub").alias("file_ext"))
    return readers.epub_metadata(made).select(F.col("path").cast("long").alias("doc_id"), "title", "creator", "language", "publisher", F.array_join("subjects", "|").alias("subjects"))



@query(f"""WITH {CHAP}, TY AS (SELECT unnest(['본편', '외전', '에필로그', '작가의 말', '기타']) AS chapter_type), BB AS (SELECT doc_id, cid, CASE cid % 4 WHEN 0 THEN title WHEN 1 THEN concat(title, ' 외전') WHEN 2 THEN concat('Epilogue ', title) ELSE concat(title, ' 작가 후기') END AS title FROM CH),
  EE AS (SELECT doc_id, cid, CASE WHEN regexp_matches(lower(title), '작가의 말|작가 후기|후기') THEN '작가의 말' WHEN regexp_matches(lower(title), '에필로그|epilogue|후일담') THEN '에필로그' WHEN regexp_matches(lower(title), '외전|번외|특별편|side story') THEN '외전' ELSE '본편' END AS t FROM BB),
  DD AS (SELECT doc_id, count(*) AS total FROM EE GROUP BY doc_id), GG AS (SELECT doc_id, t, count(*) AS n, min(cid) + 1 AS a, max(cid) + 1 AS z FROM EE GROUP BY doc_id, t)
  SELECT DD.doc_id, total, TY.chapter_type, coalesce(n, 0)::BIGINT AS n, coalesce(a, 0)::BIGINT AS first, coalesce(z, 0)::BIGINT AS last FROM DD CROSS JOIN TY LEFT JOIN GG ON GG.doc_id = DD.doc_id AND GG.t = TY.chapter_type""")
def chapter_type_table(spark, d):
    c, t = F.col("cid") % 4, F.col("title")
    other = F.when(c == 0, t).when(c == 1, F.concat(t, F.lit(" 외전"))).when(c == 2, F.concat(F.lit("Epilogue "), t)).otherwise(F.concat(t, F.lit(" 작가 후기")))
    return segment.type_summary(_chapters(spark, d).select("doc_id", "cid", other.alias("title")))


_RANGE = "CASE event_id % 5 WHEN 0 THEN concat('1~', event_id, '화') WHEN 1 THEN concat(event_id, '화') WHEN 2 THEN '완결' WHEN 3 THEN concat('총 5-', event_id, ' (2)') END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 3 THEN event_id - 4 ELSE 0 END AS n FROM events")
def expected_of_range(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(titles.expected_count_of_range(F.expr(_RANGE)), F.lit(0)).alias("n"))
