"""Queries of the catalogue as it stands after writes, and of logged runs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import shared_root, written
from ..sources import text_sink, versioned
from ..streaming import incremental
from ..operators import segment
from .core import CHAP, FLAGS, STRIP, S, _chapters, docs, flagged_files, query

_COLUMNS = ["id", "file_path", "file_name", "file_size", "file_hash", "is_duplicate", "duplicate_of"]


def _place(spark, label):
    return f"{shared_root(spark)}/quire-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _two_days(spark, d) -> versioned.Tables:
    """A first scan with patterns, novels and finished work; then a scan that finds files gone, new and changed."""
    files = flagged_files(spark, d).withColumn("file_size", F.col("file_size").cast("long")).select(*_COLUMNS, "novel_id", "lang")
    files = written(files, "scanned-files")
    made = versioned.catalogue(spark, _place(spark, "catalogue"), buckets=8)
    first = files.filter("id % 3 > 0")
    change = versioned.index_files(made.change(), first.select(*_COLUMNS))
    change.replace("episode_patterns", first.filter("id % 4 = 0").selectExpr("id AS file_id", "'[0-9]+화' AS pattern", "1L AS detected_start", "id % 400 + 1 AS detected_end", "0.9D AS confidence"))
    versioned.link_novels(change, first.select("file_path", F.concat(F.lit("작품 "), "novel_id").alias("title"), F.col("lang").alias("author"), F.lit(None).cast("string").alias("genre")))
    change.merge("processing_state", first.filter("id % 2 = 1").selectExpr("id AS file_id", "1 AS stage4"))
    change.commit()
    second = files.filter("id % 13 > 0").withColumn("file_size", F.col("file_size") + (F.col("id") % 5 == 0).cast("long"))
    change = versioned.index_files(made.change(), second.select(*_COLUMNS))
    versioned.prune_missing(change, second.select("file_path"))
    change.commit()
    return made


_NV = "NV AS (SELECT novel_id AS no, min(id) AS id, concat('작품 ', novel_id) AS title, min(lang) AS author FROM FX WHERE id % 3 > 0 GROUP BY novel_id)"


@query(f"""WITH {FLAGS}, {_NV} SELECT FX.id, file_path, (file_size + (FX.id % 5 = 0)::INT)::BIGINT AS file_size, is_duplicate, duplicate_of, NV.title, NV.author, 1 AS stage0,
  CASE WHEN FX.id % 3 > 0 AND FX.id % 2 = 1 AND FX.id % 5 > 0 THEN 1 ELSE 0 END AS stage4 FROM FX LEFT JOIN NV ON novel_id = no AND FX.id % 3 > 0 WHERE FX.id % 13 > 0""")
def catalogue_after_writes(spark, d):
    made = _two_days(spark, d)
    rows = made.read("files").join(made.read("processing_state").withColumnRenamed("file_id", "id"), "id")
    novels = made.read("novels").select(F.col("id").alias("novel_id"), "title", "author")
    return rows.join(novels, "novel_id", "left").select("id", "file_path", "file_size", "is_duplicate", "duplicate_of", "title", "author", "stage0", "stage4")


@query(f"""WITH {FLAGS}, {_NV} SELECT 'files' AS name, count(*) AS rows FROM FX WHERE id % 13 > 0 UNION ALL SELECT 'processing_state', count(*) FROM FX WHERE id % 13 > 0
  UNION ALL SELECT 'episode_patterns', count(*) FROM FX WHERE id % 13 > 0 AND id % 3 > 0 AND id % 4 = 0 UNION ALL SELECT 'novels', count(*) FROM NV UNION ALL SELECT 'rename_plan', 0""")
def catalogue_cascade(spark, d):
    made = _two_days(spark, d)
    counts = [made.read(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in ("files", "processing_state", "episode_patterns", "novels", "rename_plan")]
    return reduce(DataFrame.unionByName, counts)


# --- chapter results: a document that is split again replaces its chapters --------------------------
@query(f"""WITH {CHAP}, AGAIN AS (SELECT DISTINCT doc_id FROM CH WHERE doc_id % 3 = 0 AND length >= 100)
  SELECT doc_id, cid::INT AS cid, title, body, length::BIGINT AS length FROM CH WHERE doc_id NOT IN (SELECT doc_id FROM AGAIN) OR length >= 100""")
def chapter_results(spark, d):
    chapters = written(_chapters(spark, d).withColumnRenamed("doc_id", "file_id"), "chapters")
    made = versioned.catalogue(spark, _place(spark, "catalogue"), buckets=8)
    made.change().replace("chapters", chapters).commit()
    made.change().replace("chapters", chapters.filter("file_id % 3 = 0 AND length >= 100")).commit()
    return made.read("chapters").select(F.col("file_id").alias("doc_id"), "cid", "title", "body", "length")


# --- logged runs -----------------------------------------------------------------------------------
@query("SELECT count(*) AS total, count(*) FILTER (coalesce(length(text), 0) > 200) AS success, count(*) FILTER (coalesce(length(text), 0) <= 200) AS failed FROM documents")
def logged_run(spark, d):
    """A run over new files in several batches, with its counts by batch."""
    source, out = _place(spark, "run-source"), _place(spark, "run")
    rows = docs(spark, d).select("doc_id", "text")
    # four batches at least, of files whose number grows with the table
    each = max(1, -(-max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))) // 4))
    rows.repartition(4 * each, "doc_id").write.parquet(source)
    incremental.run_new_files(spark, source, "doc_id long, text string", lambda df: df.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")), f"{out}/rows", f"{out}/checkpoint", log=f"{out}/log", failed=F.col("n") <= 200, files_per_batch=each)
    return incremental.run_counts(spark, f"{out}/log").select("total", "success", "failed")


# --- formatted text and books as files ---------------------------------------------------------------
# titles with a number that is set apart, and bodies with runs of blank lines
_TITLE = "CASE WHEN cid % 3 = 0 THEN concat(title, '제목', cid, '화') WHEN cid % 3 = 1 THEN concat(' ', title, '-', cid, '화 ') ELSE title END"
_BODY = "concat(body, repeat(chr(10), (cid % 6)::INT), 'end  ', chr(10), repeat(concat(' ', chr(10)), (doc_id % 5)::INT))"
_BOX = f"""{CHAP}, BX AS (SELECT doc_id, cid, regexp_replace({STRIP.format(_TITLE)}, '([가-힣a-zA-Z])-?([0-9]+화)', '\\1 - \\2', 'g') AS t, string_split_regex({_BODY}, '{segment.LINE_ENDS}') AS a FROM CH),
  BQ AS (SELECT doc_id, cid, CASE WHEN length(t) >= 60 THEN t ELSE concat(repeat(' ', (60 - length(t)) // 2), t, repeat(' ', 60 - length(t) - (60 - length(t)) // 2)) END AS t, list_transform(CASE WHEN a[len(a)] = '' THEN a[:len(a) - 1] ELSE a END, lambda x: regexp_replace(x, '[{S}]+$', '')) AS a FROM BX),
  BZ AS (SELECT doc_id, cid, concat(repeat(chr(10), 7), repeat('━', 60), chr(10), t, chr(10), repeat('━', 60), repeat(chr(10), 3), array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: NOT (i > 2 AND a[i] = '' AND a[i - 1] = '' AND a[i - 2] = '')), lambda i: a[i]), chr(10)), chr(10)) AS text FROM BQ)"""


def _formatted(spark, d):
    chapters = _chapters(spark, d)
    title, body = (F.expr(x.replace("::INT", "").replace("chr(10)", "'\\n'").replace("(cid % 6)", "cast(cid % 6 as int)").replace("(doc_id % 5)", "cast(doc_id % 5 as int)")) for x in (_TITLE, _BODY))
    return text_sink.formatted(chapters.select("doc_id", F.col("cid").cast("long").alias("cid"), title.alias("title"), body.alias("body")))


@query(f"WITH {_BOX} SELECT doc_id, cid, text FROM BZ")
def formatted_chapters(spark, d):
    return _formatted(spark, d)


@query(f"WITH {_BOX} SELECT doc_id AS book, sum(strlen(text))::BIGINT AS bytes, sha256(string_agg(text, '' ORDER BY cid)) AS sha256 FROM BZ GROUP BY doc_id")
def books_as_files(spark, d):
    """Chapters written as text files of about 4,000 bytes, and the books as they are read back."""
    path = _place(spark, "text-books")
    text_sink.write_books(_formatted(spark, d), path, 4000)
    return text_sink.read_books(spark, path).select("book", "bytes", "sha256")
