"""The query of chapters on which a model has its word."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions.tables import shared_root, written
from ..operators import headings, hybrid, scorer
from .core import CHAP, S, _chapters, query

_CONFIDENCE = f"""greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + CASE WHEN regexp_matches(title, '(?i)^Chapter[{S}]+[0-9IVX]') THEN 0.2::DOUBLE ELSE 0::DOUBLE END + 0::DOUBLE
  + CASE WHEN {{n}} > 1000 THEN 0.15::DOUBLE WHEN {{n}} > 500 THEN 0.1::DOUBLE WHEN {{n}} < 100 THEN -0.2::DOUBLE ELSE 0::DOUBLE END + 0.1::DOUBLE + CASE WHEN regexp_matches(body, '[.!?][{S}]+[A-Z]') THEN 0.05::DOUBLE ELSE 0::DOUBLE END))"""


@query(f"""WITH {CHAP}, HA AS (SELECT doc_id, cid, title, body, {_CONFIDENCE.format(n=f"length(regexp_replace(body, '^[{S}]+|[{S}]+$', '', 'g'))")} AS confidence FROM CH),
  HB AS (SELECT *, sum(round(confidence * 100)::BIGINT) OVER (PARTITION BY doc_id) < 70 * count(*) OVER (PARTITION BY doc_id) AND confidence < 0.7::DOUBLE AS asked FROM HA),
  HC AS (SELECT *, CASE WHEN asked AND length(title) % 7 <> 3 THEN length(left(body, 200)) >= 150 END AS keeps FROM HB)
  SELECT doc_id, cid::INT AS cid, CASE WHEN keeps AND length(title) % 2 = 1 THEN concat('Chapter: ', title) ELSE title END AS title, length(body)::BIGINT AS length, asked FROM HC WHERE coalesce(keeps, true)""")
def hybrid_chapters(spark, d):
    """Chapters of documents; those of documents in doubt are put to the offline model."""
    made = _chapters(spark, d)
    rows = written(made.withColumn("confidence", headings.chapter_confidence(F.col("title"), F.col("body"), F.lit("english"))), "rule-chapters")
    kept = scorer.Answers(spark, f"{shared_root(spark)}/quire-answers-{spark.sparkContext.applicationId}/hybrid-{hashlib.sha256(d.encode()).hexdigest()[:16]}")
    return hybrid.decided(rows, kept, hybrid.offline).select("doc_id", "cid", "title", "length", "asked")
