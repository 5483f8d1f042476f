"""From raw documents to training batches: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again
as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, language_id, near_copies, packing, pii
from quire.llm.common import documents, materialize, named


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages (no text, no letter, or far from all of them) go; lang is
    the language found."""
    parser = language_id.fit(docs.filter(~F.coalesce(language_id.held_out(), F.lit(False))))
    return language_id.keep_identified(docs, parser)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more), the row with the least doc_id stays."""
    return near_copies.keep_one(docs)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values get pseudonyms; n_chars counts the new text."""
    new = pii.with_pseudonyms(docs, pii.session_key(spark), count_col=None)
    return new.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    import public_tokenizers

    return packing.pack(packing.token_lengths(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", identify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("pii", pseudonymize), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
