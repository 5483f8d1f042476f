"""Chapters by rules, with a model's word on the doubtful ones.

A document whose chapters are, on the whole, sure enough is left as the rules cut it. Of the others every doubtful
chapter is put to the model with what stands before and after its title; a rejected one goes, an accepted one may
get another title. Decisions come back to their chapter's place, so equal titles have decisions of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scorer import Answers, Model

# fixed values: the confidence below which a document and a chapter are in doubt, and letters of context
SURE, CONTEXT = 0.7, 200
DECISION = "is_chapter boolean, title string"


def question(before: Column, title: Column, after: Column, confidence: Column) -> Column:
    issue = F.when(confidence < 0.5, "very low confidence").otherwise("low confidence")
    ask = 'Is the marked line the title of a chapter? Answer with {"is_chapter": true or false, "title": a better title or nothing}.'
    return F.concat_ws("\n", F.lit(ask), F.concat(F.lit("Issue: "), issue), F.lit("[before]"), before, F.lit("[line]"), title, F.lit("[after]"), after)


def decided(chapters: DataFrame, answers: Answers, start: Callable[[], Model], **options) -> DataFrame:
    """chapters (doc_id, cid, title, body, confidence; a written table) with asked, without those that were rejected.

    A document is in doubt if the mean of its chapters' confidence is below SURE, and of it the chapters below SURE
    are asked about. An answer that cannot be read, and none at all, keep the chapter as it is. Context is taken from
    the chapter before (its title and body) and from the chapter's own body. Null bodies count as empty.
    """
    whole, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("cid")
    text = F.concat(F.col("title"), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    # in whole hundredths, so that the order of a sum does not matter
    hundredths = F.sum(F.round(F.col("confidence") * 100).cast("long")).over(whole)
    doubt = (hundredths < int(100 * SURE) * F.count(F.lit(1)).over(whole)) & (F.col("confidence") < SURE)
    before = F.right(F.coalesce(F.lag(text).over(order), F.lit("")), F.lit(CONTEXT))
    rows = chapters.select("*", doubt.alias("asked"), before.alias("_before"))
    prompt = question(F.col("_before"), F.col("title"), F.left(F.coalesce("body", F.lit("")), F.lit(CONTEXT)), F.col("confidence"))
    rows = rows.withColumn("_prompt", F.when(F.col("asked"), prompt)).withColumn("_digest", F.sha2(F.encode("_prompt", "utf-8"), 256)).drop("_before")
    known = answers.ask(rows.filter("asked").select(F.col("_digest").alias("digest"), F.col("_prompt").alias("prompt")), start, **options)
    said = F.from_json("answer", DECISION)
    both = rows.drop("_prompt").join(known.select(F.col("digest").alias("_digest"), said.alias("_said")), "_digest", "left")
    title = F.coalesce(F.nullif(F.trim("_said.title"), F.lit("")), "title")
    keeps = F.coalesce(F.col("_said.is_chapter"), F.lit(True))
    return both.filter(keeps).withColumn("title", title).select(*chapters.columns, "asked")


def offline() -> Model:
    """A model without a service: titles with 150 letters after them are chapters, those of odd length get a new title, and one in seven is not understood."""

    def answer(prompt: str) -> str:
        line, _, after = prompt.partition("\n[line]\n")[2].partition("\n[after]\n")
        if len(line) % 7 == 3:
            return "I am not sure"
        title = f"Chapter: {line}" if len(line) % 2 else ""
        return '{"is_chapter": %s, "title": "%s"}' % ("true" if len(after) >= 150 else "false", title.replace("\\", "\\\\").replace('"', '\\"'))

    return lambda prompts: [answer(p) for p in prompts]
