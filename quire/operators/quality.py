"""Character counts, language cues, loss rates, and verification tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, SPACE, count_letters, count_matches

CJK_MARKS = "，。！？；：、“”‘’（）《》【】—…"


def char_counts(df: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    bare = F.regexp_replace(text, f"[{SPACE}]+", "")
    return df.withColumns({
        f"{prefix}cjk": count_letters(bare, f"[{CJK}]").cast("long"),
        f"{prefix}latin": count_letters(bare, "[a-zA-Z0-9]").cast("long"),
        f"{prefix}cjk_marks": count_letters(bare, f"[{CJK_MARKS}]").cast("long"),
        f"{prefix}ascii_marks": count_letters(bare, r"[!-/:-@\[-`{-~]").cast("long"),
        f"{prefix}total": F.length(bare).cast("long"),
        f"{prefix}original": F.length(text).cast("long"),
    })


def language_by_share(cjk: Column, latin: Column) -> Column:
    return F.when(cjk / F.nullif(cjk + latin, F.lit(0)) > 0.3, "chinese").otherwise("english")


def language_by_cues(text: Column) -> Column:
    cjk, latin = count_letters(text, f"[{CJK}]"), count_letters(text, "[a-zA-Z]")
    low = F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))  # a dotted I is an i; Java's lower makes two characters of it
    zh, en = count_letters(text, "[章节卷回部篇]"), count_matches(low, "chapter|section|part|volume")
    return F.when((F.coalesce(text, F.lit("")) == "") | (cjk > latin * 0.5) | (zh > en), "chinese").otherwise("english")


def loss_rate(original: Column, converted: Column) -> Column:
    return F.coalesce((original - converted) * 100.0 / F.nullif(original, F.lit(0)), F.lit(0.0))


def concern(rate: Column) -> Column:
    return F.when(rate <= 0.5, "none").when(rate <= 1.0, "low").when(rate <= 2.0, "medium").otherwise("high")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def heading(html: Column, fallback: Column) -> Column:
    found = strip_tags(F.regexp_extract(html, "(?is)<(?:h1|h2|title)[^>]*>(.*?)</(?:h1|h2|title)>", 1))
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), fallback)


def paragraphs(text: Column) -> Column:
    """Each non-blank line, escaped, as a paragraph."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.transform(F.split(safe, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n")


def isbn(text: Column) -> Column:
    """13 digits from 978 or 979, or 10 with a check letter; marks dropped."""
    bare = F.regexp_replace(F.upper(text), "ISBN:?|[- ]", "")
    return F.when(bare.rlike("^97[89][0-9]{10}$"), bare).when(bare.rlike("^[0-9]{9}[0-9X]$"), bare)
