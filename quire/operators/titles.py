"""Titles and file names: cleaning, ranges, and the file-name rule engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, byte_truncate, one_decimal, squeeze, strip

# fixed values
STATUS = {"completed": "완결", "Completed": "완결", "ongoing": "연재", "Ongoing": "연재", "연재중": "연재", "연재": "연재", "hiatus": "휴재", "Hiatus": "휴재"}
GENRES = {"판타지": "판타지", "fantasy": "판타지", "로맨스": "로맨스", "romance": "로맨스", "무협": "무협", "현대판타지": "현판", "SF": "SF", "미스터리": "미스터리", "스릴러": "스릴러", "BL": "BL", "백합": "백합"}
PRIORITY_TAGS = ["19금", "성인", "완결", "베스트"]
TITLE_BYTES, AUTHOR_BYTES, NAME_BYTES, TAGS = 100, 30, 200, 3
END_WORDS = ["끝", "완", "END", "end", "fin", "Fin", "종료", "끗", "完"]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def clean_search_title(name: Column) -> Column:
    c = F.regexp_replace(name, r"(?i)\.(txt|epub|pdf|doc|docx)$", "")
    c = F.regexp_replace(c, f"^#+[{SPACE}]*", "")
    c = F.regexp_replace(c, r"\([^)]*(?:[0-9]+[~\-][0-9]+|[0-9]+화|완결|연재|휴재)[^)]*\)", "")
    c = F.regexp_replace(c, f"\\([{SPACE}]*\\)", "")
    return strip(squeeze(F.replace(c, F.lit("_"), F.lit(" "))))


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("long")


def episode_range_numeric(c: Column) -> Column:
    return F.coalesce(_number(F.regexp_extract(c, "([0-9]+)[~-]([0-9]+)", 2)), _number(F.regexp_extract(c, "([0-9]+)", 1)))


def filename_hint(name: Column) -> Column:
    span = F.nullif(F.regexp_extract(name, r"\(([0-9]+~[0-9]+)\)", 1), F.lit(""))
    single = F.nullif(F.regexp_extract(name, r"\(([0-9]+)\)", 1), F.lit(""))
    return F.when(span.isNotNull(), F.concat(span, F.lit("화"))).when(single.isNotNull(), F.concat(F.lit("1~"), single, F.lit("화")))


def expected_count_strict(name: Column) -> Column:
    a = _number(F.regexp_extract(name, "(?:~|-)([0-9]+)(?:화|회)?", 1))
    b = _number(F.regexp_extract(name, r"(?:총|\(|\[)([0-9]+)(?:화|회|\]|\))", 1))
    return F.coalesce(a, b, F.lit(0).cast("long"))


def expected_count_loose(name: Column) -> Column:
    """The last whole number of the name."""
    return F.coalesce(_number(F.regexp_extract(name, "([0-9]+)[^0-9]*$", 1)), F.lit(0).cast("long"))


def expected_count_of_range(c: Column) -> Column:
    n = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.when(F.size(n) >= 2, n[1] - n[0] + 1).when(F.size(n) == 1, n[0]).otherwise(F.lit(0).cast("long"))


def normalize_title(title: Column) -> Column:
    c = F.regexp_replace(title, r"\[.*?\]|\(.*?\)|【.*?】", "")
    c = F.regexp_replace(strip(c), "_[0-9]+$", "")
    c = F.regexp_replace(c, f"[{SPACE}]+완결$", "")
    return byte_truncate(strip(squeeze(c)), TITLE_BYTES)


def format_status(episode_range: Column, status: Column) -> Column:
    mapped = F.coalesce(F.element_at(_map(STATUS), status), status)
    return F.concat_ws("_", F.coalesce(F.nullif(episode_range, F.lit("")), F.lit("단편")), F.nullif(mapped, F.lit("")))


def format_rating(rating: Column) -> Column:
    return F.when(rating.isNull(), F.lit("미평가")).otherwise(F.concat(F.lit("★"), one_decimal(rating)))


def normalize_genre(genre: Column) -> Column:
    return F.when(F.coalesce(genre, F.lit("")) == "", F.lit("기타")).otherwise(F.coalesce(F.element_at(_map(GENRES), genre), genre))


def normalize_author(author: Column) -> Column:
    c = strip(F.regexp_replace(author, f"(?:작가|저자):[{SPACE}]*", ""))
    return F.when(F.coalesce(author, F.lit("")) == "", F.lit("작가미상")).otherwise(byte_truncate(c, AUTHOR_BYTES))


def format_tags(tags: Column) -> Column:
    """Priority tags first, each part in its order, three at most."""
    wanted = F.array(*[F.lit(t) for t in PRIORITY_TAGS])
    first = F.filter(tags, lambda t: F.array_contains(wanted, t))
    rest = F.filter(tags, lambda t: ~F.array_contains(wanted, t))
    return F.array_join(F.slice(F.concat(first, rest), 1, TAGS), ",")


def sanitize(name: Column) -> Column:
    return F.translate(name, '<>:"/\\|?*', "_________")


def with_filename(records: DataFrame, ext: Column) -> DataFrame:
    """records (name, title, span: the listed range, status, chapters, rating, genre, author, tags) with file_name:
    title__range_status__★rating__genre__author__tags.ext; a hint in the name beats the counted chapters, which
    beat the listed range; a difference is told in the status. What several parts ask for is made once."""
    chapters, span, status = F.col("chapters"), F.col("span"), F.col("status")
    made = records.withColumns({"_hint": filename_hint(F.col("name")), "_web": expected_count_loose(span)})
    real = F.coalesce(F.nullif(chapters.cast("long"), F.lit(0).cast("long")), F.when(F.col("_hint").isNotNull(), expected_count_loose(F.col("_hint"))), F.lit(0))
    shown = F.coalesce("_hint", F.when(chapters > 0, F.concat(F.lit("1~"), chapters.cast("string"), F.lit("화"))), span)
    made = made.withColumns({"_real": real, "_shown": shown})
    web, real = F.coalesce("_web", F.lit(0)), F.col("_real")
    part = F.concat(F.lit("부분("), real.cast("string"), F.lit("_"), web.cast("string"), F.lit("화)"))
    told = F.when((web > 0) & (real > 0) & (web != real), F.concat_ws("_", F.nullif(status, F.lit("")), part)).otherwise(status)
    fields = F.array(normalize_title(F.col("title")), format_status(F.col("_shown"), told), F.when(F.col("rating").isNotNull(), format_rating(F.col("rating"))), normalize_genre(F.col("genre")), normalize_author(F.col("author")), F.nullif(format_tags(F.col("tags")), F.lit("")))
    kept = F.filter(fields, lambda x: x.isNotNull() & (strip(x) != "") & ~F.contains(x, F.lit("Unknown")))
    made = made.withColumn("_joined", sanitize(F.array_join(kept, "__")))
    return made.withColumn("file_name", F.concat(byte_truncate(F.col("_joined"), NAME_BYTES - 5), ext)).drop("_hint", "_web", "_real", "_shown", "_joined")


def postprocess_name(name: Column) -> Column:
    c = F.regexp_replace(name, ", |,", "_")
    c = F.regexp_replace(c, "포함|및|본편", "")
    c = F.when(F.contains(c, F.lit("#")), F.concat(F.lit("#"), F.replace(c, F.lit("#"), F.lit("")))).otherwise(c)
    for a, b in (("에필로그", "에필"), ("_-_", "-"), ("__", "_"), ("_)", ")"), ("(_", "(")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "^#[_ ]+", "#")


def is_end_marker(line: Column) -> Column:
    return line.rlike(f"(?:{'|'.join(END_WORDS)})[{SPACE}]*[>】\\])]*[{SPACE}]*$")
