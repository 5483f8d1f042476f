"""Merging two metadata records of one work by priority, date and size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .titles import episode_range_numeric

# fixed values
PLATFORMS = ["노벨피아", "네이버 시리즈", "리디", "네이버 웹소설", "카카오", "문피아", "조아라"]
ADULT = ["성인", "19금", "야겜", "R19", "노블레스", "성인물"]
DOMAINS = ["novelpia.com", "series.naver.com", "ridibooks.com", "novel.naver.com", "page.kakao.com", "munpia.com", "joara.com"]
URL_BLACKLIST = [".svg", ".ico", "logo", "icon", "default", "mark"]


def platform_priority(platform: Column) -> Column:
    found = reduce(lambda c, x: c.when(F.contains(platform, F.lit(x[1])), x[0]), enumerate(PLATFORMS), F.when(platform.isNull() | (platform == ""), 999))
    return found.otherwise(900)


def cover_url(url: Column) -> Column:
    return F.when(~F.lower(url).rlike("|".join(x.replace(".", r"\.") for x in URL_BLACKLIST)), url)


def in_priority_domain(url: Column) -> Column:
    return url.rlike("|".join(x.replace(".", r"\.") for x in DOMAINS))


def genre_union(a: Column, b: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.concat_ws(",", a, b), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), ", ")


def tag_union(a: Column, b: Column, most: int = 15) -> Column:
    none = F.array().cast("array<string>")
    return F.slice(F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none))), 1, most)


def merge_metadata(pairs: DataFrame) -> DataFrame:
    """pairs: structs base and extra (title, author, genre, tags, status, episode_range, rating,
    cover_url, platform, last_updated, official_url); all rules read the records before the merge."""
    b, e = F.col("base"), F.col("extra")
    dated = lambda r: F.nullif(r["last_updated"], F.lit(""))
    empty = lambda f: F.coalesce(b[f], F.lit("")) == ""
    given = lambda f: F.coalesce(e[f], F.lit("")) != ""
    number = lambda r: F.nullif(episode_range_numeric(r["episode_range"]), F.lit(0).cast("long"))
    # what several rules ask for is made once
    union = F.when(given("genre") & empty("genre"), e["genre"]).when(given("genre") & (b["genre"] != e["genre"]), genre_union(b["genre"], e["genre"])).otherwise(b["genre"])
    every_tag = F.array_union(F.coalesce(b["tags"], F.array().cast("array<string>")), e["tags"])
    tagged = F.coalesce(F.size(e["tags"]), F.lit(0)) > 0
    names = [c for c in pairs.columns if c not in ("base", "extra")]
    pairs = pairs.withColumns({
        "_better": platform_priority(e["platform"]) < platform_priority(b["platform"]),
        "_newer": dated(e).isNotNull() & F.coalesce(dated(e) > dated(b), F.lit(True)),
        "_b": number(b),
        "_e": number(e),
        "_genre": union,
        "_adult": tagged & F.array_join(every_tag, "\n").rlike("|".join(ADULT)),
    })
    better, newer, br, er, genre, adult = (F.col(c) for c in ("_better", "_newer", "_b", "_e", "_genre", "_adult"))
    pick = lambda f, when: F.when(given(f) & when, e[f]).otherwise(b[f]).alias(f)
    wider = F.when(br.isNotNull() & er.isNotNull(), (er > br) | ((er == br) & newer)).otherwise(empty("episode_range") | newer)
    none = F.coalesce(genre, F.lit("")) == ""
    rated = F.when(adult & none, F.lit("성인물")).when(adult & ~F.contains(genre, F.lit("성인물")), F.concat(F.lit("성인물, "), genre)).otherwise(genre)
    done = F.lit("완결")
    ended = F.contains(e["status"], done) | F.contains(F.coalesce(b["status"], F.lit("")), done)
    status = F.when(given("status") & ended, done).when(given("status") & (empty("status") | newer), e["status"]).otherwise(b["status"])
    unrated = F.coalesce(b["rating"], F.lit(0.0)) == 0
    rating = F.when((e["rating"] > 0) & (unrated | (e["rating"] > b["rating"]) | (newer & (F.abs(e["rating"] - b["rating"]) < 0.1))), e["rating"]).otherwise(b["rating"])
    return pairs.select(
        *names,
        pick("title", better | newer | F.coalesce(b["title"].startswith("#"), F.lit(False))),
        pick("author", empty("author") | better | newer),
        rated.alias("genre"),
        status.alias("status"),
        pick("episode_range", wider),
        F.when(newer, e["last_updated"]).otherwise(b["last_updated"]).alias("last_updated"),
        F.when(better, e["platform"]).otherwise(b["platform"]).alias("platform"),
        rating.alias("rating"),
        pick("cover_url", empty("cover_url") | better | newer),
        F.when(tagged, tag_union(b["tags"], e["tags"])).otherwise(b["tags"]).alias("tags"),
        pick("official_url", empty("official_url")),
    )
