"""Headings of books in two languages: their forms, their validity, and better titles for bare numbers.

A heading is a whole line, so every form is matched against one line. Functions that depend on the
language take a column that holds 'chinese' or 'english'.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE, squeeze, strip

# fixed values
_ZH_NUMBER = "[一二三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟萬]+|[0-9]{1,3}"
_ZH_SPECIAL = "番外|番外篇|外传|特别篇|插话|后记|尾声|终章|楔子|序章"
_ZH_REMARK = "(?:[（(][^\r\n）)]{0,20}[）)])?"
_ROMAN = "(?:C|XC|L?X{0,3})(?:IX|IV|V?I{0,3})"
_WORDS = "(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen|Fourteen|Fifteen|Sixteen|Seventeen|Eighteen|Nineteen|Twenty|Thirty|Forty|Fifty|Sixty|Seventy|Eighty|Ninety|Hundred)"
_END = "[ \t]*\r?\\z"
FORMS = {
    "chinese": {
        "volume": f"^[ \t]*(第(?:{_ZH_NUMBER})[卷部篇](?:[ \t　]+[^\r\n]{{0,40}})?){_END}",
        "chapter": f"^([ \t\r]*(?:[0-9]{{1,4}}[.、])?[ \t]*(?:[【\\[]?第(?:{_ZH_NUMBER})章[】\\]]?(?:(?:[ \t　]+|：|:)?[【\\[]?[^\r\n【】\\[\\]]{{1,50}}[】\\]]?{_ZH_REMARK})?|[【\\[]?(?:{_ZH_SPECIAL})[】\\]]?(?:(?:[ \t　]+|：|:)?[^\r\n，。！？；]{{1,50}}{_ZH_REMARK})?)){_END}",
        "section": f"^[ \t]*(第(?:{_ZH_NUMBER})节(?:[ \t　]+[^\r\n]{{0,40}})?){_END}",
        "numbered": "\\z.",
    },
    "english": {
        "volume": f"(?i)^[ \t]*((?:Part|Book|Volume)[{SPACE}]+(?:{_ROMAN}|[0-9]{{1,3}}|{_WORDS})(?::[{SPACE}]*[^\r\n]{{0,60}})?){_END}",
        "chapter": f"(?i)^[ \t]*((?:Chapter|Ch\\.?|Chap\\.?)[{SPACE}]+(?:{_ROMAN}|[0-9]{{1,3}}|{_WORDS})(?:[:.][{SPACE}]*[^\r\n]{{0,60}})?){_END}",
        "section": f"(?i)^[ \t]*((?:Section|Sect\\.?)[{SPACE}]+(?:[0-9]{{1,3}}(?:\\.[0-9]+)?|{_WORDS})(?:[:.][{SPACE}]*[^\r\n]{{0,60}})?){_END}",
        "numbered": f"^([{SPACE}]*[0-9]+\\.[0-9]+[{SPACE}]+[^\n]+)\\z",
    },
}
TOC_WORDS = {"chinese": ["目录", "章节目录", "目　录", "正文目录", "书籍目录", "小说目录"], "english": ["Contents", "Table of Contents", "TOC"]}
NAMES = {
    "chinese": {"preface": "前言", "volume_preface": "序言", "content": "正文", "section_preface": "章节序言", "empty_chapter": "此章节内容为空。", "empty_section": "此节内容为空。", "unknown": "未知内容", "unparsed": "无法解析文档结构，请检查文档格式。"},
    "english": {"preface": "Preface", "volume_preface": "Preface", "content": "Content", "section_preface": "Chapter Preface", "empty_chapter": "This chapter is empty.", "empty_section": "This section is empty.", "unknown": "Unknown Content", "unparsed": "Unable to parse document structure. Please check document format."},
}
EMPTY = ("Empty Content", "This document is empty or cannot be parsed.")
ZH_REFERENCE, ZH_LISTED = "[在如见到自从正前后于从到至]第.{0,5}章", "[，,、；;]第.{0,5}章"
EN_REFERENCE = f"(?i)(?:in|see|from|at|to|of|for)[{SPACE}]+Chapter[{SPACE}]+[\\p{{L}}\\p{{N}}_]"
ZH_CHAPTER = "第[一二三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟萬0-9]{1,4}章"
ZH_GOES_ON, ZH_ANOTHER = f"^[{SPACE}]*[结束时中里，,]", f"^[{SPACE}]{{0,50}}.{{0,50}}第.{{1,8}}章"
EN_GOES_ON, EN_ANOTHER = f"(?i)^[{SPACE}]*(?:ends?|of|in|at)[{SPACE}]", f"(?i)^[{SPACE}]{{0,10}}Chapter[{SPACE}]+[0-9IVX]"
ZH_SIMPLE = "^(?:第[一二三四五六七八九十百千万0-9]+章|[0-9]+)$"
EN_SIMPLE = f"(?i)^(?:Chapter[{SPACE}]+[0-9]+|Ch\\.?[{SPACE}]+[0-9]+|Chapter[{SPACE}]+[IVX]+|[0-9]+)$"
ZH_LABEL, EN_LABEL = "(第[一二三四五六七八九十百千万0-9]+章)", f"(?i)(Chapter[{SPACE}]+[0-9IVX]+)"
ZH_OPENERS = f"^(?:话说|且说|却说|却说|正是|正所谓|古人云|俗语说)[{SPACE}]*"
EN_LINKS = "(?i)(?:^|[^\\p{L}\\p{N}_])(?:the|a|an|is|are|was|were|in|on|at|to|for)(?:[^\\p{L}\\p{N}_]|$)"
ZH_BREAKS = [",", "，", ":", "：", " ", "　"]


def by_language(language: Column, chinese: Column, english: Column) -> Column:
    return F.when(language == "chinese", chinese).otherwise(english)


def _folded(pattern: str) -> str:
    """A form whose letters have any case. Long s and the Kelvin sign are an s and a k, as in the SQL; Java's (?i) folds
    ASCII alone, and with (?iu) a dotless i would be an i too."""
    if not pattern.startswith("(?i)"):
        return pattern
    return re.sub("[sk]", lambda m: {"s": "[s\u017f]", "k": "[k\u212a]"}[m[0].lower()], pattern, flags=re.IGNORECASE)


def is_form(line: Column, language: Column, form: str) -> Column:
    return by_language(language, *(line.rlike(_folded(FORMS[k][form])) for k in ("chinese", "english")))


def form_title(line: Column, language: Column, form: str) -> Column:
    return strip(by_language(language, *(F.regexp_extract(line, _folded(FORMS[k][form]), 1) for k in ("chinese", "english"))))


def name(language: Column, key: str) -> Column:
    return by_language(language, F.lit(NAMES["chinese"][key]), F.lit(NAMES["english"][key]))


def is_genuine(line: Column, before: Column, after: Column, at: Column, size: Column, language: Column) -> Column:
    """A chapter heading that is neither an entry of a list nor a reference in running text.

    before and after: up to 30 and 300 characters of the text around the line; at: its place in a text of
    `size` characters.
    """
    title = strip(line)
    listed = (at < size * 0.15) & (F.regexp_instr(F.substring(after, 1, 200), F.lit(ZH_CHAPTER)).between(1, 150))
    chinese = (
        ~F.concat(F.right(before, F.lit(20)), F.substring(title, 1, 10)).rlike(ZH_REFERENCE)
        & ~F.concat(F.right(before, F.lit(10)), F.substring(title, 1, 10)).rlike(ZH_LISTED)
        & ~after.rlike(ZH_GOES_ON)
        & ~F.substring(after, 1, 100).rlike(ZH_ANOTHER)
        & (F.regexp_count(after, F.lit(ZH_CHAPTER)) < 2)
    )
    english = ~F.concat(before, F.substring(title, 1, 20)).rlike(EN_REFERENCE) & ~after.rlike(EN_GOES_ON) & ~F.substring(after, 1, 30).rlike(EN_ANOTHER)
    return ~listed & (F.length(title) <= 100) & by_language(language, chinese, english)


def is_bare(title: Column, language: Column) -> Column:
    """Whether a title is a number alone; a null or empty title is."""
    t = strip(F.coalesce(title, F.lit("")))
    zh = t.rlike(ZH_SIMPLE) | ((F.length(t) <= 5) & F.contains(t, F.lit("第")) & F.contains(t, F.lit("章")))
    return (F.coalesce(title, F.lit("")) == "") | by_language(language, zh, t.rlike(EN_SIMPLE))


def _before_last(text: Column, mark: str) -> Column:
    return F.regexp_extract(text, f"(?s)^(.*){mark}", 1)


def found_title(content: Column, language: Column, most: int = 20) -> Column:
    """A title taken from the content: its first fitting sentence, or else its beginning; '' if it has neither."""
    body = strip(F.coalesce(content, F.lit("")))
    zh = F.regexp_replace(body, ZH_OPENERS, "")

    def first(text: Column, marks: str, least: int, words: str) -> Column:
        found = F.filter(F.transform(F.split(text, marks), lambda s: strip(s)), lambda s: F.length(s).between(least, 2 * most) & s.rlike(words))
        return F.get(found, F.lit(0))

    sentence = first(zh, "[。！？；]", 5, "[的之在了是]")
    head, cut = F.substring(sentence, 1, most), None
    for mark in ZH_BREAKS:
        has = F.contains(head, F.lit(mark))
        cut = F.when(has, _before_last(head, mark)) if cut is None else cut.when(has, _before_last(head, mark))
    start = F.substring(zh, 1, most)
    whole = F.coalesce(F.nullif(F.regexp_extract(start, "(?s)^(.+)[ ，。！？；：]", 1), F.lit("")), start)
    chinese = F.when(sentence.isNotNull(), F.when(F.length(sentence) > most, F.coalesce(cut, head)).otherwise(sentence)).when(F.length(zh) >= 5, F.when(F.length(zh) > most, whole).otherwise(zh))

    sentence = first(body, "[.!?;]", 10, EN_LINKS)
    start = squeeze(strip(F.substring(body, 1, most)))
    english = F.when(sentence.isNotNull(), squeeze(strip(F.substring(sentence, 1, most)))).when(F.length(body) >= 10, F.regexp_replace(start, " [^ ]*$", ""))
    return strip(F.coalesce(by_language(language, chinese, english), F.lit("")))


def enhanced(title: Column, content: Column, language: Column) -> Column:
    """A bare number with a title found in the content; other titles stay."""
    label = F.coalesce(F.nullif(by_language(language, F.regexp_extract(title, ZH_LABEL, 1), F.regexp_extract(title, EN_LABEL, 1)), F.lit("")), title)
    more = found_title(content, language)
    return F.when(is_bare(title, language) & (more != ""), F.concat(label, by_language(language, F.lit(" "), F.lit(": ")), more)).otherwise(title)


def chapter_confidence(title: Column, content: Column, language: Column) -> Column:
    n = F.length(strip(content))
    zh = F.when(title.rlike("^第[一二三四五六七八九十百千万0-9]+章"), 0.2).otherwise(0.0)
    special = F.when(title.rlike(f"^(?:{_ZH_SPECIAL})"), 0.15).otherwise(0.0)
    en = F.when(title.rlike(f"(?i)^Chapter[{SPACE}]+[0-9IVX]"), 0.2).otherwise(0.0)
    score = F.lit(0.5) + by_language(language, zh, en) + by_language(language, special, F.lit(0.0))
    score = score + F.when(n > 1000, 0.15).when(n > 500, 0.1).when(n < 100, -0.2).otherwise(0.0) + F.when(is_bare(title, language), 0.0).otherwise(0.1)
    prose = by_language(language, content.rlike("[。！？；]"), content.rlike(f"[.!?][{SPACE}]+[A-Z]"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + F.when(prose, 0.05).otherwise(0.0)))
