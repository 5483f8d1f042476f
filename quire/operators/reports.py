"""Reports rendered from rows: summaries of chapters, the library page, and what a conversion lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
RULE = "-" * 48
NO_SUMMARY = "(No Summary)"
CARD = """<div class="book-card" data-book-id="%1$s">
    <img src="/covers/%1$s" alt="%2$s" onerror="this.style.backgroundColor='#bdc3c7'">
    <h3>%2$s</h3>
    <p class="author">%3$s</p>
    <div class="actions">
        <a href="/reader/%1$s">Read</a>
        <button class="delete" data-id="%1$s">Delete</button>
    </div>
</div>"""
NO_BOOKS = """<div class="empty-state">
    <h2>No books yet</h2>
    <p>Upload your first EPUB to get started!</p>
</div>"""
LOSS = {
    "chinese": {"title": "TXT转EPUB文字内容完整性验证报告", "table": "📊 转换前后对比", "headers": "| 项目 | 转换前 | 转换后 | 差异 | 丢失率 |", "cjk": "中文字符", "latin": "英文字符", "marks": "标点符号", "total": "**总字符数**", "pass": "✅ 验证结果：通过", "fail": "❌ 验证结果：失败"},
    "english": {"title": "TXT to EPUB Content Integrity Validation Report", "table": "📊 Before/After Comparison", "headers": "| Item | Before | After | Difference | Loss Rate |", "cjk": "Chinese characters", "latin": "English characters", "marks": "Punctuation", "total": "**Total Characters**", "pass": "✅ Validation Result: PASSED", "fail": "❌ Validation Result: FAILED"},
}


def json_text(c: Column) -> Column:
    """c as a JSON string, or null."""
    made = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), "null").otherwise(F.substr(made, F.lit(6), F.length(made) - 6))


def summary_reports(chapters: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id, plain, markdown, json: a document's chapters (doc_id, cid, title, length) by cid with their
    summaries (doc_id, cid, summary)."""
    rows = chapters.join(summaries, ["doc_id", "cid"], "left").withColumn("summary", F.coalesce("summary", F.lit(NO_SUMMARY)))
    item = F.struct("cid", "title", "length", "summary")
    got = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("c"))

    def joined(start: str, each) -> Column:
        return F.array_join(F.concat(F.array(F.lit(start)), F.transform("c", each)), "\n")

    plain = joined("=== Novel Summary Report ===\n", lambda x: F.concat(F.lit(f"\n{RULE}\n["), x["title"], F.lit(f"]\n{RULE}\n"), x["summary"], F.lit("\n")))
    markdown = joined("# Novel Summary Report\n", lambda x: F.concat(F.lit("\n## "), x["title"], F.lit("\n\n"), x["summary"], F.lit("\n\n---\n")))
    entry = lambda x: F.concat(F.lit('    {\n      "cid": '), x["cid"].cast("string"), F.lit(',\n      "title": '), json_text(x["title"]), F.lit(',\n      "length": '), x["length"].cast("string"), F.lit(',\n      "summary": '), json_text(x["summary"]), F.lit("\n    }"))
    made = F.concat(F.lit('{\n  "title": "Novel Summary Report",\n  "total_chapters": '), F.size("c").cast("string"), F.lit(',\n  "chapters": [\n'), F.array_join(F.transform("c", entry), ",\n"), F.lit("\n  ]\n}"))
    return got.select("doc_id", plain.alias("plain"), markdown.alias("markdown"), made.alias("json"))


def escape_html(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def book_cards(books: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """books: id, title, author -> id, html, and the columns `also`. One card a book; the page is the cards in one
    gallery."""
    key = escape_html(F.col("id").cast("string"))
    return books.select("id", *also, F.format_string(CARD, key, escape_html(F.col("title")), F.coalesce(escape_html(F.col("author")), F.lit("Unknown Author"))).alias("html"))


def library_pages(books: DataFrame, shelf: str) -> DataFrame:
    """shelf, html: the gallery of each shelf's books by id, one card a row (an id may stand on several); a shelf
    whose rows have no id is empty."""
    by_id = book_cards(books.filter("id is not null"), (shelf,)).groupBy(shelf).agg(F.sort_array(F.collect_list(F.struct("id", "html"))).alias("c"))
    rows = books.select(shelf).distinct().join(by_id, shelf, "left")
    body = F.coalesce(F.array_join(F.transform("c", lambda x: x["html"]), ""), F.lit(NO_BOOKS))
    return rows.select(shelf, F.concat(F.lit('<main><div id="gallery">'), body, F.lit("</div></main>")).alias("html"))


def _lost(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0.0).otherwise((before - after) / before * 100)


def _grouped(c: Column) -> Column:
    return F.format_number(c, 0)


def loss_reports(counts: DataFrame, language: str = "english") -> DataFrame:
    """counts: doc_id and, before and after (prefixes a_ and b_), cjk, latin, marks, total -> doc_id, passed, report.

    The report has the table of counts and the verdict: at most 1 % of Chinese letters and of all characters
    and 2 % of English ones may be lost.
    """
    say = LOSS[language]
    rate = {k: _lost(F.col(f"a_{k}"), F.col(f"b_{k}")) for k in ("cjk", "latin", "total")}
    passed = (rate["cjk"] <= 1) & (rate["latin"] <= 2) & (rate["total"] <= 1)

    def row(k: str, strong: str = "") -> Column:
        diff = F.col(f"b_{k}") - F.col(f"a_{k}")
        shown = F.when(diff > 0, F.concat(F.lit("+"), _grouped(diff))).otherwise(_grouped(diff))
        loss = F.when(rate[k] > 0, F.concat(F.format_number(rate[k], 2), F.lit("%"))).otherwise("0%") if k in rate else None
        cells = [_grouped(F.col(f"a_{k}")), _grouped(F.col(f"b_{k}")), shown] + ([loss] if loss is not None else [])
        cells = [F.concat(F.lit(strong), c, F.lit(strong)) for c in cells] + ([] if loss is not None else [F.lit("-")])
        return F.concat(F.lit(f"| {say[k]} | "), F.concat_ws(" | ", *cells), F.lit(" |"))

    head = f"# {say['title']}\n\n## {say['table']}\n\n{say['headers']}\n|------|--------|--------|------|--------|"
    body = [F.lit(head), row("cjk"), row("latin"), row("marks"), row("total", "**"), F.lit(""), F.concat(F.lit("## "), F.when(passed, say["pass"]).otherwise(say["fail"]))]
    return counts.select("doc_id", passed.alias("passed"), F.concat_ws("\n", *body).alias("report"))
