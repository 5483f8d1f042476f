"""Secret scans by an incremental ledger of content-addressed blobs.

A path (a document id, a file name) may have had many versions, and many paths may have had one content. Every
version is addressed by the SHA-256 of its text, its blob. The ledger holds, for each blob, the rules (kind and
version of the rule) that it was scanned with and what they found, and it never forgets a blob. An update looks
up which pairs of blob and rule version are unseen and scans only those, each blob once however many rows have
it: after more rows only new blobs are read, after a rule's new version all blobs are read with that rule alone.
Findings are joined back to every path that ever had the blob.

What is decided, is decided on narrow tables (digest, locator); texts are shuffled once, to the rows that name
the chosen copy, by locators, which no two rows share. An update is a folder of the ledger that counts once its
write is committed (_SUCCESS); one that was broken off is written again.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_hot, map_columns, materialize, named, shared_path
from .exact_dedup import located, sha256


class Rule(NamedTuple):
    """Matches of `pattern` whose `group` has `least` characters or more, leftmost and not overlapping."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Code points, end exclusive. Shorter matches are dropped, but what they cover is used up."""
        return [m.span() for m in re.finditer(self.pattern, text) if m.end(self.group) - m.start(self.group) >= self.least]


def any_case(word: str) -> str:
    """A pattern for the ASCII letters of word in either case (and no other letters that fold to them)."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)


_WORDS = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The fixed rules, in the order of their kinds, and further ones. All take time linear in the text.
BASE = (
    Rule("assign", 1, rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, "[0-9a-f]{24,}"),  # whole runs: a shorter run has no match
)
ADDED = (
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", 1, r"://[A-Za-z0-9._~%+-]{1,64}:[A-Za-z0-9._~%+!$*-]{1,64}@"),
    Rule("hub", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED
FOUND = "array<struct<rule:string,start:long,end:long>>"


class Ledger:
    """A ledger in the folder `path`, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = f"digest string, rules array<string>, found {FOUND}"

    def _committed(self) -> tuple[list[str], int]:
        """The folders of committed updates, and the next update's number."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return [], 0
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("update="))
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return [f"{self.path}/{n}" for n in done], len(done)

    def scans(self) -> DataFrame:
        """digest, rules and found of every scan so far (a blob has one row for each update that scanned it)."""
        paths = self._committed()[0]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def due(self, blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The rows of blobs (one a digest) with unseen pairs, and `todo`, the names of the rules that are unseen."""
        seen = self.scans().select("digest", F.explode("rules").alias("rule")).groupBy("digest").agg(F.collect_set("rule").alias("seen"))
        todo = F.array_except(F.array(*[F.lit(r.name) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "digest", "left").withColumn("todo", todo).drop("seen").filter(F.size("todo") > 0)

    def update(self, df: DataFrame, path_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
        """Scans the unseen pairs of the versions in df (null counts as empty). Returns path and digest of each
        row of df, and digest and n_refs (how many rows have it) of each blob."""
        by_name = {r.name: r for r in rules}
        table, at = located(df)
        placed = table.select(named(path_col).alias("path"), F.coalesce(named(text_col), F.lit("")).alias("text"), F.col(at).alias("locator"))
        refs = materialize(placed.select("path", sha256(F.col("text")).alias("digest"), "locator"), "blob-references")
        blobs = materialize(refs.groupBy("digest").agg(F.min("locator").alias("locator"), F.count(F.lit(1)).alias("n_refs")), "blobs")
        due = materialize(self.due(blobs.drop("n_refs"), rules), "due-blobs")

        def start():
            def each(digests, todo, texts):
                found = [[{"rule": n, "start": a, "end": b} for n in names for a, b in by_name[n].spans(text)] for names, text in zip(todo, texts)]
                return [digests, todo, found]

            return each

        if not due.isEmpty():
            # one plan at every size: the narrow side is the one that is held
            texts = placed.select("locator", "text").join(due.hint("shuffle_hash"), "locator").select("digest", "todo", "text")
            number = self._committed()[1]
            map_columns(texts, self.schema, start).write.mode("overwrite").parquet(f"{self.path}/update={number:09d}")
        return refs.drop("locator"), blobs.drop("locator")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """digest, and found of all scans with the given rules, of each blob that they found something in."""
        names = [r.name for r in rules]
        each = self.scans().select("digest", F.filter("found", lambda f: f["rule"].isin(names)).alias("found")).filter(F.size("found") > 0)
        return each.groupBy("digest").agg(F.flatten(F.collect_list("found")).alias("found"))


def kind_of(rule: Column) -> Column:
    return F.substring_index(rule, "@", 1)


def joined_spans(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans of the given rules, by start and then kind as listed, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    mine = F.filter(found, lambda f: F.array_contains(kinds, kind_of(f["rule"])))
    rows = F.transform(mine, lambda f: F.struct(f["start"].alias("start"), F.array_position(kinds, kind_of(f["rule"])).alias("k"), F.concat_ws(":", kind_of(f["rule"]), f["start"], f["end"]).alias("s")))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["s"]), ",")


def scan(df: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row's id_col, digest, found (spans of all rules) after an update of the ledger with df.

    Null and empty texts have no spans; repeated rows get a row each; a null id is a path like any other; an
    empty table scans nothing and gives no row. A blob with many spans is one row, no longer than its text.
    """
    refs, blobs = ledger.update(df, id_col, text_col, rules)
    found = F.coalesce("found", F.array().cast(FOUND)).alias("found")
    blobs = materialize(blobs.join(ledger.findings(rules), "digest", "left").select("digest", "n_refs", found), "blob-findings")
    return join_hot(refs, blobs, "digest", F.col("n_refs")).select(F.col("path").alias(id_col), "digest", "found")


def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; nulls, repeats and empty tables
    as in scan. The ledger is a new one: every blob is unseen."""
    got = scan(documents(spark, sf_dir), Ledger(spark, shared_path(spark, "secret-ledger")))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: kind_of(f["rule"]) == kind)).cast("long").alias(f"n_{kind}")

    return got.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined_spans(F.col("found"), BASE), 256).alias("base_sha256"), joined_spans(F.col("found"), RULES).alias("spans"))


def _spans_sql(at: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {at} AS k, '{rule.kind}' AS kind, t, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {rule.group}) AS parts, {rule.least} AS least, string_split_regex(t, '{pattern}') AS pieces FROM d"""


ORACLE_SQL = {
    "op12_secret_ledger": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        e AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(RULES))}),
        x AS (SELECT doc_id, k, kind, hits, parts, least, pieces, unnest(range(1, len(hits) + 1)) AS i FROM e WHERE len(hits) > 0),
        y AS (SELECT doc_id, k, kind, (list_sum(list_transform(pieces[:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda p: length(p))), 0))::BIGINT AS s,
              length(hits[i]) AS n FROM x WHERE length(parts[i]) >= least),
        z AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
              coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '') AS base,
              string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans FROM y GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN z USING (doc_id)
    """
}
