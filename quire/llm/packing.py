"""Packing into optimal length buckets.

The histogram of lengths over all rows (a row for each distinct length) is the only thing that is
gathered. Dynamic programming over it chooses at most `buckets` upper bounds so that padding every
row to its bucket's bound wastes the fewest tokens; the cost is solved exactly with a monotone hull
of lines. Inside each bucket, rows in a hashed order form batches of as many rows as fit the token
budget at the bucket's width (one at least, so a longer row makes a batch of its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_columns, materialize, named, number_rows
from .sstable import encoder

BUCKETS = 16
BUDGET = 65_536


def bucket_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding; histogram: (length, rows) by length.

    best[k][j]: the least padding of the first j lengths in k buckets; with C the rows and S the
    tokens of a prefix, a bucket (i, j] costs length[j] * (C[j] - C[i]) - (S[j] - S[i]), a line in
    length[j] for each i, of falling slope.
    """
    n = len(histogram)
    if not n:
        return []
    length = [h[0] for h in histogram]
    c, s = [0], [0]
    for x, rows in histogram:
        c.append(c[-1] + rows)
        s.append(s[-1] + x * rows)
    best = [0] + [length[j] * c[j + 1] - s[j + 1] for j in range(n)]
    layers: list[list[int]] = []
    for _ in range(1, min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # (slope, offset, i)
        head, after, chosen = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i, slope, offset = j - 1, -c[j - 1], best[j - 1] + s[j - 1]
            while len(hull) - head >= 2:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (offset - b1) * (m1 - m2) <= (b2 - b1) * (m1 - slope):
                    hull.pop()
                else:
                    break
            hull.append((slope, offset, i))
            x = length[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            slope, offset, i = hull[head]
            after[j], chosen[j] = slope * x + offset + x * c[j] - s[j], i
        if after[n] >= best[n]:
            break
        layers.append(chosen)
        best = after
    bounds, j = [], n
    for chosen in reversed(layers):
        bounds.append(length[j - 1])
        j = chosen[j]
    if j:
        bounds.append(length[j - 1])
    return bounds[::-1]


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """id_col, length_col, bucket, width (padded length), batch (0.. in its bucket), slot (0.. in its
    batch) and padding of each row.

    A null or negative length counts as 0. Repeated rows are packed each, rows whose hashes tie by id and
    then by place; an empty table gives none. The driver holds the distinct lengths, no more than the
    longest text has tokens.
    """
    slim = materialize(lengths.select(named(id_col).alias("_id"), F.greatest(F.coalesce(named(length_col), F.lit(0)), F.lit(0)).cast("long").alias("_n")), "lengths")
    histogram = [(r["_n"], r["count"]) for r in slim.groupBy("_n").count().orderBy("_n").collect()]
    bounds = bucket_bounds(histogram, buckets) or [0]
    widths = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(widths, lambda b: b < F.col("_n")))
    placed = slim.withColumn("bucket", bucket.cast("int")).withColumn("_h", F.xxhash64("_id"))
    ranked, _ = number_rows(placed, ["bucket", "_h", "_id"], within="bucket", label="packed")
    width = F.element_at(widths, F.col("bucket") + 1)
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(width, F.lit(1))))
    out = ranked.withColumn("width", width).withColumn("_rows", rows)
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias(length_col), "bucket", "width", F.floor(F.col("rank_no") / F.col("_rows")).alias("batch"), (F.col("rank_no") % F.col("_rows")).alias("slot"), (F.col("width") - F.col("_n")).alias("padding"))


def token_lengths(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and n_tokens: how many ids the token-id shards would hold for each whole text (null: 0)."""

    def start():
        encode, _, width = encoder(tokenizer)
        return lambda ids, texts: [ids, [len(encode(t or "")) // width for t in texts]]

    rows = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return map_columns(rows, f"id {df.schema[id_col].dataType.simpleString()}, n_tokens long", start).toDF(id_col, "n_tokens")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, width, batch, slot and padding of every document; nulls, repeats, ties and
    empty tables as in pack."""
    import public_tokenizers

    return pack(token_lengths(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
