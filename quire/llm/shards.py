"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 .. N-1 by id. A keyed Feistel network permutes the numbers of the next power of
four, and a value of N or more is sent through again (cycle walking) until it falls below N, so the
whole is a permutation of 0 .. N-1 that anyone can compute from the key, N and the number. With p the
permuted number, shard = p mod S and slot = p div S: shard sizes differ by one row at most, slots are
gapless, and the order in every shard is a shuffle. The inverse gives the row of any shard and slot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_columns, materialize, named, number_rows

ROUNDS = 6


def _mix(x: np.ndarray, key: int, round_no: int) -> np.ndarray:
    x = x + np.uint64((key * 0x9E3779B97F4A7C15 + round_no * 0xD1B54A32D192ED03 + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, bits: int, key: int, inverse: bool) -> np.ndarray:
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> half, x & mask
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        if inverse:
            left, right = right ^ (_mix(left, key, r) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key, r) & mask)
    return left << half | right


def permute(numbers: np.ndarray, n: int, key: int = 0, inverse: bool = False) -> np.ndarray:
    """The permutation of 0 .. n-1 (or its inverse) at `numbers`."""
    out = np.asarray(numbers, np.uint64).copy()
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    walking = np.arange(len(out))
    while len(walking):
        out[walking] = _network(out[walking], bits, key, inverse)
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def with_shards(df: DataFrame, order: list[str], shards: int = 16, key: int = 0) -> DataFrame:
    """The columns of df (narrow: no texts) with row_no, permuted, shard and slot.

    Equal rows of a table are told apart by their place in the input; nulls come first. Columns of df called
    row_no, permuted, shard or slot are replaced; an empty table gives an empty result.
    """
    numbered, n = number_rows(df, order, label="row-numbers")
    names = [c for c in numbered.columns if c not in ("permuted", "shard", "slot")]
    plain = numbered.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)])
    kinds = [(f.name, f.dataType.simpleString()) for f in plain.schema]

    def start():
        at = names.index("row_no")

        def each(*values):
            p = permute(np.array(values[at], np.uint64), n, key)
            return [*values, p, p % shards, p // shards]

        return each

    out = map_columns(plain, ", ".join(f"{k} {v}" for k, v in kinds) + ", permuted long, shard int, slot long", start)
    return out.toDF(*names, "permuted", "shard", "slot")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard and slot of every document. A null text has no bytes
    (size 1); repeated rows get a slot each; an empty table gives none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    got = with_shards(materialize(slim, "sizes"), ["doc_id", "size", "text_crc32"])
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
