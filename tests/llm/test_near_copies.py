"""The pipeline's near-copy stage against brute force over all pairs' Jaccard similarity."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def least_of_group(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * both >= 4 * either:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def made():
    rng = random.Random(11)
    out = []
    for n in [8, 30, 90, 300, 1200] * 8:
        words = [f"w{rng.randrange(500)}" for _ in range(n)]
        out.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            copy = list(words)
            for _ in range(rng.randint(1, max(1, n // 40))):
                copy[rng.randrange(n)] = "changed"
            out.append(" ".join(copy[: rng.randint(n * 9 // 10, n)]))
    return [*out, None, "", " ", "one two", "ONE  two"]


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "block_bytes": 2000}])
def test_near_copies(spark, sizes):
    texts = made()
    root = least_of_group(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in near_copies.keep_one(docs, **sizes).collect()}
    assert kept == {i for i, r in enumerate(root) if r == i} and len(kept) < len(texts) - 20
    lost = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None), (7, "")], "doc_id long, text string")
    assert sorted(near_copies.keep_one(lost).collect(), key=str) == [(7, ""), (None, "a b c d")]
    assert near_copies.keep_one(docs.filter("false")).count() == 0


def test_pipeline_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    root = least_of_group([r.text for r in rows])
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got) == [r.doc_id for i, r in enumerate(rows) if root[i] == i]


def test_recall_of_planted_pairs(spark):
    """500 pairs of distinct sets with a similarity of 0.8 to 0.86: every link is found."""
    rng = random.Random(2)
    texts, pairs = [], []
    while len(pairs) < 500:
        n = rng.choice([12, 40, 150, 600])
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        copy = list(words)
        for _ in range(max(1, n // 50)):
            copy[rng.randrange(n)] = "changed"
        copy = copy[: n - rng.randrange(1 + n // 12)]
        a, b = " ".join(words), " ".join(copy)
        x, y = shingles(a), shingles(b)
        if 0.8 <= len(x & y) / len(x | y) <= 0.86:
            pairs.append((len(texts), len(texts) + 1))
            texts += [a, b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    assert kept == {a for a, _ in pairs}


def test_tiles_are_skipped_by_size_and_bits():
    rng = np.random.default_rng(4)
    n = np.sort(rng.integers(1, 5000, 4000))
    f = [rng.integers(0, 1 << 63, 4000, np.uint64) for _ in range(2)]
    f[0][1], f[1][1] = f[0][0], f[1][0]
    n[1] = n[0]
    seen = {}
    a, b = near_copies.room_links(np.zeros(4000, np.int64), n, *f, np.arange(4000), seen=seen)
    assert (a.tolist(), b.tolist()) == ([1], [0]) and seen["skipped"] > seen["compared"]
