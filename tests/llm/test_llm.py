"""Each operator against a library, a brute-force version or a round trip, on small tables with
nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

import hashlib
import itertools
import random
import subprocess
import sys
import zlib
from datetime import date

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import exact_dedup, gif, language_id, packing, pii, sentencepiece_bpe, shards, simhash, sstable, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, _text string, digest string"
WORDS = "the of and to ation ing er és ß été 中文 🎉 x1 23 ' 's ... <|endoftext|> <s> 　 \x1c á İ ++".split(" ")


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "", ", ", ". "]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    return [*made, *made[:7], None, None, "", " ", "\n\n", "one", "two words", "ab" * 6000, "word " * 4000, "a" * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 0, 9, "clash", "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "no id", None, None, None, None, None, None)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    by_text = {r.text: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    got = docs.select("doc_id", "text").join(token_counts.with_token_counts(docs, path).distinct(), "doc_id").collect()
    assert len(got) == docs.filter("doc_id is not null").count()
    assert all(r.n_tokens == by_text[r.text] and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.with_token_counts(empty, path).count() == 0


def test_state_maps_compose():
    m = token_counts.Transducer([("a", "b"), ("ab", "a"), ("b", "a")], {"a", "b", "ab", "aba", "ba"})
    rng = random.Random(1)
    for _ in range(50):
        s = "".join(rng.choices("ab", k=rng.randint(1, 60)))
        maps = [token_counts.StateMap.of(m, s[i : i + 7], {0}) for i in range(0, len(s), 7)]
        assert token_counts.prefix_scan(maps) == [m.run(0, s[: i + 7]) for i in range(0, len(s), 7)]


def test_one_very_long_word():
    """Compositions are one fewer than blocks, and memory does not grow with the square of a word."""
    script = """
import random, resource, public_tokenizers
from quire.llm import token_counts
made = [0]
then = token_counts.StateMap.then
token_counts.StateMap.then = lambda a, b: (made.__setitem__(0, made[0] + 1), then(a, b))[1]
unit = "".join(random.Random(1).choices("etaoinshrdlu", k=400_000))
c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
one, two = c.counts([unit * 25])[0], c.counts([unit * 50])[0]
print(one, two, made[0], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    one, two, made, peak = map(int, subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True).stdout.split())
    blocks = [-(-n * 400_000 // token_counts.BLOCK) for n in (25, 50)]
    assert made == sum(blocks) - 2 and peak < 700
    unit = "".join(random.Random(1).choices("etaoinshrdlu", k=400_000))
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    once, twice, thrice = (len(tokenizer.encode(unit * n, add_special_tokens=False).ids) for n in (1, 2, 3))
    assert thrice - twice == twice - once  # so each further copy adds as many tokens
    assert (one, two) == (once + 24 * (twice - once), once + 49 * (twice - once))


def test_sentencepiece(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in sentencepiece_bpe.piece_digests(docs, path).collect()}
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert tuple(got[r.doc_id])[1:] == want
    assert all(list(r.ids) == sp.encode(r.text or "") for r in docs.select("doc_id", "text").join(sentencepiece_bpe.with_pieces(docs, path), "doc_id").collect())
    assert sentencepiece_bpe.piece_digests(empty, path).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash(spark, docs, empty):
    rows = docs.filter("doc_id is not null").select("doc_id", "text").distinct().orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    comp = plain_components(fps)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == {r.doc_id: (f, rows[c].doc_id) for r, f, c in zip(rows, fps, comp)}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_simhash_keeps_one(spark, docs, empty):
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    groups = {}
    for r, c in zip(rows, plain_components(fps)):
        groups.setdefault(c, []).append(r.doc_id)
    want = [min((i is None, i or 0) for i in ids) for ids in groups.values()]
    got = [(r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(docs).collect()]
    assert sorted(got) == sorted(want) and len(got) < len(rows)
    lost = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None), (7, "")], "doc_id long, text string")
    assert sorted(simhash.keep_one(lost).collect(), key=str) == [(7, ""), (None, "a b c d")]
    assert simhash.keep_one(empty).count() == 0


def test_tiles_and_components(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)} | {(1 << k) - 1 for k in range(0, 64, 3)})
    want = {}
    for v, c in zip(values, plain_components(values)):
        want.setdefault(c, set()).add(v)
    want = {frozenset(s) for s in want.values()}

    def groups(pairs):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for v in values:
            out.setdefault(find(v), set()).add(v)
        return {frozenset(s) for s in out.values()}

    arr = np.array(values, np.uint64)
    pairs = {(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 3}
    order = np.argsort(np.bitwise_count(arr), kind="stable")
    for tile in (4, 16, 1024):
        a, b = simhash.bucket_links(arr, np.zeros(len(arr), int), 3, tile)
        assert groups(zip(a.tolist(), b.tolist())) == want and len(a) < len(values)
        seen = {}
        found = [(int(order[x]), int(order[y])) for i, j in simhash.tile_pairs(arr[order], np.zeros(len(arr), int), 3, tile, seen) for x, y in zip(i, j)]
        assert len(found) == len(pairs) and {tuple(sorted(p)) for p in found} == pairs
        assert (seen.get("skipped", 0) > 0) == (tile < 1024) and seen["compared"] > 0
    rooms = np.array(sorted(rng.randrange(40) for _ in values))
    order = np.lexsort((np.bitwise_count(arr), rooms))
    for tile in (4, 16):  # several buckets in a tile, and buckets of several tiles
        found = {tuple(sorted((int(order[x]), int(order[y])))) for i, j in simhash.tile_pairs(arr[order], rooms[order], 3, tile) for x, y in zip(i, j)}
        assert found == {(a, b) for a, b in pairs if rooms[a] == rooms[b]}
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    # with blocks of 7, buckets are divided by further bands and dealt to parts that meet two by two
    for block, levels in ((simhash.BLOCK, simhash.LEVELS), (7, 3), (7, 1), (1, 2)):
        found = simhash.links(frame, block=block, levels=levels)
        for few in (simhash.FEW_LINKS, 0):
            assert groups([(r.node % (1 << 64), r.component % (1 << 64)) for r in simhash.components(found, few=few).collect()]) == want
    cells = simhash.dealt_bands(frame, block=7, levels=1).groupBy("path", "cell").count()
    assert cells.filter("cell > 0").count() > 0
    assert simhash.dealt_bands(frame, block=7).count() > 4 * len(values)
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    for few in (simhash.FEW_LINKS, 0):
        assert {r.component for r in simhash.components(chain, few=few).collect()} == {0}


def test_arrivals_meet_earlier_ones(spark, tmp_path):
    """Rows of one file are dealt to several batches; groups grow over batches, in state that was filled before."""
    rows = [(i, f"digest {i % 50}", f"at {i:04d}") for i in range(1000)]
    arrivals = exact_dedup.deal_arrivals(spark.createDataFrame(rows, "id long, digest string, locator string").coalesce(1), f"{tmp_path}/arrivals")
    state = exact_dedup.stream_state(arrivals, f"{tmp_path}/arrivals", f"{tmp_path}/state")
    assert {(r.digest, r.keep_id, r.group_size) for r in state.collect()} == {(f"digest {i}", 950 + i, 20) for i in range(50)}
    changes = spark.read.parquet(f"{tmp_path}/state/changes/batch=*").orderBy("batch").collect()
    assert len({r.batch for r in changes}) >= exact_dedup.BATCHES
    before, hits = {}, 0
    for r in changes:
        hits += r.digest in before
        assert r.group_size > before.get(r.digest, 0)
        before[r.digest] = r.group_size
    assert hits > 50


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.md5(t), 1, 1)])
def test_exact_dedup(docs, empty, digest):
    rows = docs.collect()
    best, size = {}, {}
    for r in rows:
        t = r.text or ""
        best[t] = max(best.get(t, -1), -1 if r.doc_id is None else r.doc_id)
        size[t] = size.get(t, 0) + 1
    got = exact_dedup.exact_duplicates(docs, digest=digest, files_per_batch=1).collect()
    text = {r.doc_id: r.text or "" for r in rows}
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(size)
    for r in got:
        t = text[r.doc_id]
        assert (-1 if r.keep_id is None else r.keep_id, r.group_size) == (best[t], size[t]) and (not r.kept or r.doc_id == r.keep_id)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(size)


def test_sstables(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = f"{tmp_path}/tables"
    sstable.write_tables(docs, out, path, shards=3)
    got = sorted(sstable.token_table(spark, out).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    at = 0
    for r, g in zip(rows, got):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    small = f"{tmp_path}/small"
    sstable.write_tables(docs, small, path, shards=2, table_bytes=4096)  # several tables a shard
    assert sorted(map(tuple, sstable.token_table(spark, small).collect()), key=str) == sorted(map(tuple, got), key=str)
    for where in (out, small):
        for doc in (None, 0, 3, 59, rows[-1].doc_id):
            found = sstable.lookup(spark, where, doc)
            assert [f.tolist()[:-1] for f in found] == [t.encode(r.text or "", add_special_tokens=False).ids for r in rows if r.doc_id == doc]
        assert sstable.lookup(spark, where, 10**9) == sstable.lookup(spark, where, -1) == []
    sstable.write_tables(empty, f"{tmp_path}/none", path)
    assert sstable.token_table(spark, f"{tmp_path}/none").count() == 0


def test_table_search():
    w = sstable.TableWriter(3, 1)
    keys = [(k * 7, r) for k in range(5000) for r in range(1 + (k % 50 == 0))]
    for k, r in keys:
        w.add(sstable.key_of(k, r), b"\x02" + bytes([k % 251, r]) * (k % 40), k % 40)
    out, asked = w.finish() + b"\n", []
    t = sstable.TableReader(lambda at, n: asked.append(n) or out[at : at + n], len(out))
    assert len(t.index) > 1 and (t.shard, t.part, t.docs) == (3, 1, len(keys))
    for k in range(5000):
        assert t.get(k * 7) == [b"\x02" + bytes([k * 7 % 251, r]) * (k * 7 % 40) for r in range(1 + (k % 50 == 0))]
    assert all(t.get(k) == [] for k in (1, -5, 34999, 10**12))
    asked.clear()
    t.get(700)
    assert sum(asked) < len(out) // 2


def test_packing(spark, docs, empty):
    rng = random.Random(4)
    for _ in range(200):
        h = sorted({rng.randint(0, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}.items())
        k, ls = rng.randint(1, 5), [x for x, _ in h]

        def cost(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in h)

        best = min(cost((*c, ls[-1])) for r in range(min(k, len(ls))) for c in itertools.combinations(ls[:-1], r))
        got = packing.bucket_bounds(h, k)
        assert len(got) <= k and cost(got) == best
    lengths = spark.createDataFrame([(i, rng.choice([None, 0, 3, 50, 51, 400, 5000])) for i in range(500)] + [(1, 3), (1, 3)], "doc_id long, n_tokens long")
    rows = packing.pack(lengths, buckets=3, budget=1000).collect()
    assert len(rows) == 502
    groups = {}
    for r in rows:
        groups.setdefault((r.bucket, r.batch), []).append(r)
        assert r.padding == r.width - r.n_tokens >= 0
    for (bucket, _), g in groups.items():
        assert sorted(r.slot for r in g) == list(range(len(g))) and (len(g) == 1 or len(g) * g[0].width <= 1000)
    assert packing.pack(empty.select("doc_id", F.col("n_chars").alias("n_tokens"))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    p = shards.permute(np.arange(n), n, 9)
    assert sorted(p.tolist()) == list(range(n)) and shards.permute(p, n, 9, inverse=True).tolist() == list(range(n))


def test_shards(docs, empty):
    got = shards.with_shards(docs.select("doc_id"), ["doc_id"], 16).collect()
    assert sorted(r.row_no for r in got) == list(range(len(got)))
    groups = {}
    for r in got:
        groups.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(g) == list(range(len(g))) for g in groups.values()) and max(map(len, groups.values())) - min(map(len, groups.values())) <= 1
    assert shards.with_shards(empty.select("doc_id"), ["doc_id"]).count() == 0


def test_gif(docs, empty):
    rng = random.Random(6)
    for n in (64, 640, 64 * 700):
        for data in (bytes(n), bytes(rng.randrange(256) for _ in range(n)), (b"the of and " * n)[:n]):
            assert gif.lzw_decode(gif.lzw_encode(data), 8) == data
    for r in gif.payload_features(gif.store(docs)).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert gif.payload_features(gif.store(empty)).count() == 0


def test_gif_rules(spark):
    def frame(samples, w, h, left, top, disposal, clear=None, lines=False):
        packed = disposal << 2 | (clear is not None)
        head = bytes([0x21, 0xF9, 4, packed, 5, 0, clear or 0, 0, 0x2C]) + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x40 if lines else 0, 8])
        return head + gif._blocks(gif.lzw_encode(bytes(samples)))

    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]) + bytes(3 * 252)
    start = b"GIF89a" + bytes([2, 0, 2, 0, 0xF7, 0, 0]) + palette
    data = start + frame([0, 0, 0, 0], 2, 2, 0, 0, 1) + frame([1, 3], 2, 1, 0, 0, 3, clear=3) + frame([2], 1, 1, 1, 1, 2) + frame([1], 1, 1, 0, 0, 0) + b"\x3b"
    seen, painted = [], []
    for f in gif.frames_of(data):  # a frame's screen is valid until the next one
        seen.append(f.shown.reshape(-1, 3).argmax(1).tolist())
        painted.append(bool(f.covered[1, 1]))
        assert f.delay == 5
    assert seen == [[0, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 2], [1, 0, 0, 0]] and painted == [True, True, True, False]
    (woven,) = gif.frames_of(b"GIF89a" + bytes([1, 0, 8, 0, 0xF7, 0, 0]) + palette + frame([0, 1, 2, 2, 1, 1, 0, 0], 1, 8, 0, 0, 0, lines=True) + b"\x3b")
    assert woven.shown[:, 0].argmax(1).tolist() == [0, 1, 2, 1, 1, 0, 2, 0]
    rows = gif.gif_frames(spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(data[:-9]))], "doc_id long, gif binary"), ["doc_id"]).collect()
    assert sum(r.frame is not None for r in rows if r.doc_id == 1) == 4 and {r.doc_id for r in rows if r.error} == {2, 3}
    assert [r.at for r in rows if r.doc_id == 1] == [0, 5, 10, 15] and rows[0].red[7] == 4
    assert rows[0].mode == "RGB" and rows[0].pixels == bytes([255, 0, 0] * 4) and rows[0].covered is None
    assert [r.frames for r in rows if r.doc_id == 1] == [None, None, None, 4]


def test_gif_of_several_frames(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(["a", "b", "word ", "é", "中"]) for _ in range(2_600_000)) + "end"
    raw = text.encode()
    assert len(raw) > gif.WIDTH * gif.MOST_ROWS
    media = gif.store(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    (r,) = gif.payload_features(media).collect()
    payload = gif.pad(raw)
    assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    bins = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8).tolist()
    assert r.feature == f"gif;64x65535;frames=2;hist={','.join(map(str, bins))}"
    frames = gif.gif_frames(media, ["doc_id"]).orderBy("frame").collect()
    assert b"".join(bytes(f.pixels)[: 64 * f.height] for f in frames) == payload and [f.at for f in frames] == [0, 10]


def test_language_id(spark, empty):
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language_id.held_out())
    parser = language_id.fit(t.filter("not held_out"))
    got = language_id.with_language(t.filter("held_out"), parser, keep=["lang"])
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()
    parser.load()
    assert parser.predict([None, "", "12 ..."]) == [("und", 0.0, True)] * 3
    assert [p[0] for p in parser.predict(["½ ²", "Ⅷ", "x²", "\u0301", "二"])][:2] == ["und", "und"] and parser.predict(["x²", "二"])[1][0] != "und"
    assert language_id.with_language(empty, parser).count() == 0 and language_id.fit(empty).load().predict(["x"]) == [("und", 0.0, True)]
    a = language_id.SuffixAutomaton(" abcab")
    assert [a.phrases(w) for w in (" ab", "cabx", "xx", "bcb", "")] == [1, 2, 2, 2, 0]
    sample = " der hund und die katze"
    b, text = language_id.SuffixAutomaton(sample), " und die katze der hu nd"
    at = n = 0
    while at < len(text):  # brute force: the longest piece of the sample at each place
        at += max((k for k in range(1, len(text) - at + 1) if text[at : at + k] in sample), default=1)
        n += 1
    assert b.phrases(text) == n == 4
    many = language_id.SideBySide([a, b])
    texts = [" hund", "", "x", text, " ab und cab", text * 3, "日 x"] * 4 + [text * 50]
    assert many.phrases(texts).tolist() == [[m.phrases(t) for m in (a, b)] for t in texts]
    assert many.phrases(texts[:3]).tolist() == [[m.phrases(t) for m in (a, b)] for t in texts[:3]]
    odd = spark.createDataFrame([(1, "the cat sat", "en"), (None, "le chat noir", "fr"), (3, None, "en"), (4, "sans label", None), (1, "the cat sat", "en")], "doc_id long, text string, lang string")
    small = language_id.fit(odd)
    assert small.languages == ["en", "fr"]
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language_id.with_language(odd, small).collect())
    assert got[:3] == [(0, "fr"), (1, "en"), (1, "en")] and got[3] == (3, "und")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark, empty):
    rows = ["4984250489669609 x", "4984-2504-8966-9609", "4984250489669608", "at 2024-02-29. or 2024-02-30", "31/12/1999 12/31/1999", "1.2.3.4 and 256.1.1.1", "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "a.b@c.example.com,", "+1 (988) 555-2485", "123-45-6789 000-11-2222", "", None, "4984250489669609" + " y" * 50_000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r for r in pii.with_pseudonyms(df, "k").orderBy("doc_id").collect()]
    out = [r.text for r in got]
    assert [r.n_pii for r in got] == [1, 1, 0, 1, 2, 1, 1, 0, 1, 1, 1, 0, 0, 1]
    card = out[0].split()[0]
    assert luhn(card) and len(card) == 16 and card != rows[0][:16] and out[1].replace("-", "") == card and out[13].startswith(card)
    assert date.fromisoformat(out[3].split()[1].rstrip(".")) and out[3].endswith("2024-02-30")
    bank = out[6].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bank[4:] + bank[:4])) % 97 == 1 and [len(x) for x in out[6].split()] == [4, 4, 4, 4, 4, 2]
    assert out[2] == rows[2] and out[7] == rows[7] and out[12] is None and "@example.invalid" in out[8] and out[9].startswith("+1 (")
    few = spark.range(99).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    assert few.select(pii._digit_string(F.col("d"), "k", F.lit("t"))).distinct().count() == 99
    assert pii.with_pseudonyms(empty, "k").count() == 0
