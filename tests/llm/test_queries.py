"""Each registered query on a folder of its own, against a library or a second, plain implementation.

The table has nulls in every column, empty and very long texts, ties, repeated rows, and columns
with the names that operators use inside.
"""

import hashlib
import itertools
import random
import zlib
from datetime import date, timedelta

import numpy as np
import public_tokenizers as P
import pytest
import regex
import xxhash

import corpus_pipeline
from quire.llm import language_id, packing, pii, queries

INSIDE = "_content_locator _metadata _pii_found _pii_new n_pii _src _at _p _g _all _own src at p g c0 c1 k0 id key fp room path cell row_no rank_no permuted shard slot digest locator keep_id _text _salt _parts _language gif frame error bucket n_tokens lang_pred held_out low high own size".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `doc id` string, " + ", ".join(f"{c} string" for c in INSIDE)
PERSONAL = "call +44 20 7946 0958 or (415) 555-2671, card 4984-2504-8966-9609, 2024-02-29 and 31/12/1999, DE89 3704 0044 0532 0130 00, 123-45-6789, 1.2.3.4, a.b@c.example.com"


def rows():
    rng = random.Random(7)
    words = ["the", "of", "and", "to", "ation", "ing", "er", "es", "ß", "été", "中文", "🎉", "x1", "23", "'s", "...", "<|endoftext|>", "ABC", "½ ²"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "\n", ", ", ""]) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    near = "one two three four five six seven eight nine ten " * 30
    made += [made[0], made[1], None, "", " ", "½ ²", "Ⅷ", "12", PERSONAL, PERSONAL + " again", near, near + "eleven", "w" * 20 + " ", "".join(f"{rng.choice(words)}{rng.randrange(10**6):020d} " for _ in range(210_000))]
    out = [(i, t, ["en", "fr", None, "de"][i % 4], ["s", None][i % 2], i if i % 3 else None, "x", None, *(["inside", None][i % 2] for _ in INSIDE)) for i, t in enumerate(made)]
    return [*out, out[2], out[2], (None, "without an id", *[None] * (len(out[0]) - 2)), (99, "one more", *[None] * (len(out[0]) - 2))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('none')}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    return at


def ran(spark, name, folder, none):
    """The rows, as a sorted list; the empty table gives none, with the same columns."""
    empty = queries.QUERIES[name](spark, none)
    got = queries.QUERIES[name](spark, folder)
    assert empty.collect() == [] and empty.schema.simpleString() == got.schema.simpleString()
    return got.columns, sorted(map(tuple, got.collect()), key=str)


def same(got, columns, want):
    assert got[0] == columns.split()
    assert got[1] == sorted(want, key=str)


def here(pattern):
    """The operator's pattern in this library's spelling of back-references."""
    return regex.compile(regex.sub(r"\\k<(\w)>", r"(?P=\1)", pattern))


class Pseudonyms:
    """A second implementation of op1 in plain Python: patterns are the operator's, all else is its own."""

    def __init__(self, key):
        self.key = key

    def permuted(self, v, a, b, tag):
        left, right = divmod(v, b)
        for i in range(pii.ROUNDS):
            half = left if i % 2 else right
            noise = int(hashlib.sha256(f"{self.key}|{tag}|{i}|{half}".encode()).hexdigest()[:14], 16)
            left, right = (left, (right + noise) % b) if i % 2 else ((left + noise) % a, right)
        return left * b + right

    def digits(self, d, tag):
        low = len(d) // 2
        return f"{self.permuted(int(d), 10 ** (len(d) - low), 10**low, tag + str(len(d))):0{len(d)}d}"

    @staticmethod
    def refill(m, d):
        left = iter(d)
        return "".join(next(left) if c.isdigit() else c for c in m)

    @staticmethod
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10

    @staticmethod
    def mod97(text):
        return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97

    def email(self, m):
        return "u" + hashlib.sha256(f"{self.key}|email|{m.lower()}".encode()).hexdigest()[:20] + "@example.invalid"

    def iban(self, m):
        plain = m.replace(" ", "")
        d = "".join(c for c in plain[4:] if c.isdigit())
        if self.mod97(plain) != 1 or not 15 <= len(plain) <= 34 or len(d) < 8:
            return None
        k = len(d) // 2
        right = self.digits(d[k:], "iban" + d[:k])
        tail = self.refill(plain[4:], self.digits(d[:k], "iban" + right) + right)
        new = iter(plain[:2] + f"{98 - self.mod97(plain[:2] + '00' + tail):02d}" + tail)
        return "".join(c if c == " " else next(new) for c in m)

    def ip(self, m):
        octets = list(map(int, m.split(".")))
        if max(octets) > 255:
            return None
        return ".".join(map(str, self.permuted(int.from_bytes(bytes(octets), "big"), 65536, 65536, "ip").to_bytes(4, "big")))

    def date(self, m):
        mark = regex.search("[-/.]", m)[0]
        part = m.split(mark)
        for order in (((0, 1, 2),) if len(part[0]) == 4 else ((2, 1, 0), (2, 0, 1))):
            try:
                day = date(*(int(part[k]) for k in order))
            except ValueError:
                continue
            at, first = (day - date(1800, 1, 1)).days, date(1800, 1, 1)
            if not 0 <= at < 189 * 773:
                return None
            new = first + timedelta(self.permuted(at, 189, 773, "date"))
            values = (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")
            return mark.join(values[order.index(k)] for k in range(3))
        return None

    def ssn(self, m):
        area, group, serial = map(int, m.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = self.permuted((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        return f"{areas[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"

    def phone(self, m):
        d = "".join(c for c in m if c.isdigit())
        own = d if not m.startswith("+") else d[1:] if len(d) == 11 and d[0] == "1" else ""
        if len(own) == 10 and int(own[:3]) >= 200 and int(own[3:6]) >= 200:
            x = self.permuted(((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:]), 80_000, 80_000, "phone")
            return self.refill(m, d[:-10] + f"{x // 10_000 // 800 + 200}{x // 10_000 % 800 + 200}{x % 10_000:04d}")
        if not m.startswith("+") or not 8 <= len(d) <= 15:
            return None
        code = regex.match(r"\+([0-9]{1,3})[ .(-]", m)
        code = len(code[1]) if code else 1
        return self.refill(m, d[:code] + self.digits(d[code:], "phone" + d[:code]))

    def card(self, m):
        d = "".join(c for c in m if c.isdigit())
        if self.luhn(d):
            return None
        body = self.digits(d[:-1], "card")
        return self.refill(m, body + str((10 - self.luhn(body + "0")) % 10))

    def one(self, m):
        for kind, pattern in pii.KINDS.items():
            if here(pattern).fullmatch(m) and (new := getattr(self, kind)(m)) is not None:
                return new
        return m

    def text(self, text):
        found = []
        new = here(pii.PATTERN).sub(lambda m: found.append((m[0], self.one(m[0]))) or found[-1][1], text)
        return new, sum(a != b for a, b in found)


def test_op1(spark, folder, none):
    spark.conf.set(pii.KEY_SETTING, "a key")
    plain = Pseudonyms("a key")
    got = ran(spark, "op1_pii", folder, none)
    want = [(r[0], *(plain.text(r[1]) if r[1] is not None else (None, 0))) for r in rows()]
    same(got, "doc_id text n_pii", want)
    assert {n for _, t, n in want if t and "call" in t} == {9}


def test_op1_all_kinds(spark):
    rng = random.Random(9)
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    values = []
    for _ in range(60):
        card = n(rng.choice([12, 15, 18]))
        bank = rng.choice(["DE", "FR", "GB"]) + "00" + rng.choice(["", "ABCD"]) + n(18)
        bank = bank[:2] + f"{98 - Pseudonyms.mod97(bank):02d}" + bank[4:]
        values += [card + str((10 - Pseudonyms.luhn(card + "0")) % 10), n(16), bank, " ".join(bank[i : i + 4] for i in range(0, len(bank), 4)), ".".join(str(rng.randrange(300)) for _ in range(4)), f"{n(3)}-{n(2)}-{n(4)}", f"{rng.randrange(1700, 2300)}-{rng.randrange(14):02d}-{rng.randrange(33):02d}", f"{rng.randrange(33):02d}/{rng.randrange(14):02d}/{rng.randrange(1900, 2100)}", f"+{rng.randrange(1, 999)} {n(3)} {n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"+1{n(10)}", f"{n(2)}.x@{n(2)}.Org"]
    rng.shuffle(values)
    texts = [" ; ".join(values[i : i + 9]) for i in range(0, len(values), 9)]
    plain = Pseudonyms("k")
    got = pii.with_pseudonyms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [(r.text, r.n_pii) for r in got] == [plain.text(t) for t in texts] and sum(r.n_pii for r in got) > 300


def test_op2(spark, folder, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {r[1]: len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows()}
    same(ran(spark, "op2_token_counts", folder, none), "doc_id n_bytes n_tokens over_limit", [(r[0], len((r[1] or "").encode()), n[r[1]], n[r[1]] > 1024) for r in rows()])


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(n, linked):
    root = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j) and root[i] != root[j]:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_op3(spark, folder, none):
    texts = rows()
    fp = {t: plain_fingerprint(t) for t in {r[1] for r in texts}}
    root = groups_of(len(texts), lambda i, j: (fp[texts[i][1]] ^ fp[texts[j][1]]).bit_count() <= 3)
    least = {c: min((texts[i][0] for i in range(len(texts)) if root[i] == c and texts[i][0] is not None), default=None) for c in root}
    same(ran(spark, "op3_simhash", folder, none), "doc_id fingerprint component_id", [(r[0], f"{fp[r[1]]:016x}", least[c]) for r, c in zip(texts, root)])


def test_op4(spark, folder, none):
    columns, got = ran(spark, "op4_exact_dedup", folder, none)
    assert columns == "doc_id keep_id group_size kept text_sha256".split()
    ids, size = {}, {}
    for r in rows():
        t = r[1] or ""
        ids.setdefault(t, []).append(-1 if r[0] is None else r[0])
        size[t] = size.get(t, 0) + 1
    best = {t: None if max(x) < 0 else max(x) for t, x in ids.items()}
    want = [(r[0], best[r[1] or ""], size[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows()]
    assert sorted(((a, b, c, e) for a, b, c, _, e in got), key=str) == sorted(want, key=str)
    kept = [r for r in got if r[3]]
    assert len(kept) == len(size) == len({r[4] for r in kept}) and all(r[0] == r[1] for r in kept)


def test_op5(spark, folder, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, at = [], 0
    for r in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same(ran(spark, "op5_sstables", folder, none), "doc_id start n_tokens ids_crc32", want)


def test_op6(spark, folder, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    columns, got = ran(spark, "op6_packing", folder, none)
    assert columns == "doc_id n_tokens bucket width batch slot padding".split()
    want = [(r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()]
    assert sorted((r[:2] for r in got), key=str) == sorted(want, key=str)
    lengths = sorted(n for _, n in want)
    distinct = sorted(set(lengths))
    best = {0: 0}  # places in `lengths` up to which buckets reach -> padding
    for _ in range(packing.BUCKETS):
        after = dict(best)
        for i, cost in best.items():
            for j in range(i + 1, len(lengths) + 1):
                more = cost + sum(lengths[j - 1] - x for x in lengths[i:j])
                after[j] = min(after.get(j, more), more)
        best = after
    assert sum(r[6] for r in got) == best[len(lengths)] and len({r[2] for r in got}) <= packing.BUCKETS <= len(distinct)
    for bucket in {r[2] for r in got}:
        inside = [r for r in got if r[2] == bucket]
        (width,) = {r[3] for r in inside}
        assert max(r[1] for r in inside) == width and all(r[6] == width - r[1] for r in inside)
        per = max(1, packing.BUDGET // max(1, width))
        assert sorted((r[4], r[5]) for r in inside) == [(k // per, k % per) for k in range(len(inside))]


def test_op7(spark, folder, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def want(t):
        ids = sp.encode(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    known = {t: want(t) for t in {r[1] for r in rows()}}
    same(ran(spark, "op7_sentencepiece", folder, none), "doc_id n_tokens ids_sha256 decoded_sha256", [(r[0], *known[r[1]]) for r in rows()])


def test_op8(spark, folder, none):
    def mix(x, i):
        m = (1 << 64) - 1
        x = (x + i * 0xD1B54A32D192ED03 + 1) & m
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        return x ^ x >> 31

    def permuted(x, n):
        half = next(h for h in range(1, 40) if 4**h >= n)
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for i in range(6):
                left, right = right, left ^ mix(right, i) & (1 << half) - 1
            x = left << half | right
            if x < n:
                return x

    made = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows()]
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    at = [permuted(k, len(made)) for k in range(len(made))]
    assert sorted(at) == list(range(len(made)))
    same(ran(spark, "op8_shards", folder, none), "doc_id size text_crc32 law shard slot grown_shard", [(*r, "rows", p % 16, p // 16, None) for r, p in zip(made, at)])


def test_op9(spark, folder, none):
    columns, got = ran(spark, "op9_gif", folder, none)
    assert columns == "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    want = []
    for r in rows():
        raw = (r[1] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        high, frames = min(65535, len(payload) // 64), -(-len(payload) // (64 * 65535))
        bins = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), f"gif;64x{high};frames={frames};hist=" + ",".join(map(str, bins))))
    assert sorted(((*r[:5], r[7]) for r in got), key=str) == sorted(want, key=str)
    assert max(int(r[7].split("frames=")[1].split(";")[0]) for r in got) == 2
    of = {}
    for r in got:
        of.setdefault(r[3], set()).add(r[5:8])
    assert all(len(x) == 1 for x in of.values())


def test_op10(spark, folder, none):
    columns, got = ran(spark, "op10_language_id", folder, none)
    assert columns == "doc_id held_out lang_pred score".split() and len(got) == len(rows())
    text = {(r[0]): r[1] for r in rows()}
    for doc_id, held, lang, score in got:
        assert held == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1) and 0 <= score <= 1
        assert (lang == "und") == (not regex.search(r"\p{L}", text[doc_id] or "")) and lang in ("und", "en", "fr", "de")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    samples = language_id.fit(docs.filter(~language_id.held_out())).samples
    for doc_id, _, lang, _ in got:
        if lang != "und" and len(text[doc_id]) < 3000:
            letters = " " + " ".join(regex.findall(r"\p{L}+", text[doc_id])).lower()
            need = {}
            for name, sample in samples.items():  # brute force: the longest piece of the sample at each place
                at = n = 0
                while at < len(letters):
                    at += next((k for k in range(len(letters) - at, 0, -1) if letters[at : at + k] in sample), 1)
                    n += 1
                need[name] = n * np.log2(len(sample) + 1)
            assert need[lang] == min(need.values()), doc_id


def test_pipeline(spark, folder, none):
    """Against brute force: letters, equal texts, five-word shingles at 0.8, then a row for each document that stays."""
    kept = [r for r in rows() if regex.search(r"\p{L}", r[1] or "") and len(r[1]) < 100_000]  # the long one is in no language
    last = {}
    for r in kept:
        last[r[1]] = max((last.get(r[1], (False, 0)), (r[0] is not None, r[0] or 0)))
    kept = list({(r[0], r[1]): r for r in kept if last[r[1]] == (r[0] is not None, r[0] or 0)}.values())

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in kept]
    root = groups_of(len(kept), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    want = {min((kept[i][0] is None, kept[i][0] or 0) for i in range(len(kept)) if root[i] == c) for c in root}
    got = corpus_pipeline.run(spark, folder)
    found = [(r.doc_id is None, r.doc_id or 0) for r in got.collect()]
    long_ids = {(False, r[0]) for r in rows() if len(r[1] or "") > 100_000}
    assert sorted(set(found) - long_ids) == sorted(want) and len(found) == len(set(found)) and len(want) < len(kept)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() > 0 and (name == "packing" or out.columns == docs.columns), name
        assert stage(spark, spark.read.parquet(f"{none}/documents.parquet"), none).count() == 0


def test_pipeline_stages_decide(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.conf.set(pii.KEY_SETTING, "a key")
    plain = Pseudonyms("a key")
    new = {r.doc_id: r for r in corpus_pipeline.pseudonymize(spark, docs, folder).collect()}
    for r in rows():
        text = None if r[1] is None else plain.text(r[1])[0]
        assert (new[r[0]].text, new[r[0]].n_chars, new[r[0]].n_pii) == (text, None if text is None else len(text), r[7 + INSIDE.index("n_pii")])
    packed = corpus_pipeline.pack(spark, docs, folder).collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted((r[0] for r in rows()), key=str)
    assert len({(r.bucket, r.batch, r.slot) for r in packed}) == len(packed)


def test_hot_keys_are_dealt(spark):
    from pyspark.sql import functions as F

    from quire.llm import common

    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 500 + [2] * 3 + [3])], "k long, i long").repartition(4)
    table = spark.createDataFrame([(1, 500, "a"), (2, 3, "b"), (4, 1, "c")], "k long, n long, v string")
    got = common.join_hot(left, table, "k", F.col("n"), share=50)
    assert sorted((r.k, r.i, r.v) for r in got.collect()) == [(k, i, v) for k, i, v in sorted([(1, i, "a") for i in range(500)] + [(2, 500 + i, "b") for i in range(3)])]


def test_memo_is_bounded():
    from quire.llm.common import Memo

    asked = []
    m = Memo(lambda k: asked.append(k) or k, limit=20_000, base=100, each=1)
    for i in range(10_000):
        assert m[str(i)] == str(i) and m["often"] == "often"
    assert 100 * (len(m) + len(m.older)) <= 20_000 and asked.count("often") == 1
    assert m["x" * 300] == "x" * 300 and "x" * 300 not in m
