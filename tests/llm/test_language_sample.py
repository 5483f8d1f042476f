"""What op10 learns from: every label, and rows in the order of the draw."""

import random
import re
import weakref

import numpy as np

from quire.llm import language_id


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} " * 5, f"l{k:02d}") for k in range(70) for i in (2 * k, 2 * k + 1)]
    parser = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert parser.languages == sorted({r[2] for r in rows})
    assert [p for p, *_ in parser.load().predict([r[1] for r in rows])] == [r[2] for r in rows]


def test_sample_is_not_a_prefix_by_id(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    rows = [(i, (word(i) + " ") * 400, "en") for i in range(1000, 1400)]
    parser = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = {w for w in re.findall("[a-j]{4}", parser.samples["en"])} & {word(i) for i in range(1000, 1400)}
    late = {word(i) for i in range(1200, 1400)}
    assert len(seen) < 300 and 0.3 < len(seen & late) / len(seen) < 0.7


def test_no_label_keeps_texts_with_letters(spark):
    rows = [(1, "words", None), (2, "12 !", None), (3, None, None), (4, "语", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(docs, language_id.fit(docs)).collect()} == {1, 4}


def test_unequal_samples():
    """A language with little labelled text wins its own texts, and no others."""
    rng = random.Random(8)
    syllables = {"x": ["ba", "ko", "ti", "mu", "sel"], "y": ["ra", "ko", "shi", "len", "mu"], "z": ["gro", "ti", "ump", "ak", "sel"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(n))
    for small in syllables:
        parser = language_id.CrossParser({lang: language_id.joined(text(lang, 60 if lang == small else 8000).split()) for lang in syllables}).load()
        for lang in syllables:
            assert {p for p, *_ in parser.predict([text(lang, 60) for _ in range(20)])} == {lang}


def test_ties_go_to_the_first_name():
    parser = language_id.CrossParser({"b": " one two", "a": " one two"}).load()
    assert parser.predict(["one two"])[0][:2] == ("a", 0.0)


def test_texts_in_no_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    parser = language_id.fit(docs)
    noise = " ".join("".join(random.Random(i).choices("qxzjkvw", k=6)) for i in range(60))
    odd = spark.createDataFrame([(10**6, noise, "en", "s", 1), (10**6 + 1, "12 ²", "en", "s", 1), (10**6 + 2, None, None, None, None)], docs.schema)
    got = language_id.keep_identified(docs.unionByName(odd), parser)
    rows = {r.doc_id: r for r in got.collect()}
    with_letters = {r.doc_id: r for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert rows.keys() == with_letters.keys() and got.columns == docs.columns
    assert sum(rows[i].lang == r.lang for i, r in with_letters.items()) > 0.99 * len(rows)


def test_texts_side_by_side_equal_one_by_one():
    """Misses are counted in a step, letters that are nowhere beside it; places are of the kind that numpy takes as it is."""
    import random

    rng = random.Random(5)
    automata = [language_id.SuffixAutomaton(t) for t in (" abc ab cab", " αβγ βα", " b")]
    model = language_id.SideBySide(automata)
    assert model.base.dtype == model.starts.dtype == model.roots.dtype == "int64"
    texts = ["", "日", "日日a", "a日b", "x" * 50] + ["".join(rng.choice(" abcαβγ日x") for _ in range(rng.randrange(40))) for _ in range(200)]
    assert model.phrases(texts).tolist() == [[a.phrases(t) for a in automata] for t in texts]


def test_words_by_letters():
    text = "Straße_1a²b ½ Ⅷx 日本語٣ ñ\U0001f600o\U00010400\U00010401 \ud800z"
    plain = "".join(c if c.isalpha() else " " for c in text).split()
    assert language_id.words_of(text) == plain and language_id.words_of("aé_b") == ["aé", "b"]


def test_one_automaton_is_held_at_a_time(monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 7)
    rng = np.random.default_rng(3)
    samples = ["".join(rng.choice(list(letters), 3000)) for letters in (" abcde", " cdefgh\u0431", " \u0430\u0431\u0432")]
    made = []

    def automaton(sample):
        assert not any(r() for r in made)
        new = language_id.SuffixAutomaton(sample)
        made.append(weakref.ref(new))
        return new

    model = language_id.SideBySide(automaton(s) for s in samples)
    assert len(made) == 3 and not any(r() for r in made)
    texts = ["", " ", *("".join(rng.choice(list(" abcdefgh\u0430\u0431\u0432x"), n)) for n in (1, 6, 7, 8, 40, 300, 90, 15, 2, 33, 70, 1000))]
    whole = [[language_id.SuffixAutomaton(s).phrases(t) for s in samples] for t in texts]
    assert model.phrases(texts).tolist() == whole and model.phrases(texts[-3:]).tolist() == whole[-3:]
    assert language_id.SideBySide([]).phrases(["a"]).shape == (1, 0)
