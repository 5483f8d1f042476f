"""Language identification by cross-parsing.

Each language's labelled text becomes a suffix automaton. A whole text's letters, lower-cased and with
one space before each word, are parsed with it from left to right into phrases, each the longest match
in the labelled text (one letter at least). A phrase is a place in the labelled text, so it costs the
logarithm of that text's length: phrases are normalised by it, and languages with much and with little
labelled text compare. The language needing the fewest normalised phrases wins; ties go to the first name.

What a text needs a letter is an estimate of its cross entropy. A text of FEWEST letters or more that needs
over STRANGE times what the winner's own held-back text needs is in none of the languages; the pipeline
rejects it.

The labelled text is a bounded sample: SAMPLE_DOCS documents a language at most, SAMPLE_CHARS letters
of them together, taken by a hash of the id; of a longer document, a window at a place that is drawn
by the hash as well. Every label is learned: with more than FULL_LANGUAGES of them, they share the
letters of so many, MIN_CHARS each at least. Predictions read whole texts.

Null texts and texts without a letter are `und` with score 0; repeated rows get a result each; rows
with a null id or a null label are predicted, and those with a null label are not learned from; an
empty table gives an empty result, and a parser learned from none answers `und`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, named, small_batches

UNDETERMINED = "und"
SAMPLE_DOCS = 400
SAMPLE_CHARS = 60_000
FULL_LANGUAGES = 64
MIN_DOCS, MIN_CHARS = 16, 400  # a language, however many there are
FEW = 8  # so few texts are parsed one by one, more of them side by side
PIECE = 1 << 16  # letters of a text that is parsed alone, looked up at a time
GROUP_LETTERS = 4 << 20  # texts held as letters at a time, unless a single one has more
STRANGE, FEWEST = 2.5, 100


def _letters(below: int) -> re.Pattern:
    """Runs of letters, as a class of ranges: one look-up for a character, where a class that names what it leaves out
    tries each part."""
    found, start = [], None
    for c in range(below + 1):
        here = c < below and chr(c).isalpha()
        if here and start is None:
            start = c
        elif not here and start is not None:
            found.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(found)}]+")


WORDS, SHORT_WORDS = _letters(0x110000), _letters(0x10000)


def words_of(text: str) -> list[str]:
    """The words of a text; the look-up of all letters is slow, and only texts with characters past 16 bits need it."""
    wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
    return (WORDS if wide else SHORT_WORDS).findall(text)


class SuffixAutomaton:
    """All substrings of a text; transitions of state s by letter c are moves[s][c]."""

    def __init__(self, text: str):
        moves, link, length, last = [{}], [-1], [0], 0
        for c in text:
            cur = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.moves = moves

    def phrases(self, text: str, state: int = 0) -> int:
        """Phrases of the greedy longest-match parse, from the state of a phrase begun before (counted
        here, where it ends); a letter that is nowhere is a phrase."""
        moves, n = self.moves, 0
        root = moves[0]
        for c in text:
            to = moves[state].get(c)
            if to is None:
                n += state != 0
                to = root.get(c)
                if to is None:
                    n += 1
                    state = 0
                    continue
            state = to
        return n + (state != 0)


class SideBySide:
    """Parses many texts with several automata at once.

    The automata's transitions lie in one double array: state s goes by letter code c to to[i], with
    i = base[s] + c, if owner[i] is s. A step moves all texts' states of all languages by one letter.

    automata: read one by one and not kept, so that a worker holds the states of one as objects at a time.
    """

    def __init__(self, automata: Iterable[SuffixAutomaton]):
        self.code = np.zeros(0x110000, np.int32)  # 0: a letter that is nowhere
        code: dict[str, int] = {}
        first, bases, starts = [0], [], []
        used = bytearray(1 << 16)
        owner, to = np.full(len(used), -1, np.int32), np.zeros(len(used), np.int32)
        free, gap, size = 0, 0, 0  # where places for many transitions are looked for, and for one
        for automaton in automata:
            moves = automaton.moves
            for c in sorted(set(moves[0]) - set(code)):  # the root has all letters
                code[c] = len(code) + 1
            width, own = len(code) + 1, first[-1]
            starts.append({code[c]: own + t for c, t in moves[0].items()})
            many = np.fromiter(map(len, moves), np.int32, len(moves))
            letters = np.fromiter((code[c] for m in moves for c in m), np.int32, int(many.sum()))
            target = np.fromiter((t for m in moves for t in m.values()), np.int32, len(letters))
            del moves, automaton
            order = np.lexsort((letters, np.repeat(np.arange(len(many), dtype=np.int32), many)))
            letters, target = letters[order], target[order] + np.int32(own)
            del order
            ends = np.cumsum(many)
            base = np.zeros(len(many), np.int64)  # places are of 64 bits, which numpy takes as they are
            free, gap = max(free, width), max(gap, width)
            for s in np.argsort(-many, kind="stable").tolist():
                b, a = int(ends[s]), int(ends[s] - many[s])
                if a == b:
                    break  # states without a transition come last
                out = letters[a:b].tolist()
                single = len(out) == 1  # states of one transition fill the gaps
                at, tries = used.find(0, gap if single else free), 0
                shifts = [c - out[0] for c in out[1:]]
                while True:
                    while at < 0 or at + 2 * width >= len(used):
                        owner, to = np.append(owner, np.full(len(used), -1, np.int32)), np.append(to, np.zeros(len(used), np.int32))
                        used.extend(bytes(len(used)))
                        at = used.find(0, gap if single else free) if at < 0 else at
                    if not any(used[at + d] for d in shifts):
                        break
                    at, tries = used.find(0, at + 1), tries + 1
                if single:
                    gap = at
                elif tries > 16:
                    free = at
                base[s] = at - out[0]
                for c, t in zip(out, target[a:b].tolist()):
                    i = at - out[0] + c
                    used[i], owner[i], to[i], size = 1, own + s, t, max(size, i)
            bases.append(base)
            first.append(own + len(many))
        self.code[[ord(c) for c in code]] = np.fromiter(code.values(), np.int32, len(code))
        width = len(code) + 1
        size += width + 1
        if size > len(owner):
            owner, to = np.append(owner, np.full(size - len(owner), -1, np.int32)), np.append(to, np.zeros(size - len(to), np.int32))
        self.roots = np.array(first[:-1], np.int64)
        self.base, self.owner, self.to = np.concatenate([np.zeros(0, np.int64), *bases]), owner[:size].copy(), to[:size].copy()
        self.starts = np.tile(self.roots, (width, 1))  # where a letter leads from each root; the root: nowhere
        for k, known in enumerate(starts):
            self.starts[list(known), k] = list(known.values())
        self.nowhere = self.starts == self.roots
        self.lacking = self.nowhere.any(1)

    def codes(self, text: str) -> np.ndarray:
        return self.code.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))

    def rest(self, text: str, at: int, k: int, state: int) -> int:
        """Phrases of text from `at` on in language k, from a state as SuffixAutomaton.phrases has it."""
        base, owner, to, starts = map(memoryview, (self.base, self.owner, self.to, np.ascontiguousarray(self.starts[:, k])))
        root, n = int(self.roots[k]), 0
        for a in range(at, len(text), PIECE):
            for c in self.codes(text[a : a + PIECE]).tolist():
                i = base[state] + c
                if owner[i] == state:
                    state = to[i]
                    continue
                n += state != root
                state = starts[c]
                n += state == root
        return n + (state != root)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """A row for each text with its number of phrases in each language."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        found = np.zeros((len(texts), len(self.roots)), np.int64)
        at, count = 0, np.zeros_like(found)
        state = np.tile(self.roots, (len(texts), 1))
        final, misses = state.copy(), np.zeros(state.shape, np.int32)
        if len(texts) > FEW:
            begin = np.cumsum(sizes) - sizes
            flat = np.empty(int(sizes.sum()), np.int32)
            for i, a, n in zip(order, begin.tolist(), sizes.tolist()):
                flat[a : a + n] = self.codes(texts[i])
            active = np.searchsorted(-sizes, -np.arange(int(sizes[FEW])), side="left")  # texts longer than each place
            base, owner, to, starts = self.base, self.owner, self.to, self.starts
            for at, k in enumerate(active.tolist()):
                if k < len(state):  # texts that end here keep their states
                    final[k : len(state)], count[k : len(state)] = state[k:], misses[k:]
                    state, misses, begin = state[:k], misses[:k], begin[:k]
                letter = flat.take(begin + at)
                i = base.take(state)
                i += letter[:, None]
                missed = owner.take(i) != state
                misses += missed
                state = np.where(missed, starts.take(letter, 0), to.take(i))
            final[: len(state)], count[: len(state)] = state, misses
            # a letter that is nowhere is a phrase, and ends the one before it, unless that is another such letter
            alone = np.flatnonzero(self.lacking.take(flat))
            ends_at = np.cumsum(sizes)
            row = np.searchsorted(ends_at, alone, side="right")
            place = alone - (ends_at - sizes)[row]
            inside = (place > 0) & (place < len(active))
            ends = self.nowhere[flat[alone[inside]]] & ~self.nowhere[flat[alone[inside] - 1]]
            rows, first = np.unique(row[inside], return_index=True)
            if len(rows):
                count[rows] += np.add.reduceat(ends, first, axis=0, dtype=np.int64)
            at = len(active)
        for row, i in enumerate(order):
            for k, state in enumerate(final[row].tolist()):
                found[i, k] = count[row, k] + self.rest(texts[i], at, k, state)
        return found


def joined(words: list[str]) -> str:
    return (" " + " ".join(words)).lower()


class CrossParser:
    def __init__(self, samples: dict[str, str]):
        self.samples = dict(sorted(samples.items()))
        self.languages = list(self.samples)
        self.automata = None
        self.weight = [math.log2(len(t) + 1) for t in self.samples.values()]
        self.own = [self.held_back(t) for t in self.samples.values()]

    @staticmethod
    def held_back(sample: str) -> float:
        """Bits a letter that the last tenth of a sample needs, parsed with the rest (one at least)."""
        n = len(sample) - max(1, len(sample) // 10)
        return max(1.0, SuffixAutomaton(sample[:n]).phrases(sample[n:]) * math.log2(n + 1) / (len(sample) - n))

    def __getstate__(self):
        return self.__dict__ | {"automata": None}

    def load(self) -> CrossParser:
        if self.automata is None:
            self.automata = SideBySide(SuffixAutomaton(t) for t in self.samples.values())
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, whether the text is in none of the languages) of each text: the score is the
        share by which the winner needs less than the next language, between 0 and 1; (und, 0.0, True) for a
        text that is null or has no letter."""
        found = [(UNDETERMINED, 0.0, True)] * len(texts)
        if not self.languages:
            return found
        held, size = [], 0
        for i, text in enumerate(texts):
            words = words_of(text) if text else []
            if words:
                held.append((i, joined(words)))
                size += len(held[-1][1])
            if size > GROUP_LETTERS:
                self.decide(held, found)
                held, size = [], 0
        if held:
            self.decide(held, found)
        return found

    def decide(self, held: list[tuple[int, str]], found: list[tuple[str, float, bool]]) -> None:
        for (i, letters), counts in zip(held, self.automata.phrases([letters for _, letters in held]).tolist()):
            bits = [n * w for n, w in zip(counts, self.weight)]
            order = sorted(range(len(bits)), key=lambda k: (bits[k], k))
            best, second = bits[order[0]], bits[order[1]] if len(bits) > 1 else 2 * bits[order[0]]
            strange = len(letters) >= FEWEST and best > STRANGE * self.own[order[0]] * len(letters)
            found[i] = self.languages[order[0]], min(1.0, max(0.0, 1 - best / second)) if second else 0.0, strange


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> CrossParser:
    """Learns from rows with a text and a label; what reaches the driver is bounded by docs and chars."""
    rows = labelled.select(named(id_col).cast("string").alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not sizes:
        return CrossParser({})
    if len(sizes) > FULL_LANGUAGES:
        docs, chars = max(MIN_DOCS, docs * FULL_LANGUAGES // len(sizes)), max(MIN_CHARS, chars * FULL_LANGUAGES // len(sizes))
    each = max(400, 2 * chars // min(docs, max(sizes.values())))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, docs / n)))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64(F.lit("place"), F.col("id")), F.greatest(F.lit(1), F.length("text") - each + 1)) + 1
    window = F.substr("text", place.cast("int"), F.lit(each)).alias("text")
    picked = rows.filter((draw < F.element_at(share, F.col("lang")) * 1.5)).select("lang", draw.alias("draw"), "id", window)
    got: dict[str, list] = {}
    for r in picked.collect():
        got.setdefault(r["lang"], []).append((-1.0 if r["draw"] is None else r["draw"], r["id"] or "", r["text"]))
    samples = {}
    for lang, found in got.items():
        kept, n = [], 0
        for w in (w for _, _, t in sorted(found)[:docs] for w in words_of(t)):
            if n > chars:
                break
            kept.append(w)
            n += len(w) + 1
        if kept:
            samples[lang] = joined(kept)
    return CrossParser(samples)


def with_language(df: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, the columns `keep`, lang_pred and score of each row; reads the text alone. Columns other than
    these are not kept, whatever their names."""
    shared = df.sparkSession.sparkContext.broadcast(parser)  # FULL_LANGUAGES * SAMPLE_CHARS letters at most, unless so many labels need MIN_CHARS each
    columns = list(dict.fromkeys([id_col, *(keep or [])]))
    inputs = df.select(*[named(c).alias(f"k{i}") for i, c in enumerate(columns)], named(text_col).alias("text"))
    kinds = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))

    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], f"{kinds}, lang_pred string, score double").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, model, held, size = to_arrow_schema(out), None, [], 0

        def done() -> pa.RecordBatch:
            got = model.predict([t for b in held for t in b.column(b.num_columns - 1).to_pylist()])
            own = [pa.concat_arrays([b.column(i) for b in held]) for i in range(len(columns))]
            return pa.RecordBatch.from_arrays([*own, *(pa.array([g[i] for g in got], arrow.field(len(columns) + i).type) for i in (0, 1))], schema=arrow)

        # many texts side by side cost little more than few
        for batch in batches:
            model = model or shared.value.load()
            held.append(batch)
            size += batch.column(batch.num_columns - 1).nbytes
            if size > GROUP_LETTERS:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    return inputs.mapInArrow(run, out).toDF(*columns, "lang_pred", "score")


def keep_identified(df: DataFrame, parser: CrossParser, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose text is in one of the languages, with lang_col set to it: null texts, texts without
    a letter and texts that are in none of the languages go. A parser that learned no language keeps
    every text with a letter, and its label."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(parser)

    @F.pandas_udf("string")
    def language(texts: pd.Series) -> pd.Series:
        if not shared.value.languages:
            return pd.Series(["" if t and WORDS.search(t) else UNDETERMINED for t in texts], dtype=object)
        model = shared.value.load()
        return pd.Series([UNDETERMINED if strange else found for found, _, strange in model.predict(list(texts))], dtype=object)

    name = fresh(df.columns, "_language")
    # not deterministic: evaluated once, before the filter
    found = df.withColumn(name, language.asNondeterministic()(named(text_col))).filter(F.col(name) != UNDETERMINED)
    return found.select(*[F.coalesce(F.nullif(F.col(name), F.lit("")), named(c)).alias(c) if c == lang_col else named(c) for c in df.columns])


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(named(id_col).cast("string")), F.lit(3)) == 1


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; a null id is not held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    parser = fit(docs.filter(~F.col("held_out")))
    return with_language(docs, parser, keep=["held_out"]).select("doc_id", "held_out", "lang_pred", "score")
