"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary is compiled, state by state as texts need them, into a deterministic
transducer. A state is the finite rest of the past that can still matter: every suffix that begins
some token, the last token before that suffix, and its count relative to now. Each transition
carries the number of tokens that it emits (it can be 0 or negative when pieces merge), so a text's
count is the sum along its path.

A chunk of text acts on states as a map: entry state -> (exit state, emitted tokens). Maps compose,
and composition is associative, so chunks are run apart and put together with a prefix scan:

* Texts are cut where the tokenizer's splitting rule always ends a word. The map of such a chunk takes the
  start state to itself, so it is kept as its number of tokens alone, memoised by the chunk's text. All
  chunks of many texts are composed at once by one scan (cumulative sums in numpy), and each text's
  count is the difference of the scan at its two ends.
* A word of more than BLOCK letters has no such place inside. It is cut into blocks that are run from a
  guessed entry state (warmed up on the text before them) and composed by an up-sweep over their maps; a map
  that is asked for another entry state is run from that as well, and passes it down. The down-sweep of
  prefix_scan gives the state at every block. Maps are a few numbers each, so memory grows with the
  number of blocks.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import MEMO_BYTES, Memo, documents, map_columns, named
from .merges import Machine

#: White space as the splitting rule sees it; a word never goes on after white space begins.
SPACE = " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BLOCK = 512
WARM_UP = 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Transducer(Machine):
    """Deterministic, over byte letters; state 0 is the start of a word."""

    def __init__(self, merges: list[tuple[str, str]], vocab: set[str]):
        ranks = {tuple(p): i for i, p in enumerate(merges)}
        super().__init__(vocab, lambda a, b: ranks.get((a, b)), (("", None, 0),))

    def compile(self, state: int, letter: str) -> tuple[int, int]:
        """The transition by letter: (next state, tokens emitted)."""
        last, count, live = None, 0, []
        for suffix, before, delta in self.live[state]:
            grown = suffix + letter
            if last is None and grown in self.vocab and self.compatible[before, grown]:
                last, count = grown, delta + 1
            if grown in self.begins:
                live.append((grown, before, delta))
        return self.add(state, letter, (*((s, b, d - count) for s, b, d in live), ("", last, 0)), count)

    def run(self, state: int, letters: str) -> tuple[int, int]:
        moves, total = self.moves, 0
        for letter in letters:
            state, n = moves[state][letter]
            total += n
        return state, total

    def count(self, letters: str) -> int:
        """Tokens of one word."""
        self.relieve()
        if len(letters) <= BLOCK:
            return self.run(0, letters)[1]
        cuts = range(0, len(letters), BLOCK)
        leaves = [StateMap.of(self, letters[i : i + BLOCK], {self.run(0, letters[max(0, i - WARM_UP) : i])[0]}) for i in cuts]
        return up_sweep(leaves).apply(0)[1]


class StateMap:
    """What a chunk does: entry state -> (exit state, emitted). It is a block of letters or two maps one after the
    other; entries are added as they are asked for, and no map holds the letters of those below it."""

    __slots__ = ("machine", "letters", "halves", "table")

    def __init__(self, machine: Transducer, letters: str = "", halves: tuple[StateMap, StateMap] | None = None):
        self.machine, self.letters, self.halves, self.table = machine, letters, halves, {}

    @classmethod
    def of(cls, machine: Transducer, letters: str, entries: set[int] = frozenset()) -> StateMap:
        made = cls(machine, letters)
        for e in entries:
            made.apply(e)
        return made

    def apply(self, entry: int) -> tuple[int, int]:
        if entry not in self.table:
            if self.halves is None:
                self.table[entry] = self.machine.run(entry, self.letters)
            else:
                middle, n = self.halves[0].apply(entry)
                end, m = self.halves[1].apply(middle)
                self.table[entry] = (end, n + m)
        return self.table[entry]

    def then(self, other: StateMap) -> StateMap:
        both = StateMap(self.machine, halves=(self, other))
        for entry in self.table:
            both.apply(entry)
        return both


def up_sweep(maps: list[StateMap]) -> StateMap:
    """The composition of all maps: neighbours are composed, then their compositions, and so on; one fewer
    compositions than maps, in a logarithmic number of rounds."""
    while len(maps) > 1:
        maps = [a.then(b) for a, b in zip(maps[::2], maps[1::2])] + maps[len(maps) & ~1 :]
    return maps[0]


def prefix_scan(maps: list[StateMap], entry: int = 0) -> list[tuple[int, int]]:
    """(state, tokens emitted) after each of the maps, from the entry state of the first: an up-sweep, and then a
    down-sweep in which every map gets the state that it is entered in."""
    out: list[tuple[int, int]] = []
    open_ = [(up_sweep(maps), entry, 0)] if maps else []
    while open_:
        node, state, before = open_.pop()
        if node.halves is None:
            end, n = node.apply(state)
            out.append((end, before + n))
        else:
            middle, n = node.halves[0].apply(state)
            open_ += [(node.halves[1], middle, before + n), (node.halves[0], state, before)]
    return out


class TokenCounter:
    """Counts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        machine, letters = Transducer(merges, set(model["vocab"])), byte_letters()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        word = Memo(lambda w: machine.count(w.encode().decode("latin-1").translate(letters)), MEMO_BYTES, 150, 4)

        def chunk(u: str) -> int:
            ends = u[-1] in ".,"
            body = u[1:-1] if ends else u[1:]
            if u[0] == " " and body.isalpha():  # the commonest kinds: one word, or one word and a mark
                return word[" " + body] + (word[u[-1]] if ends else 0)
            return sum(map(word.__getitem__, words.findall(u)))

        self.chunk = Memo(chunk, 4 * MEMO_BYTES, 150, 4)

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text: one scan over the maps of all texts' chunks."""
        emitted, ends, extra, chunk = [], np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), np.int64), self.chunk.__getitem__
        for k, text in enumerate(texts):
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                extra[k] = len(parts) - 1
                for part in parts:
                    emitted += map(chunk, UNITS.findall(part))
            else:
                emitted += map(chunk, UNITS.findall(text))
            ends[k + 1] = len(emitted)
        scan = np.concatenate(([0], np.cumsum(np.array(emitted, np.int64))))
        return np.diff(scan[ends]) + extra


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def with_token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit of each row's whole text.

    Null and empty texts have 0 tokens; repeated rows get a result each; an empty table gives none. Rows
    are not shuffled; a text of any length is counted.
    """

    def start():
        count = counter(path)

        def each(ids, texts):
            texts = [t or "" for t in texts]
            n = count.counts(texts)
            return [ids, [len(t.encode()) for t in texts], n, n > limit]

        return each

    rows = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(rows, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", start).toDF(id_col, "n_bytes", "n_tokens", "over_limit")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; null texts and empty tables as above."""
    import public_tokenizers

    return with_token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
