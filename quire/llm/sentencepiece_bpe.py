"""SentencePiece BPE encoding by a prefix table, and decoding.

For each prefix of a normalised text the table keeps its one last piece. An automaton follows the
suffixes that begin some piece, so it knows the pieces that end at a place; the one whose predecessor
in the table is compatible with it (see merges) is the last piece there. Its states are compiled as
texts ask for them, each transition storing the last piece found. The ids are then read off
backwards. Time is linear in the text.

A text can be cut between two letters that stand together in no piece. The model's pieces are asked
for that when it is loaded: cuts go before runs of word marks, around line ends, and between a
letter and a following full stop or comma. The tables of the units between cuts are memoised.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import MEMO_BYTES, Memo, documents, map_columns, named
from .merges import Machine

MARK = "▁"
NORMAL, BYTE = 1, 6


class Matches(Machine):
    """Letters to the last piece of the prefix read."""

    def compile(self, state: int, letter: str) -> tuple[int, str]:
        last, live = None, []
        for suffix, before in self.live[state]:
            grown = suffix + letter
            if last is None and grown in self.vocab and self.compatible[before, grown]:
                last = grown
            if grown in self.begins:
                live.append((grown, before))
        last = last or letter
        return self.add(state, letter, (*live, ("", last)), last)


class PieceModel:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.pieces = [p.piece for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        score = {p: -model.pieces[i].score for p, i in self.ids.items()}
        self.matches = Matches(self.ids, lambda a, b: score.get(a + b), (("", None),))
        self.units = self.cutter()
        self.memo = Memo(self.unit, 6 * MEMO_BYTES, 380, 8)  # ids, their text and the decoded text of a unit

    def cutter(self) -> re.Pattern:
        together = {pair for p in self.ids for pair in zip(p, p[1:])}
        if any(b == MARK != a for a, b in together):
            return re.compile(r"(?s).+")
        lines = "" if any("\n" in pair for pair in together) else "\n"
        letters = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]) if c.isalpha() and (c, ".") not in together and (c, ",") not in together)
        return re.compile((f"{MARK}*[{letters}]+(?=[.,])|" if letters else "") + f"{MARK}*[^{MARK}{lines}]+|{MARK}+" + (f"|{lines}+" if lines else ""))

    def prefix_table(self, text: str) -> list[str]:
        """The last piece of each prefix; a letter of no piece stands for itself."""
        self.matches.relieve()
        moves, state, last = self.matches.moves, 0, []
        for letter in text:
            state, piece = moves[state][letter]
            last.append(piece)
        return last

    def encode_unit(self, text: str) -> list[int]:
        last, at, out, ids = self.prefix_table(text), len(text), [], self.ids
        while at:
            piece = last[at - 1]
            at -= len(piece)
            if piece in ids:
                out.append(ids[piece])
            else:
                out.extend(self.bytes[b] for b in reversed(piece.encode()))
        return out[::-1]

    def decode_ids(self, ids: list[int]) -> str:
        """Pieces put together, bytes read as UTF-8; word marks are spaces (the dummy one is kept here)."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.pieces.__getitem__, ids)).replace(MARK, " ")
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def unit(self, text: str) -> tuple[int, str, str]:
        ids = self.encode_unit(text)
        return len(ids), ",".join(map(str, ids)), self.decode_ids(ids)

    def split(self, text: str) -> list[str]:
        return self.units.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(i) for u in self.split(text) for i in self.memo[u][1].split(",")]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_ids(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def with_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array<int>) and decoded text of each row; a null text is an empty one (no ids). Repeated
    rows get a result each, an empty table gives none, and a text of any length is encoded whole."""

    def start():
        model = piece_model(path)

        def each(keys, texts):
            ids = [model.encode(t or "") for t in texts]
            return [keys, ids, [model.decode(x) for x in ids]]

        return each

    rows = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return map_columns(rows, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string", start).toDF(id_col, "ids", "decoded")


def piece_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As with_pieces, but the number of ids and digests of both instead of the ids and the text."""

    def start():
        model = piece_model(path)

        def each(keys, texts):
            n, ids, decoded = [], [], []
            for t in texts:
                units = [model.memo[u] for u in model.split(t or "")]
                n.append(sum(u[0] for u in units))
                ids.append(hashlib.sha256(",".join([u[1] for u in units]).encode()).hexdigest())
                text = "".join([u[2] for u in units])
                decoded.append(hashlib.sha256((text[1:] if text.startswith(" ") else text).encode()).hexdigest())
            return [keys, n, ids, decoded]

        return each

    rows = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return map_columns(rows, f"id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", start).toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; nulls, repeats and empty tables as in with_pieces."""
    import public_tokenizers

    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
