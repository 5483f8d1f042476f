"""What the two BPE operators share: merge simulation and pair compatibility.

A sequence of pieces is the encoding of its text exactly when every piece encodes to itself and
every two neighbours, put together, encode to just these two: merges across a boundary depend on
the two pieces beside it alone. So each prefix of a text has one last piece, and it is the one
whose predecessor (the last piece of the shorter prefix) is compatible with it.
"""

from __future__ import annotations

from collections.abc import Callable

from .common import Memo

MACHINE_BYTES = 256 << 20

Rank = Callable[[str, str], float | None]


def simulate(text: str, rank: Rank) -> list[str]:
    """BPE by its definition: the best pair, the leftmost of equals, is merged until none is left."""
    parts = list(text)
    ranks = [rank(a, b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(ranks):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        if at < len(ranks):
            ranks[at] = rank(parts[at], parts[at + 1])
        if at:
            ranks[at - 1] = rank(parts[at - 1], parts[at])


def compatibility(rank: Rank) -> Memo:
    """(last piece, next piece) -> whether both stay; a last piece of None or '' is the start."""

    def test(pair: tuple[str | None, str]) -> bool:
        before, piece = pair
        return simulate((before or "") + piece, rank) == ([before, piece] if before else [piece])

    return Memo(test, 128 << 20, 280)


class Moves(dict):
    """The transitions out of one state; those not asked for before are compiled."""

    __slots__ = ("machine", "state")

    def __init__(self, machine: Machine, state: int):
        self.machine, self.state = machine, state

    def __missing__(self, letter: str) -> tuple:
        return self.machine.compile(self.state, letter)


class Machine:
    """A deterministic machine whose states are compiled as texts ask for them.

    A state lists the suffixes of the text so far that begin some piece, each with what a subclass
    must remember of the text before it; state 0 is the start. Between texts the machine starts anew when
    its states hold more than `limit` bytes.
    """

    def __init__(self, vocab, rank: Rank, start: tuple, limit: int = MACHINE_BYTES):
        self.vocab, self.start, self.limit = vocab, start, limit
        self.begins = {t[:k] for t in vocab for k in range(1, len(t))}
        self.compatible = compatibility(rank)
        self.reset()

    def reset(self) -> None:
        self.ids, self.live, self.moves, self.held = {self.start: 0}, [self.start], [Moves(self, 0)], 0

    def relieve(self) -> None:
        if self.held > self.limit:
            self.reset()

    def compile(self, state: int, letter: str) -> tuple:
        raise NotImplementedError

    def add(self, state: int, letter: str, live: tuple, emitted) -> tuple:
        to = self.ids.setdefault(live, len(self.live))
        if to == len(self.live):
            self.live.append(live)
            self.moves.append(Moves(self, to))
            self.held += 700 + 200 * len(live)  # about what a state takes
        self.held += 100
        move = self.moves[state][letter] = (to, emitted)
        return move
