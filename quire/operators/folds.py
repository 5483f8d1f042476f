"""Folds over ordered groups: rows are dealt by group, sorted, and seen once, with a small state.

A group is never gathered; what a fold holds of it is its own state.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys in one partition. They are dealt by a hash of their own: an exchange by the keys
    themselves is left out where a join below has dealt them so, and adaptive execution may then change the join."""
    return rows.repartition(F.xxhash64(*keys))


def kept(rows: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], start: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The rows that a fold keeps: start() is called for every group, and what it returns for each row of
    it, in order, with the row's `columns`."""
    dealt = dealt_by(rows, keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, step = None, None
        for batch in batches:
            heads = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys))
            values = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))
            mask = []
            for head, value in zip(heads, values):
                if step is None or head != group:
                    group, step = head, start()
                mask.append(step(*value))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return dealt.mapInArrow(run, rows.schema)


def spaced(distance: int) -> Callable[[], Callable[[int], bool]]:
    """Keeps a position at least `distance` past the last kept one, and the first."""

    def start() -> Callable[[int], bool]:
        last: list[int] = []

        def step(position: int) -> bool:
            if last and position - last[0] < distance:
                return False
            last[:] = [position]
            return True

        return step

    return start


def far_from_all(taken: list[int], position: int, distance: int) -> bool:
    """Whether no member of the sorted list is nearer than `distance`."""
    at = bisect_left(taken, position)
    return (at == len(taken) or taken[at] - position >= distance) and (at == 0 or position - taken[at - 1] >= distance)


def chosen(points: list[int], most: int, distance: int) -> list[int]:
    """Up to `most` of the points, in their order of preference, each at least `distance` from all taken before."""
    taken: list[int] = []
    for p in points:
        if len(taken) >= most:
            break
        if far_from_all(taken, p, distance):
            insort(taken, p)
    return taken
