"""A count-min sketch merged from the tasks' own, as bit tables that every task can hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyfold.llm.common import frozen, mix

#: A row of the sketch is merged in 2 ** SLICES slices, so a task leaves a bounded number of them, or in one if it is small.
SLICES = 6
SLICE_BITS = 18


def _cells(keys: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    return [(mix(keys + np.uint64(0x1000003 * (d + 1))) >> np.uint64(64 - bits)).astype(np.int64) for d in range(depth)]


class Sketch:
    """For each level of ``levels``, the cells counted at least so often: depth * 2 ** bits / 8 bytes for each level, whatever the input."""

    def __init__(self, bits: int, depth: int, levels: int):
        self.bits, self.depth = bits, depth
        self.tables = [[np.zeros(1 << bits >> 3, np.uint8) for _ in range(depth)] for _ in range(levels)]

    def test(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        """Whether the count of each key is estimated to reach the level; never false for one that does."""
        out = np.ones(len(keys), bool)
        for table, c in zip(self.tables[level], _cells(keys, self.bits, self.depth)):
            out &= (table[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def merged_sketch(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, depth: int, levels: list[int]) -> Sketch:
    """Counts of the keys that ``keys_of`` yields in each task.

    A task leaves, for each slice of each row of the sketch, the cells it counted;
    all of a slice meet in one task, which adds them up in an array of the slice's
    size. Only the bits of the levels reach the driver.
    """
    bits = max(bits, SLICE_BITS)
    slice_bits = max(bits - SLICES, SLICE_BITS)
    wide = 1 << slice_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in keys_of(batches):
            for d, cells in enumerate(_cells(keys, bits, depth)):
                cells, n = np.unique(cells, return_counts=True)
                cuts = np.flatnonzero(np.diff(cells >> slice_bits, prepend=-1))
                parts = [(d, int(cells[x] >> slice_bits), (cells[x:y] & (wide - 1)).astype(np.int32).tobytes(), None if n[x:y].max() == 1 else n[x:y].astype(np.int32).tobytes()) for x, y in zip(cuts, [*cuts[1:], len(cells)])]
                if parts:
                    d_, s_, c_, n_ = zip(*parts)
                    yield pa.RecordBatch.from_arrays([pa.array(d_, pa.int32()), pa.array(s_, pa.int32()), pa.array(c_, pa.binary()), pa.array(n_, pa.binary())], names=["d", "s", "cells", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def out():
            found = [np.packbits(sums >= level).tobytes() for level in levels]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([found], pa.list_(pa.binary()))], names=["d", "s", "bits"])

        for b in batches:
            for d, s, cells, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                if now != (d, s):
                    if now is not None:
                        yield out()
                    now, sums = (d, s), np.zeros(wide, np.int32)
                sums[np.frombuffer(cells, np.int32)] += 1 if n is None else np.frombuffer(n, np.int32)
        if now is not None:
            yield out()

    counted = rows.mapInArrow(count, "d int, s int, cells binary, n binary")
    merged = frozen(counted.repartition("d", "s").sortWithinPartitions("d", "s").mapInArrow(merge, "d int, s int, bits array<binary>"))
    sketch, size = Sketch(bits, depth, len(levels)), wide // 8
    for r in merged.toLocalIterator():
        for tables, data in zip(sketch.tables, r["bits"]):
            tables[r["d"]][r["s"] * size : (r["s"] + 1) * size] = np.frombuffer(bytes(data), np.uint8)
    return sketch
