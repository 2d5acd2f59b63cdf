"""Order-dependent operators that never need a whole group in one task.

Every function takes a ``chunk`` column: a coarse value that never decreases
along the order of a group (a day number, or an index divided by a block size).
Work is done per (group, chunk); only one small row per chunk is looked at per
group. A group that holds a third of all rows is thus many bounded tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def running_index(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column, name: str) -> DataFrame:
    """Zero-based position of each row inside its group."""
    keys = list(keys)
    staged = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        staged.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_local") - 1 + F.col("_offset"))
        .drop("_chunk", "_local", "_offset")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column, sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over the rows of the group up to and including this one."""
    keys = list(keys)
    staged = df.withColumn("_chunk", chunk).withColumns({f"_v_{n}": c for n, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    totals = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumns({f"_v_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    joined = local.join(totals, [*keys, "_chunk"]).withColumns({n: F.col(f"_v_{n}") + F.col(f"_t_{n}") for n in sums})
    return joined.drop("_chunk", *[f"_{p}_{n}" for n in sums for p in "vt"])


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    columns: Sequence[str],
    name: str,
    following: bool = False,
) -> DataFrame:
    """Adds a struct of ``columns`` of the previous (or following) row of the group."""
    keys, order = list(keys), list(order)
    staged = df.withColumn("_chunk", chunk).withColumn("_row", F.struct(*columns))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = (F.lead if following else F.lag)("_row").over(inside)
    edge = (F.min_by if following else F.max_by)("_row", F.struct(*order))
    between = Window.partitionBy(*keys).orderBy("_chunk")
    borders = (
        staged.groupBy(*keys, "_chunk")
        .agg(edge.alias("_edge"))
        .withColumn("_edge", (F.lead if following else F.lag)("_edge").over(between))
    )
    return (
        staged.withColumn("_near", local)
        .join(borders, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_near", "_edge"))
        .drop("_chunk", "_row", "_near", "_edge")
    )


def group_starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Positions at which a sorted table's next group begins, 0 included; NULL is a key like any other."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in names:
        code = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches as tables that cut no group: many small groups at once, or one group longer than a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        starts = group_starts(pa.Table.from_batches([*last, batch]), names) - len(last)
        if starts[-1] <= 0:  # the whole batch goes on with the group before it, or is its first
            if held and starts[-1] == 0:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held)
