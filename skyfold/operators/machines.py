"""Ordered state machines over chunks, by transition tables.

A chunk is run from every state that may enter it, so it becomes a table from
entering to leaving states; tables of neighbouring chunks compose. States must hold
no counters (those are running sums of the output): then runs from different
states soon meet, and few states leave a chunk.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skyfold.operators.ordered import group_starts, whole_groups
from skyfold.operators.scans import exclusive_prefix
from skyfold.session import cut_lineage, spread

Decide = Callable[[Any, dict], tuple[dict | None, dict]]


def run_machine(rows: list, state: dict, decide: Decide) -> tuple[list[tuple[int, dict]], dict]:
    """(row number, record) of all rows with a record, and the state after the rows."""
    made = []
    for i, row in enumerate(rows):
        record, state = decide(row, state)
        if record is not None:
            made.append((i, record))
    return made, state


def leaving_states(rows: list, entering: list[dict], decide: Decide) -> list[dict]:
    """The state after the rows for each entering one; a run that meets an earlier one ends there."""
    met: dict[int, list[tuple[dict, int]]] = {}
    out: list[dict] = []
    for number, state in enumerate(entering):
        end = None
        for i, row in enumerate(rows):
            record, state = decide(row, state)
            if record is not None:
                same = next((k for s, k in met.get(i, ()) if s == state), None)
                if same is not None:
                    end = out[same]
                    break
                met.setdefault(i, []).append((state, number))
        out.append(state if end is None else end)
    return out


def _text(state: dict) -> str:
    return json.dumps(state, sort_keys=True) if state else ""


def _state(text: str | None) -> dict:
    return json.loads(text) if text else {}


def _composed(first: str, second: str) -> str:
    a, b = json.loads(first), json.loads(second)
    return json.dumps({k: b[v] for k, v in a.items() if v in b})


def _cells(column: pa.Array) -> list:
    """Python values of a column; a missing number is NaN, a list of numbers an array."""
    kind = column.type
    if pa.types.is_floating(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(kind):
        return column.to_pylist() if not column.null_count else [float("nan") if v is None else v for v in column.to_pylist()]
    if pa.types.is_list(kind) and (pa.types.is_floating(kind.value_type) or pa.types.is_integer(kind.value_type) or pa.types.is_struct(kind.value_type)):
        ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        flat = column.flatten()
        values = _cells(flat) if pa.types.is_struct(kind.value_type) else flat.to_numpy(zero_copy_only=False)
        return [values[a:b] if there else None for a, b, there in zip([0, *ends], ends, column.is_valid().to_pylist())]
    if pa.types.is_struct(kind):
        names = [kind.field(i).name for i in range(kind.num_fields)]
        parts = [_cells(part) for part in column.flatten()]
        return [dict(zip(names, values)) if there else None for there, *values in zip(column.is_valid().to_pylist(), *parts)]
    return column.to_pylist()


def _rows(table: pa.Table) -> list:
    kept = [c for c in table.column_names if not c.startswith("_")]
    row = namedtuple("Row", kept, rename=True)
    return list(map(row._make, zip(*(_cells(table.column(c).combine_chunks()) for c in kept))))


def table_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    decide: Decide,
    outputs: Sequence[str],
    schema: str,
    seeds: Callable[[Any], list[dict]] = lambda first: [],
    along: Callable[[dict, Any], list[dict]] = lambda state, first: [state],
    anchor: str = "",
) -> DataFrame:
    """The records of a machine run over each group in order; jobs run here.

    ``decide(row, state)`` returns a record (or None) and the new state, a dictionary
    that is empty at the start of a group; the output rows are the columns
    ``outputs`` of the rows with a record, and the record. Every chunk is run once
    from the start and from ``seeds(its first row)``, once from all states that leave
    the chunk before it, and once for the output. Should the composed tables meet a
    state that a chunk does not know, that chunk is run from it; if the state's field
    ``anchor`` has not changed since the last such state, so are as many chunks after
    it as were run then and twice more, from the states that it may be there
    (``along(state, first row)``). A state that passes many chunks thus takes a
    logarithm of their number of rounds. The result is that of a sequential run. Memory per
    task is one chunk, or the batch that holds many small ones. An empty table gives no rows.
    """
    keys, order = list(keys), list(order)
    group = [*keys, "_chunk"]
    staged = cut_lineage(df.withColumn("_chunk", chunk))
    head = [f for f in staged.schema.fields if f.name in group]
    table_schema = T.StructType([*head, T.StructField("entry", T.StringType()), T.StructField("exit", T.StringType())])

    def cut(table: pa.Table) -> list[tuple[int, int]]:
        starts = group_starts(table, group).tolist()
        return list(zip(starts, [*starts[1:], table.num_rows]))

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group):
            rows, groups = _rows(table), cut(table)
            given = table.select(["_entries", "_seeded", "_passing"]).take([a for a, _ in groups]).to_pylist()
            at, entry, leaving = [], [], []
            for (a, b), asked in zip(groups, given):
                entries = {text: _state(text) for text in asked["_entries"]}
                if asked["_seeded"]:
                    entries.update((_text(s), s) for s in seeds(rows[a]))
                for text in asked["_passing"]:
                    entries.update((_text(s), s) for s in along(_state(text), rows[a]))
                leaving += map(_text, leaving_states(rows[a:b], list(entries.values()), decide))
                entry += entries
                at += [a] * len(entries)
            heads = table.select([f.name for f in head]).take(pa.array(at, pa.int64()))
            yield from heads.append_column("entry", pa.array(entry, pa.string())).append_column("exit", pa.array(leaving, pa.string())).to_batches()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group):
            rows, groups = _rows(table), cut(table)
            at, records = [], []
            for (a, b), text in zip(groups, table.column("_entry").take([a for a, _ in groups]).to_pylist()):
                for i, record in run_machine(rows[a:b], _state(text), decide)[0]:
                    at.append(a + i)
                    records.append(record)
            taken = table.select(list(dict.fromkeys(outputs))).take(pa.array(at, pa.int64()))
            made = {f.name: pa.array([r[f.name] for r in records], from_pandas=True, type=f.type) for f in wanted if f.name not in outputs}
            columns = [made[f.name] if f.name in made else taken.column(f.name).cast(f.type) for f in wanted]
            yield from pa.Table.from_arrays(columns, schema=wanted).to_batches()

    def run(given: DataFrame, fn, result) -> DataFrame:
        # The window demands whole groups in order, which a repartition alone would not: it may be planned away.
        dealt = spread(given.withColumn("_deal", F.xxhash64(*group)), "_deal")
        inside = Window.partitionBy("_deal", *group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
        return dealt.withColumn("_nth", F.row_number().over(inside)).mapInArrow(fn, result)

    wanted = to_arrow_schema(T.StructType.fromDDL(schema))
    texts = T.ArrayType(T.StringType())
    none = F.array().cast(texts)

    def evaluate(entries: DataFrame) -> DataFrame:
        return run(staged.join(entries, group), transitions, table_schema)

    along_group = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = cut_lineage(
        staged.select(*group).distinct().withColumn("_pos", F.row_number().over(along_group)).withColumn("_next", F.lead("_chunk").over(along_group))
    )
    if chunks.where("_pos > 1").isEmpty():
        return run(staged.withColumn("_entry", F.lit("")), emit, schema)
    start = chunks.select(*group, F.array(F.lit("")).alias("_entries"), none.alias("_passing"), F.lit(True).alias("_seeded"))
    table = cut_lineage(evaluate(start))
    after = table.join(chunks.select(*group, "_next"), group).where("_next is not null")
    after = after.select(*keys, F.col("_next").alias("_chunk"), F.col("exit").alias("entry")).distinct()
    known = table.select(*group, "entry")
    asked = after.join(known, [*group, "entry"], "left_anti").groupBy(*group).agg(F.collect_list("entry").alias("_entries"))
    asked = asked.withColumn("_passing", none).withColumn("_seeded", F.lit(False))
    table = cut_lineage(table.unionByName(evaluate(asked)))
    held = None
    while True:
        firsts = chunks.select(*group, "_pos")
        useful = table.join(firsts, group).where("_pos > 1 or entry = ''")
        maps = useful.groupBy(*group).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("entry", "exit")))).alias("element"))
        before = exclusive_prefix(maps, keys, "_chunk", _composed)
        state = F.from_json("before", "map<string,string>")[""]
        entering = cut_lineage(before.select(*group, F.when(F.col("before").isNull(), "").otherwise(state).alias("_entry")))
        known = table.select(*group, F.col("entry").alias("_entry"))
        lost = entering.where("_entry is not null").join(known, [*group, "_entry"], "left_anti").join(firsts, group)
        lost = lost.withColumn("_held", F.get_json_object("_entry", f"$.{anchor}"))
        if held is None:
            lost = lost.withColumn("_reach", F.lit(1))
        else:
            last = held.select(*keys, F.col("_held").alias("_last"), F.col("_reach").alias("_was"))
            lost = lost.join(last, keys, "left").withColumn("_reach", F.when(F.col("_held") == F.col("_last"), F.col("_was") * 2).otherwise(1))
        held = lost = cut_lineage(lost)
        if lost.isEmpty():
            break
        near = lost.select(*keys, F.col("_entry").alias("_text"), F.col("_pos").alias("_from"), "_reach")
        range_of = near.withColumn("_pos", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_reach") - 1)))
        met = range_of.join(chunks.select(*group, "_pos"), [*keys, "_pos"])
        here = F.col("_pos") == F.col("_from")
        asked = met.groupBy(*group).agg(F.collect_set(F.when(here, F.col("_text"))).alias("_entries"), F.collect_set(F.when(~here, F.col("_text"))).alias("_passing"))
        fresh = evaluate(asked.withColumn("_seeded", F.lit(False)))
        table = cut_lineage(table.unionByName(fresh.join(table.select(*group, "entry"), [*group, "entry"], "left_anti")))
    return run(staged.join(entering, group), emit, schema)
