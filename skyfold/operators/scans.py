"""Ordered computations as prefixes of chunk summaries.

A chunk's effect on whatever enters it is a small element, and elements of
neighbouring chunks combine into one (associatively). Chunks are summarised at
once, elements are composed along each group in blocks of blocks, and chunks run
once more from what enters them: two calls per chunk, one more if elements depend
on what enters (a gate), and again only for chunks where that changes the outcome.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skyfold.operators.ordered import group_starts, whole_groups
from skyfold.session import cut_lineage, spread

Element = list[float]
Combine = Callable[[Element, Element], Element]


def _value(cell) -> Element | str | None:
    if isinstance(cell, str):
        return cell
    return None if cell is None or (isinstance(cell, float) and pd.isna(cell)) else list(cell)


def exclusive_prefix(elements: DataFrame, keys: Sequence[str], order: str, combine: Combine, fan: int = 512) -> DataFrame:
    """(keys, order, before): the elements of all earlier rows of a group combined, NULL for its first row.

    ``elements`` has the columns keys, ``order`` and ``element`` (array of doubles, or text).
    A task combines at most ``fan`` elements; longer groups are composed in blocks,
    and the blocks' elements in the same way.
    """
    keys = list(keys)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    dealt = cut_lineage(elements.withColumn("_block", F.floor(at / fan).cast("long")))
    fields = {f.name: f for f in dealt.schema.fields}
    kind = fields["element"].dataType
    many = (dealt.agg(F.max("_block")).first()[0] or 0) > 0
    start = F.lit(None).cast(kind)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for cell in pdf.sort_values(order)["element"]:
            whole = _value(cell) if whole is None else combine(whole, _value(cell))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in [*keys, "_block"]}, "element": [whole]})

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        now, before = _value(pdf["_start"].iloc[0]), []
        for cell in pdf["element"]:
            before.append(now)
            now = _value(cell) if now is None else combine(now, _value(cell))
        return pdf[[*keys, order]].assign(before=before)

    if many:
        head = T.StructType([*[fields[k] for k in keys], fields["_block"], T.StructField("element", kind)])
        totals = dealt.groupBy(*keys, "_block").applyInPandas(total, head).withColumnRenamed("_block", "_at")
        starts = exclusive_prefix(totals, keys, "_at", combine, fan).withColumnsRenamed({"_at": "_block", "before": "_start"})
        dealt = dealt.join(starts, [*keys, "_block"])
    else:
        dealt = dealt.withColumn("_start", start)
    out = T.StructType([*[fields[k] for k in keys], fields[order], T.StructField("before", kind)])
    return dealt.groupBy(*keys, "_block").applyInPandas(inner, out)


def chunked_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    summarise: Callable[[pd.DataFrame, Element | None], Element],
    combine: Combine,
    emit: Callable[[pd.DataFrame, Element | None], pd.DataFrame],
    schema: str,
    descending: bool = False,
    settled: Callable[[Element, Element], bool] | None = None,
) -> DataFrame:
    """Output rows of every chunk, run from the composed elements of all chunks before it; jobs run here.

    ``summarise(rows, before)`` gives a chunk's element and ``emit(rows, before)``
    its output; rows come in order with a boolean column ``is_start`` (the chunk is
    its group's first) and ``before`` is None there. In the first round ``before``
    is None for every chunk, so a summary must not need it; if ``settled`` is given
    a summary may depend on it (as with gates), and rounds go on, over chunks for
    which ``settled(old, new)`` is false, until no element changes. In each round at
    least one more chunk of a group gets what a sequential run would give it.
    Memory per task is one chunk, or the batch that holds many small ones. An empty table gives no rows.
    """
    keys, order = list(keys), list(order)
    group = [*keys, "_chunk"]
    marked = df.withColumn("_chunk", -chunk if descending else chunk)
    firsts = marked.groupBy(*keys).agg(F.min("_chunk").alias("_least"))
    staged = cut_lineage(marked.join(firsts, keys).withColumn("is_start", F.col("_chunk") == F.col("_least")).drop("_least"))
    array = T.ArrayType(T.DoubleType())
    head = [f for f in staged.schema.fields if f.name in group]
    out = T.StructType([*head, T.StructField("element", array)])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int], list[pd.DataFrame]]]:
        """Tables of whole chunks, where each begins, and their rows; a batch becomes one frame, which is cut."""
        for table in whole_groups(batches, group):
            starts = group_starts(table, group).tolist()
            pdf = table.drop_columns(["_deal", "_nth"]).to_pandas()
            yield table, starts, [pdf.iloc[a:b].reset_index(drop=True) for a, b in zip(starts, [*starts[1:], len(pdf)])]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, parts in chunks(batches):
            made = [summarise(rows, _value(rows["before"].iloc[0])) for rows in parts]
            heads = table.select([f.name for f in head]).take(pa.array(starts, pa.int64()))
            yield from heads.append_column("element", pa.array(made, pa.list_(pa.float64()))).to_batches()

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, parts in chunks(batches):
            made = pd.concat([emit(rows, _value(rows["before"].iloc[0])) for rows in parts], ignore_index=True)
            yield from pa.Table.from_arrays([pa.Array.from_pandas(made[f.name], type=f.type) for f in wanted], schema=wanted).to_batches()

    def run(entering: DataFrame | None, fn, result) -> DataFrame:
        given = staged.withColumn("before", F.lit(None).cast(array)) if entering is None else staged.join(entering, group)
        # The window demands whole groups in order, which a repartition alone would not: it may be planned away.
        dealt = spread(given.withColumn("_deal", F.xxhash64(*group)), "_deal")
        inside = Window.partitionBy("_deal", *group).orderBy(*[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order])
        return dealt.withColumn("_nth", F.row_number().over(inside)).mapInArrow(fn, result)

    wanted = to_arrow_schema(T.StructType.fromDDL(schema))
    if staged.where("not is_start").isEmpty():
        return run(None, outputs, schema)
    elements = cut_lineage(run(None, summaries, out))
    seen = None
    while True:
        before = cut_lineage(exclusive_prefix(elements, keys, "_chunk", combine))
        if settled is None:
            break
        if seen is None:
            todo = before.where("before is not null")
        else:
            old = seen.withColumnRenamed("before", "old")

            def moved(pairs: pd.DataFrame) -> pd.DataFrame:
                keep = [a is not None and not settled(_value(b), _value(a)) for a, b in zip(pairs["before"], pairs["old"])]
                return pairs.loc[keep].drop(columns="old")

            met = before.where("before is not null").join(old, group)
            todo = cut_lineage(met.mapInPandas(lambda parts: map(moved, parts), T.StructType([*head, T.StructField("before", array)])))
            if todo.isEmpty():
                break
        seen = before
        fresh = run(todo, summaries, out).withColumnRenamed("element", "fresh")
        merged = cut_lineage(elements.join(fresh, group, "left"))
        changed = F.col("fresh").isNotNull() & (F.col("fresh") != F.col("element"))
        if merged.where(changed).isEmpty():
            break
        elements = cut_lineage(merged.select(*group, F.coalesce("fresh", "element").alias("element")))
    return run(before, outputs, schema)
