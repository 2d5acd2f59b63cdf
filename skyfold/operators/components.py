"""Connected components: edges near each other are contracted in their task, alternating stars settle what is left."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyfold.session import cut_lineage

#: Edges that a task contracts at a time.
HELD_EDGES = 1 << 20


def least_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least node of its component, of edges (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _near_stars(links: DataFrame, keys: list[str], held: int) -> DataFrame:
    """Stars that connect what the links (keys, u, v) connect: of any ``held`` links next to each other, each node and the least one it reaches."""

    def stars(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables)
        group = table.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(table), np.int64)
        u, v = (table.column(c).to_numpy(zero_copy_only=False) for c in "uv")
        n = len(u)
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        nodes, inner = np.unique(np.tile(group, 2) * len(ids) + at, return_inverse=True)
        root = least_roots(inner[:n], inner[n:], len(nodes))
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        some = np.empty(len(nodes), np.int64)
        some[inner] = np.tile(np.arange(n), 2)  # a row that has the node's keys
        out = {k: table.column(k).take(pa.array(some[leaf])) for k in keys}
        kind = table.schema.field("u").type
        return pa.table(out | {"u": pa.array(ids[nodes[leaf] % len(ids)], kind), "v": pa.array(ids[nodes[root[leaf]] % len(ids)], kind)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, size = [], 0
        for batch in batches:
            tables.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= held:
                yield from stars(tables).to_batches()
                tables, size = [], 0
        if size:
            yield from stars(tables).to_batches()

    near = links.repartitionByRange(*keys, "u").sortWithinPartitions(*keys, "u")
    return near.mapInArrow(run, links.schema)


def connected_components(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, a: str, b: str, label: str = "component", held: int = HELD_EDGES
) -> DataFrame:
    """Labels each node with the smallest node id of its component.

    The edges are dealt by range of their larger end, and a task contracts ``held``
    of them at a time into stars. A node that is only a leaf hangs on the least
    centre it has and joins its other centres with that one; so only centres are
    left, few where ids near each other are neighbours. On these, each round points every node at the least node seen next to it, first among
    its larger neighbours, then among its smaller ones; this settles in a
    logarithmic number of rounds whatever the diameter. Minima are partial
    aggregates, and the hub of a big component only meets its one-row minimum,
    so a giant component does not gather in one task.
    """
    keys = list(keys)
    links = edges.select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").dropna(subset=keys)
    stars = cut_lineage(_near_stars(links, keys, held))
    centres = stars.select(*keys, F.col("v").alias("u")).distinct()
    leaves = stars.join(centres, [*keys, "u"], "left_anti")
    hung = cut_lineage(leaves.groupBy(*keys, "u").agg(F.min("v").alias("p"), F.max("v").alias("_most")))
    tied = leaves.join(hung.where("p <> _most").select(*keys, "u", "p"), [*keys, "u"]).where("v <> p")
    links = cut_lineage(
        stars.join(centres, [*keys, "u"], "left_semi").unionByName(tied.select(*keys, F.col("v").alias("u"), F.col("p").alias("v"))).distinct()
    )

    def are_stars(df: DataFrame) -> bool:
        """Every node points at one other, which points nowhere; exact, from one partial aggregate for each node."""
        ends = df.select(*keys, F.explode(F.array(
            F.struct(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")),
            F.struct(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")),
        )).alias("e")).select(*keys, "e.*")
        met = ends.groupBy(*keys, "n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        return met.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()

    while not are_stars(links):
        both = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, [*keys, "u"])
            .where(F.col("v") > F.col("u"))
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        lower = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, [*keys, "u"])
            .select(*keys, F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("e"))
            .select(*keys, "e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        links = cut_lineage(small)
    ends = links.select(*keys, F.col("u").alias("p"), F.col("v").alias("_root"))
    roots = hung.join(ends, [*keys, "p"], "left").select(*keys, "u", F.coalesce("_root", "p").alias("_root"))
    roots = roots.unionByName(links.select(*keys, "u", F.col("v").alias("_root")))
    # as many rows as nodes: ids take few bytes on disk, and by these alone they would be sent to every task
    return nodes.join(
        roots.withColumnRenamed("u", node).hint("merge"), [*keys, node], "left"
    ).withColumn(label, F.coalesce("_root", node)).drop("_root")
