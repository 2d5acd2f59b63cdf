"""Whitening of embeddings: exact covariances by polarisation, eigenvectors, whitened rows.

The entries of a vector become whole numbers. For every dimension and every sum
of two dimensions the squares of the centred values are added up exactly; as
var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of these variances are
the covariances. Centred values are kept times n (n * x - S), so they are whole
numbers as well and nothing is rounded before the covariance matrix is divided.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import packed, unpacked

#: Entries from here on do not fit a long once scaled; such rows count as not finite.
LARGEST = 2.0**55
#: Rows squared at a time: sums of their products of 26-bit parts stay below 2^63.
BLOCK = 1 << 10
#: Whole numbers below this are squared in two parts; larger ones as Python integers.
PARTED = 1 << 52


@dataclass(frozen=True)
class Whitening:
    """n, sums S and spread of the fit list, covariance V, and its components in columns by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    spread: int
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(e / np.trace(self.covariance)) for e in self.values]


def usable(column: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers that fit a long once scaled."""
    fits = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & fits, F.lit(False))


def _matrix(batch: pa.RecordBatch, scale: int, shift: int) -> np.ndarray:
    lists = batch.column("_vec")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(lists), -1) * scale).astype(np.int64) + shift


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...], spread: int) -> np.ndarray:
    """n * x - S exactly, as int64 if n times the spread of a dimension allows, else as Python integers."""
    near = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    if n * (spread + 1) < 1 << 61:
        return (x - near) * n - np.array(rest, np.int64)
    return (x - near).astype(object) * n - np.array(rest, object)


def square_sums(y: np.ndarray) -> list[int]:
    """The exact sum of squares of every column."""
    if len(y) > BLOCK:
        return [sum(s) for s in zip(*[square_sums(y[at : at + BLOCK]) for at in range(0, len(y), BLOCK)], strict=True)]
    if y.dtype == object or (y.size and np.abs(y).max() >= PARTED):
        y = y.astype(object)
        return list((y * y).sum(axis=0)) if len(y) else [0] * y.shape[1]
    high, low = y >> 26, y & ((1 << 26) - 1)
    parts = [np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(hh << 52) + (hl << 27) + ll for hh, hl, ll in zip(*parts, strict=True)]


def _rows(df: DataFrame, column: str, dims: int | None = None) -> DataFrame:
    rows = df.where(usable(column)).select(F.col(column).cast("array<double>").alias("_vec"))
    return rows if dims is None else rows.where(F.size("_vec") == dims)


def _dimension(df: DataFrame, column: str) -> int:
    lengths = _rows(df, column).groupBy(F.size("_vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    return lengths[0]["dims"] if lengths else 0


_PARTS = "i int, j int, p0 decimal(20,0), p1 decimal(20,0), p2 decimal(20,0), p3 decimal(20,0)"
_LIMB = 48


def _limbs(total: int) -> list[Decimal]:
    mask = (1 << _LIMB) - 1
    return [Decimal(total >> (k * _LIMB) & mask) for k in range(3)] + [Decimal(total >> (3 * _LIMB))]


def polarised(df: DataFrame, column: str, n: int, sums: tuple[int, ...], spread: int, scale: int, shift: int) -> dict[tuple[int, int], int]:
    """Sum of squares of n-fold centred values, by dimension (i, i) and by sum of two dimensions (i, j)."""
    dims = len(sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for block in _blocks(batches):
            y = centred(_matrix(block, scale, shift), n, sums, spread)
            for i in range(dims):
                pairs = np.concatenate([y[:, i : i + 1], y[:, i : i + 1] + y[:, i + 1 :]], axis=1)
                for j, total in enumerate(square_sums(pairs), i):
                    held[i, j] = held.get((i, j), 0) + int(total)
        if held:
            limbs = list(zip(*map(_limbs, held.values()), strict=True))
            at = list(zip(*held, strict=True))
            yield pa.record_batch([pa.array(a, pa.int32()) for a in at] + [pa.array(p, pa.decimal128(20, 0)) for p in limbs], ["i", "j", "p0", "p1", "p2", "p3"])

    parts = _rows(df, column, dims).mapInArrow(partial, _PARTS)
    total = parts.groupBy("i", "j").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)])
    # one row for each pair of dimensions
    return {(r["i"], r["j"]): sum(int(r[f"p{k}"]) << (k * _LIMB) for k in range(4)) for r in total.collect()}


def fit(df: DataFrame, column: str, scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """The whitening of all usable vectors of a column; jobs run here, four passes over the column.

    Entries c become floor(scale * c) + shift. Vectors that are NULL, empty, or
    hold NULL, NaN, infinite entries or entries of 2^55 or more are left out, as
    are those of another length than the most common one (of equally common
    lengths the least). Repeated rows count as often as they occur. Without any
    vector the result is None. The driver receives one row for each pair of
    dimensions, never rows of the table.
    """
    dims = _dimension(df, column)
    if not dims:
        return None
    entry = F.floor(F.col("c") * scale).cast("long") + shift
    entries = _rows(df, column, dims).select(F.posexplode("_vec").alias("i", "c")).select("i", entry.alias("x"))
    stats = entries.groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()
    n, sums, spread = stats[0]["n"], tuple(int(r["s"]) for r in stats), max(r["hi"] - r["lo"] for r in stats)
    squares = polarised(df, column, n, sums, spread, scale, shift)
    cov = np.empty((dims, dims))
    for (i, j), q in squares.items():
        # sums are of (n * value)^2, so a variance is a sum over n^3; whole numbers until this one division
        cov[i, j] = cov[j, i] = q / n**3 if i == j else (q - squares[i, i] - squares[j, j]) / (2 * n**3)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    some = values > max(values[0], 0) * dims * np.finfo(float).eps * 8
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    return Whitening(n, sums, spread, cov, values[some], vectors[:, some])


def whiten(df: DataFrame, column: str, model: Whitening | None, limit: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """The rows with usable vectors of the model's length, with ``whitened`` (array of at most ``limit`` doubles) and ``deviation``.

    ``whitened`` is (x - S/n) projected on each component over the root of its
    eigenvalue, the largest eigenvalue first; directions without variance have no
    component. Each component's largest entry is positive. ``deviation`` is the
    exact sum over dimensions of (n*x - S)^2, as decimal(38,0), NULL beyond it.
    Outputs replace columns of the same name; all other columns, the vector's
    included, are kept. Without a model there are no rows.
    """
    kinds = {"whitened": "array<double>", "deviation": "decimal(38,0)"}
    rows = packed(df.where(usable(column)).where(F.size(column) == (len(model.sums) if model else 0)))
    if model is None:
        return unpacked(rows.where(F.lit(False)), {k: F.lit(None).cast(v) for k, v in kinds.items()})
    sent = rows.select("_row", F.col(f"_row.`{column}`").cast("array<double>").alias("_vec"))
    n, sums, spread = model.n, model.sums, model.spread
    base = model.components[:, :limit] / np.sqrt(model.values[:limit])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            y = centred(_matrix(block, scale, shift), n, sums, spread)
            z = (y / n).astype(np.float64) @ base
            whole = pa.array([Decimal(q) if q < 10**38 else None for q in square_sums(y.T) or []], pa.decimal128(38, 0))
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
            yield pa.record_batch([block.column("_row"), lists, whole], ["_row", "_z", "_dev"])

    out = sent.mapInArrow(project, f"_row {rows.schema['_row'].dataType.simpleString()}, _z array<double>, _dev decimal(38,0)")
    return unpacked(out, {"whitened": F.col("_z"), "deviation": F.col("_dev")})


def identity_error(whitened: DataFrame, column: str = "whitened") -> float:
    """Largest absolute entry of (covariance of the whitened vectors - identity), measured on the rows; 0 without rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lists = batch.column("_z")
            z = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            held = z.T @ z if held is None else held + z.T @ z
        if held is not None:
            i, j = np.triu_indices(len(held))
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(held[i, j])], ["i", "j", "s"])

    parts = whitened.select(F.col(column).alias("_z")).mapInArrow(partial, "i int, j int, s double")
    sums = {(r["i"], r["j"]): r["s"] for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    n = sums.get((0, 0), 0)
    return max((abs(s / n - sums[0, i] / n * sums[0, j] / n - (i == j)) for (i, j), s in sums.items() if i), default=0.0) if n else 0.0
