"""Helpers of the document operators: frozen tables, packed rows, prefix sums, word tables and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.session import cut_lineage

#: The separators between words, as Java and Python patterns read them.
SPACES = r"[ \t-\r]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def frozen(df: DataFrame) -> DataFrame:
    """The rows written once to the cluster's shared folder, so that every later read sees the same rows."""
    return cut_lineage(df, _made[-1] if _made else None)


_made: list[list[str]] = []


@contextmanager
def noted_tables(paths: list[str]) -> Iterator[None]:
    """Notes in ``paths`` the tables that operators write meanwhile, so that their caller can drop them when its result is written."""
    _made.append(paths)
    try:
        yield
    finally:
        _made.pop()


def packed(docs: DataFrame, name: str = "_row") -> DataFrame:
    """All columns in one struct, so that working columns cannot clash with the caller's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))


def unpacked(df: DataFrame, outputs: dict[str, Column], name: str = "_row") -> DataFrame:
    """The caller's columns and the outputs; an output replaces a column of the same name."""
    taken = {k.lower() for k in outputs}
    fields = [f.name for f in df.schema[name].dataType.fields if f.name.lower() not in taken]
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in fields], *[v.alias(k) for k, v in outputs.items()])


def numbered(docs: DataFrame) -> DataFrame:
    """(_row, _id): the packed rows with a name that stays the same whenever they are read.

    Rows read straight from Parquet files are named by file and place and not
    copied; all others are written once with a number.
    """
    if docs.inputFiles():
        try:
            place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), place.alias("_id"))
        except AnalysisException:
            pass
    return frozen(packed(docs).withColumn("_id", F.monotonically_increasing_id()))


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The array of words of a text: runs of what is not a space or U+0009 to U+000D."""
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint if a count of the (frozen) rows stays within the limit; else the planner's own join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def prefix_sums(df: DataFrame, order: list[str], value: str, group: list[str] | None = None) -> DataFrame:
    """Adds ``before`` (sum of value over earlier rows), ``rank`` (their number) and ``total``, per group if one is given.

    Rows are dealt by range of (group, order), so a hot group lies in many
    partitions; only each partition's totals are summed in sequence, then each
    partition adds its own running sums. Rows equal in all order columns come in
    any order, so callers put every column that matters into the order.
    """
    group = group or []
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = frozen(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rank"),
        F.sum("_sum").over(Window.partitionBy(*group)).alias("_total"),
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    sums = dealt.withColumn("_own", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_at", F.row_number().over(inside) - 1)
    meet = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        meet = meet & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = sums.join(offsets, meet)
    return joined.select(*df.columns, (F.col("_before") + F.col("_own")).alias("before"), (F.col("_rank") + F.col("_at")).cast("long").alias("rank"), F.col("_total").alias("total"))


# --- word tables and hashes inside tasks -----------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so the second, the base of the rolling sums, is invertible
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _power(which: int, inverse: bool, n: int) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = pow(_ODD[which], -1, 1 << 64) if inverse else _ODD[which]
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[which, inverse] = have = np.cumprod(steps)
    return have[:n]


def _sums(values: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(which, False, len(values)), out=out[1:])
    return out


def byte_batches(rows: Iterable, size_of, limit: int = 1 << 20) -> Iterator[list]:
    """Consecutive rows in lists of about ``limit`` bytes; a longer row comes alone."""
    batch, held = [], 0
    for row in rows:
        n = size_of(row)
        if batch and held + n > limit:
            yield batch
            batch, held = [], 0
        batch.append(row)
        held += n
    if batch:
        yield batch


def _word_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its 8-byte pieces, each mixed with its number before it is added.

    Sums of powers modulo 2^64 would not do: they are equal for certain different
    words whatever the base (letters swapped throughout a long Thue-Morse word).
    """
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf),), np.uint64, padded.data, 0, (1,))
    pieces = (lengths + 7) // 8
    begin = np.cumsum(pieces) - pieces
    number = np.arange(int(pieces.sum())) - np.repeat(begin, pieces)
    left = np.minimum(np.repeat(lengths, pieces) - 8 * number, 8).astype(np.uint64)
    values = eight[np.repeat(starts, pieces) + 8 * number] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))
    mixed = mix(values ^ mix(number.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + seed)))
    sums = np.add.reduceat(mixed, begin) if len(begin) else np.empty(0, np.uint64)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(_ODD[0]))


class WordTable:
    """The words of some UTF-8 texts: byte borders, the text each one belongs to, and 64-bit hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False, seed: int = 0):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            buf = LOWER[buf]
        word = np.zeros(len(buf) + 1, bool)
        word[1:] = ~_IS_SPACE[buf]
        self.buf = buf
        self.starts = np.flatnonzero(word[1:] & ~word[:-1])
        self.ends = np.flatnonzero(word[:-1] & ~word[1:])
        borders = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(borders, self.starts, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hashes = _word_hashes(buf, self.starts, self.ends - self.starts, seed)

    def runs(self, k: int) -> np.ndarray:
        """Starts (word numbers) of all runs of k words inside one text."""
        n = len(self.text) - k + 1
        return np.flatnonzero(self.text[:n] == self.text[k - 1 :]) if n > 0 else np.empty(0, np.int64)

    def run_hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the k words from each place, for k up to some hundred: a rolling sum of mixed word hashes."""
        sums = _sums(self.hashes, 1)
        return mix((sums[at + k] - sums[at]) * _power(1, True, len(sums))[at])
