"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import prefix_sums, text_of


def utf8_size(text_col: str = "text"):
    """UTF-8 bytes of a text (NULL: none) plus 1, so that empty rows have a place too."""
    return (F.octet_length(text_of(text_col)) + 1).cast("long")


def byte_shards(rows: DataFrame, size_col: str, order: list[str], shards: int = 16) -> DataFrame:
    """The rows with ``shard`` and ``slot``: shard numbers grow along ``order``, sizes are near equal.

    A row lies in the shard in which the middle of its bytes falls when all bytes
    are laid end to end and cut at equal targets, so a shard misses its target by
    half a row at each end at most. The positions come from one total per range
    partition; no row count or size limits a partition's share. ``slot`` counts
    the rows of a shard from 0 without gaps. Sizes are at least 1. Equal texts are
    rows like any others: they lie where their ids put them, in one shard or several. Rows equal in
    all of ``order`` are interchangeable. An empty table gives no rows; working
    columns named ``before``, ``rank`` and ``total`` must not be in ``rows``.
    """
    placed = prefix_sums(rows, order, size_col)
    dealt = placed.withColumn("shard", F.expr(f"cast((2 * before + `{size_col}`) * {shards} div (2 * total) as int)"))
    # one row for each shard: its size is bounded by the parameter
    first = dealt.groupBy(F.col("shard").alias("_s")).agg(F.min("rank").alias("_first"))
    return dealt.join(F.broadcast(first), F.col("shard") == F.col("_s")).select(*rows.columns, "shard", (F.col("rank") - F.col("_first")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; many tasks write into one, so a shard may be of any size."""
    sharded.write.partitionBy("shard").parquet(path)
