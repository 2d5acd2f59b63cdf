"""Sessions of ordered events by a gap in time, from mergeable parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from skyfold.operators.ordered import running_sums, with_neighbour


def gap_sessions(events: DataFrame, keys: Sequence[str], time: str, gap: float, chunk: float = 3600.0) -> DataFrame:
    """(keys, session, events, started, ended): events less than ``gap`` seconds after the one before share a session.

    ``time`` is in seconds. Each (group, time chunk) is cut into parts by itself: first,
    last and count. Parts are few; where a part begins less than the gap after the one
    before ends, whatever the chunk, the two are one session. So a group that holds
    most rows is many tasks of one chunk each. ``session`` numbers a group's sessions from 0.
    """
    keys = list(keys)
    local = events.select(*keys, F.col(time).alias("_t")).withColumn("_chunk", F.floor(F.col("_t") / chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_t")
    fresh = F.coalesce(F.col("_t") - F.lag("_t").over(inside) >= gap, F.lit(True)).cast("int")
    numbered = local.withColumn("_new", fresh).withColumn("_part", F.sum("_new").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*keys, "_chunk", "_part").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n"))
    wide = F.floor(F.col("_first") / (chunk * 1000))
    linked = with_neighbour(parts, keys, ["_first"], wide, ["_last"], "_before")
    opens = F.when(F.col("_before").isNull() | (F.col("_first") - F.col("_before._last") >= gap), 1).otherwise(0).cast("long")
    placed = running_sums(linked.withColumn("_opens", opens), keys, ["_first"], wide, {"_nth": F.col("_opens")})
    return placed.groupBy(*keys, (F.col("_nth") - 1).alias("session")).agg(
        F.sum("_n").alias("events"), F.min("_first").alias("started"), F.max("_last").alias("ended")
    )
