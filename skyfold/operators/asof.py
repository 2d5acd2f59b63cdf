"""Nearest-in-time join with a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    right_id: str,
    right_columns: Sequence[str],
    tolerance: float = 1.5,
    match: str = "match",
    span: float | None = None,
) -> DataFrame:
    """Each left row with the closest right row of its group, or NULL.

    The tolerance is inclusive and a tie goes to the earlier right row. Time is
    cut into spans; right rows near a border are sent to both sides of it, so
    each (group, span) is a bounded, independent timeline and one hot group is
    spread over all its spans. Right rows with equal time are folded first.
    """
    keys = list(keys)
    span = span or max(64.0 * tolerance, 60.0)
    fixes = (
        right.groupBy(*keys, F.col(right_time).alias("_t"))
        .agg(F.min_by(F.struct(right_id, *right_columns), F.col(right_id)).alias("_fix"))
        .select(
            *keys,
            "_t",
            F.explode(
                F.sequence(
                    F.floor((F.col("_t") - tolerance) / span),
                    F.floor((F.col("_t") + tolerance) / span),
                )
            ).alias("_span"),
            F.struct("_t", "_fix").alias("_right"),
            F.lit(0).alias("_side"),
        )
    )
    rows = left.select(
        *keys,
        F.col(left_time).alias("_t"),
        F.floor(F.col(left_time) / span).alias("_span"),
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_left"),
    )
    timeline = fixes.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_span").orderBy("_t", "_side")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    seen = timeline.withColumn("_prev", F.last("_right", ignorenulls=True).over(back)).withColumn(
        "_next", F.first("_right", ignorenulls=True).over(ahead)
    )
    gap_prev = F.col("_t") - F.col("_prev._t")
    gap_next = F.col("_next._t") - F.col("_t")
    closest = F.when(
        F.col("_next").isNull() | (gap_prev <= gap_next), F.col("_prev")
    ).otherwise(F.col("_next"))
    return (
        seen.where(F.col("_side") == 1)
        .withColumn("_best", closest)
        .withColumn("_gap", F.abs(F.col("_best._t") - F.col("_t")))
        .select(
            "_left.*",
            F.when(F.col("_gap") <= tolerance, F.col("_best._fix")).alias(match),
            F.when(F.col("_gap") <= tolerance, F.col("_gap")).alias("time_gap"),
        )
    )
