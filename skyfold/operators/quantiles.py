"""Exact quantiles of groups of any size.

``F.percentile`` keeps the distinct values of a group in one task; that suits
bounded groups such as the grey levels of a frame. ``exact_quantiles`` is for
groups without a bound: a mergeable sketch brackets each quantile, values
outside the bracket are only counted, and copies are folded into counts, so
the part of a group that meets in one task is a few millionths of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    quantiles: dict[str, float],
    accuracy: int = 1_000_000,
) -> DataFrame:
    """One row per group with one linear-interpolated quantile per given name."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    data = df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    slack = 4.0 / accuracy
    brackets = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(p).alias("p"),
            F.percentile_approx("_v", F.lit(max(0.0, p - slack)), accuracy).alias("lo"),
            F.percentile_approx("_v", F.lit(min(1.0, p + slack)), accuracy).alias("hi"),
        )
        for name, p in quantiles.items()
    ]
    summary = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.array(*brackets).alias("_b"),
    )
    # The sketch may sit one rank off at a border: widen to the value range ends.
    summary = summary.withColumn(
        "_b",
        F.transform("_b", lambda b: b.withField(
            "lo", F.when(b["p"] <= slack, F.col("_min")).otherwise(b["lo"])
        ).withField("hi", F.when(b["p"] >= 1 - slack, F.col("_max")).otherwise(b["hi"]))),
    )
    paired = data.join(summary.select(*keys, "_b"), keys).select(*keys, "_v", F.explode("_b").alias("_b"))
    # Values below and above the bracket are one counted row each; the row keeps the
    # value next to the bracket, which interpolation may need.
    side = F.when(F.col("_v") < F.col("_b.lo"), 0).when(F.col("_v") <= F.col("_b.hi"), 1).otherwise(2)
    sided = paired.withColumn("_side", side)
    banded = sided.groupBy(
        *keys, F.col("_b.name").alias("_name"), "_side", F.when(F.col("_side") == 1, F.col("_v")).alias("_in")
    ).agg(
        F.count(F.lit(1)).alias("_c"),
        F.when(F.col("_side") == 2, F.min("_v")).otherwise(F.max("_v")).alias("_bv"),
    )
    upto = (
        Window.partitionBy(*keys, "_name").orderBy("_side", "_bv").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = banded.withColumn("_upto", F.sum("_c").over(upto))
    probabilities = F.create_map(*[x for n, p in quantiles.items() for x in (F.lit(n), F.lit(p))])
    positions = (
        ranked.join(summary.select(*keys, "_n"), keys)
        .withColumn("_rank", F.element_at(probabilities, F.col("_name")) * (F.col("_n") - 1))
    )
    low = F.min(F.when(F.col("_upto") > F.floor("_rank"), F.col("_bv")))
    high = F.min(F.when(F.col("_upto") > F.ceil("_rank"), F.col("_bv")))
    part = F.first("_rank") - F.floor(F.first("_rank"))
    solved = positions.groupBy(*keys, "_name").agg(low.alias("_lo"), high.alias("_hi"), part.alias("_f"))
    result = solved.withColumn("_q", F.col("_lo") + (F.coalesce("_hi", "_lo") - F.col("_lo")) * F.col("_f"))
    return result.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in quantiles]
    )
