"""Illumination scores, status and controlled normalisation on pixel tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.functions.linalg import clip, rounded


@dataclass(frozen=True)
class IlluminationRules:
    over_level: int = 245
    under_level: int = 15
    shadow_level: int = 45
    reject_over_pct: float = 70.0
    reject_under_pct: float = 75.0
    reject_range: float = 12.0


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def illumination_metrics(pixels: DataFrame, rules: IlluminationRules = IlluminationRules()) -> DataFrame:
    """Clipping shares, luminance statistics and the three scores per frame.

    Grey levels have at most 256 values, so the exact percentiles stay small.
    """
    g = F.col("gray")
    base = pixels.groupBy("frame_id").agg(
        F.round(_share(g >= rules.over_level) * 100, 2).alias("overexposure_percent"),
        F.round(_share(g <= rules.under_level) * 100, 2).alias("underexposure_percent"),
        _share(g <= rules.shadow_level).alias("_deep"),
        F.avg("gray").alias("_mean"),
        F.percentile("gray", F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))).alias("_p"),
        F.stddev_pop("gray").alias("_std"),
    )
    span = F.col("_p")[2] - F.col("_p")[0]
    clipping = (F.col("overexposure_percent") + F.col("underexposure_percent")) * 1.2
    return base.select(
        "frame_id", "overexposure_percent", "underexposure_percent",
        F.round(clip(F.col("_deep") / 0.40 * 100, 0, 100), 1).alias("shadow_score"),
        F.round(clip(span / 200.0 * 100, 0, 100), 1).alias("contrast_score"),
        F.round(clip(100.0 - (F.abs(F.col("_mean") - 125.0) * 0.4 + clipping), 0, 100), 1).alias("exposure_score"),
        F.round("_mean", 1).alias("mean_luminance"), F.round(F.col("_p")[1], 1).alias("median_luminance"),
        F.round(span, 1).alias("dynamic_range"), F.round("_std", 2).alias("rms_contrast"),
    )


def with_status(metrics: DataFrame, rules: IlluminationRules = IlluminationRules()) -> DataFrame:
    rejected = (
        (F.col("overexposure_percent") >= rules.reject_over_pct)
        | (F.col("underexposure_percent") >= rules.reject_under_pct)
        | (F.col("dynamic_range") <= rules.reject_range)
    )
    optimal = (F.col("exposure_score") >= 72) & (F.col("shadow_score") <= 30) & (F.col("contrast_score") >= 50)
    return metrics.withColumn(
        "status", F.when(rejected, "REJECTED").when(optimal, "OPTIMAL").otherwise("ACCEPTABLE")
    )


def channel_gains(pixels: DataFrame) -> DataFrame:
    """Grey-world gains from mid-tone pixels, clamped to 0.92..1.08."""
    mid = (F.col("gray") > 20) & (F.col("gray") < 240)
    means = pixels.groupBy("frame_id").agg(*[F.avg(F.when(mid, F.col(c))).alias(f"_{c}") for c in "bgr"])
    grey = (F.col("_b") + F.col("_g") + F.col("_r")) / 3.0
    gains = means.select(
        "frame_id", *[clip(grey / (F.col(f"_{c}") + 1e-5), 0.92, 1.08).alias(f"gain_{c}") for c in "bgr"]
    )
    applied = F.greatest(*[F.abs(F.col(f"gain_{c}") - 1.0) for c in "bgr"]) > 0.01
    has_mid = means.select("frame_id", F.col("_b").isNotNull().alias("_mid"))
    return gains.join(has_mid, "frame_id").withColumn("balanced", applied & F.col("_mid")).drop("_mid")


def balance_colours(pixels: DataFrame, gains: DataFrame) -> DataFrame:
    out = pixels.join(gains, "frame_id")
    for c in "bgr":
        level = F.floor(clip(F.col(c) * F.col(f"gain_{c}"), 0, 255)).cast("int")
        out = out.withColumn(c, F.when(F.col("balanced"), level).otherwise(F.col(c)))
    return out.drop("gain_b", "gain_g", "gain_r")


def gamma_exponent(median: Column) -> Column:
    """Exponent below 1 brightens dark frames, above 1 pulls bright ones down; NULL leaves them."""
    return F.when(median < 105.0, F.greatest(F.lit(0.80), F.pow(median / 125.0, F.lit(0.45)))).when(
        median > 145.0, F.least(F.lit(1.20), F.pow(median / 125.0, F.lit(0.35)))
    )


def normalise_levels(pixels: DataFrame, metrics: DataFrame, level: str = "gray") -> DataFrame:
    """Adaptive gamma, then a lift of up to 12 levels in deep shadow, on the luminance column."""
    joined = pixels.join(metrics.select("frame_id", "median_luminance", "shadow_score"), "frame_id")
    exponent = gamma_exponent(F.col("median_luminance"))
    curved = F.when(
        exponent.isNotNull(), 255.0 * F.pow(clip(F.col(level) / 255.0, 0, 1), exponent)
    ).otherwise(F.col(level).cast("double"))
    lifted = F.col("_l") + F.when(
        F.col("shadow_score") > 20, clip((50.0 - F.col("_l")) / 50.0, 0, 1) * 12.0
    ).otherwise(F.lit(0.0))
    return (
        joined.withColumn("_l", curved)
        .withColumn("normalised", F.floor(clip(lifted, 0, 255)).cast("int"))
        .drop("_l", "median_luminance", "shadow_score")
    )


def applied_operations(metrics: DataFrame, gains: DataFrame, mode: str = "normalized") -> DataFrame:
    """The list of operations each frame received; raw mode passes through."""
    if mode == "raw":
        return metrics.withColumn("normalization_applied", F.array(F.lit("raw_passthrough")))
    exponent = gamma_exponent(F.col("median_luminance"))
    steps = F.array(
        F.when(F.col("balanced"), "color_balance"),
        F.when(exponent.isNotNull(), F.concat(F.lit("adaptive_gamma_"), F.format_number(exponent, 2))),
        F.when(F.col("shadow_score") > 20, "shadow_attenuation"),
    )
    joined = metrics.join(gains.select("frame_id", "balanced"), "frame_id", "left")
    return joined.withColumn("_ops", F.filter(steps, lambda s: s.isNotNull())).withColumn(
        "normalization_applied",
        F.when(F.size("_ops") == 0, F.array(F.lit("balanced_identity"))).otherwise(F.col("_ops")),
    ).drop("_ops", "balanced")


def run_summary(records: DataFrame, mode: str = "normalized") -> DataFrame:
    normalised = F.count(F.lit(1)) if mode != "raw" else F.lit(0).cast("long")
    return records.agg(
        F.count(F.lit(1)).alias("total_keyframes"), normalised.alias("normalized_count"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected_count"),
        *[rounded(F.avg(f"{n}_score"), 1).alias(f"average_{n}_score") for n in ("exposure", "shadow", "contrast")],
    )


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("frames"))
