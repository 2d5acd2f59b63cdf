"""Frame quality from pixel tables and frame metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.functions.linalg import clip, rounded
from skyfold.operators.ordered import with_neighbour

# Weights of the 0-100 score and class limits.
SCORE_WEIGHTS = {"sharpness": 35.0, "exposure": 15.0, "contrast": 15.0, "feature_score": 20.0,
                 "compression": 5.0, "redundancy": 10.0}
HIGH, MEDIUM = 80, 60


def gray_level(b: Column, g: Column, r: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def _stencil(pixels: DataFrame, placed: bool) -> DataFrame:
    """All rows of a frame in one partition, so both line directions reuse one shuffle; none if ``placed`` so already."""
    return pixels if placed else pixels.repartition("frame_id")


def _beside(value: Column | str, across: str, along: str) -> tuple[Column, Column]:
    """Previous and next value along a line; a border mirrors its inner neighbour."""
    line = Window.partitionBy("frame_id", across).orderBy(along)
    before, after = F.lag(value).over(line), F.lead(value).over(line)
    return F.coalesce(before, after), F.coalesce(after, before)


def laplacian(pixels: DataFrame, value: str = "gray", placed: bool = False) -> DataFrame:
    left, right = _beside(value, "y", "x")
    up, down = _beside(value, "x", "y")
    return (
        _stencil(pixels, placed)
        .withColumn("_h", left + right)
        .withColumn("laplacian", F.col("_h") + up + down - 4 * F.col(value))
        .drop("_h")
    )


def sobel(pixels: DataFrame, value: str = "gray", placed: bool = False) -> DataFrame:
    """Gradient magnitude of the 3x3 Sobel pair."""
    left, right = _beside(value, "y", "x")
    rows = _stencil(pixels, placed).withColumn("_d", right - left).withColumn("_s", left + 2 * F.col(value) + right)
    up_d, down_d = _beside("_d", "x", "y")
    up_s, down_s = _beside("_s", "x", "y")
    gx, gy = up_d + 2 * F.col("_d") + down_d, down_s - up_s
    return (
        rows.withColumn("_gx", gx).withColumn("_gy", gy)
        .withColumn("gradient", F.sqrt((F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).cast("double")))
        .drop("_d", "_s", "_gx", "_gy")
    )


def sharpness(pixels: DataFrame, placed: bool = False) -> DataFrame:
    return laplacian(pixels, placed=placed).groupBy("frame_id").agg(F.var_pop("laplacian").alias("laplacian_var"))


def brightness(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_id").agg(
        F.avg("gray").alias("mean_luminance"), F.stddev_pop("gray").alias("contrast_std")
    )


def gradient_p90(pixels: DataFrame) -> DataFrame:
    """90th percentile of the gradient; a frame is bounded by its resolution."""
    return sobel(pixels).groupBy("frame_id").agg(F.percentile("gradient", F.lit(0.9)).alias("grad_p90"))


def pixel_metrics(pixels: DataFrame, placed: bool = False) -> DataFrame:
    """Sharpness, brightness, contrast and gradient of each frame in one shuffle."""
    return (
        sobel(laplacian(pixels, placed=placed), placed=True).groupBy("frame_id").agg(
            F.var_pop("laplacian").alias("laplacian_var"), F.avg("gray").alias("mean_luminance"),
            F.stddev_pop("gray").alias("contrast_std"), F.percentile("gradient", F.lit(0.9)).alias("grad_p90"),
        )
    )


def redundancy(thumbs: DataFrame, order: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Mean squared thumbnail difference to the previous frame over 500; the first frame has 1.

    ``thumbs(frame_id, x, y, gray)``; ``order(mission_id, frame_id, frame_index)``.
    """
    chunk = F.floor(F.col("frame_index") / 10_000) if chunk is None else chunk
    linked = with_neighbour(order, ["mission_id"], ["frame_index"], chunk, ["frame_id"], "_prev")
    pairs = linked.select("mission_id", "frame_id", F.col("_prev.frame_id").alias("prev_id"))
    before = thumbs.select(F.col("frame_id").alias("prev_id"), "x", "y", F.col("gray").alias("_g"))
    mse = (
        pairs.join(thumbs.select("frame_id", "x", "y", "gray"), "frame_id")
        .join(before, ["prev_id", "x", "y"])
        .groupBy("mission_id", "frame_id")
        .agg(F.avg(F.pow((F.col("gray") - F.col("_g")).cast("double"), F.lit(2.0))).alias("mse_prev"))
    )
    return pairs.join(mse, ["mission_id", "frame_id"], "left").select(
        "mission_id", "frame_id", "mse_prev", redundancy_score(F.col("mse_prev")).alias("redundancy")
    )


def redundancy_score(mse: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), mse / 500.0), F.lit(1.0))


def quality_scores(metrics: DataFrame) -> DataFrame:
    """Normalised scores, the 0-100 score with half-even rounding, class and usability."""
    lum = F.col("mean_luminance")
    balance = F.when(lum <= 128, lum / 128.0).otherwise((255.0 - lum) / 127.0)
    scored = (
        metrics.withColumn("sharpness", F.round(clip((F.col("laplacian_var") - 20) / 400.0, 0, 1), 4))
        .withColumn("exposure", F.round(F.sqrt(balance), 4))
        .withColumn("contrast", F.round(F.least(F.lit(1.0), F.col("contrast_std") / 70.0), 4))
        .withColumn("feature_score", F.round(F.least(F.lit(1.0), F.col("feature_count") / 1000.0), 4))
        .withColumn("compression", F.round(clip(F.col("grad_p90") / 250.0, 0, 1), 4))
        .withColumn("redundancy", redundancy_score(F.col("mse_prev")))
    )
    total = sum((F.col(c) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    q = F.col("overall_quality")
    return (
        scored.withColumn("overall_quality", F.bround(clip(total, 0, 100), 0).cast("int"))
        .withColumn("classification", F.when(q >= HIGH, "HIGH").when(q >= MEDIUM, "MEDIUM").otherwise("LOW"))
        .withColumn("usable", q >= MEDIUM)
    )


def quality_report(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per class, usable frames and mean score."""
    of = lambda name: F.count_if(F.col("classification") == name)
    return scores.groupBy(*(keys or ["mission_id"])).agg(
        F.count(F.lit(1)).alias("total_frames"), F.count_if("usable").alias("usable_frames"),
        of("HIGH").alias("high_quality_count"), of("MEDIUM").alias("medium_quality_count"),
        of("LOW").alias("low_quality_count"),
        rounded(F.avg("overall_quality"), 2).alias("mean_overall_quality"),
    )


def quality_histogram(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ten bins over 0-100, the last one closed; empty bins are kept."""
    keys = keys or ["mission_id"]
    counts = scores.groupBy(*keys, F.least(F.floor(F.col("overall_quality") / 10), F.lit(9)).cast("int").alias("bin")).count()
    bins = scores.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return bins.join(counts, [*keys, "bin"], "left").select(
        *keys, (F.col("bin") * 10).alias("bin_start"), (F.col("bin") * 10 + 10).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("frames"),
    )


def usable_frames(scores: DataFrame, classification: str | None = None) -> DataFrame:
    out = scores.where("usable")
    return out.where(F.col("classification") == classification) if classification else out


def image_composite(pixels: DataFrame, placed: bool = False) -> DataFrame:
    """Sharpness, exposure score and 0.6/0.4 composite of candidate texture images."""
    lum = F.col("mean_luminance")
    per_frame = laplacian(pixels, placed=placed).groupBy("frame_id").agg(
        F.var_pop("laplacian").alias("sharpness"), F.avg("gray").alias("mean_luminance"),
        (F.avg(F.when(F.col("gray") < 15, 1.0).otherwise(0.0)) * 100).alias("under_pct"),
        (F.avg(F.when(F.col("gray") > 240, 1.0).otherwise(0.0)) * 100).alias("over_pct"),
    )
    penalty = F.abs(lum - 128.0) / 128.0 * 0.6 + (F.col("under_pct") + F.col("over_pct")) * 0.015
    return per_frame.withColumn("exposure", clip(1.0 - penalty, 0.05, 1.0)).withColumn(
        "quality", clip(0.60 * clip(F.col("sharpness") / 250.0, 0.1, 1.0) + 0.40 * F.col("exposure"), 0.1, 1.0)
    )
