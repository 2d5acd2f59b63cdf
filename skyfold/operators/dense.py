"""Dense points from depth and disparity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from skyfold.functions import linalg as la
from skyfold.functions.linalg import clip, rounded
from skyfold.operators.ordered import with_neighbour
from skyfold.operators.quality import sobel
from skyfold.operators.quantiles import exact_quantiles


def stereo_partners(poses: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """The next camera of each camera, the previous one for the last, with the relative pose.

    Input ``mission_id, idx, camera_id, R, t``.
    """
    chunk = F.floor(F.col("idx") / chunk_rows)
    keep = ["camera_id", "R", "t"]
    both = with_neighbour(poses, ["mission_id"], ["idx"], chunk, keep, "_next", following=True)
    both = with_neighbour(both, ["mission_id"], ["idx"], chunk, keep, "_prev")
    paired = both.withColumn("_o", F.coalesce("_next", "_prev")).where("_o IS NOT NULL")
    rel = la.mat_mul(la.arr9(F.col("_o.R")), la.transpose(la.arr9("R")))
    out = paired.withColumn("rel_R", F.array(*rel))
    shift = la.sub(la.arr3(F.col("_o.t")), la.mat_vec(la.arr9("rel_R"), la.arr3("t")))
    return out.select(
        "mission_id", "idx", "camera_id", F.col("_o.camera_id").alias("partner_id"), "rel_R", F.array(*shift).alias("rel_t")
    ).withColumn("baseline_m", F.when(la.norm(la.arr3("rel_t")) < 1e-4, 1.0).otherwise(la.norm(la.arr3("rel_t"))))


def depth_from_disparity(disparity: DataFrame, views: DataFrame) -> DataFrame:
    """Depth f*b/d of usable disparities inside the depth range; ``views`` gives
    ``frame_id, focal_px, baseline_m, altitude_m``."""
    depth = F.col("focal_px") * F.col("baseline_m") / F.greatest("disparity", F.lit(0.1))
    return (
        disparity.where(F.col("disparity") > 1.0).join(views, "frame_id").withColumn("depth", depth)
        .where((F.col("depth") >= 0.5) & (F.col("depth") <= F.greatest(F.lit(50.0), F.col("altitude_m") * 3.5)))
        .drop("focal_px", "baseline_m", "altitude_m")
    )


def texture_confidence(depth: DataFrame, pixels: DataFrame, placed: bool = False) -> DataFrame:
    """Confidence of valid depths from the local gradient; ``placed`` if the pixels of a frame share a partition."""
    grad = sobel(pixels, placed=placed).select("frame_id", "x", "y", "gradient")
    return depth.where("depth > 0").join(grad, ["frame_id", "x", "y"]).withColumn(
        "conf", clip(0.65 + 0.35 * clip(F.col("gradient") / 80.0, 0.2, 1.0), 0, 1)
    ).drop("gradient")


def depth_scale(sparse: DataFrame, depth: DataFrame, views: DataFrame) -> DataFrame:
    """Scale of relative depth per view: median ratio of sparse-point depth to the
    3x3 median depth at its pixel, clipped; 1 with fewer than three samples.

    ``sparse(frame_id, x, y, z)`` lists the points to test per view;
    ``views(frame_id, R, t, fx, fy, px, py, w, h)``.
    """
    cam = la.add(la.mat_vec(la.arr9("R"), (F.col("x"), F.col("y"), F.col("z"))), la.arr3("t"))
    seen = sparse.join(views, "frame_id").withColumn("_c", F.array(*cam)).where(F.col("_c")[2] > 0.1)
    u = F.bround(F.col("fx") * F.col("_c")[0] / F.col("_c")[2] + F.col("px"), 0).cast("int")
    v = F.bround(F.col("fy") * F.col("_c")[1] / F.col("_c")[2] + F.col("py"), 0).cast("int")
    seen = seen.withColumn("_u", u).withColumn("_v", v).where(
        (F.col("_u") >= 2) & (F.col("_u") < F.col("w") - 2) & (F.col("_v") >= 2) & (F.col("_v") < F.col("h") - 2)
    ).select("frame_id", F.col("_c")[2].alias("_z"), "_u", "_v")
    cells = seen.select("frame_id", "_u", "_v").distinct()
    for c in ("_u", "_v"):
        cells = cells.withColumn(f"{c}o", F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    local = cells.join(
        depth.select("frame_id", F.col("x").alias("_uo"), F.col("y").alias("_vo"), "depth"), ["frame_id", "_uo", "_vo"]
    ).groupBy("frame_id", "_u", "_v").agg(F.percentile("depth", F.lit(0.5)).alias("_d"))
    ratios = seen.join(local, ["frame_id", "_u", "_v"]).where("_d > 0.01").withColumn("_q", F.col("_z") / F.col("_d"))
    medians = exact_quantiles(ratios, ["frame_id"], "_q", {"_m": 0.5})
    counts = ratios.groupBy("frame_id").agg(F.count(F.lit(1)).alias("samples"))
    return views.select("frame_id").join(counts, "frame_id", "left").join(medians, "frame_id", "left").select(
        "frame_id", F.coalesce("samples", F.lit(0)).alias("samples"),
        F.when(F.col("samples") >= 3, clip(F.col("_m"), 0.1, 1000.0)).otherwise(1.0).alias("scale"),
    )


def back_project(depth: DataFrame, views: DataFrame, min_confidence: float = 0.30, stride: int = 2) -> DataFrame:
    """World points of every stride-th valid pixel of a view, in row-major order.

    A view is bounded by its resolution.
    """
    valid = depth.where((F.col("depth") > 0) & (F.col("conf") >= min_confidence))
    order = Window.partitionBy("frame_id").orderBy("y", "x")
    taken = valid.withColumn("_n", F.row_number().over(order) - 1).where(F.col("_n") % stride == 0).drop("_n")
    j = taken.join(views.select("frame_id", F.col("R").alias("_rot"), "t", "fx", "fy", "px", "py"), "frame_id")
    z = F.col("depth")
    cam = ((F.col("x") - F.col("px")) * z / F.col("fx"), (F.col("y") - F.col("py")) * z / F.col("fy"), z)
    world = la.mat_vec(la.transpose(la.arr9("_rot")), la.sub(cam, la.arr3("t")))
    keep = [c for c in depth.columns if c not in ("x", "y", "depth")]
    return j.select(*keep, F.col("x").alias("px_x"), F.col("y").alias("px_y"), *[world[i].alias(c) for i, c in enumerate("xyz")])


def voxel_filter(points: DataFrame, size: float = 0.04, keys: Sequence[str] = ("cloud_id",), keep: str = "first") -> DataFrame:
    """One point per voxel: the first by id, or the most confident (``keep="max_conf"``)."""
    keys = list(keys)
    cell = [F.floor(F.col(c) / size).alias(f"_v{c}") for c in "xyz"]
    row = F.struct(*[c for c in points.columns if c not in keys])
    order = F.col("point_id") if keep == "first" else F.struct(-F.col("conf"), F.col("point_id"))
    return points.groupBy(*keys, *cell).agg(F.min_by(row, order).alias("_p")).select(*keys, "_p.*")


def sigma_filter(points: DataFrame, limit: float = 3.0, minimum: int = 50, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Drops points beyond ``limit`` deviations on any axis, for clouds above the minimum size."""
    keys = list(keys)
    stats = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{c}") for c in "xyz"], *[F.stddev_pop(c).alias(f"_s{c}") for c in "xyz"]
    )
    inside = F.col("_n") <= minimum
    near = F.lit(True)
    for c in "xyz":
        near = near & (F.abs(F.col(c) - F.col(f"_m{c}")) / F.greatest(f"_s{c}", F.lit(1e-4)) < limit)
    return points.join(stats, keys).where(inside | near).select(points.columns)


def density_metrics(points: DataFrame, sparse_counts: DataFrame | None = None, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Points per cubic metre of the box (at least 1) and the gain over the sparse cloud."""
    keys = list(keys)
    base = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), *[(F.max(c) - F.min(c)).alias(f"span_{c}") for c in "xyz"]
    )
    volume = F.greatest(F.lit(1.0), F.col("span_x") * F.col("span_y") * F.col("span_z"))
    base = base.withColumn("points_per_m3", rounded(F.col("points") / volume, 1)).withColumns(
        {f"span_{c}": rounded(F.col(f"span_{c}"), 2) for c in "xyz"}
    )
    if sparse_counts is None:
        return base
    gain = F.when(F.col("sparse_points") > 0, rounded(F.col("points") / F.col("sparse_points"), 1)).otherwise(1.0)
    return base.join(sparse_counts, keys, "left").withColumn("density_gain", gain).drop("sparse_points")


def confidence_summary(points: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Mean, median and band shares of the point confidence."""
    keys = list(keys)
    share = lambda c: rounded(F.avg(F.when(c, 1.0).otherwise(0.0)) * 100, 1)
    k = F.col("conf")
    sums = points.groupBy(*keys).agg(
        rounded(F.avg(k), 3).alias("mean_confidence"), share(k >= 0.70).alias("high_pct"),
        share((k >= 0.45) & (k < 0.70)).alias("medium_pct"),
    )
    medians = exact_quantiles(points, keys, "conf", {"_m": 0.5})
    return sums.join(medians, keys).withColumn("median_confidence", rounded(F.col("_m"), 3)).drop("_m")


def normalised_depth(depth: DataFrame) -> DataFrame:
    """Depth between its 5th and 95th percentile of the frame, as 0..1."""
    ends = exact_quantiles(depth.where("depth > 0"), ["frame_id"], "depth", {"_lo": 0.05, "_hi": 0.95})
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-3))
    return depth.join(ends, "frame_id").withColumn("normalised", clip((F.col("depth") - F.col("_lo")) / span, 0, 1)).drop("_lo", "_hi")


def output_status(clouds: DataFrame, points: DataFrame, minimum: int = 100, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Whether each cloud has the least number of points."""
    keys = list(keys)
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return clouds.select(*keys).distinct().join(counts, keys, "left").select(
        *keys, n.alias("points"), F.when(n >= minimum, "ok").otherwise("too_few_points").alias("status")
    )
