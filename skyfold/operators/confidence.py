"""Evidence-based confidence of mesh vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.functions.linalg import clip, rounded
from skyfold.operators.mesh import edge_counts, face_geometry
from skyfold.operators.neighbours import count_within
from skyfold.operators.views import _inside, _project, view_candidates

KEY = ["mesh_id"]
# Evidence weights, tier limits.
WEIGHTS = {"visibility": 0.18, "observations": 0.18, "view_angle": 0.16, "feature_quality": 0.12,
           "depth_confidence": 0.12, "point_density": 0.10, "texture_quality": 0.08, "parallax_consistency": 0.06}
HIGH, MEDIUM = 0.70, 0.35


def density_score(vertices: DataFrame, points: DataFrame, radius: float = 0.5) -> DataFrame:
    """Dense points around each vertex, as a score that saturates."""
    counted = count_within(points, vertices, radius, KEY, "v")
    return counted.withColumn("density_score", F.least(F.lit(1.0), F.col("neighbour_count") / 0.785 / 120.0))


def density_from_edges(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The same score from the mean edge length, where there are no dense points."""
    ends = lambda s: vertices.select(*KEY, F.col("v").alias(s), *[F.col(c).alias(f"_{s}{c}") for c in "xyz"])
    edges = edge_counts(faces).join(ends("a"), [*KEY, "a"]).join(ends("b"), [*KEY, "b"])
    length = F.sqrt(sum((F.pow(F.col(f"_a{c}") - F.col(f"_b{c}"), F.lit(2.0)) for c in "xyz"), F.lit(0.0)))
    mean = edges.groupBy(*KEY).agg(F.avg(length).alias("_m"))
    m = F.coalesce("_m", F.lit(0.5))
    return vertices.join(mean, KEY, "left").withColumn(
        "density_score", F.least(F.lit(1.0), 1.0 / F.greatest(F.lit(1e-4), m * m) / 80.0)
    ).drop("_m")


def vertex_views(vertices: DataFrame, cameras: DataFrame, margin: int = 12, min_cos: float = 0.10) -> DataFrame:
    """Valid (vertex, camera) observations; vertices need unit normals."""
    return _project(view_candidates(vertices, cameras)).where((F.col("cos_theta") > min_cos) & _inside(margin))


def observation_evidence(vertices: DataFrame, views: DataFrame) -> DataFrame:
    """Observations, best cosine and mean camera quality per vertex; unseen vertices have zero."""
    sums = views.groupBy(*KEY, "v").agg(
        F.count(F.lit(1)).alias("observations"), F.max("cos_theta").alias("max_cos"),
        F.avg(F.least(F.lit(1.0), F.col("_cam_quality"))).alias("texture_quality"),
    )
    out = vertices.join(sums, [*KEY, "v"], "left")
    return out.withColumns({
        "observations": F.coalesce("observations", F.lit(0)),
        "max_cos": F.coalesce("max_cos", F.lit(0.0)), "texture_quality": F.coalesce("texture_quality", F.lit(0.0)),
    })


def _stepped(n: Column, base: float, gain: float, single: float) -> Column:
    return F.when(n >= 2, F.least(F.lit(1.0), base + n * gain)).when(n == 1, single).otherwise(0.0)


def with_view_scores(evidence: DataFrame) -> DataFrame:
    n = F.col("observations")
    return evidence.withColumn("parallax_score", _stepped(n, 0.4, 0.15, 0.25)).withColumn(
        "depth_score", _stepped(n, 0.5, 0.12, 0.35)
    )


def feature_score(mean_error: Column | None) -> Column:
    """Matching quality from the mean reprojection error; 0.80 when unknown."""
    if mean_error is None:
        return F.lit(0.80)
    return F.coalesce(F.exp(-(mean_error * mean_error) / (2.0 * 1.5 * 1.5)), F.lit(0.80))


def fuse(evidence: DataFrame, weights: dict[str, float] | None = None, mean_error: Column | None = None) -> DataFrame:
    """Weighted sum of the eight evidence terms; unseen vertices get 0.05."""
    w = {**WEIGHTS, **(weights or {})}
    n = F.col("observations")
    terms = {
        "visibility": F.when(n > 0, 1.0).otherwise(0.0), "observations": clip(n / 4.0, 0, 1),
        "view_angle": clip(F.col("max_cos"), 0, 1), "feature_quality": feature_score(mean_error),
        "depth_confidence": F.col("depth_score"), "point_density": F.col("density_score"),
        "texture_quality": F.col("texture_quality"), "parallax_consistency": F.col("parallax_score"),
    }
    total = sum((w[k] * t for k, t in terms.items()), F.lit(0.0))
    return evidence.withColumn("confidence", F.when(n == 0, 0.05).otherwise(clip(total, 0, 1)))


def with_tier(fused: DataFrame) -> DataFrame:
    """HIGH needs two observations, MEDIUM one; a well scored vertex seen once is UNTIERED."""
    c, n = F.col("confidence"), F.col("observations")
    tier = (
        F.when((c < MEDIUM) | (n == 0), "UNKNOWN").when((c >= HIGH) & (n >= 2), "HIGH")
        .when((c < HIGH) & (n >= 1), "MEDIUM").otherwise("UNTIERED")
    )
    return fused.withColumn("tier", tier)


def tier_statistics(tiered: DataFrame) -> DataFrame:
    of = lambda t: F.count_if(F.col("tier") == t)
    n = F.count(F.lit(1))
    names = ("HIGH", "MEDIUM", "UNKNOWN", "UNTIERED")
    return tiered.groupBy(*KEY).agg(
        n.alias("total_vertices"), *[of(t).alias(f"{t.lower()}_vertices") for t in names],
        *[rounded(of(t) / n * 100, 2).alias(f"{t.lower()}_pct") for t in names],
        rounded(F.avg("observations"), 1).alias("mean_observations"), F.max("observations").alias("max_observations"),
    )


def tier_areas(tiered: DataFrame, faces: DataFrame) -> DataFrame:
    """Surface per tier of the mean face confidence."""
    g = face_geometry(faces, tiered, ("x", "y", "z", "confidence"))
    c = (F.col("p0.confidence") + F.col("p1.confidence") + F.col("p2.confidence")) / 3.0
    part = lambda ok: rounded(F.sum(F.when(ok, F.col("area")).otherwise(0.0)), 2)
    return g.groupBy(*KEY).agg(
        rounded(F.sum("area"), 2).alias("total_area_m2"), part(c >= HIGH).alias("high_area_m2"),
        part((c >= MEDIUM) & (c < HIGH)).alias("medium_area_m2"), part(c < MEDIUM).alias("unknown_area_m2"),
    )


def confidence_summary(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy(*KEY).agg(
        rounded(F.avg("confidence"), 3).alias("mean_confidence"), rounded(F.stddev_pop("confidence"), 3).alias("std_confidence"),
        F.count(F.lit(1)).alias("evaluated_points"),
    )
