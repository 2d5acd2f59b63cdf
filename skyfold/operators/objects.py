"""Moving-object layer over detection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyfold.functions.linalg import clip, rounded

# Class groups a caller may name.
CLASS_GROUPS = {
    "person": ["person"],
    "car": ["car"],
    "motorcycle": ["motorcycle"],
    "bicycle": ["bicycle"],
    "animal": ["dog", "cat", "bird", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe"],
    "other": ["bus", "truck", "boat", "airplane", "train", "skateboard", "surfboard"],
}


def target_classes(spark: SparkSession, requested: list[str] | None = None) -> DataFrame:
    """One row per wanted class; group names are expanded, none means all groups."""
    groups = spark.createDataFrame(
        [(g, c) for g, members in CLASS_GROUPS.items() for c in members], "grp string, object_class string"
    )
    if not requested:
        return groups.select("object_class").distinct()
    asked = spark.createDataFrame([(r,) for r in requested], "grp string").select(
        F.lower(F.trim("grp")).alias("grp")
    )
    return asked.join(groups, "grp", "left").select(F.coalesce("object_class", "grp").alias("object_class")).distinct()


def relevant(detections: DataFrame, classes: DataFrame, confidence_threshold: float = 0.35) -> DataFrame:
    """Detections of a wanted class with enough confidence."""
    strong = detections.withColumn("object_class", F.lower("object_class")).where(
        F.col("confidence") >= confidence_threshold
    )
    return strong.join(classes, "object_class", "left_semi")


def clamp_boxes(detections: DataFrame, width: int, height: int) -> DataFrame:
    sides = {"x1": width, "y1": height, "x2": width, "y2": height}
    return detections.withColumns({c: rounded(clip(F.col(c), 0.0, m), 1) for c, m in sides.items()})


def mask_bands(detections: DataFrame, width: int, height: int) -> DataFrame:
    """What the boxes of each frame cover, without a row per pixel: ``frame_id, ya, yb, spans``.

    A sweep over the boxes' upper and lower edges cuts a frame into bands of image
    rows (``ya`` to ``yb``) in which the same boxes are present; ``spans`` are the
    disjoint column intervals (xa to xb) that these cover, in order. Equal boxes are
    folded first; a frame has at most ``height`` bands. Frames without a box inside
    the image have no row.
    """
    whole = {c: F.floor(c).cast("int") for c in ("x1", "y1", "x2", "y2")}
    boxes = detections.select("frame_id", *[v.alias(c) for c, v in whole.items()]).where((F.col("x1") < width) & (F.col("y1") < height))
    boxes = boxes.withColumns({"x2": F.least("x2", F.lit(width - 1)), "y2": F.least("y2", F.lit(height - 1))}).where("x1 <= x2 and y1 <= y2")
    boxes = boxes.distinct()
    edges = boxes.select("frame_id", F.explode(F.array("y1", F.col("y2") + 1)).alias("_e")).groupBy("frame_id").agg(F.sort_array(F.collect_set("_e")).alias("_edges"))
    band = F.transform("_edges", lambda e, i: F.struct(e.alias("ya"), (F.get(F.col("_edges"), i + 1) - 1).alias("yb")))
    cut = boxes.join(edges, "frame_id").select("frame_id", "x1", "x2", F.explode(F.filter(band, lambda e: (e["ya"] >= F.col("y1")) & (e["ya"] <= F.col("y2")))).alias("_band"))
    held = cut.groupBy("frame_id", "_band.ya", "_band.yb").agg(F.sort_array(F.collect_set(F.struct(F.col("x1").alias("xa"), F.col("x2").alias("xb")))).alias("_held"))
    joined = F.aggregate(
        "_held", F.array().cast("array<struct<xa:int,xb:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["xb"] + 1 >= s["xa"]), F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["xa"].alias("xa"), F.greatest(F.element_at(done, -1)["xb"], s["xb"]).alias("xb")))
        )).otherwise(F.concat(done, F.array(s))),
    )
    return held.select("frame_id", "ya", "yb", F.when(F.size("_held") == 1, F.col("_held")).otherwise(joined).alias("spans"))


def mask_rows(bands: DataFrame) -> DataFrame:
    """(frame_id, y, spans): the covered columns of each image row."""
    return bands.select("frame_id", F.explode(F.sequence("ya", "yb")).alias("y"), "spans")


def mask_cells(detections: DataFrame, width: int, height: int) -> DataFrame:
    """Distinct pixels covered by the boxes of each frame, for callers that need a row for each."""
    rows = mask_rows(mask_bands(detections, width, height)).select("frame_id", "y", F.explode("spans").alias("_s"))
    return rows.select("frame_id", F.explode(F.sequence("_s.xa", "_s.xb")).alias("x"), "y")


def mask_coverage(bands: DataFrame, width: int, height: int) -> DataFrame:
    wide = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["xb"] - s["xa"] + 1)
    covered = F.sum(wide * (F.col("yb") - F.col("ya") + 1))
    return bands.groupBy("frame_id").agg(
        covered.alias("dynamic_pixels"), rounded(covered / float(width * height) * 100, 2).alias("dynamic_pixel_percent"),
    )


def _with_mask(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Adds ``_masked``: whether the row's pixel is covered in its frame; rows meet their image row's spans."""
    mask = mask_rows(bands).select(F.col("frame_id").alias("_frame"), F.col("y").alias("_row"), F.col("spans").alias("_spans"))
    met = rows.join(mask, (F.col("frame_id") == F.col("_frame")) & (F.col("y") == F.col("_row")), "left")
    hit = F.coalesce(F.exists("_spans", lambda s: (s["xa"] <= F.col("x")) & (F.col("x") <= s["xb"])), F.lit(False))
    return met.withColumn("_masked", hit).drop("_frame", "_row", "_spans")


def static_rows(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows (features, points) that do not lie on a masked pixel of their frame."""
    return _with_mask(rows, bands).where("not _masked").drop("_masked")


def with_static_values(pixels: DataFrame, bands: DataFrame, value: str = "gray") -> DataFrame:
    """Pixels with masked values set to 0 and a flag."""
    return _with_mask(pixels, bands).withColumnRenamed("_masked", "dynamic").withColumn(
        "static_value", F.when(F.col("dynamic"), 0).otherwise(F.col(value))
    )


def risk_level(area: Column) -> Column:
    return F.when(area > 20, "ELEVATED").when(area > 5, "MODERATE").otherwise("LOW")


def frame_timeline(frames: DataFrame, detections: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per frame: detections, masked area and sorted classes; frames without any stay.

    Classes are counted before they meet, so the list is as long as the class list.
    """
    per_class = detections.groupBy("frame_id", "object_class").agg(F.count(F.lit(1)).alias("_n"))
    per_frame = per_class.groupBy("frame_id").agg(
        F.sum("_n").alias("detection_count"), F.array_sort(F.collect_list("object_class")).alias("classes")
    )
    return (
        frames.join(per_frame, "frame_id", "left").join(coverage, "frame_id", "left")
        .withColumn("detection_count", F.coalesce("detection_count", F.lit(0)))
        .withColumn("dynamic_pixel_percent", F.coalesce("dynamic_pixel_percent", F.lit(0.0)))
        .withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))
        .drop("dynamic_pixels")
    )


def layer_analytics(timeline: DataFrame, detections: DataFrame) -> DataFrame:
    """One row: totals, confidence, areas and risk."""
    areas = timeline.agg(
        F.count(F.lit(1)).alias("total_keyframes"),
        F.count_if(F.col("detection_count") > 0).alias("frames_with_dynamic_objects"),
        F.sum("detection_count").alias("total_detections"),
        rounded(F.avg("dynamic_pixel_percent"), 2).alias("average_dynamic_area_percent"),
        rounded(F.max("dynamic_pixel_percent"), 2).alias("max_dynamic_area_percent"),
    ).withColumn("_one", F.lit(1))
    confidence = detections.agg(
        rounded(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("average_confidence")
    ).withColumn("_one", F.lit(1))
    return areas.join(confidence, "_one").drop("_one").withColumn(
        "risk_level", risk_level(F.col("max_dynamic_area_percent"))
    )


def class_distribution(detections: DataFrame) -> DataFrame:
    """Count and mean confidence per class, most frequent first."""
    return detections.groupBy("object_class").agg(
        F.count(F.lit(1)).alias("detections"), rounded(F.avg("confidence")).alias("mean_confidence")
    ).orderBy(F.desc("detections"), "object_class")


def class_frame_cube(detections: DataFrame) -> DataFrame:
    """Counts by class and frame with sub-totals."""
    return detections.cube("object_class", "frame_id").agg(F.count(F.lit(1)).alias("detections"))


def frames_with(detections: DataFrame, frames: DataFrame, object_class: str | None = None) -> DataFrame:
    found = detections if object_class is None else detections.where(F.col("object_class") == object_class)
    return frames.join(found, "frame_id", "left_semi")
