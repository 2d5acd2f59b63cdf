"""Validation, run comparison, operations and measurement reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.functions.linalg import cross, norm, rounded

# The run's stages in order and the names each count is known by.
STAGES = ["preprocessing", "frame_quality", "keyframe_selection", "dynamic_masking", "illumination_preprocessing",
          "pose_estimation", "geometry", "dense_point_cloud", "mesh_generation", "texture_mapping", "georeferencing",
          "confidence_estimation", "validation"]
METRIC_NAMES = {
    "frames_extracted": ("preprocessing", ["extracted_frames_count", "frames_extracted"]),
    "keyframes_selected": ("keyframe_selection", ["selected_keyframes_count", "keyframes_selected"]),
    "dynamic_objects_masked": ("dynamic_masking", ["total_dynamic_objects_detected", "dynamic_masks_count", "total_detections"]),
    "cameras_registered": ("geometry", ["successful_image_registrations", "number_of_cameras"]),
    "dense_points": ("dense_point_cloud", ["dense_points_count", "number_of_points", "number_of_dense_points"]),
    "triangles": ("mesh_generation", ["triangles", "faces", "mesh_triangles"]),
    "confidence_high_pct": ("confidence_estimation", ["high_confidence_percentage"]),
}


# ---- validation ----

def ground_sample_distance(missions: DataFrame) -> DataFrame:
    gsd = F.col("flight_altitude_m") * F.col("sensor_width_mm") / (F.col("focal_length_mm") * F.col("image_w")) * 100.0
    return missions.withColumn("achieved_gsd_cm", gsd)


# The limits of the three criteria and of grade A.
MAX_ERROR_PX, MAX_GSD_DRIFT_PCT, LEAST_POINTS, GRADE_A_PX = 2.5, 35.0, 50.0, 1.8


def validation_criteria(runs: DataFrame) -> DataFrame:
    """One row per run and criterion with status; a missing measurement is UNAVAILABLE.

    Needs ``run_id, reproj_error_px, achieved_gsd_cm, target_gsd_cm, points``.
    """
    drift = F.abs(F.col("achieved_gsd_cm") - F.col("target_gsd_cm")) / F.greatest(F.lit(0.1), F.col("target_gsd_cm")) * 100
    judge = lambda value, ok, bad: F.when(value.isNull(), "UNAVAILABLE").when(ok, "PASS").otherwise(bad)
    entry = lambda name, value, limit, status: F.struct(
        F.lit(name).alias("parameter"), value.cast("double").alias("measured"), F.lit(limit).alias("threshold"), status.alias("status"))
    error, points = F.col("reproj_error_px"), F.col("points")
    rows = F.array(
        entry("reprojection_error", error, MAX_ERROR_PX, judge(error, error <= MAX_ERROR_PX, "FAIL")),
        entry("gsd_deviation_pct", drift, MAX_GSD_DRIFT_PCT, judge(drift, drift <= MAX_GSD_DRIFT_PCT, "WARNING")),
        entry("point_count", points, LEAST_POINTS, judge(points, points >= LEAST_POINTS, "FAIL")),
    )
    return runs.select("run_id", F.explode(rows).alias("c")).select("run_id", "c.*")


def validation_status(runs: DataFrame, criteria: DataFrame) -> DataFrame:
    """PASSED unless a criterion failed; grade A below 1.8 px, B when passed, else C."""
    verdict = criteria.groupBy("run_id").agg(F.every(F.col("status") != "FAIL").alias("_ok"))
    joined = runs.join(verdict, "run_id")
    return joined.select(
        "run_id", F.when(F.col("_ok"), "PASSED").otherwise("WARNING").alias("validation_status"),
        F.when(F.col("_ok") & F.coalesce(F.col("reproj_error_px") < GRADE_A_PX, F.lit(False)), "A").when(F.col("_ok"), "B").otherwise("C").alias("grade"),
    )


def point_density(points: Column, area: Column) -> Column:
    return rounded(points / F.greatest(F.lit(1.0), area), 1)


# ---- run comparison ----

def derived_ratios(runs: DataFrame) -> DataFrame:
    """Frame reduction, registration rate and point density of each run."""
    share = lambda a, b: F.when(F.col(b) > 0, rounded(F.col(a) / F.col(b) * 100, 1))
    return runs.withColumns({
        "frame_reduction_pct": F.when(F.col("raw_frames") > 0, rounded((F.col("raw_frames") - F.col("keyframes")) / F.col("raw_frames") * 100, 1)),
        "registration_pct": share("cameras_registered", "keyframes"),
        "points_per_m2": point_density(F.col("dense_points"), F.col("surface_area_m2")),
    })


# Compared metrics and whether a larger value is better.
COMPARED = {"frame_reduction_pct": True, "registration_pct": True, "reproj_error_px": False, "points_per_m2": True,
            "triangles": True, "confidence_high_pct": True, "processing_seconds": False, "cpu_pct": False,
            "scale_error_pct": False, "position_rmse_m": False}


def compare_runs(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Ten metrics of two measured runs in long form: values, change and status.

    A metric missing on either side is ``unavailable``; nothing is estimated.
    """
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), (F.col(m) if m in df.columns else F.lit(None)).cast("double").alias(name)) for m in COMPARED
    ])).alias("m")).select(*keys, "m.*")
    joined = long(baseline, "baseline").join(long(candidate, "candidate"), [*keys, "metric"])
    up = F.element_at(F.create_map(*[F.lit(x) for kv in COMPARED.items() for x in kv]), F.col("metric"))
    delta = F.col("candidate") - F.col("baseline")
    known = delta.isNotNull()
    better = F.when(up, delta >= 0).otherwise(delta <= 0)
    return joined.select(
        *keys, "metric", "baseline", "candidate", rounded(delta).alias("delta"),
        F.when(F.col("baseline") != 0, rounded(delta / F.abs("baseline") * 100, 1)).alias("delta_pct"),
        F.when(~known, "unavailable").when(better, "PASS").otherwise("REGRESSION").alias("status"),
    )


def ground_truth(runs: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Scale error and position RMSE against surveyed truth; absent truth is ``unavailable``.

    ``truth`` has the keys, ``scale_target_m, measured_scale_m, checkpoints_rmse_m``.
    """
    j = runs.select(*keys).join(truth, keys, "left")
    scale = rounded(F.abs(F.col("measured_scale_m") - F.col("scale_target_m")) / F.col("scale_target_m") * 100, 3)
    position = rounded(F.col("checkpoints_rmse_m"), 3)
    status = lambda c: F.when(c.isNull(), "unavailable").otherwise("measured")
    return j.select(
        *keys, scale.alias("scale_error_pct"), status(scale).alias("scale_status"), position.alias("position_rmse_m"),
        status(position).alias("position_status"),
        F.when(position.isNull(), "unavailable").otherwise(F.concat(F.format_string("%.3f", position), F.lit("m RMSE"))).alias("position_text"),
    )


def speed_up(baseline_seconds: Column, seconds: Column) -> Column:
    return rounded(baseline_seconds / F.greatest(F.lit(0.1), seconds), 1)


# ---- operations ----

def mission_list(missions: DataFrame, skip: int = 0, limit: int = 50, search: str | None = None) -> DataFrame:
    """Missions newest first; ``search`` looks in name, id and status."""
    if search and search.strip():
        text = f"%{search.strip()}%"
        missions = missions.where(F.col("name").ilike(text) | F.col("mission_id").cast("string").ilike(text) | F.col("status").ilike(text))
    return missions.orderBy(F.desc("created_sec"), "mission_id").offset(skip).limit(limit)


def fleet_statistics(missions: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of totals; a mission is completed by its status or by a completed job."""
    done = jobs.where("status = 'completed'").select("mission_id").distinct().withColumn("_done", F.lit(True))
    m = missions.join(done, "mission_id", "left")
    state = F.col("status")
    total = F.count(F.lit(1))
    return m.agg(
        total.alias("total"), F.count_if((state == "completed") | F.coalesce("_done", F.lit(False))).alias("completed"),
        F.count_if(state.isin("processing", "ready")).alias("active"),
        rounded(F.sum("video_size_bytes") / 1048576.0, 1).alias("total_mb"),
        rounded(F.avg(F.when(F.col("target_gsd_cm") > 0, F.col("target_gsd_cm"))), 1).alias("avg_gsd_cm"),
        F.when(total > 0, rounded((total - F.count_if(state == "failed")) / total * 100, 0)).otherwise(100.0).alias("health_pct"),
    )


def jobs_of(jobs: DataFrame, mission: int) -> DataFrame:
    return jobs.where(F.col("mission_id") == mission).orderBy(F.desc("started_sec"), "job_id")


def progress(stages: DataFrame) -> DataFrame:
    return stages.groupBy("job_id").agg(
        F.count_if(F.col("status") == "completed").alias("stages_completed"),
        rounded(F.count_if(F.col("status") == "completed") / float(len(STAGES)) * 100, 1).alias("progress_pct"),
    )


def live_metrics(stages: DataFrame) -> DataFrame:
    """Counts of completed stages as one row per job, over all names a count is known by."""
    columns = []
    for name, (stage, keys) in METRIC_NAMES.items():
        read = lambda k: F.get_json_object("metrics_json", f"$.{k}").try_cast("double")
        value = F.coalesce(*[F.when(read(k) != 0, read(k)) for k in keys], *[read(k) for k in keys])
        columns.append(F.max(F.when((F.col("stage_name") == stage) & (F.col("status") == "completed"), value)).alias(name))
    return stages.groupBy("job_id").agg(*columns)


def readiness(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    early = stages.groupBy("job_id").agg(
        F.bool_or((F.col("stage_name") == "geometry") & (F.col("status") == "completed")).alias("_rapid"))
    return jobs.join(early, "job_id", "left").select(
        "job_id", F.coalesce("_rapid", F.lit(False)).alias("rapid_model_ready"), (F.col("status") == "completed").alias("refined_model_ready"))


def resume_point(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """The stage to resume at: the recorded error, else the first failed or pending, else the first."""
    open_ = stages.where(F.col("status").isin("failed", "pending")).groupBy("job_id").agg(
        F.min_by("stage_name", "stage_order").alias("_first"))
    return jobs.join(open_, "job_id", "left").select(
        "job_id", F.coalesce("error_stage", "_first", F.lit(STAGES[0])).alias("resume_stage"))


def usable_prefix(stages: DataFrame) -> DataFrame:
    """Completed stages before the first one that is not; a run has at most 13 stages,
    and the first gap is an aggregate, so no group is ordered."""
    bad = stages.where("status <> 'completed'").groupBy("job_id").agg(F.min("stage_order").alias("_gap"))
    ok = stages.join(bad, "job_id", "left").where(F.col("_gap").isNull() | (F.col("stage_order") < F.col("_gap")))
    return ok.select("job_id", "stage_order", "stage_name")


def merged_artifacts(artifacts: DataFrame) -> DataFrame:
    """One path per artifact type and job; the later stage wins."""
    return artifacts.groupBy("job_id", "artifact_type").agg(
        F.max_by(F.struct("file_path", "stage_name", "file_size_bytes"), F.struct("stage_order", "file_path")).alias("a")
    ).select("job_id", "artifact_type", "a.*")


def first_artifact(artifacts: DataFrame, artifact_type: str) -> DataFrame:
    """The first artifact of a type per job."""
    return artifacts.where(F.col("artifact_type") == artifact_type).groupBy("job_id").agg(
        F.min_by("file_path", F.struct("stage_order", "file_path")).alias("file_path"))


def job_quality_report(jobs: DataFrame, stages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per job: status, counts, reduction and the map of artifacts; unknown counts stay NULL."""
    kept = merged_artifacts(artifacts).groupBy("job_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("artifact_type", "file_path")))).alias("artifacts"))
    m = live_metrics(stages)
    ratio = F.when(F.col("frames_extracted") > 0, rounded(1.0 - F.col("keyframes_selected") / F.col("frames_extracted"), 2))
    return jobs.join(m, "job_id", "left").join(kept, "job_id", "left").select(
        "job_id", "mission_id", "status", *METRIC_NAMES, ratio.alias("keyframe_reduction_ratio"), "artifacts")


def stage_summary(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage_name").agg(
        F.count(F.lit(1)).alias("runs"), rounded(F.avg("execution_time_seconds"), 3).alias("mean_seconds"),
        F.max("execution_time_seconds").alias("max_seconds"), F.count_if(F.col("status") == "failed").alias("failures"),
        rounded(F.count_if(F.col("status") == "failed") / F.count(F.lit(1)) * 100, 2).alias("failure_pct"))


def delivery_manifest(artifacts: DataFrame) -> DataFrame:
    """Archive name of each existing file."""
    return artifacts.where(F.col("file_size_bytes") > 0).select(
        "job_id", "stage_name", F.concat_ws("/", "stage_name", F.regexp_extract("file_path", r"([^/\\]+)$", 1)).alias("archive_name"), "file_size_bytes")


def delivery_totals(artifacts: DataFrame) -> DataFrame:
    """Bytes and files per stage, with the grand total."""
    return delivery_manifest(artifacts).rollup("stage_name").agg(
        F.sum("file_size_bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))


def without_missions(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of removed missions; child tables go through their jobs."""
    out = {}
    gone_jobs = tables["jobs"].join(removed, "mission_id", "left_semi").select("job_id") if "jobs" in tables else None
    for name, df in tables.items():
        key = "mission_id" if "mission_id" in df.columns else "job_id"
        out[name] = df.join(removed if key == "mission_id" else gone_jobs, key, "left_anti")
    return out


# ---- measurements ----

def pick_distances(picks: DataFrame) -> DataFrame:
    """Distance between consecutive picks of a drawing ``shape_id, seq, x, y, z``.

    The previous pick is joined by its number, so a long drawing is not one task.
    """
    before = picks.select("shape_id", (F.col("seq") + 1).alias("seq"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    d = sum((F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    return picks.join(before, ["shape_id", "seq"]).select("shape_id", "seq", F.sqrt(d).alias("distance_m"))


def fan_area(picks: DataFrame) -> DataFrame:
    """Polygon area as a triangle fan from the first pick, numbered from 0."""
    first = picks.where("seq = 0").select("shape_id", *[F.col(c).alias(f"_{c}0") for c in "xyz"])
    after = picks.select("shape_id", (F.col("seq") - 1).alias("seq"), *[F.col(c).alias(f"_{c}1") for c in "xyz"])
    j = picks.where("seq >= 1").join(after, ["shape_id", "seq"]).join(first, "shape_id")
    a = tuple(F.col(c) - F.col(f"_{c}0") for c in "xyz")
    b = tuple(F.col(f"_{c}1") - F.col(f"_{c}0") for c in "xyz")
    return j.groupBy("shape_id").agg(F.sum(0.5 * norm(cross(a, b))).alias("area_m2"))


def elevation_colours(points: DataFrame, keys: list[str] = ["cloud_id"]) -> DataFrame:
    """Colour ramp over the height range, which is at least 0.1."""
    ends = points.groupBy(*keys).agg(F.min("z").alias("_lo"), F.greatest(F.max("z") - F.min("z"), F.lit(0.1)).alias("_range"))
    t = (F.col("z") - F.col("_lo")) / F.col("_range")
    return points.join(ends, keys).withColumns({
        "ramp_r": F.sin(t * math.pi * 0.5), "ramp_g": F.sin(t * math.pi), "ramp_b": F.cos(t * math.pi * 0.5)
    }).drop("_lo", "_range")
