"""Frame ingestion: sampling, fallback, naming, listing and probe checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from skyfold.functions.linalg import rounded
from skyfold.functions.text import frame_name
from skyfold.operators.machines import table_fold
from skyfold.operators.ordered import running_index


def step_size(fps: Column, interval: Column | float) -> Column:
    interval = interval if isinstance(interval, Column) else F.lit(float(interval))
    return F.greatest(F.lit(1), F.bround(fps * interval, 0).cast("int"))


def fixed_interval(frames: DataFrame, interval: float = 1.0) -> DataFrame:
    """Every n-th frame, n from the frame rate and the interval; needs ``fps``."""
    return frames.where(F.pmod(F.col("frame_index"), step_size(F.col("fps"), interval)) == 0)


def dense_candidates(missions: DataFrame, min_interval: float = 0.2, ceiling: int | None = None) -> DataFrame:
    """Candidate frame indexes at the least spacing; with a frame ceiling, at most three times that many."""
    step = step_size(F.col("fps"), min_interval)
    last = F.col("total_frames") - 1
    stop = last if ceiling is None else F.least(last, step * (3 * ceiling - 1))
    return missions.where(F.col("total_frames") > 0).select(
        "mission_id", "fps", "total_frames",
        F.explode(F.sequence(F.lit(0).cast("long"), stop.cast("long"), step.cast("long"))).alias("frame_index"),
    )


def up_to_ceiling(frames: DataFrame, ceiling: int, index: str = "sample_index") -> DataFrame:
    """The first frames of each mission, by their position among the kept ones."""
    return frames.where(F.col(index) < ceiling)


def at_least_two(kept: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds the first and last frame of missions that kept fewer than two."""
    counts = kept.groupBy("mission_id").agg(F.count(F.lit(1)).alias("_kept"))
    ends = frames.groupBy("mission_id").agg(
        F.min("frame_index").alias("_first"), F.max("frame_index").alias("_last")
    )
    short = (
        ends.where("_last > _first").join(counts, "mission_id", "left")
        .where(F.coalesce("_kept", F.lit(0)) < 2)
        .select("mission_id", F.explode(F.array("_first", "_last")).alias("frame_index"))
    )
    added = frames.join(short, ["mission_id", "frame_index"], "left_semi").join(
        kept, ["mission_id", "frame_index"], "left_anti"
    )
    return kept.select(frames.columns).unionByName(added)


def with_names(frames: DataFrame) -> DataFrame:
    return frames.withColumn("timestamp_sec", rounded(F.col("frame_index") / F.col("fps"))).withColumn(
        "frame_name", frame_name(F.col("frame_index"))
    )


def scaled_size(df: DataFrame, longest: int = 1920, width: str = "video_w", height: str = "video_h") -> DataFrame:
    """Target size with the longest side capped and the aspect kept."""
    side = F.greatest(width, height)
    factor = F.when((side > longest) & F.lit(longest > 0), longest / side).otherwise(F.lit(1.0))
    return df.withColumn("new_w", F.floor(F.col(width) * factor).cast("int")).withColumn(
        "new_h", F.floor(F.col(height) * factor).cast("int")
    )


def estimated_count(missions: DataFrame, interval: float = 1.0) -> DataFrame:
    duration = F.col("total_frames") / F.col("fps")
    return missions.withColumn("estimated_frames", F.greatest(F.lit(1), F.floor(duration / interval)).cast("long"))


def listing(frames: DataFrame, mission: int, skip: int = 0, limit: int = 100) -> DataFrame:
    return frames.where(F.col("mission_id") == mission).orderBy("frame_index").offset(skip).limit(limit)


def frame_at(frames: DataFrame, mission: int, index: int) -> DataFrame:
    return frames.where((F.col("mission_id") == mission) & (F.col("frame_index") == index))


def probe_check(probes: DataFrame) -> DataFrame:
    """Validity, reason and duration of each probed video."""
    reason = (
        F.when(~F.coalesce(F.col("fps") > 0, F.lit(False)), "frame rate is missing or zero")
        .when(~F.coalesce((F.col("video_w") > 0) & (F.col("video_h") > 0), F.lit(False)), "frame size is missing or zero")
        .when(~F.coalesce(F.col("total_frames") > 0, F.lit(False)), "frame count is missing or zero")
    )
    return probes.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).withColumn(
        "duration_sec", F.when(F.col("fps") > 0, rounded(F.col("total_frames") / F.col("fps")))
    )


def sampling_summary(kept: DataFrame, missions: DataFrame) -> DataFrame:
    """Extracted and total frames, effective rate and ratio per mission."""
    counts = kept.groupBy("mission_id").agg(F.count(F.lit(1)).alias("extracted"))
    duration = F.col("total_frames") / F.col("fps")
    return missions.join(counts, "mission_id", "left").select(
        "mission_id",
        F.coalesce("extracted", F.lit(0)).alias("extracted"),
        "total_frames",
        rounded(F.coalesce("extracted", F.lit(0)) / F.greatest(duration, F.lit(0.001))).alias("sampling_fps"),
        rounded(F.coalesce("extracted", F.lit(0)) / F.greatest(F.col("total_frames"), F.lit(1))).alias("ratio"),
    )


def thumbnail_similarity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Normalised correlation of two equal-size thumbnail arrays; 0 when either is flat."""
    n = F.size(a).cast("double")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    product = lambda p, q: total(F.zip_with(p, q, lambda u, v: u.cast("double") * v))
    da, db = (F.transform(c, lambda v: v.cast("double")) for c in (a, b))
    sa, sb = total(da), total(db)
    top = n * product(da, db) - sa * sb
    bottom = F.sqrt((n * product(da, da) - sa * sa) * (n * product(db, db) - sb * sb))
    return pairs.withColumn("similarity", F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0)))


def pixel_similarity(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same measure over two pixel tables: ``pairs(frame_a, frame_b)``."""
    a = pixels.select(F.col("frame_id").alias("frame_a"), "x", "y", F.col("gray").cast("double").alias("ga"))
    b = pixels.select(F.col("frame_id").alias("frame_b"), "x", "y", F.col("gray").cast("double").alias("gb"))
    joined = pairs.join(a, "frame_a").join(b, ["frame_b", "x", "y"])
    return joined.groupBy("frame_a", "frame_b").agg(F.corr("ga", "gb").alias("similarity"))


@dataclass(frozen=True)
class SamplerRules:
    """Thresholds of the adaptive samplers."""

    blur: float = 40.0
    similarity: float = 0.90
    features: int = 50
    ceiling: int | None = None
    dark: float = 20.0
    bright: float = 235.0
    poor_limit: int = 8
    min_interval: float = 0.25
    max_interval: float = 2.0


def correlation(a, b) -> float:
    """Normalised correlation of two thumbnails, 0 when either is flat."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    a, b = a - a.mean(), b - b.mean()
    bottom = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / bottom) if bottom > 0 else 0.0


def gate_decision(row, state: dict, rules: SamplerRules) -> tuple[bool, dict]:
    """Simple gate: drop blurred, repeated or bare frames; ends are always kept. The state is the thumbnail to compare with."""
    thumb = {"thumb": list(map(float, row.thumb))}
    if not state:
        return True, thumb
    if row.frame_index >= row.total_frames - 1:
        return True, state
    if row.laplacian_var < rules.blur or row.feature_count < rules.features or correlation(row.thumb, state["thumb"]) > rules.similarity:
        return False, state
    return True, thumb


def _paces(fps: float, rules: SamplerRules) -> tuple[int, int]:
    least = max(1, int(round(fps * rules.min_interval)))
    return least, max(least + 1, int(round(fps * rules.max_interval)))


def paced_decision(row, state: dict, rules: SamplerRules) -> tuple[bool, dict]:
    """Paced gate: looks only every few frames, slows on static scenes, forces a
    frame after a run of poor ones. The state is the last kept thumbnail, the run of
    poor frames and the next frame to look at."""
    if row.frame_index < state.get("due", 0):
        return False, state
    poor = state.get("poor", 0)
    least, most = _paces(row.fps, rules)
    advance, keep = least, True
    if "thumb" in state:
        dim = not rules.dark <= row.mean_luminance <= rules.bright
        if dim or row.laplacian_var < rules.blur:
            keep, poor = False, poor + 1
        elif correlation(row.thumb, state["thumb"]) > rules.similarity:
            keep, advance = False, min(advance + 2, most)
        else:
            poor = 0
            if row.feature_count < rules.features:
                keep, poor = False, poor + 1
        if not keep and poor >= rules.poor_limit:
            keep, advance = True, least
    new = {**state, "poor": poor, "due": int(row.frame_index) + advance}
    if keep:
        new.update(poor=0, thumb=list(map(float, row.thumb)))
    return keep, new


def _phases(first, rules: SamplerRules) -> list[int]:
    """Frames at or after a chunk's first one at which a paced run may look next."""
    least, most = _paces(first.fps, rules)
    return [int(first.frame_index) + d for d in range(max(least, min(least + 2, most)))]


def adaptive_sample(frames: DataFrame, decide=gate_decision, rules: SamplerRules = SamplerRules(), chunk_rows: int = 20_000) -> DataFrame:
    """Kept frames of each mission by an ordered gate (``gate_decision`` or ``paced_decision``); jobs run here.

    What a run does after a kept frame depends on that frame alone, so a chunk's
    transition table needs the start and, for the paced gate, the frames at which a
    run may look first. A ceiling keeps each mission's first frames.
    """

    def pick(row, state: dict) -> tuple[dict | None, dict]:
        keep, state = decide(row, state, rules)
        return ({} if keep else None), state

    paced = decide is paced_decision
    needed = ["mission_id", "frame_id", "frame_index", "total_frames", "fps", "laplacian_var",
              "mean_luminance", "feature_count", "thumb"]
    chunk = F.floor(F.col("frame_index") / chunk_rows)
    kept = table_fold(
        frames.select(*needed), ["mission_id"], ["frame_index"], chunk, pick, ["mission_id", "frame_id", "frame_index"],
        "mission_id bigint, frame_id bigint, frame_index bigint",
        seeds=(lambda first: [{"due": due} for due in _phases(first, rules)]) if paced else lambda first: [],
        along=(lambda state, first: [{**state, "due": due} for due in _phases(first, rules)]) if paced else lambda state, first: [state],
        anchor="thumb",
    )
    if rules.ceiling is None:
        return kept
    placed = running_index(kept, ["mission_id"], ["frame_index"], chunk, "_kept")
    return up_to_ceiling(placed, rules.ceiling, "_kept").drop("_kept")
