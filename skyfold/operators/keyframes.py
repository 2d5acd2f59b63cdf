"""Keyframe selection by parallax, view change and quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from skyfold.functions.linalg import rounded
from skyfold.operators.machines import table_fold
from skyfold.operators.ordered import running_sums
from skyfold.session import cut_lineage


@dataclass(frozen=True)
class KeyframeRules:
    min_displacement: float = 20.0
    max_drops: int = 10
    angle_variance: float = 0.5
    structural: float = 0.2
    min_tracks: int = 10
    max_keyframes: int | None = None


def flow_statistics(flow: DataFrame) -> DataFrame:
    """Median displacement, direction variance and tracks per (reference, current) frame.

    The group is the feature budget of one frame, so the exact median is bounded.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return flow.groupBy("mission_id", "ref_frame", "cur_frame").agg(
        F.percentile(F.hypot(dx, dy), F.lit(0.5)).alias("median_displacement"),
        F.var_pop(F.atan2(dy, dx)).alias("angle_variance"),
        F.count(F.lit(1)).alias("tracked"),
    )


def similarity_to_previous(displacement, min_displacement: float = 20.0):
    return F.greatest(F.lit(0.0), 1.0 - displacement / (2.0 * min_displacement))


def keyframe_decision(row, state: dict, rules: KeyframeRules) -> tuple[dict | None, dict]:
    """One step of the selector: a record (without reason if the frame only moved) or None, and the new state.

    The state is the reference frame, its features and the frames dropped since.
    """
    drops, ref = state.get("drops", 0), state.get("ref")
    reason, similarity, moved = None, 0.0, 0.0
    if row.classification == "LOW":
        if drops < rules.max_drops:
            return None, {**state, "drops": drops + 1}
        reason = "MAX_DROPS_REACHED (Low Quality Fallback)"
    elif ref is None:
        reason = "FIRST_FRAME"
    elif state["ref_features"] <= rules.min_tracks:
        reason = "INSUFFICIENT_PREVIOUS_FEATURES"
    else:
        seen = [m for m in (row.moves if row.moves is not None else []) if m["ref"] == ref]
        if not seen:
            reason = "LOST_TRACKING"
        elif seen[0]["tracked"] <= rules.min_tracks:
            reason = "LOST_TRACKING (Significant change)"
        else:
            moved = seen[0]["displacement"]
            similarity = max(0.0, 1.0 - moved / (2.0 * rules.min_displacement))
            if moved >= rules.min_displacement:
                reason = "SUFFICIENT_PARALLAX"
            elif seen[0]["variance"] > rules.angle_variance:
                reason = "VIEW_ANGLE_DIVERSITY"
            elif row.redundancy < rules.structural:
                reason = "STRUCTURAL_CHANGE"
            elif drops >= rules.max_drops:
                reason = "MAX_DROPS_REACHED"
    record = {"similarity_to_previous": round(similarity, 4), "selection_reason": reason, "moved": moved}
    if reason is None:
        return (record if moved else None), {**state, "drops": drops + 1}
    return record, {"drops": 0, "ref": int(row.frame_id), "ref_features": int(row.feature_count)}


def select_keyframes(scores: DataFrame, flow_stats: DataFrame, rules: KeyframeRules = KeyframeRules(), chunk_rows: int = 20_000) -> DataFrame:
    """Selected keyframes with reasons; the reference frame is always the last selected one. Jobs run here.

    ``flow_stats`` may hold several reference frames per current frame. A frame is
    selected after ``max_drops`` others at the latest, so runs from any state soon
    agree; ``keyframe_index`` and ``moved_so_far`` are running sums over the records.
    """
    moves = flow_stats.groupBy("mission_id", F.col("cur_frame").alias("frame_id")).agg(
        F.collect_list(F.struct(
            F.col("ref_frame").alias("ref"), F.col("median_displacement").alias("displacement"),
            F.col("angle_variance").alias("variance"), "tracked",
        )).alias("moves")
    )
    rows = scores.select(
        "mission_id", "frame_id", "frame_index", "classification", "redundancy", "feature_count",
        F.col("overall_quality").cast("int").alias("quality_score"),
    ).join(moves, ["mission_id", "frame_id"], "left")
    chunk = F.floor(F.col("frame_index") / chunk_rows)
    records = cut_lineage(table_fold(
        rows, ["mission_id"], ["frame_index"], chunk, lambda row, state: keyframe_decision(row, state, rules),
        ["mission_id", "frame_id", "frame_index", "quality_score"],
        "mission_id bigint, frame_id bigint, frame_index bigint, quality_score int, "
        "similarity_to_previous double, selection_reason string, moved double",
        along=lambda state, first: [{**state, "drops": d} for d in range(rules.max_drops + 1)], anchor="ref",
    ))
    chosen = F.col("selection_reason").isNotNull()
    summed = running_sums(
        records, ["mission_id"], ["frame_index"], chunk, {"_nth": F.when(chosen, 1).otherwise(0).cast("long"), "moved_so_far": F.col("moved")}
    )
    out = summed.where(chosen).select(
        "mission_id", "frame_id", "frame_index", "quality_score", (F.col("_nth") - 1).alias("keyframe_index"),
        "similarity_to_previous", "selection_reason", "moved_so_far",
    )
    return out if rules.max_keyframes is None else out.where(F.col("keyframe_index") < rules.max_keyframes)


def with_fallback(selected: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds the last frame where fewer than two were selected, and a status per row."""
    counts = selected.groupBy("mission_id").agg(F.count(F.lit(1)).alias("_n"))
    sizes = scores.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("_frames"),
        F.max_by(F.struct("frame_id", "frame_index", "overall_quality"), "frame_index").alias("_last"),
    )
    short = sizes.join(counts, "mission_id", "left").where((F.coalesce("_n", F.lit(0)) < 2) & (F.col("_frames") >= 2))
    added = short.select(
        "mission_id", F.col("_last.frame_id").alias("frame_id"), F.col("_last.frame_index").alias("frame_index"),
        F.col("_last.overall_quality").alias("quality_score"), F.coalesce("_n", F.lit(0)).alias("keyframe_index"),
        F.lit(0.0).alias("similarity_to_previous"), F.lit("MINIMUM_KEYFRAME_FALLBACK").alias("selection_reason"),
        F.lit(0.0).alias("moved_so_far"),
    )
    both = selected.unionByName(added)
    enough = both.groupBy("mission_id").agg((F.count(F.lit(1)) >= 2).alias("sufficient"))
    return both.join(enough, "mission_id")


def selection_report(selected: DataFrame, scores: DataFrame) -> DataFrame:
    """Reduction and mean displacement per mission."""
    frames = scores.groupBy("mission_id").agg(F.count(F.lit(1)).alias("input_frames"))
    kept = selected.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("keyframes_selected"), F.max("moved_so_far").alias("_moved")
    )
    n = F.coalesce("keyframes_selected", F.lit(0))
    return frames.join(kept, "mission_id", "left").select(
        "mission_id", "input_frames", n.alias("keyframes_selected"),
        rounded((1 - n / F.greatest("input_frames", F.lit(1))) * 100, 1).alias("reduction_percent"),
        rounded(F.coalesce("_moved", F.lit(0.0)) / F.greatest(n, F.lit(1)), 2).alias("mean_displacement_px"),
    )


def reason_histogram(selected: DataFrame) -> DataFrame:
    return selected.groupBy("selection_reason").agg(F.count(F.lit(1)).alias("keyframes"))
