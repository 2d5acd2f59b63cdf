"""Schemas of the survey tables that are read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

FIXES = ("timestamp_sec double, latitude double, longitude double, altitude double, fix_type string, source string"
)
FRAME_ENTRY = "frame_id: string, frame_index: bigint, timestamp_sec: double, file: string, filepath: string, filename: string, width: int, height: int, file_size_bytes: bigint"
MANIFEST = (f"video_name string, fps double, total_frames bigint, extracted_frame_count bigint, frames array<struct<{FRAME_ENTRY}>>"
)
MISSIONS = ("mission_id bigint, name string, status string, sensor_width_mm double, focal_length_mm double, flight_altitude_m double, "
    "target_gsd_cm double, image_w int, video_size_bytes bigint, fps double, video_w int, video_h int, total_frames bigint, created_sec bigint"
)
JOBS = ("job_id bigint, mission_id bigint, status string, error_stage string, started_sec bigint")
JOB_STAGES = ("job_id bigint, stage_name string, stage_order int, status string, execution_time_seconds double, metrics_json string"
)
ARTIFACTS = ("job_id bigint, artifact_type string, stage_name string, stage_order int, file_path string, file_size_bytes bigint"
)
FRAMES = ("mission_id bigint, frame_id bigint, frame_index bigint, timestamp_sec double")
CONTROL = {"missions": MISSIONS, "jobs": JOBS, "job_stages": JOB_STAGES, "artifacts": ARTIFACTS, "frames": FRAMES}

REPORTS = {
    "frame_quality": ("frames", "frame_id:string,overall_quality:int,classification:string,usable:boolean,redundancy:double,feature_score:double,laplacian_var:double,exposure:double"),
    "keyframes": ("keyframes", "keyframe_id:bigint,original_frame_id:string,timestamp_sec:double,quality_score:double,selection_reason:string"),
    "detections": ("dynamic_objects", "frame_id:string,object_class:string,confidence:double,bounding_box:array<double>"),
    "illumination": ("frames", "frame_id:string,exposure_score:double,shadow_score:double,contrast_score:double,final_quality_status:string,normalization_applied:array<string>"),
    "trajectory": ("trajectory", "keyframe_id:bigint,frame_id:string,timestamp:double,position:array<double>,confidence:double,inlier_matches:bigint"),
    "poses": (None, "keyframe_id:bigint,filename:string,R:array<array<double>>,t:array<double>,position:array<double>"),
    "matches": (None, "frame_i:bigint,frame_j:bigint,raw_matches:bigint,verified_inliers:bigint,inlier_ratio:double"),
}


def require(df: DataFrame, ddl: str, name: str) -> DataFrame:
    """The columns of the schema in order; fails on a missing column or another type."""
    schema = T.StructType.fromDDL(ddl)
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if field.name not in have:
            raise ValueError(f"{name}: column {field.name} is missing")
        if have[field.name] != field.dataType:
            raise ValueError(f"{name}: column {field.name} is {have[field.name].simpleString()}, not {field.dataType.simpleString()}")
    return df.select(schema.fieldNames())
