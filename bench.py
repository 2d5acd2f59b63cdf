"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
"""

from __future__ import annotations

import json
import os
import time

from skyfold.plans import catalog
from skyfold.session import local_session

HEADLINE = [
    "frame_quality_report", "pixel_quality_metrics", "illumination_summary", "flow_statistics", "keyframe_selection_report",
    "dynamic_layer_analytics", "telemetry_match", "similarity_alignment", "scale_from_positions", "trajectory_fusion",
    "descriptor_matches", "triangulated_points", "back_projection", "voxel_first", "neighbour_distances",
    "density_score", "mesh_statistics", "smoothed_mesh", "component_sizes", "best_views", "tier_statistics",
    "live_job_metrics", "run_comparison", "job_quality_report",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus), "skyfold-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
