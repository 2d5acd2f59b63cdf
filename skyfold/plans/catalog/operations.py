"""Queries over missions, jobs, stages, artifacts and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions.linalg import rounded
from skyfold.operators import reports as rp
from skyfold.plans import adapters as ad
from skyfold.plans.registry import query, r6

_GSD = "flight_altitude_m*sensor_width_mm/(focal_length_mm*image_w)*100"


@query("ground_sample_distance", "missions", f"SELECT mission_id, {r6(_GSD)} achieved_gsd_cm FROM missions")
def _(spark, sf):
    out = rp.ground_sample_distance(ad.missions(spark, sf))
    return out.select("mission_id", rounded(F.col("achieved_gsd_cm")).alias("achieved_gsd_cm"))


def _runs(spark, sf):
    m = rp.ground_sample_distance(ad.missions(spark, sf))
    k = F.col("mission_id")
    return m.select(
        k.alias("run_id"), F.when(k % 7 != 0, (k % 40) / 10).alias("reproj_error_px"), "achieved_gsd_cm", "target_gsd_cm",
        F.when(k % 5 != 0, k % 400).alias("points"), (F.col("balance") / 10).alias("surface_area_m2"),
    )


_RUNS = f""", runs AS (SELECT mission_id run_id, CASE WHEN mission_id%7<>0 THEN (mission_id%40)/10 END err, {_GSD} gsd, target_gsd_cm, CASE WHEN mission_id%5<>0 THEN mission_id%400 END points, balance/10 area FROM missions),
 dv AS (SELECT *, abs(gsd-target_gsd_cm)/greatest(0.1e0,target_gsd_cm)*100 drift FROM runs),
 cr AS (SELECT run_id, 'reprojection_error' parameter, err measured, 2.5e0 threshold, CASE WHEN err IS NULL THEN 'UNAVAILABLE' WHEN err<=2.5 THEN 'PASS' ELSE 'FAIL' END status FROM dv UNION ALL
 SELECT run_id, 'gsd_deviation_pct', drift, 35e0, CASE WHEN drift<=35 THEN 'PASS' ELSE 'WARNING' END FROM dv UNION ALL
 SELECT run_id, 'point_count', CAST(points AS DOUBLE), 50e0, CASE WHEN points IS NULL THEN 'UNAVAILABLE' WHEN points>=50 THEN 'PASS' ELSE 'FAIL' END FROM dv) """


@query("validation_criteria", "missions", _RUNS + f"SELECT run_id, parameter, {r6('measured')} measured, threshold, status FROM cr")
def _(spark, sf):
    out = rp.validation_criteria(_runs(spark, sf))
    return out.withColumn("measured", rounded(F.col("measured")))


@query("validation_status", "missions", _RUNS + """, ok AS (SELECT run_id, bool_and(status<>'FAIL') k FROM cr GROUP BY 1)
 SELECT run_id, CASE WHEN k THEN 'PASSED' ELSE 'WARNING' END validation_status, CASE WHEN k AND coalesce(err<1.8,false) THEN 'A' WHEN k THEN 'B' ELSE 'C' END grade FROM runs JOIN ok USING (run_id)""")
def _(spark, sf):
    runs = _runs(spark, sf)
    return rp.validation_status(runs, rp.validation_criteria(runs))


@query("point_density", "missions", _RUNS + f"SELECT run_id, {r6('points/greatest(1,area)',1)} points_per_m2 FROM runs")
def _(spark, sf):
    return _runs(spark, sf).select("run_id", rp.point_density(F.col("points"), F.col("surface_area_m2")).alias("points_per_m2"))


def _measured(spark, sf):
    """Measured runs: job counts with the job's price as duration."""
    m = rp.live_metrics(ad.job_stages(spark, sf))
    j = ad.jobs(spark, sf)
    return j.join(m, "job_id").select(
        "mission_id", "job_id", F.col("frames_extracted").alias("raw_frames"), F.col("keyframes_selected").alias("keyframes"),
        "cameras_registered", "dense_points", (F.col("price") / 1000).alias("surface_area_m2"), "triangles", "confidence_high_pct",
        (F.col("price") / 100).alias("processing_seconds"),
    )


_LIVE_NAMES = {"frames_extracted": ("preprocessing", "extracted_frames_count"), "keyframes_selected": ("keyframe_selection", "keyframes_selected"),
               "dynamic_objects_masked": ("dynamic_masking", "total_detections"), "cameras_registered": ("geometry", "successful_image_registrations"),
               "dense_points": ("dense_point_cloud", "number_of_dense_points"), "triangles": ("mesh_generation", "mesh_triangles"),
               "confidence_high_pct": ("confidence_estimation", "high_confidence_percentage")}
_LIVE = ", live AS (SELECT job_id, " + ", ".join(
    f"max(CASE WHEN stage_name='{st}' AND status='completed' THEN CAST(json_extract_string(metrics_json,'$.{k}') AS DOUBLE) END) {n}" for n, (st, k) in _LIVE_NAMES.items()
) + " FROM job_stages GROUP BY 1) "


@query("live_job_metrics", "job_stages", _LIVE + "SELECT * FROM live")
def _(spark, sf):
    return rp.live_metrics(ad.job_stages(spark, sf))


_MEAS = _LIVE + """, ms AS (SELECT mission_id, job_id, frames_extracted rf, keyframes_selected kf, cameras_registered cr, dense_points dp, price/1000 ar, triangles, confidence_high_pct, price/100 processing_seconds FROM jobs JOIN live USING (job_id)),
 de AS (SELECT *, CASE WHEN rf>0 THEN round((rf-kf)/rf*100,1) END frame_reduction_pct, CASE WHEN kf>0 THEN round(cr/kf*100,1) END registration_pct, round(dp/greatest(1,ar),1) points_per_m2 FROM ms) """


@query("derived_ratios", "jobs job_stages", _MEAS + f"SELECT job_id, {r6('frame_reduction_pct',1)} frame_reduction_pct, {r6('registration_pct',1)} registration_pct, {r6('points_per_m2',1)} points_per_m2 FROM de")
def _(spark, sf):
    return rp.derived_ratios(_measured(spark, sf)).select("job_id", "frame_reduction_pct", "registration_pct", "points_per_m2")


_UP = {"frame_reduction_pct": 1, "registration_pct": 1, "points_per_m2": 1, "triangles": 1, "confidence_high_pct": 1, "processing_seconds": 0}
_LONG = " UNION ALL ".join(
    [f"SELECT mission_id, '{m}' metric, CAST(a.{m} AS DOUBLE) baseline, CAST(b.{m} AS DOUBLE) candidate, {u} up FROM fi a JOIN la b USING (mission_id)" for m, u in _UP.items()]
    + [f"SELECT mission_id, '{m}', NULL::DOUBLE, NULL::DOUBLE, 0 FROM fi a JOIN la b USING (mission_id)" for m in ("reproj_error_px", "cpu_pct", "scale_error_pct", "position_rmse_m")])


@query("run_comparison", "jobs job_stages", _MEAS + f""", ends AS (SELECT mission_id, min(job_id) f, max(job_id) l FROM de GROUP BY 1), fi AS (SELECT de.* FROM de JOIN ends ON de.job_id=f AND f<l), la AS (SELECT de.* FROM de JOIN ends ON de.job_id=l AND f<l), lo AS ({_LONG})
 SELECT mission_id, metric, baseline, candidate, {r6('candidate-baseline')} delta, CASE WHEN baseline<>0 THEN {r6('(candidate-baseline)/abs(baseline)*100',1)} END delta_pct,
 CASE WHEN candidate-baseline IS NULL THEN 'unavailable' WHEN (up=1 AND candidate>=baseline) OR (up=0 AND candidate<=baseline) THEN 'PASS' ELSE 'REGRESSION' END status FROM lo""")
def _(spark, sf):
    runs = rp.derived_ratios(_measured(spark, sf))
    ends = runs.groupBy("mission_id").agg(F.min("job_id").alias("_a"), F.max("job_id").alias("_b")).where("_a < _b")
    pick = lambda c: runs.join(ends.select("mission_id", F.col(c).alias("job_id")), ["mission_id", "job_id"], "left_semi")
    return rp.compare_runs(pick("_a"), pick("_b"), ["mission_id"])


@query("run_speed_up", "jobs job_stages", _MEAS + f""", ends AS (SELECT mission_id, min(job_id) f, max(job_id) l FROM de GROUP BY 1)
 SELECT e.mission_id, a.job_id baseline_job, b.job_id candidate_job, {r6('a.processing_seconds/greatest(0.1e0,b.processing_seconds)+1e-9::DOUBLE',1)} speed_up FROM ends e JOIN de a ON a.job_id=f JOIN de b ON b.job_id=l WHERE f<l""")
def _(spark, sf):
    """How much faster a mission's last run is than its first."""
    runs = _measured(spark, sf).select("mission_id", "job_id", "processing_seconds")
    of = lambda pick, name: pick(F.struct("job_id", "processing_seconds")).alias(name)
    ends = runs.groupBy("mission_id").agg(of(F.min, "_a"), of(F.max, "_b")).where("_a.job_id < _b.job_id")
    return ends.select(
        "mission_id", F.col("_a.job_id").alias("baseline_job"), F.col("_b.job_id").alias("candidate_job"),
        rp.speed_up(F.col("_a.processing_seconds"), F.col("_b.processing_seconds")).alias("speed_up"),
    )


@query("ground_truth_errors", "missions", f""", t AS (SELECT mission_id, 25e0 st, 25e0+(mission_id%13)*0.018e0 mt, 0.038e0+(mission_id%9)*0.01e0 rm FROM missions WHERE mission_id%2=0)
 SELECT m.mission_id, {r6('abs(mt-st)/st*100',3)} scale_error_pct, CASE WHEN st IS NULL THEN 'unavailable' ELSE 'measured' END scale_status, {r6('rm',3)} position_rmse_m, CASE WHEN rm IS NULL THEN 'unavailable' ELSE 'measured' END position_status,
 CASE WHEN rm IS NULL THEN 'unavailable' ELSE printf('%.3f', round(rm,3))||'m RMSE' END position_text FROM missions m LEFT JOIN t USING (mission_id)""")
def _(spark, sf):
    m = ad.missions(spark, sf)
    k = F.col("mission_id")
    truth = m.where(k % 2 == 0).select("mission_id", F.lit(25.0).alias("scale_target_m"), (25.0 + (k % 13) * 0.018).alias("measured_scale_m"), (0.038 + (k % 9) * 0.01).alias("checkpoints_rmse_m"))
    return rp.ground_truth(m, truth, ["mission_id"])


@query("mission_list", "missions", "SELECT mission_id, name, status, created_sec FROM missions ORDER BY created_sec DESC, mission_id OFFSET 10 LIMIT 40")
def _(spark, sf):
    return rp.mission_list(ad.missions(spark, sf), 10, 40).select("mission_id", "name", "status", "created_sec")


@query("mission_search", "missions", "SELECT mission_id, name, status FROM missions WHERE name ILIKE '%fail%' OR CAST(mission_id AS VARCHAR) ILIKE '%fail%' OR status ILIKE '%fail%' ORDER BY created_sec DESC, mission_id LIMIT 50")
def _(spark, sf):
    return rp.mission_list(ad.missions(spark, sf), 0, 50, " Fail").select("mission_id", "name", "status")


@query("fleet_statistics", "missions jobs", f"""SELECT count(*) total, count(*) FILTER (status='completed' OR EXISTS (SELECT 1 FROM jobs j WHERE j.mission_id=m.mission_id AND j.status='completed')) completed,
 count(*) FILTER (status IN ('processing','ready')) active, {r6('sum(video_size_bytes)/1048576e0',1)} total_mb, {r6('avg(target_gsd_cm)',1)} avg_gsd_cm, {r6("(count(*)-count(*) FILTER (status='failed'))/count(*)*100",0)} health_pct FROM missions m""")
def _(spark, sf):
    return rp.fleet_statistics(ad.missions(spark, sf), ad.jobs(spark, sf))


@query("jobs_of_mission", "jobs", "SELECT job_id, status, started_sec FROM jobs WHERE mission_id=9 ORDER BY started_sec DESC, job_id")
def _(spark, sf):
    return rp.jobs_of(ad.jobs(spark, sf), 9).select("job_id", "status", "started_sec")


@query("job_progress", "job_stages", f"SELECT job_id, count(*) FILTER (status='completed') stages_completed, {r6(chr(40)+chr(39).join(['count(*) FILTER (status=','completed',')'])+'/13e0*100)',1)} progress_pct FROM job_stages GROUP BY 1")
def _(spark, sf):
    return rp.progress(ad.job_stages(spark, sf))


@query("job_readiness", "jobs job_stages", """, g AS (SELECT job_id, bool_or(stage_name='geometry' AND status='completed') r FROM job_stages GROUP BY 1)
 SELECT job_id, coalesce(r,false) rapid_model_ready, status='completed' refined_model_ready FROM jobs LEFT JOIN g USING (job_id)""")
def _(spark, sf):
    return rp.readiness(ad.jobs(spark, sf), ad.job_stages(spark, sf))


@query("resume_point", "jobs job_stages", """, o AS (SELECT job_id, arg_min(stage_name, stage_order) f FROM job_stages WHERE status IN ('failed','pending') GROUP BY 1)
 SELECT job_id, coalesce(error_stage, f, 'preprocessing') resume_stage FROM jobs LEFT JOIN o USING (job_id)""")
def _(spark, sf):
    return rp.resume_point(ad.jobs(spark, sf), ad.job_stages(spark, sf))


@query("usable_checkpoints", "job_stages", """, w AS (SELECT *, min(CASE WHEN status='completed' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY stage_order) ok FROM job_stages)
 SELECT job_id, stage_order, stage_name FROM w WHERE ok=1""")
def _(spark, sf):
    return rp.usable_prefix(ad.job_stages(spark, sf))


@query("merged_artifacts", "artifacts", ", r AS (SELECT *, row_number() OVER (PARTITION BY job_id, artifact_type ORDER BY stage_order DESC, file_path DESC) rn FROM artifacts) SELECT job_id, artifact_type, file_path, stage_name FROM r WHERE rn=1")
def _(spark, sf):
    return rp.merged_artifacts(ad.artifacts(spark, sf)).drop("file_size_bytes")


@query("artifact_lookup", "artifacts", ", r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY stage_order, file_path) rn FROM artifacts WHERE artifact_type='mesh') SELECT job_id, file_path FROM r WHERE rn=1")
def _(spark, sf):
    return rp.first_artifact(ad.artifacts(spark, sf), "mesh")


@query("job_quality_report", "jobs job_stages artifacts", _LIVE + f""", r AS (SELECT *, row_number() OVER (PARTITION BY job_id, artifact_type ORDER BY stage_order DESC, file_path DESC) rn FROM artifacts),
 ar AS (SELECT job_id, string_agg(artifact_type||'='||file_path, ';' ORDER BY artifact_type) a FROM r WHERE rn=1 GROUP BY 1)
 SELECT job_id, mission_id, status, frames_extracted, keyframes_selected, dense_points, triangles, CASE WHEN frames_extracted>0 THEN {r6('1-keyframes_selected/frames_extracted',2)} END keyframe_reduction_ratio, coalesce(a,'') artifacts
 FROM jobs LEFT JOIN live USING (job_id) LEFT JOIN ar USING (job_id)""")
def _(spark, sf):
    out = rp.job_quality_report(ad.jobs(spark, sf), ad.job_stages(spark, sf), ad.artifacts(spark, sf))
    text = F.array_join(F.transform(F.map_entries("artifacts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("job_id", "mission_id", "status", "frames_extracted", "keyframes_selected", "dense_points", "triangles", "keyframe_reduction_ratio", F.coalesce(text, F.lit("")).alias("artifacts"))


_FAILED = "count(*) FILTER (status='failed')"


@query("stage_summary", "job_stages", f"SELECT stage_name, count(*) runs, {r6('avg(execution_time_seconds)',3)} mean_seconds, max(execution_time_seconds) max_seconds, {_FAILED} failures, {r6(_FAILED+'/count(*)*100',2)} failure_pct FROM job_stages GROUP BY 1")
def _(spark, sf):
    return rp.stage_summary(ad.job_stages(spark, sf))


@query("delivery_manifest", "artifacts", "SELECT job_id, stage_name||'/'||regexp_extract(file_path,'([^/]+)$',1) archive_name, file_size_bytes FROM artifacts WHERE file_size_bytes>0")
def _(spark, sf):
    return rp.delivery_manifest(ad.artifacts(spark, sf)).drop("stage_name")


@query("delivery_totals", "artifacts", "SELECT stage_name, CAST(sum(file_size_bytes) AS BIGINT) bytes, count(*) files FROM artifacts WHERE file_size_bytes>0 GROUP BY ROLLUP(stage_name)")
def _(spark, sf):
    return rp.delivery_totals(ad.artifacts(spark, sf))


@query("cascade_delete", "missions jobs job_stages", """, gone AS (SELECT mission_id FROM missions WHERE status='failed'), gj AS (SELECT job_id FROM jobs WHERE mission_id IN (SELECT mission_id FROM gone))
 SELECT 'missions' AS "table", count(*) "rows" FROM missions WHERE mission_id NOT IN (SELECT mission_id FROM gone) UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE mission_id NOT IN (SELECT mission_id FROM gone)
 UNION ALL SELECT 'job_stages', count(*) FROM job_stages WHERE job_id NOT IN (SELECT job_id FROM gj)""")
def _(spark, sf):
    m = ad.missions(spark, sf)
    left = rp.without_missions({"missions": m, "jobs": ad.jobs(spark, sf), "job_stages": ad.job_stages(spark, sf)}, m.where("status = 'failed'").select("mission_id"))
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _picks(spark, sf):
    """Drawings of ten picks: orders grouped by tens."""
    k = F.col("o_orderkey")
    return ad.table(spark, sf, "orders").select(
        F.floor(k / 10).alias("shape_id"), (k % 10).alias("seq"), ((F.col("o_custkey") % 401) / 8).alias("x"), ((k % 397) / 8).alias("y"), (F.col("o_totalprice") / 50000).alias("z"))


_PICKS = ", pk AS (SELECT CAST(floor(o_orderkey/10) AS BIGINT) shape_id, o_orderkey%10 seq, (o_custkey%401)/8 x, (o_orderkey%397)/8 y, o_totalprice/50000 z FROM orders) "


@query("pick_distances", "points", _PICKS + f", l AS (SELECT shape_id, seq, sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)+pow(z-lag(z) OVER w,2)) d FROM pk WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) SELECT shape_id, seq, {r6('d')} distance_m FROM l WHERE d IS NOT NULL")
def _(spark, sf):
    out = rp.pick_distances(_picks(spark, sf))
    return out.withColumn("distance_m", rounded(F.col("distance_m")))


@query("fan_area", "points", _PICKS + f""", l AS (SELECT shape_id, x-first_value(x) OVER w ax, y-first_value(y) OVER w a_y, z-first_value(z) OVER w az, lead(x) OVER w-first_value(x) OVER w bx, lead(y) OVER w-first_value(y) OVER w b_y, lead(z) OVER w-first_value(z) OVER w bz FROM pk WINDOW w AS (PARTITION BY shape_id ORDER BY seq))
 SELECT shape_id, {r6('sum(0.5e0*sqrt(pow(a_y*bz-az*b_y,2)+pow(az*bx-ax*bz,2)+pow(ax*b_y-a_y*bx,2)))',4)} area_m2 FROM l WHERE bx IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return rp.fan_area(_picks(spark, sf)).withColumn("area_m2", rounded(F.col("area_m2"), 4))


@query("elevation_colours", "points", f""", e AS (SELECT cloud_id, min(z) lo, greatest(max(z)-min(z),0.1e0) ra FROM points GROUP BY 1)
 SELECT point_id, {r6('sin((z-lo)/ra*pi()*0.5e0)')} ramp_r, {r6('sin((z-lo)/ra*pi())')} ramp_g, {r6('cos((z-lo)/ra*pi()*0.5e0)')} ramp_b FROM points JOIN e USING (cloud_id)""")
def _(spark, sf):
    out = rp.elevation_colours(ad.points(spark, sf))
    return out.select("point_id", *[rounded(F.col(c)).alias(c) for c in ("ramp_r", "ramp_g", "ramp_b")])
