"""Analytic cases of the survey operators on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.functions import geodesy as geo
from skyfold.operators import cloud as pc, confidence as cf, dense as dn, frames as fr, georef as gr, illumination as il
from skyfold.operators import keyframes as kf, mesh as ms, objects as ob, quality as ql, reports as rp, trajectory as tr, views as vw

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_geodesy_round_trips(spark):
    df = spark.createDataFrame([(28.6139, 77.2090, 215.0), (28.61435, 77.21002, 225.0), (-33.9, 18.4, 10.0)], "lat double, lon double, alt double")
    back = geo.from_ecef(*geo.to_ecef(F.col("lat"), F.col("lon"), F.col("alt")))
    utm = geo.to_utm(F.col("lat"), F.col("lon"))
    for r in df.select("lat", "lon", "alt", *[c.alias(f"b{i}") for i, c in enumerate(back)], utm["zone"].alias("zone"), utm["hemisphere"].alias("hemi")).collect():
        assert abs(r.lat - r.b0) < 1e-7 and abs(r.lon - r.b1) < 1e-7 and abs(r.alt - r.b2) < 1e-3
        assert r.hemi == ("N" if r.lat > 0 else "S") and (r.lat < 0 or r.zone == 43)
    pole = spark.range(1).select(*[c.alias(n) for c, n in zip(geo.from_ecef(F.lit(0.0), F.lit(0.0), F.lit(6356752.0)), "abc")]).first()
    assert pole.a == 90.0 and pole.b == 0.0


def test_local_origin(spark):
    args = [F.lit(v) for v in (37.774929 + 0.001, -122.419416, 110.0, 37.774929, -122.419416, 100.0)]
    e, n, u = spark.range(1).select(*[c.alias(x) for c, x in zip(geo.to_enu(*args), "enu")]).first()
    assert abs(e) < 1 and 100 < n < 120 and abs(u - 10) < 0.01


def similar(scale, angle, shift):
    c, s = math.cos(angle), math.sin(angle)
    rot = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    src = np.array([[0, 0, 0], [10, 0, 1], [0, 8, 2], [5, 5, 5], [-3, 2, 1.0]])
    return src, (scale * (rot @ src.T)).T + np.array(shift), rot


def test_similarity_is_recovered(spark):
    src, dst, rot = similar(12.5, math.radians(30), [100, -50, 25])
    rows = [(1, a.tolist(), b.tolist()) for a, b in zip(src, dst)] + [(2, [0.0] * 3, [1.0] * 3)]
    pairs = spark.createDataFrame(rows, "mission_id long, src array<double>, dst array<double>")
    got = {r.mission_id: r for r in tr.similarity_alignment(pairs, ["mission_id"]).collect()}
    assert abs(got[1].scale - 12.5) < 1e-3 and np.allclose(np.reshape(got[1].R, (3, 3)), rot, atol=1e-3) and np.allclose(got[1].t, [100, -50, 25], atol=1e-3)
    assert got[2].scale == 1.0 and got[2].R == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def cameras(spark, n, geo_of=lambda i: [10.0 * i, 0.0, 0.0]):
    rows = [(1, i, [2.0 * i, 0.0, 0.0], geo_of(i), False) for i in range(n)]
    return spark.createDataFrame(rows, "mission_id long, idx long, rel array<double>, geo array<double>, is_rtk boolean")


def test_scale_hierarchy(spark):
    missions = spark.createDataFrame([(1, 40.0)], "mission_id long, flight_altitude_m double")
    base = spark.createDataFrame([(1, 0, 3, 45.0)], "mission_id long, idx_a long, idx_b long, distance_m double")
    cams = cameras(spark, 4)
    gnss, alt = gr.scale_from_positions(cams), gr.scale_from_altitude(cams, missions)
    assert abs(gnss.first().scale - 5.0) < 1e-9
    best = gr.choose_scale(missions, [gr.scale_from_baselines(cams, base), gnss, alt]).first()
    assert best.scale == 7.5 and best.confidence == 0.95
    lost = gr.choose_scale(missions, [gr.scale_from_positions(cameras(spark, 4, lambda i: None)), alt]).first()
    assert lost.source == "BAROMETRIC_LASER_ALTIMETRY"


def test_large_mission_scale_equals_whole(spark):
    rng = np.random.default_rng(7)
    noise = rng.normal(0, 0.4, (60, 3))
    rel = rng.uniform(0, 50, (60, 3))
    rows = [(1, i, rel[i].tolist(), (rel[i] * 3 + noise[i]).tolist(), True) for i in range(60)]
    cams = spark.createDataFrame(rows, "mission_id long, idx long, rel array<double>, geo array<double>, is_rtk boolean")
    whole, blocks = gr.scale_from_positions(cams).first(), gr.scale_from_positions(cams, block=16).first()
    assert whole.evaluated == blocks.evaluated and whole.source == blocks.source
    assert math.isclose(whole.scale, blocks.scale, rel_tol=1e-12) and math.isclose(whole["std"], blocks["std"], rel_tol=1e-9)


def test_checkpoints(spark):
    tf = spark.createDataFrame([(1, 2.0, EYE, [5.0, 5.0, 5.0])], "mission_id long, scale double, R array<double>, t array<double>")
    cps = spark.createDataFrame([(1, "GCP-1", 7.0, 9.0, 5.0, [1.0, 2.0, 0.0]), (1, "GCP-2", 5.0, 5.0, 7.0, [0.0, 0.0, 1.0])], "mission_id long, id string, east_m double, north_m double, up_m double, obs array<double>")
    missions = spark.createDataFrame([(1,), (2,)], "mission_id long")
    got = {r.mission_id: r for r in gr.checkpoint_report(missions, gr.checkpoint_errors(cps, tf)).collect()}
    assert got[1].checkpoint_count == 2 and got[1].checkpoint_rmse_horizontal_m < 0.01
    assert not got[2].checkpoints_provided and got[2].checkpoint_rmse_horizontal_m is None


def stations(spark, spike=True, gps=True):
    rows = []
    for i in range(6):
        p = [float(i), 0.5 * i, 0.0]
        g = [p[0] + (5000.0 if spike and i == 3 else 0.0), p[1], p[2]] if gps else None
        rows.append((1, i, float(i), p, g, "RTK_FIXED", 80))
    return spark.createDataFrame(rows, "mission_id long, idx long, t double, visual array<double>, gps array<double>, fix_type string, inliers long")


@pytest.mark.parametrize("chunk", [2, 1000])
def test_fusion_rejects_spike(spark, chunk):
    out = tr.smooth_backward(tr.forward_filter(stations(spark), chunk), chunk).orderBy("idx").collect()
    assert sum(r.rejected for r in out) == 1 and out[3].rejected
    assert all(abs(r.fused[0] - r.idx) < 0.5 and r.confidence >= 0.15 for r in out)
    assert tr.trajectory_level(stations(spark)).first().level == "LEVEL_2_FUSED"


def test_fusion_chunks_agree(spark):
    a, b = (tr.smooth_backward(tr.forward_filter(stations(spark), c), c).orderBy("idx").collect() for c in (2, 1000))
    assert np.allclose([r.fused for r in a], [r.fused for r in b], rtol=0, atol=1e-9)


def test_no_gps_is_visual_only(spark):
    level = tr.trajectory_level(stations(spark, gps=False)).first()
    assert level.fusion_mode == "VISUAL_ONLY" and level.gps_points == 0


def test_keyframe_decisions(spark):
    scores = spark.createDataFrame(
        [(1, 1, 0, "HIGH", 1.0, 500, 90), (1, 2, 1, "LOW", 1.0, 500, 20), (1, 3, 2, "HIGH", 1.0, 500, 85), (1, 4, 3, "HIGH", 1.0, 500, 85)],
        "mission_id long, frame_id long, frame_index long, classification string, redundancy double, feature_count long, overall_quality int")
    flow = spark.createDataFrame([(1, 1, 3, 5.0, 0.01, 100), (1, 1, 4, 40.0, 0.01, 100)], "mission_id long, ref_frame long, cur_frame long, median_displacement double, angle_variance double, tracked long")
    for chunk in (1, 1000):
        got = kf.select_keyframes(scores, flow, chunk_rows=chunk).orderBy("frame_index").collect()
        assert [(r.frame_id, r.selection_reason) for r in got] == [(1, "FIRST_FRAME"), (4, "SUFFICIENT_PARALLAX")]


def image(spark, frames):
    rows = [(k, x, y, int(np.clip(f(x, y), 0, 255))) for k, f in frames.items() for y in range(24) for x in range(24)]
    px = spark.createDataFrame(rows, "frame_id long, x int, y int, gray int")
    return px.withColumns({c: F.col("gray") for c in "bgr"})


def test_frame_quality(spark):
    px = image(spark, {1: lambda x, y: 255 * ((x // 3 + y // 3) % 2), 2: lambda x, y: 120 + x / 8, 3: lambda x, y: 255, 4: lambda x, y: 0, 5: lambda x, y: 255 * ((x // 3 + y // 3) % 2)})
    order = spark.createDataFrame([(1, k, k) for k in range(1, 6)], "mission_id long, frame_id long, frame_index long")
    metrics = ql.pixel_metrics(px).join(ql.redundancy(px, order).select("frame_id", "mse_prev"), "frame_id").withColumn("feature_count", F.when(F.col("frame_id").isin(1, 5), 900).otherwise(0))
    got = {r.frame_id: r for r in ql.quality_scores(metrics).collect()}
    assert got[1].sharpness > 0.5 and got[2].sharpness < 0.2 and got[2].classification == "LOW"
    assert got[1].mse_prev is None and got[1].redundancy == 1.0 and got[5].redundancy > 0.5
    gray = np.array([[255 * ((x // 3 + y // 3) % 2) for x in range(24)] for y in range(24)], dtype=float)
    p = np.pad(gray, 1, mode="reflect")
    lap = p[1:-1, :-2] + p[1:-1, 2:] + p[:-2, 1:-1] + p[2:, 1:-1] - 4 * gray
    assert math.isclose(got[1].laplacian_var, lap.var(), rel_tol=1e-9)


def test_illumination(spark):
    px = image(spark, {1: lambda x, y: 255 if x < 6 else 180, 2: lambda x, y: 5 if x < 10 else 90, 3: lambda x, y: 255})
    got = {r.frame_id: r for r in il.with_status(il.illumination_metrics(px)).collect()}
    assert got[1].overexposure_percent > 15 and got[2].underexposure_percent > 20 and got[2].shadow_score > 30 and got[3].status == "REJECTED"
    raw = il.applied_operations(il.illumination_metrics(px), il.channel_gains(px), "raw").first()
    assert raw.normalization_applied == ["raw_passthrough"]


def test_detections(spark):
    d = spark.createDataFrame([(1, "person", 0.85, 0.0, 0.0, 3.0, 3.0), (1, "laptop", 0.9, 0.0, 0.0, 9.0, 9.0), (1, "person", 0.2, 0.0, 0.0, 9.0, 9.0)], "frame_id long, object_class string, confidence double, x1 double, y1 double, x2 double, y2 double")
    kept = ob.relevant(d, ob.target_classes(spark))
    assert [(r.object_class, r.confidence) for r in kept.collect()] == [("person", 0.85)]
    cells = ob.mask_cells(kept, 10, 10)
    assert cells.count() == 16
    px = spark.range(100).selectExpr("1L AS frame_id", "CAST(id % 10 AS INT) AS x", "CAST(id DIV 10 AS INT) AS y", "7 AS gray")
    bands = ob.mask_bands(kept, 10, 10)
    both = ob.with_static_values(px, bands)
    assert both.where("dynamic").count() == cells.count()
    assert both.where("dynamic").count() + ob.static_rows(px, bands).count() == 100


def test_sampling_fallback_and_rules(spark):
    frames = spark.createDataFrame([(1, i, i) for i in range(180)], "mission_id long, frame_id long, frame_index long").withColumn("fps", F.lit(30.0))
    kept = fr.fixed_interval(frames, 1.0)
    assert kept.count() == 6
    assert [r.frame_index for r in fr.at_least_two(frames.where("frame_index = 50"), frames).orderBy("frame_index").collect()] == [0, 50, 179]
    assert fr.with_names(frames.where("frame_index = 7")).first().frame_name == "frame_000007"


def test_depth_gate(spark):
    rows = [(1, x, y, 10.0 if x < 20 else (10.0 if x < 40 else 0.0), 0.85 if x < 20 else (0.20 if x < 40 else 0.90)) for x in range(60) for y in range(10)]
    depth = spark.createDataFrame(rows, "frame_id long, x int, y int, depth double, conf double")
    view = spark.createDataFrame([(1, EYE, [0.0] * 3, 50.0, 50.0, 30.0, 5.0)], "frame_id long, R array<double>, t array<double>, fx double, fy double, px double, py double")
    assert dn.back_project(depth, view, 0.5, 1).count() == 200


def flat_mesh(spark, faces, xyz):
    v = spark.createDataFrame([(1, i, float(p[0]), float(p[1]), float(p[2]), 0.9) for i, p in enumerate(xyz)], "mesh_id long, v long, x double, y double, z double, conf double")
    f = spark.createDataFrame([(1, i, *map(int, t)) for i, t in enumerate(faces)], "mesh_id long, f long, v0 long, v1 long, v2 long")
    return v, f


def test_component_pruning(spark):
    xyz = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0), (50, 50, 0), (51, 50, 0), (50, 51, 0)]
    v, f = flat_mesh(spark, [(0, 1, 2), (1, 3, 2), (1, 4, 3), (4, 5, 3), (6, 7, 8)], xyz)
    kept = ms.prune_components(f, 3)
    nv, nf = ms.compact(v, kept)
    assert nf.count() == 4 and sorted(r.v for r in nv.collect()) == list(range(6))


def test_no_face_across_void(spark):
    rng = np.random.default_rng(42)
    left, right = rng.uniform(-10, -5, (100, 2)), rng.uniform(15, 20, (100, 2))
    xy = np.concatenate([left, np.column_stack([right[:, 0], left[:, 1]])])
    df = spark.createDataFrame([(0, i, float(x), float(y), 0.0, 0.9) for i, (x, y) in enumerate(xy)], "cloud_id long, point_id long, x double, y double, z double, conf double")
    v, f = ms.grid_surface(df, 1.0)
    up = v.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    faces = ms.face_geometry(ms.admit_faces(f, up, 4.0), v)
    assert faces.count() > 0 and faces.agg(F.max(F.greatest("e0", "e1", "e2"))).first()[0] < 4.0


def grid(spark, n=10):
    faces = [t for y in range(n - 1) for x in range(n - 1) for i in [y * n + x] for t in ((i, i + 1, i + n), (i + 1, i + n + 1, i + n))]
    return flat_mesh(spark, faces, [(x, y, 0) for y in range(n) for x in range(n)])


def test_density_settings_and_normals(spark):
    v, f = grid(spark)
    assert ms.reduce_density(v, f, "high")[1].count() == 162
    nv, nf = ms.reduce_density(v, f, "low")
    assert 0 < nf.count() < 162 and nv.where("conf IS NULL").count() == 0
    assert ms.vertex_normals(v, f).where("abs(nz - 1) < 1e-9").count() == 100
    flat = ms.smooth(v.withColumn("z", F.when(F.col("v") == 55, 1.0).otherwise(0.0)), f, 1).where("v = 55").first()
    assert math.isclose(flat.z, 0.7)


def test_every_cloud_has_cameras(spark, tmp_path):
    """A steep plane in the second cloud: its camera stands on the side that the fallback, up, does not choose."""
    from skyfold.plans.catalog import QUERIES

    orders = [(50_000 + i, 200 + 7 * i % 10, 50_000 * (12.5 - 1.25 * (7 * i % 10))) for i in range(22)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, 0.0), (330, 0.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = QUERIES["oriented_normals"](spark, str(tmp_path)).collect()
    assert len(rows) == 22 and all(math.isclose(r.nx, -10 / math.sqrt(101), abs_tol=1e-3) for r in rows)


CAM = "mesh_id long, camera_id long, R array<double>, t array<double>, cx double, cy double, cz double, fx double, fy double, px double, py double, w int, h int, quality double, sharpness double, exposure double"
DOWN = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]


def camera(i, x, y, z, f=200.0, w=320, h=240, quality=0.9, sharpness=80.0, exposure=0.9, rot=DOWN):
    t = (-np.reshape(rot, (3, 3)) @ np.array([x, y, z])).tolist()
    return (1, i, rot, t, x, y, z, f, f, w / 2, h / 2, w, h, quality, sharpness, exposure)


def test_face_seen_from_above_only(spark):
    v, f = flat_mesh(spark, [(0, 1, 2), (0, 2, 1)], [(0, 0, 0), (2, 0, 0), (1, 2, 0)])
    cams = spark.createDataFrame([camera(0, 1.0, 1.0, 10.0)], CAM)
    ranked = vw.best_views(vw.face_views(vw.face_targets(f, v), cams), f)
    got = {r.f: r.camera_id for r in ranked.collect()}
    assert got == {0: 0, 1: None} and vw.coverage(ranked).first().coverage_pct == 50.0


@pytest.mark.parametrize("tilt", [0.0, 0.5, 1.2, 1.57, 2.0])
def test_view_candidates_lose_nothing(spark, tilt):
    """Tilted, level and inside-the-slab cameras see the same as a test of every pair."""
    rng = np.random.default_rng(2)
    pts = np.column_stack([rng.uniform(0, 100, 400), rng.uniform(0, 60, 400), rng.uniform(0, 15, 400)])
    c, s = math.cos(tilt), math.sin(tilt)
    rot = (np.array([[1, 0, 0], [0, c, -s], [0, s, c]]) @ np.reshape(DOWN, (3, 3))).ravel().tolist()
    cams = [camera(0, 30.0, 30.0, 40.0, rot=rot), camera(1, 60.0, 20.0, 8.0, rot=rot)]
    v = spark.createDataFrame([(1, i, *map(float, p), 0.0, 0.0, 1.0) for i, p in enumerate(pts)], "mesh_id long, v long, x double, y double, z double, nx double, ny double, nz double")
    got = {(r.v, r.camera_id) for r in cf.vertex_views(v, spark.createDataFrame(cams, CAM), 12, -2.0).collect()}
    want = set()
    for cam in cams:
        x = (np.reshape(cam[2], (3, 3)) @ pts.T).T + np.array(cam[3])
        with np.errstate(divide="ignore", invalid="ignore"):
            u, w = 200 * x[:, 0] / x[:, 2] + 160, 200 * x[:, 1] / x[:, 2] + 120
        ok = (x[:, 2] > 0.1) & (u >= 12) & (u < 308) & (w >= 12) & (w < 228)
        want |= {(int(i), cam[1]) for i in np.flatnonzero(ok)}
    assert got == want


def test_mask_bands_equal_painted_pixels(spark):
    rng = np.random.default_rng(8)
    boxes = [(int(f), *map(float, np.sort(rng.uniform(0, 30, 2))), *map(float, np.sort(rng.uniform(0, 20, 2)))) for f in range(6) for _ in range(rng.integers(1, 25))]
    boxes = [(f, x1, y1, x2, y2) for f, x1, x2, y1, y2 in boxes] + [(9, 40.0, 1.0, 50.0, 2.0), (8, 0.0, 0.0, 60.0, 60.0)] * 2
    df = spark.createDataFrame(boxes, "frame_id long, x1 double, y1 double, x2 double, y2 double")
    painted = {(f, x, y) for f, x1, y1, x2, y2 in boxes for x in range(int(x1), min(int(x2), 23) + 1) for y in range(int(y1), min(int(y2), 15) + 1)}
    assert {(r.frame_id, r.x, r.y) for r in ob.mask_cells(df, 24, 16).collect()} == painted
    bands = ob.mask_bands(df, 24, 16)
    area = {r.frame_id: r.dynamic_pixels for r in ob.mask_coverage(bands, 24, 16).collect()}
    assert area == {f: sum(p[0] == f for p in painted) for f in {p[0] for p in painted}}
    assert all(a.xb + 1 < b.xa for r in bands.collect() for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize(("across", "pairs_each"), [(2, 0), (4, 1), (16, 8)])
def test_least_distance_equals_all_pairs(spark, across, pairs_each):
    rng = np.random.default_rng(5)
    sets = {1: (rng.uniform(-50, 50, (300, 3)), rng.uniform(-60, 60, (20, 3))), 2: (np.full((40, 3), 3.0), rng.uniform(0, 9, (3, 3))),
            3: (np.column_stack([rng.uniform(0, 1e4, 200), np.zeros(200), np.zeros(200)]), np.column_stack([rng.uniform(0, 1e4, 30), np.zeros(30), np.full(30, 7.0)])), 4: (np.zeros((1, 3)), np.zeros((1, 3)))}
    frame = lambda k: spark.createDataFrame([(m, *map(float, p)) for m, pair in sets.items() for p in pair[k]], "mesh_id long, x double, y double, z double")
    got = {r.mesh_id: r.least for r in vw.least_distance(frame(0), frame(1), across, pairs_each).collect()}
    want = {m: np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min() for m, (a, b) in sets.items()}
    assert got.keys() == want.keys() and all(math.isclose(got[m], want[m], abs_tol=1e-9) for m in want)


def test_camera_gate(spark):
    cams = spark.createDataFrame([camera(0, 0.0, 0.0, 9.0), camera(1, 0.0, 0.0, 9.0, sharpness=5.0), camera(2, 0.0, 0.0, 9.0, exposure=0.05)], CAM)
    assert [r.camera_id for r in vw.camera_gate(cams).collect()] == [0]
    assert vw.camera_gate(cams.where("camera_id > 0")).count() == 1


def test_slab_confidence(spark):
    xyz = [(x, y, z) for z in (0.0, 2.0) for y in range(0, 11, 2) for x in range(0, 11, 2)]
    v = spark.createDataFrame([(1, i, float(p[0]), float(p[1]), p[2], 0.0, 0.0, 1.0 if p[2] > 0 else -1.0) for i, p in enumerate(xyz)], "mesh_id long, v long, x double, y double, z double, nx double, ny double, nz double")
    cams = spark.createDataFrame([camera(i, 3.0 + 4 * (i % 2), 3.0 + 4 * (i // 2), 20.0, 450.0, 640, 480) for i in range(4)], CAM)
    evidence = cf.with_view_scores(cf.observation_evidence(v, cf.vertex_views(v, cams))).withColumn("density_score", F.lit(0.8))
    tiered = cf.with_tier(cf.fuse(evidence))
    assert tiered.where("z = 0 AND confidence >= 0.35").count() == 0
    row = cf.tier_statistics(tiered).first()
    assert abs(row.high_pct + row.medium_pct + row.unknown_pct + row.untiered_pct - 100) < 0.5 and row.high_vertices > 0 and row.unknown_vertices > 0


def test_cloud_noise_is_dropped(spark):
    rng = np.random.default_rng(42)
    ground = np.column_stack([rng.uniform(0, 20, (600, 2)), rng.normal(0, 0.05, 600)])
    noise = np.column_stack([rng.uniform(-200, 200, (20, 2)), rng.uniform(50, 90, 20)])
    rows = [(0, i, *map(float, p), 0.8) for i, p in enumerate(np.concatenate([ground, noise]))]
    df = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double, conf double")
    kept = pc.outlier_filter(df)
    assert kept.where("point_id >= 600").count() < 6 and kept.where("point_id < 600").count() > 560
    flat = pc.orient_normals(pc.normals_and_curvature(pc.neighbourhood_moments(df.where("point_id < 600"))))
    assert flat.where("nz > 0.9").count() > 550


def test_reports(spark):
    stages = spark.createDataFrame([(1, "preprocessing", 1, "completed", 1.0, '{"extracted_frames_count": 1250}'), (1, "keyframe_selection", 3, "completed", 1.0, '{"keyframes_selected": 184}'),
                                    (1, "geometry", 7, "failed", 1.0, "broken")], "job_id long, stage_name string, stage_order int, status string, execution_time_seconds double, metrics_json string")
    jobs = spark.createDataFrame([(1, 1, "failed", None, 5)], "job_id long, mission_id long, status string, error_stage string, started_sec long")
    m = rp.live_metrics(stages).first()
    assert (m.frames_extracted, m.keyframes_selected, m.cameras_registered) == (1250, 184, None)
    assert rp.resume_point(jobs, stages).first().resume_stage == "geometry"
    assert not rp.readiness(jobs, stages).first().rapid_model_ready
    truth = spark.createDataFrame([(1, 25.0, 24.982, 0.038)], "mission_id long, scale_target_m double, measured_scale_m double, checkpoints_rmse_m double")
    both = {r.mission_id: r for r in rp.ground_truth(spark.createDataFrame([(1,), (2,)], "mission_id long"), truth, ["mission_id"]).collect()}
    assert both[1].position_text == "0.038m RMSE" and both[2].position_text == "unavailable"
    runs = spark.createDataFrame([(1, 1200, 180)], "mission_id long, raw_frames long, keyframes long")
    assert runs.select(((F.col("raw_frames") - F.col("keyframes")) / F.col("raw_frames") * 100).alias("r")).first().r == 85.0
