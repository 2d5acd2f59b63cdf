"""Telemetry, report, cloud and upload files."""

import json

import pytest
from pyspark.sql import functions as F

from skyfold.sources import files as fs, sinks, telemetry as ts


def test_subtitles(spark, tmp_path):
    text = ("1\r\n00:00:01,500 --> 00:00:02,000\r\nlatitude: 28.5 longitude: 77.25 rel_alt: 12.5\r\n\r\n"
            "2\r\n00:01:00.250 --> x\r\nlatitude: 1.0\r\n\r\n3\r\n01:00:00,000 --> x\r\n<b>LATITUDE = -3.5</b> [Longitude: 4]\r\n")
    (tmp_path / "a.srt").write_bytes(text.encode())
    rows = ts.read_subtitles(spark, str(tmp_path / "a.srt")).orderBy("block_no").collect()
    assert [(r.timestamp_sec, r.latitude, r.longitude, r.altitude) for r in rows] == [(1.5, 28.5, 77.25, 12.5), (3600.0, -3.5, 4.0, 0.0)]


def test_clock_and_labelled_numbers(spark):
    from skyfold.functions.text import clock_seconds, labelled_number

    clocks = [("at 00:00:01,500 --> 00:00:09,000", 1.5), ("100:00:02.25", 360002.25), ("1:2:3", 3723.0), ("12:30", 0.0), ("", 0.0), (None, 0.0)]
    rows = spark.createDataFrame(clocks, "value string, want double").select("want", clock_seconds(F.col("value")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)
    numbers = [("ALT = .5", 0.5), ("salt: 4", None), ("salt: 4 alt: -3.m", -3.0), ("abs_alt:1e3", 1000.0), ("height: 2", 2.0), ("alt: x", None), (None, None)]
    rows = spark.createDataFrame(numbers, "value string, want double").select("want", labelled_number(F.col("value"), "height|alt").alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_replaced_groups_split_by_rows(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 900 THEN 'hot' WHEN id < 990 THEN 'warm' ELSE NULL END AS kind")
    sinks.replace_groups(rows, str(tmp_path / "g"), "kind", rows_per_file=100)
    assert len(list((tmp_path / "g" / "kind=hot").glob("*.parquet"))) >= 9
    sinks.replace_groups(rows.where("kind = 'warm'").limit(5), str(tmp_path / "g"), "kind")
    counts = {r.kind: r["count"] for r in spark.read.parquet(str(tmp_path / "g")).groupBy("kind").count().collect()}
    assert counts == {"hot": 900, "warm": 5, None: 10}


def test_flight_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time, Lat ,lon,height,rtk_status\n1.0,28.0,77.0,5,fix\n2.0,,77.0,5,fix\n3.0,bad,77.0,5,fix\nx,28.0,77.0,5,fix\n,29.0,77.0,,\n")
    rows = ts.read_log(spark, str(tmp_path / "a.csv")).orderBy("latitude").collect()
    assert [(r.timestamp_sec, r.latitude, r.altitude, r.fix_type) for r in rows] == [(1.0, 28.0, 5.0, "FIX"), (0.0, 29.0, 0.0, "STANDALONE_GPS")]


def test_json_gpx_and_text(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"timestamp_sec": 1.0, "latitude": 2.0, "longitude": 3.0}]))
    assert ts.read_json_fixes(spark, str(tmp_path / "a.json")).first().longitude == 3.0
    (tmp_path / "a.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>9</ele><time>1970-01-01T00:00:10Z</time></trkpt></trkseg></trk></gpx>')
    row = ts.read_gpx(spark, str(tmp_path / "a.gpx")).first()
    assert (row.timestamp_sec, row.latitude, row.longitude, row.altitude) == (10.0, 1.5, 2.5, 9.0)
    for text in ("1970-01-01T02:00:10+02:00", "1970-01-01T00:00:10"):
        (tmp_path / "b.gpx").write_text(f'<gpx><trk><trkseg><trkpt lat="1" lon="2"><time>{text}</time></trkpt></trkseg></trk></gpx>')
        assert ts.read_gpx(spark, str(tmp_path / "b.gpx")).first().timestamp_sec == 10.0
    lines = spark.createDataFrame([("GPS: 999 28.61, 77.2",), ("nothing 1 2",), ("lat only 12",)], "value string")
    assert [(r.latitude, r.longitude) for r in ts.scan_positions(lines).collect()] == [(28.61, 77.2)]


def test_manifest_and_reports(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"video_name": "v", "fps": 30.0, "frames": [{"frame_id": "frame_000000", "frame_index": 0, "filename": "a.jpg"}]}))
    assert fs.read_manifest(spark, str(tmp_path / "m.json")).first().file == "a.jpg"
    (tmp_path / "d.json").write_text(json.dumps({"dynamic_objects": [{"frame_id": "f", "object_class": "car", "confidence": 0.5, "bounding_box": [1, 2, 3, 4]}]}))
    assert fs.read_report(spark, str(tmp_path / "d.json"), "detections").first().bounding_box == [1.0, 2.0, 3.0, 4.0]
    (tmp_path / "p.json").write_text(json.dumps([{"keyframe_id": 1, "R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "t": [0, 0, 0]}]))
    assert fs.flat_poses(fs.read_report(spark, str(tmp_path / "p.json"), "poses")).first().R == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_text_cloud(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty float quality\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0 0.5\n1 0 0 0.25\n0 1 0 1\n3 0 1 2\n")
    v, f = fs.read_text_cloud(spark, str(tmp_path / "a.ply"))
    assert [(r.v, r.x, r.r, r.conf) for r in v.orderBy("v").collect()] == [(0, 0.0, 200, 0.5), (1, 1.0, 200, 0.25), (2, 0.0, 200, 1.0)]
    assert [tuple(r) for r in f.collect()] == [(0, 0, 1, 2)]


def test_clouds_of_a_folder_follow_their_own_headers(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement vertex {}\n{}element face {}\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format(2, "property float x\nproperty float y\nproperty float z\n", 1) + "1 2 3\n4 5 6\n3 0 1 1\n")
    (tmp_path / "b.ply").write_text(head.format(1, "property uchar red\nproperty float z\nproperty float y\nproperty float x\n", 0) + "7 3 2 1\n")
    (tmp_path / "c.ply").write_text(head.format(0, "", 0))
    (tmp_path / "d.ply").write_text("no header\n1 2 3\n")
    v, f = fs.read_text_clouds(spark, str(tmp_path))
    assert sorted((r.file[-5], r.v, r.x, r.y, r.z, r.r) for r in v.collect()) == [("a", 0, 1.0, 2.0, 3.0, 200), ("a", 1, 4.0, 5.0, 6.0, 200), ("b", 0, 1.0, 2.0, 3.0, 7)]
    assert [(r.file[-5], r.f, r.v0, r.v1, r.v2) for r in f.collect()] == [("a", 0, 0, 1, 1)]


def test_a_run_that_ended_early_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    rows = lambda v: spark.createDataFrame([(1, v), (2, v)], "job_id long, v string")
    sinks.write_stage(rows("first"), rows("m1"), path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "commit_stage", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.write_stage(rows("second"), rows("m2"), path)
    data, metrics = sinks.read_stage(spark, path)
    assert {(r.job_id, r.v) for r in data.collect()} == {(1, "first"), (2, "first")} and {r.v for r in metrics.collect()} == {"m1"}
    sinks.write_stage(rows("third").where("job_id = 2"), rows("m3").where("job_id = 2"), path)
    data, metrics = sinks.read_stage(spark, path)
    assert {(r.job_id, r.v) for r in data.collect()} == {(1, "first"), (2, "third")} and {r.v for r in metrics.collect()} == {"m1", "m3"}


def test_upload_audit(spark, tmp_path):
    files = {"a.mp4": b"\0\0\0\x18ftypisom", "b.mp4": b"MZ\x90\0\x03\0\0\0\x04", "c.avi": b"RIFF\0\0\0\0AVI LIST", "d.mkv": b"\x1a\x45\xdf\xa3\0\0\0\0", "e.exe": b"MZ" * 8,
             "f.mp4": bytes.fromhex("1667479701000000000000000000"), "g.mov": b"\0\0\0\x08wide\0\0", "h.avi": b"RIFF\0\0\0\0WAVE"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in fs.upload_audit(fs.read_upload_inventory(spark, str(tmp_path))).collect()}
    assert got == {"a.mp4": None, "b.mp4": "BAD_CONTAINER", "c.avi": None, "d.mkv": None, "e.exe": "EXTENSION_NOT_ALLOWED",
                   "f.mp4": "BAD_CONTAINER", "g.mov": None, "h.avi": "BAD_CONTAINER"}


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = fs._numbered(spark, str(tmp_path / "big.txt"))
        assert lines.rdd.getNumPartitions() > 1
        assert [(r.line, r.value) for r in lines.orderBy("line").collect()] == [(i, f"line {i}") for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cut_lineage_needs_a_shared_folder(spark, monkeypatch):
    from skyfold import session

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(ValueError):
        session.shared_folder(spark)


def test_sinks_and_control(spark, tmp_path):
    path = str(tmp_path / "frames")
    sinks.replace_groups(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "mission_id long, frame_id long"), path)
    sinks.replace_groups(spark.createDataFrame([(1, 9)], "mission_id long, frame_id long"), path)
    assert sorted(r.frame_id for r in spark.read.parquet(path).collect()) == [3, 9]
    stage = str(tmp_path / "stage")
    sinks.write_stage(spark.createDataFrame([(1, 2.0)], "job_id long, v double"), spark.createDataFrame([(1, 5)], "job_id long, n int"), stage)
    assert spark.read.json(f"{stage}/metrics").first().n == 5
    jobs = spark.createDataFrame([(1, 1, "running", None, 5)], "job_id long, mission_id long, status string, error_stage string, started_sec long")
    sinks.append_artifacts(jobs, str(tmp_path / "jobs"))
    sinks.append_artifacts(jobs, str(tmp_path / "jobs"))
    assert fs.read_control(spark, str(tmp_path / "jobs"), "jobs").count() == 2
    with pytest.raises(ValueError):
        fs.read_control(spark, path, "jobs")
