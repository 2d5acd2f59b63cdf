"""Queries over parsers, upload checks, sinks and streams, fed with texts, rows and files made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyfold.functions.linalg import rounded
from skyfold.functions.text import epoch_seconds
from skyfold.plans import adapters as ad
from skyfold.plans.registry import query, r6
from skyfold.session import shared_folder
from skyfold.sources import files as fs, sinks, telemetry as ts
from skyfold.streaming import telemetry as st


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/skyfold-{uuid.uuid4().hex}"


@query("subtitle_fixes", "telemetry", f"""SELECT mission_id, fix_id, {r6('(fix_id*1237%86400000)/1000.0e0', 3)} timestamp_sec,
 (286139+fix_id%100)/10000.0e0 latitude, -(772090+fix_id%37)/10000.0e0 longitude, CASE WHEN fix_id%3=0 THEN 0.0e0 ELSE (fix_id%900)/10.0e0 END altitude FROM telemetry""")
def _(spark, sf):
    """A subtitle text for each fix; every third lacks the height, and a second block lacks the longitude."""
    n = F.col("fix_id")
    ms = n * 1237 % 86400000
    part = lambda unit, size: F.floor(ms / unit) % size
    clock = F.format_string("%02d:%02d:%02d,%03d", part(3600000, 24), part(60000, 60), part(1000, 60), ms % 1000)
    height = F.when(n % 3 == 0, F.lit("")).otherwise(F.format_string(" rel_alt: %d.%d m", F.floor(n % 900 / 10), n % 10))
    place = F.format_string("[latitude: 28.%04d] [longitude: -77.%04d]", 6139 + n % 100, 2090 + n % 37)
    text = F.concat(F.lit("1\r\n"), clock, F.lit(" --> 00:00:00,000\r\n"), place, height, F.lit("\r\n\r\n2\r\n00:00:01,000 --> x\r\nlatitude: 1.5\r\n"))
    out = ts.subtitle_fixes(ad.telemetry(spark, sf).select("mission_id", "fix_id", text.alias("value")))
    return out.select("mission_id", "fix_id", rounded(F.col("timestamp_sec"), 3).alias("timestamp_sec"), "latitude", "longitude", "altitude")


@query("flight_log_fixes", "telemetry", """SELECT CASE WHEN fix_id%7=0 THEN 0.0e0 ELSE CAST(fix_id AS DOUBLE) END timestamp_sec, (286139+fix_id%100)/10000.0e0 latitude,
 CAST(mission_id%180 AS DOUBLE) longitude, CASE WHEN fix_id%5=0 THEN 0.0e0 ELSE CAST(fix_id%300 AS DOUBLE) END altitude, CASE WHEN fix_id%4=0 THEN 'STANDALONE_GPS' ELSE fix_type END fix_type
 FROM telemetry WHERE fix_id%11<>0""")
def _(spark, sf):
    """Log rows with blank times, heights and kinds, which have defaults, and unreadable latitudes, whose rows go."""
    n = F.col("fix_id")
    blank = lambda c, every: F.when(n % every == 0, F.lit(" ")).otherwise(c.cast("string"))
    log = ad.telemetry(spark, sf).select(
        blank(n, 7).alias("Time"), F.when(n % 11 == 0, F.lit("n/a")).otherwise(F.format_string("28.%04d", 6139 + n % 100)).alias("Lat"),
        (F.col("mission_id") % 180).cast("string").alias("lon"), blank(n % 300, 5).alias("height"), blank(F.lower("fix_type"), 4).alias("rtk_status"),
    )
    return ts.log_fixes(log).drop("source")


@query("text_positions", "telemetry", "SELECT fix_id, (286139+fix_id%100)/10000.0e0 latitude, CAST(mission_id%180 AS DOUBLE) longitude FROM telemetry WHERE fix_id%6<>0 AND fix_id%5<>0")
def _(spark, sf):
    """Lines with a number that is no latitude before the position; some name no position and some give half of one."""
    n = F.col("fix_id")
    label = F.when(n % 6 == 0, "note").otherwise("GPS")
    place = F.format_string("28.%04d", 6139 + n % 100)
    second = F.when(n % 5 == 0, F.lit("?")).otherwise((F.col("mission_id") % 180).cast("string"))
    lines = ad.telemetry(spark, sf).select("fix_id", F.concat(label, F.lit(": 999 "), place, F.lit(", "), second).alias("value"))
    return ts.scan_positions(lines).select("fix_id", "latitude", "longitude")


@query("upload_verdicts", "", """WITH u AS (SELECT doc_id, coalesce(octet_length(encode(text)),0) n, doc_id%6 e, doc_id%4 h FROM documents)
 SELECT doc_id, CASE WHEN e=5 THEN 'EXTENSION_NOT_ALLOWED' WHEN n>4000 THEN 'TOO_LARGE' WHEN e=4 THEN NULL WHEN (e<=1 AND h=0) OR (e=2 AND h=1) OR (e=3 AND h=2) THEN NULL ELSE 'BAD_CONTAINER' END reason FROM u""")
def _(spark, sf):
    """Each document as an upload of its own size whose ending and first bytes follow its number; 4,000 bytes at most."""
    k = F.col("doc_id")
    ending = F.element_at(F.array(*map(F.lit, ["mp4", "MOV", "avi", "mkv", "srt", "exe"])), (k % 6 + 1).cast("int"))
    # an ISO box, a RIFF form, a Matroska element, and the ISO type half a byte late
    heads = ["00000018667479706D703432", "52494646AABBCCDD41564920", "1A45DFA30000000000000000", "0000001606747970D0000000"]
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (k % 4 + 1).cast("int")))
    files = ad.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/in/"), k.cast("string"), F.lit("."), ending).alias("path"),
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("length"), head.alias("header"),
    )
    return fs.upload_audit(files, max_bytes=4000).select("doc_id", "reason")


@query("replaced_groups", "telemetry", "SELECT fix_id, fix_type, CASE WHEN fix_type='RTK_FLOAT' THEN -mission_id ELSE mission_id END mission_id FROM telemetry")
def _(spark, sf):
    """Fixes written by kind, then one kind written anew; the other groups stay."""
    path = new_folder(spark)
    fixes = ad.telemetry(spark, sf).select("fix_id", "mission_id", "fix_type")
    sinks.replace_groups(fixes, path, "fix_type")
    sinks.replace_groups(fixes.where("fix_type = 'RTK_FLOAT'").withColumn("mission_id", -F.col("mission_id")), path, "fix_type")
    return spark.read.parquet(path).select("fix_id", "fix_type", "mission_id")


@query("appended_artifacts", "artifacts", "SELECT job_id, artifact_type, file_size_bytes FROM artifacts")
def _(spark, sf):
    """Artifacts added in two writes."""
    path = new_folder(spark)
    rows = ad.artifacts(spark, sf).select("job_id", "artifact_type", "file_size_bytes")
    for kinds in (F.col("artifact_type") == "mesh", F.col("artifact_type") != "mesh"):
        sinks.append_artifacts(rows.where(kinds), path)
    return spark.read.parquet(path)


def _file_each(rows: DataFrame, part: str, text: str) -> str:
    """One text file for each row, in a folder named by its part; returns the path."""
    path = new_folder(rows.sparkSession)
    rows.select(F.col(part).alias("part"), F.col(text).alias("value")).write.partitionBy("part").text(path)
    return path


#: Fixes or frames of a written file.
FILE_ROWS = 1000


def _parts(spark, sf):
    n = F.col("fix_id")
    return ad.telemetry(spark, sf).withColumn("part", F.floor(n / FILE_ROWS)).withColumn("deg", (286139 + n % 100) / 10000.0)


@query("json_fixes", "telemetry", "SELECT CAST(fix_id AS DOUBLE) timestamp_sec, (286139+fix_id%100)/10000.0e0 latitude, CAST(mission_id%180 AS DOUBLE) longitude, CASE WHEN fix_id%5<>0 THEN fix_id%300/2.0e0 END altitude, fix_type FROM telemetry")
def _(spark, sf):
    """Files of JSON arrays, a thousand fixes each; every fifth fix lacks its height."""
    fix = F.struct(F.col("fix_id").alias("timestamp_sec"), F.col("deg").alias("latitude"), (F.col("mission_id") % 180).alias("longitude"),
                   F.when(F.col("fix_id") % 5 != 0, F.col("fix_id") % 300 / 2.0).alias("altitude"), "fix_type")
    text = _parts(spark, sf).groupBy("part").agg(F.to_json(F.collect_list(fix)).alias("text"))
    return ts.read_json_fixes(spark, _file_each(text, "part", "text")).drop("source", "part")


@query("gpx_fixes", "telemetry", "SELECT 1700000000e0+fix_id timestamp_sec, (286139+fix_id%100)/10000.0e0 latitude, CAST(mission_id%180 AS DOUBLE) longitude, CASE WHEN fix_id%5<>0 THEN fix_id%300/2.0e0 ELSE 0e0 END altitude FROM telemetry")
def _(spark, sf):
    """Tracks whose times are written in UTC, two hours ahead, or without a zone; every fifth point lacks its height."""
    n = F.col("fix_id")
    ahead = F.when(n % 3 == 0, 7200).otherwise(0)
    clock = F.date_format(F.timestamp_seconds(1700000000 + n + ahead), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(n % 3 == 0, "+02:00").when(n % 3 == 1, "Z").otherwise("")
    height = F.when(n % 5 == 0, F.lit("")).otherwise(F.format_string("<ele>%.1f</ele>", n % 300 / 2.0))
    point = F.concat(F.format_string('<trkpt lat="%.4f" lon="%d">', F.col("deg"), F.col("mission_id") % 180), height, F.lit("<time>"), clock, zone, F.lit("</time></trkpt>"))
    text = _parts(spark, sf).groupBy("part").agg(F.concat(F.lit("<gpx><trk><trkseg>"), F.array_join(F.collect_list(point), "\n"), F.lit("</trkseg></trk></gpx>")).alias("text"))
    return ts.read_gpx(spark, _file_each(text, "part", "text")).select("timestamp_sec", "latitude", "longitude", "altitude")


@query("manifest_frames", "frames", """SELECT 'video_'||(frame_id//1000) video_name, CAST(24+(frame_id//1000)%7 AS DOUBLE) fps, 'frame_'||frame_id frame_id, frame_index, frame_index/8.0e0 timestamp_sec,
 'img/'||frame_id||'.jpg' file, 1920 width, CASE WHEN frame_id%4<>0 THEN 1080 END height FROM frames""")
def _(spark, sf):
    """Manifests of a thousand frames each; the image is named under one of three keys, and some heights are left out."""
    k = F.col("frame_id")
    name = F.concat(F.lit("img/"), k.cast("string"), F.lit(".jpg"))
    entry = F.struct(
        F.concat(F.lit("frame_"), k.cast("string")).alias("frame_id"), "frame_index", (F.col("frame_index") / 8.0).alias("timestamp_sec"),
        *[F.when(k % 3 == i, name).alias(key) for i, key in enumerate(("file", "filepath", "filename"))],
        F.lit(1920).alias("width"), F.when(k % 4 != 0, F.lit(1080)).alias("height"),
    )
    rows = ad.frames(spark, sf).withColumn("part", F.floor(k / FILE_ROWS)).groupBy("part").agg(F.collect_list(entry).alias("frames"))
    doc = F.to_json(F.struct(F.concat(F.lit("video_"), F.col("part").cast("string")).alias("video_name"), (24 + F.col("part") % 7).cast("double").alias("fps"), "frames"))
    return fs.read_manifest(spark, _file_each(rows.withColumn("text", doc), "part", "text")).drop("file_size_bytes")


@query("report_detections", "detections", f"SELECT 'frame_'||frame_id frame_id, object_class, {r6('confidence')} confidence, {r6('x1')} x1, {r6('y2')} y2 FROM detections")
def _(spark, sf):
    """Detection reports, one for each thousand frames."""
    box = F.array("x1", "y1", "x2", "y2")
    entry = F.struct(F.concat(F.lit("frame_"), F.col("frame_id").cast("string")).alias("frame_id"), "object_class", "confidence", box.alias("bounding_box"))
    rows = ad.detections(spark, sf).withColumn("part", F.floor(F.col("frame_id") / FILE_ROWS)).groupBy("part").agg(F.collect_list(entry).alias("dynamic_objects"))
    path = _file_each(rows.withColumn("text", F.to_json(F.struct("dynamic_objects", F.lit("x").alias("more")))), "part", "text")
    at = lambda i, name: rounded(F.col("bounding_box")[i]).alias(name)
    return fs.read_report(spark, path, "detections").select("frame_id", "object_class", rounded(F.col("confidence")).alias("confidence"), at(0, "x1"), at(3, "y2"))


@query("control_artifacts", "artifacts", "SELECT job_id, artifact_type, stage_name, CAST(stage_order AS INTEGER) stage_order, file_path, file_size_bytes FROM artifacts")
def _(spark, sf):
    """The artifact table at rest, its columns in another order and one more."""
    path = new_folder(spark)
    rows = ad.artifacts(spark, sf).withColumn("stage_order", F.col("stage_order").cast("int")).withColumn("more", F.lit(1))
    rows.select(*reversed(rows.columns)).write.parquet(path)
    return fs.read_control(spark, path, "artifacts")


@query("text_clouds", "points", f"""SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id)-1 v, {r6('x')} x, {r6('y')} y, {r6('z+1e-7::DOUBLE', 4)} z, CASE WHEN cloud_id%3=2 THEN 200 ELSE r END r, CASE WHEN cloud_id%3=0 THEN {r6('conf')} ELSE 1e0 END conf
 FROM points""")
def _(spark, sf):
    """A text file for each cloud; three kinds of header differ in the columns' names, order and number."""
    kind, num = F.col("cloud_id") % 3, lambda c: F.format_string("%.9f", c)
    rgb = F.concat_ws(" ", "r", "g", "b")
    xyz = [num(F.col("x")), num(F.col("y")), num(F.col("z"))]
    line = F.when(kind == 0, F.concat_ws(" ", *xyz, rgb, num(F.col("conf")))).when(kind == 1, F.concat_ws(" ", rgb, *xyz)).otherwise(F.concat_ws(" ", xyz[2], xyz[1], xyz[0]))
    names = F.when(kind == 0, F.lit("x y z red green blue quality")).when(kind == 1, F.lit("r g b x y z")).otherwise(F.lit("z y x"))
    head = F.array_join(F.transform(F.split(names, " "), lambda n: F.concat(F.lit("property float "), n)), "\n")
    rows = ad.points(spark, sf).groupBy("cloud_id").agg(F.sort_array(F.collect_list(F.struct("point_id", line.alias("line")))).alias("_l"))
    text = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("_l").cast("string"), F.lit("\n"), head, F.lit("\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"), F.array_join("_l.line", "\n"), F.lit("\n3 0 1 2"))
    vertices, _ = fs.read_text_clouds(spark, _file_each(rows.withColumn("text", text), "cloud_id", "text"))
    cloud = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return vertices.select(cloud.alias("cloud_id"), "v", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"), rounded(F.col("z") + 1e-7, 4).alias("z"), "r", rounded(F.col("conf")).alias("conf"))


@query("stage_output", "job_stages", """SELECT job_id, stage_name, CASE WHEN job_id%3=0 THEN 'again' ELSE status END status, CASE WHEN job_id%3=0 THEN 2 ELSE 1 END run FROM job_stages""")
def _(spark, sf):
    """Stages of thirty batches of jobs, written by one run, a third of them by a second, all by one that ended before its marker."""
    path = new_folder(spark)
    by = F.col("batch")
    jobs = ad.job_stages(spark, sf).select((F.col("job_id") % 30).alias("batch"), "job_id", "stage_name", "status")
    note = lambda n, some: some.select("batch").distinct().withColumn("nth", F.lit(n))
    sinks.write_stage(jobs, note(1, jobs), path, "batch")
    again = jobs.where(by % 3 == 0).withColumn("status", F.lit("again"))
    sinks.write_stage(again, note(2, again), path, "batch")
    jobs.withColumn("status", F.lit("lost")).write.partitionBy("batch").parquet(f"{path}/data/run=lost")
    data, metrics = sinks.read_stage(spark, path, "batch")
    return data.join(metrics, "batch").select("job_id", "stage_name", "status", F.col("nth").cast("int").alias("run"))


def streamed(spark: SparkSession, out: DataFrame) -> DataFrame:
    """Runs a stream over all that its source holds now and reads what it wrote."""
    path = new_folder(spark)
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query("distinct_fix_stream", "", "SELECT user_id mission_id, event_id fix_id FROM events")
def _(spark, sf):
    """The event table as a stream that sends each fix twice."""
    events = spark.readStream.schema(ad.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")  # a pattern, as a stream reads no single file by name
    time = F.timestamp_micros(F.round(epoch_seconds(F.col("ts")) * 1e6).cast("long"))
    twice = events.select(F.col("user_id").alias("mission_id"), F.col("event_id").alias("fix_id"), time.alias("fix_time"), F.explode(F.array(F.lit(1), F.lit(2))).alias("sent"))
    return streamed(spark, st.distinct_fixes(twice)).select("mission_id", "fix_id")
