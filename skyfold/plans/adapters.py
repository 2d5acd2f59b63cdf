"""Survey tables derived from the given star-schema and event tables.

The test data holds no imagery, so each survey table is a fixed projection of a
given table and grows with it. ``CTE`` holds the same definitions as SQL text
for the cross-checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyfold.functions.text import epoch_seconds
from skyfold.operators.ordered import running_index

# Mission states by market segment, stages by line number.
SEGMENT_STATUS = {"BUILDING": "completed", "AUTOMOBILE": "processing", "MACHINERY": "failed",
                  "HOUSEHOLD": "ready", "FURNITURE": "draft"}
LINE_STAGE = {1: (1, "preprocessing"), 2: (3, "keyframe_selection"), 3: (4, "dynamic_masking"),
              4: (7, "geometry"), 5: (8, "dense_point_cloud"), 6: (9, "mesh_generation"),
              7: (12, "confidence_estimation")}
LINE_METRIC = {1: "extracted_frames_count", 2: "keyframes_selected", 3: "total_detections",
               4: "successful_image_registrations", 5: "number_of_dense_points", 6: "mesh_triangles",
               7: "high_confidence_percentage"}
SUPPLIER_CLASS = ["person", "car", "dog", "truck", "laptop"]

MESH_ROWS = 5000
CLOUD_ROWS = 50000
CAMERAS_PER_MESH = 33


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lookup(column, mapping: dict, default=None):
    out = F
    for k, v in mapping.items():
        out = out.when(column == k, v)
    return out.otherwise(default) if default is not None else out


def _case(column: str, mapping: dict, default: str | None = None) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {column} {arms}{f' ELSE {q(default)}' if default else ''} END"


def missions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("mission_id"), F.col("c_name").alias("name"),
        _lookup(F.col("c_mktsegment"), SEGMENT_STATUS).alias("status"),
        (40.0 + F.col("c_nationkey")).alias("flight_altitude_m"),
        F.lit(13.2).alias("sensor_width_mm"), F.lit(8.8).alias("focal_length_mm"),
        (1.0 + 0.2 * (k % 10)).alias("target_gsd_cm"),
        F.lit(1920).alias("image_w"),
        ((k * 1000003) % 2000000000).alias("video_size_bytes"),
        (24.0 + F.col("c_nationkey") % 7).alias("fps"),
        (1280 + 320 * (k % 5)).cast("int").alias("video_w"),
        (720 + 180 * (k % 5)).cast("int").alias("video_h"),
        (600 + k % 1200).alias("total_frames"),
        (F.lit(1700000000) + (k * 7919) % 100000).alias("created_sec"),
        F.col("c_acctbal").alias("balance"),
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("mission_id"),
        _lookup(F.col("o_orderstatus"), {"F": "completed", "O": "running", "P": "failed"}).alias("status"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), F.lit("geometry")).alias("error_stage"),
        epoch_seconds(F.col("o_orderdate")).cast("long").alias("started_sec"),
        F.col("o_totalprice").alias("price"),
    )


def job_stages(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line")
    ).agg(F.min("l_returnflag").alias("flag"), F.sum("l_quantity").alias("execution_time_seconds"),
          F.sum(F.col("l_partkey") % 1000).alias("amount"))
    return grouped.select(
        "job_id",
        _lookup(F.col("line"), {k: v[0] for k, v in LINE_STAGE.items()}).alias("stage_order"),
        _lookup(F.col("line"), {k: v[1] for k, v in LINE_STAGE.items()}).alias("stage_name"),
        _lookup(F.col("flag"), {"R": "failed", "A": "pending"}, "completed").alias("status"),
        "execution_time_seconds",
        F.concat(F.lit('{"'), _lookup(F.col("line"), LINE_METRIC), F.lit('": '), F.col("amount").cast("string"), F.lit("}")).alias("metrics_json"),
    )


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["mesh", "cloud", "report", "texture"])), (F.col("l_partkey") % 4 + 1).cast("int"))
    stage = _lookup(F.col("l_linenumber"), {k: v[1] for k, v in LINE_STAGE.items()})
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), kind.alias("artifact_type"), stage.alias("stage_name"),
        _lookup(F.col("l_linenumber"), {k: v[0] for k, v in LINE_STAGE.items()}).alias("stage_order"),
        F.concat(F.lit("/store/"), F.col("l_orderkey").cast("string"), F.lit("/"), kind, F.lit("_"),
                 F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"), F.lit(".ply")).alias("file_path"),
        (F.col("l_extendedprice") * 100).cast("long").alias("file_size_bytes"),
    )


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("t", epoch_seconds(F.col("ts")))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf).where(F.col("event_type") != "click").select(
        F.col("user_id").alias("mission_id"), e.alias("fix_id"), "t",
        (28.6139 + (e % 100 - 50) * 1e-4).alias("lat"), (77.2090 + (e % 37) * 1e-4).alias("lon"),
        (215.0 + F.col("value") / 10).alias("alt"),
        _lookup(F.col("event_type"), {"purchase": "RTK_FIXED", "signup": "RTK_FLOAT"}, "STANDALONE_GPS").alias("fix_type"),
    )


def keyframes(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).where(F.col("event_type") == "click").select(
        F.col("user_id").alias("mission_id"), F.col("event_id").alias("keyframe_id"), "t",
        (F.col("value") * 3).cast("long").alias("inliers"), F.col("value").alias("value"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select(
        F.col("user_id").alias("mission_id"), F.col("event_id").alias("frame_id"), "t",
        (F.col("value") * 8).alias("laplacian_var"), (F.col("event_id") % 256).cast("double").alias("mean_luminance"),
        F.col("value").alias("contrast_std"), F.floor(F.col("value") * 20).alias("feature_count"),
        (F.col("value") * 5).alias("grad_p90"), (F.col("value") * 10).alias("mse_prev"),
    )
    day = F.floor(F.col("t") / 86400)
    return running_index(rows, ["mission_id"], ["t", "frame_id"], day, "frame_index")


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.floor(k / CLOUD_ROWS).alias("cloud_id"), k.alias("point_id"),
        ((F.col("o_custkey") % 401) / 8).alias("x"), ((k % 397) / 8).alias("y"),
        (F.col("o_totalprice") / 50000).alias("z"),
        ((k * 7) % 256).cast("int").alias("r"), ((k * 11) % 256).cast("int").alias("g"), ((k * 13) % 256).cast("int").alias("b"),
        (((k * 7) % 101) / 100).alias("conf"),
    )


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.floor(k / MESH_ROWS).alias("mesh_id"), (k % MESH_ROWS).alias("v"),
        (k % 100).cast("double").alias("x"), F.floor((k % MESH_ROWS) / 100).cast("double").alias("y"),
        (F.col("o_totalprice") / 100000).alias("z"),
        (((k * 7) % 101) / 100).alias("conf"),
    )


def faces(spark: SparkSession, sf: str) -> DataFrame:
    """Two triangles per cell of the 100-wide vertex lattice, where the next row exists."""
    k = F.col("o_orderkey")
    ids = table(spark, sf, "orders").select(F.floor(k / MESH_ROWS).alias("mesh_id"), (k % MESH_ROWS).alias("i"))
    upper = ids.select("mesh_id", (F.col("i") - 101).alias("i"))
    cell = ids.where(F.col("i") % 100 < 99).join(upper, ["mesh_id", "i"])
    i = F.col("i")
    return cell.select(
        "mesh_id",
        F.explode(F.array(
            F.struct((2 * i).alias("f"), i.alias("v0"), (i + 1).alias("v1"), (i + 100).alias("v2")),
            F.struct((2 * i + 1).alias("f"), (i + 1).alias("v0"), (i + 101).alias("v1"), (i + 100).alias("v2")),
        )).alias("t"),
    ).select("mesh_id", "t.*")


def cameras(spark: SparkSession, sf: str) -> DataFrame:
    """Downward cameras over each mesh; R is diag(1, -1, -1)."""
    k = F.col("s_suppkey")
    j = k % CAMERAS_PER_MESH
    cx, cy, cz = 5.0 + 9.0 * (j % 11), 8.0 + 16.0 * F.floor(j / 11), 40.0 + F.col("s_acctbal") / 1000
    return table(spark, sf, "supplier").select(
        F.floor(k / CAMERAS_PER_MESH).alias("mesh_id"), k.alias("camera_id"),
        cx.alias("cx"), cy.alias("cy"), cz.alias("cz"),
        F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, -1, 0, 0, 0, -1)]).alias("R"),
        F.array(-cx, cy, cz).alias("t"),
        F.lit(480.0).alias("fx"), F.lit(480.0).alias("fy"), F.lit(320.0).alias("px"), F.lit(240.0).alias("py"),
        F.lit(640).alias("w"), F.lit(480).alias("h"),
        ((k % 10) / 10).alias("quality"),
        (20.0 + F.col("s_acctbal") / 100).alias("sharpness"), ((k % 20) / 20).alias("exposure"),
    )


IMAGE = 32
PIXELS_PER_TASK = 1_000_000


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """A 32x32 grey and colour image per supplier; runs a count while the plan is built.

    The frames are dealt into tasks by the pixels they become, each frame in one. A
    join with the places, unlike an explode, shows the optimizer the size of the
    result, so that it does not take the pixels for a small side.
    """
    k, x, y = F.col("frame_id"), F.col("x"), F.col("y")
    images = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.floor("s_acctbal").alias("a"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-images.count() * IMAGE * IMAGE // PIXELS_PER_TASK))
    places = spark.range(IMAGE * IMAGE).select((F.col("id") % IMAGE).cast("int").alias("x"), F.floor(F.col("id") / IMAGE).cast("int").alias("y"))
    grid = images.repartition(parts, "frame_id").crossJoin(places)
    return grid.select(
        "frame_id", "x", "y",
        F.least(F.lit(255), (37 * k) % 230 + (7 * x + 13 * y + x * y) % (4 + (k % 8) * 36)).cast("int").alias("gray"),
        ((F.abs("a") + 5 * x + 3 * y) % 256).cast("int").alias("b"),
        ((17 * k + 2 * x + 9 * y) % 256).cast("int").alias("g"),
        ((29 * k + 11 * x + y) % 256).cast("int").alias("r"),
    )


def detections(spark: SparkSession, sf: str) -> DataFrame:
    x1 = F.col("l_linenumber") * 7.0 - 4.0
    y1 = (F.col("l_partkey") % 40).cast("double")
    cls = F.element_at(F.array(*map(F.lit, SUPPLIER_CLASS)), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), cls.alias("object_class"),
        (F.col("l_discount") * 10).alias("confidence"),
        x1.alias("x1"), y1.alias("y1"),
        (x1 + F.col("l_quantity") / 5).alias("x2"), (y1 + F.col("l_quantity") / 4).alias("y2"),
    )


def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 8).alias("frame"), F.col("vec_id").alias("kp"), F.col("embedding").alias("vec"),
    )


def flow(spark: SparkSession, sf: str) -> DataFrame:
    """Tracked feature displacements between an order (frame) and the next one of its run."""
    return table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).alias("mission_id"),
        F.floor(F.col("l_orderkey") / 10).alias("ref_frame"), F.col("l_orderkey").alias("cur_frame"),
        (F.col("l_partkey") % 640).cast("double").alias("x0"), (F.col("l_suppkey") % 480).cast("double").alias("y0"),
        ((F.col("l_partkey") % 640) + F.col("l_quantity") - 20).alias("x1"),
        ((F.col("l_suppkey") % 480) + F.col("l_linenumber") * 3.0 - 10).alias("y1"),
    )


def disparity(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("frame_id", "x", "y", (F.col("gray") / 3.0).alias("disparity"), "gray", "r", "g", "b")


_EPOCH = "epoch_us(ts)/1000000.0e0"
_NAMES = "['mesh','cloud','report','texture']"

CTE: dict[str, str] = {
    "missions": f"""SELECT c_custkey mission_id, c_name AS name, {_case('c_mktsegment', SEGMENT_STATUS)} status,
 40e0+c_nationkey flight_altitude_m, 13.2e0 sensor_width_mm, 8.8e0 focal_length_mm, 1e0+0.2e0*(c_custkey%10) target_gsd_cm,
 1920 image_w, (c_custkey*1000003)%2000000000 video_size_bytes, 24e0+c_nationkey%7 fps,
 CAST(1280+320*(c_custkey%5) AS INTEGER) video_w, CAST(720+180*(c_custkey%5) AS INTEGER) video_h,
 600+c_custkey%1200 total_frames, 1700000000+(c_custkey*7919)%100000 created_sec, c_acctbal balance FROM customer""",
    "jobs": """SELECT o_orderkey job_id, o_custkey mission_id,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' END status,
 CASE WHEN o_orderstatus='P' AND o_orderkey%2=0 THEN 'geometry' END error_stage,
 epoch_us(o_orderdate)//1000000 started_sec, o_totalprice price FROM orders""",
    "job_stages": f"""SELECT job_id, {_case('line', {k: v[0] for k, v in LINE_STAGE.items()})} stage_order,
 {_case('line', {k: v[1] for k, v in LINE_STAGE.items()})} stage_name, {_case('flag', {'R': 'failed', 'A': 'pending'}, 'completed')} status,
 execution_time_seconds, '{{"' || {_case('line', LINE_METRIC)} || '": ' || CAST(amount AS VARCHAR) || '}}' metrics_json
 FROM (SELECT l_orderkey job_id, l_linenumber line, min(l_returnflag) flag, sum(l_quantity) execution_time_seconds,
 sum(l_partkey%1000) amount FROM lineitem GROUP BY 1,2)""",
    "artifacts": f"""SELECT l_orderkey job_id, {_NAMES}[l_partkey%4+1] artifact_type,
 {_case('l_linenumber', {k: v[1] for k, v in LINE_STAGE.items()})} stage_name,
 {_case('l_linenumber', {k: v[0] for k, v in LINE_STAGE.items()})} stage_order,
 '/store/'||l_orderkey||'/'||{_NAMES}[l_partkey%4+1]||'_'||l_partkey||'_'||l_suppkey||'.ply' file_path,
 CAST(trunc(l_extendedprice*100) AS BIGINT) file_size_bytes FROM lineitem""",
    "telemetry": f"""SELECT user_id mission_id, event_id fix_id, {_EPOCH} t, 28.6139e0+(event_id%100-50)*1e-4::DOUBLE lat,
 77.2090e0+(event_id%37)*1e-4::DOUBLE lon, 215e0+value/10 alt,
 CASE event_type WHEN 'purchase' THEN 'RTK_FIXED' WHEN 'signup' THEN 'RTK_FLOAT' ELSE 'STANDALONE_GPS' END fix_type
 FROM events WHERE event_type<>'click'""",
    "keyframes": f"""SELECT user_id mission_id, event_id keyframe_id, {_EPOCH} t, CAST(trunc(value*3) AS BIGINT) inliers, value
 FROM events WHERE event_type='click'""",
    "frames": f"""SELECT user_id mission_id, event_id frame_id, {_EPOCH} t, value*8 laplacian_var,
 CAST(event_id%256 AS DOUBLE) mean_luminance, value contrast_std, CAST(floor(value*20) AS BIGINT) feature_count,
 value*5 grad_p90, value*10 mse_prev,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 frame_index FROM events""",
    "points": f"""SELECT CAST(floor(o_orderkey/{CLOUD_ROWS}) AS BIGINT) cloud_id, o_orderkey point_id, (o_custkey%401)/8 x, (o_orderkey%397)/8 y,
 o_totalprice/50000 z, CAST((o_orderkey*7)%256 AS INTEGER) r, CAST((o_orderkey*11)%256 AS INTEGER) g,
 CAST((o_orderkey*13)%256 AS INTEGER) b, ((o_orderkey*7)%101)/100 conf FROM orders""",
    "vertices": f"""SELECT CAST(floor(o_orderkey/{MESH_ROWS}) AS BIGINT) mesh_id, o_orderkey%{MESH_ROWS} v, CAST(o_orderkey%100 AS DOUBLE) x,
 floor((o_orderkey%{MESH_ROWS})/100) y, o_totalprice/100000 z, ((o_orderkey*7)%101)/100 conf FROM orders""",
    "faces": f"""SELECT mesh_id, 2*i+u f, CASE u WHEN 0 THEN i ELSE i+1 END v0, CASE u WHEN 0 THEN i+1 ELSE i+101 END v1, i+100 v2
 FROM (SELECT a.mesh_id, a.i FROM (SELECT CAST(floor(o_orderkey/{MESH_ROWS}) AS BIGINT) mesh_id, o_orderkey%{MESH_ROWS} i FROM orders) a
 JOIN (SELECT CAST(floor(o_orderkey/{MESH_ROWS}) AS BIGINT) mesh_id, o_orderkey%{MESH_ROWS} i FROM orders) b
 ON a.mesh_id=b.mesh_id AND b.i=a.i+101 WHERE a.i%100<99), (VALUES (0),(1)) q(u)""",
    "cameras": f"""SELECT *, 480e0 fx, 480e0 fy, 320e0 px, 240e0 py, 640 w, 480 h FROM (SELECT CAST(floor(s_suppkey/{CAMERAS_PER_MESH}) AS BIGINT) mesh_id,
 s_suppkey camera_id, 5e0+9e0*((s_suppkey%{CAMERAS_PER_MESH})%11) cx, 8e0+16e0*floor((s_suppkey%{CAMERAS_PER_MESH})/11) cy,
 40e0+s_acctbal/1000 cz, (s_suppkey%10)/10 quality, 20e0+s_acctbal/100 sharpness, (s_suppkey%20)/20 exposure FROM supplier)""",
    "pixels": f"""SELECT frame_id, CAST(x AS INTEGER) x, CAST(y AS INTEGER) y, CAST(least(255, (37*frame_id)%230+(7*x+13*y+x*y)%(4+(frame_id%8)*36)) AS INTEGER) gray,
 CAST((abs(a)+5*x+3*y)%256 AS INTEGER) b, CAST((17*frame_id+2*x+9*y)%256 AS INTEGER) g, CAST((29*frame_id+11*x+y)%256 AS INTEGER) r
 FROM (SELECT s_suppkey frame_id, CAST(floor(s_acctbal) AS BIGINT) a FROM supplier), range({IMAGE}) q(x), range({IMAGE}) p(y)""",
    "detections": f"""SELECT l_orderkey frame_id, {SUPPLIER_CLASS}[l_suppkey%5+1] object_class, l_discount*10 confidence,
 l_linenumber*7e0-4e0 x1, CAST(l_partkey%40 AS DOUBLE) y1, l_linenumber*7e0-4e0+l_quantity/5 x2, CAST(l_partkey%40 AS DOUBLE)+l_quantity/4 y2 FROM lineitem""",
    "descriptors": "SELECT vec_id%8 frame, vec_id kp, CAST(embedding AS DOUBLE[]) vec FROM embeddings",
    "flow": """SELECT CAST(floor(l_orderkey/100) AS BIGINT) mission_id, CAST(floor(l_orderkey/10) AS BIGINT) ref_frame, l_orderkey cur_frame,
 CAST(l_partkey%640 AS DOUBLE) x0, CAST(l_suppkey%480 AS DOUBLE) y0, (l_partkey%640)+l_quantity-20 x1,
 (l_suppkey%480)+l_linenumber*3e0-10 y1 FROM lineitem""",
}


def with_tables(names: str, body: str) -> str:
    """``body`` preceded by the named survey tables."""
    ctes = ", ".join(f"{n} AS ({CTE[n]})" for n in names.split())
    return f"WITH RECURSIVE {ctes} {body.lstrip()}"
