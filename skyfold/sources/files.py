"""Manifests, stage reports, ASCII clouds and meshes, upload inventory, control tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skyfold.schemas import CONTROL, MANIFEST, REPORTS, require

# Accepted file endings and the size ceiling of an upload.
VIDEO_EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv"]
TELEMETRY_EXTENSIONS = [".srt", ".csv", ".gpx", ".txt", ".json"]
ISO_BOXES = ["ftyp", "moov", "mdat", "wide", "free", "skip", "pnot"]
MAX_UPLOAD_BYTES = 2048 * 1024 * 1024
# Property names of the text cloud format.
PROPERTY_NAMES = {
    "x": ["x"], "y": ["y"], "z": ["z"], "r": ["red", "r"], "g": ["green", "g"], "b": ["blue", "b"],
    "conf": ["confidence", "quality", "intensity", "conf", "scalar_confidence"],
}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Frames of manifest files; the file name may sit under any of three keys."""
    docs = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    rows = docs.select("video_name", "fps", F.explode("frames").alias("f"))
    return rows.select(
        "video_name", "fps", "f.frame_id", "f.frame_index", "f.timestamp_sec",
        F.coalesce("f.file", "f.filepath", "f.filename").alias("file"), "f.width", "f.height", "f.file_size_bytes",
    )


def read_report(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Flat rows of a stage report: quality, keyframes, detections, illumination, trajectory, poses or matches."""
    under, fields = REPORTS[kind]
    ddl = ", ".join(p.replace(":", " ", 1) for p in fields.split(","))
    reader = spark.read.option("multiLine", True)
    if under is None:
        return reader.schema(ddl).json(path)
    docs = reader.schema(f"`{under}` array<struct<{fields}>>").json(path)
    return docs.select(F.inline(under))


def flat_poses(poses: DataFrame) -> DataFrame:
    """Row-major rotation of poses whose R is nested."""
    return poses.withColumn("R", F.flatten("R"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of all files at a path, with their file and their number in it.

    A task reads a block of a file in order, so row numbers run on inside a
    block; one small row for each block gives the lines before it.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.text(path).select("value", at.alias("_at"), F.monotonically_increasing_id().alias("_row"))
    blocks = rows.groupBy("_at").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_at.file").orderBy("_at.start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select(F.col("_at").alias("_block"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(offsets, F.col("_at") == F.col("_block")).select("_at.file", (F.col("_before") + F.col("_row") - F.col("_first")).alias("line"), "value")


def _layouts(lines: DataFrame) -> DataFrame:
    """One row for each file: header end, vertex and face counts and vertex properties in order, from its header lines."""
    ends = lines.where(F.trim("value") == "end_header").groupBy("file").agg(F.min("line").alias("end"))
    words = F.split(F.trim("value"), "\\s+")
    head = lines.where(F.col("value").rlike("^(element|property)")).join(ends, "file").where(F.col("line") < F.col("end"))
    head = head.select("file", "line", "end", words.alias("_w")).withColumn("_element", F.when(F.col("_w")[0] == "element", F.get("_w", F.lit(1))))
    inside = F.last("_element", ignorenulls=True).over(Window.partitionBy("file").orderBy("line"))
    head = head.withColumn("_of", inside)
    count = lambda name: F.coalesce(F.max(F.when(F.col("_element") == name, F.get("_w", F.lit(2)).try_cast("bigint"))), F.lit(0).cast("long"))
    named = F.when(F.col("_element").isNull() & (F.col("_of") == "vertex"), F.struct("line", F.lower(F.element_at("_w", -1)).alias("name")))
    found = head.groupBy("file", "end").agg(count("vertex").alias("n_vertices"), count("face").alias("n_faces"), F.sort_array(F.collect_list(named)).alias("_p"))
    return found.select("file", "end", "n_vertices", "n_faces", F.col("_p.name").alias("properties"))


def read_text_clouds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of all ASCII clouds and meshes at a path (a file, a folder or a pattern), with their ``file``.

    Each file has its own header, and its columns follow it; headers are a small
    table that the lines meet by file, so any number of files, and parts of large
    ones, are read side by side. Colours default to 200 and confidence to 1.0;
    vertices without a position are left out, files without a header give none.
    """
    lines = _numbered(spark, path)
    body = lines.join(_layouts(lines), "file").where(F.col("line") > F.col("end"))
    body = body.withColumn("_w", F.split(F.trim("value"), "\\s+")).withColumn("_v", F.col("line") - F.col("end") - 1)

    def column(name: str, default) -> Column:
        at = F.coalesce(*[F.nullif(F.array_position("properties", p), F.lit(0)) for p in PROPERTY_NAMES[name]]) - 1
        value = F.get("_w", at.cast("int")).try_cast("double")
        return value if default is None else F.coalesce(value, F.lit(float(default)))

    vertices = body.where(F.col("_v") < F.col("n_vertices")).select(
        "file", F.col("_v").alias("v"), *[column(c, None).alias(c) for c in "xyz"],
        *[column(c, 200).cast("int").alias(c) for c in "rgb"], column("conf", 1.0).alias("conf"),
    ).dropna(subset=["x", "y", "z"])
    f = F.col("_v") - F.col("n_vertices")
    index = lambda i: F.get("_w", F.lit(i)).try_cast("bigint")
    faces = body.where((f >= 0) & (f < F.col("n_faces")) & (F.size("_w") >= 4)).select("file", f.alias("f"), *[index(i + 1).alias(f"v{i}") for i in range(3)])
    return vertices, faces


def read_text_cloud(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of one ASCII cloud or mesh file."""
    vertices, faces = read_text_clouds(spark, path)
    return vertices.drop("file"), faces.drop("file")


def upload_audit(files: DataFrame, allowed: list[str] | None = None, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Verdict of each file of ``path, length, header``: ending, size and container mark."""
    allowed = allowed or VIDEO_EXTENSIONS + TELEMETRY_EXTENSIONS
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    # ISO media begins with a box: four bytes of length, then its type; RIFF names its form after eight bytes; Matroska has a fixed first element
    text = lambda first, n: F.decode(F.substring("header", first, n), "ISO-8859-1")
    container = (
        F.when(F.length("header") < 8, False)
        .when(F.col("ext").isin(".mp4", ".mov"), text(5, 4).isin(ISO_BOXES))
        .when(F.col("ext") == ".avi", (text(1, 4) == "RIFF") & (text(9, 4) == "AVI "))
        .when(F.col("ext") == ".mkv", F.hex(F.substring("header", 1, 4)) == "1A45DFA3")
        .otherwise(True)
    )
    reason = (
        F.when(~F.col("ext").isin(*allowed), "EXTENSION_NOT_ALLOWED")
        .when(F.col("length") > max_bytes, "TOO_LARGE").when(~container, "BAD_CONTAINER")
    )
    return files.withColumn("ext", ext).withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("header")


def _first_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads = []
        for path in b.column(0).to_pylist():
            store, name = pafs.FileSystem.from_uri(path)
            with store.open_input_stream(name) as data:
                heads.append(data.read(32))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, pa.binary())], names=["path", "length", "header"])


def read_upload_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and first 32 bytes of each file; no more of a file is read, whatever its size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.mapInArrow(_first_bytes, "path string, length bigint, header binary")


def read_control(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A control table at rest, checked against its schema."""
    return require(spark.read.parquet(path), CONTROL[name], name)
