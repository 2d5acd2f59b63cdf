"""Telemetry files to fixes: subtitle text, CSV logs, JSON, GPX and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyfold.functions.text import clock_seconds, filled, labelled_number
from skyfold.schemas import FIXES

# Column names a flight log may use, in order of preference.
SYNONYMS = {
    "timestamp_sec": ["timestamp_sec", "timestamp", "time"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon"],
    "altitude": ["altitude", "alt", "height"],
    "fix_type": ["fix_type", "rtk_status"],
}


def subtitle_fixes(texts: DataFrame, text: str = "value") -> DataFrame:
    """Fixes of subtitle blocks: number, time line, then labelled values.

    Blocks without latitude and longitude are dropped; altitude defaults to 0.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "^\\s+|\\s+$", ""))
    blocks = texts.withColumn("_clean", clean).select(
        *[c for c in texts.columns if c != text], F.posexplode(F.split("_clean", "\n\n")).alias("block_no", "_block")
    )
    lines = F.filter(F.transform(F.split("_block", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    rows = blocks.withColumn("_lines", lines).where(F.size("_lines") >= 2)
    content = F.array_join(F.slice("_lines", 3, F.greatest(F.size("_lines") - 2, F.lit(0))), " ")
    return rows.select(
        *[c for c in texts.columns if c != text], "block_no",
        clock_seconds(F.col("_lines")[1]).alias("timestamp_sec"),
        labelled_number(content, "latitude").alias("latitude"), labelled_number(content, "longitude").alias("longitude"),
        F.coalesce(labelled_number(content, "rel_alt|altitude|alt"), F.lit(0.0)).alias("altitude"),
        F.lit("SRT").alias("source"),
    ).where("latitude IS NOT NULL AND longitude IS NOT NULL")


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files, one row per block; each (small) file is read whole."""
    texts = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return subtitle_fixes(texts)


def log_fixes(rows: DataFrame) -> DataFrame:
    """Fixes of a flight log with any of the known column names; bad rows are skipped."""
    by_name = {c.lower().strip(): c for c in reversed(rows.columns)}

    def first(target: str) -> Column:
        present = [filled(F.col(f"`{by_name[n]}`").cast("string")) for n in SYNONYMS[target] if n in by_name]
        return F.coalesce(*present, F.lit(None).cast("string"))

    picked = rows.select(*[first(t).alias(t) for t in SYNONYMS])
    number = lambda c, default=None: (
        F.col(c).try_cast("double") if default is None
        else F.when(F.col(c).isNull(), F.lit(default)).otherwise(F.col(c).try_cast("double"))
    )
    fixes = picked.select(
        number("timestamp_sec", 0.0).alias("timestamp_sec"), number("latitude").alias("latitude"),
        number("longitude").alias("longitude"), number("altitude", 0.0).alias("altitude"),
        F.upper(F.coalesce("fix_type", F.lit("STANDALONE_GPS"))).alias("fix_type"), F.lit("CSV").alias("source"),
    )
    return fixes.dropna(subset=["timestamp_sec", "latitude", "longitude", "altitude"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return log_fixes(spark.read.option("header", True).csv(path))


def read_json_fixes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXES).option("multiLine", True).json(path)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track points of GPX files; times without a zone are UTC."""
    zoned = F.when(F.col("time").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.col("time")).otherwise(F.concat("time", F.lit("Z")))
    points = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, ele double, time string").load(path)
    return points.select(
        (F.unix_micros(F.to_timestamp(zoned)) / 1e6).alias("timestamp_sec"),
        F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.coalesce("ele", F.lit(0.0)).alias("altitude"),
        F.lit("STANDALONE_GPS").alias("fix_type"), F.lit("GPX").alias("source"),
    )


def scan_positions(lines: DataFrame, text: str = "value") -> DataFrame:
    """First adjacent number pair within +-90 / +-180 on lines that mention lat or gps."""
    words = F.filter(F.split(F.regexp_replace(F.col(text), "[,:]", " "), "\\s+"), lambda w: w != "")
    numbers = F.transform(words, lambda w: w.try_cast("double"))
    hit = lines.where(F.lower(text).rlike("lat|gps")).withColumn("_n", numbers)
    pairs = F.zip_with("_n", F.slice("_n", 2, F.greatest(F.size("_n"), F.lit(1))), lambda a, b: F.struct(a.alias("lat"), b.alias("lon")))
    good = F.filter(pairs, lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180))
    return hit.withColumn("_p", F.get(good, F.lit(0))).where("_p IS NOT NULL").select(
        *lines.columns, F.col("_p.lat").alias("latitude"), F.col("_p.lon").alias("longitude")
    )
