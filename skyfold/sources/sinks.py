"""Writing stage output and replacing or adding rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_stage(df: DataFrame, metrics: DataFrame, path: str, key: str = "job_id") -> str:
    """Stage rows as Parquet and its metrics as JSON, both split by job, visible only once a marker is written; returns the run's name.

    Each run writes folders of its own, then the list of its jobs, and last one row
    that commits it. A run that ends before that leaves files which no reader of
    ``read_stage`` sees; of a job written by several runs the last committed counts.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    df.hint("rebalance", key).write.partitionBy(key).parquet(f"{path}/data/run={run}")
    metrics.write.partitionBy(key).json(f"{path}/metrics/run={run}")
    jobs = metrics.select(key).unionByName(df.select(key)).distinct().withColumn("run", F.lit(run))
    jobs.write.mode("append").parquet(f"{path}/jobs")
    commit_stage(spark, path, run)
    return run


def commit_stage(spark: SparkSession, path: str, run: str) -> None:
    """The marker of a run: one row, so one file that is there or not."""
    marker = spark.range(1).coalesce(1).select(F.lit(run).alias("run"), F.unix_micros(F.current_timestamp()).alias("at"))
    marker.write.mode("append").parquet(f"{path}/commits")


def read_stage(spark: SparkSession, path: str, key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Rows and metrics of the last committed run of each job."""
    commits = spark.read.parquet(f"{path}/commits")
    jobs = spark.read.parquet(f"{path}/jobs").join(commits, "run")
    last = jobs.groupBy(key).agg(F.max_by("run", F.struct("at", "run")).alias("run"))
    kept = lambda df: df.join(last, [key, "run"], "left_semi").drop("run")
    return kept(spark.read.parquet(f"{path}/data")), kept(spark.read.json(f"{path}/metrics"))


def replace_groups(df: DataFrame, path: str, key: str = "mission_id", fmt: str = "parquet", rows_per_file: int = 5_000_000) -> None:
    """Replaces only the groups present in the rows; other groups stay as they are.

    Groups are rebalanced by size: a hot one is dealt over as many tasks as its
    bytes need, small ones share a task and have one file each.
    """
    writer = df.hint("rebalance", key).write.format(fmt).partitionBy(key).option("maxRecordsPerFile", rows_per_file)
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").save(path)


def append_artifacts(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
