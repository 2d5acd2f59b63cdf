"""Session helpers: a local session for tests, and the lineage-cutting rule."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "skyfold", folder: str | None = None) -> SparkSession:
    """A local session for tests and the bench, with a folder for its tables; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SKYFOLD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder or os.environ.get("SKYFOLD_CHECKPOINT_DIR", "/tmp/checkpoints"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; never one of a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir (or call setCheckpointDir) to a folder that the driver and all executors share")
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Writes the rows once to the cluster's shared folder and reads them back.

    The folder is the session's ``spark.checkpoint.dir``, or the context's
    checkpoint folder; without one this fails. Unlike a cached block, the table
    survives the loss of executors, and its size is known to the optimizer.
    ``made`` collects its path, for ``drop_tables``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skyfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of ``cut_lineage`` that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions that are not merged again: for small rows with much work each."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)
