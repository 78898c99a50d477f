"""A session for tests and benchmarks; on a cluster, use its own."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where queries write files that they read again: spark.checkpoint.dir; unset, for local sessions, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tidewater-files")


_folders: list[tuple[SparkSession, str]] = []


def own_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes with release() or when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, for what is computed at length and read many times."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete all that own_folder() has given out. Results that still read it can't be computed afterwards."""
    while _folders:
        spark, path = _folders.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session or its JVM is gone
            continue


atexit.register(release)


def local_session(cores: str | int = "*", memory: str = "4g", partitions: int = 8) -> SparkSession:
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
