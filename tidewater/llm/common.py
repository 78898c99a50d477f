"""What the training-data operators share: reading inputs, Arrow kernels, tables that cut lineage, components."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch: texts of some KB each, so that a batch stays at some MB.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"

_written: list[tuple[SparkSession, str]] = []
_local_root: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark (the folder may be in any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset (local runs and tests) a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_root:
        _local_root.append("file://" + os.path.join(tempfile.gettempdir(), f"tidewater-{uuid.uuid4().hex}"))
    return _local_root[0]


def materialize(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write df as Parquet to the shared checkpoint folder and read it back: lineage ends there and lost executors
    cost a re-read only. The files go with release() or when the driver's Python ends. clean: let Spark delete the
    shuffle files behind it at once, where they are large."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tidewater-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    if clean:
        tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """The full address of a folder of its own in the shared checkpoint folder, for files that tasks write themselves. It goes
    with discard_folder(), release() or the driver's Python."""
    path = f"{checkpoint_root(spark)}/tidewater-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of new_folder() that nothing will read again."""
    for x in [x for x in _written if folder.endswith(os.path.basename(x[1]))]:
        _written.remove(x)
        _delete(*x)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so when the driver collects its garbage. The events of
    the last job hold it for a moment, so the garbage is collected twice. A session within this process (tests,
    benchmarks) leaves it to Java."""
    jvm = getattr(spark, "_jvm", None)  # a remote session has none, and its server cleans by itself
    if jvm is None or spark.sparkContext.master.startswith("local["):
        return
    for _ in range(2):
        time.sleep(0.25)
        gc.collect()
        jvm.System.gc()
    time.sleep(0.25)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for df in tables:
        paths = {os.path.dirname(f) for f in df.inputFiles()}
        for x in [x for x in _written if any(p.endswith(os.path.basename(x[1])) for p in paths)]:
            _written.remove(x)
            _delete(*x)


def release() -> None:
    """Delete every table that materialize() has written. Results that still read them can't be computed afterwards."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session or its JVM is gone
            continue


def _delete(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


atexit.register(release)


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded size. The bounds are the session's from then on: all operators here set the same."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(kernel, schema)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names count without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array) -> list[str]:
    """The texts of a string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(columns, schema, strict=True)], schema=schema)


def spread(*keys: str | Column, buckets: int) -> Column:
    """A bucket from 0 up to buckets - 1, by hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge of edges(a, b): component is the smallest node reachable.

    Alternating large-star and small-star contraction. Each round's edges are a written table; the neighbours' minima
    are one as well, so that both sides of each join are plain shuffles, whatever size Spark takes the files for, whose hot
    keys adaptive execution can split.
    Loops and repeated edges are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def least(e: DataFrame) -> DataFrame:
        return materialize(e.groupBy("u").agg(F.min("v").alias("m")), "least")

    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).withColumn("m", F.least("m", "u"))
        large = materialize(both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = least(large)
        small = large.join(low.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
