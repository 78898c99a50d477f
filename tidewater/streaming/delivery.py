"""Delivery of a stream's batches that survives retries, restarts and being stopped.

A batch is written to a folder of its own, whole, and then entered in a ledger. Spark gives a batch the same number and
the same rows when it runs it again, so a batch that failed before its entry is written over, and one that failed after it is
skipped: readers, who take the entered batches alone, see each row once. What fails for a while is tried again after
pauses that double.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.session import own_folder

Write = Callable[[DataFrame, str], None]


def as_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


class Delivery:
    """A foreachBatch sink. write: gets a batch's rows and the place that is the batch's own; it may be called again for the
    same place, and must then replace what is there."""

    def __init__(self, folder: str, write: Write = as_parquet, attempts: int = 5, pause: float = 0.2, sleep: Callable[[float], None] = time.sleep):
        self.folder, self.write, self.attempts, self.pause, self.sleep = folder, write, attempts, pause, sleep
        self.running = threading.Lock()

    def _place(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def entered(self, spark: SparkSession, batch: int) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(self._place("ledger", batch))
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def enter(self, spark: SparkSession, batch: int) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(self._place("ledger", batch))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)  # one step: there, or not

    def __call__(self, rows: DataFrame, batch: int) -> None:
        with self.running:
            spark = rows.sparkSession
            if self.entered(spark, batch):
                return
            for k in range(self.attempts):
                try:
                    self.write(rows, self._place("rows", batch))
                    break
                except Exception:
                    if k + 1 == self.attempts:
                        raise
                    self.sleep(self.pause * 2**k)
            self.enter(spark, batch)

    def delivered(self, spark: SparkSession, schema, last: bool = False) -> DataFrame:
        """All rows of entered batches, or of the last one, with the number of their batch."""
        system_of = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        system = system_of.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(system_of)] if system.exists(system_of) else []
        if not names:
            return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("int"))
        names = [max(names, key=lambda n: int(n.partition("=")[2]))] if last else names
        whole = spark.read.schema(schema).option("basePath", f"{self.folder}/rows")
        return whole.parquet(*(f"{self.folder}/rows/{n}" for n in names))


def drain(query: StreamingQuery, sink: Delivery, seconds: float = 60.0) -> bool:
    """Stop a stream between two batches: the one under way is delivered and entered first. False if that took too long and
    the stream was stopped all the same; the next run then repeats the batch."""
    free = sink.running.acquire(timeout=seconds)
    try:
        query.stop()
    finally:
        if free:
            sink.running.release()
    return free


def delivered(stream: DataFrame, mode: str = "append", write: Write = as_parquet, folder: str | None = None, checkpoint: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives what it has delivered. With the folder and checkpoint of an earlier
    run it goes on from there. In append mode the windows that the watermark has not closed are missing; complete mode gives
    the last batch's table, update mode every batch's changes. No row passes through the driver. conf: settings of the session for this stream alone."""
    spark = stream.sparkSession
    folder, checkpoint = folder or own_folder(spark, "delivered"), checkpoint or own_folder(spark, "stream-checkpoint")
    sink = Delivery(folder, write)
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return sink.delivered(spark, stream.schema, mode == "complete").drop("batch")


def periodic(stream: DataFrame, interval: str = "1 second", mode: str = "complete") -> DataFrame:
    """Runs a stream with a batch each interval until it has taken what is there, drains it, and gives what it has delivered."""
    spark, sink = stream.sparkSession, Delivery(own_folder(stream.sparkSession, "delivered"))
    query = stream.writeStream.outputMode(mode).trigger(processingTime=interval).option("checkpointLocation", own_folder(spark, "stream-checkpoint")).foreachBatch(sink).start()
    try:
        query.processAllAvailable()
    finally:
        drain(query, sink)
    return sink.delivered(spark, stream.schema, mode == "complete").drop("batch")
