"""Regular grids: bars that nothing was traded in, and what stands in for their prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.ordered import running


def filled_bars(df: DataFrame, unit: str = "hour") -> DataFrame:
    """Every bar of each asset from its first to its last; missing ones with null values."""
    ends = df.groupBy("asset").agg(F.min("bar").alias("lo"), F.max("bar").alias("hi"))
    grid = ends.select("asset", F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias("bar"))
    return grid.join(df, ["asset", "bar"], "left")


def forward_filled(df: DataFrame, x: str = "close") -> DataFrame:
    """ffill and bfill: the last value up to a bar and the first one from it on (which looks ahead)."""
    return running(running(df, {"ffill": ("last", F.col(x))}), {"bfill": ("last", F.col(x))}, backwards=True)


def interpolated(df: DataFrame, x: str = "close") -> DataFrame:
    """Missing values on the line between their neighbours."""
    t = F.unix_timestamp(F.col("bar").cast("timestamp")).cast("double")
    known = F.when(F.col(x).isNotNull(), F.struct(t.alias("t"), F.col(x).alias("c")))
    n = running(running(df, {"_p": ("last", known)}), {"_f": ("last", known)}, backwards=True)
    line = F.col("_p.c") + (F.col("_f.c") - F.col("_p.c")) * (t - F.col("_p.t")) / F.nullif(F.col("_f.t") - F.col("_p.t"), F.lit(0.0))
    return n.select("asset", "bar", F.when(F.col("_p.t") == F.col("_f.t"), F.col("_p.c")).otherwise(line).alias(x))
