"""Exponentially weighted means of long series as an associative scan.

y[t] = (1 - a) y[t-1] + g x[t] is affine, so chunks of STEP rows are folded by themselves (a running sum of x over powers
of 1 - a), the chunks' last values are carried over the table of chunks, and carries are added back. The power
within a chunk stays far from overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import placed

STEP = 64


def ewm(df: DataFrame, x: str, alpha: float, out: str, by: str = "asset", ts: str = "bar", adjust: bool = False) -> DataFrame:
    """df with out, the weighted mean of x over the rows where x is not null (null elsewhere). adjust=False: the first
    value has weight one and all others alpha; adjust=True: weights of all values so far, divided by their sum."""
    have = placed(df.filter(F.col(x).isNotNull()).select(by, ts, F.col(x).alias("_x")), by, ts)
    k = (F.col("_at") % STEP).cast("double")
    keep = F.lit(1 - alpha)
    gain = F.lit(1.0) if adjust else F.when(F.col("_at") == 0, 1.0).otherwise(alpha)
    c = have.withColumns({"_c": F.floor(F.col("_at") / STEP), "_k": k})
    run = Window.partitionBy(by, "_c").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_b", F.pow(keep, F.col("_k")) * F.sum(gain * F.col("_x") * F.pow(keep, -F.col("_k"))).over(run))
    ends = c.groupBy(by, "_c").agg(F.max_by("_b", "_k").alias("_last"), F.count("*").alias("_n"))
    # the carry into each chunk: the ends of the chunks before it, faded; those whose share is below 1e-18 don't count
    reach = max(1, math.ceil(42 / (STEP * max(1e-9, -math.log(1 - alpha))))) if alpha < 1 else 1
    ends = c.groupBy(by, "_c").agg(F.max_by("_b", "_k").alias("_last"))
    near = Window.partitionBy(by).orderBy("_c").rowsBetween(-reach, -1)
    faded = F.aggregate("_all", F.lit(0.0), lambda s, e: s + e["_last"] * F.pow(keep, (STEP * (F.col("_c") - 1 - e["_c"])).cast("double")))
    carries = ends.withColumn("_all", F.collect_list(F.struct("_c", "_last")).over(near)).select(F.col(by).alias("_by"), F.col("_c").alias("_cc"), faded.alias("_carry"))
    y = F.col("_b") + F.col("_carry") * F.pow(keep, F.col("_k") + 1)
    if adjust:
        y = y * alpha / (1 - F.pow(keep, F.col("_at").cast("double") + 1))
    done = c.join(carries, (F.col(by) == F.col("_by")) & (F.col("_c") == F.col("_cc"))).select(F.col(by).alias("_e"), F.col(ts).alias("_t"), y.alias(out))
    return df.join(done, (F.col(by) == F.col("_e")) & (F.col(ts) == F.col("_t")), "left").drop("_e", "_t")


def seeded(df: DataFrame, x: str, n: int, alpha: float, out: str, by: str = "asset", ts: str = "bar") -> DataFrame:
    """df with out: from the n-th value of x on, the recurrence that begins with the mean of the first n values."""
    have = placed(df.filter(F.col(x).isNotNull()).select(by, ts, F.col(x).alias("_x")), by, ts)
    seed = have.filter(F.col("_at") < n).groupBy(by).agg(F.avg("_x").alias("_seed")).withColumnRenamed(by, "_s")
    from_n = have.filter(F.col("_at") >= n - 1).join(seed, F.col(by) == F.col("_s")).select(by, ts, F.when(F.col("_at") == n - 1, F.col("_seed")).otherwise(F.col("_x")).alias("_v"))
    y = ewm(from_n, "_v", alpha, out, by, ts).select(F.col(by).alias("_e"), F.col(ts).alias("_t"), out)
    return df.join(y, (F.col(by) == F.col("_e")) & (F.col(ts) == F.col("_t")), "left").drop("_e", "_t")


def ema(df: DataFrame, x: str, n: int, out: str, **keys) -> DataFrame:
    """The exponential mean of span n, seeded by the first mean."""
    return seeded(df, x, n, 2 / (n + 1), out, **keys)


def rma(df: DataFrame, x: str, n: int, out: str, **keys) -> DataFrame:
    """Wilder's mean of length n, seeded by the first mean."""
    return seeded(df, x, n, 1 / n, out, **keys)


def span(n: int) -> float:
    return 2 / (n + 1)


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))
