"""Spectra and wavelets of series, by series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import placed
from tidewater.functions.transform import transformed


def spectrum(df: DataFrame, x: str = "close") -> DataFrame:
    """asset, k, frequency, magnitude, phase of the first n // 2 frequencies of each series, by a transform in steps."""
    z = transformed(df, x).filter("k < n div 2")
    return z.select("asset", F.col("k").cast("int").alias("k"), (F.col("k") / F.col("n")).alias("frequency"), F.hypot("re", "im").alias("magnitude"), F.atan2("im", "re").alias("phase"))


def top_cycles(spec: DataFrame, n: int = 5) -> DataFrame:
    """The n strongest frequencies of each asset but the mean, with their periods: each once."""
    rank = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc(F.round("magnitude", 6)), "k"))
    return spec.filter("k > 0").withColumn("rank", rank).filter(F.col("rank") <= n).select("asset", "rank", "k", (1 / F.col("frequency")).alias("period"), "magnitude")


def cycle_dates(spec: DataFrame, n: int = 5) -> DataFrame:
    """asset, rank, k, period, turn, at: when each of the n strongest cycles begins within its series, in bars from the first:
    at its phase as time, and every period from there on. Each cycle counts once among the n."""
    turns = spec.groupBy(F.col("asset").alias("_a")).agg(F.max(F.col("k") / F.nullif(F.col("frequency"), F.lit(0.0))).alias("_n"))
    x = top_cycles(spec, n).join(spec.select(F.col("asset").alias("_s"), F.col("k").alias("_k"), "phase"), (F.col("asset") == F.col("_s")) & (F.col("k") == F.col("_k"))).join(turns, F.col("asset") == F.col("_a"))
    first = F.pmod(F.col("phase") / (2 * F.lit(math.pi)) * F.col("period"), F.col("period"))
    last = F.floor((F.round("_n") - 1 - F.col("_first")) / F.col("period"))
    x = x.withColumn("_first", first).withColumn("turn", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))))
    return x.select("asset", "rank", "k", "period", "turn", (F.col("_first") + F.col("turn") * F.col("period")).alias("at"))


def schedule(spec: DataFrame) -> DataFrame:
    """asset, k, turn, at: when each cycle stronger than the mean of all has gone round once, twice, up to k times."""
    x = spec.filter("k > 0")
    level = x.groupBy(F.col("asset").alias("_a")).agg(F.avg("magnitude").alias("_level"))
    strong = x.join(level, F.col("asset") == F.col("_a")).filter(F.col("magnitude") > F.col("_level"))
    return strong.select("asset", "k", (1 / F.col("frequency")).alias("_p"), F.explode(F.sequence(F.lit(1), F.col("k"))).alias("turn")).select("asset", "k", "turn", (F.col("turn") * F.col("_p")).alias("at"))


def resampled(df: DataFrame, n: int, x: str = "close") -> DataFrame:
    """asset, i, x: each series at n equally spaced places, on the line between its neighbours there."""
    p = placed(df).select("asset", F.col("_at").alias("at"), F.col(x).alias("v"))
    size = p.groupBy("asset").agg(F.count("*").alias("n"))
    grid = size.select("asset", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), (F.col("n") - 1).alias("last")).withColumn("p", F.col("i") * F.col("last") / (n - 1.0))
    a, c = p.select("asset", F.col("at").alias("low"), F.col("v").alias("a")), p.select("asset", F.col("at").alias("high"), F.col("v").alias("c"))
    both = grid.withColumn("low", F.floor("p")).withColumn("high", F.ceil("p")).join(a, ["asset", "low"]).join(c, ["asset", "high"])
    share = F.col("p") - F.col("low")
    return both.select("asset", "i", (F.col("a") * (1 - share) + F.col("c") * share).alias(x))


def haar_level(df: DataFrame, x: str) -> DataFrame:
    """(asset, i, approx, detail) from (asset, i, x): neighbouring pairs; an odd end is paired with itself."""
    pair = df.groupBy("asset", F.floor(F.col("i") / 2).alias("i2")).agg(F.min_by(x, "i").alias("a"), F.max_by(x, "i").alias("b"))
    return pair.select("asset", F.col("i2").alias("i"), ((F.col("a") + F.col("b")) / math.sqrt(2)).alias("approx"), ((F.col("a") - F.col("b")) / math.sqrt(2)).alias("detail"))


def haar(df: DataFrame, levels: int = 4, x: str = "close") -> DataFrame:
    """asset, level, i, coef: details of levels 1 to levels, and the last approximation as level 0."""
    now = placed(df).select("asset", F.col("_at").alias("i"), F.col(x).alias("approx"))
    out = None
    for k in range(1, levels + 1):
        now = haar_level(now.select("asset", "i", "approx"), "approx")
        d = now.select("asset", F.lit(k).alias("level"), "i", F.col("detail").alias("coef"))
        out = d if out is None else out.unionByName(d)
    return out.unionByName(now.select("asset", F.lit(0).alias("level"), "i", F.col("approx").alias("coef")))


def entropy(df: DataFrame, keys: list[str], x: str, bins: int = 50) -> DataFrame:
    """keys, entropy: Shannon's (in bits) of the histogram of x over bins of equal width in each group."""
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n"))
    width = F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col(x) - F.col("_lo")) / width), F.lit(bins - 1)), F.lit(0))
    h = df.join(ends, keys).groupBy(*keys, "_n", at.alias("_bin")).agg((F.count("*") / F.first("_n")).alias("_p"))
    return h.groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))
