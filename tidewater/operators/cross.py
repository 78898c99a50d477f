"""Cross-asset statistics: correlation with a base asset, rankings, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.functions.ordered import over_chunks, running
from tidewater.functions.selection import percentiles


def correlation(a: str, b: str, w: WindowSpec | None = None) -> Column:
    """Pearson's correlation; null where one of both doesn't vary (the built-in aggregate raises an error there)."""
    of = lambda c: c.over(w) if w is not None else c
    return of(F.covar_pop(a, b)) / F.nullif(of(F.stddev_pop(a)) * of(F.stddev_pop(b)), F.lit(0.0))


def expanding_correlation(df: DataFrame, base: str, x: str = "close") -> DataFrame:
    """asset, bar, correlation of every other asset with base over all common bars so far; null until both vary."""
    own = df.filter(F.col("asset") == base).select("bar", F.col(x).alias("b"))
    both = df.filter(F.col("asset") != base).select("asset", "bar", F.col(x).alias("a")).join(own, "bar")
    # sums over deviations from a mean that is the same for all bars, so that no digits are lost
    mean = both.groupBy(F.col("asset").alias("_a")).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    u, v = F.col("a") - F.col("ma"), F.col("b") - F.col("mb")
    sums = {"n": ("sum", F.lit(1)), "su": ("sum", u), "sv": ("sum", v), "suu": ("sum", u * u), "svv": ("sum", v * v), "suv": ("sum", u * v), "lo_a": ("min", F.col("a")), "hi_a": ("max", F.col("a")), "lo_b": ("min", F.col("b")), "hi_b": ("max", F.col("b"))}
    x = running(both.join(mean, F.col("asset") == F.col("_a")), sums)
    part = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / F.col("n")
    r = part("su", "sv", "suv") / F.nullif(F.sqrt(F.greatest(part("su", "su", "suu"), F.lit(0.0)) * F.greatest(part("sv", "sv", "svv"), F.lit(0.0))), F.lit(0.0))
    return x.select("asset", "bar", F.when((F.col("n") >= 2) & (F.col("hi_a") > F.col("lo_a")) & (F.col("hi_b") > F.col("lo_b")), r).alias("correlation"))


def aligned(df: DataFrame, base: str) -> DataFrame:
    """Rows from the base asset's first bar on."""
    start = df.filter(F.col("asset") == base).agg(F.min("bar").alias("start"))  # one row
    return df.join(F.broadcast(start), F.col("bar") >= F.col("start")).drop("start")


def since_earliest(df: DataFrame) -> DataFrame:
    """Rows from the earliest bar of all assets on."""
    start = df.agg(F.min("bar").alias("_start"))  # one row
    return df.join(F.broadcast(start), F.col("bar") >= F.col("_start")).drop("_start")


def looked_up(df: DataFrame, values: DataFrame) -> DataFrame:
    """df with the columns of values (one row an asset); null for assets that it doesn't have. Whether the table is small
    enough to be sent to all tasks is left to its measured size."""
    v = values.withColumnRenamed("asset", "_a")
    return df.join(v, F.col("asset") == F.col("_a"), "left").drop("_a")


def document_series(documents: DataFrame, field: str) -> DataFrame:
    """Documents with a map in field, as rows of its keys and values."""
    return documents.select(*(c for c in documents.columns if c != field), F.explode(field).alias("key", "value"))


def halves(df: DataFrame, x: str, tie: str) -> DataFrame:
    """df with half: 1 for the larger half of the rows by x (the odd one counts to it), 2 for the rest; equal values go by
    tie. The cut is one percentile and one count, so that no task sorts all rows; only those equal to it are ranked."""
    middle = percentiles(df, [], x, [0.5], "_p").select(F.get("_p", F.lit(0)).alias("_p"))
    cut = df.agg(F.count("*").alias("_n")).crossJoin(F.broadcast(middle))  # one row
    at = df.join(F.broadcast(cut)).filter(F.col(x) <= F.col("_p")).agg(F.max(x).alias("_cut"), F.first("_n").alias("_n"))
    y = df.join(F.broadcast(at))
    above = y.agg(F.count(F.when(F.col(x) > F.col("_cut"), 1)).alias("_above"))
    y = y.join(F.broadcast(above))
    equal = y.filter(F.col(x) == F.col("_cut")).withColumn("half", F.when(F.row_number().over(Window.partitionBy(x).orderBy(tie)) <= F.ceil(F.col("_n") / 2) - F.col("_above"), 1).otherwise(2))
    rest = y.filter(F.col(x) != F.col("_cut")).withColumn("half", F.when(F.col(x) > F.col("_cut"), 1).otherwise(2))
    return equal.unionByName(rest).drop("_n", "_cut", "_above")


def investment(fraction: Column, capital: float, invested: float) -> Column:
    """What to put in: a share (at most all) of the capital that is left, never below 0."""
    return F.greatest(F.lit(0.0), F.least(fraction, F.lit(1.0)) * (capital - invested))


def cost_averaged(df: DataFrame, window: int, parts: int) -> DataFrame:
    """asset, part, price: each series in parts of equal length (the rest is left out), with the mean of the prior means
    of window bars there, 0 where there are none."""
    x = over_chunks(df, window, lambda w: {"_i": F.col("_at"), "_ma": F.when(F.col("_at") >= window, F.avg("close").over(w.rowsBetween(-window, -1)))})
    n = df.groupBy(F.col("asset").alias("_a")).agg(F.floor(F.count("*") / parts).alias("_n"))
    y = x.join(n, F.col("asset") == F.col("_a")).filter((F.col("_n") > 0) & (F.col("_i") < parts * F.col("_n")))
    return y.groupBy("asset", F.floor(F.col("_i") / F.col("_n")).cast("int").alias("part")).agg(F.coalesce(F.avg("_ma"), F.lit(0.0)).alias("price"))


def allocation(expected: DataFrame, budget: float, least: float = 0.0) -> DataFrame:
    """asset, amount: the allocation of a budget with the largest expected return, at least a share of least to each.
    The optimum gives every asset its floor and the rest to the best one, if that gains. No rows if floors don't fit."""
    best = expected.agg(F.max_by("asset", F.struct("expected", "asset")).alias("best"), F.max("expected").alias("most"), F.count("*").alias("n"))
    x = expected.join(F.broadcast(best)).filter(F.col("n") * least <= 1)  # best: one row
    rest = F.when((F.col("asset") == F.col("best")) & (F.col("most") > 0), budget * (1 - F.col("n") * least)).otherwise(0.0)
    return x.select("asset", (F.lit(budget * least) + rest).alias("amount"))


def kelly(returns: DataFrame, x: str = "ret") -> DataFrame:
    """asset, fraction, adjusted: mean over variance (population); halved above a deviation of 5 %, half more below 1 %,
    at most 1."""
    k = returns.groupBy("asset").agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.stddev_pop(x).alias("s"))
    f = F.col("m") / F.nullif(F.col("v"), F.lit(0.0))
    return k.select("asset", f.alias("fraction"), F.least(F.when(F.col("s") > 0.05, f * 0.5).when(F.col("s") < 0.01, f * 1.5).otherwise(f), F.lit(1.0)).alias("adjusted"))


def normal_cdf(x):
    """The normal distribution function by a fixed polynomial (error below 1e-7)."""
    # The coefficients of the approximation 26.2.17 in Abramowitz and Stegun.
    p, c = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    poly = sum((v * F.pow(t, F.lit(k)) for k, v in enumerate(c, 1)), F.lit(0.0))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def black_scholes(s, k, t, r, sigma):
    """Prices (call, put) of European options as columns."""
    root = sigma * F.sqrt(t)
    d1 = (F.log(s / k) + (r + sigma * sigma / 2) * t) / root
    d2 = d1 - root
    paid = k * F.exp(-r * t)
    return s * normal_cdf(d1) - paid * normal_cdf(d2), paid * normal_cdf(-d2) - s * normal_cdf(-d1)
