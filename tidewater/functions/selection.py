"""Exact percentiles of any number of values by selection: no task holds a group's values, or all the different ones.

A percentile lies between two ranks. For every group and rank an interval that holds it is narrowed, all at once: rounds count
the values of each interval in BUCKETS parts, and the part with the rank, from its least to its largest value, is the next
interval. When no interval has more than LEFT values but those with one value alone, what is left is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import stored

BUCKETS = 1024
LEFT = 4096


def percentiles(df: DataFrame, by: Sequence[str], x: str, shares: Sequence[float], out: str = "percentiles", buckets: int = BUCKETS, left: int = LEFT, rounds: int = 64) -> DataFrame:
    """by, out: an array with the percentile of each share (0 to 1), on the line between the two nearest ranks. Nulls and NaN
    don't count; groups without values have no row. Groups may be null."""
    keys = [f"_g{k}" for k in range(len(by))]
    values = stored(df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(x).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)"), "values")
    ends = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    at = lambda s: F.floor(F.lit(s) * (F.col("n") - 1)).cast("long")
    ranks = F.array(*(r for s in shares for r in (at(s), F.least(at(s) + 1, F.col("n") - 1))))
    # a row for each group and different rank: its interval, how many values are in it, and the rank within
    want = stored(ends.select(*keys, "lo", "hi", F.col("n").alias("have"), F.explode(F.array_distinct(ranks)).alias("rank")).withColumn("inner", F.col("rank")), "ranks")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]

    def members(wanted: DataFrame) -> DataFrame:
        of = wanted.select(*(F.col(k).alias(f"w{k}") for k in keys), "lo", "hi", "rank", "inner")
        on = [F.col(k).eqNullSafe(F.col(f"w{k}")) for k in keys] or [F.lit(True)]
        joined = values.join(F.broadcast(of) if not keys else of, on)  # without groups: a row for each share
        return joined.filter("_x >= lo and _x <= hi").drop(*(f"w{k}" for k in keys))

    for _ in range(rounds):
        if not want.filter(f"have > {left} and lo < hi").limit(1).count():
            break
        wide = members(want.filter(f"have > {left} and lo < hi"))
        # halves first, so that the width of the widest interval doesn't overflow
        part = F.least(F.floor((F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets), F.lit(buckets - 1))
        counts = wide.groupBy(*keys, "rank", "inner", part.alias("part")).agg(F.count("*").alias("have"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        up = Window.partitionBy(*keys, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.coalesce(F.sum("have").over(up), F.lit(0))).filter("inner >= below and inner < below + have")
        next_ = counts.select(*keys, "lo", "hi", "have", "rank", (F.col("inner") - F.col("below")).alias("inner"))
        want = stored(want.filter(f"not (have > {left} and lo < hi)").unionByName(next_), "ranks")
    else:
        raise RuntimeError(f"intervals are still wide after {rounds} rounds")
    few = members(want.filter("lo < hi")).groupBy(*keys, "rank", "inner").agg(F.array_sort(F.collect_list("_x")).alias("v"))  # LEFT values at most
    found = few.select(*keys, "rank", F.get("v", F.col("inner").cast("int")).alias("v")).unionByName(want.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    e, m = ends.alias("e"), maps.alias("m")
    both = e.join(m, same(ends, maps) or [F.lit(True)])

    def value(s: float):
        low = at(s)
        a, b = F.element_at("m", low), F.element_at("m", F.least(low + 1, F.col("n") - 1))
        return a + (b - a) * (F.lit(s) * (F.col("n") - 1) - low)

    return both.select(*(F.col(f"e.{k}").alias(c) for k, c in zip(keys, by, strict=True)), F.array(*map(value, shares)).alias(out))
