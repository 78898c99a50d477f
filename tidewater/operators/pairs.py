"""Profitable pairs of a buy and a later sale without forming all of them.

best_pairs: chunks of a series are known by their least and highest prices, so that what two chunks can give at most is known
before any of their rows meet. If r rows of an earlier chunk are below some price and r rows of a later one above another,
r * r pairs gain the difference at least, which puts a floor under the k-th best; only pairs of chunks that can reach it are
opened, and each gives its own k best.

pair_sums: what a buy gains over all later, dearer bars is a sum over a quadrant of time and price rank. Rows are cut into chunks
by time and, once more, by rank; whole cells of the two are added by running sums, and a row meets only the rows of its
own time chunk and of its own rank chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import placed
from tidewater.session import stored

CHUNK = 1024
#: Pairs that are in memory at once.
AT_ONCE = 1 << 20
#: Pairs so close to the k-th count as equal to it, and the caller's order decides.
CLOSE = 2e-6


def chunk_rows(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """asset, c, us (times in microseconds), close of each chunk in order."""
    p = placed(df.select("asset", "bar", F.col("close").cast("double").alias("close")).filter("close is not null"))
    rows = p.groupBy("asset", F.floor(F.col("_at") / chunk).alias("c")).agg(F.array_sort(F.collect_list(F.struct("_at", F.unix_micros(F.col("bar").cast("timestamp")).alias("us"), "close"))).alias("v"))
    return stored(rows.select("asset", "c", F.col("v.us").alias("us"), F.col("v.close").alias("close")), "chunk-rows")


def open_pairs(rows: DataFrame, k: int) -> DataFrame:
    """asset, a, b, floor: the pairs of chunks (a not after b) that can hold one of the k best pairs of rows, and a profit that k
    pairs reach for sure."""
    r = math.isqrt(k - 1) + 1
    up = F.array_sort("close")
    s = rows.select("asset", "c", F.array_min("close").alias("lo"), F.array_max("close").alias("hi"), F.get(up, F.lit(r - 1)).alias("lo_r"), F.get(up, F.size("close") - r).alias("hi_r"))
    a, b = (s.select("asset", *(F.col(x).alias(f"{side}_{x}") for x in ("c", "lo", "hi", "lo_r", "hi_r"))) for side in "ab")
    pairs = a.join(b, "asset").filter("a_c <= b_c")
    floor = pairs.filter("a_c < b_c").agg(F.greatest(F.max(F.col("b_hi_r") - F.col("a_lo_r")), F.lit(0.0)).alias("floor"))  # one row
    x = pairs.crossJoin(F.broadcast(floor)).withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    most = F.col("b_hi") - F.col("a_lo")
    return x.filter((most > 0) & (most >= F.col("floor"))).select("asset", F.col("a_c").alias("a"), F.col("b_c").alias("b"), "floor")


def _best(bought: tuple[np.ndarray, np.ndarray], sold: tuple[np.ndarray, np.ndarray], floor: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times and profits of the k best pairs of two chunks (the same one twice, or one after the other), and those as good."""
    out, step = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), max(1, AT_ONCE // max(1, len(sold[0])))
    for at in range(0, len(bought[0]), step):
        t, p = bought[0][at : at + step], bought[1][at : at + step]
        gain = sold[1][None, :] - p[:, None]
        i, j = np.nonzero((gain > 0) & (gain >= floor) & (sold[0][None, :] > t[:, None]))
        out = tuple(np.concatenate(x) for x in zip(out, (t[i], sold[0][j], gain[i, j]), strict=True))
        if len(out[0]) > k:
            floor = max(floor, np.partition(out[2], len(out[2]) - k)[len(out[2]) - k] - CLOSE)
            keep = out[2] >= floor
            out = tuple(x[keep] for x in out)
    return out


def best_pairs(df: DataFrame, k: int = 5000, chunk: int = CHUNK) -> DataFrame:
    """asset, buy, sell, profit: a set that holds the k most profitable pairs of all assets, and no more than k (and ties) of
    each pair of chunks; order and limit are the caller's."""
    rows = chunk_rows(df, chunk)
    side = lambda s: rows.select("asset", F.col("c").alias(s), F.col("us").alias(f"us_{s}"), F.col("close").alias(f"close_{s}"))
    both = open_pairs(rows, k).join(side("a"), ["asset", "a"]).join(side("b"), ["asset", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for x in p.itertuples(index=False):
                t, s, g = _best((np.asarray(x.us_a), np.asarray(x.close_a)), (np.asarray(x.us_b), np.asarray(x.close_b)), x.floor, k)
                yield pd.DataFrame({"asset": x.asset, "buy": t, "sell": s, "profit": g})

    found = both.select("asset", "floor", "us_a", "close_a", "us_b", "close_b").mapInPandas(run, "asset string, buy long, sell long, profit double")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return found.select("asset", time("buy"), time("sell"), "profit")


def price_ranked(df: DataFrame) -> DataFrame:
    """df with _rank, each row's place by price within its asset; of equal prices the later bar is lower, so that a later and
    higher row is always dearer. Ranges of prices are sorted by themselves, and begin behind the rows before them."""
    spark = df.sparkSession
    order = [F.asc("close"), F.desc("bar")]
    x = stored(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "asset", *order).withColumn("_part", F.spark_partition_id()), "by-price")
    up = Window.partitionBy("asset").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = x.groupBy("asset", "_part").agg(F.count("*").alias("_n")).select(F.col("asset").alias("_a"), F.col("_part").alias("_b"), F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("asset", "_part").orderBy(*order)) - 1
    return x.withColumn("_place", place).join(sizes, (F.col("asset") == F.col("_a")) & (F.col("_part") == F.col("_b"))).withColumn("_rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_a", "_b", "_before")


def _meetings(rank: np.ndarray, time: np.ndarray, group: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """For each row the sums of values over the rows of higher rank and later time (in a later group)."""
    out = np.zeros((len(rank), values.shape[1]), values.dtype)
    step = max(1, AT_ONCE // max(1, len(rank)))
    for at in range(0, len(rank), step):
        mine = slice(at, at + step)
        later = time[None, :] > time[mine, None] if group is None else group[None, :] > group[mine, None]
        out[mine] = ((rank[None, :] > rank[mine, None]) & later).astype(values.dtype) @ values
    return out


def pair_sums(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """asset, buy, trades, profit, days: for every bar how many later bars are dearer, and the sums of what they gain and of
    the days until them. df: asset, bar, close, a whole number (sums are exact) or a double."""
    x = df.select("asset", "bar", "close").filter("close is not null").withColumn("_on", F.datediff(F.col("bar").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"))
    x = price_ranked(placed(x)).withColumns({"_c": F.floor(F.col("_at") / chunk), "_r": F.floor(F.col("_rank") / chunk)})
    x = stored(x, "quadrants")
    kind = df.schema["close"].dataType.simpleString()
    number = np.int64 if kind in ("bigint", "int") else np.float64
    out = f"asset string, _at long, n long, s {kind}, d long"

    def meet(p: pd.DataFrame, same_time: bool) -> pd.DataFrame:
        v = np.column_stack([np.ones(len(p)), p["close"], p["_on"]]).astype(number)
        got = _meetings(p["_rank"].to_numpy(), p["_at"].to_numpy(), None if same_time else p["_c"].to_numpy(), v)
        return pd.DataFrame({"asset": p["asset"], "_at": p["_at"], "n": got[:, 0].astype(np.int64), "s": got[:, 1], "d": got[:, 2].astype(np.int64)})

    of = x.select("asset", "_at", "_rank", "_c", "_r", "close", "_on")
    inside = of.groupBy("asset", "_c").applyInPandas(lambda p: meet(p, True), out)
    level = of.groupBy("asset", "_r").applyInPandas(lambda p: meet(p, False), out)
    # rows of the same time chunk meet inside, also those of the same rank chunk; so level takes later chunks only, and cells
    # later chunks of higher rank chunks
    cell = of.groupBy("asset", "_c", "_r").agg(F.count("*").alias("n"), F.sum("close").alias("s"), F.sum("_on").alias("d"))
    ends = of.groupBy("asset").agg(F.max("_c").alias("mc"), F.max("_r").alias("mr"))
    grid = ends.select("asset", F.explode(F.sequence(F.lit(0).cast("long"), "mc")).alias("_c"), "mr").select("asset", "_c", F.explode(F.sequence(F.lit(0).cast("long"), "mr")).alias("_r"))
    grid = grid.join(cell, ["asset", "_c", "_r"], "left").fillna(0, ["n", "s", "d"])
    later = Window.partitionBy("asset", "_r").orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy("asset", "_c").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    for w in (later, higher):
        grid = grid.select("asset", "_c", "_r", *(F.coalesce(F.sum(v).over(w), F.lit(0)).cast(grid.schema[v].dataType).alias(v) for v in ("n", "s", "d")))
    far = of.join(grid, ["asset", "_c", "_r"]).select("asset", "_at", "n", "s", "d")
    total = inside.unionByName(level).unionByName(far).groupBy("asset", "_at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("d").alias("d"))
    y = x.join(total, ["asset", "_at"])
    return y.select("asset", F.col("bar").alias("buy"), F.col("n").alias("trades"), (F.col("s") - F.col("n") * F.col("close")).alias("profit"), (F.col("d") - F.col("n") * F.col("_on")).alias("days"))


def profits_by(sums: DataFrame, unit: str, out: str) -> DataFrame:
    """asset, the period of buying, profit, trades, days of pair_sums()."""
    return sums.filter("trades > 0").groupBy("asset", F.date_trunc(unit, "buy").cast("timestamp_ntz").alias(out)).agg(F.sum("profit").alias("profit"), F.sum("trades").alias("trades"), F.sum("days").alias("days"))
