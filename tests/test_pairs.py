"""Best pairs and sums over pairs against all pairs."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import pairs
from tidewater.operators.signals import pair_profits


def series(spark, n: int, kind: str = "long", seed: int = 4):
    rng = random.Random(seed)
    rows = []
    for a, count in (("walk", n), ("ties", n // 2), ("one", 1), ("down", 30)):
        p = 5000
        for k in range(count):
            p = {"walk": p + rng.randint(-50, 52), "ties": rng.choice([100, 200, 300]), "one": 5, "down": 100 - k}[a]
            rows.append((a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k), p))
    return spark.createDataFrame(rows, f"asset string, bar timestamp_ntz, close {kind if kind == 'long' else 'long'}").withColumn("close", F.col("close").cast(kind)).repartition(3)


@pytest.mark.parametrize("chunk", [13, 64, 4096])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_sums(spark, chunk, kind):
    x = series(spark, 300, kind)
    got = {(r.asset, r.buy): (r.trades, r.profit, r.days) for r in pairs.pair_sums(x, chunk).collect()}
    want = {(r.asset, r.buy): (r.n, r.p, r.d) for r in pair_profits(x).groupBy("asset", "buy").agg(F.count("*").alias("n"), F.sum("profit").alias("p"), F.sum("days").alias("d")).collect()}
    assert len(got) == x.count()
    assert {k: v for k, v in got.items() if v[0]} == want


@pytest.mark.parametrize(("chunk", "k"), [(20, 9), (50, 200), (4096, 50), (10, 1)])
def test_best(spark, chunk, k):
    x = series(spark, 400)
    top = lambda df: [tuple(r) for r in df.orderBy(F.desc("profit"), "asset", "buy", "sell").limit(k).collect()]
    assert top(pairs.best_pairs(x, k, chunk)) == top(pair_profits(x).select("asset", "buy", "sell", F.col("profit").cast("double").alias("profit")))


def test_few_chunks_are_opened(spark):
    """Of a long walk only the pairs of chunks near the best ones are read."""
    p = np.cumsum(np.random.default_rng(3).normal(0, 1, 40_000))
    rows = [("a", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=k), float(v)) for k, v in enumerate(p)]
    r = pairs.chunk_rows(spark.createDataFrame(rows, "asset string, bar timestamp_ntz, close double"), 200)
    m = r.count()
    assert pairs.open_pairs(r, 5000).count() < 0.05 * m * (m + 1) / 2
