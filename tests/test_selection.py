"""Percentiles by selection against numpy, whatever the buckets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidewater.functions.selection import percentiles

SHARES = (0.0, 0.2, 0.5, 0.99, 1.0)


@pytest.mark.parametrize(("buckets", "left"), [(4, 3), (1024, 4096), (64, 0)])
def test_percentiles(spark, buckets, left):
    rng = random.Random(1)
    groups = {"spread": [rng.lognormvariate(0, 5) for _ in range(700)], "ties": [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(500)], "one": [3.0], "two": [-1.0, 4.0], "same": [0.25] * 90, None: [rng.gauss(0, 1e-9) for _ in range(60)], "far": [-1.5e308, 1.5e308, 0.0, 1.0]}
    rows = [(g, x) for g, v in groups.items() for x in v] + [("one", None), ("one", float("nan")), ("empty", None)]
    rng.shuffle(rows)
    got = {r.asset: list(r.percentiles) for r in percentiles(spark.createDataFrame(rows, "asset string, x double").repartition(3), ["asset"], "x", SHARES, buckets=buckets, left=left).collect()}
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        if g != "far":
            np.testing.assert_allclose(got[g], np.quantile(v, SHARES), rtol=1e-12)
    assert got["far"][2] == 0.5


def test_all_rows_as_one_group(spark):
    df = spark.createDataFrame([(k, float(k * k)) for k in range(1001)], "k long, x double")
    assert percentiles(df, [], "x", [0.5, 0.25], buckets=8, left=10).collect()[0].percentiles == [250000.0, 62500.0]
    assert percentiles(df.limit(0), [], "x", [0.5]).filter("percentiles[0] is not null").count() == 0
    two = percentiles(df.withColumn("a", df.k % 2).withColumn("b", df.k % 3), ["b", "a"], "x", [0.0])
    assert sorted(map(tuple, two.select("a", "b", two.percentiles[0]).collect())) == [(0, 0, 0.0), (0, 1, 16.0), (0, 2, 4.0), (1, 0, 9.0), (1, 1, 1.0), (1, 2, 25.0)]
