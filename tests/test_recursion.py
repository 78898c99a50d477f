"""Recursive forecasts: each step's features are those of the whole series with the forecasts behind it."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import models
from tidewater.operators.indicators import full_features

BARS = "asset string, bar timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def series(spark):
    rng, rows = random.Random(5), []
    for a, n in (("x", 120), ("y", 75), ("short", 20)):
        p = 100.0
        for k in range(n):
            o, p = p, p + rng.gauss(0, 1)
            rows.append((a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), o, max(o, p) + 0.3, min(o, p) - 0.2, p, float(rng.randint(1, 50))))
    return spark.createDataFrame(rows, BARS).repartition(3).cache()


def test_features_of_grown_series(spark, series):
    ends = {r.asset: r for r in models.series_ends(series).collect()}
    new, told = [], {}
    for a in ("x", "y"):
        ahead = models.Ahead(pd.DataFrame([b.asDict() for b in ends[a].bars]), ends[a].n, ends[a].means.asDict())
        at = ends[a].bars[-1].bar
        for k in range(30):
            told[a, at] = ahead.features()
            at, close = at + dt.timedelta(hours=1), float(100 + 5 * np.sin(k) + k % 3)
            new.append((a, at, close, close, close, close, float(k % 4 + 1)))
            ahead.add(at, close, float(k % 4 + 1))
    whole = full_features(series.unionByName(spark.createDataFrame(new, BARS))).toPandas()
    names = [c for c in whole.columns if c not in models.NOT_FEATURES]
    seen = 0
    for r in whole.to_dict("records"):
        if (r["asset"], r["bar"]) in told:
            f = told[r["asset"], r["bar"]]
            seen += 1
            assert f.keys() == set(names)
            for n in names:
                assert f[n] == pytest.approx(r[n], rel=1e-9, abs=1e-9), n
    assert seen == 60


def test_forest_is_the_same(spark, series):
    x, names = models.next_close(series)
    model = models.forest(x.dropna(subset=["_next"]), 7, 4, 1)
    trees = models.exported(model)
    for r in model.transform(x).select("_f", "predicted").collect():
        assert models.predicted(trees, list(r._f.toArray())) == pytest.approx(r.predicted, rel=1e-12)
    got = models.recursive_forecast(series, 5, model=model).toPandas()
    assert set(got.asset) == {"x", "y"} and len(got) == 10
    first = {r.asset: r.predicted for r in model.transform(x.filter("_next is null")).collect()}
    for a in ("x", "y"):
        one = got[got.asset == a].sort_values("step")
        assert one.close.iloc[0] == pytest.approx(first[a], rel=1e-12)
        assert (one.bar.diff().dropna() == pd.Timedelta(hours=1)).all() and one.close.between(80, 120).all()
    assert series.filter(F.col("asset") == "short").count() == 20
