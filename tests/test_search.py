"""The surrogate search: the process and its criterion against closed forms, minima of known functions, a forest's trials."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import search as sr
from tidewater.operators.models import next_close

SPACE = {"a": sr.Whole(0, 60), "b": sr.Whole(-20, 20), "kind": ("x", "y", "z")}


def valley(s: dict) -> float:
    return ((s["a"] - 41) / 10) ** 2 + ((s["b"] + 7) / 5) ** 2 + {"x": 3.0, "y": 0.0, "z": 1.5}[s["kind"]]


def test_a_process_goes_through_what_is_known():
    rng = np.random.default_rng(2)
    x = rng.random((12, 2))
    y = np.sin(4 * x[:, 0]) + x[:, 1]
    process = sr.Process(x, y)
    mean, deviation = process.at(x)
    assert np.allclose(mean, y, atol=0.05) and (deviation < 0.1).all()
    far = process.at(np.array([[50.0, 50.0]]))
    assert far[0] == pytest.approx(y.mean()) and far[1] == pytest.approx(y.std())


def test_expected_improvement_is_the_mean_of_what_lies_under():
    draws = np.random.default_rng(3).normal(2.0, 0.7, 400_000)
    for best in (1.0, 2.0, 3.5):
        want = np.maximum(best - draws, 0).mean()
        assert sr.expected_improvement(np.array([2.0]), np.array([0.7]), best)[0] == pytest.approx(want, abs=0.005)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("at_once", [1, 4])
def test_search_finds_the_valley(seed, at_once):
    """Within 50 of 7,503 settings, and better than 50 at random."""
    found = sr.search(lambda s: [valley(x) for x in s], SPACE, 50, 10, at_once, seed)
    assert len(found) == 50 and len({tuple(s.values()) for s, _ in found}) == 50
    plain = min(valley(s) for s in sr.drawn(SPACE, 50, np.random.default_rng(seed)))
    best = min(v for _, v in found)
    assert best < 0.1 and best <= plain


def test_a_small_space_is_tried_whole():
    found = sr.search(lambda s: [float(x["a"]) for x in s], {"a": sr.Whole(1, 6)}, 50, 3, 4)
    assert sorted(s["a"] for s, _ in found) == [1, 2, 3, 4, 5, 6]


def test_equal_losses():
    assert len(sr.search(lambda s: [1.0] * len(s), SPACE, 14, 5, 3)) == 14


def test_trials_of_a_forest(spark):
    rng, rows = random.Random(5), []
    for asset, n in (("x", 150), ("y", 110)):
        p = 100.0
        for k in range(n):
            o, p = p, p + rng.gauss(0, 1) + math.sin(k / 6)
            rows.append((asset, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), o, max(o, p) + 0.5, min(o, p) - 0.5, p, float(rng.randint(1, 90))))
    df = spark.createDataFrame(rows, "asset string, bar timestamp_ntz, open double, high double, low double, close double, volume double")
    space = {"trees": sr.Whole(2, 6), "features": ("sqrt", "log2"), "depth": (2, 4), "least": sr.Whole(1, 4), "bootstrap": (True, False)}
    got = sr.forest_surrogate_search(df, 5, 2, 3, 2, space).orderBy("trial").collect()
    assert [r.trial for r in got] == [1, 2, 3, 4, 5] and sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    assert [r.mse for r in sorted(got, key=lambda r: r["rank"])] == sorted(r.mse for r in got)
    best = min(got, key=lambda r: r["rank"])
    x, _ = next_close(df)
    x = x.dropna(subset=["_next"]).select("asset", "_place", "_n", "_f", "_next")
    assert sr.forest_loss(x, {c: best[c] for c in space}, 2, 1) == pytest.approx(best.mse, rel=1e-6)
    variance = x.agg(F.var_pop("_next")).first()[0]
    assert best.mse < 3 * variance
