"""Recurrences by composed maps against plain loops, whatever the chunks."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import scan
from tidewater.operators import indicators
from tidewater.plans.catalogue import QUERIES

START = dt.datetime(2024, 1, 1)


def series(spark, values: dict[str, list]):
    rows = [(a, START + dt.timedelta(hours=k), v) for a, x in values.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "asset string, bar timestamp_ntz, x double").repartition(3)


def plain(x: list, step: scan.Mean) -> list:
    out, known, y, num = [], [], None, 0.0
    for v in x:
        if v is not None:
            known.append(v)
            num = num * (1 - step.alpha) + v
            if step.adjust:
                y = num / sum((1 - step.alpha) ** k for k in range(len(known)))
            else:
                y = sum(known) / step.n if len(known) == step.n else y + step.alpha * (v - y) if y is not None else None
        out.append(None if v is None else y)
    return out


STEPS = {"a": scan.ema("x", 3), "b": scan.rma("x", 5), "c": scan.Sum({"a": 1.0, "b": -2.0}), "d": scan.ema("c", 4), "e": scan.ema("d", 2), "f": scan.weighted("x", 6), "g": scan.Mean("x", 1, 1.0)}


def wanted(x: list) -> dict[str, list]:
    out = {"x": x}
    for name, s in STEPS.items():
        if isinstance(s, scan.Sum):
            out[name] = [None if any(out[t][k] is None for t in s.terms) else sum(w * out[t][k] for t, w in s.terms.items()) for k in range(len(x))]
        else:
            out[name] = plain(out[s.x], s)
    return out


@pytest.mark.parametrize(("chunk", "block"), [(1, 2), (7, 3), (8192, 256)])
def test_cascades(spark, chunk, block):
    rng = random.Random(3)
    values = {"long": [rng.uniform(-5, 50) if rng.random() > 0.2 else None for _ in range(120)], "short": [1.0, 2.0], "none": [None] * 9, "late": [None] * 30 + [float(k) for k in range(40)]}
    got = scan.recurrences(series(spark, values).withColumn("a", F.lit(9.0)), STEPS, chunk=chunk, block=block).toPandas().sort_values(["asset", "bar"])
    for asset, x in values.items():
        for name, want in wanted(x).items():
            np.testing.assert_allclose(got[got.asset == asset][name].astype(float), np.array(want, float), rtol=1e-9, atol=1e-9, err_msg=f"{asset} {name}")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=90), st.integers(1, 40))
def test_maps_compose(x, cut):
    """A chunk's map takes what any chunk before it hands on, seeds and nulls included."""
    steps, size = STEPS, sum(isinstance(s, scan.Mean) for s in STEPS.values())
    v = np.array([np.nan if t is None else t for t in x])
    values = lambda a, b, runs: {"x": scan.Values(np.pad(np.nan_to_num(v[a:b])[:, None], ((0, 0), (0, runs - 1))), ~np.isnan(v[a:b]), int((~np.isnan(v[:a])).sum()))}
    whole = scan.run(steps, values(0, len(v), 1), np.zeros((size, 1)))[1][:, 0]
    maps = [np.roll(scan.run(steps, values(a, a + cut, size + 1), np.eye(size, size + 1, 1))[1], -1, axis=1) for a in range(0, len(v), cut)]
    np.testing.assert_allclose(scan.composed(iter(maps), size)[:, size], whole, rtol=1e-6, atol=1e-6 * max(1.0, np.nanmax(np.abs(v), initial=0)))


def test_long_strips():
    """Powers stay finite for quick and slow means over long chunks."""
    x = np.random.default_rng(0).normal(size=(5000, 1))
    for alpha in (1e-6, 0.5, 0.999999, 1.0):
        y, want = scan.faded(x, 1 - alpha, alpha, np.array([3.0])), 3.0
        for k in range(len(x)):
            want = (1 - alpha) * want + alpha * x[k, 0]
            assert abs(y[k, 0] - want) < 1e-9


def test_indicators_in_chunks(spark, small, monkeypatch):
    """Every indicator is the same over chunks of 40 bars."""
    from tidewater.sources.series import hourly

    x = hourly(spark, small)
    want = indicators.all_indicators(x).toPandas().sort_values(["asset", "bar"], ignore_index=True)
    real = scan.recurrences
    monkeypatch.setattr(indicators, "recurrences", lambda df, steps: real(df, steps, chunk=40, block=4))
    got = indicators.all_indicators(x).toPandas().sort_values(["asset", "bar"], ignore_index=True)[want.columns]
    for c in want.columns[2:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-7, err_msg=c)


def test_no_rows(spark):
    assert scan.recurrences(series(spark, {}), STEPS).count() == 0
    assert "macd" in QUERIES
