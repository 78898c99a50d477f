"""Posterior samples: sums by chunks, known noise, coverage, agreement of chains."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidewater.operators import posterior as po

N, STEPS = 84, 7


@pytest.fixture(scope="module")
def made():
    """Series of a trend with one change, a week and noise: those seen, and what came after."""
    out = {}
    for k in range(40):
        rng = np.random.default_rng(k)
        at = np.arange(N + STEPS)
        y = 100 + rng.normal(0, 0.3) * at + rng.normal(0, 0.3) * np.maximum(0, at - 40) + rng.normal(0, 3) * np.sin(2 * np.pi * at / 7) + rng.normal(0, 2.0, len(at))
        out[f"s{k}"] = y
    return out


@pytest.fixture(scope="module")
def frame(spark, made):
    rows = [(a, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float(v)) for a, y in made.items() for k, v in enumerate(y[:N])]
    return spark.createDataFrame(rows, "asset string, bar timestamp_ntz, close double").repartition(4).cache()


def test_sums_by_chunks(frame, made):
    a = {r.asset: r for r in po.series_sums(frame, 4, 10).collect()}
    for r in po.series_sums(frame, 4).collect():
        np.testing.assert_allclose(a[r.asset].xx, r.xx, rtol=1e-9, atol=1e-9)
        y = made[r.asset][:N]
        z, x = (y - y.mean()) / y.std(), po.design(np.arange(N, dtype=float), N, 4)
        np.testing.assert_allclose(r.xx, (x.T @ x).ravel(), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(r.xy, x.T @ z, rtol=1e-9, atol=1e-9)
        assert r.yy == pytest.approx(z @ z)


def test_draws_have_the_closed_form():
    """With much data the draws' mean is that of least squares with the prior, and the noise is the true one."""
    rng = np.random.default_rng(0)
    at = np.arange(3000, dtype=float)
    x = po.design(at, 3000, 2)
    y = x @ rng.normal(0, 1, x.shape[1]) + rng.normal(0, 0.5, 3000)
    beta, noise = po.gibbs(x.T @ x, x.T @ y, y @ y, 3000, po.prior_precision(2), 2000, 200, rng)
    want = np.linalg.solve(x.T @ x / 0.25 + np.diag(po.prior_precision(2)), x.T @ y / 0.25)
    spread = np.sqrt(np.diag(np.linalg.inv(x.T @ x / 0.25 + np.diag(po.prior_precision(2)))))
    assert np.abs(beta.mean(0) - want).max() < 5 * (spread / np.sqrt(2000)).max() + 0.1 * spread.max()
    np.testing.assert_allclose(beta.std(0), spread, rtol=0.15)
    assert np.sqrt(noise.mean()) == pytest.approx(0.5, rel=0.05)


def test_coverage(frame, made):
    """Bands of 95 per cent hold about so many of the prices that came after."""
    got = po.posterior_forecast(frame, STEPS, 4, 300).collect()
    assert len(got) == 40 * STEPS
    inside = [r.low <= made[r.asset][N + r.step - 1] <= r.high for r in got]
    assert 0.88 < np.mean(inside) <= 1.0
    assert max(r.agreement for r in got) < 1.05
    assert np.mean([r.high - r.low for r in got]) < 30
    again = {(r.asset, r.step): r.mean for r in po.posterior_forecast(frame.repartition(1), STEPS, 4, 300, chunk=20).collect()}
    assert all(again[r.asset, r.step] == pytest.approx(r.mean, rel=1e-6) for r in got)


def test_forecasts_are_not_negative(spark):
    rows = [("down", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), 10.0 - k / 3) for k in range(30)]
    got = po.posterior_forecast(spark.createDataFrame(rows, "asset string, bar timestamp_ntz, close double"), 5, 2, 100).collect()
    assert len(got) == 5 and all(0 <= r.low <= r.mean <= r.high for r in got)
