"""The volatility model: derivatives, chunks, known parameters, closed forms."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidewater.operators import volatility as v
from tidewater.session import stored

TRUE = {"a": (0.05, 0.10, 0.85, 0.02, 0.15), "b": (0.40, 0.20, 0.60, -0.05, -0.20)}


def returns(theta, n, seed):
    omega, alpha, beta, c, phi = theta
    rng = np.random.default_rng(seed)
    r, var, last = [], omega / (1 - alpha - beta), 0.0
    for z in rng.standard_normal(n):
        e = np.sqrt(var) * z
        last = c + phi * last + e
        var = omega + alpha * e * e + beta * var
        r.append(last)
    return np.array(r)


def likelihood(u, r, start):
    theta = v.natural(u)
    _, var, _, _ = v.passed(theta, r[1:], r[:-1], start)
    e = r[1:] - theta[3] - theta[4] * r[:-1]
    return -0.5 * (np.log(var) + e * e / var)


@pytest.fixture(scope="module")
def prices(spark):
    rows = []
    for k, (a, theta) in enumerate(TRUE.items()):
        p = 100 * np.exp(np.cumsum(np.concatenate([[0.0], returns(theta, 6000, k)])) / 100)
        rows += [(a, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), float(x)) for i, x in enumerate(p)]
    rows += [("short", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), 1.0 + i) for i in range(9)]
    return spark.createDataFrame(rows, "asset string, bar timestamp_ntz, close double").repartition(4).cache()


@pytest.fixture(scope="module")
def fit(prices):
    return stored(v.fitted(prices, chunk=1000), "fit")


def test_derivatives():
    r, start = returns(TRUE["b"], 300, 5), np.array([1.3, 0, 0, 0, 0, 0])
    u = np.array([-1.2, 1.5, -0.7, 0.1, 0.3])
    theta = v.natural(u)
    e, var, d, _ = v.passed(theta, r[1:], r[:-1], start)
    g = (0.5 * (e * e / var - 1) / var)[:, None] * d
    g[:, 3] += e / var
    g[:, 4] += e * r[:-1] / var
    got = v.slopes(u).T @ g.sum(0)
    for k in range(5):
        h = np.zeros(5)
        h[k] = 1e-6
        assert got[k] == pytest.approx((likelihood(u + h, r, start).sum() - likelihood(u - h, r, start).sum()) / 2e-6, rel=1e-5, abs=1e-5)


def test_chunks_chain():
    r, theta, start = returns(TRUE["a"], 100, 2), np.array(TRUE["a"]), np.array([0.7, 0.1, 0.2, 0.3, 0.4, 0.5])
    whole = v.passed(theta, r[1:], r[:-1], start)[3]
    at = start
    for a, b in ((0, 40), (40, 41), (41, 99)):
        x, lag = r[1:][a:b], r[:-1][a:b]
        at = v.chained(theta, v.passed(theta, x, lag, np.zeros(6))[3], b - a, at)
    np.testing.assert_allclose(at, whole, rtol=1e-10)


def test_known_parameters(fit):
    got = {r.asset: r for r in fit.collect()}
    assert got.keys() == TRUE.keys()  # nine prices are too few
    for a, theta in TRUE.items():
        assert got[a].converged
        for name, want, within in zip(v.NAMES, theta, (0.5, 0.03, 0.06, 0.05, 0.04), strict=True):
            assert getattr(got[a], name) == pytest.approx(want, abs=within * (want if name == "omega" else 1)), (a, name)


def test_no_better_point_nearby(prices, fit):
    """The fit is a maximum of the whole series' likelihood, and doesn't depend on the chunks."""
    whole = {r.asset: r for r in v.fitted(prices.filter("asset = 'b'"), chunk=8192).collect()}["b"]
    part = {r.asset: r for r in fit.collect()}["b"]
    for n in (*v.NAMES, "value", "var"):
        assert getattr(whole, n) == pytest.approx(getattr(part, n), rel=2e-3, abs=2e-4)
    p = np.array([x.close for x in prices.filter("asset = 'b'").orderBy("bar").collect()])
    r = 100 * np.diff(np.log(p))
    theta = np.array([getattr(whole, n) for n in v.NAMES])
    pq = theta[1] + theta[2]
    u = np.array([np.log(theta[0]), np.log(pq / (0.9999 - pq)), np.log(theta[1] / theta[2]), theta[3], np.arctanh(theta[4])])
    lag, now = r[:-1], r[1:]
    phi = np.cov(now, lag, bias=True)[0, 1] / lag.var()
    start = np.array([now.var() - phi * np.cov(now, lag, bias=True)[0, 1], 0, 0, 0, 0, 0])
    best = likelihood(u, r, start).sum()
    assert best == pytest.approx(whole.value, rel=1e-6)
    for k in range(5):
        for s in (-0.02, 0.02):
            h = np.zeros(5)
            h[k] = s
            assert likelihood(u + h, r, start).sum() < best + 1e-6


def test_paths(prices, fit):
    f = {(r.asset, r.step): r for r in v.volatility_forecast(prices, 4, fit).collect()}
    fits = {r.asset: r for r in fit.collect()}
    last = {r._a: r for r in v.last_returns(prices).collect()}
    for a, s in fits.items():
        m1 = s.c + s.phi * last[a].last_return
        assert f[a, 1].mean == pytest.approx(m1) and f[a, 1].sigma == pytest.approx(np.sqrt(s["var"]))
        h2 = s.omega + (s.alpha + s.beta) * s["var"]
        assert f[a, 2].sigma == pytest.approx(np.sqrt(h2 + s.phi**2 * s["var"]))
        m2 = s.c + s.phi * m1
        assert f[a, 2].path == pytest.approx(last[a].last_close * (1 + m1 / 100) * (1 + m2 / 100))
        assert f[a, 2].price_low == pytest.approx(last[a].last_close * np.exp((f[a, 1].low + f[a, 2].low) / 100))
    sims = {(r.asset, r.step): r for r in v.simulated_prices(prices, 3, 20, 2000, 7, fit).collect()}
    for a in TRUE:
        for name, z in (("p05", -1.6449), ("p50", 0.0), ("p95", 1.6449)):
            want = last[a].last_close * np.exp((f[a, 1].mean + z * f[a, 1].sigma) / 100)
            assert getattr(sims[a, 1], name) == pytest.approx(want, rel=6e-4)
    again = {(r.asset, r.step): r for r in v.simulated_prices(prices.repartition(1), 3, 20, 2000, 7, fit.repartition(1)).collect()}
    assert all(again[k].p50 == pytest.approx(sims[k].p50, rel=1e-12) for k in sims)
