"""Transforms in steps against numpy's, and the schedule of cycles."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidewater.functions import transform
from tidewater.operators import spectral


def frame(spark, values):
    rows = [(a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(v)) for a, y in values.items() for k, v in enumerate(y)]
    return spark.createDataFrame(rows, "asset string, bar timestamp_ntz, close double").repartition(3)


def test_any_length(spark):
    """Primes, powers, one and two values, and a series of many strips."""
    rng = np.random.default_rng(4)
    values = {f"n{n}": rng.normal(100, 5, n) for n in (1, 2, 3, 4, 7, 31, 64, 97, 5003)}
    got = transform.transformed(frame(spark, values), "close").toPandas()
    for a, y in values.items():
        g = got[got.asset == a].sort_values("k")
        want = np.fft.fft(y)
        assert g.k.tolist() == list(range(len(y))) and set(g.n) == {len(y)}
        np.testing.assert_allclose(g.re + 1j * g.im, want, rtol=0, atol=1e-9 * np.abs(want).max())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1000, 4_000_000])
def test_groups_are_short(n):
    r, c = transform.lengths(n)
    assert r <= n and r * c >= 2 * n - 1 and r * c <= max(1, 4 * n) and c <= 2 * r
    if n == 4_000_000:
        assert (r, c) == (2048, 4096)


def test_spectrum_and_dates(spark):
    t = np.arange(60)
    x = frame(spark, {"a": 3 * np.cos(2 * np.pi * (t - 4) / 20) + np.cos(2 * np.pi * (t - 2) / 6)})
    s = {r.k: r for r in spectral.spectrum(x).collect()}
    assert len(s) == 30 and s[3].magnitude == pytest.approx(90) and s[10].magnitude == pytest.approx(30)
    assert s[3].phase == pytest.approx(-2 * np.pi * 4 / 20)
    dates = [(r.rank, r.turn, r.at) for r in spectral.cycle_dates(spectral.spectrum(x), 2).orderBy("rank", "turn").collect()]
    assert [d[:2] for d in dates] == [(1, 0), (1, 1), (1, 2)] + [(2, k) for k in range(10)]
    assert [d[2] for d in dates[:3]] == pytest.approx([16, 36, 56])  # a phase of -4 bars, as time in front of the first crest
    assert [d[2] for d in dates[3:5]] == pytest.approx([4, 10])
