"""Best trades from tables of chunks: any chunks give what the whole series gives."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.operators import trades


def plain_trades(p: list[float], most: int) -> float:
    free, held = [0.0] * (most + 1), [-np.inf] * (most + 1)
    for x in p:
        for k in range(most, 0, -1):
            free[k] = max(free[k], held[k] + x)
            held[k] = max(held[k], free[k - 1] - x)
    return max(free)


def plain_selection(opens, closes, most: int) -> float:
    days, best = range(len(opens)), 0.0
    for n in range(1, most + 1):
        for b in itertools.combinations(days, n):
            for s in itertools.combinations(days, n):
                best = max(best, sum(closes[j] - opens[i] for i in b for j in s if j > i))
    return best


def series(spark, values: dict[str, list[tuple[float, float]]]):
    rows = [(a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), o, c) for a, x in values.items() for k, (o, c) in enumerate(x)]
    return spark.createDataFrame(rows, "asset string, bar timestamp_ntz, open double, close double").repartition(3)


@pytest.mark.parametrize(("chunk", "fan"), [(1, 2), (100, 2), (8192, 64)])
def test_multi_trades(spark, chunk, fan):
    rng = random.Random(2)
    values = {a: [(0.0, rng.uniform(1, 9)) for _ in range(n)] for a, n in (("long", 1000 if chunk > 1 else 60), ("one", 1))} | {"down": [(0.0, 9.0 - k) for k in range(9)]}
    got = {r.asset: r for r in trades.multi_trades(series(spark, values), 7, chunk, fan).collect()}
    for a, x in values.items():
        assert got[a].profit == pytest.approx(plain_trades([c for _, c in x], 7))
    assert (got["down"].trades, got["one"].trades) == (0, 0) and (got["long"].trades <= 7)


@pytest.mark.parametrize("chunk", [2, 100])
def test_selected_pairs(spark, chunk):
    rng = random.Random(6)
    values = {a: [(rng.uniform(1, 9), rng.uniform(1, 9)) for _ in range(n)] for a, n in (("a", 8), ("b", 3), ("c", 1))}
    got = {r.asset: r.profit for r in trades.selected_pairs(series(spark, values), 3, chunk, 2).collect()}
    assert got == pytest.approx({a: plain_selection(*zip(*x, strict=True), 3) for a, x in values.items()})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=2, max_size=40), st.integers(1, 39), st.integers(1, 4))
def test_tables_chain(p, cut, most):
    p, cut = np.array(p, float), min(cut, len(p) - 1)
    whole = trades.one_after_the_other(p, most).ravel()
    parts = trades.chained(trades.one_after_the_other(p[:cut], most).ravel(), trades.one_after_the_other(p[cut:], most).ravel(), most)
    np.testing.assert_array_equal(whole, parts)
    days = pd.DataFrame({"open": p, "close": p[::-1]})
    np.testing.assert_array_equal(trades.selections(days, 2), trades.product(trades.selections(days[:cut], 2), trades.selections(days[cut:], 2)))
