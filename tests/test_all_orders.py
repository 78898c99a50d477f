"""Queries over all orders and all assets, against plain versions."""

from __future__ import annotations

from collections import defaultdict

import pytest

from tidewater.plans.catalogue import QUERIES
from tidewater.plans.signals import MACD_STRATEGIES


def seeded(x: list, n: int) -> list:
    """The exponential mean of the values there are, from the n-th on, seeded by the mean of the first n."""
    out, known, y = [], [], None
    for v in x:
        if v is not None:
            known.append(v)
            y = sum(known) / n if len(known) == n else y + 2 / (n + 1) * (v - y) if y is not None else None
        out.append(None if v is None else y)
    return out


def both(f, a: list, b: list) -> list:
    return [None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)]


@pytest.fixture(scope="module")
def series(spark, small):
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{small}/orders.parquet").collect():
        orders[r.o_orderpriority, r.o_orderdate.replace(hour=0, minute=0, second=0, microsecond=0)].append(float(r.o_totalprice))
    out = defaultdict(list)
    for (asset, bar), x in sorted(orders.items()):
        out[asset].append((bar, sum(x) / len(x)))
    return out


def plain(series, name: str) -> dict:
    out = {}
    for asset, s in series.items():
        x = [v for _, v in s]
        before = [None, *x[:-1]]
        if name == "macd":
            m = both(lambda a, b: a - b, seeded(x, 12), seeded(x, 26))
            columns = [m, seeded(m, 9)]
        elif name == "trix":
            e = seeded(seeded(seeded(x, 14), 14), 14)
            columns = [both(lambda a, b: 100 * (a / b - 1), e, [None, *e[:-1]])]
        else:
            d = both(lambda a, b: a - b, x, before)
            a = [None if v is None else abs(v) for v in d]
            columns = [both(lambda p, q: 100 * p / q, seeded(seeded(d, 25), 13), seeded(seeded(a, 25), 13))]
        out |= {(asset, bar): v for (bar, _), *v in zip(s, *columns, strict=True)}
    return out


@pytest.mark.parametrize(("name", "columns"), [("macd", ("macd", "macd_signal")), ("trix", ("trix",)), ("tsi", ("tsi",))])
def test_all_orders(spark, small, series, name, columns):
    got = {(r.asset, r.bar): [r[c] for c in columns] for r in QUERIES[f"{name}_all_orders"](spark, small).collect()}
    want = plain(series, name)
    assert max(bar.year for _, bar in want) > 1995
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-3)


def test_strategy_all_orders(spark, small, series):
    want, last = set(), {}
    for (asset, bar), (m, s) in plain(series, "macd").items():
        a, b = last.get(asset, (None, None))
        last[asset] = (m, s)
        if None in (m, s, a, b):
            continue
        for name, low, high in MACD_STRATEGIES:
            if m < s and a >= b and m > high:
                want.add((name, asset, bar, -1))
            elif m > s and a <= b and m < low:
                want.add((name, asset, bar, 1))
    assert set(map(tuple, QUERIES["strategy_macd_all_orders"](spark, small).collect())) == want


@pytest.mark.parametrize("name", ["mcmc_paths", "jump_diffusion"])
def test_every_asset(spark, small, name):
    assets = {r[0] for r in spark.read.parquet(f"{small}/events.parquet").select("event_type").distinct().collect()}
    found = QUERIES[name](spark, small).toPandas()
    assert set(found["asset"]) == assets
    assert found["n" if name == "mcmc_paths" else "kept"].min() > 0
