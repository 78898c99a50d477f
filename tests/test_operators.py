"""Hand-computed and property tests of the library's operators."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions.ewm import ema, ewm, rma
from tidewater.functions.ordered import full, over_chunks, placed, running, simple_return
from tidewater.operators import calendar, cross, gaps, indicators, markov, models, signals, spectral, text, trades
from tidewater.sources import documents, sinks

DAY = dt.datetime(2024, 3, 1)


def bars(spark, values, asset="a", step=dt.timedelta(hours=1), volume=1.0):
    rows = [(asset, DAY + k * step, *([None if v is None else float(v)] * 4), volume) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "asset string, bar timestamp_ntz, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[0] for r in df.orderBy("bar").select(name).collect()]


def test_places_and_chunks_do_not_change_windows(spark):
    x = bars(spark, [math.sin(k) * 10 + 20 for k in range(97)])
    one = over_chunks(x, 9, lambda w: {"m": full(w, 7, "close"), "r": simple_return(w)})
    many = over_chunks(x, 9, lambda w: {"m": full(w, 7, "close"), "r": simple_return(w)}, chunk=16)
    assert column(one, "m") == column(many, "m")
    assert column(one, "r") == column(many, "r")
    assert column(placed(x), "_at") == list(range(97))
    with pytest.raises(ValueError):
        over_chunks(x, 20, lambda w: {}, chunk=16)


def test_ramp(spark):
    x = bars(spark, range(1, 41))
    assert column(over_chunks(x, 14, lambda w: {"m": full(w, 14, "close")}), "m")[12:15] == [None, 7.5, 8.5]
    assert column(indicators.rsi_simple(x), "rsi")[14:] == [100.0] * 26
    assert column(indicators.rsi_wilder(x), "rsi")[14:] == [100.0] * 26
    assert column(ema(x, "close", 3, "e"), "e")[:5] == [None, None, 2.0, 3.0, 4.0]


def test_constant_series_has_no_range(spark):
    x = bars(spark, [5.0] * 40)
    k, d, e = indicators.stochastic()
    assert set(column(over_chunks(x, 20, k, d, e), "stoch_k")) == {None}
    assert set(column(over_chunks(x, 14, indicators.williams()), "willr")) == {None}
    assert set(column(over_chunks(x, 14, *indicators.cci()), "cci")) == {None}
    both = x.unionByName(x.withColumn("asset", F.lit("b")))
    assert set(column(cross.expanding_correlation(both, "a"), "correlation")) == {None}


def test_short_series_and_single_price(spark):
    x = bars(spark, [1, 2, 3])
    assert column(over_chunks(x, 14, lambda w: {"m": full(w, 14, "close")}), "m") == [None] * 3
    assert column(indicators.macd(x), "macd") == [None] * 3
    assert indicators.single_price(x.withColumn("high", F.lit(9.0))).first()["high"] == 1.0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 1000), min_size=1, max_size=200), st.sampled_from([0.05, 0.3, 0.9]))
def test_weighted_means(spark, values, alpha):
    x, s = bars(spark, values), pd.Series(values)
    for adjust in (False, True):
        np.testing.assert_allclose(column(ewm(x, "close", alpha, "y", adjust=adjust), "y"), s.ewm(alpha=alpha, adjust=adjust).mean(), rtol=1e-9)
    got = pd.Series(column(rma(x, "close", 5, "y"), "y"), dtype=float)
    want = [None] * 4 + list(pd.concat([pd.Series([s[:5].mean()]), s[5:]]).ewm(alpha=0.2, adjust=False).mean()) if len(s) >= 5 else [None] * len(s)
    np.testing.assert_allclose(got, pd.Series(want, dtype=float), rtol=1e-9)


def test_gaps(spark):
    x = bars(spark, [1, 2, 3, 4, 5]).filter(~F.col("close").isin(2, 3)).select("asset", "bar", "close")
    g = gaps.filled_bars(x)
    assert column(g, "close") == [1.0, None, None, 4.0, 5.0]
    assert column(gaps.interpolated(g), "close") == [1.0, 2.0, 3.0, 4.0, 5.0]
    f = gaps.forward_filled(g)
    assert column(f, "ffill") == [1.0, 1.0, 1.0, 4.0, 5.0] and column(f, "bfill") == [1.0, 4.0, 4.0, 4.0, 5.0]


def test_calendar(spark):
    rows = [(dt.datetime(2024, 3, 8, 14, 30),), (dt.datetime(2024, 3, 11, 13, 30),), (dt.datetime(2024, 3, 9, 15, 0),)]
    x = spark.createDataFrame(rows, "bar timestamp_ntz")
    assert [r[0] for r in x.select(signals.trading_hours()).collect()] == [True, True, True]  # 9:30 before and after the change of clocks
    assert calendar.without_weekends(x).count() == 2
    assert [r[0] for r in x.select(calendar.week_of_month("bar")).collect()] == [2, 2, 2]
    assert spark.range(1).select(calendar.clock(F.lit(3725.9)), calendar.day_number(F.lit("wednesday"))).first()[:] == ("01:02:05", 2)


def test_day_trade_modes(spark):
    x = bars(spark, [5, 3, 9, 4])
    assert signals.day_trade(x).first()["profit"] == 6.0
    assert signals.day_trade(x, "reference").first()["profit"] == 4.0
    assert signals.best_pair(x).first()["profit"] == 6.0
    assert trades.multi_trades(bars(spark, [1, 5, 2, 7])).first()[1:] == (2, 9.0)


def test_backtest(spark):
    x = bars(spark, [10, 11, 20, 19, 10]).withColumn("signal", F.element_at(F.array(*map(F.lit, (1, 1, -1, -1, 1))), F.hour("bar") + 1))
    assert signals.alternating_backtest(x, 105.0).first()[1:] == (3, 205.0)  # 10 shares at 10, sold at 20, 20 bought at 10
    assert signals.alternating_backtest(x.withColumn("signal", F.lit(0)), 105.0).first()[1:] == (0, 105.0)
    assert signals.run_starts(x).count() == 3


def test_markov_chain(spark):
    rows = [("a", 0, 1, 1.0), ("a", 1, 0, 0.5), ("a", 1, 2, 0.5), ("a", 2, 1, 1.0)]
    m = spark.createDataFrame(rows, "asset string, from_state int, to_state int, p double")
    np.testing.assert_allclose([r.share for r in markov.steady_state(m).orderBy("state").collect()], [0.25, 0.5, 0.25], atol=1e-9)
    np.testing.assert_allclose([r.steps for r in markov.absorbing_steps(m, 2).orderBy("state").collect()], [4, 3, 1], atol=1e-9)
    t = markov.transitions(bars(spark, [0, 1, 0, 1, 2, 1]).withColumn("state", F.col("close").cast("int")), "state")
    assert {(r.from_state, r.to_state): r.p for r in t.collect()} == {(0, 1): 1.0, (1, 0): 0.5, (1, 2): 0.5, (2, 1): 1.0}
    a = markov.markov_paths(spark, np.array([[0.5, 0.5], [0.1, 0.9]]), 0, 3, 2, 50).orderBy("path").collect()
    b = markov.markov_paths(spark.newSession(), np.array([[0.5, 0.5], [0.1, 0.9]]), 0, 3, 2, 50).orderBy("path").collect()
    assert a == b and sum(r.n for r in a) == 100


def test_spectrum_and_wavelets(spark):
    y = [math.sin(2 * math.pi * 4 * k / 64) + 0.5 * math.sin(2 * math.pi * 9 * k / 64) for k in range(64)]
    x = bars(spark, y)
    s = spectral.spectrum(x)
    assert [r.k for r in spectral.top_cycles(s, 2).orderBy("rank").collect()] == [4, 9]
    np.testing.assert_allclose([r.magnitude for r in s.orderBy("k").collect()], np.abs(np.fft.fft(y))[:32], atol=1e-9)
    energy = spectral.haar(x).agg(F.sum(F.col("coef") ** 2)).first()[0]
    assert energy == pytest.approx(sum(v * v for v in y))
    assert spectral.entropy(bars(spark, [1.0] * 8), ["asset"], "close").first()["entropy"] == 0
    assert spectral.entropy(bars(spark, [0, 1, 2, 3]), ["asset"], "close", 4).first()["entropy"] == 2


def test_portfolio(spark):
    e = spark.createDataFrame([("a", 0.1), ("b", 0.3)], "asset string, expected double")
    assert {r.asset: r.amount for r in cross.allocation(e, 100.0, 0.2).collect()} == {"a": 20.0, "b": 80.0}
    assert cross.allocation(e, 100.0, 0.6).count() == 0
    call, put = spark.range(1).select(*cross.black_scholes(F.lit(100.0), F.lit(100.0), F.lit(1.0), F.lit(0.05), F.lit(0.2))).first()
    assert call == pytest.approx(10.4506, abs=1e-3) and put == pytest.approx(5.5735, abs=1e-3)


def test_models(spark):
    x = bars(spark, [k % 24 * 2.0 + (k % 24) ** 2 for k in range(96)]).withColumn("h", F.hour("bar"))
    r = models.quadratic_trend(x, "asset", "h", "close").first()
    np.testing.assert_allclose([r.c0, r.c1, r.c2, r.band], [0, 2, 1, 0], atol=1e-3)
    d = models.decompose(x).toPandas()
    np.testing.assert_allclose(d.trend + d.seasonal + d.remainder, d.close)
    states, centres = models.kmeans_states(bars(spark, [1, 1.1, 5, 5.1, 9, 9.1]), 3)
    assert column(states, "state") == [0, 0, 1, 1, 2, 2] and len(centres) == 3


def test_documents(spark, tmp_path):
    chart = {"fetched_at": 1000, "data": {"x": {"prices": [[0, 1.5], [3600000, 2.5]], "total_volumes": [[0, 10.0]]}}}
    (tmp_path / "chart-1-day.json").write_text(json.dumps(chart))
    (tmp_path / "bad-1-day.json").write_text("{")
    docs = documents.chart_documents(spark, str(tmp_path), "*1-day*.json")
    rows = documents.chart_series(docs).orderBy("ts").collect()
    assert [(r.asset, r.price, r.volume) for r in rows] == [("x", 1.5, 10.0), ("x", 2.5, None)]
    assert documents.zipped_series(docs).count() == 2
    fresh = lambda now: documents.freshness(docs, spark.createDataFrame([(now,)], "now long")).collect()
    assert [r[:] for r in fresh(2000)] == [("x", 1000, True)] and not fresh(10**9)[0].fresh
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "eth.json").write_text("[[0, 1.0], [1000, 2.0]]")
    assert [(r.asset, r.value) for r in documents.flat_series(spark, str(tmp_path / "flat")).orderBy("ts").collect()] == [("eth", 1.0), ("eth", 2.0)]
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,10\n2024-01-03,2,3,1,2.5,20\n")
    o = documents.ohlcv(spark, str(tmp_path / "p.csv"), "2024-01-02")
    assert o.count() == 1 and documents.column_pairs(o, F.lit("P"), "Close").first()["close"] == [[1704240000000.0, 2.5]]
    (tmp_path / "h.json").write_text(json.dumps({"h1": {"2024-01-01T00:00:00": "1,234.50"}}))
    assert documents.holder_ledger(spark, str(tmp_path / "h.json")).first()["amount"] == 1234.5


def test_sinks(spark, tmp_path):
    x = bars(spark, [1, 2])
    for codec in ("gzip", "none"):
        sinks.write_json(x, str(tmp_path / codec), codec)
        assert spark.read.json(str(tmp_path / codec)).count() == 2
    sinks.write_split(x, str(tmp_path / "split"))
    assert (tmp_path / "split" / "asset=a").is_dir()
    sinks.write_csv(x.select("close"), str(tmp_path / "csv"))
    assert "| 1 | a | 2.0000 |" in sinks.markdown_ranks(x.filter("close = 2"), "close")
    old = spark.createDataFrame([("h", {DAY: 1.0}), ("gone", {DAY: 9.0})], "holder string, history map<timestamp_ntz, double>")
    new = spark.createDataFrame([("h", DAY + dt.timedelta(days=1), 2.0), ("n", DAY, 3.0)], "holder string, ts timestamp_ntz, amount double")
    assert {r.holder: len(r.history) for r in sinks.upsert_histories(old, new).collect()} == {"h": 2, "n": 1}


def test_running_aggregates_over_chunks(spark):
    y = [math.sin(k) * 10 if k % 5 else None for k in range(57)]
    x, s = bars(spark, y), pd.Series(y)
    outs = {"total": ("sum", F.col("close")), "low": ("min", F.col("close")), "top": ("max", F.col("close")), "known": ("last", F.col("close"))}
    got = running(x.drop("low"), outs, chunk=8)
    close = lambda name, want: np.testing.assert_allclose(pd.Series(column(got, name), dtype=float), want, rtol=1e-12)
    close("total", s.fillna(0).cumsum().where(s.notna().cumsum() > 0))
    close("low", s.ffill().cummin())
    close("top", s.ffill().cummax())
    close("known", s.ffill())
    back = running(x, {"next": ("last", F.col("close"))}, chunk=8, backwards=True)
    np.testing.assert_allclose(pd.Series(column(back, "next"), dtype=float), s.bfill())


def test_polynomials_and_p_values(spark):
    rng = np.random.default_rng(4)
    y = [5 + 0.3 * k - 0.01 * k * k + 0.0002 * k**3 + rng.normal() for k in range(60)]
    x = bars(spark, y).withColumn("i", F.unix_timestamp(F.col("bar").cast("timestamp")).cast("double") / 3600 - 474_096)
    at = [r[0] for r in x.orderBy("bar").select("i").collect()]
    got = models.polynomial_trend(x, "asset", "i", "close", 3).first()
    np.testing.assert_allclose(got.coefficients, np.polyfit(at, y, 3)[::-1], rtol=1e-5, atol=1e-4)
    # fixed values of the t distribution
    for t, n, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0), (3.169, 10, 0.01), (-1.96, 1e6, 0.05)):
        assert models.student_p(t, n) == pytest.approx(p, abs=2e-4)


def test_selected_pairs(spark):
    """Against all choices of days."""
    rng = np.random.default_rng(6)
    opened, closed = rng.integers(1, 50, (2, 6)).astype(float)
    x = bars(spark, closed).withColumn("open", F.element_at(F.array(*map(F.lit, opened.tolist())), F.hour("bar") + 1))
    best = 0.0
    for n in (1, 2, 3):
        for buys in itertools.combinations(range(6), n):
            for sells in itertools.combinations(range(6), n):
                best = max(best, sum(closed[s] - opened[b] for b in buys for s in sells if s > b))
    assert trades.selected_pairs(x, 3).first()["profit"] == pytest.approx(best)


def test_cluster_bins(spark):
    x = markov.kmeans_bins(bars(spark, [1, 2, 3, 11, 12, 13, 21, 22, 23]), 3)
    assert column(x, "state") == [0, 0, 1, 1, 1, 2, 2, 2, 3]  # right-closed at the centres 2, 12, 22


def test_halves(spark):
    for n in (1, 2, 5, 8):
        rows = [(k, float(k // 3)) for k in range(n)]
        got = {r.h: r.half for r in cross.halves(spark.createDataFrame(rows, "h int, v double"), "v", "h").collect()}
        ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
        assert got == {h: 1 if k < -(-n // 2) else 2 for k, (h, _) in enumerate(ranked)}


def test_trades_with_costs_and_orders(spark):
    t = lambda rows: spark.createDataFrame([("a", DAY + dt.timedelta(hours=h), p) for h, p in rows], "asset string, bar timestamp_ntz, price double")
    r = signals.traded_with_costs(t([(0, 10.0), (2, 20.0)]), t([(1, 20.0), (3, 10.0), (9, 5.0)]), 100.0, 0.01).first()
    assert r.trades == 2 and r.final_capital == pytest.approx((100 / 10 * 20 - 0.3) / 20 * 10 - 0.3)
    x = bars(spark, [1, 2, 3, 4, 5, 6]).withColumn("signal", F.element_at(F.array(*map(F.lit, (-1, 1, 1, 0, -1, 1))), F.hour("bar") + 1))
    assert column(signals.long_only(x), "signal") == [1, -1, 1]
    size = signals.order_size(F.lit(100.0), F.lit(10.0), 0.1)
    assert spark.range(1).select(*(c.alias(n) for n, c in size.items())).first()[:] == pytest.approx((9.0, 11.0, 9.9, 10))


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(text.clean_symbol(F.lit(s))) for s in ("X:BTCUSD", "eth-usd", "sol")] == ["btc", "eth", "sol"]
    assert [one(text.time_unit(F.lit(s))) for s in ("a-1-MINUTE.json", "b-hourly.json", "c-90-day.json", "d")] == ["Minutes", "Hours", "Days", "Time Units"]
    assert one(text.number(F.lit("1,234.50"))) == 1234.5 and one(text.number(F.lit("x"))) is None and one(text.with_commas(F.lit(1234.5))) == "1,234.50"


def test_resampled_and_schedule(spark):
    assert column(spectral.resampled(bars(spark, [0, 10, 20]), 5).withColumnRenamed("i", "bar"), "close") == [0, 5, 10, 15, 20]
    y = [math.sin(2 * math.pi * 4 * k / 64) for k in range(64)]
    assert [r["at"] for r in spectral.schedule(spectral.spectrum(bars(spark, y))).orderBy("turn").collect()] == [16, 32, 48, 64]


def test_robust_decomposition(spark):
    """More of an outlier stays in the remainder, and its neighbours' share is smaller, than without the weights."""
    y = [10 + k * 0.1 + (3, 0, 0, -1, 0, -2, 0)[k % 7] + (50 if k == 40 else 0) for k in range(84)]
    left = [models.decompose(bars(spark, y), robust=k).toPandas().sort_values("bar", ignore_index=True).remainder for k in (2, 0)]
    assert left[0][40] > max(left[1][40], 45)
    assert left[0].drop(40).abs().mean() < left[1].drop(40).abs().mean()


def test_forecast_scores(spark):
    y = [20 + 5 * math.sin(2 * math.pi * k / 7) + 0.2 * k for k in range(60)]
    grid = spark.createDataFrame([(0, 3, 0.1, 0.01, False), (1, 3, 0.1, 1e6, False)], "config int, changepoints int, trend_ridge double, season_ridge double, multiplicative boolean")
    got = {r.config: (r["rank"], r.rmse) for r in models.forecast_scores(bars(spark, y, step=dt.timedelta(days=1)), grid, 7).collect()}
    assert got[0][0] == 1 and got[0][1] < 0.5 < got[1][1]
