"""Queries of all rules, gated and long-only strategies, trades with costs, orders, and trades by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.ordered import crossed_over, crossed_under, over_chunks
from tidewater.operators import indicators as ind
from tidewater.operators import signals as sig
from tidewater.operators.pairs import pair_sums
from tidewater.plans import base as b
from tidewater.plans.base import query
from tidewater.plans.indicators import ALL_INDICATORS, MACD, MFI, TR, WILLR
from tidewater.sources.series import daily, hourly, order_periods

SIDES = ("buy", "sell")
_flags = ", ".join(f"coalesce({c}, false) AS {r}_{n}" for r, both in sig.RULES.items() for c, n in zip(both, SIDES, strict=True))


@query("signals_all_rules", f"{b.HOURLY}, {ALL_INDICATORS} SELECT asset, bar, {_flags} FROM ai")
def signals_all_rules(spark, d):
    """Every simple rule on every bar."""
    return ind.all_indicators(hourly(spark, d)).select("asset", "bar", *(sig.flag(c).alias(f"{r}_{n}") for r, both in sig.RULES.items() for c, n in zip(both, SIDES, strict=True)))


def crossing(a: str, level: float | str, over: bool):
    """A column of a window: a crosses a level (or another column) upwards or downwards."""
    to = F.col(level) if isinstance(level, str) else F.lit(level)
    return lambda w: (crossed_over if over else crossed_under)(w, F.col(a), to)


def acted(x, buy, sell):
    return x.withColumn("signal", sig.signal(buy, sell)).filter("signal <> 0").select("asset", "bar", "close", "signal")


RSI_WILDER = f"wd AS (SELECT *, close - lag(close) {b.W} AS d FROM bars), wu AS (SELECT asset, bar, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS v FROM wd), {b.recurrence('wu', 'u', 'wg', '(1.0/14)', 14)}, {b.recurrence('wu', 'v', 'wl', '(1.0/14)', 14)}, wr AS (SELECT asset, bar, CASE WHEN wl = 0 THEN 100.0 ELSE 100 - 100 / (1 + wg / wl) END AS rsi FROM wg_r JOIN wl_r USING (asset, bar))"


def _cross(x: str, level: str, over: bool) -> str:
    return f"coalesce({x} > {level} AND lag({x}) {b.W} <= {level}, false)" if over else f"coalesce({x} < {level} AND lag({x}) {b.W} >= {level}, false)"


@query("strategy_combined_cross", f"""{b.HOURLY}, {MFI}, {RSI_WILDER}, c AS (SELECT bars.*, mfi, rsi FROM bars JOIN mf USING (asset, bar) LEFT JOIN wr USING (asset, bar)), c2 AS (SELECT *, {WILLR} AS willr, 100 * (close - {b.full(14, 'low', 'min')}) / nullif({b.full(14, 'high', 'max')} - {b.full(14, 'low', 'min')}, 0) AS stoch FROM c),
c3 AS (SELECT asset, bar, close, {_cross('mfi', '20', True)} AS buy, {_cross('mfi', '80', False)} OR {_cross('rsi', '70', False)} OR ({_cross('willr', '-20', False)} AND {_cross('stoch', '20', False)}) AS sell FROM c2) SELECT asset, bar, close, CASE WHEN sell THEN -1 ELSE 1 END::INTEGER AS signal FROM c3 WHERE buy OR sell""")
def strategy_combined_cross(spark, d):
    """Buys as money flow crosses 20 upwards; sells as it crosses 80 downwards, or strength 70, or both oscillators cross."""
    raw, _, _ = ind.stochastic()
    x = ind.rsi_wilder(over_chunks(hourly(spark, d), 16, *ind.mfi(), ind.williams(), raw).drop("_d"))
    of = {"up": ("mfi", 20.0, True), "m": ("mfi", 80.0, False), "r": ("rsi", 70.0, False), "w": ("willr", -20.0, False), "s": ("_k", 20.0, False)}
    x = over_chunks(x, 1, lambda w: {k: crossing(*v)(w) for k, v in of.items()})
    return acted(x, F.col("up"), F.col("m") | F.col("r") | (F.col("w") & F.col("s")))


@query("strategy_keltner", f"{b.HOURLY}, {TR}, {b.recurrence('tr2', 'tr', 'a', '(1.0/9)', 9)}, {b.recurrence('bars', 'close', 'e', '(2.0/10)', 9)}, c AS (SELECT bars.asset, bars.bar, close, e - 0.1 * a AS lo, e + 0.1 * a AS hi FROM bars LEFT JOIN a_r USING (asset, bar) LEFT JOIN e_r USING (asset, bar)), c2 AS (SELECT *, lag(close) {b.W} AS pc, lag(lo) {b.W} AS pl, lag(hi) {b.W} AS ph FROM c) SELECT asset, bar, close, CASE WHEN close < hi AND pc >= ph THEN -1 ELSE 1 END::INTEGER AS signal FROM c2 WHERE (close > lo AND pc <= pl) OR (close < hi AND pc >= ph)")
def strategy_keltner(spark, d):
    """Buys as the price crosses the lower band upwards, sells as it crosses the upper one downwards."""
    x = over_chunks(ind.keltner(hourly(spark, d)), 1, lambda w: {"up": crossing("close", "kc_low", True)(w), "down": crossing("close", "kc_high", False)(w)})
    return acted(x, F.col("up"), F.col("down"))


#: MACD strategies that money flow can trigger as well: name, levels of the crosses, money flow below which to buy and above
#: which to sell (none: never).
GATED = (("cross_or_oversold", -2.0, 1.5, 5.0, None), ("cross_or_both", -0.2, 1.0, 8.0, 85.0))


def _gated(lo: float, hi: float, under: float, over: float | None) -> str:
    sell = f"(macd < sg AND lm >= ls AND macd > {hi})" + (f" OR mfi > {over}" if over else "")
    return f"CASE WHEN coalesce({sell}, false) THEN -1 WHEN coalesce((macd > sg AND lm <= ls AND macd < {lo}) OR mfi < {under}, false) THEN 1 ELSE 0 END::INTEGER"


@query("strategy_macd_mfi", f"{b.HOURLY}, {MACD}, {MFI}, x AS (SELECT mf.asset, mf.bar, mfi, macd, sg, lag(macd) OVER q AS lm, lag(sg) OVER q AS ls FROM mf LEFT JOIN mc USING (asset, bar) LEFT JOIN sg_r USING (asset, bar) WINDOW q AS (PARTITION BY mf.asset ORDER BY mf.bar)), s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, asset, bar, {_gated(*g)} AS signal FROM x" for n, *g in GATED) + ") SELECT * FROM s WHERE signal <> 0")
def strategy_macd_mfi(spark, d):
    x = ind.macd(over_chunks(hourly(spark, d), 16, *ind.mfi()))
    x = over_chunks(x, 1, lambda w: {"up": crossing("macd", "macd_signal", True)(w), "down": crossing("macd", "macd_signal", False)(w)})
    parts = []
    for name, lo, hi, under, over in GATED:
        buy = (F.col("up") & (F.col("macd") < lo)) | sig.flag(f"mfi < {under}")
        sell = (F.col("down") & (F.col("macd") > hi)) | (sig.flag(f"mfi > {over}") if over else F.lit(False))
        parts.append(F.struct(F.lit(name).alias("strategy"), sig.signal(buy, sell).alias("signal")))
    return x.select("asset", "bar", F.explode(F.array(*parts)).alias("s")).select("s.strategy", "asset", "bar", "s.signal").filter("signal <> 0")


SINCE = "2024-01-10"


def _flow(since: str | None) -> str:
    return f"{MFI}, ms AS (SELECT asset, bar, open, close, mfi, lag(mfi) {b.W} AS lm FROM mf), sx AS (SELECT asset, bar, open, close, CASE WHEN mfi < 80 AND lm >= 80 THEN -1 ELSE 1 END::INTEGER AS signal FROM ms WHERE ((mfi > 20 AND lm <= 20) OR (mfi < 80 AND lm >= 80)){f" AND bar >= TIMESTAMP '{since}'" if since else ''})"


MFI_SIGNALS = _flow(SINCE)
_LONG = "lr AS (SELECT *, lag(signal) OVER (PARTITION BY asset ORDER BY bar) AS p FROM sx), lo AS (SELECT asset, bar, open, close, signal FROM lr WHERE p IS DISTINCT FROM signal AND bar >= (SELECT min(bar) FROM sx f WHERE f.asset = lr.asset AND f.signal = 1))"
LONG, LONG_ALL = f"{MFI_SIGNALS}, {_LONG}", f"{_flow(None)}, {_LONG}"


def flow_signals(spark, d, since: str | None = SINCE):
    x = over_chunks(hourly(spark, d), 16, *ind.mfi(), lambda w: {"up": crossing("mfi", 20.0, True)(w), "down": crossing("mfi", 80.0, False)(w)})
    x = x.withColumn("signal", sig.signal(F.col("up"), F.col("down"))).filter(F.col("signal") != 0)
    return x.filter(F.col("bar") >= F.lit(since).cast("timestamp_ntz")) if since else x


@query("strategy_long_only", f"{b.HOURLY}, {LONG} SELECT asset, bar, close, signal FROM lo")
def strategy_long_only(spark, d):
    """From a date on, a position is opened once and closed as a whole."""
    return sig.long_only(flow_signals(spark, d)).select("asset", "bar", "close", "signal")


@query("strategy_one_day", f"{b.HOURLY}, {MFI_SIGNALS} SELECT asset, bar, close, signal FROM sx WHERE bar >= TIMESTAMP '2024-01-15' AND bar < TIMESTAMP '2024-01-16'")
def strategy_one_day(spark, d):
    """Signals of one day only."""
    return flow_signals(spark, d).filter(F.to_date("bar") == F.lit("2024-01-15").cast("date")).select("asset", "bar", "close", "signal")


@query("buys_and_sells", f"{b.HOURLY}, {LONG_ALL} SELECT asset, bar, 'buy' AS side, open AS price FROM lo WHERE signal = 1 UNION ALL SELECT asset, bar, 'sell', close FROM lo WHERE signal = -1")
def buys_and_sells(spark, d):
    """Buys at the open and sells at the close, in one list."""
    x = sig.long_only(flow_signals(spark, d, None))
    side = lambda s, name, c: x.filter(F.col("signal") == s).select("asset", "bar", F.lit(name).alias("side"), F.col(c).alias("price"))
    return side(1, "buy", "open").unionByName(side(-1, "sell", "close")).orderBy("asset", "bar")


@query("trades_with_costs", f"""{b.HOURLY.replace("WITH", "WITH RECURSIVE", 1)}, {LONG_ALL}, tb AS (SELECT asset, open AS bought, row_number() {b.W} AS k FROM lo WHERE signal = 1), tsl AS (SELECT asset, close AS sold, row_number() {b.W} AS k FROM lo WHERE signal = -1), tp AS (SELECT * FROM tb JOIN tsl USING (asset, k)),
fo AS (SELECT DISTINCT asset, 0::BIGINT AS k, 10000.0::DOUBLE AS c FROM tp UNION ALL SELECT tp.asset, tp.k, c / bought * sold - 0.001 * (bought + sold) FROM fo JOIN tp ON tp.asset = fo.asset AND tp.k = fo.k + 1)
SELECT asset, max(k) AS trades, round(last(c ORDER BY k), 2) AS final_capital, round(last(c ORDER BY k) - 10000, 2) AS profit FROM fo GROUP BY asset""")
def trades_with_costs(spark, d):
    x = buys_and_sells(spark, d)
    of = lambda s: x.filter(F.col("side") == s).drop("side")
    return sig.traded_with_costs(of("buy"), of("sell")).select("asset", "trades", F.round("final_capital", 2).alias("final_capital"), F.round("profit", 2).alias("profit"))


@query("order_sizes", f"{b.DAILY}, l AS (SELECT asset, last(close ORDER BY bar) AS price FROM bars GROUP BY asset) SELECT asset, round(price * (1 - 0.006::DOUBLE), 6) AS limit_price, round(10000 / nullif(price * (1 - 0.006::DOUBLE), 0) * 0.99::DOUBLE, 6) AS size, round(10000 / nullif(price * (1 - 0.006::DOUBLE), 0) * 0.99::DOUBLE * (1 - 0.006::DOUBLE), 6) AS fee_adjusted_size, floor(10000 / nullif(price, 0))::BIGINT AS whole_shares FROM l")
def order_sizes(spark, d):
    """What orders of 10,000 at a fee of 0.6 per cent would be; none is placed."""
    x = daily(spark, d).groupBy("asset").agg(F.max_by("close", "bar").alias("price"))
    return x.select("asset", *(c.cast("bigint").alias(n) if n == "whole_shares" else F.round(c, 6).alias(n) for n, c in sig.order_size(F.lit(10_000.0), F.col("price"), 0.006).items()))


def _orders(unit: str) -> str:
    return f"WITH bars AS (SELECT o_orderpriority AS asset, date_trunc('{unit}', o_orderdate)::TIMESTAMP AS bar, sum(round(o_totalprice * 100)::BIGINT) AS close FROM orders GROUP BY ALL), pairs AS (SELECT a.asset, a.bar AS buy, b.bar AS sell, b.close - a.close AS profit, date_diff('day', a.bar, b.bar) AS days FROM bars a JOIN bars b ON a.asset = b.asset AND a.bar < b.bar AND b.close > a.close)"


@query("monthly_trades", f"{_orders('week')}, g AS (SELECT asset, date_trunc('month', buy)::TIMESTAMP AS month, sum(profit) AS profit, avg(profit) AS mp, avg(days) AS md, count(*) AS n FROM pairs GROUP BY ALL), e AS (SELECT asset, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM g GROUP BY asset) SELECT asset, month, coalesce(profit, 0)::BIGINT AS profit, mp AS mean_profit, md AS mean_days, coalesce(n, 0) AS trades FROM e LEFT JOIN g USING (asset, month)")
def monthly_trades(spark, d):
    """Profits in cents: sums are whole numbers, and means divide once, so that nothing is rounded."""
    return sig.monthly_trades(pair_sums(order_periods(spark, d, "week")))


@query("buy_sell_matrix", f"{_orders('month')}, dates AS (SELECT DISTINCT buy FROM pairs), sells AS (SELECT DISTINCT sell FROM pairs) SELECT buy, sell, coalesce(avg(profit), 0) AS profit FROM dates CROSS JOIN sells LEFT JOIN pairs USING (buy, sell) GROUP BY ALL")
def buy_sell_matrix(spark, d):
    """The mean profit of every date of buying and every date of selling, as rows."""
    return sig.buy_sell_cells(sig.pair_profits(order_periods(spark, d, "month")))
