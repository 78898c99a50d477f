"""Queries of signals, strategies, backtests and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.ordered import crossed_over, crossed_under, full, over_chunks
from tidewater.functions.selection import percentiles
from tidewater.operators import indicators as ind
from tidewater.operators import signals as sig
from tidewater.operators.cross import correlation
from tidewater.operators.pairs import best_pairs
from tidewater.plans import base as b
from tidewater.plans.base import query
from tidewater.plans.indicators import ALL_INDICATORS, MACD, MFI, ORDERS, RSI_SIMPLE, STOCH, UO, WILLR
from tidewater.sources.series import daily, hourly, order_days


def indicated(bars):
    """Bars with the indicators of the combined rule; each is one stage over chunks, all but the last in one pass."""
    k, d, e = ind.stochastic()
    x = over_chunks(bars, 50, *ind.mfi(), ind.williams(), *ind.ultimate(), k, d, e).drop("_f", "_d", "_up", "_dn", "_bp", "_tr", "_k")
    return ind.rsi_simple(x)


ALL = f"{RSI_SIMPLE}, {MFI}, {UO}, {STOCH}, w AS (SELECT asset, bar, {WILLR} AS willr FROM bars), ai AS (SELECT bars.asset, bars.bar, bars.close, rsi, mfi, uo, stoch_k, willr FROM bars JOIN rs USING (asset, bar) JOIN mf USING (asset, bar) JOIN u USING (asset, bar) JOIN k4 USING (asset, bar) JOIN w USING (asset, bar))"
SIGNAL = "CASE WHEN coalesce(mfi > 79.5, false) OR coalesce(rsi > 70, false) OR (coalesce(willr > -20, false) AND coalesce(uo > 70, false) AND coalesce(stoch_k > 80, false)) THEN -1 WHEN coalesce(mfi < 20.5, false) THEN 1 ELSE 0 END"


def signalled(spark, d):
    return indicated(hourly(spark, d)).withColumn("signal", sig.signal(*sig.combined()))


@query("signals_combined", f"{b.HOURLY}, {ALL} SELECT asset, bar, close, {SIGNAL}::INTEGER AS signal FROM ai")
def signals_combined(spark, d):
    return signalled(spark, d).select("asset", "bar", "close", "signal")


@query("signals_trading_hours", f"{b.HOURLY}, {ALL}, s AS (SELECT asset, bar, close, {SIGNAL}::INTEGER AS signal FROM ai) SELECT asset, bar, close, signal FROM s WHERE signal <> 0 AND hour(timezone('America/New_York', timezone('UTC', bar))) BETWEEN 9 AND 15")
def signals_trading_hours(spark, d):
    return signalled(spark, d).filter((F.col("signal") != 0) & sig.trading_hours()).select("asset", "bar", "close", "signal")


@query("signals_simple", f"{b.HOURLY}, {ALL} SELECT asset, bar, coalesce(rsi < 30, false) AS rsi_buy, coalesce(rsi > 70, false) AS rsi_sell, coalesce(willr < -80, false) AS williams_buy, coalesce(willr > -20, false) AS williams_sell, coalesce(uo < 30, false) AS ultimate_buy, coalesce(uo > 70, false) AS ultimate_sell, coalesce(stoch_k < 20, false) AS stochastic_buy, coalesce(stoch_k > 80, false) AS stochastic_sell FROM ai")
def signals_simple(spark, d):
    return indicated(hourly(spark, d)).select("asset", "bar", *(sig.flag(sig.RULES[k][j]).alias(f"{k}_{n}") for k in ("rsi", "williams", "ultimate", "stochastic") for j, n in enumerate(("buy", "sell"))))


@query("signal_runs", f"{b.HOURLY}, {ALL}, s AS (SELECT asset, bar, close, {SIGNAL}::INTEGER AS signal FROM ai), n AS (SELECT * FROM s WHERE signal <> 0) SELECT asset, bar, close, signal FROM (SELECT *, lag(signal) {b.W} AS p FROM n) WHERE p IS DISTINCT FROM signal")
def signal_runs(spark, d):
    return sig.run_starts(signalled(spark, d).filter("signal <> 0")).select("asset", "bar", "close", "signal")


@query("latest_signal", f"{b.HOURLY}, {ALL}, s AS (SELECT asset, bar, close, {SIGNAL}::INTEGER AS signal FROM ai) SELECT asset, bar, signal, close FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY bar DESC, signal) AS k FROM s WHERE signal <> 0) WHERE k = 1")
def latest_signal(spark, d):
    return sig.latest(signalled(spark, d))


@query("backtest_alternating", f"""{b.HOURLY.replace("WITH", "WITH RECURSIVE", 1)}, {ALL}, s AS (SELECT asset, bar, close, {SIGNAL}::INTEGER AS signal FROM ai),
n AS (SELECT *, lag(signal) {b.W} AS p FROM s WHERE signal <> 0 AND close > 0), a AS (SELECT asset, bar, close, signal, row_number() {b.W} AS k FROM n WHERE p IS DISTINCT FROM signal),
fo AS (SELECT asset, 0::BIGINT AS k, 50000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, 0::BIGINT AS trades FROM a WHERE k = 1
 UNION ALL SELECT a.asset, a.k, CASE WHEN signal = 1 AND shares = 0 AND floor(cash / close) > 0 THEN cash - floor(cash / close) * close WHEN signal = -1 AND shares > 0 THEN cash + shares * close ELSE cash END,
 CASE WHEN signal = 1 AND shares = 0 AND floor(cash / close) > 0 THEN floor(cash / close) WHEN signal = -1 AND shares > 0 THEN 0.0 ELSE shares END,
 CASE WHEN (signal = 1 AND shares = 0 AND floor(cash / close) > 0) OR (signal = -1 AND shares > 0) THEN trades + 1 ELSE trades END FROM fo JOIN a ON a.asset = fo.asset AND a.k = fo.k + 1),
e AS (SELECT asset, last(cash ORDER BY k) AS cash, last(shares ORDER BY k) AS shares, last(trades ORDER BY k) AS trades FROM fo GROUP BY asset), l AS (SELECT asset, last(close ORDER BY bar) AS last_close FROM bars GROUP BY asset)
SELECT l.asset, coalesce(trades, 0) AS trades, round(coalesce(cash + shares * last_close, 50000.0), 2) AS final_capital FROM l LEFT JOIN e USING (asset)""")
def backtest_alternating(spark, d):
    return sig.alternating_backtest(signalled(spark, d)).select("asset", "trades", F.round("final_capital", 2).alias("final_capital"))


@query("pullback", f"{b.HOURLY}, {ALL_INDICATORS}, l AS (SELECT *, lag(macd) {b.W} AS lm, lag(macd_signal) {b.W} AS ls FROM ai) SELECT asset, bar, coalesce(rsi > 70, false) OR coalesce(close > bb_high, false) OR coalesce(macd < macd_signal AND lm >= ls, false) OR coalesce(close > sma_50 AND close > sma_200, false) AS pullback FROM l")
def pullback(spark, d):
    x = over_chunks(ind.all_indicators(hourly(spark, d)), 1, lambda w: {"bearish": crossed_under(w, F.col("macd"), F.col("macd_signal"))})
    return x.select("asset", "bar", (sig.flag("rsi > 70") | sig.flag("close > bb_high") | F.col("bearish") | sig.flag("close > sma_50 and close > sma_200")).alias("pullback"))


@query("crossover_sma", f"{b.HOURLY}, m AS (SELECT asset, bar, {b.full(5, 'close')} AS a, {b.full(20, 'close')} AS c FROM bars), l AS (SELECT *, lag(a) {b.W} AS la, lag(c) {b.W} AS lc FROM m) SELECT asset, bar, coalesce(a > c AND la <= lc, false) AS crossed_over, coalesce(a < c AND la >= lc, false) AS crossed_under FROM l")
def crossover_sma(spark, d):
    x = over_chunks(hourly(spark, d), 25, lambda w: {"a": full(w, 5, "close"), "c": full(w, 20, "close")}, lambda w: {"crossed_over": crossed_over(w, F.col("a"), F.col("c")), "crossed_under": crossed_under(w, F.col("a"), F.col("c"))})
    return x.select("asset", "bar", "crossed_over", "crossed_under")


#: Level-gated crosses of MACD and its signal: name, level below which crosses over buy, above which crosses under sell.
MACD_STRATEGIES = (("narrow", -0.05, 0.14), ("finest", -0.0002, 0.001), ("wide", -2.0, 1.5), ("middle", -0.2, 1.0))


MACD_SIGNALS = f"WITH RECURSIVE {ORDERS}, {MACD}, x AS (SELECT asset, bar, macd, sg, lag(macd) {b.W} AS lm, lag(sg) {b.W} AS ls FROM mc LEFT JOIN sg_r USING (asset, bar)) SELECT strategy, asset, bar, CASE WHEN macd < sg AND lm >= ls AND macd > hi THEN -1 ELSE 1 END::INTEGER AS signal FROM x, (VALUES {', '.join(f'({n!r}, {lo}, {hi})' for n, lo, hi in MACD_STRATEGIES)}) s(strategy, lo, hi) WHERE (macd > sg AND lm <= ls AND macd < lo) OR (macd < sg AND lm >= ls AND macd > hi)"


@query("strategy_macd", MACD_SIGNALS)
def strategy_macd(spark, d):
    return macd_strategies(order_days(spark, d))


@query("strategy_macd_all_orders", MACD_SIGNALS)
def strategy_macd_all_orders(spark, d):
    return macd_strategies(order_days(spark, d))


def macd_strategies(bars):
    x = over_chunks(ind.macd(bars), 1, lambda w: {"up": crossed_over(w, F.col("macd"), F.col("macd_signal")), "down": crossed_under(w, F.col("macd"), F.col("macd_signal"))})
    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in MACD_STRATEGIES)))
    s = x.withColumn("l", levels).withColumn("signal", sig.signal(F.col("up") & (F.col("macd") < F.col("l.lo")), F.col("down") & (F.col("macd") > F.col("l.hi"))))
    return s.filter("signal <> 0").select("l.strategy", "asset", "bar", "signal")


@query("strategy_mfi", f"{b.HOURLY}, {MFI}, x AS (SELECT asset, bar, mfi, lag(mfi) {b.W} AS lm FROM mf) SELECT asset, bar, CASE WHEN mfi < 80 AND lm >= 80 THEN -1 ELSE 1 END::INTEGER AS signal FROM x WHERE (mfi > 20 AND lm <= 20) OR (mfi < 80 AND lm >= 80)")
def strategy_mfi(spark, d):
    x = over_chunks(hourly(spark, d), 16, *ind.mfi(), lambda w: {"up": crossed_over(w, F.col("mfi"), F.lit(20.0)), "down": crossed_under(w, F.col("mfi"), F.lit(80.0))})
    return x.withColumn("signal", sig.signal(F.col("up"), F.col("down"))).filter("signal <> 0").select("asset", "bar", "signal")


PAIRS = "pairs AS (SELECT a.asset, a.bar AS buy, b.bar AS sell, b.close - a.close AS profit, date_diff('day', a.bar, b.bar) AS days FROM bars a JOIN bars b ON a.asset = b.asset AND a.bar < b.bar AND b.close > a.close)"


def pairs(spark, d):
    return sig.pair_profits(daily(spark, d))


@query("profit_pairs", f"{b.DAILY}, {PAIRS} SELECT asset, buy, sell, round(profit, 6) AS profit, days::INTEGER AS days FROM pairs")
def profit_pairs(spark, d):
    return pairs(spark, d).withColumn("profit", F.round("profit", 6))


@query("top_trades", f"{b.DAILY}, {PAIRS} SELECT asset, buy, sell, round(profit, 6) AS profit FROM pairs ORDER BY round(profit, 6) DESC, asset, buy, sell LIMIT 5000")
def top_trades(spark, d):
    """The 5000 most profitable pairs; only chunks that can hold one of them meet."""
    return best_pairs(daily(spark, d), 5000).withColumn("profit", F.round("profit", 6)).orderBy(F.desc("profit"), "asset", "buy", "sell").limit(5000)


@query("best_pair", f"{b.DAILY}, {PAIRS} SELECT asset, round(max(profit), 6) AS profit FROM pairs GROUP BY asset")
def best_pair(spark, d):
    return sig.best_pair(daily(spark, d)).select("asset", F.round("profit", 6).alias("profit"))


@query("trades_by_month", f"{b.DAILY}, {PAIRS} SELECT asset, date_trunc('week', buy)::TIMESTAMP AS week, round(sum(profit), 4) AS total, round(avg(profit), 9) AS mean_profit, count(*) AS trades, round(avg(days), 4) AS mean_days FROM pairs GROUP BY ALL")
def trades_by_month(spark, d):
    """By week of buying, as the data spans a month."""
    g = pairs(spark, d).groupBy("asset", F.date_trunc("week", "buy").cast("timestamp_ntz").alias("week"))
    return g.agg(F.round(F.sum("profit"), 4).alias("total"), F.round(F.avg("profit"), 9).alias("mean_profit"), F.count("*").alias("trades"), F.round(F.avg("days"), 4).alias("mean_days"))


@query("trades_heat", f"{b.DAILY}, {PAIRS} SELECT day(buy)::INTEGER AS buy_day, {', '.join(f'round(coalesce(avg(CASE WHEN isodow(sell) = {k + 1} THEN profit END), 0), 6) AS sell_{k}' for k in range(7))} FROM pairs GROUP BY ALL")
def trades_heat(spark, d):
    x = pairs(spark, d).select(F.day("buy").alias("buy_day"), F.weekday("sell").alias("wd"), "profit").groupBy("buy_day").pivot("wd", list(range(7))).agg(F.avg("profit")).fillna(0.0)
    return x.select("buy_day", *(F.round(str(k), 6).alias(f"sell_{k}") for k in range(7)))


@query("describe_trades", f"{b.DAILY}, {PAIRS} SELECT asset, count(*) AS n, round(avg(profit), 4) AS mean, round(stddev_samp(profit), 4) AS std, round(min(profit), 4) AS min, round(quantile_cont(profit, 0.25), 4) AS q1, round(quantile_cont(profit, 0.5), 4) AS median, round(quantile_cont(profit, 0.75), 4) AS q3, round(max(profit), 4) AS max FROM pairs GROUP BY asset")
def describe_trades(spark, d):
    r = lambda c, n: F.round(c, 4).alias(n)
    x = pairs(spark, d)
    q = percentiles(x, ["asset"], "profit", [0.25, 0.5, 0.75])
    g = x.groupBy("asset").agg(F.count("*").alias("n"), r(F.avg("profit"), "mean"), r(F.stddev_samp("profit"), "std"), r(F.min("profit"), "min"), r(F.max("profit"), "max"))
    return g.join(q, "asset").select("asset", "n", "mean", "std", "min", *(r(F.get("percentiles", F.lit(k)), c) for k, c in enumerate(("q1", "median", "q3"))), "max")


@query("pair_corr", f"{b.DAILY}, {PAIRS} SELECT asset, round(CASE WHEN stddev_pop(profit) * stddev_pop(days) > 0 THEN corr(profit, days) END, 6) AS corr FROM pairs GROUP BY asset")
def pair_corr(spark, d):
    return pairs(spark, d).groupBy("asset").agg(F.round(correlation("profit", "days"), 6).alias("corr"))


@query("day_trade_intended", f"{b.HOURLY}, x AS (SELECT asset, date_trunc('day', bar)::TIMESTAMP AS day, close - min(close) OVER (PARTITION BY asset, bar::DATE ORDER BY bar ROWS UNBOUNDED PRECEDING) AS p FROM bars) SELECT asset, day, round(max(p), 6) AS profit FROM x GROUP BY ALL")
def day_trade_intended(spark, d):
    return sig.day_trade(hourly(spark, d)).withColumn("profit", F.round("profit", 6))


@query("day_trade_reference", f"{b.HOURLY}, x AS (SELECT asset, date_trunc('day', bar)::TIMESTAMP AS day, close, row_number() OVER (PARTITION BY asset, bar::DATE ORDER BY bar) AS k FROM bars) SELECT asset, day, round(greatest(max(close) - max(CASE WHEN k = 1 THEN close END), coalesce(max(CASE WHEN k = 1 THEN close END) - max(CASE WHEN k = 2 THEN close END), 0)), 6) AS profit FROM x GROUP BY ALL")
def day_trade_reference(spark, d):
    return sig.day_trade(hourly(spark, d), "reference").withColumn("profit", F.round("profit", 6))
