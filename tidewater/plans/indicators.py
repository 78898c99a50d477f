"""Queries of the technical indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.ordered import change, full, over_chunks, simple_return
from tidewater.operators import indicators as ind
from tidewater.plans import base as b
from tidewater.plans.base import query
from tidewater.sources.series import bars, daily, hourly, order_days, ticks


def out(df, *cols, places=6):
    return df.select("asset", "bar", *(F.round(c, places).alias(c) for c in cols))


RSI_SIMPLE = f"d AS (SELECT *, close - lag(close) {b.W} AS d FROM bars), g AS (SELECT *, {b.full(14, 'CASE WHEN d IS NOT NULL THEN greatest(d, 0) END')} AS g, {b.full(14, 'CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END')} AS l FROM d), rs AS (SELECT *, CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM g)"


@query("rsi_simple", f"{b.HOURLY}, {RSI_SIMPLE} SELECT asset, bar, round(rsi, 6) AS rsi FROM rs")
def rsi_simple(spark, d):
    return out(ind.rsi_simple(hourly(spark, d)), "rsi")


@query("rsi_wilder", f"{b.DAILY_RECURSIVE}, d AS (SELECT *, close - lag(close) {b.W} AS d FROM bars), u AS (SELECT asset, bar, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS v FROM d), {b.recurrence('u', 'u', 'g', '(1.0/14)', 14)}, {b.recurrence('u', 'v', 'l', '(1.0/14)', 14)} SELECT bars.asset, bars.bar, round(CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi FROM bars LEFT JOIN g_r USING (asset, bar) LEFT JOIN l_r USING (asset, bar)")
def rsi_wilder(spark, d):
    return out(ind.rsi_wilder(daily(spark, d)), "rsi", places=4)


@query("bbands", f"{b.HOURLY}, m AS (SELECT asset, bar, {b.full(20, 'close')} AS m, {b.full(20, 'close', 'stddev_pop')} AS s FROM bars) SELECT asset, bar, round(m - 2 * s, 6) AS bb_low, round(m, 6) AS bb_mid, round(m + 2 * s, 6) AS bb_high FROM m")
def bbands(spark, d):
    return out(over_chunks(hourly(spark, d), 20, ind.bollinger()), "bb_low", "bb_mid", "bb_high")


TR = f"tr AS (SELECT *, lag(close) {b.W} AS pc FROM bars), tr2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM tr)"


@query("atr", f"{b.DAILY_RECURSIVE}, {TR}, {b.recurrence('tr2', 'tr', 'a', '(1.0/14)', 14)} SELECT bars.asset, bars.bar, round(a, 4) AS atr FROM bars LEFT JOIN a_r USING (asset, bar)")
def atr(spark, d):
    return out(ind.atr(daily(spark, d)), "atr", places=4)


@query("atr_simple", f"{b.HOURLY}, x AS (SELECT *, abs(close - lag(close) {b.W}) AS a FROM bars) SELECT asset, bar, round({b.full(14, 'a')}, 6) AS atr_simple FROM x")
def atr_simple(spark, d):
    return out(over_chunks(hourly(spark, d), 15, lambda w: {"_a": F.abs(change(w, "close"))}, lambda w: {"atr_simple": full(w, 14, "_a")}), "atr_simple")


STOCH = f"k AS (SELECT *, 100 * (close - {b.full(14, 'low', 'min')}) / nullif({b.full(14, 'high', 'max')} - {b.full(14, 'low', 'min')}, 0) AS k FROM bars), k3 AS (SELECT *, {b.full(3, 'k')} AS stoch_k FROM k), k4 AS (SELECT *, {b.full(3, 'stoch_k')} AS stoch_d FROM k3)"


@query("stoch", f"{b.HOURLY}, {STOCH} SELECT asset, bar, round(stoch_k, 6) AS stoch_k, round(stoch_d, 6) AS stoch_d FROM k4")
def stoch(spark, d):
    return out(over_chunks(hourly(spark, d), 20, *ind.stochastic()), "stoch_k", "stoch_d")


@query("obv", f"{b.HOURLY}, x AS (SELECT *, coalesce(sign(close - lag(close) {b.W}), 0) * volume AS v FROM bars) SELECT asset, bar, sum(v) OVER (PARTITION BY asset ORDER BY bar ROWS UNBOUNDED PRECEDING) AS obv FROM x")
def obv(spark, d):
    return ind.obv(hourly(spark, d)).select("asset", "bar", "obv")


@query("cci", f"{b.HOURLY}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *, {b.full(14, 'tp')} AS m, list(tp) {b.rows(14)} AS l FROM t) SELECT asset, bar, round((tp - m) / nullif(0.015 * (list_sum(list_transform(l, lambda x: abs(x - m))) / 14), 0), 4) AS cci FROM m")
def cci(spark, d):
    return out(over_chunks(hourly(spark, d), 14, *ind.cci()), "cci", places=4)


@query("vwap", f"{b.HOURLY} SELECT asset, bar, round(sum((high + low + close) / 3 * volume) OVER v / nullif(sum(volume) OVER v, 0), 6) AS vwap FROM bars WINDOW v AS (PARTITION BY asset, bar::DATE ORDER BY bar ROWS UNBOUNDED PRECEDING)")
def vwap(spark, d):
    return out(ind.vwap(hourly(spark, d)), "vwap")


MFI = f"f AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), f2 AS (SELECT *, tp * volume AS f, tp - lag(tp) {b.W} AS d FROM f), f3 AS (SELECT *, {b.full(14, 'CASE WHEN d IS NOT NULL THEN CASE WHEN d > 0 THEN f ELSE 0.0 END END', 'sum')} AS up, {b.full(14, 'CASE WHEN d IS NOT NULL THEN CASE WHEN d < 0 THEN f ELSE 0.0 END END', 'sum')} AS dn FROM f2), mf AS (SELECT *, 100 * up / nullif(up + dn, 0) AS mfi FROM f3)"


@query("mfi", f"{b.HOURLY}, {MFI} SELECT asset, bar, round(mfi, 6) AS mfi FROM mf")
def mfi(spark, d):
    return out(over_chunks(hourly(spark, d), 15, *ind.mfi()), "mfi")


WILLR = f"-100 * ({b.full(14, 'high', 'max')} - close) / nullif({b.full(14, 'high', 'max')} - {b.full(14, 'low', 'min')}, 0)"


@query("willr", f"{b.HOURLY} SELECT asset, bar, round({WILLR}, 6) AS willr FROM bars")
def willr(spark, d):
    return out(over_chunks(hourly(spark, d), 14, ind.williams()), "willr")


def _share(n: int) -> str:
    return f"({b.full(n, 'bp', 'sum')}) / nullif({b.full(n, 'tr', 'sum')}, 0)"


UO = f"p AS (SELECT *, lag(close) {b.W} AS pc FROM bars), p2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END AS bp, CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END AS tr FROM p), u AS (SELECT *, 100 * (4 * {_share(7)} + 2 * {_share(14)} + {_share(28)}) / 7 AS uo FROM p2)"


@query("ultimate", f"{b.HOURLY}, {UO} SELECT asset, bar, round(uo, 6) AS uo FROM u")
def ultimate(spark, d):
    return out(over_chunks(hourly(spark, d), 29, *ind.ultimate()), "uo")


MACD = f"{b.recurrence('bars', 'close', 'fa', '(2.0/13)', 12)}, {b.recurrence('bars', 'close', 'sl', '(2.0/27)', 26)}, mc AS (SELECT asset, bar, fa - sl AS macd FROM fa_r JOIN sl_r USING (asset, bar)), {b.recurrence('mc', 'macd', 'sg', '(2.0/10)', 9)}"
ORDERS = "bars AS (SELECT o_orderpriority AS asset, date_trunc('day', o_orderdate)::TIMESTAMP AS bar, avg(o_totalprice) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL)"


MACD_SQL = f"WITH RECURSIVE {ORDERS}, {MACD} SELECT bars.asset, bars.bar, round(macd, 3) AS macd, round(sg, 3) AS macd_signal, round(macd - sg, 3) AS macd_hist FROM bars LEFT JOIN mc USING (asset, bar) LEFT JOIN sg_r USING (asset, bar)"


@query("macd", MACD_SQL)
def macd(spark, d):
    return out(ind.macd(order_days(spark, d)), "macd", "macd_signal", "macd_hist", places=3)


@query("macd_all_orders", MACD_SQL)
def macd_all_orders(spark, d):
    return out(ind.macd(order_days(spark, d)), "macd", "macd_signal", "macd_hist", places=3)


ADX = f"{TR}, mv AS (SELECT *, high - lag(high) {b.W} AS up, lag(low) {b.W} - low AS dn FROM tr2), dm AS (SELECT asset, bar, tr, CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END END AS p, CASE WHEN up IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END END AS m FROM mv), {b.recurrence('dm', 'p', 'ps', '(1.0/14)', 14)}, {b.recurrence('dm', 'm', 'ms', '(1.0/14)', 14)}, {b.recurrence('dm', 'tr', 'ts', '(1.0/14)', 14)}, di AS (SELECT asset, bar, 100 * ps / nullif(ts, 0) AS plus_di, 100 * ms / nullif(ts, 0) AS minus_di FROM ps_r JOIN ms_r USING (asset, bar) JOIN ts_r USING (asset, bar)), dx AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di), {b.recurrence('dx', 'dx', 'ax', '(1.0/14)', 14)}"


@query("adx", f"{b.DAILY_RECURSIVE}, {ADX} SELECT bars.asset, bars.bar, round(plus_di, 4) AS plus_di, round(minus_di, 4) AS minus_di, round(ax, 4) AS adx FROM bars LEFT JOIN di USING (asset, bar) LEFT JOIN ax_r USING (asset, bar)")
def adx(spark, d):
    return out(ind.adx(daily(spark, d)), "plus_di", "minus_di", "adx", places=4)


TRIX = f"{b.recurrence('bars', 'close', 'e1', '(2.0/15)', 14)}, {b.recurrence('e1_r', 'e1', 'e2', '(2.0/15)', 14)}, {b.recurrence('e2_r', 'e2', 'e3', '(2.0/15)', 14)}, tx AS (SELECT bars.asset, bars.bar, 100 * (e3 / nullif(lag(e3) OVER (PARTITION BY bars.asset ORDER BY bars.bar), 0) - 1) AS trix FROM bars LEFT JOIN e3_r ON e3_r.asset = bars.asset AND e3_r.bar = bars.bar)"


TRIX_SQL = f"WITH RECURSIVE {ORDERS}, {TRIX} SELECT asset, bar, round(trix, 4) AS trix, round({b.full(9, 'trix')}, 4) AS trix_signal FROM tx"


@query("trix", TRIX_SQL)
def trix(spark, d):
    return out(ind.trix(order_days(spark, d)), "trix", "trix_signal", places=4)


@query("trix_all_orders", TRIX_SQL)
def trix_all_orders(spark, d):
    return out(ind.trix(order_days(spark, d)), "trix", "trix_signal", places=4)


TSI = f"d AS (SELECT *, close - lag(close) {b.W} AS d FROM bars), da AS (SELECT asset, bar, d, abs(d) AS a FROM d), {b.recurrence('da', 'd', 'd1', '(2.0/26)', 25)}, {b.recurrence('d1_r', 'd1', 'd2', '(2.0/14)', 13)}, {b.recurrence('da', 'a', 'a1', '(2.0/26)', 25)}, {b.recurrence('a1_r', 'a1', 'a2', '(2.0/14)', 13)}, tv AS (SELECT asset, bar, 100 * d2 / nullif(a2, 0) AS tsi FROM d2_r JOIN a2_r USING (asset, bar)), {b.recurrence('tv', 'tsi', 'tg', '(2.0/14)', 13)}"


TSI_SQL = f"WITH RECURSIVE {ORDERS}, {TSI} SELECT bars.asset, bars.bar, round(tsi, 4) AS tsi, round(tg, 4) AS tsi_signal FROM bars LEFT JOIN tv USING (asset, bar) LEFT JOIN tg_r USING (asset, bar)"


@query("tsi", TSI_SQL)
def tsi(spark, d):
    return out(ind.tsi(order_days(spark, d)), "tsi", "tsi_signal", places=4)


@query("tsi_all_orders", TSI_SQL)
def tsi_all_orders(spark, d):
    return out(ind.tsi(order_days(spark, d)), "tsi", "tsi_signal", places=4)


@query("keltner", f"{b.DAILY_RECURSIVE}, {TR}, {b.recurrence('tr2', 'tr', 'a', '(1.0/9)', 9)}, {b.recurrence('bars', 'close', 'e', '(2.0/10)', 9)} SELECT bars.asset, bars.bar, round(e - 0.1 * a, 4) AS kc_low, round(e, 4) AS kc_mid, round(e + 0.1 * a, 4) AS kc_high FROM bars LEFT JOIN a_r USING (asset, bar) LEFT JOIN e_r USING (asset, bar)")
def keltner(spark, d):
    return out(ind.keltner(daily(spark, d)), "kc_low", "kc_mid", "kc_high", places=4)


@query("momentum_volume", f"{b.HOURLY} SELECT asset, bar, round(close - lag(close, 10) {b.W}, 6) AS momentum, round(volume / nullif(lag(volume) {b.W}, 0) - 1, 6) AS volume_change, round({b.full(5, 'volume')}, 6) AS volume_sma_5, round({b.full(10, 'volume')}, 6) AS volume_sma_10 FROM bars")
def momentum_volume(spark, d):
    return out(over_chunks(hourly(spark, d), 10, lambda w: {"momentum": change(w, "close", 10), "volume_change": simple_return(w, "volume"), "volume_sma_5": full(w, 5, "volume"), "volume_sma_10": full(w, 10, "volume")}), "momentum", "volume_change", "volume_sma_5", "volume_sma_10")


@query("feature_table", f"""{b.HOURLY}, r AS (SELECT *, close / nullif(lag(close) {b.W}, 0) - 1 AS ret, abs(close - lag(close) {b.W}) AS a, 100 * (close - {b.full(14, 'low', 'min')}) / nullif({b.full(14, 'high', 'max')} - {b.full(14, 'low', 'min')}, 0) AS k FROM bars)
SELECT asset, bar, round(ret, 6) AS ret, round({b.full(5, 'close')}, 6) AS sma_5, round({b.full(10, 'close')}, 6) AS sma_10, round({b.full(5, 'ret', 'stddev_samp')}, 6) AS volatility, round({b.full(14, 'a')}, 6) AS atr_simple, round({b.full(20, 'close')} - 2 * {b.full(20, 'close', 'stddev_samp')}, 6) AS bb_low, round(k, 6) AS stoch_k, round({b.full(3, 'k')}, 6) AS stoch_d, hour(bar)::INTEGER AS hour, (isodow(bar) - 1)::INTEGER AS weekday, lag(close, 3) {b.W} AS lag_3 FROM r""")
def feature_table(spark, d):
    x = ind.features(hourly(spark, d))
    return x.select("asset", "bar", *(F.round(c, 6).alias(c) for c in ("ret", "sma_5", "sma_10", "volatility", "atr_simple", "bb_low", "stoch_k", "stoch_d")), "hour", "weekday", "lag_3")


def _adjusted(span: int) -> str:
    """The weighted mean with all weights of a span, over their sum, of row k from 0."""
    return f"sum(close * pow(1 - 2.0/{span + 1}, -k)) OVER v / sum(pow(1 - 2.0/{span + 1}, -k)) OVER v"


def _plain(span: int) -> str:
    """The same where the first value has weight one and all others 2 / (span + 1)."""
    return f"pow(1 - 2.0/{span + 1}, k) * sum(CASE WHEN k = 0 THEN close ELSE 2.0/{span + 1} * close * pow(1 - 2.0/{span + 1}, -k) END) OVER v"


@query("macd_lines", f"{b.HOURLY}, n AS (SELECT *, row_number() {b.W} - 1 AS k FROM bars) SELECT asset, bar, round({_adjusted(12)} - {_adjusted(26)}, 6) AS adjusted, round({_plain(12)} - {_plain(26)}, 6) AS plain FROM n WINDOW v AS (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING)")
def macd_lines(spark, d):
    """The line of two more definitions of exponential means."""
    return out(ind.macd_line(ind.macd_line(hourly(spark, d), "adjusted", True), "plain", False), "adjusted", "plain", places=6)


_hlc3 = f"{b._bars('hour').replace('bars AS', 'raw AS')}, bars AS (SELECT asset, bar, h AS open, h AS high, h AS low, h AS close, volume FROM (SELECT *, (high + low + close) / 3 AS h FROM raw))"


@query("oscillators_hlc3", f"WITH {b.TICKS}, {_hlc3}, {RSI_SIMPLE}, {MFI}, {STOCH} SELECT bars.asset, bars.bar, round(rsi, 5) AS rsi, round(mfi, 5) AS mfi, round(stoch_k, 5) AS stoch_k FROM bars JOIN rs USING (asset, bar) JOIN mf USING (asset, bar) JOIN k3 USING (asset, bar)")
def oscillators_hlc3(spark, d):
    """Oscillators over the mean of high, low and close instead of the close."""
    x = ind.single_price(hourly(spark, d).withColumn("close", ind.typical()))
    k, smooth, _ = ind.stochastic()
    return out(ind.rsi_simple(over_chunks(x, 20, *ind.mfi(), k, smooth).drop("_d")), "rsi", "mfi", "stoch_k", places=5)


_quarters = "bars AS (SELECT asset, time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS bar, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM ticks GROUP BY ALL)"


@query("features_15min", f"WITH {b.TICKS}, {_quarters}, r AS (SELECT *, close / nullif(lag(close) {b.W}, 0) - 1 AS ret FROM bars) SELECT asset, bar, round(ret, 6) AS ret, round({b.full(20, 'close')}, 6) AS sma_5, round({b.full(40, 'close')}, 6) AS sma_10, round({b.full(20, 'ret', 'stddev_samp')}, 6) AS volatility FROM r")
def features_15min(spark, d):
    """The feature table over quarters of an hour, whose windows are four times as many bars."""
    at = F.window(F.col("ts").cast("timestamp"), "15 minutes").start.cast("timestamp_ntz")
    return out(ind.features(bars(ticks(spark, d), at), "15min"), "ret", "sma_5", "sma_10", "volatility")


#: Every indicator of indicators.all_indicators() over bars, as ai.
ALL_INDICATORS = f"""{RSI_SIMPLE}, {MFI}, {UO}, {STOCH}, {MACD}, {TRIX}, {TSI[TSI.index("da AS"):]}, {ADX}, {b.recurrence('tr2', 'tr', 'tra', '(1.0/14)', 14)}, {b.recurrence('bars', 'close', 'em', '(2.0/15)', 14)},
x1 AS (SELECT *, (high + low + close) / 3 AS tp, {WILLR} AS willr, {b.full(20, 'close')} AS bb_mid, {b.full(20, 'close', 'stddev_pop')} AS sd, {b.full(14, 'high - low')} AS adr, {b.full(50, 'close')} AS sma_50, {b.full(200, 'close')} AS sma_200, sum((high + low + close) / 3 * volume) OVER v / nullif(sum(volume) OVER v, 0) AS vwap, coalesce(sign(close - lag(close) {b.W}), 0) * volume AS ov FROM bars WINDOW v AS (PARTITION BY asset, bar::DATE ORDER BY bar ROWS UNBOUNDED PRECEDING)),
x2 AS (SELECT *, {b.full(14, 'tp')} AS tm, list(tp) {b.rows(14)} AS tl, sum(ov) OVER (PARTITION BY asset ORDER BY bar ROWS UNBOUNDED PRECEDING) AS obv FROM x1),
x3 AS (SELECT asset, bar, trix, {b.full(9, 'trix')} AS trix_signal FROM tx),
ai AS (SELECT x2.asset, x2.bar, x2.close, rs.rsi, bb_mid - 2 * sd AS bb_low, bb_mid + 2 * sd AS bb_high, (x2.tp - tm) / nullif(0.015 * (list_sum(list_transform(tl, lambda x: abs(x - tm))) / 14), 0) AS cci, vwap, em AS ema, adr, tra AS atr, obv, macd, sg AS macd_signal, ax AS adx, mfi, trix, trix_signal, tsi, tg AS tsi_signal, willr, uo, stoch_k, stoch_d, sma_50, sma_200
 FROM x2 JOIN rs USING (asset, bar) JOIN mf USING (asset, bar) JOIN u USING (asset, bar) JOIN k4 USING (asset, bar) LEFT JOIN mc USING (asset, bar) LEFT JOIN sg_r USING (asset, bar) LEFT JOIN x3 USING (asset, bar) LEFT JOIN tv USING (asset, bar) LEFT JOIN tg_r USING (asset, bar) LEFT JOIN ax_r USING (asset, bar) LEFT JOIN tra_r USING (asset, bar) LEFT JOIN em_r USING (asset, bar))"""
SHOWN = "rsi bb_low bb_high vwap ema adr atr macd macd_signal adx mfi trix trix_signal tsi tsi_signal willr uo stoch_k stoch_d".split()


@query("indicator_table", f"{b.HOURLY}, {ALL_INDICATORS} SELECT asset, bar, {', '.join(f'round({c}, 4) AS {c}' for c in SHOWN)}, round(cci, 3) AS cci, obv FROM ai")
def indicator_table(spark, d):
    """Every indicator of the exported document."""
    return ind.all_indicators(hourly(spark, d)).select("asset", "bar", *(F.round(c, 4).alias(c) for c in SHOWN), F.round("cci", 3).alias("cci"), "obv")


@query("feature_table_full", f"{b.HOURLY}, {RSI_SIMPLE}, {b.recurrence('bars', 'close', 'q5', '(2.0/6)', 5)}, {b.recurrence('bars', 'close', 'q10', '(2.0/11)', 10)}, n AS (SELECT *, row_number() {b.W} - 1 AS k FROM bars), ml AS (SELECT asset, bar, {_adjusted(12)} - {_adjusted(26)} AS macd_line FROM n WINDOW v AS (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING)) SELECT rs.asset, rs.bar, round(rsi, 5) AS rsi, round(q5, 5) AS ema_5, round(q10, 5) AS ema_10, round(macd_line, 5) AS macd_line FROM rs LEFT JOIN q5_r USING (asset, bar) LEFT JOIN q10_r USING (asset, bar) LEFT JOIN ml USING (asset, bar)")
def feature_table_full(spark, d):
    """What the full feature table has beside the windows of feature_table."""
    return out(ind.full_features(hourly(spark, d)), "rsi", "ema_5", "ema_10", "macd_line", places=5)
