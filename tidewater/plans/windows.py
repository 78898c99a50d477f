"""Bars, returns, rolling statistics and weighted means."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.ewm import ema, ewm, rma, span
from tidewater.functions.ordered import change, full, over_chunks, placed, ratio, running, simple_return, trailing
from tidewater.operators.gaps import filled_bars, forward_filled, interpolated
from tidewater.plans import base as b
from tidewater.plans.base import query
from tidewater.sources.series import daily, hourly, minute_bars, ticks

r6 = lambda x: F.round(x, 6)


@query("bars_hourly_ohlcv", f"{b.HOURLY} SELECT * FROM bars")
def bars_hourly(spark, d):
    return hourly(spark, d)


@query("bars_15min_last", f"WITH {b.TICKS} SELECT asset, time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS bar, last(price ORDER BY ts, event_id) AS close FROM ticks GROUP BY ALL")
def bars_15min(spark, d):
    return minute_bars(ticks(spark, d), 15)


GRID = "grid AS (SELECT asset, unnest(generate_series(lo, hi, INTERVAL 1 HOUR))::TIMESTAMP AS bar FROM (SELECT asset, min(bar) AS lo, max(bar) AS hi FROM bars GROUP BY asset)), filled AS (SELECT asset, bar, close FROM grid LEFT JOIN bars USING (asset, bar))"


@query("bars_gapfilled", f"{b.HOURLY}, {GRID} SELECT asset, bar, close FROM filled")
def bars_gapfilled(spark, d):
    return filled_bars(hourly(spark, d).select("asset", "bar", "close"), "hour")


@query("ffill_bfill", f"{b.HOURLY}, {GRID} SELECT asset, bar, close, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bar ROWS UNBOUNDED PRECEDING) AS ffill, first_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM filled")
def ffill_bfill(spark, d):
    return forward_filled(filled_bars(hourly(spark, d).select("asset", "bar", "close"), "hour"))


@query("interp_linear", f"""{b.HOURLY}, {GRID}, n AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN bar END IGNORE NULLS) OVER p AS t0, last_value(close IGNORE NULLS) OVER p AS c0, first_value(CASE WHEN close IS NOT NULL THEN bar END IGNORE NULLS) OVER f AS t1, first_value(close IGNORE NULLS) OVER f AS c1 FROM filled WINDOW p AS (PARTITION BY asset ORDER BY bar ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY asset ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT asset, bar, round(CASE WHEN t0 = t1 THEN c0 ELSE c0 + (c1 - c0) * (epoch(bar) - epoch(t0)) / (epoch(t1) - epoch(t0)) END, 6) AS close FROM n""")
def interp_linear(spark, d):
    return interpolated(filled_bars(hourly(spark, d).select("asset", "bar", "close"), "hour")).withColumn("close", r6("close"))


@query("ret_simple", f"{b.HOURLY} SELECT asset, bar, round(close / nullif(lag(close) {b.W}, 0) - 1, 6) AS ret FROM bars")
def ret_simple(spark, d):
    return over_chunks(hourly(spark, d), 1, lambda w: {"ret": r6(simple_return(w))}).select("asset", "bar", "ret")


@query("ret_log", f"{b.HOURLY} SELECT asset, bar, round(ln(close / nullif(lag(close) {b.W}, 0)), 6) AS log_ret FROM bars")
def ret_log(spark, d):
    return over_chunks(hourly(spark, d), 1, lambda w: {"log_ret": r6(F.log(ratio("close", F.lag("close").over(w))))}).select("asset", "bar", "log_ret")


@query("ret_gapfilled", f"{b.HOURLY}, {GRID}, f AS (SELECT asset, bar, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bar ROWS UNBOUNDED PRECEDING) AS c FROM filled) SELECT asset, bar, round(c / nullif(lag(c) {b.W}, 0) - 1, 6) AS ret FROM f")
def ret_gapfilled(spark, d):
    """Returns over all bars of the grid: a missing bar repeats the price before it, so its return is 0."""
    f = forward_filled(filled_bars(hourly(spark, d).select("asset", "bar", "close"), "hour")).select("asset", "bar", F.col("ffill").alias("close"))
    return over_chunks(f, 1, lambda w: {"ret": r6(simple_return(w))}).select("asset", "bar", "ret")


@query("diff_k", f"{b.HOURLY} SELECT asset, bar, round(close - lag(close, 1) {b.W}, 6) AS diff_1, round(close - lag(close, 10) {b.W}, 6) AS diff_10 FROM bars")
def diff_k(spark, d):
    return over_chunks(hourly(spark, d), 10, lambda w: {f"diff_{k}": r6(change(w, "close", k)) for k in (1, 10)}).select("asset", "bar", "diff_1", "diff_10")


@query("lag_features", f"{b.HOURLY} SELECT asset, bar, {', '.join(f'lag(close, {k}) {b.W} AS lag_{k}' for k in range(1, 11))} FROM bars")
def lag_features(spark, d):
    return over_chunks(hourly(spark, d), 10, lambda w: {f"lag_{k}": F.lag("close", k).over(w) for k in range(1, 11)}).select("asset", "bar", *(f"lag_{k}" for k in range(1, 11)))


@query("sma", f"{b.HOURLY} SELECT asset, bar, round({b.full(14, 'close')}, 6) AS sma_14, round({b.full(50, 'close')}, 6) AS sma_50, round({b.full(200, 'close')}, 6) AS sma_200 FROM bars")
def sma(spark, d):
    return over_chunks(hourly(spark, d), 200, lambda w: {f"sma_{n}": r6(full(w, n, "close")) for n in (14, 50, 200)}).select("asset", "bar", "sma_14", "sma_50", "sma_200")


@query("sma_min1", f"{b.HOURLY} SELECT asset, bar, round(avg(close) {b.rows(3)}, 6) AS season FROM bars")
def sma_min1(spark, d):
    return over_chunks(hourly(spark, d), 3, lambda w: {"season": r6(F.avg("close").over(trailing(w, 3)))}).select("asset", "bar", "season")


@query("prior_ma", f"{b.HOURLY} SELECT asset, bar, round(CASE WHEN row_number() {b.W} > 20 THEN avg(close) OVER (PARTITION BY asset ORDER BY bar ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END, 6) AS prior_ma FROM bars")
def prior_ma(spark, d):
    """The mean of the 20 rows before a row."""
    return over_chunks(hourly(spark, d), 20, lambda w: {"prior_ma": r6(F.when(F.col("_at") >= 20, F.avg("close").over(w.rowsBetween(-20, -1))))}).select("asset", "bar", "prior_ma")


@query("rolling_std", f"{b.HOURLY}, r AS (SELECT asset, bar, close, close / nullif(lag(close) {b.W}, 0) - 1 AS ret FROM bars) SELECT asset, bar, round({b.full(20, 'close', 'stddev_samp')}, 6) AS std_20, round({b.full(5, 'ret', 'stddev_samp')}, 6) AS volatility_5 FROM r")
def rolling_std(spark, d):
    return over_chunks(hourly(spark, d), 21, lambda w: {"ret": simple_return(w)}, lambda w: {"std_20": r6(full(w, 20, "close", F.stddev_samp)), "volatility_5": r6(full(w, 5, "ret", F.stddev_samp))}).select("asset", "bar", "std_20", "volatility_5")


@query("rolling_minmax", f"{b.HOURLY} SELECT asset, bar, {b.full(14, 'low', 'min')} AS low_14, {b.full(14, 'high', 'max')} AS high_14 FROM bars")
def rolling_minmax(spark, d):
    return over_chunks(hourly(spark, d), 14, lambda w: {"low_14": full(w, 14, "low", F.min), "high_14": full(w, 14, "high", F.max)}).select("asset", "bar", "low_14", "high_14")


@query("envelope", f"{b.HOURLY} SELECT asset, bar, min(close) OVER e AS lower, max(close) OVER e AS upper FROM bars WINDOW e AS (PARTITION BY asset ORDER BY bar ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def envelope(spark, d):
    return over_chunks(hourly(spark, d), 1, lambda w: {"lower": F.min("close").over(w.rowsBetween(-1, 1)), "upper": F.max("close").over(w.rowsBetween(-1, 1))}, ahead=1).select("asset", "bar", "lower", "upper")


@query("minmax_scale", f"{b.HOURLY}, m AS (SELECT asset, min(close) AS lo, max(close) AS hi FROM bars GROUP BY asset) SELECT asset, bar, round(CASE WHEN hi = lo THEN -1.0 ELSE 2 * (close - lo) / (hi - lo) - 1 END, 6) AS scaled FROM bars JOIN m USING (asset)")
def minmax_scale(spark, d):
    h = hourly(spark, d)
    m = h.groupBy("asset").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
    return h.join(m, "asset").select("asset", "bar", r6(F.when(F.col("hi") == F.col("lo"), -1.0).otherwise(2 * (F.col("close") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) - 1)).alias("scaled"))


@query("dedupe_first", f"WITH {b.TICKS} SELECT asset, date_trunc('minute', ts)::TIMESTAMP AS ts, first(price ORDER BY ts, event_id) AS price FROM ticks GROUP BY ALL")
def dedupe_first(spark, d):
    """The first price of each minute: a partial aggregate instead of a sort of all rows."""
    return ticks(spark, d).groupBy("asset", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")).agg(F.min_by("price", F.struct(F.col("ts"), F.col("event_id"))).alias("price"))


@query("cumulative", f"{b.DAILY} SELECT asset, bar, round(sum(close) OVER (PARTITION BY asset ORDER BY bar ROWS UNBOUNDED PRECEDING), 4) AS cum_sum, round(exp(sum(ln(close)) OVER (PARTITION BY asset ORDER BY bar ROWS UNBOUNDED PRECEDING) / row_number() {b.W}), 4) AS geo_mean FROM bars")
def cumulative(spark, d):
    x = running(daily(spark, d), {"s": ("sum", F.col("close")), "l": ("sum", F.log("close")), "k": ("sum", F.lit(1))})
    return x.select("asset", "bar", F.round("s", 4).alias("cum_sum"), F.round(F.exp(F.col("l") / F.col("k")), 4).alias("geo_mean"))


def _direct(alpha: str, where: str = "bars") -> str:
    return f"n AS (SELECT asset, bar, close AS x, row_number() {b.W} AS k FROM {where}), y AS (SELECT asset, bar, k, x AS v FROM n WHERE k = 1 UNION ALL SELECT n.asset, n.bar, n.k, (1 - {alpha}) * y.v + {alpha} * n.x FROM y JOIN n ON n.asset = y.asset AND n.k = y.k + 1)"


@query("ewm_adjust_false", f"{b.DAILY_RECURSIVE}, {_direct('(2.0/13)')} SELECT asset, bar, round(v, 4) AS ewm_12 FROM y")
def ewm_adjust_false(spark, d):
    return ewm(daily(spark, d), "close", span(12), "y").select("asset", "bar", F.round("y", 4).alias("ewm_12"))


@query("ewm_adjust_true", f"{b.DAILY}, n AS (SELECT asset, bar, close AS x, row_number() {b.W} AS k FROM bars) SELECT a.asset, a.bar, round(sum(pow(11.0/13, a.k - c.k) * c.x) / sum(pow(11.0/13, a.k - c.k)), 6) AS ewm_12 FROM n a JOIN n c ON c.asset = a.asset AND c.k <= a.k GROUP BY a.asset, a.bar")
def ewm_adjust_true(spark, d):
    return ewm(daily(spark, d), "close", span(12), "y", adjust=True).select("asset", "bar", F.round("y", 6).alias("ewm_12"))


@query("ema_seeded", f"{b.DAILY_RECURSIVE}, {b.recurrence('bars', 'close', 'e', '(2.0/15)', 14)} SELECT bars.asset, bars.bar, round(e, 4) AS ema_14 FROM bars LEFT JOIN e_r ON e_r.asset = bars.asset AND e_r.bar = bars.bar")
def ema_seeded(spark, d):
    return ema(daily(spark, d), "close", 14, "y").select("asset", "bar", F.round("y", 4).alias("ema_14"))


@query("wilder_rma", f"{b.DAILY_RECURSIVE}, {b.recurrence('bars', 'close', 'e', '(1.0/14)', 14)} SELECT bars.asset, bars.bar, round(e, 4) AS rma_14 FROM bars LEFT JOIN e_r ON e_r.asset = bars.asset AND e_r.bar = bars.bar")
def wilder_rma(spark, d):
    return rma(daily(spark, d), "close", 14, "y").select("asset", "bar", F.round("y", 4).alias("rma_14"))


@query("fixed_hold", f"{b.DAILY}, h AS (SELECT asset, bar, lead(bar, 6) {b.W} AS until, lead(close, 6) {b.W} / nullif(close, 0) - 1 AS gain FROM bars) SELECT asset, bar, until, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY gain DESC, bar) AS k FROM h WHERE gain IS NOT NULL) WHERE k = 1")
def fixed_hold(spark, d):
    """The best period of seven bars: the first of those with the largest gain."""
    h = over_chunks(daily(spark, d), 0, lambda w: {"until": F.lead("bar", 6).over(w), "gain": F.lead("close", 6).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1}, ahead=6).filter("gain is not null")
    best = h.groupBy("asset").agg(F.min_by(F.struct("bar", "until", "gain"), F.struct(-F.col("gain"), F.col("bar"))).alias("z"))
    return best.select("asset", "z.bar", "z.until", r6(F.col("z.gain")).alias("gain"))


@query("chunk_average", f"{b.DAILY}, n AS (SELECT asset, close, row_number() {b.W} - 1 AS k, count(*) OVER (PARTITION BY asset) AS n FROM bars) SELECT asset, k // (n // 5) AS part, round(avg(close), 6) AS mean_price FROM n WHERE n >= 5 AND k // (n // 5) < 5 GROUP BY ALL")
def chunk_average(spark, d):
    """Means of five parts of equal length; what is left over at the end is dropped."""
    p = placed(daily(spark, d))
    n = p.groupBy(F.col("asset").alias("_a")).agg(F.count("*").alias("n")).filter("n >= 5")
    x = p.join(n, F.col("asset") == F.col("_a")).withColumn("part", F.floor(F.col("_at") / F.floor(F.col("n") / 5))).filter("part < 5")
    return x.groupBy("asset", "part").agg(r6(F.avg("close")).alias("mean_price"))


@query("train_test_split", f"{b.HOURLY}, n AS (SELECT asset, bar, row_number() {b.W} AS k, count(*) OVER (PARTITION BY asset) AS n FROM bars) SELECT asset, bar, k <= floor(0.8 * n) AS is_train FROM n")
def train_test_split(spark, d):
    p = placed(hourly(spark, d))
    n = p.groupBy(F.col("asset").alias("_a")).agg(F.count("*").alias("n"))
    return p.join(n, F.col("asset") == F.col("_a")).select("asset", "bar", (F.col("_at") + 1 <= F.floor(F.col("n") * 0.8)).alias("is_train"))
