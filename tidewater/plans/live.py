"""Queries of live streams: indicators with typed state, signals from a log, refused signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans import base as b
from tidewater.plans.base import query
from tidewater.session import own_folder
from tidewater.sources.series import ticks
from tidewater.sources.signal_log import log_stream
from tidewater.streaming.delivery import delivered
from tidewater.streaming.indicators import STATE, TOLD, live_indicators
from tidewater.streaming.operators import tick_stream
from tidewater.streaming.signals import accepted, checked, dead_letters

LIVE = f"""WITH {b.TICKS}, bars AS (SELECT asset, ts AS bar, price AS close, volume FROM ticks), d AS (SELECT *, close - lag(close) {b.W} AS d FROM bars),
u AS (SELECT asset, bar, greatest(d, 0) AS u, greatest(-d, 0) AS v, abs(d) AS r FROM d WHERE d IS NOT NULL),
{b.recurrence('u', 'u', 'g', '(1.0/14)', 14)}, {b.recurrence('u', 'v', 'l', '(1.0/14)', 14)}, {b.recurrence('u', 'r', 'atr', '(1.0/14)', 14)},
{b.recurrence('bars', 'close', 'ema', '(2.0/15)', 14)}, {b.recurrence('bars', 'close', 'f', '(2.0/13)', 12)}, {b.recurrence('bars', 'close', 's', '(2.0/27)', 26)},
m AS (SELECT asset, bar, f - s AS macd FROM f_r JOIN s_r USING (asset, bar)), {b.recurrence('m', 'macd', 'macd_signal', '0.2', 9)},
w AS (SELECT asset, bar, close AS price, row_number() {b.W} AS n, {b.full(14, 'close')} AS sma, {b.full(20, 'close')} AS mid, {b.full(20, 'close', 'stddev_pop')} AS dev, sum(coalesce(sign(d), 0) * volume) {b.W[:-1]} ROWS UNBOUNDED PRECEDING) AS obv FROM d)
SELECT asset, bar, n, price, round(sma, 6) AS sma, round(ema, 6) AS ema, round(CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(atr, 6) AS atr,
 round(mid - 2 * dev, 6) AS bb_low, round(mid, 6) AS bb_mid, round(mid + 2 * dev, 6) AS bb_high, round(obv, 6) AS obv
FROM w LEFT JOIN ema_r USING (asset, bar) LEFT JOIN g_r USING (asset, bar) LEFT JOIN l_r USING (asset, bar) LEFT JOIN m USING (asset, bar) LEFT JOIN macd_signal_r USING (asset, bar) LEFT JOIN atr_r USING (asset, bar) WHERE n >= 20"""


@query("stream_live_indicators", LIVE)
def stream_live_indicators(spark, d):
    """Every tick's indicators from the twentieth on. What tells the time on at the end of the log: a row without a price behind
    every tick, by more than the watermark's delay."""
    both = F.array(F.struct("ts", "price"), F.struct((F.col("ts") + F.expr("interval 2 hours 1 second")).alias("ts"), F.lit(None).cast("double").alias("price")))
    x = tick_stream(spark, d).withColumn("_e", F.explode(both)).select("asset", "_e.ts", "event_id", "_e.price", "volume")
    x = delivered(live_indicators(x), conf=STATE)
    return x.select("asset", F.col("ts").cast("timestamp_ntz").alias("bar"), "n", "price", *(F.round(c, 6).alias(c) for c in TOLD))


def written_log(spark, d) -> str:
    """The events as lines of a signal log, some of them faulty, some written twice."""
    e = ticks(spark, d).withColumn("k", F.col("event_id") % 20)
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    late = F.date_format(F.col("ts") + F.expr("interval 121 seconds"), "yyyy-MM-dd HH:mm:ss")
    said = F.struct(
        F.when(F.col("k") == 2, "hold").when(F.col("event_id") % 3 == 0, "sell").otherwise("buy").alias("type"),
        F.when(F.col("k") == 3, "two words").otherwise(F.concat(F.upper("asset"), F.lit("/USD"))).alias("symbol"),
        F.when(F.col("k") == 4, -1.0).when(F.col("k") != 1, 1 + F.abs("price")).alias("price"),
        F.when(F.col("k") == 5, "soon").otherwise(at).alias("timestamp"), F.when(F.col("k") == 6, late).otherwise(at).alias("arrived"),
    )
    lines = e.withColumn("_twice", F.explode(F.when(F.col("k") == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(F.when(F.col("k") == 0, "no object").otherwise(F.to_json(said)).alias("value"))
    path = own_folder(spark, "log")
    lines.write.text(path)
    return path


@query("stream_signals", "SELECT CASE WHEN event_id % 3 = 0 THEN 'sell' ELSE 'buy' END AS type, upper(event_type) || '/USD' AS symbol, count(DISTINCT date_trunc('second', ts)) AS n, min(date_trunc('second', ts))::TIMESTAMP AS first, max(date_trunc('second', ts))::TIMESTAMP AS last FROM events WHERE event_id % 20 >= 7 GROUP BY ALL")
def stream_signals(spark, d):
    """Valid signals of the log, the first of each type, symbol and second."""
    x = delivered(accepted(checked(log_stream(spark, written_log(spark, d)))))
    time = lambda f, n: f("ts").cast("timestamp_ntz").alias(n)
    return x.groupBy("type", "symbol").agg(F.count("*").alias("n"), time(F.min, "first"), time(F.max, "last"))


@query("stream_dead_letters", "SELECT ['not an object', 'missing field', 'type', 'symbol', 'price', 'timestamp', 'stale'][(event_id % 20 + 1)::INTEGER] AS reason, count(*) AS n FROM events WHERE event_id % 20 < 7 GROUP BY ALL")
def stream_dead_letters(spark, d):
    """Refused lines of the log by reason."""
    return delivered(dead_letters(checked(log_stream(spark, written_log(spark, d))))).groupBy("reason").agg(F.count("*").alias("n"))
