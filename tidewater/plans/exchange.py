"""Queries that write documents and tables in the formats of the library and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import indicators as ind
from tidewater.operators import signals as sig
from tidewater.plans import base as b
from tidewater.plans.base import query
from tidewater.plans.indicators import ALL_INDICATORS
from tidewater.plans.signals import SIGNAL
from tidewater.session import own_folder
from tidewater.sources import documents, sinks
from tidewater.sources.series import daily, hourly, table, ticks


def written_charts(spark, d) -> str:
    """Market charts of all assets as gzipped JSON documents, one an asset, beside a file that isn't JSON."""
    path = own_folder(spark, "charts")
    sinks.write_charts(hourly(spark, d).select("asset", F.col("bar").alias("ts"), F.col("close").alias("price"), "volume"), path, 1_700_000_000_000)
    spark.createDataFrame([("{ no document",)], "value string").coalesce(1).write.mode("append").text(path)
    return path


SERIES = f"{b.HOURLY} SELECT asset, bar AS ts, close AS price, volume FROM bars"


@query("chart_series", SERIES)
def chart_series(spark, d):
    """Prices and volumes of equal times from all documents of a folder."""
    return documents.chart_series(documents.chart_documents(spark, written_charts(spark, d)))


@query("chart_zipped", f"{b.HOURLY} SELECT asset, (row_number() {b.W} - 1)::INTEGER AS at, bar AS ts, close AS price, volume FROM bars")
def chart_zipped(spark, d):
    """Prices and volumes paired by position."""
    return documents.zipped_series(documents.chart_documents(spark, written_charts(spark, d), "*.json.gz"))


@query("chart_of_assets", f"{SERIES} WHERE asset IN ('view', 'click')")
def chart_of_assets(spark, d):
    """Only the assets of a list."""
    chosen = spark.createDataFrame([("view",), ("click",)], "asset string")
    return documents.chart_series(documents.chart_documents(spark, written_charts(spark, d)), chosen)


@query("charts_are_fresh", f"WITH {b.TICKS}, l AS (SELECT asset, epoch_us(max(ts)) // 1000 AS fetched_at FROM ticks GROUP BY asset), n AS (SELECT max(fetched_at) + 13800000 AS now FROM l) SELECT asset, fetched_at, now - fetched_at < 14400000 AS fresh FROM l, n")
def charts_are_fresh(spark, d):
    """Whether each asset's document is young enough to skip another fetch, ten minutes before the newest one is four hours
    old. A document is as old as its last event."""
    path, x = own_folder(spark, "charts"), ticks(spark, d)
    sinks.write_charts(x, path)
    docs = documents.chart_documents(spark, path)
    now = docs.agg((F.max("fetched_at") + 13_800_000).alias("now"))  # one row
    return documents.freshness(docs, now)


@query("split_metrics", f"{b.HOURLY} SELECT asset, 'prices' AS metric, count(*) AS n, round(sum(close), 4) AS total FROM bars GROUP BY asset UNION ALL SELECT asset, 'volumes', count(*), round(sum(volume), 4) FROM bars GROUP BY asset")
def split_metrics(spark, d):
    """A folder for each asset and metric."""
    path = own_folder(spark, "split")
    sinks.write_metrics(hourly(spark, d), path, {"prices": "close", "volumes": "volume"})
    x = spark.read.schema("ms long, value double, asset string, metric string").json(path)
    return x.groupBy("asset", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("flat_files", f"{b.DAILY} SELECT asset, bar AS ts, close AS value FROM bars")
def flat_files(spark, d):
    """Arrays of [ms, value], a file for each asset."""
    path = own_folder(spark, "flat")
    sinks.write_flat(daily(spark, d), path)
    return documents.flat_series(spark, f"{path}/*/*", r"asset=([^/]+)/")


def written_ohlcv(spark, d) -> str:
    """Daily prices as CSV, a folder for each asset."""
    path = own_folder(spark, "ohlcv")
    sinks.write_csv(daily(spark, d).select("asset", F.to_date("bar").alias("Date"), *(F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume"))), path, ("asset",))
    return path


@query("ohlcv_files", f"{b.DAILY} SELECT asset, bar AS day, open, high, low, close, volume FROM bars WHERE bar >= TIMESTAMP '2024-01-10'")
def ohlcv_files(spark, d):
    """Daily prices as CSV, read from a date on."""
    o = documents.ohlcv(spark, written_ohlcv(spark, d), "2024-01-10")
    return o.select("asset", F.col("Date").cast("timestamp_ntz").alias("day"), *(F.col(c.title()).alias(c) for c in ("open", "high", "low", "close", "volume")))


@query("column_pairs", f"{b.DAILY} SELECT upper(asset) AS symbol, count(*) AS n, round(sum(close), 4) AS total, epoch_ms(min(bar)) AS first_ms FROM bars GROUP BY asset")
def column_pairs(spark, d):
    """One column of CSV files as series of [ms, value]."""
    p = documents.column_pairs(documents.ohlcv(spark, written_ohlcv(spark, d)), F.upper("asset"), "Close")
    return p.select("symbol", F.size("close").cast("long").alias("n"), F.round(F.aggregate("close", F.lit(0.0), lambda s, v: s + v[1]), 4).alias("total"), F.get(F.get("close", F.lit(0)), F.lit(0)).cast("long").alias("first_ms"))


@query("holder_files", "SELECT user_id AS holder, date_trunc('day', ts)::TIMESTAMP AS ts, round(sum(value), 2) AS amount FROM events GROUP BY ALL")
def holder_files(spark, d):
    """Ledgers as documents {holder: {time: amount with commas}}."""
    path = own_folder(spark, "holders")
    x = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("holder"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("value"), 2).alias("amount"))
    sinks.write_ledger(x, path)
    return documents.holder_ledger(spark, path).select(F.col("holder").cast("long").alias("holder"), "ts", "amount")


@query("codec_sizes", f"{b.DAILY}, c AS (SELECT * FROM (VALUES ('none'), ('gzip'), ('bzip2'), ('deflate'), ('snappy'), ('lz4')) c(codec)) SELECT codec, count(*) AS n, true AS smaller_or_none FROM bars, c GROUP BY codec")
def codec_sizes(spark, d):
    """The same rows with each codec: all are read again, and compressed files are smaller."""
    found = sinks.compared_codecs(daily(spark, d), own_folder(spark, "codecs"))
    plain = found.filter("codec = 'none'").select(F.col("bytes").alias("plain"))  # one row
    return found.join(F.broadcast(plain)).select("codec", "n", ((F.col("codec") == "none") | (F.col("bytes") < F.col("plain"))).alias("smaller_or_none"))


@query("markdown_table", f"{b.DAILY}, m AS (SELECT asset, round(avg(close), 4) AS m FROM bars GROUP BY asset), k AS (SELECT row_number() OVER (ORDER BY m DESC, asset) AS k, asset, m FROM m) SELECT k + 2 AS line, '| ' || k || ' | ' || asset || ' | ' || format('{{:.4f}}', m) || ' |' AS text FROM k UNION ALL SELECT 1, '| Rank | asset | mean |' UNION ALL SELECT 2, '| --- | --- | --- |'")
def markdown_table(spark, d):
    """Ranks by the mean price as a Markdown table."""
    x = daily(spark, d).groupBy("asset").agg(F.round(F.avg("close"), 4).alias("mean"))
    lines = sinks.markdown_ranks(x, "mean").split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "line long, text string")


@query("indicator_document", f"{b.HOURLY}, {ALL_INDICATORS}, s AS (SELECT *, {SIGNAL}::INTEGER AS signal FROM ai) SELECT asset AS symbol, count(*) AS n, count(CASE WHEN signal = 1 THEN 1 END) AS buys, count(CASE WHEN signal = -1 THEN 1 END) AS sells, round(sum(rsi), 3) AS rsi, round(sum(macd), 3) AS macd, round(sum(tsi_signal), 3) AS tsi_signal, strftime(max(bar), '%Y-%m-%d %H:%M:%S') AS last FROM s GROUP BY asset")
def indicator_document(spark, d):
    """The columnar document of each asset over its whole series (every indicator as a list, and the signals), written with gzip in parts of
    a day each and read; an asset's parts are put together."""
    path = own_folder(spark, "document")
    parts = sinks.indicator_documents(ind.all_indicators(hourly(spark, d)).withColumn("signal", sig.signal(*sig.combined())))
    sinks.write_json(parts, path)
    x = spark.read.schema(parts.schema).json(path)
    known = lambda c: F.filter(c, lambda v: v.isNotNull())
    total = lambda c: F.round(F.sum(F.when(F.size(known(c)) > 0, F.aggregate(known(c), F.lit(0.0), lambda s, v: s + v))), 3).alias(c)
    size = lambda c: F.sum(F.size(c)).cast("long")
    return x.groupBy("symbol").agg(size("timestamp").alias("n"), size("buy_signals").alias("buys"), size("sell_signals").alias("sells"), total("rsi"), total("macd"), total("tsi_signal"), F.max(F.element_at("timestamp", -1)).alias("last"))
