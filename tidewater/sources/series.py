"""Canonical inputs: ticks, bars, daily series and the holder ledger, from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, ts, event_id, price, volume."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("asset"), "ts", "event_id", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


def truncated(unit: str, ts: str | Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def bars(t: DataFrame, unit: str | Column = "hour") -> DataFrame:
    """asset, bar, open, high, low, close, volume of ticks; one pass, partial aggregates before the shuffle. unit: one
    of date_trunc(), or a column with each tick's bar."""
    at = F.struct("ts", "event_id")
    return t.groupBy("asset", (truncated(unit, "ts") if isinstance(unit, str) else unit).alias("bar")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))


def minute_bars(t: DataFrame, minutes: int) -> DataFrame:
    """asset, bar, close of bars of some minutes."""
    of = F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes").start.cast("timestamp_ntz")
    return t.groupBy("asset", of.alias("bar")).agg(F.max_by("price", F.struct("ts", "event_id")).alias("close"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(ticks(spark, sf_dir), "hour")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(ticks(spark, sf_dir), "day")


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset (order priority), bar (day), close (mean order total), volume (orders)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), truncated("day", "o_orderdate").alias("bar")).agg(F.avg("o_totalprice").alias("close"), F.count("*").cast("double").alias("volume"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """holder, ts, amount: the ledger of what holders hold."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("holder"), "ts", "event_id", F.col("value").alias("amount"))


def order_periods(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """asset (order priority), bar (week, or month), close: the orders' total in cents, a whole number, so that sums of
    profits are exact in any order."""
    o = table(spark, sf_dir, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return o.groupBy(F.col("o_orderpriority").alias("asset"), truncated(unit, "o_orderdate").alias("bar")).agg(cents.alias("close"))
