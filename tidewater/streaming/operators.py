"""Structured Streaming: windows, deduplication, stale signals, incremental means and session state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "2 hours"


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files: asset, ts (timestamp), event_id, user_id, price, volume."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{{events.parquet,events.parquet/*}}")
    return stream.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


def tumbling(ticks: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """asset, bar, n, mean, high, low by event-time windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = ticks.withWatermark("ts", DELAY).groupBy("asset", w.alias("w"))
    return g.agg(F.count("*").alias("n"), F.avg("price").alias("mean"), F.max("price").alias("high"), F.min("price").alias("low")).select("asset", F.col("w.start").cast("timestamp_ntz").alias("bar"), "n", "mean", "high", "low")


def sessions(ticks: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """asset, start, until, n of sessions that a gap ends."""
    g = ticks.withWatermark("ts", DELAY).groupBy("asset", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select("asset", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("until"), "n")


def deduplicated(ticks: DataFrame, keys: tuple[str, ...] = ("asset", "event_id")) -> DataFrame:
    """The first tick of each key within the watermark."""
    return ticks.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(list(keys))


def fresh(signals: DataFrame, now: str = "now", seconds: int = 120) -> DataFrame:
    """Signals of at most some seconds of age at the column now."""
    return signals.filter(F.unix_timestamp(now) - F.unix_timestamp("ts") <= seconds)


def running_ema(ticks: DataFrame, alpha: float) -> DataFrame:
    """asset, n, ema: after each batch the exponential mean of each asset's ticks in the order of their times. The state
    holds two numbers an asset; a batch's late ticks come after those of batches before."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, y = state.get if state.exists else (0, 0.0)
        for p in pd.concat(batches).sort_values(["ts", "event_id"])["price"]:
            y = p if n == 0 else (1 - alpha) * y + alpha * p
            n += 1
        state.update((n, float(y)))
        yield pd.DataFrame({"asset": [key[0]], "n": [n], "ema": [y]})

    return ticks.groupBy("asset").applyInPandasWithState(step, "asset string, n long, ema double", "n long, y double", "update", GroupStateTimeout.NoTimeout)


def session_profit(fills: DataFrame, start: float = 50_000.0, target: float = 0.02) -> DataFrame:
    """asset, profit, done: cumulative profit of fills(asset, ts, event_id, amount), until a share of the start is
    gained; later fills of that session don't count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (profit,) = state.get if state.exists else (0.0,)
        for a in pd.concat(batches).sort_values(["ts", "event_id"])["amount"]:
            if profit < start * target:
                profit += a
        state.update((float(profit),))
        yield pd.DataFrame({"asset": [key[0]], "profit": [profit], "done": [profit >= start * target]})

    return fills.groupBy("asset").applyInPandasWithState(step, "asset string, profit double, done boolean", "profit double", "update", GroupStateTimeout.NoTimeout)


def replaced_orders(orders: DataFrame, keep: int = 100) -> DataFrame:
    """asset, side, placed, cancelled, open, known: a new order of an asset's side cancels the one that is open; the ids of
    the last keep orders are the state. orders: asset, side, ts, event_id. A simulation: nothing is placed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        placed, ids = state.get if state.exists else (0, [])
        new = pd.concat(batches).sort_values(["ts", "event_id"])["event_id"].tolist()
        placed, ids = placed + len(new), (list(ids) + new)[-keep:]
        state.update((placed, ids))
        yield pd.DataFrame({"asset": [key[0]], "side": [key[1]], "placed": [placed], "cancelled": [placed - 1], "open": [ids[-1]], "known": [len(ids)]})

    out = "asset string, side string, placed long, cancelled long, open long, known int"
    return orders.groupBy("asset", "side").applyInPandasWithState(step, out, "placed long, ids array<long>", "update", GroupStateTimeout.NoTimeout)


def running_indicators(ticks: DataFrame, n: int = 14) -> DataFrame:
    """asset, n, sma, rsi, high, low of the last n prices of each asset after each batch (rsi over n changes). The state is
    a ring of n + 1 prices and a count, so that a batch costs its own rows and not the whole series."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, ring = state.get if state.exists else (0, [])
        new = pd.concat(batches).sort_values(["ts", "event_id"])["price"].tolist()
        count, ring = count + len(new), (list(ring) + new)[-n - 1 :]
        state.update((count, ring))
        last, changes = ring[-n:], [b - a for a, b in zip(ring, ring[1:], strict=False)]
        gain, loss = sum(max(c, 0) for c in changes), sum(max(-c, 0) for c in changes)
        rsi = None if len(changes) < n else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        yield pd.DataFrame({"asset": [key[0]], "n": [count], "sma": [sum(last) / n if len(last) == n else None], "rsi": [rsi], "high": [max(last)], "low": [min(last)]}).astype({"sma": float, "rsi": float})

    return ticks.groupBy("asset").applyInPandasWithState(step, "asset string, n long, sma double, rsi double, high double, low double", "n long, ring array<double>", "update", GroupStateTimeout.NoTimeout)


def appended(old: DataFrame, batch: DataFrame) -> DataFrame:
    """A batch behind what there is, by column names."""
    return old.unionByName(batch, allowMissingColumns=True)
