"""Indicators of live ticks with typed state: whatever batches the ticks come in, and in whatever order within the delay, each
tick gets the values that the whole series would give it.

Ticks wait in a map, by the day, until the watermark has passed them (an event-time timer for each day that has some wakes
their series, the earliest first), are then taken in the order of their times, the first of each time, and leave only what the
next ones need: the numbers of the recurrences in a map, a ring of prices in a list, count, time, price and volume balance in a
value. What was late for the watermark is dropped by it. A batch costs its own ticks, in vectors; however long it is, a task holds
GATHERED of its ticks, or the ticks that wait of one day of one series. Series are told apart by keys: an asset whose ticks come
from several venues can be keyed by both, so that a hot asset is several series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions.scan import Mean, Sum, Values, ema, rma, run

#: Ticks that a series has had before anything is told, by the length of its ticks.
LEAST = {"second": 20, "minute": 5}
MEAN_LENGTH, BAND_LENGTH, BAND_WIDTH = 14, 20, 2.0
STEPS = {
    "ema": ema("price", MEAN_LENGTH), "_fast": ema("price", 12), "_slow": ema("price", 26), "macd": Sum({"_fast": 1.0, "_slow": -1.0}), "macd_signal": ema("macd", 9),
    "_gain": rma("up", MEAN_LENGTH), "_loss": rma("down", MEAN_LENGTH), "atr": rma("range", MEAN_LENGTH),
}
MEANS = [n for n, s in STEPS.items() if isinstance(s, Mean)]
TOLD = ("sma", "ema", "rsi", "macd", "macd_signal", "atr", "bb_low", "bb_mid", "bb_high", "obv")
#: Microseconds of a slot, whose ticks wait together.
SLOT = 86_400_000_000
#: Ticks that are gathered before they go to the state, and ticks that are told at once.
GATHERED, AT_ONCE = 1 << 16, 1 << 16
TICK = np.dtype([("micros", "<i8"), ("event_id", "<i8"), ("price", "<f8"), ("volume", "<f8")])
#: State of RocksDB, which timers and several state variables need.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def rolled(ring: np.ndarray, x: np.ndarray, n: int, f) -> np.ndarray:
    """f over the last n values up to each of x, whose predecessors are in the ring; NaN where there are fewer."""
    whole = np.concatenate([ring[len(ring) - min(len(ring), n - 1) :], x])
    out = np.full(len(x), np.nan)
    if len(whole) >= n:
        got = f(np.lib.stride_tricks.sliding_window_view(whole, n), axis=1)
        out[len(x) - len(got) :] = got
    return out


def told(price: np.ndarray, volume: np.ndarray, n: int, before: float | None, obv: float, numbers: np.ndarray, ring: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The indicators of some ticks behind n others, and the numbers of the recurrences at the end."""
    d = np.diff(price, prepend=np.nan if before is None else before)
    one = lambda v, k: Values(np.nan_to_num(v)[:, None], ~np.isnan(v), k)
    changes = max(0, n - 1)
    inputs = {"price": one(price, n), "up": one(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), changes), "down": one(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), changes), "range": one(np.abs(d), changes)}
    found, ends = run(STEPS, inputs, numbers[:, None])
    of = {k: np.where(found[k].have, found[k].values[:, 0], np.nan) for k in STEPS}
    with np.errstate(divide="ignore", invalid="ignore"):
        of["rsi"] = np.where(of["_loss"] == 0, 100.0, 100 - 100 / (1 + of["_gain"] / of["_loss"]))
    of["sma"] = rolled(ring, price, MEAN_LENGTH, np.mean)
    of["bb_mid"], dev = rolled(ring, price, BAND_LENGTH, np.mean), rolled(ring, price, BAND_LENGTH, np.std)
    of["bb_low"], of["bb_high"] = of["bb_mid"] - BAND_WIDTH * dev, of["bb_mid"] + BAND_WIDTH * dev
    of["obv"] = obv + np.cumsum(np.sign(np.nan_to_num(d)) * volume)
    return of, ends[:, 0]


def as_ticks(rows: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(rows), TICK)
    out["micros"] = rows["ts"].astype("datetime64[us]").astype("int64")
    out["event_id"], out["price"], out["volume"] = rows["event_id"], rows["price"].astype(float), rows["volume"].astype(float).fillna(0.0)
    return out


class LiveIndicators(StatefulProcessor):
    def __init__(self, keys: tuple[str, ...], least: int):
        self.keys, self.least = keys, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, piece int", "ticks binary")
        self.pieces = handle.getMapState("pieces", "slot long", "n int, least long")
        self.ring = handle.getListState("ring", "price double")
        self.numbers = handle.getMapState("numbers", "name string", "value double")
        self.last = handle.getValueState("last", "n long, micros long, price double, obv double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({c: pd.Series(dtype=object) for c in (*self.keys, "ts", "n", "price", *TOLD)})
        held, size = [], 0
        for new in rows:
            held.append(as_ticks(new[new["price"].notna()]))
            size += len(held[-1])
            if size >= GATHERED:
                self.wait(np.concatenate(held))
                held, size = [], 0
        if size:
            self.wait(np.concatenate(held))

    def wait(self, ticks: np.ndarray) -> None:
        """Put ticks to those that wait of their slots, and see that each slot's earliest wakes it."""
        slots = ticks["micros"] // SLOT
        order = np.argsort(slots, kind="stable")
        for some in np.split(ticks[order], np.flatnonzero(np.diff(slots[order])) + 1):
            slot, earliest = int(some["micros"][0] // SLOT), int(some["micros"].min())
            n, least = self.pieces.getValue((slot,)) or (0, None)
            if least is None or earliest < least:
                self.handle.registerTimer(earliest // 1000 + 1)
            self.waiting.updateValue((slot, n), (some.tobytes(),))
            self.pieces.updateValue((slot,), (n + 1, earliest if least is None else min(earliest, least)))

    def taken(self, slot: int, until: int) -> np.ndarray:
        """The ticks of a slot from before until (milliseconds), in order, the first of each time; the others wait on."""
        n, _ = self.pieces.getValue((slot,)) or (0, None)
        if not n:
            return np.empty(0, TICK)
        pieces = [(slot, k) for k in range(n)]
        held = np.concatenate([np.frombuffer(self.waiting.getValue(k)[0], TICK) for k in pieces])
        for k in pieces:
            self.waiting.removeKey(k)
        self.pieces.removeKey((slot,))
        passed = held["micros"] // 1000 < until
        if not passed.all():
            self.wait(held[~passed])
        ready = held[passed]
        ready = ready[np.lexsort((ready["event_id"], ready["micros"]))]
        return ready[np.append(True, np.diff(ready["micros"]) > 0)[: len(ready)]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ready = self.taken((expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 // SLOT, timerValues.getCurrentWatermarkInMs())
        n, micros, before, obv = self.last.get() if self.last.exists() else (0, None, None, 0.0)
        ready = ready if micros is None else ready[ready["micros"] > micros]
        if not len(ready):
            return
        ring = np.array([r[0] for r in self.ring.get()] if self.ring.exists() else [], float)
        known = dict((k[0], v[0]) for k, v in self.numbers.iterator()) if self.numbers.exists() else {}
        numbers = np.array([known.get(m, 0.0) for m in MEANS])
        for a in range(0, len(ready), AT_ONCE):
            some = ready[a : a + AT_ONCE]
            price = some["price"]
            of, numbers = told(price, some["volume"], n, before, obv, numbers, ring)
            count = n + 1 + np.arange(len(price))
            out = pd.DataFrame({**dict(zip(self.keys, key, strict=True)), "ts": pd.to_datetime(some["micros"], unit="us"), "n": count, "price": price, **{c: of[c] for c in TOLD}})
            ring, n, before, obv = np.concatenate([ring, price])[-BAND_LENGTH:], n + len(price), float(price[-1]), float(of["obv"][-1])
            yield out[count >= self.least]
        for m, v in zip(MEANS, numbers.tolist(), strict=True):
            self.numbers.updateValue((m,), (v,))
        self.ring.put([(p,) for p in ring.tolist()])
        self.last.update((n, int(ready["micros"][-1]), before, obv))

    def close(self) -> None:
        pass


def live_indicators(ticks: DataFrame, keys: tuple[str, ...] = ("asset",), least: int = LEAST["second"], delay: str = "2 hours") -> DataFrame:
    """ticks(keys, ts, event_id, price, volume) as a stream of keys, ts, n, price and TOLD, from the least-th tick of each
    series on. Rows without a price only move the time on. Run it with the settings of STATE."""
    kinds = ", ".join(f"`{k}` {ticks.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, ts timestamp, n long, price double, {', '.join(f'{c} double' for c in TOLD)}"
    of = ticks.select(*keys, "ts", "event_id", "price", "volume").withWatermark("ts", delay)
    return of.groupBy(*keys).transformWithStateInPandas(statefulProcessor=LiveIndicators(keys, least), outputStructType=schema, outputMode="Append", timeMode="EventTime")
