"""Live indicators, the replayable log, ingestion and delivery: the same rows whatever the batches, kills and restarts."""

from __future__ import annotations

import datetime as dt
import json
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tidewater.functions.scan import recurrences, rma
from tidewater.operators import indicators as ind
from tidewater.sources.signal_log import SignalLogReader, log_stream
from tidewater.streaming import indicators
from tidewater.streaming.delivery import Delivery, as_parquet, delivered, drain
from tidewater.streaming.indicators import MEANS, STATE, TOLD, live_indicators, told
from tidewater.streaming.signals import accepted, checked, dead_letters

START = dt.datetime(2024, 1, 1)
TICKS = "asset string, ts timestamp, event_id long, price double, volume double"


def ticks(n: int = 90) -> list[tuple]:
    rng = random.Random(8)
    rows = [(a, START + dt.timedelta(minutes=k), 2 * k, rng.uniform(50, 60), float(rng.randint(1, 9))) for a in ("x", "y") for k in range(n if a == "x" else n // 3)]
    rows += [("x", START + dt.timedelta(minutes=7), 999, 1.0, 1.0), ("y", START, 998, 2.0, 1.0)]  # later ids of times that are there
    rows.sort(key=lambda r: (r[1] + dt.timedelta(minutes=rng.uniform(0, 40)), r[2]))  # out of order within the delay
    return [*rows, *((a, START + dt.timedelta(days=2), 10_000, None, None) for a in ("x", "y"))]


@pytest.mark.parametrize("files", [1, 4])
def test_live_indicators(spark, tmp_path, files):
    rows = ticks()
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = delivered(live_indicators(stream, least=5), conf=STATE).toPandas().sort_values(["asset", "ts"], ignore_index=True)
    first = {}
    for a, ts, i, p, v in sorted(r for r in rows if r[3] is not None):
        first.setdefault((a, ts), (a, ts, p, p, p, p, v))
    bars = spark.createDataFrame(list(first.values()), "asset string, bar timestamp_ntz, open double, high double, low double, close double, volume double")
    want = ind.all_indicators(bars).drop("rsi", "sma").join(ind.rsi_wilder(bars).select("asset", "bar", "rsi"), ["asset", "bar"])
    want = want.toPandas().sort_values(["asset", "bar"], ignore_index=True)
    want["sma"] = want.groupby("asset")["close"].transform(lambda s: s.rolling(14).mean())
    want = want[want.groupby("asset").cumcount() >= 4].reset_index(drop=True)
    assert got["ts"].tolist() == want["bar"].tolist() and got["n"].tolist() == (want.groupby("asset").cumcount() + 5).tolist()
    for c in TOLD:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


class Held:
    """A state variable in memory, whatever its kind."""

    def __init__(self):
        self.all, self.one = {}, None

    def getValue(self, key):
        return self.all.get(key)

    def updateValue(self, key, value):
        self.all[key] = value

    def removeKey(self, key):
        del self.all[key]

    def iterator(self):
        return iter(self.all.items())

    def exists(self):
        return bool(self.all) or self.one is not None

    def get(self):
        return self.one

    def put(self, value):
        self.one = value

    update = put


class Handle:
    """What a processor asks of Spark: state, timers."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def _state(self, name, *schemas):
        return self.states.setdefault(name, Held())

    getMapState = getListState = getValueState = _state  # noqa: N815

    def registerTimer(self, ms):
        self.timers.add(ms)

    def passed(self, processor, until):
        """The watermark goes to until (milliseconds)."""
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: until)
        for ms in sorted(t for t in self.timers if t <= until):
            yield from processor.handleExpiredTimer(("x",), now, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))
            self.timers.remove(ms)


def test_a_long_batch_is_held_in_parts(monkeypatch):
    """A batch of many days in any order: its ticks go to the state while it is read, by the day, and come out as if they
    were told at once, whatever the watermark's steps."""
    monkeypatch.setattr(indicators, "GATHERED", 100)
    monkeypatch.setattr(indicators, "AT_ONCE", 30)
    rng = np.random.default_rng(3)
    ts = pd.to_datetime(np.sort(rng.integers(0, 20 * 86_400, 2000)) * 1_000_000 + rng.integers(0, 1000, 2000), unit="us").as_unit("us")
    rows = pd.DataFrame({"ts": ts, "event_id": np.arange(2000), "price": rng.uniform(1, 9, 2000), "volume": rng.integers(0, 9, 2000).astype(float)})
    first = rows.drop_duplicates("ts")
    handle, live, unread = Handle(), indicators.LiveIndicators(("asset",), 1), []

    def chunks(mixed):
        for k in range(0, len(mixed), 50):
            waits = sum(len(v[0]) for v in handle.states["waiting"].all.values()) // indicators.TICK.itemsize
            unread.append(k - waits)
            yield mixed[k : k + 50]

    live.init(handle)
    mixed = rows.sample(frac=1.0, random_state=1)
    late = mixed[mixed["ts"] >= pd.Timestamp("1970-01-08 12:00")]
    assert sum(map(len, live.handleInputRows(("x",), chunks(pd.concat([mixed.drop(late.index), late[::2]])), None))) == 0
    assert max(unread) <= 100 and len(handle.timers) >= 20
    out = list(handle.passed(live, 7 * 86_400_000 + 40_000_000))  # within a day, before any of the late ones
    list(live.handleInputRows(("x",), chunks(late[1::2]), None))
    for until in (9 * 86_400_000 + 1234, 9 * 86_400_000 + 5_000_000, 30 * 86_400_000):
        out += handle.passed(live, until)
    assert max(map(len, out)) <= 30 and not handle.states["waiting"].all and not handle.states["pieces"].all and not handle.timers
    got = pd.concat(out, ignore_index=True)
    want, _ = told(first["price"].to_numpy(), first["volume"].to_numpy(), 0, None, 0.0, np.zeros(len(MEANS)), np.array([]))
    assert got["ts"].tolist() == first["ts"].tolist() and got["n"].tolist() == list(range(1, len(first) + 1))
    for c in TOLD:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_any_split_of_vectors():
    rng = np.random.default_rng(1)
    p, v = rng.uniform(1, 9, 80), rng.uniform(0, 5, 80)
    whole, ends = told(p, v, 0, None, 0.0, np.zeros(len(MEANS)), np.array([]))
    for cuts in ([1, 2, 3], [13, 14, 40], [79], list(range(1, 80))):
        parts, numbers, ring, n, before, obv = [], np.zeros(len(MEANS)), np.array([]), 0, None, 0.0
        for a, b in zip([0, *cuts], [*cuts, 80], strict=True):
            of, numbers = told(p[a:b], v[a:b], n, before, obv, numbers, ring)
            ring, n, before, obv = np.concatenate([ring, p[a:b]])[-20:], b, p[b - 1], of["obv"][-1]
            parts.append(pd.DataFrame({c: of[c] for c in TOLD}))
        got = pd.concat(parts, ignore_index=True)
        for c in TOLD:
            np.testing.assert_allclose(got[c], whole[c], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(numbers, ends)


def line(k: int, **other) -> str:
    at = START + dt.timedelta(seconds=k)
    return json.dumps({"type": "buy" if k % 2 else "sell", "symbol": "BTC/USD", "price": 1.0 + k, "timestamp": f"{at:%Y-%m-%d %H:%M:%S}", "arrived": f"{at:%Y-%m-%d %H:%M:%S}"} | other)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_log_partitions(tmp_path, split):
    """Every line once, whatever the splits; unfinished lines wait."""
    lines = [line(k) if k % 3 else "ü" * k for k in range(30)]
    (tmp_path / "0001").write_text("\n".join(lines[:10]))  # complete, as another segment follows
    (tmp_path / "0002").write_text("\n".join(lines[10:]) + "\nunfinish")
    (tmp_path / "_ignored").write_text("x\n")
    r = SignalLogReader({"path": f"file://{tmp_path}", "split_bytes": str(split)})
    end = r.latestOffset()
    read = lambda a, b: [x for p in r.partitions(a, b) for x in r.read(p)]
    assert [x[2] for x in read(r.initialOffset(), end)] == lines
    half = {"segment": "0002", "byte": len("\n".join(lines[10:20]).encode()) + 1}
    assert read(r.initialOffset(), half) + read(half, end) == read(r.initialOffset(), end)
    with (tmp_path / "0002").open("a") as f:
        f.write("ed\n")
    assert [x[2] for x in read(end, r.latestOffset())] == ["unfinished"] and read(end, end) == []


def test_log_of_nothing(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assert delivered(log_stream(spark, f"file://{tmp_path}/log")).count() == 0


BAD = {"not an object": ["garbage", "", "[1]", "12"], "missing field": ["{}", '{"type": "buy"}'], "type": [line(1, type="hold")], "symbol": [line(1, symbol="a b")], "price": [line(1, price=0), line(1, price=-3)], "timestamp": [line(1, timestamp="yesterday")], "stale": [line(1, arrived="2024-01-01 00:02:02")]}


def test_ingestion_over_restarts(spark, tmp_path):
    """Segments that grow between runs from one checkpoint: nothing is lost, nothing comes twice, the refused say why."""
    log, work = tmp_path / "log", f"file://{tmp_path}"
    log.mkdir()

    def run():
        x = checked(log_stream(spark, f"file://{log}", 100))
        good = delivered(accepted(x), folder=f"{work}/good", checkpoint=f"{work}/good-c")
        return good, delivered(dead_letters(x), folder=f"{work}/bad", checkpoint=f"{work}/bad-c")

    (log / "0001").write_text("\n".join([line(k) for k in range(8)] + [line(3), line(4)] + BAD["type"]) + "\n" + line(8)[:20])
    good, bad = run()
    assert good.count() == 8 and bad.count() == 1
    (log / "0001").write_text((log / "0001").read_text() + line(8)[20:] + "\n")
    (log / "0002").write_text("\n".join([line(5), line(9)] + [x for r, xs in BAD.items() if r != "type" for x in xs]) + "\n")
    for _ in range(2):
        good, bad = run()
        assert sorted(r.price for r in good.collect()) == [1.0 + k for k in range(10)]
        assert sorted((r.reason, r.raw) for r in bad.collect()) == sorted((r, x) for r, xs in BAD.items() for x in xs)


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before", "during", "after"])
def test_delivery_after_a_kill(spark, tmp_path, when):
    """Killed before it writes, half-way or between its entry and Spark's own, a batch is there once in the end."""
    log, work = tmp_path / "log", f"file://{tmp_path}"
    log.mkdir()
    for k in range(4):
        (log / f"{k:04d}").write_text("".join(line(10 * k + j) + "\n" for j in range(10)))
    stream = log_stream(spark, f"file://{log}")

    class Mortal(Delivery):
        def __call__(self, rows, batch):
            super().__call__(rows, batch)
            if when == "after" and not state["dead"]:
                state["dead"] = True
                raise Killed

    def write(rows, path):
        if when != "after" and not state["dead"]:
            if when == "during":
                as_parquet(rows.limit(3), path)
            state["dead"] = True
            raise Killed
        as_parquet(rows, path)

    state = {"dead": False}
    for _ in range(2):
        sink = Mortal(f"{work}/out", write, attempts=1)
        try:
            stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{work}/c").foreachBatch(sink).start().awaitTermination()
        except Exception:
            assert state["dead"]
    assert sorted(r.raw for r in sink.delivered(spark, stream.schema).collect()) == sorted(line(k) for k in range(40))


def test_retries_and_drain(spark, tmp_path):
    pauses, calls = [], []

    def flaky(rows, path):
        calls.append(path)
        if len(calls) < 4:
            raise OSError("busy")
        as_parquet(rows, path)

    sink = Delivery(f"file://{tmp_path}/out", flaky, attempts=4, pause=0.5, sleep=pauses.append)
    rows = spark.range(5)
    sink(rows, 7)
    sink(rows, 7)
    assert pauses == [0.5, 1.0, 2.0] and len(set(calls)) == 1 and len(calls) == 4
    assert [r.batch for r in sink.delivered(spark, rows.schema).collect()] == [7] * 5
    with pytest.raises(OSError, match="busy"):
        Delivery(f"file://{tmp_path}/none", lambda r, p: (_ for _ in ()).throw(OSError("busy")), attempts=2, sleep=pauses.append)(rows, 0)
    assert Delivery(f"file://{tmp_path}/none").delivered(spark, rows.schema).count() == 0
    live = Delivery(f"file://{tmp_path}/live")
    query = spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.trigger(processingTime="200 milliseconds").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(live).start()
    while query.lastProgress is None:
        query.awaitTermination(1)
    assert drain(query, live) and not query.isActive
    got = live.delivered(spark, "timestamp timestamp, value long")
    assert got.count() == got.select("value").distinct().count()


def test_plain_means_agree(spark):
    """The live recurrences are those of the batch."""
    x = spark.createDataFrame([("a", START + dt.timedelta(hours=k), float(k % 5)) for k in range(30)], "asset string, bar timestamp_ntz, close double")
    got = recurrences(x, {"m": rma("close", 14)}).orderBy("bar").toPandas()["m"]
    assert got.isna().sum() == 13 and got.iloc[13] == pytest.approx(np.mean([k % 5 for k in range(14)]))
