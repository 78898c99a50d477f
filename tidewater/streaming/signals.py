"""Ingestion of signals: what fails a test of type, symbol, price, time or age goes to a dead-letter table with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the signals' format.
FIELDS = "type string, symbol string, price double, timestamp string, arrived string"
TYPES = ("buy", "sell")
FORMAT = "yyyy-MM-dd HH:mm:ss"
SYMBOL = "^[A-Za-z0-9:._-]{1,20}(/[A-Za-z]{2,5})?$"
STALE_SECONDS = 120


def checked(lines: DataFrame, now: Column | None = None, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """lines(raw) with type, symbol, price, ts and reason, null for what is valid. Age is counted to now, or else to the time
    of arrival that the line itself states."""
    s = F.from_json("raw", FIELDS, {"mode": "PERMISSIVE"})
    x = lines.withColumn("_s", s).withColumns({"type": F.col("_s.type"), "symbol": F.col("_s.symbol"), "price": F.col("_s.price"), "ts": F.try_to_timestamp("_s.timestamp", F.lit(FORMAT))})
    at = now if now is not None else F.try_to_timestamp("_s.arrived", F.lit(FORMAT))
    age = F.unix_timestamp(at) - F.unix_timestamp("ts")
    missing = F.col("_s").isNull() | F.greatest(*(F.col(f"_s.{c}").isNull() for c in ("type", "symbol", "price", "timestamp")))
    reason = (
        F.when(F.try_parse_json("raw").isNull() | F.col("raw").rlike(r"^\s*[^{\s]"), "not an object")
        .when(missing, "missing field")
        .when(~F.col("type").isin(*TYPES), "type")
        .when(~F.col("symbol").rlike(SYMBOL), "symbol")
        .when(~(F.col("price") > 0) | F.isnan("price"), "price")
        .when(F.col("ts").isNull(), "timestamp")
        .when(age > stale_seconds, "stale")
    )
    return x.withColumn("reason", reason).drop("_s")


def accepted(checked_lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Valid signals, the first of each type, symbol and time."""
    good = checked_lines.filter("reason is null").drop("reason", "raw")
    return good.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["type", "symbol", "ts"])


def dead_letters(checked_lines: DataFrame) -> DataFrame:
    """Where the others stand in the log, what they say and why they were refused."""
    return checked_lines.filter("reason is not null").select("segment", "at", "raw", "reason")
