"""Calendar effects: weekdays, weeks of the month, hours, swings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import placed


def week_of_month(ts: str | Column) -> Column:
    return F.floor((F.day(ts) - 1) / 7).cast("int") + 1


def day_number(name: Column) -> Column:
    """0 for Mon to 6 for Sun."""
    return F.array_position(F.array(*(F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))), F.initcap(F.substring(name, 1, 3))) - 1


def without_weekends(df: DataFrame, ts: str = "bar") -> DataFrame:
    return df.filter(F.weekday(ts) < 5)


def seconds_of_day(ts: str | Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int")


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds, floored."""
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"), s % 60)


def hours_of_day(ts: str | Column) -> Column:
    """Hours since midnight, with fractions, by whole seconds."""
    return seconds_of_day(ts) / 3600


def last_rows(df: DataFrame, n: int, by: str = "asset", ts: str = "bar") -> DataFrame:
    """The last n rows of each series: those of the largest times, found by partial lists of n before the shuffle."""
    x = placed(df, by, ts)
    ends = x.groupBy(F.col(by).alias("_b")).agg(F.max("_at").alias("_last"))
    return x.join(ends, F.col(by) == F.col("_b")).filter(F.col("_at") > F.col("_last") - n).drop("_b", "_last", "_at")


def return_lists(df: DataFrame, group: Column) -> DataFrame:
    """asset, the group, returns: the returns of each group in the order of their bars."""
    x = df.filter("ret is not null").groupBy("asset", group).agg(F.array_sort(F.collect_list(F.struct("bar", "ret"))).alias("_l"))
    return x.withColumn("returns", F.transform("_l", lambda s: s["ret"])).drop("_l")


def best_hours(df: DataFrame) -> DataFrame:
    """asset, day, buy, sell, profit: the hours of the most profitable purchase and later sale within each day; of equal
    ones the earliest. Days without a profitable pair are not there."""
    h = df.select("asset", F.date_trunc("day", "bar").cast("timestamp_ntz").alias("day"), F.hour("bar").alias("hour"), "close")
    w = Window.partitionBy("asset", "day").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    x = h.withColumn("low", F.min(F.struct("close", "hour")).over(w)).withColumn("profit", F.col("close") - F.col("low.close")).filter("profit > 0")
    best = F.max_by(F.struct(F.col("low.hour").alias("buy"), F.col("hour").alias("sell"), "profit"), F.struct(F.col("profit"), -F.col("low.hour"), -F.col("hour")))
    return x.groupBy("asset", "day").agg(best.alias("z")).select("asset", "day", "z.buy", "z.sell", "z.profit")
