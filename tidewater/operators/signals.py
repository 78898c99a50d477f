"""Signals and backtests over indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import over_chunks, running
from tidewater.operators.pairs import profits_by

#: Name, buy condition, sell condition: each over indicator columns of equal names.
RULES = {
    "rsi": ("rsi < 30", "rsi > 70"),
    "bands": ("close < bb_low", "close > bb_high"),
    "cci": ("cci < -100", "cci > 100"),
    "vwap": ("close > vwap", "close < vwap"),
    "ema": ("ema > close", "ema < close"),
    "adr": ("adr < close", "adr > close"),
    "adx": ("adx > 20", "adx < 20"),
    "mfi": ("mfi < 20.5", "mfi > 79.5"),
    "macd": ("macd > macd_signal", "macd < macd_signal"),
    "trix": ("trix > trix_signal", "trix < trix_signal"),
    "tsi": ("tsi < -25", "tsi > 25"),
    "williams": ("willr < -80", "willr > -20"),
    "ultimate": ("uo < 30", "uo > 70"),
    "stochastic": ("stoch_k < 20", "stoch_k > 80"),
}


def flag(condition: str) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False))


def signal(buy: Column, sell: Column) -> Column:
    """1 for buy, -1 for sell, 0 for none; a sell overrides a buy."""
    return F.when(sell, -1).when(buy, 1).otherwise(0)


def trading_hours(ts: str = "bar", zone: str = "America/New_York") -> Column:
    """Whether a time (taken as UTC) lies from 9 up to 16 in that zone."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))).between(9, 15)


def combined() -> tuple[Column, Column]:
    """Buy on money flow; sell on money flow, or strength, or three oscillators together."""
    both = [flag(RULES[k][1]) for k in ("williams", "ultimate", "stochastic")]
    return flag(RULES["mfi"][0]), flag(RULES["mfi"][1]) | flag(RULES["rsi"][1]) | (both[0] & both[1] & both[2])


def run_starts(df: DataFrame, x: str = "signal", by: str = "asset", ts: str = "bar") -> DataFrame:
    """The rows whose value differs from the one before."""
    y = over_chunks(df, 1, lambda w: {"_b": F.lag(x).over(w)}, by=by, ts=ts)
    return y.filter(~F.col("_b").eqNullSafe(F.col(x))).drop("_b")


def alternating_backtest(df: DataFrame, capital: float = 50_000.0) -> DataFrame:
    """asset, trades, final_capital: whole shares are bought on the first of each run of buys and sold on the first of
    each run of sells; what is held at the end is sold at the last price. df: asset, bar, close, signal."""
    acts = run_starts(df.filter("signal <> 0 and close > 0"))
    last = df.groupBy("asset").agg(F.max_by("close", "bar").alias("last_close"))
    # the signals of an asset, alternating: far fewer than its bars
    paths = acts.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("bar", "signal", "close"))).alias("path"))
    start = F.struct(F.lit(capital).alias("cash"), F.lit(0.0).alias("shares"), F.lit(0).cast("long").alias("trades"))

    def step(s: Column, a: Column) -> Column:
        n = F.floor(s["cash"] / a["close"]).cast("double")
        buy = F.struct((s["cash"] - n * a["close"]).alias("cash"), n.alias("shares"), (s["trades"] + 1).alias("trades"))
        sell = F.struct((s["cash"] + s["shares"] * a["close"]).alias("cash"), F.lit(0.0).alias("shares"), (s["trades"] + 1).alias("trades"))
        return F.when((a["signal"] == 1) & (s["shares"] == 0) & (n > 0), buy).when((a["signal"] == -1) & (s["shares"] > 0), sell).otherwise(s)

    done = paths.select("asset", F.aggregate("path", start, step).alias("s"))
    return last.join(done, "asset", "left").select("asset", F.coalesce("s.trades", F.lit(0).cast("long")).alias("trades"), F.coalesce(F.col("s.cash") + F.col("s.shares") * F.col("last_close"), F.lit(capital)).alias("final_capital"))


def long_only(df: DataFrame) -> DataFrame:
    """The signals that act where a position is opened once and closed as a whole: a buy while nothing is held, and a
    sell of what is held. The first of each run of equal signals, from the first buy on."""
    acts = run_starts(df.filter("signal <> 0"))
    first = acts.filter("signal = 1").groupBy(F.col("asset").alias("_a")).agg(F.min("bar").alias("_first"))
    return acts.join(first, F.col("asset") == F.col("_a")).filter(F.col("bar") >= F.col("_first")).drop("_a", "_first")


def traded_with_costs(buys: DataFrame, sells: DataFrame, capital: float = 10_000.0, cost: float = 0.001) -> DataFrame:
    """asset, trades, final_capital, profit: the k-th buy is paired with the k-th sell, all capital is put in, and a
    share of both prices is paid for each pair. buys and sells: asset, bar, price."""
    place = Window.partitionBy("asset").orderBy("bar")
    a = buys.select("asset", F.row_number().over(place).alias("k"), F.col("price").alias("bought"))
    b = sells.select("asset", F.row_number().over(place).alias("k"), F.col("price").alias("sold"))
    pairs = a.join(b, ["asset", "k"]).groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("k", "bought", "sold"))).alias("p"))
    end = F.aggregate("p", F.lit(capital), lambda c, t: c / t["bought"] * t["sold"] - cost * (t["bought"] + t["sold"]))
    return pairs.select("asset", F.size("p").cast("long").alias("trades"), end.alias("final_capital")).withColumn("profit", F.col("final_capital") - capital)


def order_size(cash: Column, price: Column, fee: float, keep: float = 0.99) -> dict[str, Column]:
    """What a limit order of all cash would be; nothing is placed. The buying fee lowers the price and, once more, the
    size; a part of the size is kept back."""
    limit = price * (1 - fee)
    size = cash / F.nullif(limit, F.lit(0.0)) * keep
    return {"limit_price": limit, "size": size, "fee_adjusted_size": size * (1 - fee), "whole_shares": F.floor(cash / F.nullif(price, F.lit(0.0)))}


def latest(df: DataFrame) -> DataFrame:
    """The newest signal of each asset; of equal times a sell. df: asset, bar, signal, close."""
    return df.filter("signal <> 0").groupBy("asset").agg(F.max_by(F.struct("bar", "signal", "close"), F.struct(F.col("bar"), -F.col("signal"))).alias("s")).select("asset", "s.bar", "s.signal", "s.close")


def pair_profits(df: DataFrame) -> DataFrame:
    """All profitable pairs (buy earlier than sell) of an asset: buy, sell, profit, days. Quadratic in the bars of an
    asset by its meaning: for the best pair alone use best_pair()."""
    a = df.select("asset", F.col("bar").alias("buy"), F.col("close").alias("bought"))
    b = df.select("asset", F.col("bar").alias("sell"), F.col("close").alias("sold"))
    return a.join(b, "asset").filter("buy < sell and sold > bought").select("asset", "buy", "sell", (F.col("sold") - F.col("bought")).alias("profit"), F.date_diff("sell", "buy").alias("days"))


def monthly_trades(sums: DataFrame) -> DataFrame:
    """asset, month, profit, mean_profit, mean_days, trades of pairs.pair_sums() by the month of buying; months without any are
    there with no profit."""
    g = profits_by(sums, "month", "month")
    g = g.select("asset", "month", "profit", (F.col("profit") / F.col("trades")).alias("mean_profit"), (F.col("days") / F.col("trades")).alias("mean_days"), "trades")
    ends = g.groupBy("asset").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    grid = ends.select("asset", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return grid.join(g, ["asset", "month"], "left").na.fill({"profit": 0, "trades": 0})


def buy_sell_cells(pairs: DataFrame) -> DataFrame:
    """buy, sell, profit: the mean profit of the pairs of each date of buying and each date of selling that there is, 0 where
    there are none. Cells are rows, so that dates come from the data; dates are far fewer than pairs."""
    of = pairs.groupBy("buy", "sell").agg(F.avg("profit").alias("profit"))
    grid = pairs.select("buy").distinct().crossJoin(pairs.select("sell").distinct())  # one row a cell of the result
    return grid.join(of, ["buy", "sell"], "left").fillna(0.0, ["profit"])


def best_pair(df: DataFrame) -> DataFrame:
    """The most profitable pair of each asset from the least price up to each sale."""
    x = running(df, {"low": ("min", F.struct("close", "bar"))}).withColumn("profit", F.col("close") - F.col("low.close")).filter("profit > 0")
    best = x.groupBy("asset").agg(F.max_by(F.struct("low.bar", F.col("bar").alias("sell"), "profit"), F.struct(F.col("profit"), -F.unix_timestamp(F.col("bar").cast("timestamp")))).alias("z"))
    return best.select("asset", F.col("z.bar").alias("buy"), "z.sell", "z.profit")


def day_trade(df: DataFrame, mode: str = "intended") -> DataFrame:
    """asset, day, profit of the best single trade within each day. mode intended: any later sale; reference: the buy
    stands at the day's first bar (or the sale at the first, bought at the second), as the original constraints have it."""
    day = df.withColumn("day", F.date_trunc("day", "bar").cast("timestamp_ntz"))
    w = Window.partitionBy("asset", "day").orderBy("bar")
    if mode == "reference":
        x = day.withColumns({"k": F.row_number().over(w)})
        first, second = F.max(F.when(F.col("k") == 1, F.col("close"))), F.max(F.when(F.col("k") == 2, F.col("close")))
        return x.groupBy("asset", "day").agg(F.greatest(F.max("close") - first, F.coalesce(first - second, F.lit(0.0))).alias("profit"))
    low = F.min("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return day.withColumn("low", low).groupBy("asset", "day").agg(F.max(F.col("close") - F.col("low")).alias("profit"))
