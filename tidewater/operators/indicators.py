"""Technical indicators as columns over bars (open, high, low, close, volume).

Definitions: exponential means (ema) and Wilder's means (rma) begin with the mean of their first values; bands use the
population's deviation; a full window is needed everywhere. Divisions by zero give null.
single_price(bars) sets open, high and low to close, for series that have one price a bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.functions.ewm import ewm, positive, span
from tidewater.functions.ordered import change, full, over_chunks, ratio, running, simple_return, trailing
from tidewater.functions.scan import Steps, Sum, ema, recurrences, rma, weighted

Dict = dict[str, Column]


def single_price(bars: DataFrame) -> DataFrame:
    return bars.withColumns({c: F.col("close") for c in ("open", "high", "low")})


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def rsi_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    """rsi: from plain means of gains and losses; 100 where there are no losses."""
    x = lambda w: {"_d": change(w, "close")}
    return over_chunks(bars, n + 1, x, *rsi_parts(n)).withColumn("rsi", strength("_g", "_l")).drop("_d", "_g", "_l")


def rsi_parts(n: int):
    """A stage with plain means _g and _l of gains and losses, over the change _d."""
    return (lambda w: {"_g": full(w, n, F.when(F.col("_d").isNotNull(), positive(F.col("_d")))), "_l": full(w, n, F.when(F.col("_d").isNotNull(), positive(-F.col("_d"))))},)


def strength(gain: str, loss: str) -> Column:
    return F.when(F.col(loss) == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """rsi: from Wilder's means of gains and losses."""
    x = over_chunks(bars, 1, lambda w: {"_d": change(w, "close")}, lambda w: {"_u": F.when(F.col("_d").isNotNull(), positive(F.col("_d"))), "_v": F.when(F.col("_d").isNotNull(), positive(-F.col("_d")))})
    return recurrences(x, {"_g": rma("_u", n), "_l": rma("_v", n)}).withColumn("rsi", strength("_g", "_l")).drop("_d", "_u", "_v", "_g", "_l")


def bollinger(n: int = 20, k: float = 2.0, deviation=F.stddev_pop):
    """A stage with bb_low, bb_mid, bb_high."""

    def stage(w: WindowSpec) -> Dict:
        mid, dev = full(w, n, "close"), full(w, n, "close", deviation)
        return {"bb_mid": mid, "bb_low": mid - k * dev, "bb_high": mid + k * dev}

    return stage


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr: Wilder's mean of true ranges, from the second bar on."""
    x = over_chunks(bars, 1, lambda w: {"_tr": F.when(F.lag("close").over(w).isNotNull(), true_range(w))})
    return recurrences(x, {"atr": rma("_tr", n)}).drop("_tr")


def stochastic(n: int = 14, smooth: int = 3, signal: int = 3):
    """Stages with stoch_k (smoothed) and stoch_d."""
    raw = lambda w: {"_k": 100 * ratio(F.col("close") - full(w, n, "low", F.min), full(w, n, "high", F.max) - full(w, n, "low", F.min))}
    return raw, lambda w: {"stoch_k": full(w, smooth, "_k")}, lambda w: {"stoch_d": full(w, signal, "stoch_k")}


def obv(bars: DataFrame) -> DataFrame:
    """obv: running sum of volume by the sign of the change."""
    x = over_chunks(bars, 1, lambda w: {"_v": F.coalesce(F.signum(change(w, "close")), F.lit(0.0)) * F.col("volume")})
    return running(x, {"obv": ("sum", F.col("_v"))}).drop("_v")


def cci(n: int = 14):
    """Stages with cci; the mean deviation is a fold over the window's values."""

    def gathered(w: WindowSpec) -> Dict:
        return {"_tp": typical(), "_mean": full(w, n, typical()), "_all": F.collect_list(typical()).over(trailing(w, n))}

    dev = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_mean"))) / n
    return gathered, lambda w: {"cci": ratio(F.col("_tp") - F.col("_mean"), 0.015 * dev)}


def vwap(bars: DataFrame) -> DataFrame:
    """vwap: since the day's first bar."""
    w = Window.partitionBy("asset", F.to_date("bar")).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("vwap", ratio(F.sum(typical() * F.col("volume")).over(w), F.sum("volume").over(w)))


def mfi(n: int = 14):
    """Stages with mfi."""
    flow = lambda w: {"_f": typical() * F.col("volume"), "_d": typical() - F.lag(typical()).over(w)}
    sums = lambda w: {"_up": full(w, n, F.when(F.col("_d").isNotNull(), F.when(F.col("_d") > 0, F.col("_f")).otherwise(0.0)), F.sum), "_dn": full(w, n, F.when(F.col("_d").isNotNull(), F.when(F.col("_d") < 0, F.col("_f")).otherwise(0.0)), F.sum)}
    return flow, sums, lambda w: {"mfi": 100 * ratio(F.col("_up"), F.col("_up") + F.col("_dn"))}


def williams(n: int = 14):
    """A stage with willr."""
    return lambda w: {"willr": -100 * ratio(full(w, n, "high", F.max) - F.col("close"), full(w, n, "high", F.max) - full(w, n, "low", F.min))}


def ultimate(a: int = 7, b: int = 14, c: int = 28):
    """Stages with uo."""

    def pressure(w: WindowSpec) -> Dict:
        before = F.lag("close").over(w)
        have = before.isNotNull()
        return {"_bp": F.when(have, F.col("close") - F.least("low", before)), "_tr": F.when(have, F.greatest("high", before) - F.least("low", before))}

    share = lambda w, n: ratio(full(w, n, "_bp", F.sum), full(w, n, "_tr", F.sum))
    return pressure, lambda w: {"uo": 100 * (4 * share(w, a) + 2 * share(w, b) + share(w, c)) / 7}


def macd_of(fast: int = 12, slow: int = 26, signal: int = 9) -> Steps:
    """Recurrences with macd and macd_signal."""
    return {"_f": ema("close", fast), "_s": ema("close", slow), "macd": Sum({"_f": 1.0, "_s": -1.0}), "macd_signal": ema("macd", signal)}


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macd_signal, macd_hist."""
    return recurrences(bars, macd_of(fast, slow, signal)).withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_f", "_s")


def macd_line(bars: DataFrame, out: str, adjust: bool, fast: int = 12, slow: int = 26) -> DataFrame:
    """The line from plain exponential means that begin with the first value (adjust: divided by the sum of weights)."""
    x = ewm(ewm(bars, "close", span(fast), "_f", adjust=adjust), "close", span(slow), "_s", adjust=adjust)
    return x.withColumn(out, F.col("_f") - F.col("_s")).drop("_f", "_s")


def movement(w: WindowSpec) -> Dict:
    """Directional movement _p and _m, and true ranges _tr, from the second bar on."""
    up, down = change(w, "high"), -change(w, "low")
    return {"_p": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "_m": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)), "_tr": F.when(up.isNotNull(), true_range(w))}


def adx_of(n: int = 14) -> Steps:
    """Recurrences with Wilder's means of movement()."""
    return {"_ps": rma("_p", n), "_ms": rma("_m", n), "_trs": rma("_tr", n)}


def directions(df: DataFrame) -> DataFrame:
    """plus_di, minus_di and _dx over adx_of()."""
    df = df.withColumns({"plus_di": 100 * ratio("_ps", "_trs"), "minus_di": 100 * ratio("_ms", "_trs")})
    return df.withColumn("_dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """plus_di, minus_di, adx."""
    x = directions(recurrences(over_chunks(bars, 1, movement), adx_of(n)))
    return recurrences(x, {"adx": rma("_dx", n)}).drop("_p", "_m", "_tr", "_ps", "_ms", "_trs", "_dx")


def trix_of(n: int = 14) -> Steps:
    """Recurrences with _3, a triple exponential mean."""
    return {"_1": ema("close", n), "_2": ema("_1", n), "_3": ema("_2", n)}


def trix_stages(signal: int = 9):
    """Stages with trix and trix_signal, over trix_of()."""
    return lambda w: {"trix": 100 * simple_return(w, "_3")}, lambda w: {"trix_signal": full(w, signal, "trix")}


def trix(bars: DataFrame, n: int = 14, signal: int = 9) -> DataFrame:
    """trix (per cent change of a triple exponential mean) and trix_signal (plain mean)."""
    return over_chunks(recurrences(bars, trix_of(n)), signal + 1, *trix_stages(signal)).drop("_1", "_2", "_3")


def tsi_of(fast: int = 13, slow: int = 25) -> Steps:
    """Recurrences with means of means of the change _cd and its absolute value _ca."""
    return {c + k: ema(c + of, m) for c in ("_cd", "_ca") for k, of, m in (("1", "", slow), ("2", "1", fast))}


def price_change(w: WindowSpec) -> Dict:
    return {"_cd": change(w, "close"), "_ca": F.abs(change(w, "close"))}


def tsi(bars: DataFrame, fast: int = 13, slow: int = 25, signal: int = 13) -> DataFrame:
    """tsi (doubly smoothed change over doubly smoothed absolute change) and tsi_signal (its exponential mean)."""
    x = recurrences(over_chunks(bars, 1, price_change), tsi_of(fast, slow)).withColumn("tsi", 100 * ratio("_cd2", "_ca2"))
    return recurrences(x, {"tsi_signal": ema("tsi", signal)}).drop("_cd", "_ca", "_cd1", "_ca1", "_cd2", "_ca2")


def all_indicators(bars: DataFrame) -> DataFrame:
    """Bars with every indicator that the rules of signals.RULES and the exported document need: windows over chunks,
    then the recurrences in two scans (the second has means of what isn't linear in the first), then windows over those."""
    k, d, e = stochastic()
    plain = lambda w: {"sma": full(w, 14, "close"), "adr": full(w, 14, F.col("high") - F.col("low")), "sma_50": full(w, 50, "close"), "sma_200": full(w, 200, "close")}
    x = over_chunks(bars, 200, movement, price_change, *mfi(), williams(), lambda w: {"_mtr": F.col("_tr")}, *ultimate(), k, d, e, bollinger(), *cci(), plain)
    x = x.withColumn("_tr", F.col("_mtr"))
    x = recurrences(x.drop("_all"), {"ema": ema("close", 14), "atr": rma("_tr", 14)} | macd_of() | adx_of() | trix_of() | tsi_of())
    x = recurrences(directions(x).withColumn("tsi", 100 * ratio("_cd2", "_ca2")), {"adx": rma("_dx", 14), "tsi_signal": ema("tsi", 13)})
    x = over_chunks(x, 16, *trix_stages(), lambda w: {"_d": change(w, "close")}, *rsi_parts(14))
    x = vwap(obv(x.withColumn("rsi", strength("_g", "_l")).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))))
    return x.drop(*(c for c in x.columns if c.startswith("_")))


def keltner(bars: DataFrame, n: int = 9, k: float = 0.1) -> DataFrame:
    """kc_low, kc_mid, kc_high."""
    x = over_chunks(bars, 1, lambda w: {"_tr": F.when(F.lag("close").over(w).isNotNull(), true_range(w))})
    x = recurrences(x, {"kc_mid": ema("close", n), "atr": rma("_tr", n)}).drop("_tr")
    return x.withColumns({"kc_low": F.col("kc_mid") - k * F.col("atr"), "kc_high": F.col("kc_mid") + k * F.col("atr")}).drop("atr")


#: Bars of an hour of each interval: windows of day-long features scale by it.
SCALE = {"hour": 1, "15min": 4, "5min": 12}


def features(bars: DataFrame, interval: str = "hour") -> DataFrame:
    """The feature table of a forecast: returns, means, deviations, bands, oscillators, calendar and lags, in one pass
    of windows over chunks."""
    s = SCALE[interval]
    k, d, e = stochastic(14 * s, 1, 3)

    def first(w: WindowSpec) -> Dict:
        return {"ret": simple_return(w), "sma_5": full(w, 5 * s, "close"), "sma_10": full(w, 10 * s, "close"), "momentum": change(w, "close", 10 * s), "volume_change": simple_return(w, "volume"), "volume_sma_5": full(w, 5 * s, "volume"), "volume_sma_10": full(w, 10 * s, "volume"), "hour": F.hour("bar"), "weekday": F.weekday("bar"), **{f"lag_{j}": F.lag("close", j).over(w) for j in range(1, 11)}}

    x = over_chunks(bars, 20 * s + 10, first, lambda w: {"volatility": full(w, 5 * s, "ret", F.stddev_samp), "atr_simple": full(w, 14 * s, F.abs(change(w, "close")))}, bollinger(20 * s, 2.0, F.stddev_samp), k, d, e)
    return x.drop("_k")


def full_features(bars: DataFrame, interval: str = "hour") -> DataFrame:
    """features() with exponential means, strength and the MACD line (its spans don't scale with the interval), the
    recurrences in one pass."""
    s = SCALE[interval]
    line = {"_f": weighted("close", 12), "_s": weighted("close", 26), "macd_line": Sum({"_f": 1.0, "_s": -1.0})}
    return recurrences(rsi_simple(features(bars, interval), 14 * s), {"ema_5": ema("close", 5 * s), "ema_10": ema("close", 10 * s)} | line).drop("_f", "_s")
