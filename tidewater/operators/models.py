"""Statistical models: trends, regimes, clusters, decompositions and forecasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import over_chunks, placed
from tidewater.functions.scan import ema, recurrences, weighted
from tidewater.operators.calendar import last_rows
from tidewater.operators.indicators import full_features
from tidewater.session import stored


def quadratic_trend(df: DataFrame, by: str, t: str, y: str) -> DataFrame:
    """by, c0, c1, c2, band: least squares of y on 1, t, t squared from one pass of sums, and 1.96 deviations (of the
    population) of what is left over."""
    s = {f"s{k}": F.sum(F.pow(F.col(t).cast("double"), F.lit(k))) for k in range(5)} | {f"y{k}": F.sum(F.col(y) * F.pow(F.col(t).cast("double"), F.lit(k))) for k in range(3)} | {"yy": F.sum(F.col(y) ** 2)}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        m = np.array([[r[f"s{i + j}"] for j in range(3)] for i in range(3)])
        v = np.array([r["y0"], r["y1"], r["y2"]])
        c = np.linalg.lstsq(m, v, rcond=None)[0]
        mean = (r["y0"] - c @ m[0]) / r["s0"]
        left = max(0.0, (r["yy"] - 2 * c @ v + c @ m @ c) / r["s0"] - mean**2)
        return pd.DataFrame({by: [r[by]], "c0": c[:1], "c1": c[1:2], "c2": c[2:], "band": [1.96 * np.sqrt(left)]})

    kind = dict(df.dtypes)[by]
    return df.groupBy(by).agg(*(e.alias(n) for n, e in s.items())).groupBy(by).applyInPandas(solve, f"{by} {kind}, c0 double, c1 double, c2 double, band double")


def polynomial_trend(df: DataFrame, by: str, t: str, y: str, degree: int) -> DataFrame:
    """by, n, coefficients (of rising powers of t): least squares from one pass of sums over t scaled to -1 .. 1."""
    ends = df.groupBy(F.col(by).alias("_b")).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    half = F.greatest((F.col("_hi") - F.col("_lo")) / 2, F.lit(0.5))
    x = df.join(ends, F.col(by) == F.col("_b")).withColumn("_u", (F.col(t) - (F.col("_hi") + F.col("_lo")) / 2) / half)
    power = lambda k: F.pow("_u", F.lit(float(k)))
    sums = x.groupBy(by, "_lo", "_hi").agg(F.count("*").alias("n"), F.array(*(F.sum(power(k)) for k in range(2 * degree + 1))).alias("s"), F.array(*(F.sum(F.col(y) * power(k)) for k in range(degree + 1))).alias("v"))

    def solve(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = np.array([[r.s[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
                c = np.linalg.lstsq(m, np.array(r.v), rcond=None)[0]
                mid, scale = (r.hi + r.lo) / 2, max((r.hi - r.lo) / 2, 0.5)
                poly = sum((c[k] * np.polynomial.Polynomial([-mid / scale, 1 / scale]) ** k for k in range(degree + 1)), np.polynomial.Polynomial([0.0]))
                out.append((r.name, r.n, [float(a) for a in np.pad(poly.coef, (0, degree + 1 - len(poly.coef)))]))
            yield pd.DataFrame(out, columns=[by, "n", "coefficients"])

    kind = dict(df.dtypes)[by]
    return sums.select(F.col(by).alias("name"), F.col("_lo").cast("double").alias("lo"), F.col("_hi").cast("double").alias("hi"), "n", "s", "v").mapInPandas(solve, f"{by} {kind}, n long, coefficients array<double>")


def student_p(t: float, df: float) -> float:
    """The two-sided p-value of a t statistic, from the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, for x below its mean."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for k in range(1, 300):
        for n in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / (1 + n * d)
            c = 1 + n / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def with_p_value(stats: DataFrame) -> DataFrame:
    """regime_stats() with p_value, of the slope being 0."""

    @F.pandas_udf("double")
    def p(slope: pd.Series, err: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a / e, k - 2) if e and e > 0 else float("nan") for a, e, k in zip(slope, err, n, strict=True)])

    return stats.withColumn("p_value", F.nanvl(p("slope", "stderr", F.col("n").cast("double")), F.lit(None).cast("double")))


def regime_stats(df: DataFrame, regime: str, x: str = "close") -> DataFrame:
    """asset, regime, n, mean, std (population), slope, intercept, r, stderr of x over positions within the regime."""
    p = placed(df.withColumn("_g", F.concat_ws(":", "asset", F.col(regime).cast("string"))), by="_g")
    g = p.groupBy("asset", regime).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.regr_slope(x, "_at").alias("slope"), F.regr_intercept(x, "_at").alias("intercept"), F.when((F.stddev_pop(x) > 0) & (F.stddev_pop("_at") > 0), F.regr_r2(x, "_at")).alias("r2"), F.stddev_pop("_at").alias("_s"))
    err = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r2")) / F.nullif(F.col("n") - 2, F.lit(0))) * F.col("std") / F.nullif(F.col("_s"), F.lit(0.0))
    return g.select("asset", regime, "n", "mean", "std", "slope", "intercept", (F.sqrt("r2") * F.signum("slope")).alias("r"), err.alias("stderr"))


def kmeans_states(df: DataFrame, k: int, x: str = "close", seed: int = 1) -> tuple[DataFrame, list[float]]:
    """df with state (clusters of x, numbered by their centres), and the centres in order."""
    v = VectorAssembler(inputCols=[x], outputCol="_v").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(v)
    centres = [float(c[0]) for c in model.clusterCenters()]
    rank = F.array(*(F.lit(int(r)) for r in np.argsort(np.argsort(centres))))
    return model.transform(v).withColumn("state", F.get(rank, F.col("_c"))).drop("_v", "_c"), sorted(centres)


NOT_FEATURES = ("asset", "bar", "open", "high", "low", "close", "volume")


def next_close(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The feature table with _at, _n (place, and number of rows of the asset), _f (the features as a vector) and _next (the
    close of the next bar, null for the last), and the features' names."""
    x = full_features(df)
    names = [c for c in x.columns if c not in NOT_FEATURES]
    x = over_chunks(x.dropna(subset=names), 0, lambda w: {"_place": F.col("_at"), "_next": F.lead("close").over(w)}, ahead=1)
    n = x.groupBy(F.col("asset").alias("_a")).agg(F.count("*").alias("_n"))
    x = stored(x.join(n, F.col("asset") == F.col("_a")).drop("_a"), "features")
    return VectorAssembler(inputCols=names, outputCol="_f").transform(x), names


def forest(x: DataFrame, trees: int, depth: int, seed: int):
    return RandomForestRegressor(featuresCol="_f", labelCol="_next", predictionCol="predicted", numTrees=trees, maxDepth=depth, seed=seed).fit(x)


def forest_forecast(df: DataFrame, trees: int = 20, depth: int = 6, seed: int = 1) -> DataFrame:
    """asset, bar, close, predicted: the last fifth of each series forecast one bar ahead by a forest over the feature
    table, fitted to the first four fifths of all series."""
    x, _ = next_close(df)
    x = x.dropna(subset=["_next"])
    train = F.col("_place") < F.floor(0.8 * F.col("_n"))
    return forest(x.filter(train), trees, depth, seed).transform(x.filter(~train)).select("asset", "bar", F.col("_next").alias("close"), "predicted")


def forest_search(df: DataFrame, trees: tuple[int, ...] = (5, 10), depths: tuple[int, ...] = (3, 5), splits: int = 3, seed: int = 1) -> DataFrame:
    """trees, depth, mse, rank: every setting's mean squared error over rolling origins. Each split trains on the bars up
    to its origin and is tested on the part of the series behind it."""
    x, _ = next_close(df)
    x = x.dropna(subset=["_next"]).select("_place", "_n", "_f", "_next")
    out = []
    for t in trees:
        for depth in depths:
            errors = []
            for k in range(1, splits + 1):
                low, high = F.col("_n") * k / (splits + 1), F.col("_n") * (k + 1) / (splits + 1)
                model = forest(x.filter(F.col("_place") < low), t, depth, seed)
                tested = model.transform(x.filter((F.col("_place") >= low) & (F.col("_place") < high)))
                errors.append(tested.agg(F.avg((F.col("predicted") - F.col("_next")) ** 2)).first()[0])
            out.append((t, depth, float(np.mean(errors))))
    rows = [(*r, k) for k, r in enumerate(sorted(out, key=lambda r: r[2]), 1)]
    return df.sparkSession.createDataFrame(rows, "trees int, depth int, mse double, rank int")


#: Bars that the windows of a feature table reach back, at most.
REACH = 40
#: The feature table's exponential means: span, and whether their weights are divided by their sum.
EXPONENTIAL = {"ema_5": (5, False), "ema_10": (10, False), "_fast": (12, True), "_slow": (26, True)}


class Ahead:
    """The end of a series that grows bar by bar: the bars that windows need, and the numbers of the recurrences over all
    bars so far. features() are those that full_features() has for the whole series' last bar."""

    def __init__(self, bars: pd.DataFrame, n: int, means: dict[str, float]):
        self.bars, self.n, self.kept = bars[["bar", "open", "high", "low", "close", "volume"]].to_dict("list"), n, dict(means)

    def add(self, bar, close: float, volume: float) -> None:
        """A bar with one price."""
        for c, v in {"bar": bar, "open": close, "high": close, "low": close, "close": close, "volume": volume}.items():
            self.bars[c] = [*self.bars[c], v][-REACH:]
        self.n += 1
        for name, (span, divided) in EXPONENTIAL.items():
            a = 2 / (span + 1)
            if divided:  # the mean of k values is their weighted sum over (1 - keep ** k) / a
                keep = 1 - a
                total = self.kept[name] * (1 - keep ** (self.n - 1)) / a * keep + close
                self.kept[name] = total * a / (1 - keep**self.n)
            else:
                self.kept[name] += a * (close - self.kept[name])

    def features(self) -> dict[str, float]:
        c, h, lo, v = (np.array(self.bars[k], float) for k in ("close", "high", "low", "volume"))
        ret, d = c[1:] / c[:-1] - 1, np.diff(c)
        k = lambda j: 100 * (c[len(c) - 1 - j] - lo[len(c) - 14 - j : len(c) - j].min()) / np.ptp(np.concatenate([lo[len(c) - 14 - j : len(c) - j], h[len(c) - 14 - j : len(c) - j]]))
        gain, loss = np.maximum(d, 0)[-14:].mean(), np.maximum(-d, 0)[-14:].mean()
        mid, dev = c[-20:].mean(), c[-20:].std(ddof=1)
        at = pd.Timestamp(self.bars["bar"][-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = {
                "ret": ret[-1], "sma_5": c[-5:].mean(), "sma_10": c[-10:].mean(), "momentum": c[-1] - c[-11], "volume_change": v[-1] / v[-2] - 1, "volume_sma_5": v[-5:].mean(), "volume_sma_10": v[-10:].mean(),
                "hour": at.hour, "weekday": at.weekday(), "volatility": ret[-5:].std(ddof=1), "atr_simple": np.abs(d)[-14:].mean(), "bb_mid": mid, "bb_low": mid - 2 * dev, "bb_high": mid + 2 * dev,
                "stoch_k": k(0), "stoch_d": (k(0) + k(1) + k(2)) / 3, "rsi": 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss), "ema_5": self.kept["ema_5"], "ema_10": self.kept["ema_10"], "macd_line": self.kept["_fast"] - self.kept["_slow"],
            }
        return out | {f"lag_{j}": c[-1 - j] for j in range(1, 11)}


def series_ends(df: DataFrame) -> DataFrame:
    """asset, n (bars), means (EXPONENTIAL after the last bar), bars (the last REACH of each series, in order)."""
    means = {name: weighted("close", s) if divided else ema("close", s) for name, (s, divided) in EXPONENTIAL.items()}
    x = recurrences(df.select("asset", "bar", "close"), means)
    ends = x.groupBy(F.col("asset").alias("_a")).agg(F.count("*").alias("n"), F.max_by(F.struct(*EXPONENTIAL), "bar").alias("means"))
    last = last_rows(df, REACH).groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("bar", "open", "high", "low", "close", "volume"))).alias("bars"))
    return last.join(ends, F.col("asset") == F.col("_a")).select("asset", "n", "means", "bars")


def exported(model) -> list[list[tuple]]:
    """A forest as plain lists, a node each: feature, threshold, place of the children; or None and the value."""

    def walk(node, out: list) -> int:
        at = len(out)
        out.append(None)
        if node.subtreeDepth() == 0:
            out[at] = (None, float(node.prediction()), 0, 0)
        else:
            split = node.split()
            out[at] = (split.featureIndex(), float(split.threshold()), walk(node.leftChild(), out), walk(node.rightChild(), out))
        return at

    trees = []
    for t in model.trees:
        trees.append([])
        walk(t._java_obj.rootNode(), trees[-1])
    return trees


def predicted(trees: list[list[tuple]], x: list[float]) -> float:
    """The mean of the trees' values for one row of features."""
    total = 0.0
    for t in trees:
        f, v, left, right = t[0]
        while f is not None:
            f, v, left, right = t[left if x[f] <= v else right]
        total += v
    return total / len(trees)


def recursive_forecast(df: DataFrame, steps: int, trees: int = 10, depth: int = 5, seed: int = 1, model=None) -> DataFrame:
    """asset, step, bar, close: the next bars of each series, an hour apart, each forecast from the ones before it. The forest is
    fitted once, unless a model of next_close()'s features is given. A series goes on from its last bars and the numbers of its recurrences, so that each step's features are
    those of the whole series with the forecasts behind it; all steps of a series are one task's, and no step is a job."""
    x, names = next_close(df)
    grown = exported(model or forest(x.dropna(subset=["_next"]), trees, depth, seed))

    def run(batches):
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                bars = pd.DataFrame([dict(b) if isinstance(b, dict) else b.asDict() for b in r.bars])
                ahead = Ahead(bars, r.n, dict(r.means) if isinstance(r.means, dict) else r.means.asDict())
                at, volume = pd.Timestamp(bars["bar"].iloc[-1]), float(bars["volume"].iloc[-1])
                for step in range(1, steps + 1):
                    f = ahead.features()
                    close = predicted(grown, [float(f[n]) for n in names])
                    at += pd.Timedelta(hours=1)
                    out.append((r.asset, step, at, close))
                    ahead.add(at, close, volume)
            yield pd.DataFrame(out, columns=["asset", "step", "bar", "close"])

    return series_ends(df).filter(f"n >= {REACH}").mapInPandas(run, "asset string, step int, bar timestamp_ntz, close double")


def loess(y: np.ndarray, width: int, trust: np.ndarray | None = None) -> np.ndarray:
    """Local linear fits with tricube weights over the width nearest points (all are equally spaced), times trust."""
    n = len(y)
    if n < 3:
        return y.copy()
    width = min(width, n)
    at = np.clip(np.arange(n) - width // 2, 0, n - width)[:, None] + np.arange(width)
    d = at - np.arange(n)[:, None]
    w = (1 - np.minimum(np.abs(d) / (np.abs(d).max(axis=1, keepdims=True) + 1e-9), 1) ** 3) ** 3
    if trust is not None:
        w = w * np.maximum(trust[at], 1e-6)
    v = y[at]
    s0, s1, s2, t0, t1 = w.sum(1), (w * d).sum(1), (w * d * d).sum(1), (w * v).sum(1), (w * d * v).sum(1)
    det = s0 * s2 - s1 * s1
    return np.where(np.abs(det) > 1e-12, (t0 * s2 - t1 * s1) / np.where(np.abs(det) > 1e-12, det, 1), t0 / s0)


def decompose(df: DataFrame, period: int = 7, rounds: int = 3, robust: int = 2) -> DataFrame:
    """asset, bar, close, trend, seasonal, remainder: seasonal-trend decomposition by local regression, per series. After
    each of robust passes, points with large remainders weigh less (bisquare weights of six median deviations)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar", ignore_index=True)
        y = pdf["close"].interpolate(limit_direction="both").to_numpy(float)
        trend, season, trust = np.zeros(len(y)), np.zeros(len(y)), np.ones(len(y))
        for k in range((robust + 1) * rounds):
            for j in range(min(period, len(y))):
                season[j::period] = loess((y - trend)[j::period], 7, trust[j::period])
            season -= pd.Series(season).rolling(period, center=True, min_periods=1).mean().to_numpy()
            trend = loess(y - season, max(3, int(1.5 * period) | 1), trust)
            if k % rounds == rounds - 1:
                left = np.abs(y - trend - season)
                trust = (1 - np.minimum(left / max(6 * np.median(left), 1e-12), 1) ** 2) ** 2
        return pd.DataFrame({"asset": pdf["asset"], "bar": pdf["bar"], "close": y, "trend": trend, "seasonal": season, "remainder": y - trend - season})

    return df.select("asset", "bar", "close").groupBy("asset").applyInPandas(run, "asset string, bar timestamp_ntz, close double, trend double, seasonal double, remainder double")


def additive_forecast(df: DataFrame, grid: DataFrame, steps: int) -> DataFrame:
    """asset, config, step, forecast: piecewise linear trend and weekly Fourier terms by ridge regression, for every
    asset and row of grid(config, changepoints, trend_ridge, season_ridge, multiplicative); forecasts are at least 0."""
    series = df.groupBy("asset").agg(F.transform(F.array_sort(F.collect_list(F.struct("bar", "close"))), lambda s: s["close"]).alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            y = np.array(r.y, float)
            n = len(y)
            t = np.arange(n + steps) / max(n, 1)
            knots = np.linspace(0, 0.8, int(r.changepoints) + 2)[1:-1]
            season = [f(2 * np.pi * k * np.arange(n + steps) / 7) for k in (1, 2, 3) for f in (np.sin, np.cos)]
            x = np.column_stack([np.ones(n + steps), t, *(np.maximum(0, t - k) for k in knots), *season])
            ridge = np.array([1e-6, 1e-6, *[r.trend_ridge] * len(knots), *[r.season_ridge] * 6])
            z = np.log(np.maximum(y, 1e-9)) if r.multiplicative else y
            w = np.linalg.solve(x[:n].T @ x[:n] + np.diag(ridge), x[:n].T @ z)
            f = x[n:] @ w
            out += [(r.asset, r.config, k + 1, float(max(0.0, v))) for k, v in enumerate(np.exp(np.clip(f, -50, 50)) if r.multiplicative else f)]
        return pd.DataFrame(out, columns=["asset", "config", "step", "forecast"])

    pairs = series.join(F.broadcast(grid))  # grid: one row for each configuration
    return pairs.repartition("asset", "config").mapInPandas(lambda it: (run(p) for p in it), "asset string, config int, step int, forecast double")


def forecast_scores(df: DataFrame, grid: DataFrame, steps: int) -> DataFrame:
    """asset, config, rmse, rank: each configuration's error over the last steps bars, forecast from those before."""
    p = placed(df.select("asset", "bar", "close"))
    n = p.groupBy(F.col("asset").alias("_a")).agg((F.count("*") - steps).alias("_n"))
    p = p.join(n, F.col("asset") == F.col("_a"))
    told = additive_forecast(p.filter(F.col("_at") < F.col("_n")).select("asset", "bar", "close"), grid, steps)
    truth = p.filter(F.col("_at") >= F.col("_n")).select("asset", (F.col("_at") - F.col("_n") + 1).cast("int").alias("step"), "close")
    scores = told.join(truth, ["asset", "step"]).groupBy("asset", "config").agg(F.sqrt(F.avg((F.col("forecast") - F.col("close")) ** 2)).alias("rmse"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("asset").orderBy("rmse", "config")))  # a row for each configuration
