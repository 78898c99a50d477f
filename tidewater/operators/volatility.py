"""Volatility forecasts: an autoregressive mean with a variance of order (1, 1), fitted by maximum likelihood.

r[t] = c + phi r[t-1] + e[t], var[t] = omega + alpha e[t-1]^2 + beta var[t-1], returns in per cent. All series are fitted at
once by scoring steps (the information matrix from outer products, damped where it doesn't gain); each step tries several
dampings in one pass. The variance and its derivatives are recurrences with the same factor beta, so that series are cut into
chunks: each finds what it adds from nothing, a walk over the chunks' few numbers gives their starts, and chunks then give
sums of likelihood, scores and products. Parameters are a table of a row for each series and trial, never the driver's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.ordered import CHUNK, over_chunks, placed
from tidewater.functions.scan import faded
from tidewater.session import stored

#: Dampings that a step tries, times the series' own.
DAMPINGS = (0.0, 0.1, 1.0, 10.0)
NAMES = ("omega", "alpha", "beta", "c", "phi")
LEAST = 20


def natural(u: np.ndarray) -> np.ndarray:
    """omega, alpha, beta, c, phi from numbers without bounds: their logarithm, persistence, share of alpha, c, and phi."""
    p, q = 0.9999 / (1 + np.exp(-u[1])), 1 / (1 + np.exp(-u[2]))
    return np.array([np.exp(u[0]), p * q, p * (1 - q), u[3], np.tanh(u[4])])


def slopes(u: np.ndarray) -> np.ndarray:
    """How natural() changes with u."""
    p, q = 0.9999 / (1 + np.exp(-u[1])), 1 / (1 + np.exp(-u[2]))
    dp, dq = p * (1 - p / 0.9999), q * (1 - q)
    j = np.zeros((5, 5))
    j[0, 0], j[3, 3], j[4, 4] = np.exp(u[0]), 1.0, 1 - np.tanh(u[4]) ** 2
    j[1, 1], j[1, 2], j[2, 1], j[2, 2] = q * dp, p * dq, (1 - q) * dp, -p * dq
    return j


def passed(theta: np.ndarray, r: np.ndarray, lag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over a chunk, with its variance and derivatives at the start: residuals, variances, derivatives (rows x 5), and both
    at the end."""
    omega, alpha, beta, c, phi = theta
    e = r - c - phi * lag
    after = faded((omega + alpha * e * e)[:, None], beta, 1.0, start[:1])[:, 0]
    var = np.concatenate([start[:1], after[:-1]])
    gains = np.column_stack([np.ones(len(e)), e * e, var, -2 * alpha * e, -2 * alpha * e * lag])
    d = faded(gains, beta, 1.0, start[1:])
    return e, var, np.concatenate([start[None, 1:], d[:-1]]), np.concatenate([after[-1:], d[-1]])


def chained(theta: np.ndarray, adds: np.ndarray, n: int, start: np.ndarray) -> np.ndarray:
    """The end of a chunk of n rows from its start and what it adds from nothing."""
    beta = theta[2]
    end = beta**n * start + adds
    end[3] += n * beta ** (n - 1) * start[0]  # the variance feeds its derivative by beta
    return end


def log_returns(df: DataFrame, x: str = "close") -> DataFrame:
    """asset, bar, close, r (per cent) and lag of each bar that has two before it."""
    ln = lambda w: {"r": 100 * F.log(F.when(F.col(x) > 0, F.col(x)) / F.when(F.lag(x).over(w) > 0, F.lag(x).over(w)))}
    x2 = over_chunks(df.select("asset", "bar", F.col(x).cast("double").alias(x)), 2, ln, lambda w: {"lag": F.lag("r").over(w)})
    return x2.filter("r is not null and lag is not null")


def chunks_of(returns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each series: asset, chunk, r, lag."""
    x = placed(returns).withColumn("chunk", F.floor(F.col("_at") / chunk))
    rows = x.groupBy("asset", "chunk").agg(F.array_sort(F.collect_list(F.struct("_at", "r", "lag"))).alias("v"))
    return stored(rows.select("asset", "chunk", F.col("v.r").alias("r"), F.col("v.lag").alias("lag")), "returns")


TRIAL = "asset string, trial int, u array<double>, theta array<double>, start array<double>, best array<double>, best_value double, damping double, done boolean"
FIELDS = ["asset", "trial", "u", "theta", "start", "best", "best_value", "damping", "done"]


def first_trials(returns: DataFrame) -> DataFrame:
    """One trial for each series of LEAST returns or more: the mean by least squares, usual shares of the variance."""
    s = returns.groupBy("asset").agg(F.count("*").alias("n"), F.avg("r").alias("mr"), F.avg("lag").alias("ml"), F.covar_pop("r", "lag").alias("cov"), F.var_pop("lag").alias("vl"), F.var_pop("r").alias("vr"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for x in p.itertuples(index=False):
                phi = float(np.clip(x.cov / x.vl if x.vl > 0 else 0.0, -0.95, 0.95))
                var = max(x.vr - phi * x.cov, 1e-8)
                u = np.array([np.log(0.1 * var), np.log(9.0), np.log(1 / 8.0), x.mr - phi * x.ml, np.arctanh(phi)])
                out.append((x.asset, 0, u, natural(u), np.array([var, 0, 0, 0, 0, 0]), u, -np.inf, 1.0, False))
            yield pd.DataFrame(out, columns=FIELDS)

    return s.filter(F.col("n") >= LEAST).mapInPandas(run, TRIAL)


def evaluated(chunks: DataFrame, trials: DataFrame) -> DataFrame:
    """Each trial with value (log-likelihood without its constant), scores, products (both by theta) and end (the variance
    behind the last return, and its derivatives)."""
    key = ["asset", "trial"]
    of = trials.select("asset", "trial", "theta", "start")
    both = chunks.join(of, "asset")

    def adds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"asset": p["asset"], "trial": p["trial"], "chunk": p["chunk"], "n": p["r"].map(len), "theta": p["theta"], "first": p["start"], "adds": [passed(np.asarray(t), np.asarray(r), np.asarray(g), np.zeros(6))[3] for t, r, g in zip(p["theta"], p["r"], p["lag"], strict=True)]})

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p, at, starts = p.sort_values("chunk"), np.asarray(p["first"].iloc[0]), []
        for t, a, n in zip(p["theta"], p["adds"], p["n"], strict=True):
            starts.append(at)
            at = chained(np.asarray(t), np.asarray(a), int(n), at)
        return pd.DataFrame({"asset": p["asset"], "trial": p["trial"], "chunk": p["chunk"], "at": starts})

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for x in p.itertuples(index=False):
                r, lag = np.asarray(x.r), np.asarray(x.lag)
                e, var, d, end = passed(np.asarray(x.theta), r, lag, np.asarray(x.at))
                z = e * e / var
                g = (0.5 * (z - 1) / var)[:, None] * d
                g[:, 3] += e / var
                g[:, 4] += e * lag / var
                out.append((x.asset, x.trial, x.chunk, float(-0.5 * (np.log(var) + z).sum()), g.sum(0), (g.T @ g).ravel(), end))
            yield pd.DataFrame(out, columns=["asset", "trial", "chunk", "value", "scores", "products", "end"])

    kinds = "asset string, trial int, chunk long"
    starts = both.mapInPandas(adds, f"{kinds}, n long, theta array<double>, first array<double>, adds array<double>").groupBy(*key).applyInPandas(walk, f"{kinds}, at array<double>")
    parts = both.join(starts, [*key, "chunk"]).select(*key, "chunk", "theta", "r", "lag", "at").mapInPandas(sums, f"{kinds}, value double, scores array<double>, products array<double>, end array<double>")
    added = lambda c, n: F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(n))).alias(c)
    whole = parts.groupBy(*key).agg(F.sum("value").alias("value"), added("scores", 5), added("products", 25), F.max_by("end", "chunk").alias("end"))
    return trials.join(whole, key)


def improved(p: pd.DataFrame) -> pd.DataFrame:
    """The next trials of a series from those evaluated."""
    p = p.sort_values("trial", ignore_index=True)
    value = p["value"].where(np.isfinite(p["value"]), -np.inf)
    k, row = int(value.argmax()), p.iloc[0]
    gained = value[k] > row["best_value"]
    damping = float(np.clip(row["damping"] * (0.2 if gained else 30.0), 1e-6, 1e12))
    if not gained:  # back to the best point, whose scores are those of trial -1
        k = int(p.index[p["trial"] == -1][0]) if (p["trial"] == -1).any() else k
    u = np.asarray(p["u"][k])
    j = slopes(u)
    score, info = j.T @ np.asarray(p["scores"][k]), j.T @ np.asarray(p["products"][k]).reshape(5, 5) @ j
    scale = np.diag(np.maximum(np.diag(info), 1e-12))
    steps = [np.linalg.lstsq(info + (1e-10 + damping * m) * scale, score, rcond=None)[0] for m in DAMPINGS]
    done = bool(abs(score @ steps[0]) < 1e-9 * max(1.0, abs(value[k])) or damping > 1e9)
    out = [(-1, u), *((m, u + np.clip(s, -3, 3)) for m, s in enumerate(steps))]
    return pd.DataFrame([(row["asset"], m, v, natural(v), row["start"], u, float(value[k]), damping, done) for m, v in out], columns=FIELDS)


def fitted(df: DataFrame, steps: int = 25, chunk: int = CHUNK) -> DataFrame:
    """asset, NAMES, value (log-likelihood), converged, var (of the next return) of every series of LEAST returns or more."""
    returns = log_returns(df)
    chunks = chunks_of(returns, chunk)
    trials = stored(first_trials(returns), "trials")
    for _ in range(steps):
        now = evaluated(chunks, trials)
        trials = stored(now.groupBy("asset").applyInPandas(improved, TRIAL), "trials")
        if not trials.filter("not done").limit(1).count():
            break
    last = evaluated(chunks, trials.filter("trial = -1"))
    return last.select("asset", *(F.get("theta", F.lit(k)).alias(n) for k, n in enumerate(NAMES)), "value", F.col("done").alias("converged"), F.get("end", F.lit(0)).alias("var"))


def last_returns(df: DataFrame) -> DataFrame:
    return log_returns(df).groupBy(F.col("asset").alias("_a")).agg(F.max_by("close", "bar").alias("last_close"), F.max_by("r", "bar").alias("last_return"), F.max("bar").alias("last_bar"))


def volatility_forecast(df: DataFrame, horizon: int = 5, fit: DataFrame | None = None) -> DataFrame:
    """asset, step, mean, sigma (of the return that many steps ahead, the mean's own spread included), low, high (1.96
    sigma), path (the price compounded by simple returns), price, price_low, price_high (by sums of logarithmic ones)."""
    fit = stored(fitted(df), "fit") if fit is None else fit
    x = fit.join(last_returns(df), F.col("asset") == F.col("_a"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for s in p.itertuples(index=False):
                mean, var, spread = s.last_return, s.var, 0.0
                path, logs = s.last_close, np.zeros(3)
                for k in range(1, horizon + 1):
                    mean = s.c + s.phi * mean
                    spread = s.phi**2 * spread + var
                    var = s.omega + (s.alpha + s.beta) * var
                    sigma = np.sqrt(spread)
                    ends = np.array([mean, mean - 1.96 * sigma, mean + 1.96 * sigma])
                    path, logs = path * (1 + mean / 100), logs + ends / 100
                    out.append((s.asset, k, mean, sigma, ends[1], ends[2], path, *(s.last_close * np.exp(logs))))
            yield pd.DataFrame(out, columns=["asset", "step", "mean", "sigma", "low", "high", "path", "price", "price_low", "price_high"])

    return x.mapInPandas(run, "asset string, step int, mean double, sigma double, low double, high double, path double, price double, price_low double, price_high double")


def simulated_prices(df: DataFrame, horizon: int = 5, blocks: int = 10, paths: int = 1000, seed: int = 1, fit: DataFrame | None = None) -> DataFrame:
    """asset, step, p05, p50, p95, mean of simulated prices: blocks of paths run the variance recursion with normal shocks,
    each block from a seed of its own, so that results don't depend on partitions."""
    fit = stored(fitted(df), "fit") if fit is None else fit
    x = fit.join(last_returns(df), F.col("asset") == F.col("_a")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = x.withColumn("seed", F.abs(F.xxhash64("asset", "block", F.lit(seed))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for s in p.itertuples(index=False):
                z = np.random.default_rng(int(s.seed)).standard_normal((horizon, paths))
                r, var, logs = np.full(paths, s.last_return), np.full(paths, s.var), np.zeros(paths)
                for k in range(horizon):
                    e = np.sqrt(var) * z[k]
                    r = s.c + s.phi * r + e
                    var = s.omega + s.alpha * e * e + s.beta * var
                    logs = logs + r / 100
                    yield pd.DataFrame({"asset": s.asset, "step": k + 1, "price": s.last_close * np.exp(logs)})

    ends = x.repartition("asset", "block").mapInPandas(run, "asset string, step int, price double")
    q = lambda p: F.percentile("price", F.lit(p))  # noqa: E731  over blocks x paths values, which a parameter sets
    return ends.groupBy("asset", "step").agg(q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.avg("price").alias("mean"))
