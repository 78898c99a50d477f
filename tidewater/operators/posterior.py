"""Posterior samples of the additive forecast: a piecewise linear trend and weekly terms with normal priors.

All that a series' samples need of its bars are sums: products of its design's columns with each other and with the prices.
Chunks make them, sums add up, and chains (rows of series and chain) then draw by turns the coefficients given the noise and
the noise given the coefficients, whatever the series' length. Chains are seeded by their key and start apart, and their
agreement is told by the ratio of variances between and within their halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.ordered import CHUNK, placed
from tidewater.session import stored

PERIOD, WAVES = 7, 3
#: Prior deviations of the intercept and slope, of each change of the slope, and of the weekly terms, in units of the prices'.
PRIOR = (10.0, 2.0, 2.0)


def design(at: np.ndarray, n: int, changes: int) -> np.ndarray:
    """The columns for the bars at some places of a series of n: 1, time, changes of slope, weekly waves."""
    t = at / max(n, 1)
    knots = np.linspace(0, 0.8, changes + 2)[1:-1]
    waves = [f(2 * np.pi * k * at / PERIOD) for k in range(1, WAVES + 1) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(len(at)), t, *(np.maximum(0, t - k) for k in knots), *waves])


def prior_precision(changes: int) -> np.ndarray:
    return 1 / np.array([PRIOR[0]] * 2 + [PRIOR[1]] * changes + [PRIOR[2]] * 2 * WAVES) ** 2


def series_sums(df: DataFrame, changes: int = 5, chunk: int = CHUNK) -> DataFrame:
    """asset, n, mean, scale, xx, xy, yy: sums over each series, of prices in units of their deviation from their mean."""
    whole = df.groupBy(F.col("asset").alias("_a")).agg(F.count("close").alias("n"), F.avg("close").alias("mean"), F.when(F.stddev_pop("close") > 0, F.stddev_pop("close")).otherwise(1.0).alias("scale"))
    p = placed(df.select("asset", "bar", "close").filter("close is not null")).join(whole, F.col("asset") == F.col("_a"))
    rows = p.groupBy("asset", "n", "mean", "scale", F.floor(F.col("_at") / chunk).alias("c")).agg(F.collect_list(F.struct("_at", "close")).alias("v"))
    size = 2 + changes + 2 * WAVES

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                at, y = np.array([x["_at"] for x in r.v], float), (np.array([x["close"] for x in r.v]) - r.mean) / r.scale
                x = design(at, r.n, changes)
                out.append((r.asset, r.n, r.mean, r.scale, (x.T @ x).ravel(), x.T @ y, float(y @ y)))
            yield pd.DataFrame(out, columns=["asset", "n", "mean", "scale", "xx", "xy", "yy"])

    parts = rows.select("asset", "n", "mean", "scale", "v").mapInPandas(sums, "asset string, n long, mean double, scale double, xx array<double>, xy array<double>, yy double")
    added = lambda c, k: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(k))).alias(c)
    return parts.groupBy("asset", "n", "mean", "scale").agg(added("xx", size * size), added("xy", size), F.sum("yy").alias("yy"))


def gibbs(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, precision: np.ndarray, draws: int, warm: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """draws of coefficients and of the noise's variance, after warm ones."""
    size, var = len(xy), float(np.exp(rng.normal(0, 1)))
    beta, noise = np.empty((draws, size)), np.empty(draws)
    for k in range(-warm, draws):
        lower = np.linalg.cholesky(xx / var + np.diag(precision))
        mean = np.linalg.solve(lower.T, np.linalg.solve(lower, xy / var))
        b = mean + np.linalg.solve(lower.T, rng.standard_normal(size))
        left = max(yy - 2 * b @ xy + b @ xx @ b, 1e-12)
        var = (0.001 + left / 2) / rng.gamma(0.001 + n / 2)
        if k >= 0:
            beta[k], noise[k] = b, var
    return beta, noise


def sampled(sums: DataFrame, steps: int = 7, chains: int = 4, draws: int = 500, warm: int = 200, changes: int = 5, seed: int = 1) -> DataFrame:
    """asset, chain, forecast (an array of draws x steps prices, at least 0), means and spreads (of each half of the chain: for
    every coefficient and the logarithm of the noise, the mean and variance)."""
    x = sums.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).withColumn("seed", F.abs(F.xxhash64("asset", "chain", F.lit(seed))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                rng, xy = np.random.default_rng(int(r.seed)), np.asarray(r.xy)
                beta, noise = gibbs(np.asarray(r.xx).reshape(len(xy), -1), xy, r.yy, r.n, prior_precision(changes), draws, warm, rng)
                ahead = design(np.arange(r.n, r.n + steps, dtype=float), r.n, changes)
                y = r.mean + r.scale * (beta @ ahead.T + np.sqrt(noise)[:, None] * rng.standard_normal((draws, steps)))
                halves = np.array_split(np.column_stack([beta, np.log(noise)]), 2)
                out.append((r.asset, r.chain, np.maximum(0.0, y).ravel(), np.concatenate([h.mean(0) for h in halves]), np.concatenate([h.var(0, ddof=1) for h in halves])))
            yield pd.DataFrame(out, columns=["asset", "chain", "forecast", "means", "spreads"])

    return x.repartition("asset", "chain").mapInPandas(run, "asset string, chain int, forecast array<double>, means array<double>, spreads array<double>")


def posterior_forecast(df: DataFrame, steps: int = 7, chains: int = 4, draws: int = 500, changes: int = 5, seed: int = 1, chunk: int = CHUNK) -> DataFrame:
    """asset, step, mean, low, high (a band of 95 per cent of the samples), agreement: the largest ratio of the spread over all
    chains to that within their halves, 1 when they agree; under 1.05 they may be used."""
    s = stored(sampled(series_sums(df, changes, chunk), steps, chains, draws, changes=changes, seed=seed), "samples")

    def ratios(p: pd.DataFrame) -> pd.DataFrame:
        means, spreads = (np.concatenate([np.asarray(v).reshape(2, -1) for v in p[c]]) for c in ("means", "spreads"))
        half = draws // 2
        within = spreads.mean(axis=0)
        r = np.sqrt(((half - 1) / half * within + means.var(axis=0, ddof=1)) / np.maximum(within, 1e-300))
        return pd.DataFrame({"asset": p["asset"][:1], "agreement": [float(r.max())]})

    agree = s.select("asset", "means", "spreads").groupBy("asset").applyInPandas(ratios, "asset string, agreement double")
    each = s.select("asset", F.posexplode("forecast").alias("k", "y")).select("asset", (F.col("k") % steps + 1).alias("step"), "y")
    q = lambda p: F.percentile("y", F.lit(p))  # noqa: E731  chains x draws values, which parameters set
    return each.groupBy("asset", "step").agg(F.avg("y").alias("mean"), q(0.025).alias("low"), q(0.975).alias("high")).join(agree, "asset")
