"""Markov chains over price states: transition tables, stationary and absorbing quantities, simulation."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import over_chunks
from tidewater.functions.selection import percentiles


def transitions(df: DataFrame, state: str) -> DataFrame:
    """asset, from_state, to_state, n, p: moves between consecutive bars, p by from_state."""
    x = over_chunks(df, 1, lambda w: {"from_state": F.lag(state).over(w)}).filter("from_state is not null")
    n = x.groupBy("asset", "from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("asset", "from_state")))


def quantile_bins(df: DataFrame, k: int, x: str = "close") -> DataFrame:
    """df with state, 0 to k - 1: bins of equal shares by exact percentiles of each asset."""
    cuts = percentiles(df, ["asset"], x, [j / k for j in range(1, k)], "cuts").withColumnRenamed("asset", "_a")
    return df.join(cuts, F.col("asset") == F.col("_a")).withColumn("state", F.size(F.filter("cuts", lambda c: c < F.col(x)))).drop("_a", "cuts")


def equal_bins(df: DataFrame, k: int, x: str = "close") -> DataFrame:
    """df with state, 0 to k - 1: bins of equal width of each asset; the largest value is in the last."""
    ends = df.groupBy(F.col("asset").alias("_a")).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / k, F.lit(0.0))
    return df.join(ends, F.col("asset") == F.col("_a")).withColumn("state", F.coalesce(F.least(F.floor((F.col(x) - F.col("lo")) / width), F.lit(k - 1)), F.lit(0)).cast("int")).drop("_a", "lo", "hi")


def kmeans_bins(df: DataFrame, k: int, x: str = "close", seed: int = 1) -> DataFrame:
    """df with state, 0 to k: bins that the centres of k clusters of x cut, each with its upper edge; the least value is in
    the first."""
    v = VectorAssembler(inputCols=[x], outputCol="_v").transform(df.select(x).dropna())
    centres = sorted(float(c[0]) for c in KMeans(k=k, seed=seed, featuresCol="_v").fit(v).clusterCenters())
    return df.withColumn("state", sum((F.when(F.col(x) > c, 1).otherwise(0) for c in centres), F.lit(0)))


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    states = np.unique(np.concatenate([pdf["from_state"], pdf["to_state"]]))
    m = np.zeros((len(states), len(states)))
    m[np.searchsorted(states, pdf["from_state"]), np.searchsorted(states, pdf["to_state"])] = pdf["p"]
    m[m.sum(axis=1) == 0] = 1 / len(states)  # a state that is never left: uniform
    return states, m


def steady_state(moves: DataFrame) -> DataFrame:
    """asset, state, share: the stationary distribution. A chain's matrix is states squared, whatever the input."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        states, m = _matrix(pdf)
        a = np.vstack([m.T - np.eye(len(m)), np.ones(len(m))])
        pi = np.linalg.lstsq(a, np.append(np.zeros(len(m)), 1.0), rcond=None)[0]
        return pd.DataFrame({"asset": pdf["asset"].iloc[0], "state": states, "share": pi})

    return moves.select("asset", F.col("from_state").cast("int"), F.col("to_state").cast("int"), "p").groupBy("asset").applyInPandas(run, "asset string, state int, share double")


def absorbing_steps(moves: DataFrame, target: int) -> DataFrame:
    """asset, state, steps: expected moves until the target state; the target itself counts 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        states, m = _matrix(pdf)
        rest = states != target
        q = m[np.ix_(rest, rest)]
        steps = np.ones(len(states))
        steps[rest] = np.linalg.lstsq(np.eye(len(q)) - q, np.ones(len(q)), rcond=None)[0]
        return pd.DataFrame({"asset": pdf["asset"].iloc[0], "state": states, "steps": steps})

    return moves.select("asset", F.col("from_state").cast("int"), F.col("to_state").cast("int"), "p").groupBy("asset").applyInPandas(run, "asset string, state int, steps double")


def _paths(cum: np.ndarray, ids: pd.Series, start: int, steps: int, shocks: dict[int, float], seed: int) -> np.ndarray:
    draws = np.array([np.random.default_rng((seed, int(k))).random(steps) for k in ids]).reshape(len(ids), steps)
    return _walked(cum, draws, start, shocks)


def _walked(cum: np.ndarray, draws: np.ndarray, start: int, shocks: dict[int, float]) -> np.ndarray:
    """The states of walks (rows of draws) through a matrix of cumulative shares."""
    state = np.full(len(draws), start)
    path = [state]
    for t in range(draws.shape[1]):
        if t in shocks:
            state = np.clip((state * shocks[t]).astype(int), 0, len(cum) - 1)
        state = np.minimum((cum[state] < draws[:, t, None]).sum(axis=1), len(cum) - 1)
        path.append(state)
    return np.stack(path, axis=1).astype(np.int32)


def markov_paths(spark: SparkSession, matrix: np.ndarray, start: int, steps: int, runs: int, sims: int, shocks: dict[int, float] | None = None, seed: int = 0) -> DataFrame:
    """path array<int>, n: how often each path occurred in runs * sims simulations. Each simulation draws from a
    generator seeded by its number, so the result doesn't depend on the partitioning. shocks: at these steps the state's
    number is multiplied, and kept within the states."""
    cum, shocks = np.cumsum(matrix, axis=1), shocks or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": list(_paths(cum, b["id"], start, steps, shocks, seed))})

    return spark.range(runs * sims).mapInPandas(run, "path array<int>").groupBy("path").agg(F.count("*").alias("n"))


def whole_table(moves: DataFrame) -> DataFrame:
    """asset, from_state, to_state, p for every pair of an asset's states: 0 for moves that never happened, and the same
    share for all where a state was never left. states squared rows an asset."""
    known = moves.select("asset", F.col("from_state").alias("s")).unionByName(moves.select("asset", F.col("to_state").alias("s"))).distinct()
    sizes = known.groupBy("asset").agg(F.count("*").alias("_k"))
    pairs = known.withColumnRenamed("s", "from_state").join(known.withColumnRenamed("s", "to_state"), "asset").join(sizes, "asset")
    left = moves.select("asset", "from_state").distinct().withColumn("_left", F.lit(True))
    x = pairs.join(left, ["asset", "from_state"], "left").join(moves.select("asset", "from_state", "to_state", "p"), ["asset", "from_state", "to_state"], "left")
    return x.select("asset", "from_state", "to_state", F.when(F.col("_left"), F.coalesce("p", F.lit(0.0))).otherwise(1 / F.col("_k")).alias("p"))


def asset_paths(moves: DataFrame, states: int, start: int, steps: int, runs: int, sims: int, shocks: dict[int, float] | None = None, seed: int = 0) -> DataFrame:
    """asset, path array<int>, n: how often each path occurred in runs times sims simulations of the transitions of every
    asset. A run has a seed of its own, the same for all assets."""
    shocks = shocks or {}
    # one row an asset: its matrix, states squared
    cells = moves.groupBy("asset").agg(F.collect_list(F.struct(F.col("from_state").cast("int").alias("f"), F.col("to_state").cast("int").alias("t"), F.col("p"))).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                m = np.zeros((states, states))
                for c in r.cells:
                    m[c["f"], c["t"]] = c["p"]
                draws = np.random.default_rng((seed, int(r.run))).random((sims, steps))
                yield pd.DataFrame({"asset": r.asset, "path": list(_walked(np.cumsum(m, axis=1), draws, start, shocks))})

    each = cells.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).repartition("asset", "run")
    return each.mapInPandas(run, "asset string, path array<int>").groupBy("asset", "path").agg(F.count("*").alias("n"))


# Rates, means and deviations of jumps in each state of the market.
MARKETS = {
    "bullish": ((0.1, 0.15, 0.2), (0.05, 0.1, 0.15), (0.1, 0.15, 0.2)),
    "bearish": ((0.1, 0.2, 0.3), (-0.2, -0.15, -0.1), (0.2, 0.3, 0.4)),
    "neutral": ((0.1, 0.2, 0.3), (-0.05, 0.0, 0.05), (0.15, 0.2, 0.25)),
}


def market_grid(series: DataFrame) -> DataFrame:
    """A row for each of series and each combination of jumps in each market: market, config, jump_rate, jump_mean, jump_std."""
    rows = [(m, *c) for m, values in MARKETS.items() for c in itertools.product(*values)]
    grid = F.array(*(F.struct(F.lit(m).alias("market"), F.lit(k).alias("config"), F.lit(a).alias("jump_rate"), F.lit(b).alias("jump_mean"), F.lit(c).alias("jump_std")) for k, (m, a, b, c) in enumerate(rows)))
    return series.withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g")


def price_limit(df: DataFrame, x: str = "close") -> DataFrame:
    """asset, limit: the 99th percentile of the prices, or the highest price if that is more, as it always is: so the highest
    price decides, and no percentile has to be found."""
    return df.groupBy("asset").agg(F.max(x).alias("limit"))


def jump_paths(grid: DataFrame, sims: int, steps: int, dt: float, seed: int = 0) -> DataFrame:
    """grid with kept, mean_final, p5, p95 of Merton jump diffusion paths: grid rows have config, s0, mu, sigma,
    jump_rate, jump_mean, jump_std, limit, and asset; config is unique within an asset, and draws the same numbers for each.
    Paths that reach the row's limit anywhere, their start included, are dropped. Simulations are spread as blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                rng = np.random.default_rng((seed, int(r.config), int(r.block)))
                n = rng.poisson(r.jump_rate * dt, (int(r.size), steps))
                jump = n * r.jump_mean + np.sqrt(n) * r.jump_std * rng.standard_normal((int(r.size), steps))
                drift = (r.mu - r.sigma**2 / 2) * dt + r.sigma * np.sqrt(dt) * rng.standard_normal((int(r.size), steps))
                path = r.s0 * np.exp(np.cumsum(drift + jump, axis=1))
                fine = np.maximum(path.max(axis=1), r.s0) < r.limit
                out += [(r.asset, r.config, float(x)) for x in path[fine, -1]]
            yield pd.DataFrame(out, columns=["asset", "config", "final"])

    size = 500
    blocks = grid.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-sims // size) - 1)))).withColumn("size", F.least(F.lit(size), F.lit(sims) - F.col("block") * size))
    finals = blocks.repartition("asset", "config", "block").mapInPandas(run, "asset string, config int, final double")
    q = lambda p: F.percentile("final", F.lit(p))
    return grid.join(finals.groupBy("asset", "config").agg(F.count("*").alias("kept"), F.avg("final").alias("mean_final"), q(0.05).alias("p5"), q(0.95).alias("p95")), ["asset", "config"], "left")
