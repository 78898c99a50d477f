"""Settings of a model searched by a surrogate: a Gaussian process over the trials so far tells which settings are expected
to improve most. Trials are Spark jobs, several at once; what the driver holds is a number for each trial."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.models import next_close


class Whole(NamedTuple):
    """Whole numbers from low up to high."""

    low: int
    high: int


Space = dict[str, Whole | tuple]
#: Settings that are drawn for each proposal.
DRAWS = 2000
#: Length scales and shares of noise that are tried for the process.
LENGTHS, NOISES = (0.1, 0.2, 0.4, 0.8, 1.6), (1e-6, 1e-3, 1e-2, 1e-1)


def encoded(space: Space, settings: list[dict]) -> np.ndarray:
    """A row of numbers from 0 to 1 for each setting; choices are a column for each value."""
    columns = []
    for name, of in space.items():
        got = [s[name] for s in settings]
        if isinstance(of, Whole):
            columns.append([(v - of.low) / max(1, of.high - of.low) for v in got])
        else:
            columns += [[float(v == c) / math.sqrt(2) for v in got] for c in of]
    return np.array(columns, float).T.reshape(len(settings), -1)


def drawn(space: Space, n: int, rng: np.random.Generator) -> list[dict]:
    """n settings, evenly at random."""
    columns = {k: rng.integers(of.low, of.high + 1, n).tolist() if isinstance(of, Whole) else [of[i] for i in rng.integers(0, len(of), n)] for k, of in space.items()}
    return [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)]


def near(space: Space, setting: dict, rng: np.random.Generator) -> list[dict]:
    """Settings that differ in one place from a given one; whole numbers by up to a tenth of their range."""
    out = []
    for name, of in space.items():
        step = max(1, (of.high - of.low) // 10) if isinstance(of, Whole) else 0
        values = {int(np.clip(setting[name] + k, of.low, of.high)) for k in rng.integers(-step, step + 1, 8)} if isinstance(of, Whole) else of
        out += [setting | {name: v} for v in values if v != setting[name]]
    return out


def kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """Matern's with two derivatives."""
    d = np.sqrt(5 * ((a[:, None] - b[None]) ** 2).sum(axis=2)) / length
    return (1 + d + d**2 / 3) * np.exp(-d)


class Process:
    """A Gaussian process through observations; length scale and noise are the likeliest of LENGTHS and NOISES."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.mean, self.scale = x, float(np.mean(y)), float(np.std(y)) or 1.0
        z = (y - self.mean) / self.scale
        fits = []
        for length in LENGTHS:
            for noise in NOISES:
                lower = np.linalg.cholesky(kernel(x, x, length) + (noise + 1e-10) * np.eye(len(x)))
                w = np.linalg.solve(lower, z)
                fits.append((-0.5 * w @ w - np.log(np.diag(lower)).sum(), length, lower, w))
        _, self.length, self.lower, self.w = max(fits, key=lambda f: f[0])

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations."""
        v = np.linalg.solve(self.lower, kernel(self.x, x, self.length))
        return self.mean + self.scale * (v.T @ self.w), self.scale * np.sqrt(np.maximum(1 - (v**2).sum(axis=0), 1e-12))


def expected_improvement(mean: np.ndarray, deviation: np.ndarray, best: float) -> np.ndarray:
    """By how much a value of that distribution is expected to lie under best, higher ones counting as 0."""
    z = (best - mean) / deviation
    below = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    return (best - mean) * below + deviation * np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)


def proposals(space: Space, known: list[tuple[dict, float]], n: int, rng: np.random.Generator) -> list[dict]:
    """n new settings to try at once: each is the one of largest expected improvement if those before it turn out as the
    process expects. Fewer where the space has no more."""
    tried, values = [s for s, _ in known], [v for _, v in known]
    out: list[dict] = []
    for _ in range(n):
        best = tried[int(np.argmin(values))]
        some = [s for s in drawn(space, DRAWS, rng) + near(space, best, rng) if s not in tried]
        if not some:
            break
        process = Process(encoded(space, tried), np.array(values))
        mean, deviation = process.at(encoded(space, some))
        k = int(np.argmax(expected_improvement(mean, deviation, min(values))))
        out.append(some[k])
        tried, values = [*tried, some[k]], [*values, float(mean[k])]
    return out


def search(losses: Callable[[list[dict]], list[float]], space: Space, trials: int = 50, initial: int = 10, at_once: int = 4, seed: int = 1) -> list[tuple[dict, float]]:
    """Settings and their losses in the order of the trials: initial ones at random, then proposals, at_once of them
    together. losses takes a list of settings. No setting is tried twice; a small space ends before trials are up."""
    rng, known = np.random.default_rng(seed), []
    first: list[dict] = []
    for s in drawn(space, 20 * initial, rng):
        if s not in first and len(first) < min(initial, trials):
            first.append(s)
    batch = first
    while batch:
        known += zip(batch, losses(batch), strict=True)
        batch = proposals(space, known, min(at_once, trials - len(known)), rng)
    return known


#: 30 is the largest depth that a forest may have here. least: rows of a leaf.
FOREST: Space = {"trees": Whole(100, 200), "features": ("sqrt", "log2"), "depth": (10, 20, 30), "least": Whole(1, 4), "bootstrap": (True, False)}


def forest_loss(x: DataFrame, setting: dict, splits: int, seed: int) -> float:
    """The mean over rolling origins of a forest's mean squared error: each split trains on the bars of all series up to its
    origin and is tested on the part behind it. x: rows of next_close()."""
    model = RandomForestRegressor(
        featuresCol="_f", labelCol="_next", predictionCol="predicted", numTrees=setting["trees"], maxDepth=setting["depth"], minInstancesPerNode=setting["least"], featureSubsetStrategy=setting["features"], bootstrap=setting["bootstrap"], seed=seed
    )
    # trees draw rows by partition and place, so these are fixed, and a trial repeats its result
    parts, errors = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
    x = x.repartition(parts, "asset", "_place").sortWithinPartitions("asset", "_place")
    for k in range(1, splits + 1):
        low, high = F.col("_n") * k / (splits + 1), F.col("_n") * (k + 1) / (splits + 1)
        tested = model.fit(x.filter(F.col("_place") < low)).transform(x.filter((F.col("_place") >= low) & (F.col("_place") < high)))
        errors.append(tested.agg(F.avg((F.col("predicted") - F.col("_next")) ** 2)).first()[0])
    return float(np.mean(errors))


def forest_surrogate_search(df: DataFrame, trials: int = 50, splits: int = 5, initial: int = 10, at_once: int = 4, space: Space = FOREST, seed: int = 1) -> DataFrame:
    """trial, the settings, mse and rank of all trials of a search of the forest that forecasts the next close. Series too
    short for the splits have no part in those that they don't reach."""
    x, _ = next_close(df)
    x = x.dropna(subset=["_next"]).select("asset", "_place", "_n", "_f", "_next")

    def losses(settings: list[dict]) -> list[float]:
        with ThreadPoolExecutor(at_once) as pool:
            jobs = [pool.submit(inheritable_thread_target(df.sparkSession)(lambda s=s: forest_loss(x, s, splits, seed))) for s in settings]
            return [j.result() for j in jobs]

    found = search(losses, space, trials, initial, at_once, seed)
    rank = np.argsort(np.argsort([v for _, v in found], kind="stable"), kind="stable") + 1
    rows = [(k, *(s[c] for c in ("trees", "features", "depth", "least", "bootstrap")), v, int(r)) for k, ((s, v), r) in enumerate(zip(found, rank, strict=True), 1)]
    return df.sparkSession.createDataFrame(rows, "trial int, trees int, features string, depth int, least int, bootstrap boolean, mse double, rank int")
