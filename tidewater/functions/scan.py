"""Recurrences of long series by composing the chunks' affine maps.

A seeded mean keeps one number: the sum of its inputs until there are n, then their mean, then (1 - alpha) of it and alpha of
the next input. Means of means, and sums of them, keep one number each. How many inputs each has had at a chunk's start is
a matter of counting, so that over a chunk all numbers together go through one affine map, whatever they begin with. Every
chunk finds its map by itself (its inputs from zeros, and each unit vector without inputs); maps are composed in blocks of
BLOCK chunks and over the blocks, which gives the numbers at each chunk's start; then every chunk runs once more from there.
Tasks grow with the rows, not with the series. Chunks and maps are read several times, so both are written tables, which
also keeps plans of cascades short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import CHUNK, placed
from tidewater.session import stored

BLOCK = 256


class Mean(NamedTuple):
    """The mean of x that begins with the plain mean of n values and then takes alpha of each. adjust (n = 1): all values so
    far, weighted by powers of 1 - alpha, over the sum of weights."""

    x: str
    n: int
    alpha: float
    adjust: bool = False


class Sum(NamedTuple):
    """A weighted sum of columns that are null in the same rows or begin later."""

    terms: dict[str, float]


Steps = dict[str, Mean | Sum]


def ema(x: str, n: int) -> Mean:
    return Mean(x, n, 2 / (n + 1))


def rma(x: str, n: int) -> Mean:
    return Mean(x, n, 1 / n)


def weighted(x: str, span: int) -> Mean:
    return Mean(x, 1, 2 / (span + 1), True)


class Values(NamedTuple):
    """What a chunk has of a column: values (rows x runs), where they are, how many there were before."""

    values: np.ndarray
    have: np.ndarray
    before: int


def faded(x: np.ndarray, keep: float, gain: float, y: np.ndarray) -> np.ndarray:
    """y[t] = keep y[t-1] + gain x[t] down the rows of x, in strips within which powers of keep stay far from overflow."""
    if keep == 0 or not len(x):
        return gain * x
    strip = max(1, min(64, int(-200 / math.log10(keep)))) if keep < 1 else 64
    rows = -(-len(x) // strip)
    padded = np.zeros((rows * strip, x.shape[1]))
    padded[: len(x)] = gain * x
    k = np.arange(strip)[None, :, None]
    out = np.cumsum(padded.reshape(rows, strip, -1) * keep**-k, axis=1) * keep**k
    last = keep ** (k[0] + 1)
    for r in range(rows):
        out[r] += last * y
        y = out[r, -1]
    return out.reshape(rows * strip, -1)[: len(x)]


def stepped(step: Mean, x: Values, start: np.ndarray) -> tuple[Values, np.ndarray]:
    """A mean over a chunk, and the number that it keeps at the end."""
    at = np.flatnonzero(x.have)
    v, need, keep = x.values[at], step.n - x.before, 1 - step.alpha
    out, have = np.full(x.values.shape, np.nan), np.zeros(len(x.have), bool)
    if step.adjust:
        y = faded(v, keep, 1.0, start)
        k = x.before + 1 + np.arange(len(at))[:, None]
        out[at], have[at] = y * step.alpha / (1 - keep**k), True
        return Values(out, have, x.before), y[-1] if len(y) else start
    if need > len(at):
        return Values(out, have, 0), start + v.sum(axis=0)
    if need > 0:
        first = (start + v[:need].sum(axis=0)) / step.n
        y = np.concatenate([first[None], faded(v[need:], keep, step.alpha, first)])
        at = at[need - 1 :]
    else:
        y = faded(v, keep, step.alpha, start)
    out[at], have[at] = y, True
    return Values(out, have, max(0, x.before - step.n + 1)), y[-1] if len(y) else start


def run(steps: Steps, inputs: dict[str, Values], starts: np.ndarray) -> tuple[dict[str, Values], np.ndarray]:
    """All steps over a chunk from starts (means x runs), and the numbers at the end."""
    known, ends = dict(inputs), np.array(starts)
    for k, (name, step) in enumerate((n, s) for n, s in steps.items() if isinstance(s, Mean)):
        known |= _sums(steps, known)
        known[name], ends[k] = stepped(step, known[step.x], starts[k])
    return known | _sums(steps, known), ends


def _sums(steps: Steps, known: dict[str, Values]) -> dict[str, Values]:
    ready = {n: s for n, s in steps.items() if isinstance(s, Sum) and n not in known and all(t in known for t in s.terms)}
    return {n: Values(sum(w * known[t].values for t, w in s.terms.items()), np.logical_and.reduce([known[t].have for t in s.terms]), min(known[t].before for t in s.terms)) for n, s in ready.items()}


def _inputs(pdf: pd.DataFrame, columns: list[str], runs: int) -> dict[str, Values]:
    """The chunk's inputs: in the first run themselves, in the others zero."""
    out = {}
    for c in columns:
        v = pdf[c].to_numpy(float)
        x = np.zeros((len(v), runs))
        x[:, 0] = np.nan_to_num(v, nan=0.0)
        out[c] = Values(x, ~np.isnan(v), int(pdf[f"_before_{c}"].iloc[0]))
    return out


def composed(maps: Iterator[np.ndarray], size: int) -> np.ndarray:
    """One affine map (matrix beside vector) for several in order."""
    whole = np.eye(size, size + 1)
    for m in maps:
        whole = m[:, :size] @ whole
        whole[:, size] += m[:, size]
    return whole


def recurrences(df: DataFrame, steps: Steps, by: str = "asset", ts: str = "bar", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """df with a column for each step, null until it has begun and where its input is null. Columns of df that have the name
    of a step are replaced. Steps may build on columns of df and on each other."""
    means = [n for n, s in steps.items() if isinstance(s, Mean)]
    used = {c for s in steps.values() for c in ([s.x] if isinstance(s, Mean) else s.terms)}
    columns, size = sorted(used - steps.keys()), len(means)
    kept = [c for c in df.columns if c not in steps]
    x = stored(placed(df.select(*kept), by, ts).withColumn("_chunk", F.floor(F.col("_at") / chunk)), "chunks")
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(by, "_chunk").agg(*(F.count(c).alias(f"_n_{c}") for c in columns))
    counts = counts.select(F.col(by).alias("_of"), F.col("_chunk").alias("_of_chunk"), *(F.coalesce(F.sum(f"_n_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns))
    x = x.join(counts, (F.col(by) == F.col("_of")) & (F.col("_chunk") == F.col("_of_chunk"))).drop("_of", "_of_chunk")
    key = f"`{by}` {df.schema[by].dataType.simpleString()}"

    def map_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", ignore_index=True)
        _, ends = run(steps, _inputs(pdf, columns, size + 1), np.eye(size, size + 1, 1))
        return pd.DataFrame({by: pdf[by][:1], "_chunk": pdf["_chunk"][:1], "_map": [np.roll(ends, -1, axis=1).ravel()]})

    def read(m: np.ndarray) -> np.ndarray:
        return np.asarray(m).reshape(size, size + 1)

    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        return pd.DataFrame({by: pdf[by].iloc[:1], "_block": pdf["_block"].iloc[:1], "_map": [composed(map(read, pdf["_map"]), size).ravel()]})

    def walk(pdf: pd.DataFrame, at: str, state: np.ndarray) -> pd.DataFrame:
        """The numbers at the start of each of several maps in a row."""
        pdf, states = pdf.sort_values(at), []
        for m in map(read, pdf["_map"]):
            states.append(state)
            state = m[:, :size] @ state + m[:, size]
        return pd.DataFrame({by: pdf[by], at: pdf[at], "_state": states})

    def block_starts(pdf: pd.DataFrame) -> pd.DataFrame:
        return walk(pdf, "_block", np.zeros(size))

    def chunk_starts(maps: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        return walk(maps, "_chunk", np.asarray(blocks["_state"].iloc[0]))

    def fill(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", ignore_index=True)
        found, _ = run(steps, _inputs(pdf, columns, 1), np.asarray(start["_state"].iloc[0])[:, None])
        for n in steps:
            pdf[n] = np.where(found[n].have, found[n].values[:, 0], np.nan)
        return pdf[names]

    names = [*kept, *steps]
    maps = x.groupBy(by, "_chunk").applyInPandas(map_of, f"{key}, _chunk long, _map array<double>")
    maps = stored(maps.withColumn("_block", F.floor(F.col("_chunk") / block)), "maps")
    blocks = maps.groupBy(by, "_block").applyInPandas(block_map, f"{key}, _block long, _map array<double>")
    blocks = blocks.groupBy(by).applyInPandas(block_starts, f"{key}, _block long, _state array<double>")
    starts = maps.groupBy(by, "_block").cogroup(blocks.groupBy(by, "_block")).applyInPandas(chunk_starts, f"{key}, _chunk long, _state array<double>")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), *(f"`{n}` double" for n in steps)])
    return x.groupBy(by, "_chunk").cogroup(starts.groupBy(by, "_chunk")).applyInPandas(fill, schema)
