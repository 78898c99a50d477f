"""Best sets of trades by products in the semiring of maximum and sum.

What a stretch of bars can do for a trader is a table: the most that can be gained from each state at its start to each at its
end. Two stretches in a row have the product of their tables, where sums take the place of products and maxima that of
sums. So chunks make their tables by themselves, and a tree multiplies them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewater.functions.ordered import CHUNK
from tidewater.functions.tree import FAN, reduced

NONE = -np.inf


def one_after_the_other(p: np.ndarray, most: int) -> np.ndarray:
    """gain[start, end, k]: the most from holding nothing (0) or a share (1) to the same, with k purchases in between. The
    gain doesn't depend on how many there were before."""
    gain = np.full((2, 2, most + 1), NONE)
    gain[0, 0, 0] = gain[1, 1, 0] = 0.0
    for x in p:
        gain[:, 1, 1:] = np.maximum(gain[:, 1, 1:], gain[:, 0, :-1] - x)
        gain[:, 0] = np.maximum(gain[:, 0], gain[:, 1] + x)
    return gain


def chained(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The table of two stretches in a row: over the state between them, and the split of the purchases."""
    a, b = a.reshape(2, 2, most + 1), b.reshape(2, 2, most + 1)
    out = np.full_like(a, NONE)
    for k in range(most + 1):
        out[:, :, k:] = np.maximum(out[:, :, k:], (a[:, :, None, k, None] + b[None, :, :, : most + 1 - k]).max(axis=1))
    return out.ravel()


def multi_trades(df: DataFrame, most: int = 10, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """asset, trades, profit: the best at most `most` trades of one share, one after the other."""
    table = reduced(df.select("asset", "bar", "close"), lambda p: one_after_the_other(p["close"].to_numpy(float), most).ravel(), lambda a, b: chained(a, b, most), chunk=chunk, fan=fan)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            free = [np.asarray(v).reshape(2, 2, most + 1)[0, 0] for v in p["value"]]
            yield pd.DataFrame({"asset": p["asset"], "trades": [int(np.argmax(f)) for f in free], "profit": [float(f.max()) for f in free]})

    return table.mapInPandas(best, "asset string, trades int, profit double")


def selections(p: pd.DataFrame, n: int) -> np.ndarray:
    """gain[start, end] between states of i purchases and j sales so far, when there are n of each in the end: a sale gains its
    close with every purchase before it, a purchase costs its open with every sale still to come. A day's sale comes first,
    so that no day is sold against itself."""
    side = n + 1
    gain = np.full((side, side, side, side), NONE)  # i and j at the start, i and j now
    for i in range(side):
        for j in range(side):
            gain[i, j, i, j] = 0.0
    bought, left = np.arange(side)[:, None], n - np.arange(side)[None, :]
    for o, c in zip(p["open"].to_numpy(float), p["close"].to_numpy(float), strict=True):
        gain[..., :, 1:] = np.maximum(gain[..., :, 1:], gain[..., :, :-1] + c * bought)
        gain[..., 1:, :] = np.maximum(gain[..., 1:, :], gain[..., :-1, :] - o * left)
    return gain.reshape(side * side, side * side)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices with maxima for sums and sums for products."""
    return np.stack([(row[:, None] + b).max(axis=0) for row in a])


def selected_pairs(df: DataFrame, most: int = 10, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """asset, days, profit: at most `most` buying days (at the open) and as many selling days (at the close), where every
    selected later sale counts with every selected earlier purchase."""
    sizes = [(n + 1) ** 2 for n in range(1, most + 1)]
    cuts = np.cumsum([0] + [s * s for s in sizes])
    part = lambda v, k: v[cuts[k] : cuts[k + 1]].reshape(sizes[k], sizes[k])
    of_chunk = lambda p: np.concatenate([selections(p, n).ravel() for n in range(1, most + 1)])
    both = lambda a, b: np.concatenate([product(part(a, k), part(b, k)).ravel() for k in range(most)])
    table = reduced(df.select("asset", "bar", "open", "close"), of_chunk, both, chunk=chunk, fan=fan)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            # from nothing bought or sold to all n of each
            worth = [[0.0, *(part(np.asarray(v), k)[0, -1] for k in range(most))] for v in p["value"]]
            yield pd.DataFrame({"asset": p["asset"], "days": [int(np.argmax(w)) for w in worth], "profit": [float(max(w)) for w in worth]})

    return table.mapInPandas(best, "asset string, days int, profit double")
