"""Fourier transforms of long series in steps over short ones, with no group above the square root of the length times STRIP.

A length is brought to a power of two, R times C, by writing the transform as a convolution with a chirp (whose own transform needs
no data). Place m = r + R c: every r transforms its C values, all are turned by a twiddle, and every k of C, a strip of them a
group, transforms its R values: bin k + C j. The product's inverse transform begins with transforms over j, which each strip
has at hand, and ends with those over k, so that a series is shuffled three times: by r, by k and by the result's strips.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.ordered import placed

STRIP = 64


def lengths(n: int) -> tuple[int, int]:
    """R and C: two powers of two whose product is at least 2 n - 1; R is at most n."""
    p = max(0, (2 * n - 2).bit_length())
    return 1 << (p // 2), 1 << (p - p // 2)


def chirp(m: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi m^2 / n), the square taken modulo 2 n in whole numbers."""
    m = np.asarray(m, np.int64)
    return np.exp(1j * np.pi * ((m * m) % (2 * n)) / n)


def kernel(m: np.ndarray, n: int, whole: int) -> np.ndarray:
    """The chirp wrapped around a length: at m and at whole - m for m below n, 0 elsewhere."""
    near = np.minimum(m, whole - m)
    return np.where(near < n, chirp(near, n), 0)


def transformed(df: DataFrame, x: str, by: str = "asset", ts: str = "bar") -> DataFrame:
    """by, n, k, re, im: the discrete Fourier transform of each series, all n bins."""
    p = placed(df.select(by, ts, F.col(x).cast("double").alias("_x")), by, ts)
    n = p.groupBy(F.col(by).alias("_b")).agg(F.count("*").alias("n"))
    # bits of 2 n - 2: the power that lengths() takes
    bits = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(2 * F.col("n") - 2)))
    p = p.join(n, F.col(by) == F.col("_b")).withColumn("_r", F.col("_at") % F.round(F.pow(F.lit(2.0), F.floor(bits / 2))).cast("long"))
    key = f"`{by}` {df.schema[by].dataType.simpleString()}, n long"
    four = "ar array<double>, ai array<double>, br array<double>, bi array<double>"

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        """The C values of an r, of the series and of the kernel, transformed, turned and cut into strips."""
        size, r, asset = int(pdf["n"].iloc[0]), int(pdf["_r"].iloc[0]), pdf[by].iloc[0]
        rows, cols = lengths(size)
        at = pdf["_at"].to_numpy()
        a = np.zeros(cols, complex)
        a[at // rows] = pdf["_x"].fillna(0.0).to_numpy() * np.conj(chirp(at, size))
        turn = np.exp(-2j * np.pi * ((r * np.arange(cols)) % (rows * cols)) / (rows * cols))
        fa = np.fft.fft(a) * turn
        fb = np.fft.fft(kernel(r + rows * np.arange(cols), size, rows * cols)) * turn
        strips = range(0, cols, STRIP)
        cut = lambda v: [v[s : s + STRIP] for s in strips]
        return pd.DataFrame({by: asset, "n": size, "_s": list(range(len(strips))), "_r": r, "ar": cut(fa.real), "ai": cut(fa.imag), "br": cut(fb.real), "bi": cut(fb.imag)})

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """A strip of k: transforms over r, the product of both, and the first half of the way back."""
        size, strip, asset = int(pdf["n"].iloc[0]), int(pdf["_s"].iloc[0]), pdf[by].iloc[0]
        rows, cols = lengths(size)
        pdf = pdf.sort_values("_r")
        of = lambda c: np.stack([np.asarray(v) for v in pdf[c]])
        z = np.fft.fft(of("ar") + 1j * of("ai"), axis=0) * np.fft.fft(of("br") + 1j * of("bi"), axis=0)  # j by k
        k = strip * STRIP + np.arange(z.shape[1])
        q = np.arange(rows)
        back = np.fft.fft(np.conj(z), axis=0) * np.exp(-2j * np.pi * ((q[:, None] * k[None, :]) % (rows * cols)) / (rows * cols))  # q by k
        strips = range(0, rows, STRIP)
        part = [back[s : s + STRIP] for s in strips]
        return pd.DataFrame({by: asset, "n": size, "_q": list(range(len(strips))), "_s": strip, "ar": [b.real.ravel() for b in part], "ai": [b.imag.ravel() for b in part]})

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        """A strip of q: transforms over k, and the chirp taken off: bin q + R p."""
        size, strip, asset = int(pdf["n"].iloc[0]), int(pdf["_q"].iloc[0]), pdf[by].iloc[0]
        rows, cols = lengths(size)
        wide = min(STRIP, rows - strip * STRIP)
        pdf = pdf.sort_values("_s")
        of = lambda c: np.concatenate([np.asarray(v).reshape(wide, -1) for v in pdf[c]], axis=1)
        y = np.conj(np.fft.fft(of("ar") + 1j * of("ai"), axis=1)) / (rows * cols)
        bins = (strip * STRIP + np.arange(wide))[:, None] + rows * np.arange(cols)[None, :]
        keep = bins < size
        got = y[keep] * np.conj(chirp(bins[keep], size))
        return pd.DataFrame({by: asset, "n": size, "k": bins[keep], "re": got.real, "im": got.imag})

    x1 = p.select(by, "n", "_r", "_at", "_x").groupBy(by, "_r").applyInPandas(columns, f"{key}, _s int, _r long, {four}")
    x2 = x1.groupBy(by, "_s").applyInPandas(rows_of, f"{key}, _q int, _s int, ar array<double>, ai array<double>")
    return x2.groupBy(by, "_q").applyInPandas(ends, f"{key}, k long, re double, im double")
