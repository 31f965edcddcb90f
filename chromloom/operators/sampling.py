"""Thinning of integer counts by binomial draws that depend on an entry's key alone, so that a result can be repeated on any cluster.

Every entry has a stream of uniform numbers of its own: a hash of its key and a counter. A draw of few expected successes
inverts the distribution with one of them; one of many is Hörmann's transformed rejection ("The generation of binomial random
variates", 1993), with two a trial and 1.2 trials on average. So the cost does not depend on the counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expected successes from which on draws are by rejection.
MANY = 10.0
_U = np.uint64


def uniforms(key: np.ndarray, counter: int) -> np.ndarray:
    """Numbers in (0, 1), the counter-th of each key's stream (the mixing of splitmix64)."""
    x = key.astype(_U) + _U((counter + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return ((x ^ (x >> _U(31))) >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _inverted(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The smallest k with P(X <= k) >= u, by adding up the probabilities; p at most a half, n p below MANY."""
    k, odds = np.zeros(len(n)), p / (1 - p)
    mass = np.exp(n * np.log1p(-p))
    total, open_ = mass.copy(), u > mass
    while open_.any():
        k[open_] += 1
        mass[open_] *= odds[open_] * (n[open_] - k[open_] + 1) / k[open_]
        total[open_] += mass[open_]
        open_ &= (u > total) & (k < n)
    return k


def _log_factorial_rest(k: np.ndarray) -> np.ndarray:
    """ln k! less Stirling's (k + 1/2) ln(k + 1) - (k + 1) + ln(2 pi) / 2."""
    x = k + 1.0
    s = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / s) / s) / s) / x
    small = np.asarray([np.log(np.arange(1, j + 1)).sum() - ((j + 0.5) * np.log(j + 1.0) - (j + 1) + 0.5 * np.log(2 * np.pi)) for j in range(10)])
    return np.where(k < 10, small[np.minimum(k, 9).astype(int)], series)


def _rejected(n: np.ndarray, p: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Transformed rejection; p at most a half, n p at least MANY."""
    out, left, trial = np.zeros(len(n)), np.arange(len(n)), 0
    spread = np.sqrt(n * p * (1 - p))
    b = 1.15 + 2.53 * spread
    a = -0.0873 + 0.0248 * b + 0.01 * p
    centre, alpha, v_r = n * p + 0.5, (2.83 + 5.1 / b) * spread, 0.92 - 4.2 / b
    mode = np.floor((n + 1) * p)
    while len(left):
        u, v = uniforms(key[left], 2 * trial + 1) - 0.5, uniforms(key[left], 2 * trial + 2)
        us = 0.5 - np.abs(u)
        i_n, i_p, i_b, m = n[left], p[left], b[left], mode[left]
        k = np.floor((2 * a[left] / us + i_b) * u + centre[left])
        inside = (k >= 0) & (k <= i_n)
        sure = inside & (us >= 0.07) & (v <= v_r[left])
        safe = np.clip(k, 0, i_n)
        with np.errstate(divide="ignore"):
            height = np.log(v * alpha[left] / (a[left] / (us * us) + i_b))
        bound = (
            (m + 0.5) * np.log((m + 1) / ((i_p / (1 - i_p)) * (i_n - m + 1)))
            + (i_n + 1) * np.log((i_n - m + 1) / (i_n - safe + 1))
            + (safe + 0.5) * np.log((i_p / (1 - i_p)) * (i_n - safe + 1) / (safe + 1))
            + _log_factorial_rest(m) + _log_factorial_rest(i_n - m) - _log_factorial_rest(safe) - _log_factorial_rest(i_n - safe)
        )
        taken = sure | (inside & (height <= bound))
        out[left[taken]] = k[taken]
        left, trial = left[~taken], trial + 1
    return out


def binomial(n: np.ndarray, p: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A draw of Binomial(n, p) for each entry, the same whenever its key (64 bits), n and p are."""
    n, p = np.floor(np.maximum(np.nan_to_num(n), 0)), np.clip(np.nan_to_num(p), 0, 1)
    flip = p > 0.5
    q = np.where(flip, 1 - p, p)
    out = np.zeros(len(n))
    many, few = n * q >= MANY, (n * q < MANY) & (n * q > 0)
    out[few] = _inverted(n[few], q[few], uniforms(key[few], 0))
    out[many] = _rejected(n[many], q[many], key[many])
    return np.where(flip, n - out, out)


def thinned(value: str, rate: Column, seed: int, *key: str) -> Column:
    """A binomial draw: how many of `value` reads are kept at the rate."""

    @F.pandas_udf("double")
    def draw(n: pd.Series, p: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(binomial(n.to_numpy(np.float64), p.to_numpy(np.float64), k.to_numpy(np.int64).view(np.uint64)))

    return draw(F.col(value).cast("double"), rate.cast("double"), F.xxhash64(*key, F.lit(seed)))


def downsample_cells(upper: DataFrame, most: float, seed: int = 0) -> DataFrame:
    """Maps (one triangle) of a chromosome whose total exceeds `most` are thinned to it on average."""
    totals = upper.groupBy("cell_id", "chrom").agg(F.sum("v").alias("__t"))
    out = upper.join(totals, ["cell_id", "chrom"]).withColumn("__rate", F.least(F.lit(most) / F.col("__t"), F.lit(1.0)))
    return out.withColumn("v", thinned("v", F.col("__rate"), seed, "cell_id", "chrom", "row", "col")).filter("v > 0").select(*upper.columns)


def downsample_batches(upper: DataFrame, cells: DataFrame, by_distance: bool = True, seed: int = 0) -> DataFrame:
    """Counts of each batch thinned so that its mean a cell, on each distance or in all, is that of the smallest non-zero batch; cells: (cell_id, batch_id)."""
    size = cells.groupBy("batch_id").agg(F.count(F.lit(1)).alias("__n"))
    keyed = upper.join(cells.select("cell_id", "batch_id"), "cell_id").withColumn("__d", F.col("col") - F.col("row") if by_distance else F.lit(0))
    means = keyed.groupBy("chrom", "__d", "batch_id").agg(F.sum("v").alias("__s")).join(size, "batch_id").withColumn("__m", F.col("__s") / F.col("__n"))
    least = means.filter("__m > 0").groupBy("chrom", "__d").agg(F.min("__m").alias("__least"))
    rate = means.join(least, ["chrom", "__d"]).select("chrom", "__d", "batch_id", F.least(F.col("__least") / F.col("__m"), F.lit(1.0)).alias("__rate"))
    out = keyed.join(rate, ["chrom", "__d", "batch_id"])
    return out.withColumn("v", thinned("v", F.col("__rate"), seed, "cell_id", "chrom", "row", "col")).filter("v > 0").select(*upper.columns)
