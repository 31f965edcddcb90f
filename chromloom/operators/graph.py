"""Embeddings and neighbour graphs of cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromloom.operators.nearest import nearest_cells
from chromloom.operators.neighbours import descended, shared_spectrum
from chromloom.operators.ranks import exact_quantiles
from chromloom.operators.tall import r_factor, task_sums
from chromloom.sources.shared import discard, kept


def norm(vec: str = "vec") -> Column:
    return F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(frame: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows of unit length; zero rows stay as they are."""
    n = norm(vec)
    return frame.withColumn("__n", n).withColumn(vec, F.when(F.col("__n") > 0, F.transform(vec, lambda x: x / F.col("__n"))).otherwise(F.col(vec))).drop("__n")


def one_hot(frame: DataFrame, label: str, values: list) -> list[Column]:
    """One 0/1 column for each of the sorted values."""
    return [(F.col(label) == v).cast("double").alias(f"{label}_{v}") for v in sorted(values)]


def _marks(frame: DataFrame, by: list[str], value: str, n_quantiles: int) -> tuple[list[float], dict[tuple, list[float]]]:
    """(shares, their quantiles by group): as many landmarks as asked for, but no more than rows."""
    n = frame.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    k = max(2, min(n_quantiles, n))
    grid = [i / (k - 1) for i in range(k)]
    found: dict[tuple, list[float]] = {}
    if n:
        for r in exact_quantiles(frame, by, value, grid).orderBy(*by, "q").collect():  # n_quantiles numbers a group
            found.setdefault(tuple(r[c] for c in by), []).append(r["x"])
    return grid, found


def quantile_uniform(frame: DataFrame, column: str, n_quantiles: int = 100) -> DataFrame:
    """column mapped to [0, 1] by its quantiles: the mean of interpolations from below and above, so that ties get the middle of their range."""
    grid, found = _marks(frame, [], column, n_quantiles)
    if not found:
        return frame
    marks, x = found[()], F.col(column)
    ups, downs = [], []  # one flat list each: nested expressions take the optimizer exponential time
    for i in range(1, len(grid)):
        a, b, lo, hi = grid[i - 1], grid[i], marks[i - 1], marks[i]
        if hi > lo:
            inside = F.lit(a) + (x - lo) / (hi - lo) * (b - a)
            ups.append(F.when((x >= lo) & (x < hi), inside))
            downs.append(F.when((x > lo) & (x <= hi), inside))
    up = F.when(x >= marks[-1], 1.0).otherwise(F.coalesce(*ups, F.lit(0.0)))
    down = F.when(x <= marks[0], 0.0).otherwise(F.coalesce(*downs, F.lit(1.0)))
    middle = F.when(x == marks[0], 0.0).when(x == marks[-1], 1.0).otherwise((up + down) / 2)
    return frame.withColumn(column, middle)


def quantile_uniform_vectors(frame: DataFrame, vec: str = "vec", n_quantiles: int = 100) -> DataFrame:
    """Every component of the vectors mapped to [0, 1] by its own quantiles, as quantile_uniform() does; nulls stay."""
    flat = frame.select(F.posexplode(vec).alias("i", "x"))
    grid, found = _marks(flat, ["i"], "x", n_quantiles)
    if not found:
        return frame
    shares, marks = np.asarray(grid), np.asarray([found[(i,)] for i in range(len(found))])

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        some = s.notna()
        if not some.any():
            return s
        x = np.stack(s[some].to_numpy()).astype(np.float64)
        out = np.empty_like(x)
        for i, own in enumerate(marks):
            middle = (np.interp(x[:, i], own, shares) - np.interp(-x[:, i], -own[::-1], -shares[::-1])) / 2
            out[:, i] = np.where(x[:, i] == own[0], 0.0, np.where(x[:, i] == own[-1], 1.0, middle))
        whole = pd.Series([None] * len(s), dtype=object)
        whole[some.to_numpy()] = pd.Series(list(out), index=whole.index[some.to_numpy()])
        return whole

    return frame.withColumn(vec, run(F.col(vec)))


def gram_of(frame: DataFrame, vec: str = "vec", add_ones: bool = False, first: int | None = None) -> np.ndarray:
    """The Gram matrix of the rows (with a leading column of ones, if asked), or its first rows; one array a task, summed in a tree."""

    def gram(x: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(x)), x]) if add_ones else x
        return x[:, :first].T @ x

    total = task_sums(frame, vec, gram)
    return np.zeros((0, 0)) if total is None else total


def project(frame: DataFrame, matrix: np.ndarray, vec: str = "vec") -> DataFrame:
    """vec times a small matrix."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(s.to_numpy()).astype(np.float64) @ matrix)) if len(s) else s

    return frame.withColumn(vec, run(F.col(vec)))


def svd_embedding(frame: DataFrame, rank: int, vec: str = "vec") -> tuple[DataFrame, np.ndarray]:
    """(U S of the uncentred rank-`rank` SVD as vec, singular values): by the R factor, width x width numbers, without squaring it."""
    r = r_factor(frame, vec)
    if r is None:
        return frame, np.zeros(0)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    return project(frame, vt[:rank].T, vec), s[:rank]


def regress_out(frame: DataFrame, covariates: list[Column], vec: str = "vec", keep_intercept: bool = False) -> DataFrame:
    """vec less its least-squares fit on the covariates, with intercept (keep_intercept: which then stays in); the moments are one aggregation."""
    k = len(covariates)
    both = frame.withColumn("__c", F.array(*(c.cast("double") for c in covariates))).withColumn("__all", F.concat("__c", F.col(vec).cast("array<double>")))
    gram = gram_of(both, "__all", add_ones=True, first=k + 1)  # only what meets the covariates
    if not len(gram):
        return frame
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    spread = gram[1 : k + 1, 1:] - n * np.outer(mean[:k], mean)  # about the means: of all equally good fits the one with the least slopes
    slopes = np.linalg.lstsq(spread[:, :k], spread[:, k:], rcond=1e-12)[0]
    beta = np.vstack([np.zeros(len(mean) - k) if keep_intercept else mean[k:] - mean[:k] @ slopes, slopes])

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        if not len(s):
            return s
        x = np.stack(s.to_numpy()).astype(np.float64)
        return pd.Series(list(x[:, k:] - np.column_stack([np.ones(len(x)), x[:, :k]]) @ beta))

    return both.withColumn(vec, run("__all")).drop("__c", "__all")


def shared_neighbours(edges: DataFrame, part: int = 1024) -> DataFrame:
    """(a, b, n): pairs of nodes a < b with n common neighbours, of edges (src, dst).

    The sources of a dst are dealt in parts of about `part`; two parts (or one with itself) meet in one group, so that a dst
    with very many sources is many groups of at most part^2 pairs. Pairs are counted in each task before the shuffle. The
    edges are worked out once.
    """
    edges = kept(edges.select("src", "dst"))
    parts = edges.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    own = edges.join(parts, "dst").withColumn("p", F.pmod(F.xxhash64("src"), F.col("parts")))
    x = own.select("dst", F.col("src").alias("x"), "p", F.explode(F.sequence(F.col("p"), F.col("parts") - 1)).alias("q"))
    y = own.select("dst", F.col("src").alias("y"), F.col("p").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p"))).alias("p"))
    pairs = x.join(y, ["dst", "p", "q"]).filter((F.col("p") < F.col("q")) | (F.col("x") < F.col("y")))
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def same_label_share(edges: DataFrame, labels: DataFrame, label: str, key: str = "cell_id") -> DataFrame:
    """(key, share): the share of a node's neighbours with its own label; nodes without edges have 0."""
    side = lambda name: labels.select(F.col(key).alias(name), F.col(label).alias(f"{name}_label"))
    share = edges.join(side("src"), "src").join(side("dst"), "dst").groupBy("src").agg(F.avg((F.col("src_label") == F.col("dst_label")).cast("double")).alias("share"))
    return labels.select(F.col(key).alias("src")).join(share, "src", "left").select(F.col("src").alias(key), F.coalesce("share", F.lit(0.0)).alias("share"))


def modularity(edges: DataFrame, labels: DataFrame, label: str, gamma: float = 1.0, normalize: bool = False, key: str = "cell_id") -> DataFrame:
    """One row (modularity) of edges (src, dst, w) without self loops and with positive weight. The edges are worked out once."""
    edges = kept(edges.select("src", "dst", "w"))
    if not edges.filter("src = dst").isEmpty():
        raise ValueError("self loops")
    side = lambda name: labels.select(F.col(key).alias(name), F.col(label).alias(f"{name}_label"))
    e = edges.join(side("src"), "src").join(side("dst"), "dst")
    by = kept(e.groupBy("src_label").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("src_label") == F.col("dst_label"), F.col("w")).otherwise(0.0)).alias("inside")))
    discard(edges)
    total = by.agg(F.sum("w").alias("all_w"), F.sum("inside").alias("all_inside"), F.count(F.lit(1)).alias("n"))
    share = by.join(F.broadcast(total)).withColumn("k", F.col("w") / F.col("all_w"))
    out = share.agg((F.max(F.col("all_inside") / F.col("all_w")) - gamma * F.sum(F.col("k") * F.col("k"))).alias("m"), F.sum(F.col("k") * (1 - gamma * F.col("k"))).alias("top"), F.max("n").alias("n"))
    return out.select(F.when(F.col("n") <= 1, 0.0).otherwise(F.col("m") / F.col("top") if normalize else F.col("m")).alias("modularity"))


def batch_mix(frame: DataFrame, labels: DataFrame, k: int = 25, label: str = "batch_id") -> DataFrame:
    """(cell_id, share): share of each cell's k nearest neighbours that are of its own batch."""
    if label not in labels.columns:
        raise ValueError(f"labels have no column {label}")
    return same_label_share(nearest_cells(frame, k), labels, label)


def batch_mix_both(frame: DataFrame, labels: DataFrame, k: int = 25, wide: int = 50, label: str = "batch_id", seed: int = 0) -> DataFrame:
    """(cell_id, share, share_shared): share as in batch_mix(), and the same among neighbours by shared neighbours.

    The second embeds the cells by the truncated SVD (of the vectors' width) of the graph of shared neighbours among the
    `wide` nearest, and looks at the k nearest there. Neighbours are found by descent, so nothing grows with the square of
    the cells.
    """
    if label not in labels.columns:
        raise ValueError(f"labels have no column {label}")
    near = descended(frame, max(wide, k), seed=seed)
    width = frame.select(F.max(F.size("vec"))).first()[0] or 1
    spectrum, _ = shared_spectrum(near.filter(F.col("rank") <= wide), width, seed=seed)
    second = descended(spectrum.withColumnRenamed("src", "cell_id"), k, seed=seed)
    direct = same_label_share(near.filter(F.col("rank") <= k), labels, label)
    return direct.join(same_label_share(second, labels, label).withColumnRenamed("share", "share_shared"), "cell_id")
