"""Smoothing of maps: stencils, pooling and random walks with restart.

The walk exists twice: step by step as joins and sums (walk_steps), and as a grouped Arrow function (walk_groups) with
one dense block for each cell and chromosome, the size of a chromosome squared whatever the number of cells. walk_slices
is the form for long chromosomes: slices of rows with the columns of the band about them, so that what a cell gives grows
with its bins and not with their square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromloom.functions.linalg import mean_filter, random_walk

CELL = ("cell_id", "chrom")


def stencil(maps: DataFrame, bins: DataFrame, weights: dict[tuple[int, int], float]) -> DataFrame:
    """Each value spread over its neighbours with the given weights; what leaves the map is lost."""
    around = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(w).alias("w")) for (i, j), w in weights.items()))
    out = maps.join(bins.select("chrom", "n_bin"), "chrom").withColumn("s", F.explode(around))
    moved = {a: F.col(a) + F.col(f"s.{k}") for a, k in (("row", "i"), ("col", "j"))}
    out = out.select(*CELL, "n_bin", *(c.alias(a) for a, c in moved.items()), (F.col("v") * F.col("s.w")).alias("v"))
    out = out.filter("row >= 0 and row < n_bin and col >= 0 and col < n_bin")
    return out.groupBy(*CELL, "row", "col").agg(F.sum("v").alias("v"))


def mean_smooth(maps: DataFrame, bins: DataFrame) -> DataFrame:
    """3 x 3 means, zeros outside the map counted in."""
    return stencil(maps, bins, {(i, j): 1 / 9 for i in (-1, 0, 1) for j in (-1, 0, 1)})


def gauss_smooth(maps: DataFrame, bins: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing of radius 1 whose border repeats the map mirrored about its outermost bins."""
    w = np.exp(-0.5 * np.arange(-1, 2) ** 2 / sigma**2)
    w /= w.sum()
    out = maps
    for axis in ("row", "col"):
        other = "col" if axis == "row" else "row"
        x = out.join(bins.select("chrom", "n_bin"), "chrom")
        # bin 1 also stands at -1, and bin n - 2 at n
        twice = lambda at, edge: F.when((F.col(axis) == at) & (F.col("n_bin") > 1), F.array(F.struct(edge.cast("long").alias("to"), F.lit(float(w[0])).alias("w")))).otherwise(F.array().cast("array<struct<to:bigint,w:double>>"))  # noqa: E731, B023
        plain = F.array(*(F.struct((F.col(axis) + k).cast("long").alias("to"), F.lit(float(w[k + 1])).alias("w")) for k in (-1, 0, 1)))
        x = x.withColumn("s", F.explode(F.concat(plain, twice(F.lit(1), F.lit(0)), twice(F.col("n_bin") - 2, F.col("n_bin") - 1))))
        x = x.filter("s.to >= 0 and s.to < n_bin").select(*CELL, F.col("s.to").alias(axis), other, (F.col("v") * F.col("s.w")).alias("v"))
        out = x.groupBy(*CELL, "row", "col").agg(F.sum("v").alias("v"))
    return out


def block_pool(maps: DataFrame, bins: DataFrame, side: int) -> DataFrame:
    """Means of side x side blocks, zeros counted in; blocks that the edge cuts are left out."""
    full = F.expr(f"n_bin div {side}")
    out = maps.join(bins.select("chrom", "n_bin"), "chrom").filter((F.expr(f"row div {side}") < full) & (F.expr(f"col div {side}") < full))
    return out.groupBy(*CELL, F.expr(f"row div {side}").alias("row"), F.expr(f"col div {side}").alias("col")).agg((F.sum("v") / (side * side)).alias("v"))


def bin_coverage(smoothed: DataFrame) -> DataFrame:
    """(cell_id, chrom, col, cov): 1e-4 plus the column's sum; nothing above 1e-4 counts as infinite."""
    sums = smoothed.groupBy(*CELL, "col").agg((F.lit(1e-4) + F.sum("v")).alias("cov"))
    return sums.withColumn("cov", F.when(F.col("cov") <= 1e-4, F.lit(float("inf"))).otherwise(F.col("cov")))


def _times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product by cell and chromosome of (row, col, v) tables."""
    left, right = a.select(*CELL, "row", F.col("col").alias("k"), F.col("v").alias("x")), b.select(*CELL, F.col("row").alias("k"), "col", F.col("v").alias("y"))
    return left.join(right, [*CELL, "k"]).groupBy(*CELL, "row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def _column_shares(m: DataFrame, eps: float) -> DataFrame:
    sums = m.groupBy(*CELL, "col").agg(F.sum("v").alias("__s"))
    return m.join(sums, [*CELL, "col"]).withColumn("v", F.col("v") / (F.col("__s") + eps)).select(*m.columns)


def walk_steps(dense_maps: DataFrame, steps: int, restart: float = 0.5, mix: float = 0.75) -> DataFrame:
    """A fixed number of steps of the walk over dense square maps, as joins and sums: Q A."""
    a = dense_maps.select(*CELL, "row", "col", "v")
    transposed = a.select(*CELL, F.col("col").alias("row"), F.col("row").alias("col"), "v")
    second = _times(a, transposed).withColumn("v", F.when(F.col("row") == F.col("col"), 0.0).otherwise(F.col("v")))
    first, second = _column_shares(a, 1e-15), _column_shares(second, 1e-15)
    link = first.withColumn("v", mix * F.col("v")).unionByName(second.withColumn("v", (1 - mix) * F.col("v"))).groupBy(*CELL, "row", "col").agg(F.sum("v").alias("v"))
    p = _column_shares(link, 0.0)
    identity = a.filter("row = col").withColumn("v", F.lit(1.0))
    q = identity
    for _ in range(steps):
        q = _times(q, p).withColumn("v", (1 - restart) * F.col("v")).unionByName(identity.withColumn("v", F.lit(restart))).groupBy(*CELL, "row", "col").agg(F.sum("v").alias("v"))
    return _times(q, a)


def _block(pdf: pd.DataFrame, floor: float, conv: bool) -> np.ndarray:
    n = int(pdf["n_bin"].iloc[0])
    a = np.zeros((n, n))
    np.add.at(a, (pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)), pdf["v"].to_numpy(np.float64))
    a = np.maximum(a, floor)
    return np.maximum(mean_filter(a), floor) if conv and n > 1 else a


def walk_changes(maps: DataFrame, bins: DataFrame, steps: int = 60, conv: bool = False, floor: float = 1e-8) -> DataFrame:
    """(cell_id, chrom, step, change) of each cell's walk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, changes = random_walk(_block(pdf, floor, conv), steps)
        return pd.DataFrame({"cell_id": pdf["cell_id"].iloc[0], "chrom": pdf["chrom"].iloc[0], "step": np.arange(1, steps + 1), "change": changes})

    return maps.join(bins.select("chrom", "n_bin"), "chrom").groupBy(*CELL).applyInPandas(run, "cell_id long, chrom string, step long, change double")


def walk_lengths(changes: DataFrame, tolerance: float = 0.01, most: int = 60) -> DataFrame:
    """(chrom, n_steps): the steps before the first whose largest change over the cells is below the tolerance."""
    by_step = changes.groupBy("chrom", "step").agg(F.max("change").alias("change"))
    return by_step.groupBy("chrom").agg(F.coalesce(F.min(F.when(F.col("change") < tolerance, F.col("step"))) - 1, F.lit(most)).cast("long").alias("n_steps"))


def walk_groups(maps: DataFrame, bins: DataFrame, lengths: DataFrame, conv: bool = False, normalize_columns: bool = False, floor: float = 1e-8) -> DataFrame:
    """The smoothed dense maps (cell_id, chrom, row, col, v); lengths: (chrom, n_steps).

    normalize_columns: the walk is made symmetric and its rows sum to one, and columns of the map are divided by coverage.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _block(pdf, floor, conv)
        q, out, _ = random_walk(a, int(pdf["n_steps"].iloc[0]))
        if normalize_columns:
            q = np.maximum((q + q.T) / 2, 0)
            q /= q.sum(axis=1, keepdims=True)
            cov = 1e-4 + out.sum(axis=0)
            out = q @ (a / cov)
        n = len(a)
        row, col = np.divmod(np.arange(n * n), n)
        return pd.DataFrame({"cell_id": pdf["cell_id"].iloc[0], "chrom": pdf["chrom"].iloc[0], "row": row, "col": col, "v": out.ravel()})

    grouped = maps.join(bins.select("chrom", "n_bin"), "chrom").join(lengths, "chrom")
    return grouped.groupBy(*CELL).applyInPandas(run, "cell_id long, chrom string, row long, col long, v double")


SLICE = (*CELL, "part")
SMOOTHED = "cell_id long, chrom string, row long, col long, v double"


def slice_sides(bins: DataFrame, resolution: int) -> DataFrame:
    """bins with side: the rows of a slice, as even as can be, 15 Mb of bins at most but no fewer than 128 and no more than 256."""
    most = min(max(15_000_000 // resolution, 128), 256)
    return bins.withColumn("side", F.ceil(F.col("n_bin") / F.ceil(F.col("n_bin") / most)).cast("long"))


def _sliced(maps: DataFrame, sides: DataFrame) -> DataFrame:
    return maps.join(sides.select("chrom", "n_bin", "side"), "chrom").withColumn("part", F.expr("row div side"))


def _slice_block(pdf: pd.DataFrame, flank: int, floor: float, conv: bool) -> tuple[np.ndarray, int, int]:
    """(rows of the slice x columns of its context, the first row, the first column)."""
    n, side, part = (int(pdf[k].iloc[0]) for k in ("n_bin", "side", "part"))
    top, bottom = part * side, min(n, (part + 1) * side)
    left, right = max(0, top - flank), min(n, bottom + flank)
    col = pdf["col"].to_numpy(np.int64)
    inside = (col >= left) & (col < right)
    a = np.zeros((bottom - top, right - left))
    np.add.at(a, (pdf["row"].to_numpy(np.int64)[inside] - top, col[inside] - left), pdf["v"].to_numpy(np.float64)[inside])
    a = np.maximum(a, floor)
    return (np.maximum(mean_filter(a), floor) if conv and len(a) > 1 else a), top, left


def _entries(pdf: pd.DataFrame, out: np.ndarray, top: int, left: int) -> pd.DataFrame:
    row, col = np.divmod(np.arange(out.size), out.shape[1])
    return pd.DataFrame({"cell_id": pdf["cell_id"].iloc[0], "chrom": pdf["chrom"].iloc[0], "row": row + top, "col": col + left, "v": out.ravel()})


def slice_changes(maps: DataFrame, sides: DataFrame, flank: int, steps: int = 60, conv: bool = False, floor: float = 1e-8) -> DataFrame:
    """(cell_id, chrom, part, step, change) of the walk of each cell's slices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, top, left = _slice_block(pdf, flank, floor, conv)
        _, _, changes = random_walk(a, steps, start=top - left)
        return pd.DataFrame({"cell_id": pdf["cell_id"].iloc[0], "chrom": pdf["chrom"].iloc[0], "part": pdf["part"].iloc[0], "step": np.arange(1, steps + 1), "change": changes})

    return _sliced(maps, sides).groupBy(*SLICE).applyInPandas(run, "cell_id long, chrom string, part long, step long, change double")


def walk_slices(maps: DataFrame, sides: DataFrame, lengths: DataFrame, flank: int, conv: bool = False, normalize_columns: bool = False, floor: float = 1e-8) -> DataFrame:
    """The smoothed slices (cell_id, chrom, row, col, v) with the columns up to flank bins beyond their rows.

    sides: bins as slice_sides() gives them; lengths: (chrom, n_steps), 0 for no walk. Entries further than flank from a
    slice take no part, so maps are banded to flank first. Slices without entries give no rows. One slice of a whole
    chromosome gives what walk_groups() gives. With normalize_columns the coverage of a column is summed over all slices
    before the second pass.
    """
    grouped = _sliced(maps, sides).join(lengths, "chrom")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, top, left = _slice_block(pdf, flank, floor, conv)
        return _entries(pdf, random_walk(a, int(pdf["n_steps"].iloc[0]), start=top - left)[1], top, left)

    smoothed = grouped.groupBy(*SLICE).applyInPandas(run, SMOOTHED)
    if not normalize_columns:
        return smoothed

    def columns(pdf: pd.DataFrame, cov: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["cell_id", "chrom", "row", "col", "v"])
        a, top, left = _slice_block(pdf, flank, floor, conv)
        q, _, _ = random_walk(a, int(pdf["n_steps"].iloc[0]), start=top - left)
        q = np.maximum((q + q.T) / 2, 0)
        q /= q.sum(axis=1, keepdims=True)
        by_column = np.full(a.shape[1], np.inf)
        by_column[cov["col"].to_numpy(np.int64) - left] = cov["cov"].to_numpy(np.float64)
        return _entries(pdf, q @ (a / by_column), top, left)

    spots = bin_coverage(smoothed).join(sides.select("chrom", "n_bin", "side"), "chrom")
    parts = F.sequence(F.greatest(F.lit(0), F.floor((F.col("col") - flank) / F.col("side"))), F.least(F.floor((F.col("n_bin") - 1) / F.col("side")), F.floor((F.col("col") + flank) / F.col("side"))))
    spots = spots.select(*CELL, F.explode(parts).alias("part"), "col", "cov")
    return grouped.groupBy(*SLICE).cogroup(spots.groupBy(*SLICE)).applyInPandas(columns, SMOOTHED)


def tuned_lengths(maps: DataFrame, sides: DataFrame, flank: int, conv: bool = False) -> DataFrame:
    """(chrom, n_steps) by the stop rule over all cells and slices."""
    return walk_lengths(slice_changes(maps, sides, flank, conv=conv))
