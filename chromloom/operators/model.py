"""The integrative factorisation X_c(i, :, :) ~ U_i (D_c diag(A_i) B_c^T)^T V^T of packed tensors, by alternating least squares.

The tensor (chrom, row, col, cell_ord, v), the meta-embedding V (cell_ord, vec of R numbers), the factor A (chrom, row, a of r
numbers) and the projected tensors (chrom, row, x of r x R numbers) stay DataFrames. Cells are cut into blocks of BLOCK, and row
bins into parts of ROWS; a block's rows of V meet its entries of a part in one group, and what the blocks contribute is added
up in two steps. Each sweep is three such passes: the row bins' projections U, the cells' scores, and the projected tensor. V is
the scores' polar factor (by a tree of QR factors), so nothing that grows with the cells reaches the driver, nor does anything
that grows with the bins: the projected tensor is fitted row by row, and only the sums for B (r x r) and D (R x r) come back.
Missing entries are zero (the dense floor of 1e-8 is left out).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.functions.linalg import polar, solve_factor
from chromloom.operators.graph import l2_normalize, project, regress_out, svd_embedding
from chromloom.operators.tall import keyed_sums, polar_rows, r_factor, truncated_svd
from chromloom.sources.shared import discard, kept

#: Cells and row bins of a group, and groups of blocks that are added up first.
BLOCK, ROWS, FOLDS = 1_024, 8, 32
#: Base pairs of the bins that the start's features are pooled to.
POOLED = 1_000_000


def ranks(bins: dict[str, int], resolution: int, size_ratio: float, rank: int) -> dict[str, int]:
    """The width r of each chromosome's factors."""
    return {c: max(1, min(int(n * size_ratio * resolution / 1e6), rank, n)) for c, n in bins.items()}


def stacked(tensors: dict[int, DataFrame], bins: dict[int, dict[str, int]]) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """(tensor, columns, heights): the resolutions of each chromosome below one another, each with its own columns."""
    out, columns, heights = None, {}, {}
    for resolution, tensor in tensors.items():
        start = F.coalesce(*(F.when(F.col("chrom") == c, F.lit(heights[c])) for c in bins[resolution] if c in heights), F.lit(0)) if heights else F.lit(0)
        own = tensor.select("chrom", (F.col("row") + start).cast("long").alias("row"), "col", "cell_ord", "v")
        out = own if out is None else out.unionByName(own)
        for c, n in bins[resolution].items():
            columns[c], heights[c] = max(columns.get(c, 0), n), heights.get(c, 0) + n
    return out, columns, heights


class RowFactor(Mapping):
    """A factor with a row of numbers for each bin, kept as rows (chrom, row, a); a chromosome's matrix is read on demand."""

    def __init__(self, frame: DataFrame, chroms: list[str]):
        self.frame, self.chroms = frame, chroms

    def __getitem__(self, chrom: str) -> np.ndarray:
        if chrom not in self.chroms:
            raise KeyError(chrom)
        return np.stack([r["a"] for r in self.frame.filter(F.col("chrom") == chrom).orderBy("row").collect()])

    def __iter__(self):
        return iter(self.chroms)

    def __len__(self) -> int:
        return len(self.chroms)


@dataclass
class Factors:
    a: Mapping[str, np.ndarray]
    b: dict[str, np.ndarray]
    d: dict[str, np.ndarray]
    v: DataFrame  # (cell_ord, vec)
    losses: list[float] = field(default_factory=list)

    def a_rows(self) -> DataFrame:
        """A as rows (chrom, row, a)."""
        if isinstance(self.a, RowFactor):
            return self.a.frame
        return self.v.sparkSession.createDataFrame([(c, i, x.tolist()) for c, m in self.a.items() for i, x in enumerate(m)], "chrom string, row long, a array<double>")


def pools_of(bins: dict[int, dict[str, int]]) -> dict[str, list[tuple[int, int]]]:
    """(first row, side) of the blocks that each resolution of a chromosome is pooled by, as stacked() puts them: bins of POOLED base pairs."""
    out: dict[str, list[tuple[int, int]]] = {}
    heights: dict[str, int] = {}
    for resolution, own in bins.items():
        for c, n in own.items():
            out.setdefault(c, []).append((heights.get(c, 0), max(1, math.ceil(POOLED / resolution))))
            heights[c] = heights.get(c, 0) + n
    return out


def pooled_features(tensor: DataFrame, pools: list[tuple[int, int]], width: int) -> DataFrame:
    """(cell_ord, f, v) of one chromosome: means of side x side blocks below one another, numbered from 0."""
    first, side, base = F.lit(0), F.lit(pools[0][1]), F.lit(0)
    rows = 0
    for k, (start, own) in enumerate(pools):
        inside = F.col("row") >= start
        first, side, base = F.when(inside, start).otherwise(first), F.when(inside, own).otherwise(side), F.when(inside, rows).otherwise(base)
        rows += -(-(pools[k + 1][0] - start) // own) if k + 1 < len(pools) else 0
    wide = -(-width // min(own for _, own in pools))
    placed = tensor.select("cell_ord", "v", side.alias("side"), (base + F.floor((F.col("row") - first) / side)).alias("i"), F.floor(F.col("col") / side).alias("j"))
    return placed.groupBy("cell_ord", (F.col("i") * wide + F.col("j")).cast("long").alias("f")).agg((F.sum("v") / F.max(F.col("side") * F.col("side"))).alias("v"))


def side_by_side(frames: list[tuple[DataFrame, int]]) -> DataFrame:
    """(cell_ord, vec): the vectors of all frames, each of its width, end to end; zeros where a frame lacks a cell."""
    starts = np.cumsum([0, *(w for _, w in frames)])
    rows = None
    for k, (frame, _) in enumerate(frames):
        own = frame.select("cell_ord", F.lit(int(starts[k])).alias("start"), "vec")
        rows = own if rows is None else rows.unionByName(own)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(int(starts[-1]))
        for start, vec in zip(pdf["start"], pdf["vec"], strict=True):
            out[start : start + len(vec)] = vec
        return pd.DataFrame({"cell_ord": [pdf["cell_ord"].iloc[0]], "vec": [out]})

    return rows.groupBy("cell_ord").applyInPandas(join, "cell_ord long, vec array<double>")


def near_one(spark: SparkSession, heights: dict[str, int], widths: dict[str, int], seed: int) -> RowFactor:
    """Rows of 1 plus Gaussian noise (sd 0.01), drawn by chromosome and row."""
    chroms = list(heights)
    first = spark.createDataFrame([(k, c, heights[c], widths[c]) for k, c in enumerate(chroms)], "k int, chrom string, n long, width int")
    rows = first.select("k", "chrom", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            noise = [1 + np.random.default_rng([seed, k, i]).normal(0, 0.01, w) for k, w, i in zip(f["k"], f["width"], f["row"], strict=True)]
            yield pd.DataFrame({"chrom": f["chrom"], "row": f["row"], "a": noise})

    return RowFactor(kept(rows.mapInPandas(run, "chrom string, row long, a array<double>")), chroms)


def init_factors(tensor: DataFrame, bins: dict[str, int], widths: dict[str, int], rank: int, pools: dict[str, list[tuple[int, int]]] | None = None, seed: int = 0, heights: dict[str, int] | None = None) -> Factors:
    """A near one, B near the identity; V and D from the SVD of the chromosomes' leading pooled features, side by side.

    pools: as pools_of() gives them (by default blocks of 2 x 2). A chromosome's features are only touched through
    products with a few vectors (truncated_svd), so no matrix has their number squared.
    """
    heights = heights or bins
    r = np.random.default_rng(seed)

    def leading(c: str) -> DataFrame:
        return truncated_svd(pooled_features(tensor.filter(F.col("chrom") == c), (pools or {}).get(c, [(0, 2)]), bins[c]), widths[c], seed=seed)[0]

    with ThreadPoolExecutor(4) as pool:  # jobs of several chromosomes at a time; the cluster's tasks do the work
        features = kept(side_by_side(list(zip(pool.map(leading, bins), [widths[c] for c in bins], strict=True))))
    b = {c: np.eye(widths[c]) + r.normal(0, 0.01, (1, widths[c])) for c in bins}
    triangle = r_factor(features)
    if triangle is None:
        raise ValueError("no entries to start from")
    _, s, right = np.linalg.svd(triangle, full_matrices=False)
    right, s = right[:rank].T, s[:rank]
    right, s = right[:, s > 1e-12 * s.max(initial=0)], s[s > 1e-12 * s.max(initial=0)]
    right = right * np.where((right**3).sum(axis=0) < 0, -1.0, 1.0)
    d = np.split(s[:, None] * right.T, np.cumsum([widths[c] for c in bins])[:-1], axis=1)
    return Factors(near_one(tensor.sparkSession, heights, widths, seed), b, dict(zip(bins, d, strict=True)), kept(project(features, right / s)))


def cell_blocks(tensor: DataFrame) -> DataFrame:
    """The tensor with the block of each entry's cell and the part of its row bin."""
    return tensor.withColumns({"block": F.expr(f"cell_ord div {BLOCK}"), "part": F.expr(f"row div {ROWS}")})


def _met(blocks: DataFrame, v: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """run(chrom, block, entries, cells, V of the block, {row: {name: array}}) for each chromosome, part and block; rows: (chrom, row, arrays)."""
    keys = ["chrom", "part", "block"]
    own = v.groupBy(F.expr(f"cell_ord div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("cell_ord", "vec"))).alias("cells"))
    names = [c for c in rows.columns if c not in ("chrom", "row")]
    by_part = rows.groupBy("chrom", F.expr(f"row div {ROWS}").alias("part")).agg(F.collect_list(F.struct("row", *names)).alias("rows"))
    right = blocks.groupBy(*(F.col(k).alias(k) for k in keys)).agg(F.count(F.lit(1)).alias("n")).join(own, "block").join(by_part, ["chrom", "part"])
    none = pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])

    def grouped(entries: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(other):
            return none
        one = other.iloc[0]
        cells = np.asarray([x["cell_ord"] for x in one["cells"]], np.int64)
        vectors = np.asarray([x["vec"] for x in one["cells"]], np.float64)
        entries = entries[np.isin(entries["cell_ord"], cells)]
        arrays = {x["row"]: {n: np.asarray(x[n]) for n in names} for x in one["rows"]}
        return run(one["chrom"], int(one["block"]), entries, cells, vectors, arrays) if len(entries) else none

    # both sides come from blocks: expressions of their own keep the keys apart
    right = right.select(*(F.coalesce(F.col(k), F.lit(None)).alias(k) for k in keys), "cells", "rows")
    return blocks.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(grouped, schema)


def added(frame: DataFrame, keys: list[str], kinds: str, finish=None, schema: str = "") -> DataFrame:
    """Sums of the arrays x by keys: first within FOLDS groups of blocks, then of these; finish: what is made of each sum."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys + (["fold"] if "fold" in pdf else [])].iloc[:1].assign(x=[np.sum(np.stack(pdf["x"].to_numpy()), axis=0)])

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return finish(add(pdf).iloc[0]) if finish else add(pdf)

    few = frame.withColumn("fold", F.pmod(F.xxhash64("block"), F.lit(FOLDS))).groupBy(*keys, "fold").applyInPandas(add, f"{kinds}, fold long, x array<double>")
    return few.drop("fold").groupBy(*keys).applyInPandas(last, schema or f"{kinds}, x array<double>")


def row_projections(blocks: DataFrame, f: Factors, bins: dict[str, int]) -> DataFrame:
    """(chrom, row, u): the orthonormal bins x r factor of each row bin's slice."""
    b, d = f.b, f.d

    def run(chrom, block, entries, cells, v, rows) -> pd.DataFrame:
        c = v @ d[chrom]
        out = []
        for i, own in entries.groupby("row"):
            t = np.zeros((bins[chrom], c.shape[1]))
            np.add.at(t, own["col"].to_numpy(), own["v"].to_numpy()[:, None] * c[np.searchsorted(cells, own["cell_ord"].to_numpy())])
            out.append((chrom, int(i), block, (t * rows[int(i)]["a"] @ b[chrom].T).ravel()))
        return pd.DataFrame(out, columns=["chrom", "row", "block", "x"])

    def finish(one: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"chrom": [one["chrom"]], "row": [one["row"]], "u": [polar(np.asarray(one["x"]).reshape(bins[one["chrom"]], -1)).ravel()]})

    parts = _met(blocks, f.v, f.a_rows(), run, "chrom string, row long, block long, x array<double>")
    return added(parts, ["chrom", "row"], "chrom string, row long", finish, "chrom string, row long, u array<double>")


def _slices(entries: pd.DataFrame, cells: np.ndarray, rows: dict[int, dict[str, np.ndarray]], n: int):
    """(row, Z: cells of the block x r) of each row bin: Z = (U_i^T X_i)^T."""
    for i, own in entries.groupby("row"):
        u = rows[int(i)]["u"].reshape(n, -1)
        z = np.zeros((len(cells), u.shape[1]))
        np.add.at(z, np.searchsorted(cells, own["cell_ord"].to_numpy()), own["v"].to_numpy()[:, None] * u[own["col"].to_numpy()])
        yield int(i), z


def cell_scores(blocks: DataFrame, f: Factors, bins: dict[str, int], cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(cell_ord, vec): each cell's scores (a row of S^T); cells: a V, of which only the cells count."""
    b, d = f.b, f.d

    def run(chrom, block, entries, own, _, arrays) -> pd.DataFrame:
        s = sum(z @ (d[chrom] * arrays[i]["a"] @ b[chrom].T).T for i, z in _slices(entries, own, arrays, bins[chrom]))
        # what is added up first here are parts of the rows: a cell is in one block only
        return pd.DataFrame({"cell_ord": own, "block": int(entries["row"].iloc[0]) // ROWS, "x": list(s)})

    parts = _met(blocks, cells, rows.join(f.a_rows(), ["chrom", "row"]), run, "cell_ord long, block long, x array<double>")
    return added(parts, ["cell_ord"], "cell_ord long").withColumnRenamed("x", "vec")


def projected_rows(blocks: DataFrame, bins: dict[str, int], v: DataFrame, rows: DataFrame) -> DataFrame:
    """(chrom, row, x): Y_i (r x R) of each row bin: its slice projected by U_i and the new meta-embedding."""

    def run(chrom, block, entries, cells, own, arrays) -> pd.DataFrame:
        return pd.DataFrame([(chrom, i, block, (z.T @ own).ravel()) for i, z in _slices(entries, cells, arrays, bins[chrom])], columns=["chrom", "row", "block", "x"])

    return added(_met(blocks, v, rows, run, "chrom string, row long, block long, x array<double>"), ["chrom", "row"], "chrom string, row long")


def projected(blocks: DataFrame, f: Factors, bins: dict[str, int], v: DataFrame, rows: DataFrame) -> dict[str, np.ndarray]:
    """Y_c (bins x r x R) of each chromosome as one array: to look at small ones; the fit uses projected_rows()."""
    heights = {r["chrom"]: r["n"] for r in f.a_rows().groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {c: np.zeros((heights[c], f.b[c].shape[0], f.d[c].shape[0])) for c in bins}
    for r in projected_rows(blocks, bins, v, rows).toLocalIterator():
        out[r["chrom"]][r["row"]] = np.asarray(r["x"]).reshape(out[r["chrom"]].shape[1:])
    return out


def orthonormal(scores: DataFrame) -> tuple[DataFrame, float]:
    """(the polar factor of the scores, kept; the sum of their singular values)."""
    v, values = polar_rows(scores)
    return kept(v), float(values.sum())


def row_grams(a: RowFactor) -> dict[str, np.ndarray]:
    """A^T A of each chromosome."""
    chroms = a.chroms

    def sums(frames: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for f in frames:
            for c, own in f.groupby("chrom"):
                x = np.stack(own["a"].to_numpy())
                out[chroms.index(c)] = out.get(chroms.index(c), 0) + x.T @ x
        return out

    return {chroms[k]: x.reshape(math.isqrt(len(x)), -1) for k, x in keyed_sums(a.frame, sums).items()}


def cp_rows(
    y: DataFrame, a: RowFactor, grams: dict[str, np.ndarray], b: dict[str, np.ndarray], d: dict[str, np.ndarray], sweeps: int = 1, tolerance: float = 1e-5
) -> tuple[RowFactor, dict[str, np.ndarray], dict[str, np.ndarray], dict[str, np.ndarray], dict[str, list[float]]]:
    """(A, A^T A, B, D, relative losses after each sweep) of alternating least squares for y(i, j, m) ~ sum_r A(i, r) B(j, r) D(m, r).

    y: kept rows (chrom, row, x), every chromosome fitted by itself from its warm start. A row of A follows from the row of
    y and the other factors, so a sweep passes over y twice: for A^T A and the sum that gives B, then for the one that gives
    D. A is written once, at the end; a row of A without a row in y is zero. Columns of A and B are kept at unit length, D takes
    the norms. A chromosome stops where its loss settles.
    """
    chroms, b, d, grams = a.chroms, dict(b), dict(d), dict(grams)
    losses: dict[str, list[float]] = {c: [] for c in chroms}
    active, scale, rule = list(chroms), {c: np.sqrt(np.diag(grams[c])) for c in chroms}, {}

    def balance(c: str) -> None:
        n, m = np.where(scale[c] > 0, scale[c], 1.0), np.linalg.norm(b[c], axis=0)
        m = np.where(m > 0, m, 1.0)
        grams[c], b[c], d[c], scale[c] = grams[c] / np.outer(n, n), b[c] / m, d[c] * (n * m), n

    def row_of(x: np.ndarray, own_b: np.ndarray, own_d: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return solve_factor(((x @ own_d) * own_b).sum(axis=0)[None], gram)[0]

    def pass_of(names: list[str], of):
        shapes, rules = {c: (b[c].shape[0], d[c].shape[0]) for c in names}, {c: rule[c] for c in names}

        def sums(frames: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
            out: dict[int, np.ndarray] = {}
            for f in frames:
                for c, x in zip(f["chrom"], f["x"], strict=True):
                    if c in shapes:
                        k, x = chroms.index(c), np.asarray(x).reshape(shapes[c])
                        out[k] = out.get(k, 0) + of(c, x, row_of(x, *rules[c]))
            return out

        return {chroms[k]: x for k, x in keyed_sums(y.filter(F.col("chrom").isin(names)), sums).items()}

    for c in chroms:
        balance(c)
    for _ in range(sweeps):
        for c in active:
            rule[c] = (b[c], d[c], (b[c].T @ b[c]) * (d[c].T @ d[c]))
        old_d = {c: d[c] for c in active}
        first = pass_of(active, lambda c, x, row, old_d=old_d: np.concatenate([[(x * x).sum()], np.outer(row, row).ravel(), (x @ old_d[c] * row).ravel()]))
        totals = {}
        for c in active:
            width = b[c].shape[1]
            x = first.get(c, np.zeros(1 + width * width + b[c].size))
            totals[c], grams[c] = float(x[0]), x[1 : 1 + width * width].reshape(width, width)
            b[c] = solve_factor(x[1 + width * width :].reshape(b[c].shape), grams[c] * (d[c].T @ d[c]))
        new_b = {c: b[c] for c in active}
        second = pass_of(active, lambda c, x, row, new_b=new_b: (x.T @ new_b[c] * row).ravel())
        for c in list(active):
            m = second.get(c, np.zeros(d[c].size)).reshape(d[c].shape)
            d[c] = solve_factor(m, grams[c] * (b[c].T @ b[c]))
            fit = float((grams[c] * (b[c].T @ b[c]) * (d[c].T @ d[c])).sum())
            own = losses[c]
            own.append(max(0.0, totals[c] + fit - 2 * float((m * d[c]).sum())) / max(totals[c], 1e-300))
            scale[c] = np.ones(len(grams[c]))
            if len(own) > 1 and own[-2] - own[-1] < tolerance * max(own[-2], 1e-300):
                active.remove(c)
                continue
            scale[c] = np.sqrt(np.diag(grams[c]))
            balance(c)
        if not active:
            break
    if not rule:
        return a, grams, b, d, losses
    norms, shapes = {c: np.where(scale[c] > 0, scale[c], 1.0) for c in chroms}, {c: (b[c].shape[0], d[c].shape[0]) for c in chroms}

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = [row_of(np.asarray(x).reshape(shapes[c]), *rule[c]) / norms[c] for c, x in zip(f["chrom"], f["x"], strict=True)]
            yield pd.DataFrame({"chrom": f["chrom"], "row": f["row"], "a": own})

    found = y.mapInPandas(rows, "chrom string, row long, a array<double>").withColumnRenamed("a", "found")
    every = a.frame.join(found, ["chrom", "row"], "left").select("chrom", "row", F.coalesce("found", F.transform("a", lambda x: x * 0.0)).alias("a"))
    return RowFactor(kept(every), chroms), grams, b, d, losses


def fit(
    tensor: DataFrame, bins: dict[str, int], n_good: int, widths: dict[str, int], rank: int, sweeps: int, tolerance: float = 2e-5, inner: int = 1, seed: int = 0,
    heights: dict[str, int] | None = None, pools: dict[str, list[tuple[int, int]]] | None = None, start: Factors | None = None,
) -> Factors:
    """Sweeps until the relative error settles; losses holds sqrt(|X - model|^2 / |X|^2) before each update of the factors.

    bins: columns of each chromosome; heights: its rows where these differ, as when stacked() puts several resolutions
    below one another. These share B and D and have rows of A and projections of their own. pools: see init_factors().
    start: factors of an earlier fit of the same cells and bins to go on from, in place of init_factors(); they stay as they
    are. What a sweep keeps in the shared folder is deleted by the next.
    """
    good = kept(cell_blocks(tensor.filter(F.col("cell_ord") < n_good)))
    if start is None:
        f = init_factors(good, bins, widths, rank, pools, seed, heights)
    else:
        wrong = {c for c in bins if start.d[c].shape[1] != widths[c]}
        if wrong:
            raise ValueError(f"the start's factors have other widths: {sorted(wrong)}")
        f = Factors(RowFactor(kept(start.a_rows()), list(bins)), dict(start.b), dict(start.d), kept(start.v))
    grams = row_grams(f.a)
    total = good.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    for it in range(sweeps):
        core = sum(float((grams[c] * (f.b[c].T @ f.b[c]) * (f.d[c].T @ f.d[c])).sum()) for c in bins)
        rows = kept(row_projections(good, f, bins))
        scores = kept(cell_scores(good, f, bins, f.v, rows))
        v, agree = orthonormal(scores)
        y = kept(projected_rows(good, bins, v, rows))
        old = [f.v, f.a.frame, rows, scores, y]
        f.v = v
        f.losses.append(float(np.sqrt(max(0.0, total + core - 2 * agree) / max(total, 1e-300))))
        f.a, grams, f.b, f.d, _ = cp_rows(y, f.a, grams, f.b, f.d, min(10, inner + it // 10))
        discard(*old)
        if it >= 3 and f.losses[-2] ** 2 - f.losses[-1] ** 2 < tolerance * f.losses[-2] ** 2:
            break
    discard(good)
    return f


def transform(tensor: DataFrame, f: Factors, bins: dict[str, int]) -> DataFrame:
    """(cell_ord, vec): the meta-embedding of all cells with entries, good and bad, with the row projections of the fit."""
    blocks = kept(cell_blocks(tensor))
    rows = kept(row_projections(blocks, f, bins))
    return orthonormal(kept(cell_scores(blocks, f, bins, blocks.select("cell_ord").distinct().withColumn("vec", F.array(F.lit(0.0))), rows)))[0]


def meta_frame(order: DataFrame, v: DataFrame) -> DataFrame:
    """(cell_id, vec) of a meta-embedding; zeros for cells without entries."""
    width = F.max(F.size("vec")).alias("width")
    every = order.select("cell_id", "cell_ord").join(v, "cell_ord", "left").join(F.broadcast(v.agg(width)))
    return every.select("cell_id", F.coalesce("vec", F.array_repeat(F.lit(0.0), F.coalesce("width", F.lit(0)))).alias("vec"))


def cell_embedding(meta: DataFrame, f: Factors, width: int) -> dict[str, DataFrame]:
    """embed_all (V times the normalised D, side by side), embed_raw (its SVD) and embed_l2_norm."""
    sides = [d / np.maximum(np.linalg.norm(d, axis=0), 1e-300) for d in f.d.values()]
    every = project(meta, np.column_stack(sides))
    raw, _ = svd_embedding(every, width)
    return {"embed_all": every, "embed_raw": raw, "embed_l2_norm": l2_normalize(raw)}


def corrected_embedding(every: DataFrame, covariates: list, width: int, name: str = "coverage_fh", keep_intercept: bool = False) -> dict[str, DataFrame]:
    """Raw and unit-length embeddings of embed_all without its linear fit on the covariates, named after these."""
    raw, _ = svd_embedding(regress_out(every, covariates, keep_intercept=keep_intercept), width)
    return {f"embed_correct_{name}": raw, f"embed_l2_norm_correct_{name}": l2_normalize(raw)}


def run_name(size_ratio: float, rank: int, inner: int, extra: str = "") -> str:
    """The name of a run's files by its parameters."""
    return f"dim1_{size_ratio:.1f}_rank_{rank}_niterp_{inner}_{extra}"


def save_factors(f: Factors, spark, path: str, light: bool = False) -> None:
    """Parquet: V in path/v and A in path/a as they are, B and D as (factor, chrom, i, row) in path/factors; light: V and D alone."""
    f.v.write.mode("overwrite").parquet(f"{path}/v")
    a = f.a_rows()
    (a.limit(0) if light else a).write.mode("overwrite").parquet(f"{path}/a")
    rows = [(name, c, i, x.tolist()) for name, factor in (("b", f.b), ("d", f.d)) if name == "d" or not light for c, m in factor.items() for i, x in enumerate(m)]
    spark.createDataFrame(rows, "factor string, chrom string, i int, row array<double>").write.mode("overwrite").parquet(f"{path}/factors")


def load_factors(spark, path: str) -> Factors:
    """Only B and D are read by the driver; of light files A and B are empty."""
    out: dict[str, dict[str, np.ndarray]] = {"b": {}, "d": {}}
    for (name, chrom), g in spark.read.parquet(f"{path}/factors").toPandas().groupby(["factor", "chrom"]):
        out[name][chrom] = np.stack(g.sort_values("i")["row"].to_numpy())
    return Factors(RowFactor(spark.read.parquet(f"{path}/a"), list(out["b"])), out["b"], out["d"], spark.read.parquet(f"{path}/v"))
