"""Tall matrices kept as rows or blocks of rows: QR and polar factors by trees of small ones, and truncated SVDs of wide sparse features.

A tall matrix is a DataFrame with an array column; each array holds one or more rows of `width` numbers, end to end. Only
width x width matrices reach the driver or ride with the tasks, whatever the number of rows. Sparse matrices (row, column,
value) are packed in blocks of CELLS rows by FEATURES columns; a product meets each block with one block of the other side and
adds up what they contribute, FAN at a time. No columns x columns matrix is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromloom.sources.shared import discard, kept

#: Rows and columns of a packed block; arrays or factors that are put together in one step.
CELLS, FEATURES, FAN = 1_024, 1_024, 32
#: Singular values below this share of the largest count as zero: their directions stay zero in orthonormal factors.
CUT = 1e-13


def summed(frame: DataFrame, key: str, other: str, n: int, value: str = "x") -> DataFrame:
    """(key, value): sums of the arrays of each key, FAN at a time by `other` (0 .. n - 1)."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(**{value: [np.sum(np.stack(pdf[value].to_numpy()), axis=0)]})

    out = frame.select(key, other, value)
    while True:
        n = -(-n // FAN)
        out = out.withColumn(other, F.expr(f"{other} div {FAN}")).groupBy(key, other).applyInPandas(add, f"{key} long, {other} long, {value} array<double>")
        if n <= 1:
            return out.drop(other)


def task_sums(frame: DataFrame, vec: str, matrix_of) -> np.ndarray | None:
    """The sum over all rows of matrix_of(rows as a matrix): one matrix a task, added up in a tree; None without rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                own = matrix_of(np.stack(f[vec].to_numpy()).astype(np.float64))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"all": [0], "part": [TaskContext.get().partitionId()], "height": [len(total)], "x": [total.ravel()]})

    parts = kept(frame.select(vec).mapInPandas(run, "all long, part long, height long, x array<double>"))
    sizes = parts.agg(F.max("part").alias("last"), F.max("height").alias("height")).first()
    if sizes["last"] is None:
        return None
    out = np.asarray(summed(parts, "all", "part", sizes["last"] + 1).first()["x"]).reshape(sizes["height"], -1)
    discard(parts)
    return out


def keyed_sums(frame: DataFrame, arrays_of) -> dict[int, np.ndarray]:
    """Sums of arrays by number: arrays_of(frames of a task) gives {number: array}; frame should be a kept table, or made of one row by row.

    There is one array for each number and task, added up in a tree; as many as there are numbers reach the driver.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, x in arrays_of(frames).items():
            yield pd.DataFrame({"k": [k], "part": [TaskContext.get().partitionId()], "x": [x.ravel()]})

    parts = frame.mapInPandas(run, "k long, part long, x array<double>")
    return {r["k"]: np.asarray(r["x"]) for r in summed(parts, "k", "part", max(1, frame.rdd.getNumPartitions())).collect()}


def r_factor(frame: DataFrame, vec: str = "vec", width: int | None = None) -> np.ndarray | None:
    """The triangular factor of the matrix's QR decomposition: one a task, then FAN stacked at a time; None without rows.

    width: numbers of a matrix row; by default each array is one row. frame should be a kept table, or made of one row by row.
    """

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for f in frames:
            if len(f):
                x = np.concatenate(f[vec].to_numpy()).astype(np.float64).reshape(-1, width or len(f[vec].iloc[0]))
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "width": [r.shape[1]], "x": [r.ravel()]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.concatenate(pdf["x"].to_numpy()).reshape(-1, int(pdf["width"].iloc[0])), mode="r")
        return pdf.iloc[:1].assign(x=[r.ravel()])

    schema, n = "part long, width long, x array<double>", max(1, frame.rdd.getNumPartitions())
    parts = frame.select(vec).mapInPandas(first, schema)
    while n > 1:
        n = -(-n // FAN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInPandas(join, schema)
    one = parts.collect()
    return np.asarray(one[0]["x"]).reshape(-1, one[0]["width"]) if one else None


def times_matrix(frame: DataFrame, *matrices: np.ndarray, vec: str = "vec") -> DataFrame:
    """Every matrix row times small matrices, one after the other."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        if not len(s):
            return s
        rows = np.concatenate(s.to_numpy()).astype(np.float64).reshape(-1, len(matrices[0]))
        for m in matrices:
            rows = rows @ m
        return pd.Series(np.split(rows.ravel(), np.cumsum([len(x) // len(matrices[0]) * rows.shape[1] for x in s])[:-1]))

    return frame.withColumn(vec, run(F.col(vec)))


def polar_rows(frame: DataFrame, vec: str = "vec", width: int | None = None, passes: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(the polar factor U V^T of the matrix, worked out row by row when it is read; its singular values).

    The matrix is multiplied by V S^-1 V^T of its R factor. Rounding leaves an error of the condition number times 1e-16 in
    that, so it is done a second time, to the nearly orthonormal outcome. Directions below CUT stay zero.
    """
    values, cut, own, out = np.zeros(0), CUT, [], frame
    for i in range(passes):
        r = r_factor(out, vec, width)
        if r is None:
            return frame, values
        _, s, vt = np.linalg.svd(r, full_matrices=False)
        values = values if i else s
        inverse = np.where(s > cut * s.max(initial=0), 1 / np.maximum(s, 1e-300), 0.0)
        own, cut = [*own, (vt.T * inverse) @ vt], 0.1
        out = times_matrix(frame, *own, vec=vec)
    return out, values


@dataclass
class Packed:
    """A sparse matrix in blocks (block, part, at, v): at is the place in the block, row by row."""

    frame: DataFrame
    blocks: int
    parts: int
    shape: tuple[int, int]  # rows and columns of a block


def packed(entries: DataFrame, row: str, column: str, value: str, shape: tuple[int, int] = (CELLS, FEATURES)) -> Packed:
    """Entries (each place once) in blocks, kept."""
    high, wide = shape
    at = F.expr(f"cast(({row} % {high}) * {wide} + {column} % {wide} as int)")
    placed = entries.select(F.expr(f"{row} div {high}").alias("block"), F.expr(f"{column} div {wide}").alias("part"), F.struct(at.alias("at"), F.col(value).cast("double").alias("v")).alias("e"))
    frame = kept(placed.groupBy("block", "part").agg(F.collect_list("e").alias("e")).select("block", "part", F.col("e.at").alias("at"), F.col("e.v").alias("v")))
    ends = frame.agg(F.max("block"), F.max("part")).first()
    return Packed(frame, (ends[0] if ends[0] is not None else -1) + 1, (ends[1] if ends[1] is not None else -1) + 1, shape)


def _products(x: Packed, rows: DataFrame, key: str, other: str, of) -> DataFrame:
    """(key, other, x): of(block as a dense matrix, row) for each row."""
    shape = x.shape

    def dense(at, v) -> np.ndarray:
        out = np.zeros(shape[0] * shape[1])
        out[np.asarray(at)] = v
        return out.reshape(shape)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for one in f.itertuples(index=False):
                yield pd.DataFrame({key: [getattr(one, key)], other: [getattr(one, other)], "x": [of(dense(one.at, one.v), one).ravel()]})

    return rows.mapInPandas(run, f"{key} long, {other} long, x array<double>")


def times_random(x: Packed, width: int, seed: int) -> DataFrame:
    """(block, x): the matrix times random normal columns, which are the same wherever they are drawn."""
    wide = x.shape[1]
    return summed(_products(x, x.frame, "block", "part", lambda a, one: a @ np.random.default_rng([seed, one.part]).normal(size=(wide, width))), "block", "part", x.parts)


def times(x: Packed, right: DataFrame, width: int) -> DataFrame:
    """(block, x): the matrix times right (part, m)."""
    return summed(_products(x, x.frame.join(right, "part"), "block", "part", lambda a, one: a @ np.asarray(one.m).reshape(-1, width)), "block", "part", x.parts)


def transposed_times(x: Packed, left: DataFrame, width: int) -> DataFrame:
    """(part, x): the transposed matrix times left (block, m)."""
    return summed(_products(x, x.frame.join(left, "block"), "part", "block", lambda a, one: a.T @ np.asarray(one.m).reshape(-1, width)), "part", "block", x.blocks)


def _as_rows(blocks: DataFrame, key: str, size: int, width: int, name: str) -> DataFrame:
    """(name, vec) of blocks (key, x), without rows of zeros."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, x in zip(f[key], f["x"], strict=True):
                rows = np.asarray(x).reshape(-1, width)
                used = np.flatnonzero(rows.any(axis=1))
                yield pd.DataFrame({name: k * size + used, "vec": list(rows[used])})

    return blocks.mapInPandas(run, f"{name} long, vec array<double>")


def _signs(right: DataFrame, width: int) -> np.ndarray:
    """1 or -1 for each column: the sign of the sum of its cubes."""

    def cubes(frames: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        parts = [(np.concatenate(f["x"].to_numpy()).reshape(-1, width) ** 3).sum(axis=0) for f in frames if len(f)]
        return {0: np.sum(parts, axis=0)} if parts else {}

    return np.where(keyed_sums(right, cubes)[0] < 0, -1.0, 1.0)


def truncated_svd(
    entries: DataFrame, rank: int, row: str = "cell_ord", column: str = "f", value: str = "v", over: int = 10, power: int = 2, seed: int = 0, shape: tuple[int, int] = (CELLS, FEATURES)
) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(U S as (row, vec), the singular values, V as (column, vec)) of a sparse matrix, by a randomised range finder.

    entries: (row, column, value) with row and column numbers from 0, each place once. The range of rank + over random
    combinations of the columns is sharpened by `power` rounds with the matrix and its transpose, orthonormalised between.
    Each singular vector's sign is that of the sum of the cubes of V's column. Fewer than rank values if the matrix has no
    more; rows of zeros are left out. An empty matrix gives empty tables.
    """
    x, width = packed(entries, row, column, value, shape), rank + over
    spark = entries.sparkSession
    if not x.blocks:
        return spark.createDataFrame([], f"{row} long, vec array<double>"), np.zeros(0), spark.createDataFrame([], f"{column} long, vec array<double>")
    y = kept(times_random(x, width, seed))
    for i in range(power + 1):
        # within the rounds it is enough that the columns don't collapse into one
        q = polar_rows(y, "x", width, passes=2 if i == power else 1)[0].withColumnRenamed("x", "m")
        z = kept(transposed_times(x, q, width))
        if i < power:
            across = polar_rows(z, "x", width, passes=1)[0].withColumnRenamed("x", "m")
            after = kept(times(x, across, width))
            discard(y, z)
            y = after
    discard(x.frame)
    u, s, _ = np.linalg.svd(r_factor(z, "x", width).T, full_matrices=False)
    count = min(rank, int((s > CUT**0.5 * s.max(initial=0)).sum()))
    u, s = u[:, :count], s[:count]
    if not count:
        return spark.createDataFrame([], f"{row} long, vec array<double>"), s, spark.createDataFrame([], f"{column} long, vec array<double>")
    sign = _signs(times_matrix(z, u / s, vec="x"), count)
    scores, right = times_matrix(q.withColumnRenamed("m", "x"), u * s * sign, vec="x"), times_matrix(z, u / s * sign, vec="x")
    return _as_rows(scores, "block", shape[0], count, row), s, _as_rows(right, "part", shape[1], count, column)


def vector_signs(frame: DataFrame, vec: str = "vec") -> DataFrame:
    """The columns of the vectors with the sign of the sum of their cubes, so that factors can be compared."""
    cubes = task_sums(frame, vec, lambda m: (m**3).sum(axis=0)[None])
    return frame if cubes is None else times_matrix(frame, np.diag(np.where(cubes[0] < 0, -1.0, 1.0)), vec=vec)
