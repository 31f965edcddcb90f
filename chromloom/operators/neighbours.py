"""Approximate nearest neighbours of cells, and the spectrum of their graph.

`descended` is neighbour descent (Dong, Moses and Li, "Efficient k-nearest neighbor graph construction for generic similarity
measures", 2011) on a table of edges: a neighbour of a neighbour is likely a neighbour. Cells first meet within buckets of
random hyperplane codes. In each round the neighbours of a cell, and a hashed sample of the cells that have it as a neighbour,
meet in one group, and every pair of which one edge is new may better both cells' lists. Rounds end when few edges change.
No two cells meet but in such groups, whose sizes depend on k alone, so the work grows with the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromloom.operators.tall import polar_rows, r_factor, task_sums, times_matrix
from chromloom.sources.shared import discard, kept

#: Cells of a bucket of the start, and how many codes each cell gets.
BUCKET, CODES = 256, 3
#: Pairs of members that are compared at once.
PAIRS = 2**18
#: Rounds at most, and the share of edges whose change goes on.
ROUNDS, SETTLED = 20, 0.002


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, by a matrix product: good to some 1e-8 of the norms, to choose by."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src, each dst once; Spark cuts each task's rows to k a src before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _ids_and_rows(group: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the vectors, as a matrix, of a group."""
    ids = group.column(name).to_numpy()
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column("vec").chunks])
    return ids, flat.reshape(len(ids), -1).astype(np.float64)


def _edges(src, dst, dist) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "dist": pa.array(dist, pa.float64())})


def _within(groups: DataFrame, k: int) -> DataFrame:
    """(src, dst, dist) of the k nearest within each group (g) of (id, vec)."""

    def meet(group: pa.Table) -> pa.Table:
        ids, x = _ids_and_rows(group, "id")
        if len(ids) < 2:
            return _edges([], [], [])
        d = pair_distances(x, x)
        np.fill_diagonal(d, np.inf)
        n = min(k, len(ids) - 1)
        top = np.argpartition(d, n - 1, axis=1)[:, :n]
        return _edges(np.repeat(ids, n), ids[top].ravel(), np.take_along_axis(d, top, axis=1).ravel())

    return groups.groupBy("g").applyInArrow(meet, "src long, dst long, dist double")


def bucketed(vectors: DataFrame, n: int, width: int, k: int, seed: int) -> DataFrame:
    """The start (src, dst, dist): neighbours within buckets of CODES codes; large buckets are dealt out by hash."""
    size = max(BUCKET, 2 * k)
    bits = max(0, int(np.ceil(np.log2(max(1, n / size)))))
    mean = task_sums(vectors, "vec", lambda m: m.sum(axis=0)[None])[0] / n
    planes = np.random.default_rng(seed).normal(size=(width, CODES * bits))

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                signs = (np.stack(f["vec"].to_numpy()).astype(np.float64) - mean) @ planes > 0
                for c in range(CODES):
                    code = signs[:, c * bits : (c + 1) * bits] @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(f), np.int64)
                    yield pd.DataFrame({"code": c, "bucket": code, "id": f["id"], "vec": f["vec"]})

    codes = kept(vectors.mapInPandas(coded, "code long, bucket long, id long, vec array<float>"))
    sizes = codes.groupBy("code", "bucket").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    dealt = codes.join(sizes, ["code", "bucket"]).withColumn("g", F.struct("code", "bucket", F.pmod(F.xxhash64("id", "code"), F.col("parts"))))
    out = kept(_best(_within(dealt.select("g", "id", "vec"), k).distinct(), k))
    discard(codes)
    return out


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by the key, cut between keys alone, so that no group is in two tables."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            keys = rows.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield rows.slice(0, cut)
            rest = rows.slice(cut)
    if rest is not None:
        yield rest


def _met(groups: pa.Table, k: int) -> pa.Table:
    """(src, dst, dist): for each member u the k nearest others of its group v that may better its list; groups of like size are compared together."""
    v = groups.column("v").to_numpy()
    ids, x = _ids_and_rows(groups, "u")
    fresh, far = groups.column("fresh").to_numpy(), groups.column("far").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(v)]]))
    order, out, done = np.argsort(-sizes, kind="stable"), [], 0
    while done < len(order) and (m := int(sizes[order[done]])) > 1:
        some = order[done : done + max(1, PAIRS // m**2)]
        done += len(some)
        there = np.arange(m) < sizes[some, None]
        at = np.where(there, starts[some, None] + np.arange(m), starts[some, None])
        y, new = x[at], fresh[at]
        square = (y * y).sum(axis=2)
        d = np.sqrt(np.maximum(square[:, :, None] + square[:, None] - 2 * (y @ y.transpose(0, 2, 1)), 0))
        open_ = (new[:, :, None] | new[:, None]) & (d < far[at][:, :, None]) & there[:, :, None] & there[:, None]
        open_[:, np.arange(m), np.arange(m)] = False
        d[~open_] = np.inf
        n = min(k, m - 1)
        top = np.argpartition(d, n - 1, axis=2)[:, :, :n]
        dist = np.take_along_axis(d, top, axis=2)
        group, one, place = np.nonzero(np.isfinite(dist))
        out.append((ids[at[group, one]], ids[at[group, top[group, one, place]]], dist[group, one, place]))
    return _edges(*(np.concatenate(c) for c in zip(*out, strict=True))) if out else _edges([], [], [])


def _round(edges: DataFrame, vectors: DataFrame, k: int, sample: int, seed: int) -> DataFrame:
    """(src, dst, dist, fresh) after every cell's neighbours have met once."""
    worst = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).select(F.col("src").alias("u"), F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("far"))
    degree = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(2**30)) / F.lit(float(2**30))
    back = edges.join(degree, "dst").filter(chance < F.lit(float(sample)) / F.col("degree")).select(F.col("dst").alias("v"), F.col("src").alias("u"), "fresh")
    members = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), "fresh").unionByName(back).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
    known = vectors.withColumnRenamed("id", "u").join(worst, "u", "left").select("u", "vec", F.coalesce("far", F.lit(float("inf"))).alias("far"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole(batches, "v"):
            yield from _met(groups, k).to_batches()

    # many cells' groups in a call: one call for each cell takes longer than the comparisons
    found = members.join(known, "u").repartition("v").sortWithinPartitions("v").mapInArrow(meet, "src long, dst long, dist double")
    # an edge found again has been there before; its distance may differ in the last digits
    merged = edges.select("src", "dst", "dist", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True))).groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    return _best(merged, k)


def exact_distances(edges: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(src, dst, dist, rank) with distances in double precision, ties to the smaller dst; vectors: (id, vec) as given."""
    side = lambda end: vectors.select(F.col("id").alias(end), F.col("vec").alias(f"{end}_vec"))
    square = F.aggregate(F.zip_with("src_vec", "dst_vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    out = edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", F.sqrt(square).alias("dist"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).filter(F.col("rank") <= k)


def descended(frame: DataFrame, k: int, key: str = "cell_id", vec: str = "vec", seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """(src, dst, dist, rank): about the k nearest other cells of each by Euclidean distance, ranks from 1, kept.

    Cells with a null id or vector are left out; repeated ids must not occur. With fewer than k other cells a cell gets those
    that it met. An empty table or a single cell gives an empty result.
    """
    given = frame.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("id is not null and vec is not null")
    vectors = kept(given.withColumn("vec", F.col("vec").cast("array<float>")))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if size["n"] < 2:
        return frame.sparkSession.createDataFrame([], "src long, dst long, dist double, rank int")
    start = bucketed(vectors, size["n"], size["width"], k, seed)
    edges = kept(start.withColumn("fresh", F.lit(True)))
    discard(start)
    for i in range(rounds):
        after = kept(_round(edges, vectors, k, max(8, k // 2), seed + i))
        discard(edges)
        edges = after
        if edges.filter("fresh").count() <= SETTLED * size["n"] * k:
            break
    out = kept(exact_distances(edges, given, k))
    discard(edges, vectors)
    return out


def edge_sums(edges: DataFrame, rows: DataFrame, to: str, by: str, width: int) -> DataFrame:
    """(to, x): for each node the sum of the arrays x of the nodes (by) at the other end of its edges (src, dst, w)."""
    terms = edges.join(rows, by).select(to, *((F.col("w") * F.col("x")[i]).alias(f"x{i}") for i in range(width)))
    return terms.groupBy(to).agg(*(F.sum(f"x{i}").alias(f"x{i}") for i in range(width))).select(to, F.array(*(f"x{i}" for i in range(width))).alias("x"))


def shared_spectrum(edges: DataFrame, rank: int, over: int = 8, power: int = 4, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """((src, vec = U S), S) of the truncated SVD of G G^T, the graph of shared neighbours of edges (src, dst[, w]).

    G G^T is never built: its product with a few columns is two joins with the edges, and block power iteration needs no
    more. S are the squares of G's singular values. Signs are those of the sums of the columns' cubes.
    """
    edges = kept(edges.select("src", "dst", (F.col("w") if "w" in edges.columns else F.lit(1.0)).cast("double").alias("w")))
    width = rank + over

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"dst": f["dst"], "x": [np.random.default_rng([seed, i]).normal(size=width) for i in f["dst"]]})

    z = kept(edges.select("dst").distinct().mapInPandas(drawn, "dst long, x array<double>"))
    for i in range(power + 1):
        y = kept(edge_sums(edges, z, "src", "dst", width))
        q = polar_rows(y, "x")[0]
        after = kept(edge_sums(edges, q, "dst", "src", width))
        discard(z)
        if i < power:  # the last one is read again through q
            discard(y)
        z = after
    triangle = r_factor(z, "x")
    if triangle is None:
        return edges.select("src", F.array().cast("array<double>").alias("vec")).limit(0), np.zeros(0)
    u, s, _ = np.linalg.svd(triangle.T, full_matrices=False)
    u, s = u[:, :rank], s[:rank]
    scores = times_matrix(q, u * s**2, vec="x").withColumnRenamed("x", "vec")
    cubes = task_sums(scores, "vec", lambda m: (m**3).sum(axis=0)[None])[0]
    out = kept(times_matrix(scores, np.diag(np.where(cubes < 0, -1.0, 1.0))))
    discard(edges, z, y)
    return out, s**2
