"""Exact nearest neighbours of cells: every block of cells meets every other, without a shuffle that grows with their pairs.

Cells are packed in blocks once. The blocks are dealt to L partitions as sources and to R as targets, and Spark's Cartesian
product reads one of each in a task, which holds at most TARGETS blocks and returns the k best of each of its sources. So disk
grows with the cells (times k and R, one for TARGETS blocks); only the number of products is quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromloom.sources.shared import discard, kept

#: Cells of a block at most, blocks that a task holds as targets, and rows of a block that are compared at once.
BLOCK, TARGETS, STRIP = 2048, 64, 256
#: Numbers of a block at most (1 MB), and pairs that are compared exactly at once.
NUMBERS, EXACT = 2**17, 2**14
#: Bytes of pairs of blocks that are sent to Python at once.
BATCH = "4m"
#: Largest squares between which products in single precision are good to choose by; others are made in double precision.
SINGLE = (1e-12, 1e30)


def _targets(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The rows that can be among anyone's k nearest: of the same vector the k + 1 smallest ids (all, if an id is repeated)."""
    if len(ids) <= k + 1 or len(np.unique(ids)) < len(ids):
        return np.arange(len(ids))
    group = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, group))
    own = group[order]
    place = np.arange(len(ids)) - np.searchsorted(own, own)
    return np.sort(order[place <= k])


def _packed(cells: DataFrame, width: int, k: int, block: int) -> DataFrame:
    """(ids, x, near) of (id, vec): blocks as bytes; near: the rows that count as targets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), np.zeros((0, width))

        def row(n: int) -> pa.RecordBatch:
            own = [ids[:n].tobytes(), x[:n].tobytes(), _targets(ids[:n], x[:n], k).astype(np.int32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in own], names=["ids", "x", "near"])

        for batch in batches:
            more = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(more).all(axis=1)
            ids, x = np.concatenate([ids, batch.column(0).to_numpy()[good]]), np.concatenate([x, more[good]])
            while len(ids) >= block:
                yield row(block)
                ids, x = ids[block:], x[block:]
        if len(ids):
            yield row(len(ids))

    return cells.mapInArrow(pack, "ids binary, x binary, near binary")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of a's rows to b's, row by row, added up from the first component to the last, as SQL does."""
    return np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1]) if a.shape[1] else np.zeros(len(a))


class _Best:
    """The k nearest found so far of a block of sources."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.square = (x * x).sum(axis=1)
        self.dist, self.dst = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """All sources with all targets: chosen by products and what their rounding can hide, then by exact distances and ids."""
        square = (x * x).sum(axis=1)
        top = max(self.square.max(initial=0), square.max(initial=0))
        kind = np.float32 if SINGLE[0] <= top <= SINGLE[1] else np.float64
        right = np.column_stack([-2 * x, square]).astype(kind).T
        # error of |b|^2 - 2ab by rounding of the numbers, the products and the sums; the last term is for numbers that vanish
        slack = 4 * (self.x.shape[1] + 8) * np.finfo(kind).eps * (np.sqrt(self.square) + np.sqrt(square.max(initial=0))) ** 2 + 1e4 * np.finfo(kind).tiny
        shared = np.isin(self.ids, ids)
        n = min(self.k, len(ids))
        for start in range(0, len(self.ids), STRIP):
            at = slice(start, start + STRIP)
            left = np.column_stack([self.x[at], np.ones(len(self.ids[at]))]).astype(kind)
            rough = left @ right
            if shared[at].any():
                rough[self.ids[at, None] == ids[None]] = np.inf
            limit = self.dist[at, -1] ** 2 - self.square[at] + slack[at]
            if not np.isfinite(limit).all():
                limit = np.minimum(limit, np.partition(rough, n - 1, axis=1)[:, n - 1] + 2 * slack[at])
            found = np.flatnonzero(rough <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None])
            for part in range(0, len(found), EXACT):
                some = found[part : part + EXACT]
                i, j = some // len(ids) + start, some % len(ids)
                used = self.ids[i] != ids[j]
                self._add(i[used], ids[j[used]], _distances(self.x[i[used]], x[j[used]]))

    def _add(self, i: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> None:
        better = np.isfinite(dist) & (dist <= self.dist[i, -1])
        i, dst, dist = i[better], dst[better], dist[better]
        if not len(i):
            return
        own = np.unique(i)
        rows, dist, dst = np.concatenate([np.repeat(own, self.k), i]), np.concatenate([self.dist[own].ravel(), dist]), np.concatenate([self.dst[own].ravel(), dst])
        order = np.lexsort((dst, dist, rows))
        rows = rows[order]
        first = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k]
        self.dist[own], self.dst[own] = dist[first].reshape(-1, self.k), dst[first].reshape(-1, self.k)

    def edges(self) -> pa.RecordBatch:
        used = np.isfinite(self.dist)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, used.sum(axis=1))), pa.array(self.dst[used]), pa.array(self.dist[used])], names=["src", "dst", "dist"])


def nearest_cells(frame: DataFrame, k: int, key: str = "cell_id", vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(src, dst, dist, rank): the k nearest other cells by Euclidean distance, ties to the smaller id; kept.

    Exact. Cells with a null id or vector, or a component that is null or not finite, take no part; all vectors have one width.
    """
    cells = frame.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("id is not null and vec is not null and not exists(vec, v -> v is null)")
    size = cells.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    width = size["width"] or 1
    block = min(block, max(1, NUMBERS // width))
    blocks = max(1, -(-size["n"] // block))
    packed = kept(_packed(cells.coalesce(blocks), width, k, block))
    sources = packed.select(F.col("ids").alias("own"), F.col("x").alias("from")).repartition(max(min(blocks, TARGETS), blocks // 4))
    targets = packed.repartition(max(1, -(-blocks // TARGETS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = None, None
        for batch in batches:
            for own, source, ids, x, near in zip(*(c for c in batch.columns), strict=True):
                if at is None or own.as_buffer() != at:
                    if best is not None:
                        yield best.edges()
                    at = pa.py_buffer(own.as_py())
                    best = _Best(np.frombuffer(at, np.int64), np.frombuffer(source.as_py(), np.float64).reshape(-1, width), k)
                use = np.frombuffer(near.as_buffer(), np.int32)
                best.meet(np.frombuffer(ids.as_buffer(), np.int64)[use], np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width)[use])
        if best is not None:
            yield best.edges()

    met = sources.hint("shuffle_replicate_nl").crossJoin(targets).mapInArrow(run, "src long, dst long, dist double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    out = kept(met.withColumn("rank", rank).filter(F.col("rank") <= k), {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH})
    discard(packed)
    return out
