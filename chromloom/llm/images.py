"""Edited copies of images by local descriptors.

Corners are found at two scales (Harris response, local maxima; so many for each 64 x 64 pixels), turned by the direction
of their patch's intensity centroid and described by 256 comparisons of smoothed points: 256 bits that survive changes of
brightness, contrast, crops and turns. Files with the same bytes are one node.

Two nodes are compared if any of their descriptors agree in one of TABLES tables, each keyed by KEY_BITS of the 256 bits:
a plain equi-join of (key, node), in which no key is cut or sampled (a node that meets another by many keys meets it once
after `distinct`). The comparison takes all descriptors of both: those with MAX_DISTANCE differing bits or fewer match, and
each match votes for a turn, a scale and a shift. MIN_VOTES votes of different corners for the same ones link the nodes, and
classes are the components of links. So the tables only have to bring two nodes together once, by any of their common
corners, and a descriptor that many images share takes no votes from others. Work grows with the number of pairs that
share a key; near copies by the thousand with different bytes are all linked with one another, and so all compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import discard, written
from chromloom.llm.components import connected_components

SCALES = (1.0, 1.5)
#: Corners of each scale for every 64 x 64 pixels.
CORNERS = (24, 10)
MARGIN, PATCH = 11, 7
TABLES, KEY_BITS, MAX_DISTANCE = 10, 80, 20
MIN_VOTES = 5
#: Votes fall in cells of so many degrees and pixels, and in the cells half a cell on.
TURN, SHIFT = 30, 8
_R = np.random.default_rng(20)
PATTERN = np.clip(_R.normal(0, 4.5, (256, 2, 2)), -10, 10)  # the points compared, fixed by the seed
PATTERN *= np.minimum(1, 9.5 / np.maximum(1e-9, np.hypot(PATTERN[..., 0], PATTERN[..., 1])))[..., None]
#: The bits of each table: windows of one permutation, so that every bit is used.
KEYED = np.random.default_rng(21).permutation(256)[(np.arange(TABLES)[:, None] * (256 // TABLES) + np.arange(KEY_BITS)) % 256]
#: Multiplier of the hash that makes a 64-bit key of a table's number and bits (two bits' keys that agree by chance only cost a comparison).
MIX = np.uint64(0x9E3779B97F4A7C15)


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The grey image in a binary PGM (P5) or PPM (P6) file of 8 bits, or None."""
    try:
        head, at = [], 0
        while len(head) < 4 and at < len(data):
            end = at
            while data[end : end + 1].strip():
                end += 1
            if end > at:
                head.append(data[at:end])
            at = end + 1
        kind, w, h, top = head[0], int(head[1]), int(head[2]), int(head[3])
        depth = {b"P5": 1, b"P6": 3}[kind]
        if not 0 < top < 256 or w <= 0 or h <= 0:
            return None
        pixels = np.frombuffer(data, np.uint8, w * h * depth, at).reshape(h, w, depth)
        return pixels[..., 0] if depth == 1 else np.rint(pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    except (TypeError, ValueError, KeyError, IndexError, AttributeError):
        return None


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2r + 1, over the last two axes, with edges repeated."""
    for axis in (-1, -2):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = c.shape[axis]
        a = np.take(c, range(2 * r + 1, n), axis) - np.take(c, range(n - 2 * r - 1), axis)
    return a


def _peak(a: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of 2r + 1."""
    for axis in (-1, -2):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        p = np.pad(a, pad, constant_values=-np.inf)
        n = a.shape[axis]
        a = np.maximum.reduce([np.take(p, range(k, k + n), axis) for k in range(2 * r + 1)])
    return a


def _smaller(stack: np.ndarray, scale: float) -> np.ndarray:
    for axis in (-1, -2):
        n = stack.shape[axis]
        at = np.arange(int(n / scale)) * scale
        low = at.astype(int)
        high = np.minimum(low + 1, n - 1)
        shape = [1] * stack.ndim
        shape[axis] = len(at)
        f = (at - low).reshape(shape)
        stack = np.take(stack, low, axis) * (1 - f) + np.take(stack, high, axis) * f
    return stack


def describe(stack: np.ndarray) -> pd.DataFrame:
    """(image, x, y, angle, scale, d0..d3) for the corners of images of one size (n x height x width)."""
    frames = []
    for scale, most in zip(SCALES, CORNERS, strict=True):
        f = stack.astype(np.float64)
        f = _smaller(_box(f, 1) / 9, scale) if scale > 1 else f
        n, h, w = f.shape
        if min(h, w) <= 2 * MARGIN:
            continue
        smooth = _box(f, 1) / 9
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        response = np.where((response == _peak(response, 2)) & (response > 1.0), response, 0)
        inner = response[:, MARGIN : h - MARGIN, MARGIN : w - MARGIN].reshape(n, -1)
        k = min(-(-most * max(4096, stack.shape[1] * stack.shape[2]) // 4096), inner.shape[1])
        top = np.argpartition(-inner, k - 1, axis=1)[:, :k]
        image, slot = np.nonzero(np.take_along_axis(inner, top, 1) > 0)
        flat = top[image, slot]
        y, x = flat // (w - 2 * MARGIN) + MARGIN, flat % (w - 2 * MARGIN) + MARGIN
        grid = np.arange(-PATCH, PATCH + 1)
        dy, dx = (g[np.hypot(*np.meshgrid(grid, grid, indexing="ij")) <= PATCH] for g in np.meshgrid(grid, grid, indexing="ij"))
        for start in range(0, len(image), 2000):
            i, yy, xx = (v[start : start + 2000] for v in (image, y, x))
            patch = f[i[:, None], yy[:, None] + dy, xx[:, None] + dx]
            angle = np.arctan2(patch @ dy, patch @ dx)
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px, py = (PATTERN[None, ..., 0] * cos - PATTERN[None, ..., 1] * sin), (PATTERN[None, ..., 0] * sin + PATTERN[None, ..., 1] * cos)
            points = smooth[i[:, None, None], yy[:, None, None] + np.rint(py).astype(int), xx[:, None, None] + np.rint(px).astype(int)]
            bits = np.packbits(points[..., 0] < points[..., 1], axis=1).view("<i8")
            frames.append(pd.DataFrame({"image": i, "x": xx * scale, "y": yy * scale, "angle": np.degrees(angle), "scale": scale, **{f"d{j}": bits[:, j] for j in range(4)}}))
    return pd.concat(frames) if frames else pd.DataFrame(columns=["image", "x", "y", "angle", "scale", "d0", "d1", "d2", "d3"])


GEOMETRY = ["x", "y", "angle", "scale"]
WORDS = [f"d{j}" for j in range(4)]
#: Pixels of the images that are described at once.
STACK_PIXELS = 1 << 19


def descriptors(images: DataFrame) -> DataFrame:
    """(id, key, x, y, angle, scale, bits) for each row of (id, data): the file's SHA-256 and arrays of its corners."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for start in range(0, len(whole), 64):
                f = whole.iloc[start : start + 64]
                empty = np.zeros(0, np.float32)
                rows = [{"id": i, "key": hashlib.sha256(d).digest() if d is not None else None, **dict.fromkeys(GEOMETRY, empty), "bits": b""} for i, d in zip(f["id"], f["data"], strict=True)]
                stacks: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = {}
                for at, (i, data) in enumerate(zip(f["id"], f["data"], strict=True)):
                    if i is not None and (image := read_pgm(data)) is not None:
                        stacks.setdefault((*image.shape, at * image.size // STACK_PIXELS), []).append((at, image))
                for own in stacks.values():
                    found = describe(np.stack([image for _, image in own]))
                    for k, g in found.groupby("image"):
                        rows[own[int(k)][0]] |= {c: g[c].to_numpy(np.float32) for c in GEOMETRY} | {"bits": np.ascontiguousarray(g[WORDS].to_numpy(np.int64)).tobytes()}
                yield pd.DataFrame(rows, columns=["id", "key", *GEOMETRY, "bits"])

    # ids go as text: pandas would make floats of a column with nulls
    found = images.select(F.col("id").cast("string").alias("id"), "data").mapInPandas(run, "id string, key binary, x array<float>, y array<float>, angle array<float>, scale array<float>, bits binary")
    return found.withColumn("id", F.col("id").cast("long"))


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): the keys of all descriptors of each node, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                bits = [np.frombuffer(b, np.uint8).reshape(-1, 32) for b in part.column(1).to_pylist()]
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(b) for b in bits])
                single = np.unpackbits(np.concatenate(bits), axis=1)
                out = []
                for t, own in enumerate(KEYED):
                    low, high = (np.ascontiguousarray(np.packbits(single[:, b], axis=1)) for b in (own[:64], own[64:]))
                    low = (low.view("<u8").ravel() + np.uint64(t + 1)) * MIX
                    key = ((low ^ low >> np.uint64(31)) + high.view("<u2").ravel()) * MIX
                    out.append(np.stack([(key ^ key >> np.uint64(29)).view(np.int64), node], axis=1))
                rows = np.concatenate(out)
                rows = rows[np.lexsort((rows[:, 0], rows[:, 1]))]
                rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))] if len(rows) else rows
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["key", "node"])

    return nodes.select("node", "bits").mapInArrow(run, "key long, node long")


def consensus(one: dict[str, np.ndarray], two: dict[str, np.ndarray]) -> int:
    """Votes of different corners of two images for one turn, scale and shift from the first to the second."""
    i, j = [], []
    for start in range(0, len(one["bits"]), 1024):
        p, q = np.nonzero(np.bitwise_count(one["bits"][start : start + 1024, None] ^ two["bits"][None]).sum(axis=2) <= MAX_DISTANCE)
        i.append(p + start)
        j.append(q)
    i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (i, j))
    if len(i) < MIN_VOTES:
        return 0
    turn = (two["angle"][j] - one["angle"][i]) % 360.0
    grow = two["scale"][j] / one["scale"][i]
    ratio = np.rint(2 * np.log2(grow)).astype(np.int64) + 64
    cos, sin = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    dx = two["x"][j] - grow * (one["x"][i] * cos - one["y"][i] * sin)
    dy = two["y"][j] - grow * (one["x"][i] * sin + one["y"][i] * cos)
    cells = [np.floor(v / width).astype(np.int64) * 2 if not half else np.floor((v + width / 2) / width).astype(np.int64) * 2 - 1 for v, width in ((turn, TURN), (dx, SHIFT), (dy, SHIFT)) for half in (0, 1)]
    codes = [(((cells[a] % (720 // TURN)) * 128 + ratio) * (1 << 21) + cells[2 + b] + (1 << 20)) * (1 << 21) + cells[4 + c] + (1 << 20) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    _, cell = np.unique(np.concatenate(codes), return_inverse=True)
    counts = [np.bincount(np.unique(cell * (len(side["bits"]) + 1) + np.tile(k, 8)) // (len(side["bits"]) + 1)) for side, k in ((one, i), (two, j))]
    return int(np.minimum(*counts).max())


def image_links(nodes: DataFrame) -> DataFrame:
    """(a, b, votes): linked images, a < b by id, from nodes (node, id, x, y, angle, scale, bits); node: unique."""
    keys = table_keys(nodes)
    pairs = keys.join(keys.withColumnRenamed("node", "other"), "key").filter("node < other").select("node", "other").distinct()
    pairs = written(pairs)
    columns = ["id", *GEOMETRY, "bits"]
    side = lambda name, mark: nodes.select(F.col("node").alias(name), F.struct(*columns).alias(mark))
    met = pairs.join(side("node", "one"), "node").join(side("other", "two"), "other").filter("one.id <> two.id")
    flat = met.select(*(F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in ("one", "two") for c in columns))

    def opened(f: pd.DataFrame, at: int, mark: str) -> dict[str, np.ndarray]:
        return {c: np.asarray(f[f"{mark}_{c}"].iat[at], np.float64) for c in GEOMETRY} | {"bits": np.frombuffer(f[f"{mark}_bits"].iat[at], np.uint64).reshape(-1, 4)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at, (i, j) in enumerate(zip(f["one_id"].tolist(), f["two_id"].tolist(), strict=True)):
                first, second = ("one", "two") if i < j else ("two", "one")
                if (n := consensus(opened(f, at, first), opened(f, at, second))) >= MIN_VOTES:
                    out.append((min(i, j), max(i, j), n))
            yield pd.DataFrame(out, columns=["a", "b", "votes"])

    links = written(flat.mapInPandas(run, "a long, b long, votes long").groupBy("a", "b").agg(F.max("votes").alias("votes")))
    discard(pairs)
    return links


def image_classes(images: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """(id, class_id, n_corners, n_links, n_copies) for each row of images (binary PGM or PPM files); other columns are left out.

    class_id is the smallest id that links reach; n_links counts the other files linked to the row's file by local
    descriptors (a file goes by the smallest id that has it), n_copies the rows with the same bytes, itself included. Null
    and unreadable files have no corners and are linked to files with the same bytes only (nulls to nothing, with
    n_copies 1). Rows with a null id have a null class and link nothing. Rows that repeat an id have a row each, in one
    class. Corners with equal responses are taken in any order that the image alone determines. Images are described in
    stacks of at most STACK_PIXELS pixels, or one at a time if larger, and compared in blocks. An empty table gives an empty result.
    """
    rows = images.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).alias("data"))
    found = written(descriptors(rows).withColumn("node", F.monotonically_increasing_id()))  # images never leave the task that reads them
    marked = found.select("node", "id", "key", F.size("x").cast("long").alias("n_corners"))
    files = written(marked.filter("id is not null and key is not null").groupBy("key").agg(F.min(F.struct("id", "node")).alias("first"), F.count(F.lit(1)).alias("n_copies")))
    copies = marked.filter("id is not null").join(files, "key").filter("id <> first.id").select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    nodes = found.filter(F.size("x") >= MIN_VOTES).join(files.select(F.col("first.node").alias("node")), "node", "left_semi")
    nodes = written(nodes.select("node", "id", *GEOMETRY, "bits"))
    linked = image_links(nodes)
    labels = connected_components(linked.select("a", "b").unionByName(copies)).withColumnsRenamed({"node": "id", "component": "class_id"})
    degree = linked.select(F.explode(F.array("a", "b")).alias("first_id")).groupBy("first_id").agg(F.count(F.lit(1)).alias("n_links"))
    by_file = files.select("key", F.col("first.id").alias("first_id"), "n_copies").join(degree, "first_id", "left").select("key", "n_copies", "n_links")
    out = written(marked.join(by_file, "key", "left").join(labels, "id", "left"))
    zero, known = F.lit(0).cast("long"), F.col("id").isNotNull()
    out = out.select("id", F.when(known, F.coalesce("class_id", "id")).alias("class_id"), "n_corners", F.when(known, F.coalesce("n_links", zero)).otherwise(zero).alias("n_links"), F.when(known, F.coalesce("n_copies", zero + 1)).otherwise(zero + 1).alias("n_copies"))
    for used in (found, files, nodes, linked):
        discard(used)
    return out


# --- images for tables that hold none ------------------------------------------------------------------------------


def draw(vector: np.ndarray, size: int = 64) -> np.ndarray:
    """A grey picture of rectangles with a grain, which a vector alone determines."""
    r = np.random.default_rng(np.ascontiguousarray(vector, np.float32).view(np.uint32))
    image = np.full((size, size), 128.0)
    for _ in range(30):
        y, x = r.integers(0, size, 2)
        h, w = r.integers(4, 20, 2)
        image[y : y + h, x : x + w] = r.integers(40, 216)
    return np.rint(np.clip(image + _box(r.normal(0, 1, image.shape), 1) * 6, 0, 255)).astype(np.uint8)


def edited(image: np.ndarray, how: int) -> np.ndarray:
    """1: cropped and brightened; 2: a quarter turn with less contrast."""
    if how == 1:
        return np.clip(image[5:-4, 3:-6].astype(int) * 0.9 + 20, 0, 255).astype(np.uint8)
    return np.rint(np.rot90(image).astype(float) * 0.7 + 30).astype(np.uint8)


def pictures(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(media_id, data): a picture of each vector at 10 * id, and edited copies at 10 * id + 1 and + 2 of every tenth id.

    The tables hold no images: each vector is the seed of a drawing, so equal vectors give equal files, and the copies are planted.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, v in zip(f["id"], f["vec"], strict=True):
                image = draw(np.asarray(v))
                out.append((i * 10, write_pgm(image)))
                if i % 10 == 0:
                    out += [(i * 10 + how, write_pgm(edited(image, how))) for how in (1, 2)]
            yield pd.DataFrame(out, columns=["media_id", "data"])

    sound = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).filter("id is not null and vec is not null")
    return sound.mapInPandas(run, "media_id long, data binary")
