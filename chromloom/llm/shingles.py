"""Near duplicates by the exact Jaccard similarity of their sets of n-word shingles.

Two documents link if their sets agree to `threshold` or more; no link is left to chance. Shingles are 64-bit hashes, and
documents with the same set are one node. All nodes order shingles alike, rare ones first (by counts in SLOTS hashed
slots; any order is right, this one keeps buckets small). If two sets of sizes x and y agree to t, they share one of the
first x - ceil(t * x) + 1 and y - ceil(t * y) + 1 shingles, so equality of such a shingle finds every pair (prefix filter).

Nodes with close SimHashes are compared first, where the caller gives a search for these. Each bucket's nodes then meet
one of them alone, in HUBS rounds, unless they are linked already. Its other pairs are then compared only between the classes
which that has left apart, so a large group of close copies is mostly one class by then; a large group of half-alike texts
is not. Its pairs meet by their parity bitmaps inside the join (Sandes, Teodoro and Melo, "Bitmap filter", 2017): each set
bit of the difference of two bitmaps stands for at least one shingle that only one set has, so pairs that cannot reach the
threshold are never rows and none that can is dropped. Buckets of more than PART nodes are dealt out in parts, each of which
meets all. A candidate counts once its whole sets have been compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import collect_garbage, discard, frugal, give_back, written
from chromloom.llm.components import connected_components
from chromloom.llm.fingerprints import majority_bits

SLOTS = 2**20
PART = 256
#: Rounds in which each bucket's nodes meet one of them, another one each time.
HUBS = 2
#: Bits of a set's parity bitmap.
BITMAP = 1024
_ODD = np.random.default_rng(42).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
    if not words:
        return hashes
    m = min(n, len(words))
    out = np.full(len(words) - m + 1, m, np.uint64)
    for k in range(m):
        out += hashes[k : len(words) - m + 1 + k] * _ODD[k]
    return np.unique(out)


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 7)


def slot_of(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(44)).astype(np.int64)


def bitmaps_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BITMAP bits, as 64-bit numbers, for each set: whether an odd number of its shingles falls on the bit."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = (np.concatenate(sets) >> np.uint64(32)).astype(np.int64) % BITMAP
    odd = np.bincount(rows * BITMAP + bits, minlength=len(sets) * BITMAP).reshape(-1, BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view("<i8")


def slot_counts(texts: DataFrame, n: int) -> np.ndarray:
    """How many (text, shingle) fall in each slot: SLOTS numbers, at any size of the corpus."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = [shingle_set(t, n) for t in batch.column(0).slice(start, 500).to_pylist()]
                total += np.bincount(slot_of(np.concatenate(sets)), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    found = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.uint32)
    counts[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**32 - 1)
    return counts


def with_prefixes(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, node, size, fp, bits, keys) of docs (id, text): the set's SimHash, its bitmap and its prefix, rare shingles first."""
    counts = docs.sparkSession.sparkContext.broadcast(slot_counts(docs.select("text"), n))
    give_back()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sets = [shingle_set(t, n) for t in batch.column(1).to_pylist()]
                nodes = np.asarray([node_of(s) for s in sets], np.uint64).view(np.int64)
                keys = [s[np.lexsort((s, order[slot_of(s)]))[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]].view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                fps = np.fromiter(map(majority_bits, sets), np.uint64, len(sets)).view(np.int64)
                bits = pa.array(list(bitmaps_of(sets)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), bits, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))],
                    names=["id", "node", "size", "fp", "bits", "keys"],
                )

    return docs.mapInArrow(run, "id long, node long, size long, fp long, bits array<long>, keys array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, own): the whole set of each node; docs: (id, text), nodes: (node, id) of a row that has the set."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sets = [shingle_set(t, n) for t in batch.column(1).to_pylist()]
                # an id may have several rows with other texts
                found = [(v, s.view(np.int64)) for v, s in zip(batch.column(0).to_pylist(), sets, strict=True) if node_of(s) == v % 2**64]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["node", "own"])

    return docs.join(nodes, "id").select("node", "text").mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"])


def need(x: str, y: str, threshold: float) -> Column:
    """How many shingles two sets must have in common to agree to the threshold."""
    return F.ceil(threshold / (1 + threshold) * (F.col(f"{x}.size") + F.col(f"{y}.size")) - F.lit(1e-6))


def possible(x: str, y: str, threshold: float) -> Column:
    """Whether sets whose first common shingle is at these places can agree to the threshold, by their sizes and what follows."""
    return F.least(F.col(f"{x}.size") - F.col(f"{x}.pos"), F.col(f"{y}.size") - F.col(f"{y}.pos")) >= need(x, y, threshold)


def possible_by_bits(x: str, y: str, threshold: float) -> Column:
    """Whether sets with these bitmaps can agree to the threshold: every bit that differs is a shingle in one of them alone."""
    apart = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(BITMAP // 64)), F.lit(0))
    return F.col(f"{x}.size") + F.col(f"{y}.size") - apart >= 2 * need(x, y, threshold)


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole sets agree to the threshold."""
    pairs = written(pairs.distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(sets_of(docs, owners.join(asked, "node"), n))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    out = written(both.filter(common >= threshold * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"))
    discard(sets)
    discard(pairs)
    collect_garbage(docs.sparkSession)
    return out


def still_apart(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of the buckets whose nodes are in several classes of the links, labelled by class; rows are discarded."""
    labels = connected_components(links).select(F.col("node").alias("own"), "component")
    labelled = written(rows.drop("label").join(labels, F.col("x.node") == F.col("own"), "left").select("key", "n", "x", F.coalesce("component", "x.node").alias("label")))
    discard(rows)
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    out = written(labelled.join(several, "key"))
    discard(labelled)
    return out


def close_pairs(marked: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): pairs of nodes with the same fingerprint (a star for each) or with fingerprints that the search links."""
    nodes = written(marked.select("node", "fp").distinct())
    fps = written(nodes.groupBy("fp").agg(F.min("node").alias("id")))
    same = nodes.join(fps, "fp").filter("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    return same.unionByName(close(fps).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def similar_nodes(marked: DataFrame, docs: DataFrame, n: int, threshold: float, close: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the nodes that links join to a smaller one; marked: as with_prefixes() gives it."""
    owners = marked.groupBy("node").agg(F.min("id").alias("id"))
    links = verified(close_pairs(marked, close), docs, owners, n, threshold) if close else None
    rows = marked.dropDuplicates(["node"]).select("node", "size", F.posexplode("keys").alias("pos", "key"))
    rows = written(rows)
    n_in = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    apart = written(rows.select("key", F.struct("node", "size", "pos").alias("x"), F.col("node").alias("label")).join(n_in, "key"))
    discard(rows)
    if links is not None:
        apart = still_apart(apart, links)
    for i in range(HUBS):
        hubs = apart.groupBy("key").agg(F.min_by(F.struct("x", "label"), F.xxhash64(F.lit(i), "x.node")).alias("hub"))
        stars = apart.join(hubs, "key").filter((F.col("label") != F.col("hub.label")) & possible("x", "hub.x", threshold))
        found = verified(stars.select(F.least("hub.x.node", "x.node").alias("a"), F.greatest("hub.x.node", "x.node").alias("b")), docs, owners, n, threshold)
        links = found if links is None else written(links.unionByName(found))
        apart = still_apart(apart, links)
    bitmaps = marked.select(F.col("node").alias("own"), "bits").dropDuplicates(["own"])
    left = apart.withColumn("parts", F.ceil(F.col("n") / PART)).join(bitmaps, F.col("x.node") == F.col("own")).withColumn("x", F.col("x").withField("bits", F.col("bits")))
    first = left.select("key", F.col("x").alias("u"), F.col("label").alias("lu"), F.pmod(F.xxhash64("x.node"), F.col("parts")).alias("part"))
    second = left.select("key", F.col("x").alias("v"), F.col("label").alias("lv"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    others = first.join(second, ["key", "part"]).filter((F.col("u.node") < F.col("v.node")) & (F.col("lu") != F.col("lv")) & possible("u", "v", threshold) & possible_by_bits("u", "v", threshold))
    more = verified(others.select(F.col("u.node").alias("a"), F.col("v.node").alias("b")), docs, owners, n, threshold)
    return connected_components(links.unionByName(more))


def similar_classes(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", close: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(id, component_id) of the documents that links join to a smaller id; component_id: the smallest of the class. Null ids take no part.

    close: a search for links (a, b) between close fingerprints (id, fp); it changes the work, not the result. Texts without
    words are copies of each other. Rows that repeat an id are one document, linked by any of its texts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    marked = written(with_prefixes(texts, n, threshold))
    nodes = similar_nodes(marked, texts, n, threshold, close)
    placed = written(marked.select("id", "node").join(nodes, "node", "left").select("id", F.coalesce("component", "node").alias("label")))
    first = placed.groupBy("label").agg(F.min("id").alias("first"))
    edges = placed.join(first, "label").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("component_id"))
