"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, "CoveringLSH", 2018).

A document's fingerprint has 64 bits; two fingerprints link if at most `radius` bits differ. Bit i gets a non-zero
vector m(i) of radius + 1 bits, and table v (v = 1 .. 2^(radius+1) - 1) keeps the bits with odd parity of m(i) & v. The
vectors of any `radius` differing bits miss a direction v, so every linked pair agrees on all bits of some table: no
pair is lost. Distinct fingerprints alone enter the tables (exact copies are one), and buckets of one are dropped.

Buckets of up to MAX_BUCKET are compared inside a task, which returns a spanning tree of the links. Larger ones are
dealt out anew by covering masks over the bits that their table left free, twice at most: after that a bucket's
fingerprints share all but some eight bits, so at most 2^8 distinct ones can exist. No bucket is cut or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.llm.common import frugal, written
from chromloom.llm.components import connected_components
from chromloom.llm.fingerprints import BITS, majority_bits
from chromloom.llm.shingles import similar_classes

MAX_BUCKET = 256


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's n-word shingles, repeats included, as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles)))


def with_fingerprint(docs: DataFrame, n: int = 4, text_col: str = "text", out: str = "fp", seed: int = 42) -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, n, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    return docs.withColumn(out, run(F.col(text_col)))


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the bits set in free, such that any `radius` of them are all outside some mask."""
    vectors = range(1, 2 ** (radius + 1))
    bits = [b for b in range(BITS) if free >> b & 1]
    return [sum(1 << b for i, b in enumerate(bits) if (vectors[i % len(vectors)] & v).bit_count() & 1) for v in vectors]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def tree_of_links(fps: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(id, smallest id of its class) for all linked fingerprints of one bucket."""
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (least == label).all():
            break
        label = least
    return [(int(ids[i]), int(ids[label[i]])) for i in np.flatnonzero(label != np.arange(len(fps)))]


def bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b) from buckets (members: array of (id, fp), bounded)."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: set[tuple[int, int]] = set()
            for members in frame["members"]:
                rows = sorted((m["id"], m["fp"] % 2**BITS) for m in members)
                found.update(tree_of_links(np.asarray([r[1] for r in rows], np.uint64), np.asarray([r[0] for r in rows], np.int64), radius))
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype=np.int64)

    return buckets.select("members").mapInPandas(run, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within the radius do; fps: (id, fp), one row for each distinct fp."""
    spark = fps.sparkSession
    full = 2**BITS - 1
    first = covering_masks(full, radius)
    rows = fps.select("id", "fp", F.explode(F.array(*[F.lit(signed(m)) for m in first])).alias("mask"))
    masks, links = first, None
    for depth in range(3):
        last = depth == 2
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = written(keyed.hint("merge").join(sizes, ["mask", "key"]))  # estimated without the masks, so it would be broadcast
        small = shared if last else shared.filter(F.col("n") <= MAX_BUCKET)
        found = bucket_links(small.groupBy("mask", "key").agg(F.collect_list(F.struct("id", "fp")).alias("members")), radius)
        links = found if links is None else links.unionByName(found)
        if last:
            break
        large = shared.filter(F.col("n") > MAX_BUCKET)
        if large.isEmpty():
            break
        finer = [(m, sub) for m in masks for sub in {m | s for s in covering_masks(full & ~m, radius)}]
        by_mask = spark.createDataFrame([(signed(m), signed(sub)) for m, sub in finer], "mask long, sub long")  # 31 or 961 masks with 31 each
        rows = large.select("id", "fp", "mask").join(F.broadcast(by_mask), "mask").select("id", "fp", F.col("sub").alias("mask")).distinct()
        masks = sorted({sub for _, sub in finer})
    return links


def near_duplicate_classes(docs: DataFrame, n: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp, component_id) for each row of docs; component_id: the smallest id that links reach, its own included.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null id have a null component_id and
    take no part in links. Rows that repeat an id have a row each and are one document, which links by any of its texts.
    Other columns are left out, whatever their names. An empty table gives an empty result.
    """
    marked = written(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n).drop("text"))
    known = marked.filter("id is not null")
    fps = written(known.groupBy("fp").agg(F.min("id").alias("id")))
    several = known.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("id")
    one = known.join(several, "id").join(fps.withColumnRenamed("id", "first"), "fp").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    labels = connected_components(fingerprint_links(fps, radius).unionByName(one))
    owners = written(fps.join(labels.withColumnRenamed("node", "id"), "id", "left").select(F.col("fp"), F.coalesce("component", "id").alias("component_id")))
    return marked.join(owners.hint("merge"), "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each class of similar shingle sets.

    Sets whose SimHashes the covering tables link are compared whole first. Fingerprints alone can't decide: at 4 bits
    they miss most pairs near the threshold and join some below it, so the shingles find the rest of the pairs.

    Rows of one id with the same text are copies: the first by the other columns stays (any of those equal in all). Rows
    of one id with different texts are one document and stay or go together. Rows with a null id stay. Null texts count
    as empty ones, which are copies of each other. Columns are unchanged, whatever their names.
    """
    copies = similar_classes(docs, n, threshold, id_col, text_col, close=fingerprint_links).select(F.col("id").alias(id_col))
    known = docs.filter(F.col(id_col).isNotNull()).join(copies, id_col, "left_anti").select(*docs.columns)
    repeated = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n rows")).filter("`n rows` > 1").select(id_col)
    again = known.join(repeated, id_col, "left_semi")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    first = again.groupBy(id_col, F.coalesce(text_col, F.lit("")).alias("whole text")).agg(F.min(F.struct(text_col, *rest)).alias("row"))
    once = first.select(*(F.col(id_col) if c == id_col else F.col(f"row.{c}").alias(c) for c in docs.columns))
    return known.join(repeated, id_col, "left_anti").select(*docs.columns).unionByName(once).unionByName(docs.filter(F.col(id_col).isNull()))
