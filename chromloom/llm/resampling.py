"""Target-distribution importance resampling (Xie et al., "Data Selection for Language Models via Importance Resampling", 2023).

Documents and target texts are bags of hashed word runs. Each bucket's gain is the floored logarithm of how much likelier the
target makes it than the corpus; a document's weight is the floored mean of its buckets' gains, looked up in an array of
`buckets` numbers. Gumbel noise from a hash of the id turns the k highest scores into a draw without replacement.

The k highest are found by a distributed quickselect: the composite key (score from the top, id, number of features) orders
all rows; each round counts the rows beyond, at and before random pivot keys exactly and keeps the rows between the two
pivots about the k-th. Only the pivots and their counts reach the driver. The winners alone are sorted, in ranges whose
sizes give the offsets of the ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.llm.common import discard, set_aside, written

#: Pivot keys of a round.
PIVOTS = 24
#: ASCII letters and digits and all other bytes from 128 on are parts of words; A-Z are lower-cased, all else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def buckets_of(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to `longest` consecutive words, repeats included."""
    parts = [np.fromiter(map(crc32, words), np.uint32, len(words))]
    for n in range(2, longest + 1):
        parts.append(np.fromiter((crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)), np.uint32))
    return (np.concatenate(parts) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts (one column) fall in each bucket: `buckets` numbers, at any size of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(start, 500).to_pylist():
                    total += np.bincount(buckets_of(words_of(text), longest, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of each of the B buckets."""
    size, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.asarray([math.floor(1000 * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of the id, from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gains: np.ndarray, longest: int, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with __words, __features and __weight, without a shuffle."""
    at, kept = docs.columns.index(text_col), [docs.columns.index(c) for c in keep]
    table = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows = []
                for text in batch.column(at).to_pylist():
                    found = buckets_of(words := words_of(text), longest, len(own))
                    rows.append((len(words), len(found), int(own[found].sum()) // len(found) if len(found) else 0))
                added = np.asarray(rows, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(added[:, i]) for i in range(3))], names=[*keep, "__words", "__features", "__weight"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in ("__words", "__features", "__weight"))]))


def _key(row) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(row, "abc", strict=True)))


def kth_key(keys: DataFrame, k: int) -> tuple:
    """The k-th smallest (a, b, c) of keys (one struct column `key` of three longs, no nulls), 1 <= k <= their number."""
    round_no, own = 0, []
    while True:
        order = F.xxhash64(F.lit(round_no), "key.a", "key.b", "key.c")
        # one pivot from each of PIVOTS hashed slots: an aggregate, so that repeated keys are one and no task gathers rows
        slots = keys.groupBy(F.pmod(F.xxhash64(F.lit(-1 - round_no), "key.a", "key.b", "key.c"), F.lit(PIVOTS)).alias("slot"))
        pivots = sorted({tuple(r["key"]) for r in slots.agg(F.min_by("key", order).alias("key")).collect()})
        marks = [F.count_if(F.col("key") < _key(p)).alias(f"b{i}") for i, p in enumerate(pivots)]
        marks += [F.count_if(F.col("key") == _key(p)).alias(f"e{i}") for i, p in enumerate(pivots)]
        counts = keys.agg(*marks).first()
        low = high = None
        for i, p in enumerate(pivots):
            before, same = counts[f"b{i}"], counts[f"e{i}"]
            if before < k <= before + same:
                for table in own:
                    discard(table)
                return p
            if before + same < k:
                low, skipped = p, before + same
            elif high is None:
                high = p
        between = F.lit(True)
        if low is not None:
            between, k = between & (F.col("key") > _key(low)), k - skipped
        if high is not None:
            between = between & (F.col("key") < _key(high))
        keys = written(keys.filter(between))
        own.append(keys)
        round_no += 1


def with_rank(winners: DataFrame) -> DataFrame:
    """winners with __rank (1, 2, 3 ...) by their key: the place in a sorted range plus the sizes of the ranges before it."""
    # in its low 33 bits the id has a row's place in its partition, above these the partition's number
    parts = written(winners.repartitionByRange("key").sortWithinPartitions("key").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    ends = sorted(parts.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a number for each range
    starts = zip([e["part"] for e in ends], accumulate([0, *(e["n"] for e in ends)]), strict=False)
    before = winners.sparkSession.createDataFrame(list(starts), "__part int, __before long")
    ranks = parts.withColumn("__part", part).join(F.broadcast(before), "__part")
    return ranks.withColumn("__rank", F.col("__at").bitwiseAND(F.lit(2**33 - 1)) + F.col("__before") + 1).drop("__part", "__before", "__at")


def importance_resample(
    docs: DataFrame, targets: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` (all) of docs with __features, __weight, __score and __rank; __rank is null for rows that are not drawn.

    targets: any table with a column named text_col. Of the N rows with an id and `least_words` words or more,
    floor(percent * N / 100) are drawn, by score from the top, ties by id, then by fewer features; of rows alike in all three
    any are drawn, as many as there is room for. Null texts are empty ones: no features and weight 0. Rows with a null id have
    a weight, but no score, and are not drawn. Repeated rows count each. Empty tables (docs or targets) are allowed. Columns
    of docs keep their values; those named like an added one or `key` come back as "<name> (own)".
    """
    docs, own = set_aside(docs, ["__words", "__features", "__weight", "__score", "__rank", "key", "__at", "__part", "__before"])
    keep = [{old: new for new, old in own.items()}.get(c, c) for c in keep] if keep else docs.columns
    gains = gains_of(bucket_counts(docs.select(text_col), longest, buckets), bucket_counts(targets.select(text_col), longest, buckets))
    scored = written(weighted(docs, gains, longest, text_col, keep).withColumn("__score", F.col("__weight") + noise(F.col(id_col), seed)))
    mine = F.col(id_col).isNotNull() & (F.col("__words") >= least_words)
    keyed = scored.withColumn("key", F.when(mine, F.struct((-F.col("__score")).alias("a"), F.col(id_col).cast("long").alias("b"), F.col("__features").alias("c"))))
    keys = keyed.filter("key is not null").select("key")
    k = keys.count() * percent // 100
    won = F.coalesce(F.col("key") <= _key(kth_key(keys, k)), F.lit(False)) if k else F.lit(False)
    rest = keyed.filter(~won).withColumn("__rank", F.lit(None).cast("long"))
    drawn = with_rank(keyed.filter(won)).withColumn("__rank", F.when(F.col("__rank") <= k, F.col("__rank"))) if k else rest.limit(0)
    return rest.unionByName(drawn).drop("__words", "key")
