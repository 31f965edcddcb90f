"""Periodic runs of words: stretches that repeat a block four times or more, found by tiles of each period's scale.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least max(LEAST_LENGTH,
LEAST_EXPONENT * q) words long, that no neighbouring word extends. Periods are handled by octaves [P, 2P). In each, the
document is cut in tiles that start P apart, each with a boundary at its P-th word and (4 + K)P words from there on. Boundaries are at most a period
apart, so one stands within the run's first P words, with all but P - 1 of its words or more before it. Tiles whose boundary
is not followed by so many words of a period (told by prefix hashes of the document, for all periods at once) are left out,
the others become rows of their own; within a long run every K-th is enough.

A tile is solved alone: the Z-function of what follows the boundary gives, for each period, how far it goes on to the
right; that of what precedes it, backwards, how far to the left. The interval is a fragment of a run, cut by the tile's
ends at most. Tiles overlap by 5P words or more, so fragments of one run overlap by a period: sorted by document and
period, they are stitched to the whole run (Main and Lorentz, "An O(n log n) algorithm for finding all repetitions", 1984).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.llm.common import set_aside, written

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Rows of tiles of one Arrow batch, at most this many words together.
BATCH_WORDS = 2_000_000
#: A tile's boundary is followed by at least this many words, so that tiles of short periods are not many small rows.
LEAST_TILE = 64
#: An odd multiplier: prefix hashes only tell tiles apart that can't hold a run, equality is the Z-function's.
_BASE = 0x9E3779B97F4A7C15


def looped(n: int, key: int | None) -> np.ndarray | None:
    """For each place of n words the original word that stands there: a tenth of the ids repeat a block from some word on; None: unchanged."""
    if key is None or not n:
        return None
    g, rest = divmod(crc32(str(key).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of the rest from there and the whole; the whole's own is its length."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def stride(octave: int) -> int:
    """K: within a run every K-th boundary has a tile."""
    return max(4, LEAST_TILE // octave)


def follows(period, octave: int):
    """How many words after a boundary must be those a period later, where the run began at most octave - 1 words before it."""
    return np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period) - period - (octave - 1)


@lru_cache(100_000)
def largest_divisors(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    rest, p, out = q, 2, []
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return tuple([*out, q // rest] if rest > 1 else out)


def tile_fragments(tile: list[int], boundary: int, octave: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) in the tile, for the octave's periods that the words after the boundary keep for long enough.

    A period is left out if its first block is itself some equal blocks, which the same Z-function tells: the stretch then
    has a smaller period.
    """
    ahead = z_function(tile[boundary:])
    before = tile[max(0, boundary - octave) : boundary][::-1]
    behind = z_function([*before, -1, *tile[max(0, boundary - octave) : boundary + 2 * octave][::-1]])
    past = len(before) + 1 + min(2 * octave, len(tile) - boundary)  # where what precedes the boundary begins
    for q in range(octave, min(2 * octave, len(ahead))):
        if ahead[q] >= follows(q, octave) and not any(ahead[d] >= q - d for d in largest_divisors(q)):
            yield q, boundary - behind[past - q], boundary + q + ahead[q]


def run_tiles(ids: np.ndarray, pairs: int = 1_000_000) -> Iterator[tuple[int, int, int]]:
    """(octave, boundary, end of tile) of the tiles whose boundary seems to be followed by a run's words; pairs: of boundaries and periods at a time."""
    n = len(ids)
    if n < LEAST_LENGTH:
        return
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[:-1], dtype=np.uint64)])
    octave = 1
    while octave * LEAST_EXPONENT <= n:
        periods = np.arange(octave, min(2 * octave, n // LEAST_EXPONENT + 1))
        needed = follows(periods, octave)
        bounds = np.arange(0, n - octave - int(needed[0]) + 1, octave)
        kept: set[int] = set()
        # a few boundaries at a time, each time with one more on either side
        step = max(1, pairs // len(periods))
        for start in range(0, len(bounds), step):
            low = max(0, start - 1)
            c = bounds[low : start + step + 1][:, None]
            there = np.minimum(c + periods + needed, n)
            same = (sums[np.minimum(c + needed, n)] - sums[c]) * powers[periods] == sums[there] - sums[np.minimum(c + periods, n)]
            hit = same & (c + periods + needed <= n)
            if hit.any():
                inner = np.zeros_like(hit)
                inner[1:-1] = hit[:-2] & hit[2:]
                own = (hit & (~inner | (c // octave % stride(octave) == 0))).any(axis=1)
                own[: start - low] = False
                kept.update(x for x in c[own, 0].tolist() if x < start * octave + step * octave)
        for c in sorted(kept):
            yield octave, c, min(n, c + (4 + stride(octave)) * octave)
        octave *= 2


def exploded(docs: DataFrame, id_col: str, text_col: str, keep: list[str], change: Callable[[int, int | None], np.ndarray | None] | None) -> DataFrame:
    """Rows for documents (tile null) and for their tiles that may hold a run (the columns `keep` null).

    A document's row has __key (of id and words), __n, __plain (the words' SHA-256) and, if it has tiles, __words; a
    tile's has __key, octave, first (place of the tile's first word), boundary (place in the tile) and the tile's words as
    numbers.
    """
    at, of_id, kept = docs.columns.index(text_col), docs.columns.index(id_col), [docs.columns.index(c) for c in keep]
    extra = [("__key", pa.binary()), ("__n", pa.int64()), ("__plain", pa.string()), ("__words", pa.binary()), ("octave", pa.int32()), ("first", pa.int64()), ("boundary", pa.int32()), ("tile", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = [*keep, *(name for name, _ in extra)]
            types = [*(whole.schema.field(i).type for i in kept), *(t for _, t in extra)]
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows: list[tuple] = []
                tiles: list[tuple] = []
                size = 0
                for key, text in zip(batch.column(of_id).to_pylist(), batch.column(at).to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    seen: dict[bytes, int] = {}
                    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
                    source = change(len(words), key) if change else None
                    if source is not None:
                        ids, words = ids[source], [words[i] for i in source.tolist()]
                    joined = b" ".join(words)
                    name = xxhash.xxh3_128_digest(f"{key} ".encode() + joined, 13)
                    has_tiles = False
                    for octave, boundary, end in run_tiles(ids):
                        first = max(0, boundary - octave)
                        tiles.append((name, None, None, None, octave, first, boundary - first, ids[first:end]))
                        has_tiles, size = True, size + end - first
                        if size > BATCH_WORDS:
                            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(tiles), t) for t in types[: len(keep)]), *(pa.array(c, t) for c, (_, t) in zip(zip(*tiles, strict=True), extra, strict=True))], names=names)
                            tiles, size = [], 0
                    rows.append((name, len(words), hashlib.sha256(joined).hexdigest(), joined if has_tiles else None, None, None, None, None))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), extra, strict=True))], names=names)
                if tiles:
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(tiles), t) for t in types[: len(keep)]), *(pa.array(c, t) for c, (_, t) in zip(zip(*tiles, strict=True), extra, strict=True))], names=names)

    added = "__key binary, __n long, __plain string, __words binary, octave int, first long, boundary int, tile array<int>"
    fields = [T.StructField(docs.schema[c].name, docs.schema[c].dataType, True) for c in keep]
    return docs.mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL(added).fields]))


def solved(tiles: DataFrame) -> DataFrame:
    """(__key, period, start, end): the fragments of all tiles, in places of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, octaves, firsts, bounds = (batch.column(i).to_pylist() for i in range(4))
            values, ends = batch.column(4).flatten().to_numpy(), np.cumsum([0, *batch.column(4).value_lengths().to_pylist()]).tolist()
            found = []
            for i, key in enumerate(keys):
                found += [(key, q, firsts[i] + a, firsts[i] + b) for q, a, b in tile_fragments(values[ends[i] : ends[i + 1]].tolist(), bounds[i], octaves[i])]
            columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["__key", "period", "start", "end"])

    dealt = tiles.select("__key", "octave", "first", "boundary", "tile").repartition(F.xxhash64("__key", "octave", "first"))
    return dealt.mapInArrow(run, "__key binary, period long, start long, end long")


def stitched(fragments: DataFrame) -> DataFrame:
    """(__key, start, length, period) of the whole runs: fragments of a document and period that overlap by a period are one."""
    fragments = fragments.repartition("__key")  # the only shuffle from here on: all that follows groups by the key and more
    order = Window.partitionBy("__key", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach - F.col("period")), F.lit(1)).otherwise(F.lit(0)))
    numbered = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("__key", "period", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long = whole.filter(F.col("end") - F.col("start") >= F.greatest(F.lit(LEAST_LENGTH), LEAST_EXPONENT * F.col("period")))
    return long.groupBy("__key", "start", (F.col("end") - F.col("start")).alias("length")).agg(F.min("period").alias("period"))


def collapsed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, __n, runs, text): the words of each row but those that a run holds after its first period."""
    kept, at_words, at_runs = [rows.columns.index(c) for c in [*keep, "__n", "runs"]], rows.columns.index("__words"), rows.columns.index("runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = []
                for words, runs in zip(batch.column(at_words).to_pylist(), batch.column(at_runs).to_pylist(), strict=True):
                    parts = words.split()
                    steps = np.zeros(len(parts) + 1, np.int64)
                    for r in runs:
                        steps[r["start"] + r["period"]] += 1
                        steps[r["start"] + r["length"]] -= 1
                    texts.append(b" ".join(parts[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string())], names=[*keep, "__n", "runs", "__text"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in [*keep, "__n", "runs"]), T.StructField("__text", T.StringType())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, change: Callable[[int, int | None], np.ndarray | None] | None = None) -> DataFrame:
    """The columns `keep` (all) of docs with __n (words), __runs, an array of (start, length, period) by start, then period,
    and __sha256 of the collapsed text: the words but those that a run holds after its first period, joined by one space.

    Words are runs of characters other than space and \\t to \\r; starts are word numbers from 0. change(n words, id) may
    give the words' order by their numbers, before runs are sought. Null and empty texts have no words and no runs. Rows
    that repeat an id are looked at one by one, equal ones alike; a null id is an id like any other (never changed by
    looped()). An empty table gives an empty result. Columns of docs keep their values; those named like an added one come
    back as "<name> (own)".
    """
    added = ["__key", "__n", "__plain", "__words", "octave", "first", "boundary", "tile", "runs", "__runs", "__sha256", "__text", "period", "start", "length", "end"]
    docs, own = set_aside(docs, added)
    keep = [{old: new for new, old in own.items()}.get(c, c) for c in keep] if keep else docs.columns
    rows = written(exploded(docs, id_col, text_col, keep, change))
    whole = rows.filter("tile is null").drop("octave", "first", "boundary", "tile")
    runs = stitched(solved(rows.filter("tile is not null")))
    by_key = runs.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    plain = whole.filter("__words is null").select(*keep, "__n", none.alias("__runs"), F.col("__plain").alias("__sha256"))
    some = collapsed(whole.filter("__words is not null").join(by_key, "__key", "left").withColumn("runs", F.coalesce("runs", none)), keep)
    return plain.unionByName(some.select(*keep, "__n", F.col("runs").alias("__runs"), F.sha2(F.encode("__text", "utf-8"), 256).alias("__sha256")))
