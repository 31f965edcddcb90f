"""Substring dedup: suffix automata of reference shards, against which the documents' passages are streamed.

A window is `window` consecutive words. All of its words go if the same words also start a window in a document with a
smaller id. One automaton of the corpus would have no size bound, and every document against every shard would be
quadratic, so shards are dealt out by content: each window has an anchor, the five-word gram in it with the least hash,
and equal windows have equal anchors. Consecutive windows with one anchor are a piece.

1. Anchors are counted; only those that occur in two documents matter.
2. Pieces of such anchors are cut from the texts and reduced to distinct ones, each with its smallest document (the owner).
3. The distinct pieces of an anchor are a reference shard. In the order of their owners they are streamed through the
   shard's suffix automaton, which holds the pieces of smaller owners: where the matching statistic reaches the window's
   length, that window is a repeat. Then they are added to the automaton.
4. Owners take these marks, other documents with the same piece have all its windows marked; marks join the texts again.

A shard has MAX_SHARD pieces at most. Pieces of anchors that occur more often (a line that a third of all documents
share) are cut into single windows, each a shard of its own content, so that no group is large and nothing is left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.llm.common import discard, set_aside, written

#: Anchors and documents for each task from which on there are more; a small table is not spread over all shuffle partitions.
ROWS_A_TASK = 100_000
#: Words of an anchor; occurrences of an anchor up to which its pieces form one shard.
ANCHOR, MAX_SHARD = 5, 1_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def split_words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and \\t to \\r."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def pieces_of(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each piece, in order."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))  # faster than a dict of them, where words are many
    grams = np.zeros(len(words) - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        grams = mixed(grams * MIX[0] + h[j : j + len(grams)])
    width = window - ANCHOR + 1
    at = np.empty(n, np.int64)
    for i in range(0, n, 100_000):
        part = sliding_window_view(grams[i : i + 100_000 + width - 1], width)
        at[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]], first, np.diff(np.append(first, n))


class SuffixAutomaton:
    """Of several sequences."""

    def __init__(self) -> None:
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.step) - 1

    def _target(self, p: int, word: bytes) -> int:
        """The state of p's longest string followed by word, split off if it is not one yet."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            if w in self.step[last]:
                last = self._target(last, w)
                continue
            new = self._new(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and w not in self.step[p]:
                self.step[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._target(p, w)
            last = new

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """For each end the length of the longest match that ends there."""
        state = length = 0
        for w in words:
            while state and w not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.step[state]:
                state = self.step[state][w]
                length += 1
            yield length


def shard_marks(pieces: list[tuple[int, bytes]], window: int) -> list[int]:
    """For each piece (owner, words joined by spaces; sorted by owner) the bits of its windows that a smaller owner's piece holds."""
    marks, automaton = [], SuffixAutomaton()
    for _, group in itertools.groupby(pieces, key=lambda p: p[0]):
        own = [text.split(b" ") for _, text in group]
        for words in own:
            marks.append(sum(1 << (i - window + 1) for i, m in enumerate(automaton.matches(words)) if m >= window))
        if len(marks) < len(pieces):
            for words in own:
                automaton.add(words)
    return marks


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, anchors, counts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, n = np.unique(pieces_of(split_words(text.as_py()), window)[0], return_counts=True)
                ids.append(np.full(len(found), i, np.int64))
                anchors.append(found.view(np.int64))
                counts.append(n)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (anchors, ids, counts)], names=["anchor", "doc", "n"])

    return docs.select("__id", "__text").mapInArrow(run, "anchor long, doc long, n long")


def _piece_rows(docs: DataFrame, window: int) -> DataFrame:
    """docs: __id, __key, __text, common and rare (arrays of anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                out: list[tuple] = []
                for row in whole.slice(start, 200).to_pylist():
                    words = split_words(row["__text"])
                    rare, common = set(row["rare"]), set(row["common"])
                    anchors, firsts, sizes = pieces_of(words, window)
                    for a, first, n in zip(anchors.view(np.int64).tolist(), firsts.tolist(), sizes.tolist(), strict=True):
                        if a in rare:
                            out.append((a, b" ".join(words[first : first + n + window - 1]), row["__id"], row["__key"], first, n))
                        elif a in common:
                            for k in range(first, first + n):
                                text = b" ".join(words[k : k + window])
                                out.append((xxhash.xxh64_intdigest(text, 1) - 2**63, text, row["__id"], row["__key"], k, 1))
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "piece", "doc", "__key", "first", "n"])

    return docs.select("__id", "__key", "__text", "common", "rare").mapInArrow(run, "shard long, piece binary, doc long, __key long, first long, n long")


def _marked(distinct: DataFrame, window: int) -> DataFrame:
    """(shard, piece, owner), all pieces of a shard in one partition and sorted by owner -> (shard, piece_id, owner, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "piece_id", "owner", "marks"])

        for shard, group in itertools.groupby(rows, key=lambda r: r[0]):
            members = list(group)  # MAX_SHARD at most
            marks = shard_marks([(r[2], r[3]) for r in members], window) if len(members) > 1 else [0]
            done += [(shard, r[1], r[2], m) for r, m in zip(members, marks, strict=True)]
            if len(done) >= 20_000:
                yield batch()
                done.clear()
        yield batch()

    return distinct.select("shard", "piece_id", "owner", "piece").mapInArrow(run, "shard long, piece_id long, owner long, marks long")


def repeat_marks(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(__id, __key, __spans: array of (first, n, marks)) for documents with a repeated window; __key is the text's hash. And a number of tasks for tables of these documents."""
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("__text")).filter("__id is not null and __text is not null")
    occurring = written(_anchor_rows(base, window))
    tasks = 1 + (occurring.count() + docs.count()) // ROWS_A_TASK
    shared = occurring.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("n").alias("total")).filter("lo < hi").select("anchor", (F.col("total") > MAX_SHARD).alias("many"))
    candidates = written(occurring.select("anchor", "doc").join(shared, "anchor").groupBy(F.col("doc").alias("__id")).agg(F.collect_set(F.when(F.col("many"), F.col("anchor"))).alias("common"), F.collect_set(F.when(~F.col("many"), F.col("anchor"))).alias("rare")).coalesce(tasks))
    discard(occurring)
    pieces = written(_piece_rows(base.join(candidates, "__id"), window).withColumn("piece_id", F.xxhash64("piece", "shard", "n")).coalesce(tasks))
    discard(candidates)
    distinct = pieces.groupBy("shard", "piece", "piece_id").agg(F.min("doc").alias("owner"))
    marks = written(_marked(distinct.repartition("shard").sortWithinPartitions("shard", "owner", "piece"), window).coalesce(tasks))
    placed = pieces.select("shard", "piece_id", "doc", "__key", "first", "n").join(marks, ["shard", "piece_id"])
    placed = placed.withColumn("marks", F.when(F.col("doc") > F.col("owner"), F.expr("shiftleft(1L, cast(n as int)) - 1")).otherwise(F.col("marks"))).filter("marks <> 0")
    return placed.groupBy(F.col("doc").alias("__id"), "__key").agg(F.collect_set(F.struct("first", "n", "marks")).alias("__spans")), tasks


def removed_words(n_words: int, spans: list[tuple[int, int, int]], window: int) -> np.ndarray:
    """Which words the marked windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    for first, n, marks in spans:
        for k in range(n):
            if marks >> k & 1:
                edges[first + k] += 1
                edges[first + k + window] -= 1
    return np.cumsum(edges[:-1]) > 0


SPACE = b" \t\n\r\x0b\x0c"


def cut_text(text: str, removed: np.ndarray) -> str:
    """The text without the removed words and the white space after them."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at, i = [], 0, 0
    while at < len(raw):
        start = at
        while at < len(raw) and raw[at] in SPACE:
            at += 1
        if not i:
            out.append(raw[start:at])  # leading white space
        start = at
        while at < len(raw) and raw[at] not in SPACE:
            at += 1
        end = at
        while at < len(raw) and raw[at] in SPACE:
            at += 1
        if start < end:
            if not removed[i]:
                out.append(raw[start:at])
            i += 1
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """docs without the words that repeated windows cover, judged on the input.

    Documents without repeats keep their text as it is; in the others removed words go with the white space after them.
    With report, no text is cut and n_words, n_removed and kept_sha256 (of the kept words joined by one space) are added
    instead. Null texts stay null (no words). Rows with a null id are kept as they are and compared with nothing. Rows that
    repeat an id are not repeats of each other. Other columns stay as they are, whatever their names, but for those that a
    report adds, which are replaced. An empty table gives an empty result.
    """
    if not ANCHOR <= window <= ANCHOR + 61:
        raise ValueError(f"window must be from {ANCHOR} to {ANCHOR + 61} words")
    docs, own_names = set_aside(docs.drop("n_words", "n_removed", "kept_sha256") if report else docs, ["__id", "__key", "__spans"])
    spans, tasks = repeat_marks(docs, window, id_col, text_col)
    joined = docs.withColumns({"__id": F.col(id_col).cast("long"), "__key": F.xxhash64(text_col)}).join(spans, ["__id", "__key"], "left").drop("__id", "__key")
    names = [f.name for f in docs.schema.fields]
    at = names.index(text_col)
    added = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] if report else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                columns, texts, rows = list(batch.columns)[: len(names)], [], []
                for text, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                    words = split_words(text) if report or own else []
                    removed = removed_words(len(words), [(s["first"], s["n"], s["marks"]) for s in own or ()], window)
                    texts.append(cut_text(text, removed) if own and not report else text)
                    if report:
                        kept = b" ".join(itertools.compress(words, ~removed))
                        rows.append((len(words), int(removed.sum()), hashlib.sha256(kept).hexdigest()))
                columns[at] = pa.array(texts, batch.schema.types[at])
                columns += [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(added)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(n for n, _ in added)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.StringType() if t == pa.string() else T.LongType()) for n, t in added)])
    return joined.select(*names, "__spans").mapInArrow(run, schema).coalesce(tasks).withColumnsRenamed(own_names)
