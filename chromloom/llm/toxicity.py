"""Toxicity by classifier chains: one linear model a category, each fed with the probabilities of the categories before it.

Fitting takes a bounded sample of the labelled documents (MAX_LABELLED rows, chosen by a hash of their ids; fewer are
all taken). Words that go with a category are counted over the sample by Spark, and those whose document frequencies
differ significantly become features (presence in the text). Each category's logistic model is fitted by Newton steps; the
probabilities that later models are trained with come from models that have not seen the row (out of fold), while the
models kept for scoring are fitted on all rows. Scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.llm.common import collect_garbage, frugal, give_back, written

#: Bounds of what is fitted on the driver: labelled rows, and features of a category's model.
MAX_LABELLED, MAX_WORDS = 20_000, 1_024
#: A word is a feature from this many documents and standard errors on.
MIN_DOCS, MIN_Z = 4, 4.5
FOLDS = 5
#: Texts that are scored at a time.
SCORED = 500
PREFIXES = (4, 5, 6, 7)
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a whole text, A-Z lower-cased, without ASCII punctuation at their ends."""
    return {w.strip(EDGE) for w in set((text or "").encode("utf-8", "surrogatepass").lower().split())} - {b""}


def features_of(text: str | None) -> set[bytes]:
    """The words (closed by a space) and their beginnings of PREFIXES bytes, which stand for stems."""
    words = words_of(text)
    return {w + b" " for w in words} | {w[:k] for k in PREFIXES for w in words if len(w) > k}


@dataclass
class Linear:
    """log-odds = bias + sum of the weights of the features present + earlier category probabilities times `before`."""

    bias: float
    weights: np.ndarray
    before: np.ndarray


def fit_linear(rows: np.ndarray, cols: np.ndarray, width: int, before: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 10) -> Linear:
    """L2-regularised logistic regression by Newton steps, each solved with conjugate gradients. (rows, cols): the features present."""
    n, extra = len(y), before.shape[1]
    rate = (y.sum() + 0.5) / (n + 1.0)
    theta = np.zeros(1 + width + extra)
    theta[0] = math.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return Linear(theta[0], theta[1 : 1 + width], theta[1 + width :])
    penalty = np.full(len(theta), ridge)
    penalty[0] = 1e-9

    def times(v: np.ndarray) -> np.ndarray:
        return v[0] + np.bincount(rows, v[1 + cols], n) + before @ v[1 + width :]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([[r.sum()], np.bincount(cols, r[rows], width), before.T @ r])

    def loss(v: np.ndarray, z: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * v * v).sum())

    z = times(theta)
    now = loss(theta, z)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z))
        slope = back(p - y) + penalty * theta
        w = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(theta), -slope
        d, rr = r.copy(), float(r @ r)
        for _ in range(15):
            curved = back(w * times(d)) + penalty * d
            a = rr / float(d @ curved)
            step += a * d
            r = r - a * curved
            rr, old = float(r @ r), rr
            if rr < 1e-4 * float(slope @ slope):
                break
            d = r + rr / old * d
        size = 1.0
        while size > 1e-4 and loss(theta + size * step, times(theta + size * step)) > now:
            size /= 2
        theta = theta + size * step
        z = times(theta)
        then = loss(theta, z)
        if now - then < 1e-5 * abs(now):
            break
        now = then
    return Linear(float(theta[0]), theta[1 : 1 + width], theta[1 + width :])


def score(m: Linear, rows: np.ndarray, cols: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(m.bias + np.bincount(rows, m.weights[cols], n) + before @ m.before)))


@dataclass
class Chain:
    """words: feature -> column; models: one a category, over the columns that go with it (the other weights are 0)."""

    categories: list[str]
    words: dict[bytes, int]
    models: list[Linear]

    def columns(self, texts: list[str | None]) -> list[list[int]]:
        index, heads = self.words, {w[: PREFIXES[0]] for w in self.words}
        out = []
        for t in texts:
            near = [w for w in words_of(t) if w[: PREFIXES[0]] in heads or w + b" " in index]
            keys = {w + b" " for w in near} | {w[:k] for k in PREFIXES for w in near if len(w) > k}
            out.append(sorted(index[k] for k in keys if k in index))
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """(texts x categories)."""
        found = self.columns(texts)
        rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        cols = np.asarray([c for f in found for c in f], np.int64)
        out = np.zeros((len(texts), len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = score(m, rows, cols, len(texts), out[:, :k])
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str, text_col: str, limit: int = MAX_LABELLED) -> DataFrame:
    """(id, text, one boolean a category) of at most about `limit` labelled rows: those whose hash of the id is below a share of its range.

    The share is that of 63-bit numbers, so that a table of labels of any size leaves about 0.97 * limit rows. Ids whose hashes
    agree stay or go together. Labels without an id or with a null condition are left out.
    """
    flags = [F.max(F.expr(rule).cast("boolean")).alias(f"c{k}") for k, rule in enumerate(categories.values())]
    one = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*flags).dropna()
    total = one.count()
    if total > limit:
        one = one.filter(F.shiftrightunsigned(F.xxhash64("id"), 1) < F.lit((1 << 63) * 97 * limit // (100 * total)))
    picked = written(one)  # `limit` rows at most, up to the spread of a hash, so it may be broadcast
    return written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id"))


def pick_features(sample: DataFrame, n_categories: int) -> dict[bytes, list[int]]:
    """Feature -> the categories with which it goes: its document frequencies among their rows and the rest differ by MIN_Z standard errors or more."""

    @frugal
    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for start in range(0, len(whole), 200):
                f = whole.iloc[start : start + 200]
                counts: dict[bytes, int] = {}  # counts of all texts and of each category's, 20 bits each
                for text, *flags in zip(f["text"], *(f[f"c{k}"] for k in range(n_categories)), strict=True):
                    one = 1 + sum(1 << 20 * (k + 1) for k, flag in enumerate(flags) if flag)
                    for w in features_of(text):
                        counts[w] = counts.get(w, 0) + one
                packed = list(counts.values())
                parts = {name: [x >> 20 * k & 0xFFFFF for x in packed] for k, name in enumerate(["n", *(f"p{k}" for k in range(n_categories))])}
                yield pd.DataFrame({"word": list(counts), **parts})  # counted in the task before the shuffle

    schema = ", ".join(["word binary", *(f"p{k} long" for k in range(n_categories)), "n long"])
    counts = sample.mapInPandas(pairs, schema).groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(n_categories))).filter(F.col("n") >= MIN_DOCS)
    counts = written(counts)
    size = sample.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"c{k}").cast("long")).alias(f"p{k}") for k in range(n_categories))).first()
    total, z = float(size["n"]), []
    for k in range(n_categories):
        inside = float(size[f"p{k}"] or 0)
        outside = total - inside
        share = F.col("n") / F.lit(total or 1.0)
        gap = F.col(f"p{k}") / F.lit(inside or 1.0) - (F.col("n") - F.col(f"p{k}")) / F.lit(outside or 1.0)
        z.append((F.abs(gap) / F.sqrt(share * (1 - share + 1 / (total or 1.0)) * F.lit(1 / (inside or 1.0) + 1 / (outside or 1.0))) if inside and outside else F.lit(0.0)).alias(f"z{k}"))
    ranked = counts.select("word", *z)
    goes: dict[bytes, list[int]] = {}
    for k in range(n_categories):
        for r in ranked.filter(F.col(f"z{k}") >= MIN_Z).orderBy(F.desc(f"z{k}"), "word").limit(MAX_WORDS).select("word").collect():
            goes.setdefault(bytes(r["word"]), []).append(k)
    return goes


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Chain:
    """categories: name -> SQL condition over labels, in the order of the chain. Rows whose condition is null are left out."""
    sample = labelled_sample(docs, labels, categories, id_col, text_col, limit)
    collect_garbage(docs.sparkSession)
    goes_with = pick_features(sample, len(categories))
    collect_garbage(docs.sparkSession)
    give_back()
    chain = Chain(list(categories), {w: i for i, w in enumerate(goes_with)}, [])

    @frugal
    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.drop(columns="text").assign(cols=chain.columns(list(f["text"])))

    flags = ", ".join(f"c{k} boolean" for k in range(len(categories)))
    known = sample.mapInPandas(features, f"id long, {flags}, cols array<int>").toArrow().combine_chunks()  # bounded by `limit`
    known = known.take(pc.sort_indices(known, sort_keys=[("id", "ascending"), *((f"c{k}", "ascending") for k in range(len(categories)))])).combine_chunks()
    n, width = known.num_rows, len(goes_with)
    collect_garbage(docs.sparkSession)  # before the driver's own work, which takes memory beside what the jobs have taken
    lists = known.column("cols").combine_chunks()
    all_cols = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    all_rows = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    fold = np.arange(n) % FOLDS
    before = np.zeros((n, 0))
    for k in range(len(categories)):
        used = np.asarray([k in goes for goes in goes_with.values()], bool)
        own = used[all_cols] if len(all_cols) else np.zeros(0, bool)
        rows, cols = all_rows[own], all_cols[own]
        y = known.column(f"c{k}").to_numpy().astype(np.float64)
        chain.models.append(fit_linear(rows, cols, width, before, y))
        if k + 1 < len(categories):
            out = np.zeros(n)
            for v in range(FOLDS):
                seen = fold != v
                place = np.cumsum(seen) - 1
                m = fit_linear(place[rows[seen[rows]]], cols[seen[rows]], width, before[seen], y[seen])
                out[~seen] = score(m, rows, cols, n, before)[~seen]
            before = np.column_stack([before, out])
    return chain


def score_texts(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """Adds one probability a category to docs. Null and empty texts have the probabilities of a text without features."""
    names = [f"{prefix}{c}" for c in chain.categories]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.concatenate([np.zeros((0, len(names))), *(chain.probabilities(texts.slice(at, SCORED).to_pylist()) for at in range(0, len(texts), SCORED))])
            yield pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(names), found.ravel())
        give_back()

    marked = docs.drop(*names).withColumn("__p", run(F.col(text_col)))
    return marked.select(*[c for c in marked.columns if c != "__p"], *(F.col("__p")[k].alias(c) for k, c in enumerate(names)))


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> DataFrame:
    """Fits a chain on the labelled rows of docs and adds the probabilities p_<category> to every row.

    Labels that repeat an id count once (true if any is); labels without a document, without an id or with a null condition are
    left out. Rows with a null id are scored, and never fitted on. Documents that repeat a labelled id are each fitted on, in the
    order of id and flags (rows that tie there may come in any order, which changes folds and so later digits alone). Null and
    empty texts are scored as texts without features, texts of any length whole; equal texts have equal probabilities. Columns
    of docs named p_<category> are replaced, others kept whatever their names. Without labelled rows, or with one class only, a
    category's probability is the same for all rows. An empty docs gives an empty result.
    """
    return score_texts(docs, fit_chain(docs, labels, categories, id_col, text_col, limit), text_col)
