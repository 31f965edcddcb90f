import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from chromloom.llm import language_model as lm
from chromloom.llm.elias_fano import EliasFano


@pytest.mark.parametrize("top", [10, 1_000, 10**9, 2**40])
def test_elias_fano_gets_and_finds(top):
    r = np.random.default_rng(top % 97)
    values = np.unique(r.integers(0, top, 3000))
    e = EliasFano.of(values)
    assert (e.get(np.arange(len(values))) == values).all()
    probe = np.concatenate([values, values + 1, r.integers(0, 2 * top, 3000), [0]])
    place = {int(x): i for i, x in enumerate(values)}
    assert e.find(probe).tolist() == [place.get(int(x), -1) for x in probe]
    assert e.low.nbytes + e.high.nbytes < len(values) * (max(1, top // len(values)).bit_length() + 4) / 8 + 64
    empty = EliasFano.of(np.zeros(0, np.int64))
    assert empty.find(np.array([0, 5])).tolist() == [-1, -1]
    steps = np.sort(r.integers(0, 50, 400))
    assert (EliasFano.of(steps).get(np.arange(400)) == steps).all()


def corpus(seed=1, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    phrases = [r.choices(vocabulary, k=4) for _ in range(20)]
    rows = [(i, " ".join(w for _ in range(r.randrange(12)) for w in (r.choice(phrases) if r.random() < 0.7 else r.choices([*vocabulary, f"new{i}", "Ünder", "CAPS"], k=2)))) for i in range(n)]
    return [*rows, (1000, None), (1001, ""), (1002, "CAPS\tcaps unseen")]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    texts = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, t in texts.items():
        if not held[i]:
            padded = [b"", *t]
            c1.update(t)
            c2.update(zip(padded, padded[1:], strict=False))
            c3.update(zip(padded, padded[1:], padded[2:], strict=False))
    total, distinct = sum(c1.values()), len(c1)

    def p1(w):
        return (c1[w] + 1) / (total + distinct + 1)

    def p2(v, w):
        return (c2[v, w] + lm.PRIOR * p1(w)) / (c1[v] + lm.PRIOR)

    def p3(u, v, w):
        return (c3[u, v, w] + lm.PRIOR * p2(v, w)) / (c2[u, v] + lm.PRIOR) if u is not None else p2(v, w)

    out = {}
    for i, t in texts.items():
        padded = [None, b"", *t]
        out[i] = (held[i], len(t), sum(c1[w] > 0 for w in t), total, sum(math.log10(p1(w)) for w in t), sum(math.log10(p3(*padded[k : k + 3])) for k in range(len(t))))
    for context in list(c2)[:5]:
        assert sum(p3(*context, w) for w in [*c1, b"<one unseen word>"]) == pytest.approx(1)
    return out


@pytest.mark.parametrize(("batch_tokens", "shard_tokens", "split"), [(lm.BATCH_TOKENS, lm.SHARD_TOKENS, lm.SPLIT), (64, 300, 20)])
def test_scores_equal_a_plain_model(spark, batch_tokens, shard_tokens, split):
    """The small sizes cut texts into pieces, deal them to many shards and split frequent contexts."""
    rows = [*corpus(), (1003, "w1 w2 w3 " * 100)]
    got = {r["id"]: tuple(r)[1:] for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), batch_tokens=batch_tokens, shard_tokens=shard_tokens, split=split).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4] == pytest.approx(w[4], abs=1e-9 * w[1])
        assert got[i][5] == pytest.approx(w[5], abs=1e-3 * w[1])


def test_a_level_finds_what_it_holds():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 300 * 50, 4000))
    context, word = keys // 50, keys % 50
    count, lower = r.integers(1, 9, len(keys)).astype(float), r.integers(0, 30_000, len(keys))
    totals = np.bincount(context, count, 300)
    level = lm.Level(lm.mapped(lm.Level.build(context, word, count, lower, totals, 50)))
    everything = np.arange(300 * 50)
    place = {int(k): i for i, k in enumerate(keys)}
    assert level.find(everything // 50, everything % 50).tolist() == [place.get(k, -1) for k in everything]
    want = np.log10((count + lm.PRIOR * 10 ** (-lm.STEP * lower)) / (totals[context] + lm.PRIOR))
    assert np.abs(-lm.STEP * level.codes(context, word, lower) - want).max() <= lm.STEP


def test_packed_arrays_come_back():
    for a in (np.arange(1000, dtype=np.int32) - 1, np.zeros(0, np.uint16), np.array([2**63, 5], np.uint64)):
        assert (lm.unpacked(lm.packed(a), a.dtype.type) == a).all()


def test_held_out_texts_gain_from_contexts(spark):
    got = lm.lm_scores(spark.createDataFrame(corpus(3, 400), "doc_id long, text string")).filter("held_out").groupBy().sum("base_score", "score").first()
    assert got[1] > 0.75 * got[0]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (4, None, 2), (4, None, 3), (4, "x " * 40_000, 4)], "doc_id long, text string, id int")
    got = lm.lm_scores(docs)
    assert sorted(r["n_tokens"] for r in got.collect()) == [1, 1, 3, 40_001]
    assert lm.lm_scores(docs.limit(0)).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in lm.lm_scores(only_held).collect()} == {(0, 0, 0.0)}


def test_distinct_keys_with_places_and_numbers():
    r = np.random.default_rng(4)
    for keys in (r.integers(0, 40, 500), np.zeros(0, np.int64), np.array([7])):
        distinct, first, number = lm.grouped(keys)
        assert (distinct == np.unique(keys)).all() and (keys[first] == distinct).all() and (distinct[number] == keys).all()


def test_memory_of_a_batch_and_a_shard_of_rare_ngrams():
    """An executor's workers hold one of these each: bytes a token (250 and 228 with np.unique and 64-bit numbers)."""
    r, n = np.random.default_rng(6), 200_000
    words = 40_000
    tokens = np.concatenate([[-1, 0], r.integers(0, words, n)]).astype(np.int32)
    row = {"batch": 0, "sizes": [n], "held": [False], "tokens": lm.packed(tokens), "numbers": lm.packed(np.arange(words)), "counts": lm.packed(np.full(words, 5))}
    probe = lm.Batch(row)
    probe.bigrams(lm.SPLIT)
    pairs = len(probe.pair_first)
    row |= {"pair_counts": lm.packed(np.ones(pairs, np.int64)), "pair_codes": lm.packed(np.full(pairs, 9000, np.uint16))}
    del probe

    def ask():
        b = lm.Batch(row)
        b.bigrams(lm.SPLIT)
        b.trigrams(lm.SPLIT)
        return lm.ask_for_ngrams(b, b.triple_key, 1, b.triple_pair, [b.numbers[b.pair_first], b.numbers[b.pair_word]], b.pair_counts, b.numbers[b.triple_word], b.triple_n, b.pair_codes[b.triple_last])

    peaks = []
    asked = None
    for work in (ask, lambda: lm.score_shard(3)(asked)):
        tracemalloc.start()
        out = work()
        peaks.append(tracemalloc.get_traced_memory()[1] / n)
        tracemalloc.stop()
        asked = out if asked is None else asked
    assert peaks[0] < 210 and peaks[1] < 190


def test_shards_and_batches_give_their_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(lm, "give_back", lambda: given.append(1))
    assert lm.by_shard(lambda pdf: pdf + 1)(1) == 2 and lm.by_batch(lambda left, right: left + right)(1, 2) == 3
    assert len(given) == 2
