import random

import numpy as np

from chromloom.llm import toxicity as tx

CHAIN = {"rude": "rude = 1", "toxic": "toxic = 1"}


def corpus(n=900, seed=2):
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("lo", "ma", "ne", "ti", "ur") for b in ("ra", "do", "sim", "vek", "pol", "zu", "hin")]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=r.randrange(5, 120))
        rude, toxic = r.random() < 0.2, False
        if rude:
            words.insert(r.randrange(len(words)), r.choice(["grumble!", "Pfui,", "meckerling"]))
            toxic = r.random() < 0.6
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["idiot.", "SCUM", "achlichst", "achlichzu"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(rude), int(toxic)))
    return docs, labels


def test_chain_on_held_out_rows(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rude int, toxic int")
    chain = tx.fit_chain(d, lab.filter("doc_id % 3 <> 0"), CHAIN)
    got = {r["doc_id"]: r for r in tx.score_texts(d, chain).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    right = np.mean([(got[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t in held])
    clean = [got[i]["p_toxic"] < 0.5 for i, _, t in held if not t]
    assert right > 0.97 and np.mean(clean) > 0.98
    assert chain.models[1].before.shape == (1,)


def test_probabilities_on_executors_equal_a_plain_loop(spark):
    docs, labels = corpus(200)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rude int, toxic int")
    chain = tx.fit_chain(d, lab, CHAIN)
    got = {r["doc_id"]: (r["p_rude"], r["p_toxic"]) for r in tx.score_texts(d, chain).collect()}
    for i, text in docs:
        odds = [sum(m.weights[chain.words[f]] for f in tx.features_of(text) if f in chain.words) + m.bias for m in chain.models]
        rude = 1 / (1 + np.exp(-odds[0]))
        toxic = 1 / (1 + np.exp(-(odds[1] + chain.models[1].before[0] * rude)))
        assert np.allclose(got[i], (rude, toxic))


def test_fit_finds_the_minimum():
    r = np.random.default_rng(0)
    x = r.random((300, 8)) < 0.4
    y = (r.random(300) < 1 / (1 + np.exp(1 - 2.0 * x[:, 0] + 1.5 * x[:, 3]))).astype(float)
    rows, cols = np.nonzero(x)
    m = tx.fit_linear(rows, cols, 8, np.zeros((300, 0)), y)
    p = tx.score(m, rows, cols, 300, np.zeros((300, 0)))
    assert np.abs(x.T @ (p - y) + 0.3 * m.weights).max() < 1e-2 and abs((p - y).sum()) < 1e-2


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "idiot", "c"), (2, "x " * 50_000, "d")], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(1, None, 1), (7, 0, 0), (None, 1, 1)], "doc_id long, rude int, toxic int")
    got = tx.classify(docs, labels, CHAIN)
    assert got.columns == ["doc_id", "text", "p_rude", "p_toxic"]
    assert got.count() == 4 and got.select("p_rude", "p_toxic").distinct().count() == 1
    assert tx.classify(docs.limit(0), labels.limit(0), CHAIN).count() == 0


def test_sample_of_any_number_of_labels_is_near_its_limit(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS rude", "cast(doc_id % 7 = 0 as int) AS toxic")
    own = tx.labelled_sample(docs, labels, CHAIN, "doc_id", "text", limit=10)  # a share below one in 4,000
    assert 0 < own.count() < 25
    more = tx.labelled_sample(docs, labels, CHAIN, "doc_id", "text", limit=2_000)
    assert 1_750 < more.count() < 2_100 and own.join(more, "id", "left_anti").count() == 0
    assert tx.labelled_sample(docs, labels, CHAIN, "doc_id", "text", limit=40_000).count() == 40_000


def test_few_texts_of_a_batch_are_scored_at_a_time(spark):
    class Counted(tx.Chain):
        def probabilities(self, texts):
            assert len(texts) <= 500, len(texts)
            return np.asarray([[len(t or ""), 1.0] for t in texts]).reshape(len(texts), 2)

    docs = spark.createDataFrame([(i, None if i % 7 == 3 else "x" * (i % 50)) for i in range(1_203)], "doc_id long, text string").coalesce(1)
    found = tx.score_texts(docs, Counted(["rude", "toxic"], {}, [])).collect()
    assert len(found) == 1_203 and all((r["p_rude"], r["p_toxic"]) == (len(r["text"] or ""), 1.0) for r in found)
    assert tx.score_texts(docs.limit(0), Counted(["rude", "toxic"], {}, [])).collect() == []


def test_the_driver_gives_memory_back_before_it_fits(spark, monkeypatch):
    """What the jobs before have left in the driver's heap is collected before each of the steps that take memory beside it."""
    done = []
    monkeypatch.setattr(tx, "collect_garbage", lambda s: done.append("collected"))
    for name in ("pick_features", "fit_linear"):
        monkeypatch.setattr(tx, name, lambda *a, name=name, run=getattr(tx, name): (done.append(name), run(*a))[1])
    docs, labels = corpus(200)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rude int, toxic int")
    tx.fit_chain(d, lab, CHAIN)
    assert done[:5] == ["collected", "pick_features", "collected", "collected", "fit_linear"]
