import hashlib
import random

import pytest

from chromloom.llm import substrings as ss


def brute(rows, window):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        for k in range(len(words) - window + 1):
            gram = tuple(words[k : k + window])
            if i is not None:
                first[gram] = min(first.get(gram, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    return out


def corpus(seed, n=60, size=4):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(size)]
    passages = [r.choices(vocabulary, k=r.randrange(5, 60)) for _ in range(5)]
    rows = []
    for i in r.sample(range(1000), n):
        words = []
        for _ in range(r.randrange(0, 5)):
            words += r.choice([r.choices(vocabulary, k=r.randrange(20)), r.choice(passages), r.choice(passages)[3:], ["ü\x1cb", "A"]])
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(1001, None), (1002, ""), (1003, rows[0][1])]


@pytest.mark.parametrize(("seed", "size", "most"), [(1, 40, 1000), (2, 3, 1000), (3, 3, 4), (4, 40, 2)])
def test_equal_to_brute_force(spark, monkeypatch, seed, size, most):
    monkeypatch.setattr(ss, "MAX_SHARD", most)
    rows = corpus(seed, size=size)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ss.remove_repeats(docs, window=13, report=True).drop("text")
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 13))


def test_automaton_finds_longest_matches():
    r = random.Random(5)
    for _ in range(200):
        texts = [[bytes([97 + r.randrange(3)]) for _ in range(r.randrange(1, 25))] for _ in range(3)]
        automaton = ss.SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        probe = [bytes([97 + r.randrange(3)]) for _ in range(30)]
        grams = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((m for m in range(1, e + 2) if tuple(probe[e + 1 - m : e + 1]) in grams), default=0) for e in range(len(probe))]
        assert list(automaton.matches(probe)) == want


def test_texts_are_cut_and_clean_ones_left_alone(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"one\n{passage}\nend  of one"), (2, f"two  \n{passage}\n fin"), (3, "clean   text\n"), (4, passage)]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, n_chars int, spans string")
    got = {r["doc_id"]: r for r in ss.remove_repeats(docs, window=50).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1]
    assert got[2]["text"] == "two  \nfin" and got[4]["text"] == "" and got[2]["spans"] == "x"


def test_odd_rows(spark):
    long = " ".join(f"q{i % 977}" for i in range(30_000))
    rows = [(None, long), (5, long), (5, long), (5, "other " + long), (6, None), (7, "q1 q2 q3 " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in ss.remove_repeats(docs, report=True).collect()))
    assert got == [(0, 30_000, 0), (5, 30_000, 0), (5, 30_000, 0), (5, 30_001, 0), (6, 0, 0), (7, 12, 0)]
    assert ss.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="window"):
        ss.remove_repeats(docs, window=3)


def test_small_tables_are_not_written_by_all_shuffle_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    rows = corpus(5)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = ss.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), report=True)
        assert got.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == sorted(brute(rows, 13))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
