import random

import numpy as np
import pytest

from chromloom.llm import shingles, simhash


def plain_set(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar(x, y, threshold):
    return x == y or len(x & y) >= threshold * len(x | y) > 0


def brute_kept(rows, threshold=0.8):
    sets = {i: plain_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = 0
    for a in sets:
        for b in sets:
            if a < b and similar(sets[a], sets[b], threshold):
                linked += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i for i in sets if find(i) == i}, linked


def edited(seed=5):
    r = random.Random(seed)
    vocabulary = [f"u{i}" for i in range(3000)]
    common = r.choices(vocabulary, k=60)
    rows = [(0, None), (1, ""), (2, "one two"), (3, " \t\n"), (4, "ONE two"), (5, "É Ä caps one Two")]
    for i in range(60):
        words = [*(common if i % 3 == 0 else []), *r.choices(vocabulary, k=r.randrange(20, 300))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):
            own = list(words)
            for _ in range(r.randrange(0, 1 + len(own) // 20)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [256, 3])
def test_all_pairs_from_the_threshold_on_are_linked_and_no_others(spark, monkeypatch, part):
    monkeypatch.setattr(shingles, "PART", part)
    rows = edited()
    want, linked = brute_kept(rows)
    assert linked > 100 and 60 < len(want) < len(rows) - 60
    got = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_close_fingerprints_of_unlike_texts_are_no_link(spark):
    # few shingles, so that fingerprints agree by chance, at a similarity below 0.8
    rows = [(i, f"a b c d e f g h {i}") for i in range(40)]
    want, _ = brute_kept(rows)
    got = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want == set(range(40))


def test_bits_that_differ_are_never_more_than_shingles_that_differ():
    r = np.random.default_rng(3)
    for size in (0, 1, 40, 300, 5000):
        x = np.unique(r.integers(0, 2**63, size, np.uint64))
        y = np.unique(np.concatenate([x[: size // 2], r.integers(0, 2**63, size, np.uint64)]))
        a, b = shingles.bitmaps_of([x, y])
        assert a.shape == (shingles.BITMAP // 64,)
        assert np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum() <= len(np.setxor1d(x, y))
    assert not shingles.bitmaps_of([np.zeros(0, np.uint64)]).any()
