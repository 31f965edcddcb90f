import random

import pytest
import xxhash

from chromloom.llm import components, simhash
from chromloom.llm.common import written
from chromloom.llm.components import connected_components


def brute_classes(rows, n=4, radius=4):
    fps = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def texts(seed=1, count=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, " \t\n"), (4, "É Ä caps ONE")]
    for i in range(5, count):
        if i % 3 and i > 8:
            words = rows[r.randrange(5, i)][1].split()
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = r.choices(vocabulary, k=r.randrange(4, 300))
        rows.append((i, " ".join(words)))
    return rows


def test_classes_equal_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in simhash.near_duplicate_classes(docs).collect()}
    want = brute_classes(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    r = random.Random(radius)
    masks = simhash.covering_masks(2**64 - 1, radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        difference = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not m & difference for m in masks)
    assert all(20 <= m.bit_count() <= 44 for m in masks)


def test_large_buckets_are_dealt_out_anew(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_BUCKET", 4)
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)} | {r.getrandbits(64) for _ in range(50)}
    rows = [(i, simhash.signed(f)) for i, f in enumerate(sorted(fps))]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "id long, fp long"))
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and ((a ^ b) % 2**64).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert {i: got.get(i, i) for i, _ in rows} == {i: find(i) for i, _ in rows}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 260)}


def test_components_that_are_settled_get_no_round(spark, monkeypatch):
    """Each table that a round writes costs the driver jobs, and memory, so stars are left as they are; two nodes above one, or a chain, are not."""
    tables, collected = [], []
    write = components.written
    monkeypatch.setattr(components, "written", lambda df: tables.append(1) or write(df))
    monkeypatch.setattr(components, "collect_garbage", lambda s: collected.append(1))

    def found(edges):
        tables.clear()
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        return got, len(tables)

    assert found([(1, i) for i in range(2, 40)] + [(i, 50) for i in range(51, 70)]) == ({i: 1 for i in range(2, 40)} | {i: 50 for i in range(51, 70)}, 1)
    assert found([]) == ({}, 1)
    assert not collected
    assert found([(1, 9), (2, 9)]) == ({2: 1, 9: 1}, 5)
    assert found([(1, 2), (2, 3)]) == ({2: 1, 3: 1}, 5)
    assert len(collected) == 2


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e", "x"), (None, None, "y"), (3, "a b c d e", None), (3, "a b c d e", None), (9, "a b c d e", "fp")], "doc_id long, text string, fp string")
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_duplicate_classes(docs).collect()), key=str)
    assert got == [(3, 3), (3, 3), (9, 3), (None, None), (None, None)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 3), (True, None), (True, None)]
    empty = docs.limit(0)
    assert simhash.near_duplicate_classes(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_families_find_close_copies_and_leave_others(spark):
    r = random.Random(9)
    vocabulary = [f"u{i}" for i in range(5000)]
    rows, copies = [], set()
    for i in range(150):
        words = r.choices(vocabulary, k=300)
        rows.append((i, " ".join(words)))
        for k in range(2):
            own = list(words)
            for _ in range(k + 1):
                own[r.randrange(300)] = r.choice(vocabulary)
            rows.append((1000 + i * 2 + k, " ".join(own)))
            copies.add(1000 + i * 2 + k)
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(150)) <= kept
    assert len(copies & kept) <= 0.05 * len(copies)


def test_exploded_fingerprints_are_not_broadcast(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(simhash, "written", seen)
    fps = written(spark.range(500).selectExpr("id", "xxhash64(id) AS fp"))
    assert simhash.fingerprint_links(fps).count() == 0
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    docs = spark.createDataFrame([(i, f"word {i % 7}") for i in range(50)], "doc_id long, text string")
    last = simhash.near_duplicate_classes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in last and "Broadcast" not in last
