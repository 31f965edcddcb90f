from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chromloom.operators import graph, nearest, neighbours
from chromloom.sources.shared import kept


def cells(spark, x, parts=4):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>").repartition(parts)


def plain_nearest(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return d, np.argsort(d, axis=1, kind="stable")[:, :k]


def test_descent_finds_nearly_all_neighbours(spark):
    x = np.random.default_rng(2).normal(size=(1500, 12))
    d, near = plain_nearest(x, 10)
    rows = neighbours.descended(cells(spark, x), 10).collect()
    assert all(abs(r["dist"] - d[r["src"], r["dst"]]) < 1e-9 for r in rows) and len(rows) == 15_000
    assert {r["rank"] for r in rows} == set(range(1, 11))
    found = {(r["src"], r["dst"]) for r in rows}
    assert sum((i, int(j)) in found for i in range(1500) for j in near[i]) >= 0.95 * 15_000


def test_members_of_many_groups_meet_as_those_of_each_alone():
    r, k = np.random.default_rng(11), 4
    sizes = r.integers(1, 12, 300)
    v, n = np.repeat(np.arange(300), sizes), int(sizes.sum())
    x, u, fresh, far = r.normal(size=(n, 3)).astype(np.float32), r.permutation(n), r.random(n) < 0.5, np.where(r.random(n) < 0.2, np.inf, r.random(n) * 4)
    table = pa.table({"v": v, "u": u, "vec": pa.array(list(x), pa.list_(pa.float32())), "far": far, "fresh": fresh})
    batches = [b for start in range(0, n, 97) for b in table.slice(start, 97).to_batches()]
    parts = list(neighbours._whole(iter(batches), "v"))
    got = {(a, b): d for p in parts for a, b, d in zip(*(c.to_pylist() for c in neighbours._met(p, k).columns), strict=True)}
    assert sum(map(len, parts)) == n and len(parts) > 5
    want = {}
    for g in range(300):
        own = np.flatnonzero(v == g)
        for i in own:
            d = sorted((float(np.linalg.norm(x[i].astype(float) - x[j])), u[j]) for j in own if j != i and (fresh[i] or fresh[j]))
            want |= {(u[i], b): dist for dist, b in d[:k] if dist < far[i]}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-6 for e in want)


def test_descent_of_repeated_few_and_no_cells(spark):
    x = np.repeat(np.random.default_rng(1).normal(size=(3, 4)), 40, axis=0)
    rows = neighbours.descended(cells(spark, x), 5).collect()
    assert len(rows) == 600 and all(r["dist"] == 0 for r in rows)
    few = neighbours.descended(cells(spark, x[[0, 50, 100]]), 5)
    assert few.count() == 6
    assert neighbours.descended(cells(spark, x).limit(0), 5).count() == 0
    nulls = cells(spark, x[:50]).unionByName(spark.createDataFrame([(None, [0.0] * 4), (99, None)], "cell_id long, vec array<double>"))
    assert {r["src"] for r in neighbours.descended(nulls, 3).collect()} == set(range(50))


def test_exact_neighbours_with_close_ties(spark):
    r = np.random.default_rng(7)
    x = np.repeat(r.normal(size=(30, 6)) * 1000, 3, axis=0) + r.integers(0, 2, (90, 6)) * 1e-5
    got = {(q["src"], q["rank"]): q["dst"] for q in graph.nearest_cells(cells(spark, x), 6, block=16).collect()}
    _, near = plain_nearest(x, 6)
    assert got == {(i, j + 1): int(near[i, j]) for i in range(90) for j in range(6)}


def test_exact_neighbours_shuffle_no_pairs_of_blocks(spark, monkeypatch):
    x, plans, tables = np.random.default_rng(8).normal(size=(600, 5)), [], []

    def seen(frame, *settings):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        tables.append(kept(frame, *settings))
        return tables[-1]

    monkeypatch.setattr(nearest, "kept", seen)
    monkeypatch.setattr(nearest, "TARGETS", 8)
    got = {(q["src"], q["rank"]): q["dst"] for q in graph.nearest_cells(cells(spark, x), 4, block=10).collect()}
    _, near = plain_nearest(x, 4)
    assert got == {(i, j + 1): int(near[i, j]) for i in range(600) for j in range(4)}
    pairs = plans[1][plans[1].index("MapInArrow") :]
    # below the blocks' meeting only the blocks themselves are dealt out, once as sources and once as targets
    assert "CartesianProduct" in pairs and pairs.count("Exchange") == 2 and "Generate" not in pairs and "Join" not in pairs


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e25])
def test_exact_neighbours_of_repeated_and_odd_vectors(spark, scale):
    r = np.random.default_rng(6)
    x = np.concatenate([np.repeat(r.normal(size=(2, 4)), 40, axis=0), r.normal(size=(40, 4))])[r.permutation(120)] * scale
    odd = [(None, [0.0] * 4), (500, None), (501, [0.0, float("nan"), 0.0, 0.0]), (502, [float("inf"), 0.0, 0.0, 0.0]), (503, [None, 0.0, 0.0, 0.0])]
    frame = cells(spark, x).unionByName(spark.createDataFrame(odd, "cell_id long, vec array<double>"))
    got = {(q["src"], q["rank"]): q["dst"] for q in graph.nearest_cells(frame, 5, block=32).collect()}
    d = np.sqrt(np.cumsum((x[:, None] - x[None]) ** 2, axis=2)[:, :, -1])
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert got == {(i, j + 1): int(near[i, j]) for i in range(120) for j in range(5)}
    few = graph.nearest_cells(cells(spark, x[:3]), 5)
    assert few.count() == 6
    assert graph.nearest_cells(cells(spark, x).limit(0), 5).count() == 0


def test_spectrum_of_shared_neighbours_equals_numpy(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(40, 3)) + 4 * c for c in range(3)])
    _, near = plain_nearest(x, 8)
    g = np.zeros((120, 120))
    g[np.repeat(np.arange(120), 8), near.ravel()] = 1
    edges = spark.createDataFrame([(i, int(j)) for i in range(120) for j in near[i]], "src long, dst long")
    out, s = neighbours.shared_spectrum(edges, 3, power=6)
    u, want, _ = np.linalg.svd(g @ g.T)
    assert np.allclose(s, want[:3], rtol=1e-3)
    got = np.zeros((120, 3))
    for q in out.collect():
        got[q["src"]] = q["vec"]
    assert np.allclose(got @ got.T, (u[:, :3] * want[:3] ** 2) @ u[:, :3].T, atol=1e-2 * want[0] ** 2)
    assert ((got**3).sum(axis=0) >= 0).all()


def test_spectrum_keeps_no_tables_of_earlier_rounds(spark, monkeypatch):
    tables, most = [], []

    def seen(frame, *settings):
        tables.append(kept(frame, *settings))
        most.append(sum(Path(t.inputFiles()[0].removeprefix("file://")).exists() for t in tables))
        return tables[-1]

    monkeypatch.setattr(neighbours, "kept", seen)
    edges = spark.createDataFrame([(i, (i + j) % 40) for i in range(40) for j in (1, 2, 5)], "src long, dst long")
    assert neighbours.shared_spectrum(edges, 3)[0].count() == 40
    assert max(most) <= 4  # the edges, two sides and the next one


def test_both_scores_of_batch_mixing(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(60, 4)) + 20 * c for c in range(2)])
    labels = spark.createDataFrame([(i, "a" if i < 60 else "b") for i in range(120)], "cell_id long, batch_id string")
    out = graph.batch_mix_both(cells(spark, x), labels, k=5, wide=8).collect()
    assert len(out) == 120 and all(q["share"] == 1.0 for q in out)
    assert np.mean([q["share_shared"] for q in out]) > 0.9  # one cloud's cells share no neighbours with the other's
    mixed = labels.withColumn("batch_id", F.when(F.col("cell_id") % 2 == 0, "a").otherwise("b"))
    assert 0.3 < np.mean([q["share"] for q in graph.batch_mix_both(cells(spark, x), mixed, k=5, wide=8).collect()]) < 0.7


@pytest.mark.parametrize("of", ["modularity", "shared_neighbours"])
def test_graphs_work_their_edges_out_once(spark, of):
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    ring = spark.createDataFrame([(i, (i + 1) % 40, 1.0) for i in range(40)], "src long, dst long, w double")
    edges = ring.mapInPandas(run, "src long, dst long, w double")
    labels = spark.createDataFrame([(i, i // 20) for i in range(40)], "cell_id long, lab long")
    if of == "modularity":
        assert abs(graph.modularity(edges, labels, "lab").collect()[0][0] - (38 / 40 - 0.5)) < 1e-9
    else:
        assert graph.shared_neighbours(edges).count() == 0
    assert seen.value == 40


@pytest.mark.parametrize("part", [7, 1024])
def test_shared_neighbours_with_hubs(spark, part):
    r = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in zip(r.integers(0, 60, 300), r.integers(0, 40, 300), strict=True)} | {(i, 1000) for i in range(50)} | {(70, j) for j in range(40)}
    frame = spark.createDataFrame(sorted(edges), "src long, dst long").repartition(3)
    of = {}
    for a, b in edges:
        of.setdefault(a, set()).add(b)
    want = {(a, b, len(of[a] & of[b])) for a in of for b in of if a < b and of[a] & of[b]}
    assert {tuple(q) for q in graph.shared_neighbours(frame, part).collect()} == want
