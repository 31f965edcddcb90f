import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom.operators import graph, quality, ranks, sampling
from chromloom.streaming import increments


def test_ranks_and_quantiles_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = np.random.default_rng(2)
        rows = [(g, i, float(x)) for g, n in (("a", 500), ("b", 1), ("c", 37)) for i, x in enumerate(np.round(r.normal(size=n), 1))]
        frame = spark.createDataFrame([*rows, ("d", 0, None)], "g string, i long, x double").repartition(5)
        got = {(q["g"], q["i"]): q["rank"] for q in ranks.group_ranks(frame.filter("x is not null"), ["g"], ["x", "i"]).collect()}
        for g in "abc":
            own = sorted((x, i) for h, i, x in rows if h == g)
            assert [got[g, i] for _, i in own] == list(range(len(own)))
        grid = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
        found = {(q["g"], q["q"]): q["x"] for q in ranks.exact_quantiles(frame, ["g"], "x", grid).collect()}
        assert len(found) == 18
        for g in "abc":
            assert np.allclose([found[g, i] for i in range(6)], np.quantile([x for h, _, x in rows if h == g], grid))
        order = quality.cell_order(spark.createDataFrame([(i, i % 3 > 0) for i in range(100)], "cell_id long, kept boolean").repartition(7)).collect()
        want = sorted(range(100), key=lambda i: (i % 3 == 0, i))
        assert [x["cell_id"] for x in sorted(order, key=lambda x: x["cell_ord"])] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_components_become_uniform(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 5)), 1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "cell_id long, vec array<double>").repartition(3)
    got = {q["cell_id"]: q["vec"] for q in graph.quantile_uniform_vectors(frame, n_quantiles=21).collect()}
    assert got[300] is None
    flat = frame.filter("cell_id < 300").select("cell_id", *(F.col("vec")[i].alias(f"x{i}") for i in range(5)))
    for i in range(5):
        one = {q["cell_id"]: q["x"] for q in graph.quantile_uniform(flat.select("cell_id", F.col(f"x{i}").alias("x")), "x", 21).collect()}
        assert all(got[k][i] == pytest.approx(one[k]) for k in one)
    assert graph.quantile_uniform_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "p"), [(1, 0.3), (5, 0.5), (30, 0.05), (25, 0.42), (40, 0.9), (1000, 0.3), (10**6, 0.4), (10**6, 0.999)])
def test_binomial_draws_fit_their_distribution(n, p):
    keys = np.random.default_rng(n).integers(0, 2**64, 40_000, np.uint64)
    draws = sampling.binomial(np.full(40_000, n), np.full(40_000, p), keys)
    assert (draws == sampling.binomial(np.full(40_000, n), np.full(40_000, p), keys)).all()
    assert draws.min() >= 0 and draws.max() <= n and (draws == np.floor(draws)).all()
    sd = math.sqrt(n * p * (1 - p))
    low, high = max(0, math.floor(n * p - 6 * sd)), min(n, math.ceil(n * p + 6 * sd))
    k = np.arange(low, high + 1)
    log = np.asarray([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in k]) + k * math.log(p) + (n - k) * math.log1p(-p)
    # neighbouring values together until each class expects 20 draws or more
    cells, want, seen = [], [], 0.0
    for j, mass in zip(k, np.exp(log), strict=True):
        seen += mass * 40_000
        if seen >= 20:
            cells.append(j)
            want.append(seen)
            seen = 0.0
    want[-1] += seen
    counts = np.bincount(np.minimum(np.searchsorted(cells, draws), len(cells) - 1), minlength=len(cells))
    chi, free = float(((counts - want) ** 2 / want).sum()), len(cells) - 1
    assert chi < free + 5 * math.sqrt(2 * max(free, 1)) + 5


def test_edge_cases_of_draws():
    key = np.arange(6, dtype=np.uint64)
    assert sampling.binomial(np.asarray([0, 7, 7, np.nan, -3, 2.9]), np.asarray([0.5, 0, 1, 0.5, 0.5, 1]), key).tolist() == [0, 0, 7, 0, 0, 2]
    assert len(sampling.binomial(np.zeros(0), np.zeros(0), key[:0])) == 0


def entries(spark, rows):
    return spark.createDataFrame(rows, increments.MAP)


def test_batches_count_once_and_files_stay_few(spark, tmp_path):
    r = np.random.default_rng(1)
    folder = increments.MapFolder(spark, f"{tmp_path}/map")
    assert increments.accumulated_map(spark, folder.path).count() == 0
    total: dict[tuple, float] = {}
    for n in range(11):
        rows = [(int(a), f"chr{b}", int(i), int(i) + 1, float(v)) for a, b, i, v in zip(r.integers(0, 9, 40), r.integers(1, 3, 40), r.integers(0, 5, 40), r.integers(1, 9, 40), strict=True)]
        for k in rows:
            total[k[:4]] = total.get(k[:4], 0) + k[4]
        increments.merge_batch(folder, entries(spark, rows), n, buckets=4, merge=3)
        if n in (1, 5):  # run again after it counted
            increments.merge_batch(folder, entries(spark, rows), n, buckets=4, merge=3)
    assert {tuple(x)[:4]: x["v"] for x in increments.accumulated_map(spark, folder.path).collect()} == total
    assert len(list((tmp_path / "map").rglob("part-*.parquet"))) <= 2 * 4 + 2 * 3 * 4 and folder.live().batch == 10


def test_a_failed_batch_leaves_the_map_as_it_was(spark, tmp_path, monkeypatch):
    folder = increments.MapFolder(spark, f"{tmp_path}/map")
    for n in range(2):
        increments.merge_batch(folder, entries(spark, [(1, "chr1", n, n, 1.0), (2, "chr1", 0, 0, 1.0)]), n, buckets=2, merge=3)
    before = sorted(map(tuple, increments.accumulated_map(spark, folder.path).collect()))
    batch = entries(spark, [(2, "chr1", 0, 0, 5.0)])
    with monkeypatch.context() as m:
        m.setattr(increments.MapFolder, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            increments.merge_batch(folder, batch, 2, buckets=2, merge=3)
    assert sorted(map(tuple, increments.accumulated_map(spark, folder.path).collect())) == before
    increments.merge_batch(folder, batch, 2, buckets=2, merge=3)
    after = {tuple(x)[:4]: x["v"] for x in increments.accumulated_map(spark, folder.path).collect()}
    assert after == {(1, "chr1", 0, 0): 1.0, (1, "chr1", 1, 1): 1.0, (2, "chr1", 0, 0): 7.0} and folder.live().deltas == []
