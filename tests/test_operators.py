import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromloom.functions import linalg as la
from chromloom.operators import contacts, graph, model, normalize, quality, sampling, smooth, tensor
from chromloom.sources import files
from chromloom.streaming import increments

ENTRY = "cell_id long, chrom string, row long, col long, v double"


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 6), st.integers(0, 10**6))
def test_polar_is_orthonormal_and_nearest(n, m, seed):
    x = np.random.default_rng(seed).normal(size=(max(n, m), m))
    u = la.polar(x)
    assert np.allclose(u.T @ u, np.eye(m), atol=1e-8)
    assert np.allclose(u.T @ x, (u.T @ x).T, atol=1e-8)
    assert np.allclose(x @ la.inverse_root(x.T @ x)[0], u, atol=1e-5)


def test_polar_without_finite_svd():
    x = np.eye(4)[:, :3].copy()
    x[0, 0] = np.nan
    try:
        u = la.polar(x)
    except np.linalg.LinAlgError:
        pytest.fail("no fallback")
    assert u.shape == (4, 3)


def test_cp_recovers_a_planted_tensor():
    r = np.random.default_rng(3)
    a, b, d = (r.normal(size=(n, 2)) for n in (9, 5, 7))
    y = np.einsum("ir,jr,mr->ijm", a, b, d)
    start = [f + 0.1 * r.normal(size=f.shape) for f in (a, b, d)]
    (p, q, s), losses = la.cp_als(y, start, 60, 0)
    assert losses[-1] < 1e-6 and all(x >= y - 1e-12 for x, y in zip(losses, losses[1:], strict=False))
    assert np.allclose(np.einsum("ir,jr,mr->ijm", p, q, s), y, atol=1e-2)


def test_walk_closed_form():
    r = np.random.default_rng(1)
    a = r.random((6, 6))
    a = a + a.T
    q, out, changes = la.random_walk(a, 5)
    link = 0.75 * a / a.sum(axis=0)
    s2 = a @ a.T
    np.fill_diagonal(s2, 0)
    p = link + 0.25 * s2 / s2.sum(axis=0)
    p = p / p.sum(axis=0)
    want = 0.5 * sum(np.linalg.matrix_power(0.5 * p, j) for j in range(5)) + np.linalg.matrix_power(0.5 * p, 5)
    assert np.allclose(q, want) and np.allclose(out, want @ a) and len(changes) == 5


def maps(spark, seed=0, n=6, cells=3):
    r = np.random.default_rng(seed)
    rows = [(c, "chr1", int(i), int(j), float(r.integers(1, 9))) for c in range(cells) for i in range(n) for j in range(i, n) if r.random() < 0.6]
    return contacts.symmetric(spark.createDataFrame(rows, ENTRY)), spark.createDataFrame([("chr1", n)], "chrom string, n_bin long")


def test_grouped_walk_equals_joined_steps(spark):
    m, bins = maps(spark)
    cells = spark.range(3).withColumnRenamed("id", "cell_id")
    steps = smooth.walk_steps(tensor.dense(m, bins, cells), 3)
    groups = smooth.walk_groups(m, bins, bins.select("chrom", F.lit(3).cast("long").alias("n_steps")))
    key = lambda r: (r["cell_id"], r["row"], r["col"])
    one, two = ({key(r): r["v"] for r in f.collect()} for f in (steps, groups))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one)


def test_stop_rule_takes_the_largest_change(spark):
    changes = spark.createDataFrame([(0, "a", 1, 0.5), (1, "a", 1, 0.001), (0, "a", 2, 0.009), (1, "a", 2, 0.02), (0, "a", 3, 0.001), (1, "a", 3, 0.001), (0, "b", 1, 1.0)], "cell_id long, chrom string, step long, change double")
    assert {tuple(r) for r in smooth.walk_lengths(changes).collect()} == {("a", 2), ("b", 60)}


def test_median_rule_of_quality(spark):
    upper = spark.createDataFrame([(c, "chr1", i, i, 1.0) for c in range(4) for i in range(c)], ENTRY)
    bins = spark.createDataFrame([("chr1", 4)], "chrom string, n_bin long")
    cells = spark.range(4).withColumnRenamed("id", "cell_id")
    got = {r["cell_id"]: r["kept"] for r in quality.cell_quality(upper, cells, bins, 500_000).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True}  # no cell exceeds 3 rows, so the median 1.5 decides


def test_empty_tables(spark):
    none, bins = spark.createDataFrame([], ENTRY), spark.createDataFrame([("chr1", 4)], "chrom string, n_bin long")
    assert normalize.pack(none, bins, 3).count() == 0
    pairs = spark.createDataFrame([], "cell_id long, chrom1 string, pos1 long, chrom2 string, pos2 long, cnt double")
    assert quality.all_cells(pairs).count() == 0 and contacts.upper_map(pairs, 10).count() == 0


def test_thinning_keeps_rates_and_repeats(spark):
    upper = spark.createDataFrame([(c, "chr1", i, i + c % 3, 40.0) for c in range(6) for i in range(30)], ENTRY)
    cells = spark.createDataFrame([(c, "x" if c < 2 else "y") for c in range(6)], "cell_id long, batch_id string")
    capped = sampling.downsample_cells(upper, 600.0).cache()
    totals = [r["s"] for r in capped.groupBy("cell_id").agg(F.sum("v").alias("s")).collect()]
    assert all(480 < s < 720 for s in totals)
    assert capped.exceptAll(sampling.downsample_cells(upper, 600.0)).count() == 0
    thin = sampling.downsample_batches(upper, cells, by_distance=False).groupBy("cell_id").agg(F.sum("v").alias("s")).collect()
    assert all(r["s"] == 1200 for r in thin)  # equal batches stay whole


def test_model_loss_falls_on_planted_structure(spark):
    r = np.random.default_rng(5)
    n, cells, rank = 6, 12, 2
    x = np.einsum("ijr,kr->ijk", r.random((n, n, rank)), r.random((cells, rank)))
    frame = spark.createDataFrame([("chr1", i, j, k, float(x[i, j, k])) for i in range(n) for j in range(n) for k in range(cells)], "chrom string, row long, col long, cell_ord long, v double")
    f = model.fit(frame, {"chr1": n}, cells, {"chr1": 2}, 2, 5)
    assert f.losses[-1] < f.losses[0] and f.losses[-1] < 0.2
    v = np.stack([r["vec"] for r in model.transform(frame, f, {"chr1": n}).orderBy("cell_ord").collect()])
    assert np.allclose(v.T @ v, np.eye(2), atol=1e-6)


@pytest.mark.parametrize("block", [1024, 5])
def test_a_sweep_equals_a_dense_one(spark, monkeypatch, block):
    """With small blocks the sums of several blocks and parts meet."""
    monkeypatch.setattr(model, "BLOCK", block)
    r = np.random.default_rng(8)
    bins, widths, cells, rank = {"chr1": 11, "chr2": 5}, {"chr1": 3, "chr2": 2}, 17, 4
    x = {c: r.random((n, n, cells)) * (r.random((n, n, cells)) < 0.5) for c, n in bins.items()}
    entries = [(c, i, j, k, float(m[i, j, k])) for c, m in x.items() for i, j, k in zip(*map(lambda q: q.tolist(), np.nonzero(m)), strict=True)]
    frame = spark.createDataFrame(entries, "chrom string, row long, col long, cell_ord long, v double")
    v = np.linalg.qr(r.normal(size=(cells, rank)))[0]
    rows = spark.createDataFrame([(k, q.tolist()) for k, q in enumerate(v)], "cell_ord long, vec array<double>")
    f = model.Factors({c: r.random((n, widths[c])) for c, n in bins.items()}, {c: r.random((w, w)) for c, w in widths.items()}, {c: r.random((rank, w)) for c, w in widths.items()}, rows)
    blocks = model.cell_blocks(frame)
    us = model.row_projections(blocks, f, bins)
    got = {q["cell_ord"]: q["vec"] for q in model.cell_scores(blocks, f, bins, f.v, us).collect()}
    y = model.projected(blocks, f, bins, f.v, us)
    s, want = np.zeros((cells, rank)), {c: np.zeros((n, widths[c], rank)) for c, n in bins.items()}
    for c, n in bins.items():
        for i in range(n):
            u, _, vt = np.linalg.svd(x[c][i] @ v @ f.d[c] * f.a[c][i] @ f.b[c].T, full_matrices=False)
            z = x[c][i].T @ (u @ vt)
            s += z @ (f.d[c] * f.a[c][i] @ f.b[c].T).T
            want[c][i] = z.T @ v
    assert np.allclose(np.stack([got[k] for k in range(cells)]), s) and all(np.allclose(y[c], want[c]) for c in bins)
    polar, total = model.orthonormal(model.cell_scores(blocks, f, bins, f.v, us))
    u, values, vt = np.linalg.svd(s, full_matrices=False)
    assert np.allclose(np.stack([q["vec"] for q in polar.orderBy("cell_ord").collect()]), u @ vt) and total == pytest.approx(values.sum())


def test_factors_come_back_from_disk(spark, tmp_path):
    v = spark.createDataFrame([(0, [0.0, 1.0]), (1, [2.0, 3.0])], "cell_ord long, vec array<double>")
    f = model.Factors({"c": np.ones((3, 2))}, {"c": np.eye(2)}, {"c": np.full((4, 2), 0.5)}, v)
    model.save_factors(f, spark, str(tmp_path / "f"))
    back = model.load_factors(spark, str(tmp_path / "f"))
    assert sorted(map(str, back.v.collect())) == sorted(map(str, v.collect())) and all(np.allclose(getattr(back, x)["c"], getattr(f, x)["c"]) for x in "abd")


def test_self_loops_are_refused(spark):
    edges = spark.createDataFrame([(1, 1, 1.0)], "src long, dst long, w double")
    labels = spark.createDataFrame([(1, "x")], "cell_id long, lab string")
    with pytest.raises(ValueError, match="self loops"):
        graph.modularity(edges, labels, "lab")
    with pytest.raises(ValueError, match="no column"):
        graph.batch_mix(labels, labels)


def test_files(spark, tmp_path):
    one = tmp_path / "data.txt"
    one.write_text("cell_name\tcell_id\tchrom1\tpos1\tchrom2\tpos2\tcount\na\t0\tchr1\t5\tchr1\t9000\t2\n")
    assert [tuple(r) for r in files.read_contacts(spark, str(one)).collect()] == [(0, "chr1", 5, "chr1", 9000, 2.0)]
    for i in range(2):
        (tmp_path / f"c{i}.tsv").write_text(f"chrom1\tpos1\tchrom2\tpos2\nchr1\t{i}\tchr1\t7\n")
    (tmp_path / "filelist.txt").write_text(f"{tmp_path}/c1.tsv\n{tmp_path}/c0.tsv\n")
    assert sorted(tuple(r) for r in files.read_contact_files(spark, str(tmp_path / "filelist.txt")).collect()) == [(0, "chr1", 1, "chr1", 7, 1.0), (1, "chr1", 0, "chr1", 7, 1.0)]
    (tmp_path / "sizes.txt").write_text("chr2\t50\nchr1\t90\nchrM\t3\n")
    sizes = files.read_sizes(spark, str(tmp_path / "sizes.txt"), ["chr1", "chr2"])
    assert sorted(tuple(r) for r in contacts.chromosome_bins(sizes, 20).collect()) == [("chr1", 0, 5, 0, 5), ("chr2", 1, 3, 5, 8)]
    (tmp_path / "black.bed").write_text("chr1\t0\t100\n")
    assert files.read_bed(spark, str(tmp_path / "black.bed")).first()["bend"] == 100
    bins = spark.createDataFrame([("chr1", 4)], "chrom string, n_bin long")
    assert files.read_blacklist_bins(spark, str(tmp_path / "nothing"), bins).count() == 0
    (tmp_path / "m.tsv").write_text("x\ta\tb\nr1\t1\t2.5\n")
    assert tuple(files.read_matrix(spark, str(tmp_path / "m.tsv")).first()) == ("r1", 1.0, 2.5)
    (tmp_path / "config.json").write_text('{"chrom_list": ["chr1"], "resolution": 10, "other": 1}')
    config = files.read_config(str(tmp_path / "config.json"))
    assert config.resolution_fh == [10] and config.more == {"other": 1}
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert [files.cached(spark, str(tmp_path / "cache"), {"res": 1, "norm": True}, build).count() for _ in range(2)] == [3, 3] and len(calls) == 1


def test_stream_sums_equal_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "cell_name\tcell_id\tchrom1\tpos1\tchrom2\tpos2\tcount\n"
    for i in range(4):
        (tmp_path / "in" / f"{i}.tsv").write_text(head + "".join(f"x\t{c}\tchr1\t{c * 7}\tchr1\t{9000 + i}\t1\n" for c in range(3)))
    q = increments.accumulate(increments.stream_contacts(spark, str(tmp_path / "in"), 1), 1000, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = {(r["cell_id"], r["row"], r["col"]): r["v"] for r in increments.accumulated_map(spark, str(tmp_path / "out")).collect()}
    assert got == {(c, 0, 9): 4.0 for c in range(3)}


def test_integrity_checks_find_planted_faults(spark):
    from chromloom.operators import contacts as c
    from chromloom.operators import tensor as t

    bins = spark.createDataFrame([("chr1", 4)], "chrom string, n_bin long")
    maps = spark.createDataFrame([(0, "chr1", 0, 1, 2.0), (0, "chr1", 1, 0, 2.0), (0, "chr1", 1, 3, 5.0), (0, "chr1", 3, 1, 4.0), (0, "chr1", 2, 9, 1.0), (0, "chr1", 2, 2, float("nan"))], "cell_id long, chrom string, row long, col long, v double")
    assert c.out_of_range(maps, bins).count() == 4 and c.out_of_range(maps.filter("v = 2 and row = 0"), bins).count() == 0
    assert c.asymmetric(maps.filter("col < 4 and not isnan(v)")).count() > 0 and c.asymmetric(maps.filter("v = 2")).count() == 0
    assert t.bad_entries(maps, {"row": 4, "col": 4}).count() == 2


def test_sorting_points_and_label_and_map_files(spark, tmp_path):
    from chromloom.operators import tensor as t
    from chromloom.sources import files

    maps = spark.createDataFrame([(i % 3, "chr1", (i * 7) % 11, i, float(i)) for i in range(20)], "cell_id long, chrom string, row long, col long, v double")
    assert [x["row"] for x in t.ordered(maps, "row", "col").collect()] == sorted((i * 7) % 11 for i in range(20))
    files.write_maps(maps, f"{tmp_path}/maps")
    assert sorted(map(str, files.read_maps(spark, f"{tmp_path}/maps").select(*maps.columns).collect())) == sorted(map(str, maps.collect()))
    spark.createDataFrame([(0, "T"), (1, "B")], "cell_id long, kind string").write.parquet(f"{tmp_path}/labels")
    assert {x["kind"] for x in files.read_labels(spark, f"{tmp_path}/labels").collect()} == {"T", "B"}
