import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom.functions import linalg as la
from chromloom.operators import graph, model, smooth
from chromloom.plans import workflow
from chromloom.sources.files import Config, read_config

ENTRY = "cell_id long, chrom string, row long, col long, v double"


def banded(spark, n=13, cells=3, width=3, seed=4):
    r = np.random.default_rng(seed)
    rows = [(k, "chr1", i, j, float(r.random())) for k in range(cells) for i in range(n) for j in range(n) if abs(i - j) <= width and r.random() < 0.6]
    return spark.createDataFrame(rows, ENTRY), rows


def values(frame):
    return {(r["cell_id"], r["row"], r["col"]): r["v"] for r in frame.collect()}


@pytest.mark.parametrize(("conv", "columns"), [(False, False), (True, False), (True, True)])
def test_one_slice_equals_the_whole_walk(spark, conv, columns):
    maps, _ = banded(spark)
    bins = spark.createDataFrame([("chr1", 13)], "chrom string, n_bin long")
    steps = bins.select("chrom", F.lit(4).cast("long").alias("n_steps"))
    whole = values(smooth.walk_groups(maps, bins, steps, conv, columns))
    one = values(smooth.walk_slices(maps, bins.withColumn("side", F.lit(13).cast("long")), steps, 3, conv, columns))
    assert one.keys() == whole.keys() and all(one[k] == pytest.approx(whole[k], rel=1e-9) for k in one)


@pytest.mark.parametrize("columns", [False, True])
def test_slices_equal_plain_blocks(spark, columns):
    n, side, flank, steps = 13, 5, 3, 4
    maps, rows = banded(spark, n)
    sides = spark.createDataFrame([("chr1", n, side)], "chrom string, n_bin long, side long")
    got = values(smooth.walk_slices(maps, sides, sides.select("chrom", F.lit(steps).cast("long").alias("n_steps")), flank, False, columns))
    want = {}
    for cell in range(3):
        a = np.full((n, n), 1e-8)
        for k, _, i, j, v in rows:
            if k == cell:
                a[i, j] = v
        spans = [(top, min(n, top + side), max(0, top - flank), min(n, top + side + flank)) for top in range(0, n, side)]
        walks = [la.random_walk(a[top:end, left:right], steps, start=top - left) for top, end, left, right in spans]
        cov = np.full(n, 1e-4)
        for (_, _, left, right), (_, out, _) in zip(spans, walks, strict=True):
            cov[left:right] += out.sum(axis=0)
        for (top, end, left, right), (q, out, _) in zip(spans, walks, strict=True):
            if columns:
                q = (q + q.T) / 2
                out = q / q.sum(axis=1, keepdims=True) @ (a[top:end, left:right] / cov[left:right])
            want |= {(cell, top + i, left + j): out[i, j] for i in range(end - top) for j in range(right - left)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-8) for k in want)
    assert len(got) < 3 * n * n


def test_stacked_resolutions_share_the_factors(spark):
    """Two resolutions below one another: the loss falls, A has a row for each bin of both, B and D one for the chromosome."""
    r = np.random.default_rng(2)
    z = r.random((20, 2))
    tensors, bins = {}, {}
    for resolution, n in ((1, 8), (2, 4)):
        x = np.einsum("ijr,kr->ijk", r.random((n, n, 2)), z)
        tensors[resolution] = spark.createDataFrame([("chr1", i, j, k, float(x[i, j, k])) for i in range(n) for j in range(n) for k in range(20)], "chrom string, row long, col long, cell_ord long, v double")
        bins[resolution] = {"chr1": n}
    tensor, columns, heights = model.stacked(tensors, bins)
    assert (columns, heights) == ({"chr1": 8}, {"chr1": 12}) and tensor.agg(F.max("row")).first()[0] == 11
    f = model.fit(tensor, columns, 20, {"chr1": 2}, 2, 5, heights=heights)
    assert f.a["chr1"].shape == (12, 2) and f.b["chr1"].shape == (2, 2) and f.losses[-1] < min(0.25, f.losses[0])
    v = np.stack([x["vec"] for x in f.v.orderBy("cell_ord").collect()])
    q = np.linalg.qr(z)[0]
    assert np.linalg.norm(v - q @ (q.T @ v)) < 0.1


def test_intercept_comes_back(spark):
    r = np.random.default_rng(3)
    x, cov = r.normal(size=(40, 3)) + 5, r.integers(0, 3, 40)
    frame = spark.createDataFrame([(i, x[i].tolist(), f"b{cov[i]}") for i in range(40)], "cell_id long, vec array<double>, batch_id string")
    hot = graph.one_hot(frame, "batch_id", ["b0", "b1", "b2"])
    bare, with_it = (np.stack([q["vec"] for q in graph.regress_out(frame, hot, keep_intercept=k).orderBy("cell_id").collect()]) for k in (False, True))
    means = np.stack([x[cov == b].mean(axis=0) for b in range(3)])
    assert np.allclose(bare, x - means[cov], atol=1e-9)
    # the least slopes for shares p of the groups: the intercept is the plain mean of the group means
    assert np.allclose(with_it - bare, means.mean(axis=0), atol=1e-8)


def test_files_to_embeddings(spark, tmp_path):
    """From tables of text and a config to embeddings, factors on disk and imputed maps."""
    import json

    r = np.random.default_rng(7)
    lines = ["cell_name\tcell_id\tchrom1\tpos1\tchrom2\tpos2\tcount"]
    for cell in range(12):
        for _ in range(80 if cell < 10 else 2):
            chrom, size = [("chr1", 1200), ("chr2", 800)][int(r.integers(2))]
            a = int(r.integers(size))
            lines.append(f"x\t{cell}\t{chrom}\t{a * 10_000}\t{chrom}\t{min(size - 1, a + int(r.integers(300))) * 10_000}\t1")
    (tmp_path / "data.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "sizes.txt").write_text("chr1\t12000000\nchr2\t8000000\n")
    spark.createDataFrame([(i, f"b{i % 2}", float(i)) for i in range(12)], "cell_id long, batch string, depth double").write.parquet(f"{tmp_path}/labels")
    (tmp_path / "config.json").write_text(json.dumps({"chrom_list": ["chr1", "chr2"], "data_dir": str(tmp_path), "resolution": 500_000, "resolution_fh": [500_000, 1_000_000], "genome_reference_path": f"{tmp_path}/sizes.txt", "input_format": "table_v1", "batch_id": "batch", "labels": f"{tmp_path}/labels"}))
    config, settings = read_config(f"{tmp_path}/config.json"), workflow.Settings(off_diag=6, batch_norm=True, conv=True, walk=True)
    found = workflow.read_inputs(spark, config)
    assert workflow.prepare(**found, config=config, settings=settings, meta_only=True).tensors == {}
    data = workflow.prepare(**found, config=config, settings=settings)
    assert data.n_cells == 12 and 0 < data.n_good < 12 and set(data.tensors) == {500_000, 1_000_000}
    f, meta = workflow.run_model(data, settings, rank=4, sweeps=2, path=f"{tmp_path}/out")
    out = workflow.embed(data, f, meta, 3, restore_order=True)
    assert [x["cell_id"] for x in out["embed_raw"].collect()] == list(range(12))
    corrected = workflow.correct_linear(data, out["embed_all"], ["batch", "depth"], 3, add_intercept_back=True)
    assert set(corrected) == {"embed_correct_batch_depth", "embed_l2_norm_correct_batch_depth"} and workflow.correct_linear(data, out["embed_all"], ["none"], 3) is None
    assert all(x.count() == 12 for x in [*out.values(), *corrected.values()])
    name = model.run_name(0.6, 4, 1)
    light, whole = (model.load_factors(spark, f"{tmp_path}/out/{kind}{name}") for kind in ("results", "results_all"))
    assert light.a == {} and set(whole.a) == {"chr1", "chr2"} and np.allclose(light.d["chr1"], whole.d["chr1"])
    maps = workflow.impute(found["contacts"], found["sizes"], config, settings, path=f"{tmp_path}/maps")
    mirror = values(maps.filter("chrom = 'chr1'"))
    assert mirror and all(v == pytest.approx(mirror[k, j, i], rel=1e-9) for (k, i, j), v in mirror.items())


def test_resolutions_must_be_multiples(spark):
    none = spark.createDataFrame([], ENTRY)
    with pytest.raises(ValueError, match="multiple"):
        workflow.packed(none, none, none, Config(["chr1"], resolution=500_000), workflow.Settings(), 750_000)
