import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom import __main__ as cli
from chromloom.operators import model, normalize, tensor
from chromloom.plans import workflow
from chromloom.sources.files import Config

ENTRY = "cell_id long, chrom string, row long, col long, v double"


def some_maps(spark, n=9, cells=3, seed=1):
    r = np.random.default_rng(seed)
    x = np.triu(r.integers(0, 4, (cells, n, n)).astype(float))
    x = x + x.transpose(0, 2, 1)
    rows = [(k, "chr1", int(i), int(j), float(x[k, i, j])) for k in range(cells) for i, j in zip(*np.nonzero(x[k]), strict=True)]
    return spark.createDataFrame(rows, ENTRY), x


@pytest.mark.parametrize("strips", [2, 3, [0, 1, 1, 2, 2, 2, 3, 3, 3], [0, 1, 1, 2]])
def test_strips_of_offsets(spark, strips):
    maps, x = some_maps(spark)
    want = {}
    for k, i, j in zip(*np.nonzero(x), strict=True):
        o = j - i
        if isinstance(strips, int):
            o += strips // 2
            o -= strips % 2 == 0 and o <= 0
            o //= strips
        elif abs(o) < len(strips):
            o = int(np.sign(o)) * strips[abs(o)]
        else:
            continue
        want[k, i, i + o] = want.get((k, i, i + o), 0) + x[k, i, j]
    got = normalize.strip_offsets(maps, strips, "cell_id", "chrom").collect()
    assert {(r["cell_id"], r["row"], r["col"]): r["v"] for r in got} == want


def test_normalisers_are_fitted_on_what_the_ones_before_left(spark):
    maps, x = some_maps(spark)
    bins = spark.createDataFrame([("chr1", 9)], "chrom string, n_bin long")
    steps = [normalize.coverage_normalizer(root=True), normalize.distance_normalizer(bins)]
    got = np.zeros_like(x)
    for r in normalize.normalize_per_cell(maps, steps, [normalize.half_diagonal]).collect():
        got[r["cell_id"], r["row"], r["col"]] = r["v"]

    def coverage(b):
        f = np.sqrt(b.sum(axis=1)) + 1e-15
        return lambda m: m / np.outer(f, f)

    def distance(b):
        e = np.asarray([np.diagonal(b, d).sum() / (9 - d) for d in range(9)]) + 1e-15
        return lambda m: m / e[np.abs(np.subtract.outer(range(9), range(9)))]

    bulk, want = x.sum(axis=0), x.copy()
    for fit in (coverage, distance):
        scaled = fit(bulk)

        def kept_total(m, scaled=scaled):
            return scaled(m) * m.sum() / (scaled(m).sum() + 1e-15)

        bulk, want = kept_total(bulk), np.stack([kept_total(m) for m in want])
    for m in want:
        m[np.diag_indices(9)] /= 2
    assert np.allclose(got, want)


def test_bands_and_masks(spark):
    maps, x = some_maps(spark, n=7, cells=1)
    for off, width in ((2, 5), (10, 7)):
        left = width // 2
        got = {(r["row"], r["offset"]): r["v"] for r in tensor.reformatted(maps, off, 7).collect()}
        assert got == {(i, j - i + left): x[0, i, j] for i in range(7) for j in range(7) if x[0, i, j] and -left <= j - i < (width + 1) // 2}
        mask = {(r["row"], r["offset"]): r["valid"] for r in tensor.validity_mask(spark.range(7).withColumnRenamed("id", "row"), off, 7).collect()}
        assert mask == {(i, o): 0 <= i + o - left < 7 for i in range(7) for o in range(width)}


def contact_rows(seed=5, n=4000):
    r = np.random.default_rng(seed)
    return [(int(k), "chr1", int(a), "chr1", int(a + b), 1.0) for k, a, b in zip(r.integers(0, 8, n), r.integers(0, 900, n), r.integers(0, 90, n), strict=True)]


def test_prepared_tables_are_kept_and_fits_go_on(spark, tmp_path, monkeypatch):
    contacts = spark.createDataFrame(contact_rows(), "cell_id long, chrom1 string, pos1 long, chrom2 string, pos2 long, cnt double")
    contacts = contacts.withColumns({c: F.col(c) * 10_000 for c in ("pos1", "pos2")})
    sizes = spark.createDataFrame([("chr1", 10_000_000, 0)], "chrom string, size long, ord int")
    config, settings = Config(["chr1"], data_dir="x", resolution=1_000_000, resolution_fh=[1_000_000]), workflow.Settings(off_diag=5, strips=2)
    first = workflow.prepare(contacts, sizes, config, settings, cache=f"{tmp_path}/cache")
    with monkeypatch.context() as m:
        for name in ("base_maps", "describe_cells", "tensor_of"):
            m.setattr(workflow, name, None)
        again = workflow.prepare(contacts, sizes, config, settings, cache=f"{tmp_path}/cache")
    assert again.bins == first.bins and (again.n_cells, again.n_good) == (first.n_cells, first.n_good) == (8, first.n_good)
    assert sorted(map(str, again.tensors[1_000_000].collect())) == sorted(map(str, first.tensors[1_000_000].collect()))
    settings.only_good = False
    f, _ = workflow.run_model(again, settings, rank=3, sweeps=2, sizes={"chr1": 2})
    assert f.b["chr1"].shape == (2, 2)
    more, _ = workflow.run_model(again, settings, rank=3, sweeps=1, sizes={"chr1": 2}, start=f)
    assert more.losses[0] <= f.losses[-1] + 1e-6 and f.v.count() == 8  # the start stays as it is
    with pytest.raises(ValueError, match="other widths"):
        model.fit(again.tensors[1_000_000], again.bins[1_000_000], 8, {"chr1": 3}, 3, 1, start=f)


def test_command_line(spark, tmp_path):
    head = "cell_id\tchrom1\tpos1\tchrom2\tpos2\tcount\n"
    (tmp_path / "data.txt").write_text(head + "".join(f"{k}\t{c}\t{a * 10_000}\t{d}\t{b * 10_000}\t1\n" for k, c, a, d, b, _ in contact_rows(6, 1500)))
    (tmp_path / "sizes.txt").write_text("chr1\t10000000\n")
    config = {"chrom_list": ["chr1"], "data_dir": str(tmp_path), "resolution": 1_000_000, "genome_reference_path": f"{tmp_path}/sizes.txt"}
    (tmp_path / "config.json").write_text(json.dumps(config))
    args = [f"{tmp_path}/config.json", f"{tmp_path}/out", "--off-diag", "5", "--rank", "2", "--sweeps", "1", "--all-cells", "--width", "2"]
    cli.main(args, spark)
    raw = spark.read.parquet(f"{tmp_path}/out/embed_raw")
    assert raw.count() == 8 and {len(r["vec"]) for r in raw.collect()} == {2}
    cli.main([f"{tmp_path}/config.json", f"{tmp_path}/maps", "--off-diag", "5", "--impute"], spark)
    assert spark.read.parquet(f"{tmp_path}/maps").filter("row = col").count() > 20
