"""Runs the whole workflow from the command line: `spark-submit` this package, or `python -m chromloom CONFIG OUT [options]`.

CONFIG is the JSON file of a run (see sources.files.Config); OUT the folder that the embeddings, or the imputed maps, go to.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from chromloom.plans import workflow as wf
from chromloom.sources.files import read_blacklist_bins, read_config
from chromloom.sources.ship import ship_package


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="chromloom", description=__doc__)
    p.add_argument("config")
    p.add_argument("out")
    p.add_argument("--off-diag", type=int, default=100, help="width of the band in bins")
    p.add_argument("--strips", type=int, default=1, help="offsets of a strip of the packed maps")
    p.add_argument("--batch-norm", action="store_true", help="normalise batches to the bulk")
    p.add_argument("--conv", action="store_true", help="smooth by convolution")
    p.add_argument("--walk", action="store_true", help="smooth by random walks with restart")
    p.add_argument("--columns", choices=["auto", "yes", "no"], default="auto", help="normalise columns in smoothing")
    p.add_argument("--all-cells", action="store_true", help="fit on cells of low quality too")
    p.add_argument("--size-ratio", type=float, default=0.6)
    p.add_argument("--rank", type=int, default=256)
    p.add_argument("--inner", type=int, default=1, help="sweeps over a projected tensor")
    p.add_argument("--sweeps", type=int, help="sweeps of the fit at most")
    p.add_argument("--tolerance", type=float, default=2e-5)
    p.add_argument("--width", type=int, help="width of the embeddings; the rank by default")
    p.add_argument("--bad-bins", help="Parquet table (chrom, bin) of bins to leave out")
    p.add_argument("--cache", help="folder in which prepared tables are kept from run to run")
    p.add_argument("--model", help="folder that the factors are written to")
    p.add_argument("--impute", action="store_true", help="write smoothed maps and fit no model")
    p.add_argument("--cell-order", choices=["tensor", "given"], default="given", help="order of the embeddings' rows")
    return p.parse_args(args)


def settings_of(o: argparse.Namespace) -> wf.Settings:
    columns = {"auto": None, "yes": True, "no": False}[o.columns]
    return wf.Settings(o.off_diag, o.batch_norm, o.conv, o.walk, columns, not o.all_cells, o.strips)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = options(args)
    spark = ship_package(spark or SparkSession.builder.appName("chromloom").getOrCreate())
    config, settings = read_config(o.config), settings_of(o)
    given = wf.read_inputs(spark, config)
    bad = read_blacklist_bins(spark, o.bad_bins, wf.c.chromosome_bins(given["sizes"], config.resolution)) if o.bad_bins else None
    if o.impute:
        wf.impute(given["contacts"], given["sizes"], config, settings, given["blacklist"], bad, o.out)
        return
    data = wf.prepare(given["contacts"], given["sizes"], config, settings, given["blacklist"], given["labels"], bad, cache=o.cache)
    f, meta = wf.run_model(data, settings, o.size_ratio, o.rank, o.inner, o.sweeps, o.tolerance, path=o.model)
    for name, frame in wf.embed(data, f, meta, o.width or o.rank, restore_order=o.cell_order == "given").items():
        frame.write.mode("overwrite").parquet(f"{o.out.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
