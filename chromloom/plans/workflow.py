"""A whole run in one call each: contacts to packed tensors (prepare), tensors to factors and embeddings (run_model, embed),
and smoothed maps without a model (impute). All steps are the operators of this library; what later steps read more than
once is kept in the shared folder.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.operators import contacts as c
from chromloom.operators import graph as g
from chromloom.operators import model as md
from chromloom.operators import normalize as nz
from chromloom.operators import quality as qc
from chromloom.operators import smooth as sm
from chromloom.operators import tensor as t
from chromloom.sources import files
from chromloom.sources.files import Config
from chromloom.sources.shared import kept


@dataclass
class Settings:
    """What a run does with the maps, beside its Config."""

    off_diag: int = 100
    batch_norm: bool = False
    conv: bool = False
    walk: bool = False
    #: Column normalisation in smoothing: True, False, or None for the rule of sparsity.
    columns: bool | None = None
    only_good: bool = True
    #: Offsets that a strip of the packed maps has, or the strip of each absolute offset; 1: none.
    strips: int | list[int] = 1


@dataclass
class Prepared:
    cells: DataFrame  # cell_id, cell_ord, kept, n_unique, log_reads and the labels
    tensors: dict[int, DataFrame]  # by resolution: chrom, row, col, cell_ord, v
    bins: dict[int, dict[str, int]]  # by resolution: bins of each chromosome after compaction
    n_cells: int
    n_good: int


def read_inputs(spark: SparkSession, config: Config) -> dict[str, DataFrame | None]:
    """contacts, sizes, blacklist and labels from the files that the config names; a config without labels has none."""
    if config.input_format == "v1":
        contacts = files.read_contacts(spark, f"{config.data_dir}/data.txt")
    else:
        contacts = files.read_contact_files(spark, f"{config.data_dir}/filelist.txt", config.contact_header or None, config.header_included)
    labels = config.more.get("labels")
    return {
        "contacts": contacts,
        "sizes": files.read_sizes(spark, config.genome_reference_path, config.chrom_list),
        "blacklist": files.read_bed(spark, config.blacklist) if config.blacklist else None,
        "labels": files.read_labels(spark, labels) if labels else None,
    }


def base_maps(contacts: DataFrame, sizes: DataFrame, config: Config, blacklist: DataFrame | None = None) -> DataFrame:
    """The upper maps at the base resolution, kept."""
    near = c.on_chromosomes(c.close_contacts(contacts), sizes)
    return kept(c.upper_map(near if blacklist is None else c.remove_blacklisted(near, blacklist), config.resolution))


def describe_cells(contacts: DataFrame, upper: DataFrame, bins: DataFrame, config: Config, labels: DataFrame | None = None) -> DataFrame:
    """(cell_id, cell_ord, kept, n_unique, log_reads, labels): quality, place in the tensors (good cells first) and labels."""
    quality = kept(qc.cell_quality(upper, qc.all_cells(contacts), bins, config.resolution))
    placed = quality.join(qc.cell_order(quality).select("cell_id", "cell_ord"), "cell_id")
    return kept(qc.with_labels(placed, labels, config.plot_label))


def smoothed(maps: DataFrame, bins: dict[str, int], resolution: int, settings: Settings, columns: bool) -> DataFrame:
    """Packed maps by convolution and walk in slices; each chromosome walks as long as its slowest cell and slice asks for."""
    sides = sm.slice_sides(maps.sparkSession.createDataFrame(list(bins.items()), "chrom string, n_bin long"), resolution)
    lengths = kept(sm.tuned_lengths(maps, sides, settings.off_diag, settings.conv)) if settings.walk else sides.select("chrom", F.lit(0).cast("long").alias("n_steps"))
    return sm.walk_slices(maps, sides, lengths, settings.off_diag, settings.conv, columns and settings.walk)


def packed(upper: DataFrame, cells: DataFrame, sizes_bins: DataFrame, config: Config, settings: Settings, resolution: int, bad_bins: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(packed maps at one resolution, kept; bins of each chromosome)."""
    if resolution % config.resolution:
        raise ValueError(f"{resolution} is no multiple of {config.resolution}")
    maps, by_batch = c.symmetric(upper), settings.batch_norm and config.batch_id in cells.columns
    if by_batch:
        maps = maps.join(cells.select("cell_id", F.col(config.batch_id).cast("string").alias("batch_id")), "cell_id")
    out = kept(nz.pack(maps, sizes_bins, settings.off_diag, resolution // config.resolution, bad_bins, by_batch, settings.strips).select("cell_id", "chrom", "row", "col", "v"))
    return out, {r["chrom"]: int(r["n"]) for r in out.groupBy("chrom").agg((F.max("row") + 1).alias("n")).orderBy("chrom").collect()}


def prepare(contacts: DataFrame, sizes: DataFrame, config: Config, settings: Settings, blacklist: DataFrame | None = None, labels: DataFrame | None = None, bad_bins: DataFrame | None = None, meta_only: bool = False, cache: str | None = None) -> Prepared:
    """Cells and, unless meta_only, one tensor for each resolution of config.resolution_fh, smoothed as the settings say.

    cache: a folder in which the base maps, the cells and the tensors are kept from run to run, each under a name of all
    settings that it depends on; the data set is told by config.data_dir. Without it they are worked out by each run.
    """
    bins = c.chromosome_bins(sizes, config.resolution)
    base, spark = {"config": asdict(config), "blacklist": blacklist is not None}, contacts.sparkSession

    def stored(name: str, more: dict, build: Callable[[], DataFrame]) -> DataFrame:
        if cache is None:
            return build()
        key = hashlib.sha256(json.dumps(base | more, sort_keys=True, default=str).encode()).hexdigest()[:32]
        return files.cached(spark, f"{cache.rstrip('/')}/{name}", {"key": key}, build)

    upper = stored("maps", {}, lambda: base_maps(contacts, sizes, config, blacklist))
    cells = stored("cells", {"labels": labels is not None}, lambda: describe_cells(contacts, upper, bins, config, labels))
    counts = cells.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kept"), 1)).alias("good")).first()
    out = Prepared(cells, {}, {}, counts["n"], counts["good"])
    for resolution in [] if meta_only else config.resolution_fh or [config.resolution]:
        tensor = stored("tensors", {"resolution": resolution, "settings": asdict(settings), "bad bins": bad_bins is not None}, lambda resolution=resolution: tensor_of(upper, cells, bins, config, settings, resolution, bad_bins, out.n_cells))
        # smoothing stays inside the bins, and every bin that packing keeps has entries
        out.bins[resolution] = {r["chrom"]: int(r["n"]) for r in tensor.groupBy("chrom").agg((F.max("row") + 1).alias("n")).orderBy("chrom").collect()}
        out.tensors[resolution] = tensor
    return out


def tensor_of(upper: DataFrame, cells: DataFrame, sizes_bins: DataFrame, config: Config, settings: Settings, resolution: int, bad_bins: DataFrame | None, n_cells: int) -> DataFrame:
    """(chrom, row, col, cell_ord, v): packed and smoothed maps at one resolution, kept."""
    maps, n = packed(upper, cells, sizes_bins, config, settings, resolution, bad_bins)
    columns = settings.columns
    if columns is None:
        dense = sum(k * k for k in n.values()) * max(n_cells, 1)
        columns = nz.normalizes_columns(maps.count() / max(dense, 1), resolution)
    if settings.conv or settings.walk:
        maps = smoothed(maps, n, resolution, settings, columns)
    return kept(maps.join(cells.select("cell_id", "cell_ord"), "cell_id").select("chrom", "row", "col", "cell_ord", "v"))


def run_model(
    data: Prepared, settings: Settings, size_ratio: float = 0.6, rank: int = 256, inner: int = 1, sweeps: int | None = None, tolerance: float = 2e-5, seed: int = 0, path: str | None = None, extra: str = "",
    sizes: dict[str, int] | None = None, start: md.Factors | None = None,
) -> tuple[md.Factors, DataFrame]:
    """(factors, (cell_id, vec) of the meta-embedding of all cells), fitted on the good cells (or all, without only_good).

    Resolutions of a chromosome share B, D and their width, the least that any of them asks for. sweeps: by default one
    for every 15 good cells. sizes: the widths of some chromosomes, in place of the rule's. start: factors of an earlier
    run to go on from. With a path, the factors are written below it, whole and light, under the run's name.
    """
    tensor, columns, heights = md.stacked(data.tensors, data.bins)
    widths: dict[str, int] = {}
    for resolution, bins in data.bins.items():
        for chrom, w in md.ranks(bins, resolution, size_ratio, rank).items():
            widths[chrom] = min(w, widths.get(chrom, w))
    widths |= {chrom: w for chrom, w in (sizes or {}).items() if chrom in widths}
    tensor, n_good = kept(tensor), data.n_good if settings.only_good else data.n_cells
    f = md.fit(tensor, columns, n_good, widths, rank, max(1, n_good // 15) if sweeps is None else sweeps, tolerance, inner, seed, heights, md.pools_of(data.bins), start)
    meta = kept(md.meta_frame(data.cells, md.transform(tensor, f, columns)))
    if path:
        name, spark = md.run_name(size_ratio, rank, inner, extra), tensor.sparkSession
        md.save_factors(f, spark, f"{path.rstrip('/')}/results_all{name}")
        md.save_factors(f, spark, f"{path.rstrip('/')}/results{name}", light=True)
    return f, meta


def embed(data: Prepared, f: md.Factors, meta: DataFrame, width: int, restore_order: bool = False) -> dict[str, DataFrame]:
    """The embeddings (cell_id, cell_ord, vec), sorted by cell_ord, or with restore_order by cell_id, when they are read."""
    out = md.cell_embedding(meta, f, width)
    every = kept(out["embed_all"])
    reads = g.quantile_uniform(data.cells.select("cell_id", "log_reads"), "log_reads")
    out |= {"embed_all": every} | md.corrected_embedding(every.join(reads, "cell_id"), [F.col("log_reads")], width)
    placed = data.cells.select("cell_id", "cell_ord")
    return {k: x.select("cell_id", "vec").join(placed, "cell_id").select("cell_id", "cell_ord", "vec").orderBy("cell_id" if restore_order else "cell_ord") for k, x in out.items()}


def correct_linear(data: Prepared, every: DataFrame, names: list[str], width: int, add_intercept_back: bool = False) -> dict[str, DataFrame] | None:
    """embed_all without its fit on columns of the cells (floats as they are, others one-hot); None if a column is missing."""
    if any(n not in data.cells.columns for n in names):
        return None
    both, covariates = every.select("cell_id", "vec").join(data.cells.select("cell_id", *names), "cell_id"), []
    for n in names:
        if dict(both.dtypes)[n] in ("float", "double"):
            covariates.append(F.col(n))
        else:
            covariates += g.one_hot(both, n, [r[0] for r in both.select(n).distinct().collect() if r[0] is not None])
    return md.corrected_embedding(both, covariates, width, "_".join(names), add_intercept_back)


def impute(contacts: DataFrame, sizes: DataFrame, config: Config, settings: Settings, blacklist: DataFrame | None = None, bad_bins: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """(cell_id, chrom, row, col, v) of all cells, smoothed in slices at the first resolution and symmetrised, without a model.

    The walk takes one step more than the stop rule counts, and columns are not normalised. With a path, one folder a
    chromosome is written.
    """
    bins = c.chromosome_bins(sizes, config.resolution)
    upper = base_maps(contacts, sizes, config, blacklist)
    resolution = (config.resolution_fh or [config.resolution])[0]
    maps, n = packed(upper, qc.all_cells(contacts), bins, config, settings, resolution, bad_bins)
    sides = sm.slice_sides(maps.sparkSession.createDataFrame(list(n.items()), "chrom string, n_bin long"), resolution)
    steps = sm.tuned_lengths(maps, sides, settings.off_diag, settings.conv).select("chrom", F.least(F.col("n_steps") + 1, F.lit(60)).cast("long").alias("n_steps")) if settings.walk else sides.select("chrom", F.lit(0).cast("long").alias("n_steps"))
    out = t.symmetrized(sm.walk_slices(maps, sides, kept(steps), settings.off_diag, settings.conv), "cell_id", "chrom")
    if path:
        files.write_maps(out, path)
        return files.read_maps(maps.sparkSession, path)
    return out
