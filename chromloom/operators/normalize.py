"""Normalisation of sparse maps (cell_id, chrom, row, col, v; both triangles), each step a DataFrame of the next.

Bulk sums, coverages and shares are aggregates by chromosome, batch, bin or distance: they have at most bins^2 or bins rows
a chromosome whatever the number of cells, and are joined back to the entries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromloom.operators.ranks import group_ranks

EPS = 1e-15


def drop_bins(maps: DataFrame, bad: DataFrame) -> DataFrame:
    """Without the rows and columns of the bins listed in bad (chrom, bin)."""
    out = maps
    for axis in ("row", "col"):
        b = bad.select(F.col("chrom").alias("__chrom"), F.col("bin").alias("__bin")).distinct()
        out = out.join(b, (F.col("chrom") == F.col("__chrom")) & (F.col(axis) == F.col("__bin")), "left_anti")
    return out


def coarsen(maps: DataFrame, factor: int, keys: tuple[str, ...] = ("cell_id", "chrom")) -> DataFrame:
    """Bins of factor times the width; equal coordinates are summed."""
    return maps.groupBy(*keys, F.expr(f"row div {factor}").alias("row"), F.expr(f"col div {factor}").alias("col")).agg(F.sum("v").alias("v"))


def band(maps: DataFrame, off_diag: int) -> DataFrame:
    return maps.filter(F.abs(F.col("col") - F.col("row")) <= off_diag)


def merge_duplicates(maps: DataFrame, *keys: str) -> DataFrame:
    return maps.groupBy(*keys).agg(F.sum("v").alias("v"))


def bulk(maps: DataFrame, *by: str) -> DataFrame:
    """(chrom, *by, row, col, v): the sum over cells."""
    return maps.groupBy("chrom", *by, "row", "col").agg(F.sum("v").alias("v"))


def bulk_mean(maps: DataFrame, n_cells: int) -> DataFrame:
    """The sum over cells by the number of all cells, with or without the entry."""
    return bulk(maps).withColumn("v", F.col("v") / n_cells)


def coverage(sums: DataFrame, *by: str) -> DataFrame:
    """(chrom, *by, bin, cov): row sums of a bulk map."""
    return sums.groupBy("chrom", *by, F.col("row").alias("bin")).agg(F.sum("v").alias("cov"))


def compact_bins(sums: DataFrame, min_cov: float = 0.0) -> DataFrame:
    """(chrom, bin, new_bin): bins with more coverage than min_cov, renumbered from 0 in each chromosome."""
    kept = coverage(sums).filter(F.col("cov") > min_cov)
    return kept.select("chrom", "bin", (F.row_number().over(Window.partitionBy("chrom").orderBy("bin")) - 1).cast("long").alias("new_bin"))


def remap(maps: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entries by their new bins; those of dropped bins go."""
    out = maps
    for axis in ("row", "col"):
        out = out.join(mapping.select("chrom", F.col("bin").alias(axis), F.col("new_bin").alias(f"__{axis}")), ["chrom", axis]).withColumn(axis, F.col(f"__{axis}")).drop(f"__{axis}")
    return out.select(*maps.columns)


def distance_shares(sums: DataFrame, off_diag: int, eps_total: float, *by: str) -> DataFrame:
    """(chrom, *by, d, share): share of the coverage-balanced map on diagonal d, off-diagonals counted twice."""
    cov = coverage(sums, *by)
    keys = ["chrom", *by]
    h = sums.join(cov.withColumnsRenamed({"bin": "row", "cov": "ci"}), [*keys, "row"]).join(cov.withColumnsRenamed({"bin": "col", "cov": "cj"}), [*keys, "col"])
    h = h.withColumn("h", F.col("v") / ((F.sqrt("cj") + EPS) * (F.sqrt("ci") + EPS)))
    total = h.groupBy(*keys).agg(F.sum("h").alias("total"))
    by_distance = h.filter(f"col >= row and col - row <= {off_diag}").groupBy(*keys, (F.col("col") - F.col("row")).alias("d")).agg(F.sum("h").alias("s"))
    weight = F.when(F.col("d") == 0, 1.0).otherwise(2.0)
    return by_distance.join(total, keys).select(*keys, "d", (weight * F.col("s") / (F.col("total") + eps_total)).alias("share"))


def batch_normalize(maps: DataFrame, off_diag: int) -> DataFrame:
    """maps (with batch_id) with each batch's coverage and distance profile brought to those of the bulk."""
    sums, own = bulk(maps), bulk(maps, "batch_id")
    ratio = distance_shares(own, off_diag, EPS, "batch_id").join(distance_shares(sums, off_diag, 0.0).withColumnRenamed("share", "bulk_share"), ["chrom", "d"], "left")
    ratio = ratio.select("chrom", "batch_id", "d", (F.col("share") / (F.coalesce("bulk_share", F.lit(0.0)) + EPS)).alias("q"))
    cov, own_cov = coverage(sums), coverage(own, "batch_id")
    out = maps.withColumn("d", F.abs(F.col("col") - F.col("row")))
    for axis in ("row", "col"):
        out = out.join(own_cov.select("chrom", "batch_id", F.col("bin").alias(axis), F.sqrt("cov").alias(f"b_{axis}")), ["chrom", "batch_id", axis])
        out = out.join(cov.select("chrom", F.col("bin").alias(axis), F.sqrt("cov").alias(f"c_{axis}")), ["chrom", axis])
    out = out.join(ratio, ["chrom", "batch_id", "d"])
    return out.withColumn("v", F.col("v") / (F.col("b_row") * F.col("b_col")) * F.col("c_row") * F.col("c_col") / (F.col("q") + EPS)).select(*maps.columns)


def depth_normalize(maps: DataFrame, n_bins: DataFrame) -> DataFrame:
    """v * bins / sum of v over the cell's chromosome; n_bins: (chrom, n). The window holds one map of one cell."""
    total = F.sum("v").over(Window.partitionBy("chrom", "cell_id"))
    return maps.join(n_bins.select("chrom", F.col("n").alias("__n")), "chrom").withColumn("v", F.col("v") * F.col("__n") / (total + EPS)).select(*maps.columns)


def log_clip(maps: DataFrame, deviations: float = 15.0) -> DataFrame:
    """ln(1 + v), then at most mean + deviations * population standard deviation of the chromosome's entries."""
    logs = maps.withColumn("v", F.log1p("v"))
    limits = logs.groupBy("chrom").agg((F.avg("v") + deviations * F.stddev_pop("v")).alias("__limit"))
    return logs.join(limits, "chrom").withColumn("v", F.least("v", "__limit")).select(*maps.columns)


def strip_offsets(maps: DataFrame, strips: int | list[int], *keys: str) -> DataFrame:
    """maps with their offsets col - row in strips, coordinates that fall together summed; col is row + the strip's number.

    strips: a number of offsets that a strip has (centred on the diagonal), or a table of the strip of each absolute offset,
    which keeps the sign; entries beyond the table's end go.
    """
    off = F.col("col") - F.col("row")
    if isinstance(strips, int):
        near = F.floor((F.abs(off) + strips // 2) / strips)
    else:
        near = F.get(F.array(*(F.lit(int(x)) for x in strips)), F.abs(off).cast("int"))
    placed = maps.withColumn("col", F.col("row") + (near * F.signum(off)).cast("long")).filter(F.col("col").isNotNull())
    return placed.groupBy(*keys, "row", "col").agg(F.sum("v").alias("v"))


def pack(maps: DataFrame, bins: DataFrame, off_diag: int, factor: int = 1, bad_bins: DataFrame | None = None, batch_norm: bool = False, strips: int | list[int] = 1) -> DataFrame:
    """The packed tensor of maps (cell_id, chrom, row, col, v and, for batch_norm, batch_id); bins: (chrom, n_bin).

    Order: blacklisted bins, coarsening, band, bulk, valid bins, batch and depth normalisation, compaction, strips of offsets
    (see strip_offsets; 1: none), ln(1 + v), clip.
    """
    keys = ("cell_id", "chrom", *(("batch_id",) if "batch_id" in maps.columns else ()))
    out = drop_bins(maps, bad_bins) if bad_bins is not None else maps
    out = band(coarsen(out, factor, keys) if factor > 1 else out, off_diag)
    mapping = compact_bins(bulk(out))
    if batch_norm:
        out = batch_normalize(out, off_diag)
    out = depth_normalize(out, bins.select("chrom", F.ceil(F.col("n_bin") / factor).alias("n")))
    out = remap(out, mapping)
    return log_clip(out if strips == 1 else strip_offsets(out, strips, *keys))


def sparsity(maps: DataFrame, bins: DataFrame, n_cells: int) -> DataFrame:
    """(n_stored, n_dense, share): stored entries over all bins^2 * cells of the chromosomes."""
    stored = maps.agg(F.count(F.lit(1)).alias("n_stored"))
    dense = bins.agg((F.sum(F.col("n_bin") * F.col("n_bin")) * n_cells).cast("long").alias("n_dense"))
    return stored.join(F.broadcast(dense)).select("n_stored", "n_dense", (F.col("n_stored") / F.col("n_dense")).alias("share"))


def normalizes_columns(share: float, resolution: int) -> bool:
    """The rule for column normalisation in smoothing."""
    return share * (500_000 / resolution) ** 2 <= 0.03


# --- further normalisers of single maps ---------------------------------------------------------------------------


def expected_by_distance(maps: DataFrame, bins: DataFrame, *keys: str) -> DataFrame:
    """(*keys, d, expected): mean of each diagonal, zeros included. Keys must hold chrom."""
    upper = maps.filter("col >= row").join(bins.select("chrom", F.col("n_bin").alias("__n")), "chrom")
    return upper.groupBy(*keys, (F.col("col") - F.col("row")).alias("d"), "__n").agg(F.sum("v").alias("s")).select(*keys, "d", (F.col("s") / (F.col("__n") - F.col("d"))).alias("expected"))


def observed_over_expected(maps: DataFrame, bins: DataFrame, *keys: str) -> DataFrame:
    expected = expected_by_distance(maps, bins, *keys)
    out = maps.withColumn("d", F.abs(F.col("col") - F.col("row"))).join(expected, [*keys, "d"], "left")
    return out.withColumn("v", F.when(F.coalesce("expected", F.lit(0.0)) == 0, 0.0).otherwise(F.col("v") / F.col("expected"))).select(*maps.columns)


def _rescaled(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """after with the totals of before."""
    totals = before.groupBy(*keys).agg(F.sum("v").alias("__was"))
    now = after.groupBy(*keys).agg(F.sum("v").alias("__is"))
    return after.join(totals, list(keys)).join(now, list(keys)).withColumn("v", F.col("v") * F.col("__was") / (F.col("__is") + EPS)).select(*after.columns)


def coverage_normalizer(root: bool = False) -> Callable[[DataFrame], Callable[..., DataFrame]]:
    """A normaliser for normalize_per_cell(): divides by the bulk's row sums (root: their square roots) at both ends and keeps totals."""

    def fit(sums: DataFrame) -> Callable[..., DataFrame]:
        cov = coverage(sums).withColumn("f", (F.sqrt("cov") if root else F.col("cov")) + EPS)

        def apply(maps: DataFrame, *keys: str) -> DataFrame:
            out = maps
            for axis in ("row", "col"):
                out = out.join(cov.select("chrom", F.col("bin").alias(axis), F.col("f").alias(f"__{axis}")), ["chrom", axis])
            return _rescaled(maps, out.withColumn("v", F.col("v") / (F.col("__row") * F.col("__col"))).select(*maps.columns), *keys)

        return apply

    return fit


def distance_normalizer(bins: DataFrame) -> Callable[[DataFrame], Callable[..., DataFrame]]:
    """A normaliser for normalize_per_cell(): divides by the bulk's expectation at the distance and keeps totals."""

    def fit(sums: DataFrame) -> Callable[..., DataFrame]:
        expected = expected_by_distance(sums, bins, "chrom")

        def apply(maps: DataFrame, *keys: str) -> DataFrame:
            out = maps.withColumn("d", F.abs(F.col("col") - F.col("row"))).join(expected, ["chrom", "d"])
            return _rescaled(maps, out.withColumn("v", F.col("v") / (F.col("expected") + EPS)).select(*maps.columns), *keys)

        return apply

    return fit


def normalize_per_cell(
    maps: DataFrame, normalizers: Sequence[Callable[[DataFrame], Callable[..., DataFrame]]] = (), functions: Sequence[Callable[[DataFrame], DataFrame]] = (), sums: DataFrame | None = None
) -> DataFrame:
    """maps (cell_id, chrom, row, col, v) through the normalisers, one after the other, then through the functions.

    Each normaliser is fitted on the bulk map as the ones before it left that (sums; by default the sum of maps), and applied
    to it and to every cell's maps. A function takes and returns maps.
    """
    sums = bulk(maps) if sums is None else sums
    for fit in normalizers:
        apply = fit(sums)
        maps, sums = apply(maps, "cell_id", "chrom"), apply(sums, "chrom")
    for f in functions:
        maps = f(maps)
    return maps


def vanilla_coverage(maps: DataFrame, root: bool = False, *keys: str) -> DataFrame:
    """Divides by the bulk's row sums (root: their square roots) at both ends and keeps each map's total."""
    return coverage_normalizer(root)(bulk(maps))(maps, *(keys or ("cell_id", "chrom")))


def distance_normalize(maps: DataFrame, bins: DataFrame) -> DataFrame:
    """Divides by the bulk's expectation at the distance and keeps each map's total."""
    return distance_normalizer(bins)(bulk(maps))(maps, "cell_id", "chrom")


def clip_above(maps: DataFrame, by: tuple[str, ...] = ("chrom", "row", "col"), deviations: float = 1.0) -> DataFrame:
    """At most mean + deviations * population standard deviation over the stored values with the same keys."""
    limits = maps.groupBy(*by).agg((F.avg("v") + deviations * F.stddev_pop("v")).alias("__limit"))
    return maps.join(limits, list(by)).withColumn("v", F.least("v", "__limit")).select(*maps.columns)


def half_diagonal(maps: DataFrame) -> DataFrame:
    return maps.withColumn("v", F.when(F.col("row") == F.col("col"), F.col("v") / 2).otherwise(F.col("v")))


def zero_diagonal(maps: DataFrame) -> DataFrame:
    return maps.withColumn("v", F.when(F.col("row") == F.col("col"), 0.0).otherwise(F.col("v")))


def center_groups(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """value minus its mean in the group: an aggregate joined back, so that large groups stay spread out."""
    means = frame.groupBy(*by).agg(F.avg(value).alias("__mean"))
    return frame.join(means, list(by)).withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")


def quantile_normalize(frame: DataFrame, group: str, column: str, item: str, value: str) -> DataFrame:
    """frame (group, column, item, value) with each value replaced by the mean, over columns, of the values at its rank.

    Means are taken by first-come ranks (ties in the order of item); a tied value gets the mean of its smallest rank. Ranks come
    from sorted ranges, so no task holds a whole column. Rows with a null in these columns are left out.
    """
    ranked = group_ranks(frame, [group, column], [value, item], name="__first")
    least = ranked.groupBy(group, column, value).agg(F.min("__first").alias("__least"))
    means = ranked.groupBy(group, F.col("__first").alias("__least")).agg(F.avg(value).alias("__mean"))
    return ranked.join(least, [group, column, value]).join(means, [group, "__least"]).withColumn(value, F.col("__mean")).select(*frame.columns)


def scale_column_batches(maps: DataFrame, cells: DataFrame) -> DataFrame:
    """Scales column bins of each batch to the mean of the batches' column means; cells: (cell_id, batch_id), all of them."""
    size = cells.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    means = maps.groupBy("chrom", "batch_id", "col").agg(F.sum("v").alias("s")).join(size, "batch_id").withColumn("m", F.col("s") / F.col("n"))
    n_batches = size.agg(F.count(F.lit(1)).alias("b"))
    overall = means.groupBy("chrom", "col").agg(F.sum("m").alias("total")).join(F.broadcast(n_batches)).select("chrom", "col", (F.col("total") / F.col("b")).alias("overall"))
    factor = means.join(overall, ["chrom", "col"]).select("chrom", "batch_id", "col", (F.col("overall") / (F.col("m") + EPS)).alias("__f"))
    return maps.join(factor, ["chrom", "batch_id", "col"]).withColumn("v", F.col("v") * F.col("__f")).select(*maps.columns)
