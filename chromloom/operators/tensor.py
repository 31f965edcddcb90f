"""Long-format sparse tensors: one integer column an axis and a value v. Coordinates are arithmetic, ranges are filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_index(axes: list[str], shape: list[int]) -> Column:
    """Row-major index of the coordinates."""
    out = F.lit(0).cast("long")
    for a, n in zip(axes, shape, strict=True):
        out = out * n + F.col(a)
    return out


def from_linear(index: Column, shape: list[int]) -> list[Column]:
    """The coordinates of a row-major index."""
    out = []
    for n in reversed(shape):
        out.insert(0, F.pmod(index, F.lit(n)).cast("long"))
        index = F.floor(index / n)
    return out


def reshape(tensor: DataFrame, axes: list[str], shape: list[int], new_axes: list[str], new_shape: list[int]) -> DataFrame:
    """One -1 in new_shape stands for what is left."""
    size = 1
    for n in shape:
        size *= n
    known = 1
    for n in new_shape:
        known *= n if n != -1 else 1
    new_shape = [size // known if n == -1 else n for n in new_shape]
    flat = tensor.withColumn("__i", linear_index(axes, shape))
    keep = [c for c in tensor.columns if c not in axes]
    return flat.select(*(c.alias(a) for a, c in zip(new_axes, from_linear(F.col("__i"), new_shape), strict=True)), *keep)


def permute(tensor: DataFrame, axes: list[str], order: list[int]) -> DataFrame:
    """Axis i of the result is axis order[i] of the tensor; names stay with the places."""
    rest = [c for c in tensor.columns if c not in axes]
    return tensor.select(*(F.col(axes[o]).alias(axes[i]) for i, o in enumerate(order)), *rest)


def slice_axis(tensor: DataFrame, axis: str, start: int, stop: int, rebase: bool = True) -> DataFrame:
    out = tensor.filter((F.col(axis) >= start) & (F.col(axis) < stop))
    return out.withColumn(axis, F.col(axis) - start) if rebase else out


def point(tensor: DataFrame, axis: str, at: int) -> DataFrame:
    return tensor.filter(F.col(axis) == at).drop(axis)


def split_axis(tensor: DataFrame, axis: str, breaks: list[int]) -> DataFrame:
    """Adds part: the stretch between breaks that the coordinate is in; the axis counts from the stretch's start."""
    edges = [0, *breaks]
    part, base = F.lit(0), F.lit(0).cast("long")
    for i, e in enumerate(edges):
        part, base = F.when(F.col(axis) >= e, i).otherwise(part), F.when(F.col(axis) >= e, F.lit(e).cast("long")).otherwise(base)
    return tensor.withColumn("part", part.cast("long")).withColumn(axis, F.col(axis) - base)


def tiles(tensor: DataFrame, bin_batch: int, cell_batch: int, n_good: int, flank: int | None = None) -> DataFrame:
    """Adds bin_tile, cell_tile and good: cells below n_good and the rest are cut separately. flank: keep columns near the tile's rows only."""
    good = F.col("cell_ord") < n_good
    out = tensor.withColumn("good", good).withColumn("bin_tile", F.expr(f"row div {bin_batch}"))
    out = out.withColumn("cell_tile", F.when(good, F.expr(f"cell_ord div {cell_batch}")).otherwise(F.expr(f"(cell_ord - {n_good}) div {cell_batch}")))
    if flank is not None:
        low = F.col("bin_tile") * bin_batch - flank
        out = out.filter((F.col("col") >= low) & (F.col("col") < (F.col("bin_tile") + 1) * bin_batch + flank)).withColumn("col", F.col("col") - F.greatest(low, F.lit(0)))
    return out


def remap_ids(tensor: DataFrame, axis: str, mapping: DataFrame) -> DataFrame:
    """mapping: (old, new); coordinates without a new one go."""
    m = mapping.select(F.col("old").alias(axis), F.col("new").alias("__new"))
    return tensor.join(m, axis).withColumn(axis, F.col("__new")).select(*tensor.columns)


def trim(tensor: DataFrame, axes: list[str], low: float, high: float) -> DataFrame:
    """Values in [low, high], equal coordinates summed."""
    return tensor.filter(F.col("v").between(low, high)).groupBy(*axes).agg(F.sum("v").alias("v"))


def top_share(tensor: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Values strictly above the (1 - share) quantile of their group; the quantile is an aggregate joined back."""
    cut = tensor.groupBy(*keys).agg(F.percentile("v", F.lit(1.0 - share)).alias("__cut"))
    return tensor.join(cut, keys).filter("v > __cut").drop("__cut")


def append_rows(tensor: DataFrame, extra: DataFrame, n_rows: int) -> DataFrame:
    """The rows of extra below the n_rows rows of tensor."""
    return tensor.unionByName(extra.withColumn("row", F.col("row") + n_rows).select(*tensor.columns))


def store_upper(maps: DataFrame) -> DataFrame:
    """The upper triangle with half the diagonal, from which mirrored() gives the whole map."""
    return maps.filter("row <= col").withColumn("v", F.when(F.col("row") == F.col("col"), F.col("v") / 2).otherwise(F.col("v")))


def mirrored(upper: DataFrame, *keys: str) -> DataFrame:
    """Entries plus their mirror images, equal coordinates summed."""
    flipped = upper.select(*keys, F.col("col").alias("row"), F.col("row").alias("col"), "v")
    return upper.select(*keys, "row", "col", "v").unionByName(flipped).groupBy(*keys, "row", "col").agg(F.sum("v").alias("v"))


def symmetrized(maps: DataFrame, *keys: str) -> DataFrame:
    """A map plus its transpose, with the diagonal back at its own value."""
    return mirrored(maps, *keys).withColumn("v", F.when(F.col("row") == F.col("col"), F.col("v") / 2).otherwise(F.col("v")))


def dense(maps: DataFrame, bins: DataFrame, cells: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Every (cell_id, chrom, row, col) with its value or the floor. The grid comes from sequences, not from joins of tables."""
    side = F.sequence(F.lit(0).cast("long"), F.col("n_bin") - 1)
    sides = [(r["chrom"], r["n_bin"]) for r in bins.select("chrom", "n_bin").collect() if r["n_bin"]]  # the configured chromosomes
    if not sides:
        return maps.select("cell_id", "chrom", "row", "col", "v").limit(0)
    chroms = F.array(*(F.struct(F.lit(c).alias("chrom"), F.lit(n).cast("long").alias("n_bin")) for c, n in sides))
    grid = cells.select("cell_id", F.explode(chroms).alias("k")).select("cell_id", "k.chrom", "k.n_bin")
    grid = grid.withColumn("row", F.explode(side)).withColumn("col", F.explode(side)).drop("n_bin")
    return grid.join(maps.select("cell_id", "chrom", "row", "col", "v"), ["cell_id", "chrom", "row", "col"], "left").withColumn("v", F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(floor)))


def banded(maps: DataFrame, half_width: int) -> DataFrame:
    """(.., row, offset, v): columns as offsets 0 .. 2 * half_width from row - half_width."""
    off = F.col("col") - F.col("row")
    return maps.filter(F.abs(off) <= half_width).withColumn("offset", off + half_width).drop("col")


def from_banded(rows: DataFrame, half_width: int) -> DataFrame:
    return rows.withColumn("col", F.col("row") + F.col("offset") - half_width).drop("offset")


def reformatted(maps: DataFrame, off_diag: int, n_bins: int, valid: DataFrame | None = None) -> DataFrame:
    """(.., row, offset, v): the band of one chromosome's maps, of 2 * off_diag + 1 columns or n_bins if these are fewer.

    The offset counts from row - half the width. valid: (bin), of which both ends must be; by default all are.
    """
    width = min(2 * off_diag + 1, n_bins)
    left, right = width // 2, (width + 1) // 2
    off, out = F.col("col") - F.col("row"), maps
    for axis in ("row", "col") if valid is not None else ():
        out = out.join(valid.select(F.col("bin").alias(axis)), axis, "left_semi").select(*maps.columns)
    return out.filter((off >= -left) & (off < right)).withColumn("offset", off + left).drop("col")


def validity_mask(rows: DataFrame, off_diag: int, n_bins: int) -> DataFrame:
    """(row, offset, valid) of each place of a band as reformatted() lays it out: whether it is a column of the map; rows: (row)."""
    width = min(2 * off_diag + 1, n_bins)
    left, right = width // 2, (width + 1) // 2
    place = F.col("row") + F.col("offset")
    grid = rows.select(F.col("row").cast("long").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("offset"))
    return grid.withColumn("valid", (place >= left) & (place < n_bins + width - right))


def sliced_strips(maps: DataFrame, strips: int, width: int, start: int = 0) -> DataFrame:
    """(.., row, strip, v): strip k holds the columns row + start + k, for k below strips and columns below width."""
    strip = F.col("col") - F.col("row") - start
    return maps.filter((strip >= 0) & (strip < strips) & (F.col("row") + strip < width)).withColumn("strip", strip).drop("col")


def tilted_strips(rows: DataFrame, strips: int) -> DataFrame:
    """(.., row, col, v) of (.., row, strip, v): columns row + strip; those of strips or more go, as in the square form."""
    return rows.filter(F.col("row") + F.col("strip") < strips).withColumn("col", F.col("row") + F.col("strip")).drop("strip")


def coarsen_offsets(maps: DataFrame, factor: int, *keys: str) -> DataFrame:
    """Offsets col - row in bins of factor around the diagonal, summed; (.., row, offset, v)."""
    off = F.col("col") - F.col("row")
    near = F.floor((F.abs(off) + factor // 2) / factor) * F.signum(off)
    return maps.withColumn("offset", near.cast("long")).groupBy(*keys, "row", "offset").agg(F.sum("v").alias("v"))


def diagonal(maps: DataFrame, k: int) -> DataFrame:
    return maps.filter(F.col("col") - F.col("row") == k)


def frobenius(tensor: DataFrame, *keys: str) -> DataFrame:
    return tensor.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def times_factor(tensor: DataFrame, factor: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    """Contracts an axis with a factor (axis, r, x): (*keys, r, v)."""
    return tensor.join(factor, axis).groupBy(*keys, "r").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def bad_entries(tensor: DataFrame, shape: dict[str, int]) -> DataFrame:
    """Entries outside the shape or without a finite value: none in a sound tensor."""
    wrong = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    for axis, n in shape.items():
        wrong = wrong | (F.col(axis) < 0) | (F.col(axis) >= n)
    return tensor.filter(wrong)


def ordered(tensor: DataFrame, axis: str, *then: str) -> DataFrame:
    """Range-partitioned and sorted by an axis, so that slices of it read few partitions."""
    return tensor.repartitionByRange(axis).sortWithinPartitions(axis, *then)


