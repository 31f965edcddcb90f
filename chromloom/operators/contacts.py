"""From contact pairs to contact maps: predicates, blacklist anti-join, binning, maps.

Contacts: cell_id, chrom1, pos1, chrom2, pos2, cnt. Maps are sparse: cell_id, chrom, row, col, v. A map from
upper_map() holds each pair of bins once (row <= col); symmetric() gives both triangles with the diagonal doubled.
Chromosomes become a list of literals and blacklists a broadcast while they have no more than FEW rows, which is counted; larger
ones are joined as any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the tiles by which positions and intervals meet in an equi-join.
TILE = 1_000_000
#: Rows of a dimension table that may ride with the tasks.
FEW = 100_000


def close_contacts(contacts: DataFrame, min_distance: int = 2500) -> DataFrame:
    """Contacts inside one chromosome, at least min_distance apart or at one position."""
    distance = F.abs(F.col("pos2") - F.col("pos1"))
    return contacts.filter((F.col("chrom1") == F.col("chrom2")) & ((distance >= min_distance) | (distance == 0)))


def on_chromosomes(contacts: DataFrame, chroms: DataFrame) -> DataFrame:
    """Contacts whose first chromosome is listed: a predicate, so no contact is shuffled for it."""
    names = [r[0] for r in chroms.select("chrom").limit(FEW // 100 + 1).collect()]
    if len(names) <= FEW // 100:
        return contacts.filter(F.col("chrom1").isin(sorted({n for n in names if n is not None})))
    return contacts.join(chroms.select(F.col("chrom").alias("chrom1")).distinct(), "chrom1", "left_semi").select(*contacts.columns)


def _tiles(blacklist: DataFrame) -> DataFrame:
    last = F.greatest(F.col("bend") - 1, F.col("bstart"))
    return blacklist.select("chrom", "bstart", "bend", F.explode(F.sequence(F.expr(f"bstart div {TILE}"), F.floor(last / TILE))).alias("tile"))


def remove_blacklisted(contacts: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Contacts with neither end in a blacklisted interval [bstart, bend) of its chromosome."""
    out, tiles = contacts, _tiles(blacklist)
    if tiles.limit(FEW + 1).count() <= FEW:
        tiles = F.broadcast(tiles)
    for end in ("1", "2"):
        pos = F.col(f"pos{end}")
        b = tiles.select(*(F.col(c).alias(f"__{c}") for c in tiles.columns))
        hit = (F.col(f"chrom{end}") == F.col("__chrom")) & (F.floor(pos / TILE) == F.col("__tile")) & (pos >= F.col("__bstart")) & (pos < F.col("__bend"))
        out = out.join(b, hit, "left_anti")
    return out


def chromosome_bins(sizes: DataFrame, resolution: int) -> DataFrame:
    """(chrom, ord, n_bin, bin_start, bin_end): bins of each chromosome and their place in the order of ord."""
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    n = sizes.withColumn("n_bin", F.ceil(F.col("size") / resolution).cast("long"))
    n = n.withColumn("bin_start", F.coalesce(F.sum("n_bin").over(before), F.lit(0)).cast("long"))
    return n.select("chrom", "ord", "n_bin", "bin_start", (F.col("bin_start") + F.col("n_bin")).alias("bin_end"))


def bin_of(pos: Column, resolution: int) -> Column:
    return F.floor(pos / resolution).cast("long")


def upper_map(contacts: DataFrame, resolution: int) -> DataFrame:
    """One row for each pair of bins (row <= col) of a cell: v is the sum of cnt. Contacts must lie inside one chromosome."""
    low, high = F.least("pos1", "pos2"), F.greatest("pos1", "pos2")
    return contacts.groupBy("cell_id", F.col("chrom1").alias("chrom"), bin_of(low, resolution).alias("row"), bin_of(high, resolution).alias("col")).agg(F.sum("cnt").cast("double").alias("v"))


def symmetric(upper: DataFrame) -> DataFrame:
    """Both triangles; the diagonal counts twice, as in the sum of a map and its transpose."""
    flipped = upper.filter("row <> col").select(*(F.col({"row": "col", "col": "row"}.get(c, c)).alias(c) for c in upper.columns))
    return upper.withColumn("v", F.when(F.col("row") == F.col("col"), 2 * F.col("v")).otherwise(F.col("v"))).unionByName(flipped)


def out_of_range(upper: DataFrame, bins: DataFrame) -> DataFrame:
    """Entries outside their chromosome's bins, below the diagonal or not positive: none in a sound map."""
    return upper.join(bins.select("chrom", "n_bin"), "chrom").filter("row < 0 or col >= n_bin or row > col or v <= 0 or isnan(v)").select(*upper.columns)


def asymmetric(maps: DataFrame) -> DataFrame:
    """Entries of a symmetric map whose mirror image is missing or different: none in a sound map."""
    mirror = maps.select("cell_id", "chrom", F.col("col").alias("row"), F.col("row").alias("col"), "v")
    return maps.join(mirror, ["cell_id", "chrom", "row", "col", "v"], "left_anti")
