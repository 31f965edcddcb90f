"""Quality of cells, and their order in a tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromloom.operators.ranks import numbered


def all_cells(contacts: DataFrame) -> DataFrame:
    """Cells 0 .. the largest id, with or without contacts."""
    top = contacts.agg(F.max("cell_id")).first()[0]
    return contacts.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("cell_id"))


def row_thresholds(upper: DataFrame, bins: DataFrame, resolution: int) -> DataFrame:
    """(chrom, threshold): rows of the summed map with more than 0.1 * bins * int(1e6 / resolution) partners."""
    pairs = upper.groupBy("chrom", "row", "col").agg(F.sum("v").alias("v")).filter("v > 0").select("chrom", "row", "col")
    both = pairs.unionByName(pairs.filter("row <> col").select("chrom", F.col("col").alias("row"), F.col("row").alias("col")))
    partners = both.groupBy("chrom", "row").agg(F.count(F.lit(1)).alias("n")).join(bins.select("chrom", "n_bin"), "chrom")
    wide = partners.filter(F.col("n") > 0.1 * F.col("n_bin") * int(1e6 / resolution)).groupBy("chrom").agg(F.count(F.lit(1)).alias("threshold"))
    return bins.select("chrom").join(wide, "chrom", "left").select("chrom", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def chromosome_quality(upper: DataFrame, cells: DataFrame, bins: DataFrame, resolution: int) -> DataFrame:
    """(cell_id, chrom, n_unique, reads, passed) for every cell and chromosome.

    A cell passes if its unique contacts exceed the chromosome's threshold; where half of the cells or fewer do, if they
    exceed the median. Thresholds and medians are one row a chromosome, joined back.
    """
    own = upper.groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("n_unique"), (2 * F.sum("v")).alias("reads"))
    chroms = [r["chrom"] for r in bins.select("chrom").collect()]  # the configured list of chromosomes
    grid = cells.select("cell_id", F.explode(F.array(*map(F.lit, chroms)) if chroms else F.array().cast("array<string>")).alias("chrom"))
    full = grid.join(own, ["cell_id", "chrom"], "left").select("cell_id", "chrom", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), F.coalesce("reads", F.lit(0.0)).alias("reads"))
    full = full.join(row_thresholds(upper, bins, resolution), "chrom")
    rules = full.groupBy("chrom").agg(F.avg((F.col("n_unique") > F.col("threshold")).cast("double")).alias("share"), F.percentile("n_unique", F.lit(0.5)).alias("median"))
    full = full.join(rules, "chrom")
    return full.select("cell_id", "chrom", "n_unique", "reads", F.when(F.col("share") > 0.5, F.col("n_unique") > F.col("threshold")).otherwise(F.col("n_unique") > F.col("median")).alias("passed"))


def cell_quality(upper: DataFrame, cells: DataFrame, bins: DataFrame, resolution: int) -> DataFrame:
    """(cell_id, n_unique, kept, log_reads): kept if every chromosome passes."""
    return chromosome_quality(upper, cells, bins, resolution).groupBy("cell_id").agg(F.sum("n_unique").alias("n_unique"), F.min("passed").alias("kept"), F.log1p(F.sum("reads")).alias("log_reads"))


def cell_order(quality: DataFrame) -> DataFrame:
    """(cell_id, kept, cell_ord): kept cells first, each half by id; numbered over sorted ranges, without a window."""
    return numbered(quality.select("cell_id", "kept"), F.col("kept").desc(), F.col("cell_id"), name="cell_ord")


def with_labels(cells: DataFrame, labels: DataFrame | None, plot_label: str | None = None) -> DataFrame:
    """cells with the columns of their labels, or with a column placeholder of 1.0 where there are none."""
    if labels is None or not [c for c in labels.columns if c != "cell_id"]:
        return cells.withColumn("placeholder", F.lit(1.0))
    out = cells.join(labels, "cell_id", "left")
    if plot_label and plot_label not in labels.columns:
        out = out.withColumn(plot_label, F.lit("none"))
    return out


def restore_order(ordered: DataFrame, order: DataFrame) -> DataFrame:
    """Rows keyed by cell_ord get their cell_id back."""
    return ordered.join(order.select("cell_id", "cell_ord"), "cell_ord")
