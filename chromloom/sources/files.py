"""Readers and writers of contact files, dimension files, maps and labels. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTACT = "cell_name string, cell_id long, chrom1 string, pos1 long, chrom2 string, pos2 long, count double"
TYPES = {"cell_name": "string", "cell_id": "long", "chrom1": "string", "pos1": "long", "chrom2": "string", "pos2": "long", "count": "double"}
COLUMNS = ["cell_id", "chrom1", "pos1", "chrom2", "pos2", "cnt"]


@dataclass
class Config:
    """A run's settings, as in its JSON file; other keys are kept in `more`."""

    chrom_list: list[str]
    data_dir: str = ""
    temp_dir: str = ""
    resolution: int = 500_000
    resolution_fh: list[int] = field(default_factory=list)
    genome_reference_path: str = ""
    input_format: str = "v1"
    structured: bool = False
    header_included: bool = True
    contact_header: list[str] = field(default_factory=list)
    blacklist: str | None = None
    plot_label: str | None = None
    batch_id: str | None = None
    more: dict = field(default_factory=dict)


def read_config(path: str) -> Config:
    with open(path) as f:
        found = json.load(f)
    own = {k: found.pop(k) for k in list(found) if k in Config.__dataclass_fields__ and k != "more"}
    config = Config(**own, more=found)
    config.resolution_fh = config.resolution_fh or [config.resolution]
    config.input_format = config.input_format.rpartition("_")[2]  # v1: one table; v2: one file a cell
    if config.input_format not in ("v1", "v2"):
        raise ValueError(f"unknown input_format {config.input_format}")
    return config


def _tsv(spark: SparkSession, path, schema: str, header: bool) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=header, enforceSchema=True)


def header_of(spark: SparkSession, path) -> list[str]:
    return spark.read.text(path).limit(1).first()[0].split("\t")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """One tab-separated table with a header, sorted by cell or not: grouping is by key, so both are read alike."""
    columns = header_of(spark, path)
    frame = _tsv(spark, path, ", ".join(f"`{c}` {TYPES.get(c, 'string')}" for c in columns), True)
    return contact_columns(frame)


def contact_columns(frame: DataFrame) -> DataFrame:
    cnt = F.col("count").cast("double") if "count" in frame.columns else F.lit(1.0)
    return frame.select("cell_id", "chrom1", "pos1", "chrom2", "pos2", cnt.alias("cnt"))


def read_contact_files(spark: SparkSession, listing: str, header: list[str] | None = None, header_included: bool = True) -> DataFrame:
    """One tab-separated file a cell; a cell's id is its line in the listing. All files are read in one scan and known by their paths."""
    paths = spark.read.text(listing, wholetext=True).first()[0].split("\n")
    paths = [p.strip() for p in paths if p.strip()]
    columns = header_of(spark, paths[0]) if header_included and not header else (header or [])
    frame = _tsv(spark, paths, ", ".join(f"`{c}` {TYPES.get(c, 'string')}" for c in columns if c != "cell_id"), header_included)
    ids = spark.createDataFrame([(i, p.split("://")[-1].split("/")[-1], p.split("://")[-1]) for i, p in enumerate(paths)], "cell_id long, name string, path string")
    at = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/+", "/")
    frame = frame.withColumns({"__path": at})
    frame = frame.join(ids.select("cell_id", F.regexp_replace("path", "^/+", "/").alias("__path")), "__path").drop("__path")
    return contact_columns(frame)


def read_sizes(spark: SparkSession, path: str, chrom_list: list[str]) -> DataFrame:
    """(chrom, size, ord) of the listed chromosomes."""
    order = spark.createDataFrame(list(zip(chrom_list, range(len(chrom_list)), strict=True)), "chrom string, ord int")
    return _tsv(spark, path, "chrom string, size long", False).join(order, "chrom")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chrom string, bstart long, bend long", False)


def read_blacklist_bins(spark: SparkSession, path: str, bins: DataFrame) -> DataFrame:
    """(chrom, bin) from Parquet; bins beyond their chromosome are left out, and a missing file means none."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "chrom string, bin long")
    return found.join(bins.select("chrom", "n_bin"), "chrom").filter("bin >= 0 and bin < n_bin").select("chrom", "bin")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A numeric table whose first column names the rows and first line the columns; compressed files by their suffix."""
    first = header_of(spark, path) if sep == "\t" else spark.read.text(path).limit(1).first()[0].split(sep)
    names = ["row_name", *(c for c in first[1:])]
    return spark.read.csv(path, sep=sep, header=True, enforceSchema=True, schema=", ".join(f"`{c}` {'string' if i == 0 else 'double'}" for i, c in enumerate(names)))


def write_maps(maps: DataFrame, path: str) -> None:
    """Raw or imputed maps, one folder a chromosome."""
    maps.write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached(spark: SparkSession, root: str, key: dict, build) -> DataFrame:
    """The table that all parameters in key name, built and written by the first call."""
    path = f"{root.rstrip('/')}/" + "/".join(f"{k}={key[k]}" for k in sorted(key))
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
