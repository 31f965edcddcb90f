"""Contacts, cells and embeddings derived from the given tables, as DataFrames and as the SQL that oracles start with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.operators import contacts as c
from chromloom.sources.shared import kept

RESOLUTION, OFF_DIAG = 500_000, 5
CHROMS = [("chr1", 21_000_000, 0), ("chr2", 16_000_000, 1), ("chr3", 11_000_000, 2)]
BLACKLIST = [("chr1", 3_000_000, 4_000_000), ("chr2", 0, 500_000)]


_CONTACTS: dict[tuple[str, str], DataFrame] = {}


def contact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts of all lines, written once a session as the table that a user would have: filters on them are then
    predicates of a scan, instead of these expressions over and over."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _CONTACTS:
        _CONTACTS[key] = kept(derived_contacts(spark, sf_dir))
    return _CONTACTS[key]


def derived_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    b = lines.selectExpr(
        "CASE WHEN l_orderkey % 1000 < 4 THEN 36 + l_orderkey % 1000 ELSE l_orderkey % 36 END AS cell_id",
        "concat('chr', CAST(l_linenumber % 3 + 1 AS STRING)) AS chrom1",
        "CASE WHEN l_returnflag = 'A' AND l_suppkey % 10 = 0 THEN concat('chr', CAST((l_linenumber + 1) % 3 + 1 AS STRING)) ELSE concat('chr', CAST(l_linenumber % 3 + 1 AS STRING)) END AS chrom2",
        "CASE l_linenumber % 3 WHEN 0 THEN 21000000 WHEN 1 THEN 16000000 ELSE 11000000 END AS size",
        "l_partkey * 7919 + l_suppkey * 104729 + l_orderkey * 1301 AS h",
        "(CAST(l_quantity AS BIGINT) - 1) * ((l_orderkey * 13) % 53) * 1500 AS dist",
        "l_returnflag AS rf",
        "CAST(l_linenumber AS BIGINT) AS cnt",
    ).withColumn("pa", F.expr("h % size"))
    q = b.withColumn("pb", F.expr("least(pa + dist, size - 1)"))
    return q.selectExpr("CAST(cell_id AS BIGINT) AS cell_id", "chrom1", "CASE WHEN rf = 'R' THEN pb ELSE pa END AS pos1", "chrom2", "CASE WHEN rf = 'R' THEN pa ELSE pb END AS pos2", "cnt")


def chrom_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHROMS, "chrom string, size long, ord int")


def bins(spark: SparkSession) -> DataFrame:
    return c.chromosome_bins(chrom_sizes(spark), RESOLUTION)


def blacklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BLACKLIST, "chrom string, bstart long, bend long")


def upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binned map: one triangle, after the distance and blacklist predicates. Kept, as queries read it in several branches."""
    kept = c.close_contacts(contact_pairs(spark, sf_dir))
    return c.upper_map(c.remove_blacklisted(c.on_chromosomes(kept, chrom_sizes(spark)), blacklist(spark)), RESOLUTION).persist()


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.symmetric(upper(spark, sf_dir))


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps(spark, sf_dir).filter(F.abs(F.col("col") - F.col("row")) <= OFF_DIAG)


def batch_of(frame: DataFrame) -> DataFrame:
    return frame.withColumn("batch_id", F.concat(F.lit("b"), (F.col("cell_id") % 3).cast("string")))


def cell_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return batch_of(v)


#: The same tables for DuckDB; each oracle is "WITH " + CTES + ", ..." or "WITH " + CTES + " SELECT ...".
CTES = """
src AS (SELECT CASE WHEN l_orderkey % 1000 < 4 THEN 36 + l_orderkey % 1000 ELSE l_orderkey % 36 END AS cell_id,
  concat('chr', CAST(l_linenumber % 3 + 1 AS STRING)) AS chrom1,
  CASE WHEN l_returnflag = 'A' AND l_suppkey % 10 = 0 THEN concat('chr', CAST((l_linenumber + 1) % 3 + 1 AS STRING)) ELSE concat('chr', CAST(l_linenumber % 3 + 1 AS STRING)) END AS chrom2,
  CASE l_linenumber % 3 WHEN 0 THEN 21000000 WHEN 1 THEN 16000000 ELSE 11000000 END AS size,
  l_partkey * 7919 + l_suppkey * 104729 + l_orderkey * 1301 AS h,
  (CAST(l_quantity AS BIGINT) - 1) * ((l_orderkey * 13) % 53) * 1500 AS dist, l_returnflag AS rf, CAST(l_linenumber AS BIGINT) AS cnt FROM lineitem),
src2 AS (SELECT *, least(h % size + dist, size - 1) AS pb, h % size AS pa FROM src),
contacts AS (SELECT cell_id, chrom1, CASE WHEN rf = 'R' THEN pb ELSE pa END AS pos1, chrom2, CASE WHEN rf = 'R' THEN pa ELSE pb END AS pos2, cnt FROM src2),
chrom_sizes AS (SELECT * FROM (VALUES ('chr1', 21000000, 0), ('chr2', 16000000, 1), ('chr3', 11000000, 2)) AS t(chrom, size, ord)),
nb AS (SELECT chrom, ord, CAST(ceil(size / 500000.0) AS BIGINT) AS n FROM chrom_sizes),
blacklist AS (SELECT * FROM (VALUES ('chr1', 3000000, 4000000), ('chr2', 0, 500000)) AS t(chrom, bstart, bend)),
close AS (SELECT * FROM contacts WHERE chrom1 = chrom2 AND (abs(pos2 - pos1) >= 2500 OR pos1 = pos2)),
clean AS (SELECT * FROM close WHERE NOT EXISTS (SELECT 1 FROM blacklist k WHERE k.chrom = chrom1 AND pos1 >= k.bstart AND pos1 < k.bend)
  AND NOT EXISTS (SELECT 1 FROM blacklist k WHERE k.chrom = chrom2 AND pos2 >= k.bstart AND pos2 < k.bend)),
up AS MATERIALIZED (SELECT cell_id, chrom1 AS chrom, CAST(floor(least(pos1, pos2) / 500000.0) AS BIGINT) AS r, CAST(floor(greatest(pos1, pos2) / 500000.0) AS BIGINT) AS c, CAST(sum(cnt) AS DOUBLE) AS v FROM clean GROUP BY 1, 2, 3, 4),
sym AS MATERIALIZED (SELECT cell_id, chrom, r, c, CASE WHEN r = c THEN 2 * v ELSE v END AS v, concat('b', CAST(cell_id % 3 AS STRING)) AS batch_id FROM up
  UNION ALL SELECT cell_id, chrom, c, r, v, concat('b', CAST(cell_id % 3 AS STRING)) FROM up WHERE r <> c),
band AS MATERIALIZED (SELECT * FROM sym WHERE abs(c - r) <= 5),
blk AS (SELECT chrom, r, c, sum(v) AS v FROM band GROUP BY 1, 2, 3),
cells AS (SELECT unnest(range((SELECT max(cell_id) FROM contacts) + 1)) AS cell_id)
"""
