"""Registered queries with their DuckDB oracles. Floats are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.operators import contacts as c
from chromloom.operators import graph as g
from chromloom.operators import model as md
from chromloom.operators import normalize as nz
from chromloom.operators import quality as qc
from chromloom.operators import sampling as sp
from chromloom.operators import smooth as sm
from chromloom.operators import tall as tl
from chromloom.operators import tensor as t
from chromloom.plans import fixtures as fx
from chromloom.plans import workflow as wf
from chromloom.sources import files
from chromloom.sources.files import Config
from chromloom.sources.shared import kept, shared_path
from chromloom.sources.ship import ship_package
from chromloom.streaming import increments as inc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ["cell_id", "chrom", "row", "col"]
OUT = 'cell_id, chrom, r AS "row", c AS col'


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql follows the shared CTEs (with a leading comma if it adds some)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(ship_package(spark), sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {fx.CTES.strip()}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return f

    return add


def rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*(F.round(x, 6).alias(x) if kind == "double" else F.col(x) for x, kind in frame.dtypes))


# --- contacts -----------------------------------------------------------------------------------------------------


@query("SELECT cell_id, chrom1, pos1, chrom2, pos2, cnt FROM close")
def contacts_filtered(spark, d):
    return c.on_chromosomes(c.close_contacts(fx.contact_pairs(spark, d)), fx.chrom_sizes(spark))


@query("SELECT cell_id, chrom1, pos1, chrom2, pos2, cnt FROM clean")
def blacklist_antijoin(spark, d):
    return c.remove_blacklisted(c.close_contacts(fx.contact_pairs(spark, d)), fx.blacklist(spark))


@query("SELECT chrom, count(*) AS n_contacts, max(n) AS n_bin, max(s) AS bin_start, max(s) + max(n) AS bin_end FROM close JOIN (SELECT chrom, n, CAST(coalesce(sum(n) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM nb) b ON chrom = chrom1 GROUP BY 1")
def chrom_bins(spark, d):
    near = c.close_contacts(fx.contact_pairs(spark, d)).groupBy(F.col("chrom1").alias("chrom")).agg(F.count(F.lit(1)).alias("n_contacts"))
    return near.join(fx.bins(spark), "chrom").select("chrom", "n_contacts", "n_bin", "bin_start", "bin_end")


def written_contacts(spark, d) -> DataFrame:
    """The contacts in the columns of contact files."""
    return fx.contact_pairs(spark, d).select(F.lit("c").alias("cell_name"), "cell_id", "chrom1", "pos1", "chrom2", "pos2", F.col("cnt").alias("count"))


def written_dimensions(spark, root: str) -> Config:
    """Chromosome sizes and blacklist as files; a config that names them."""
    fx.chrom_sizes(spark).select("chrom", "size").write.csv(f"{root}/sizes.txt", sep="\t")
    fx.blacklist(spark).write.csv(f"{root}/blacklist.bed", sep="\t")
    return Config([name for name, _, _ in fx.CHROMS], data_dir=root, resolution=fx.RESOLUTION, genome_reference_path=f"{root}/sizes.txt", blacklist=f"{root}/blacklist.bed")


UPPER = 'SELECT cell_id, chrom, r AS "row", c AS col, round(v, 6) AS v FROM up'


@query(UPPER)
def files_one_table(spark, d):
    """The base maps of one table of contacts with chromosome sizes and a blacklist, all read from files."""
    root = shared_path(spark)
    written_contacts(spark, d).write.csv(f"{root}/data.txt", sep="\t", header=True)
    config = written_dimensions(spark, root)
    given = wf.read_inputs(spark, config)
    return wf.base_maps(given["contacts"], given["sizes"], config, given["blacklist"])


@query(UPPER)
def files_by_cell(spark, d):
    """The same from one file a cell and a listing of these."""
    root = shared_path(spark)
    by_cell = written_contacts(spark, d).drop("cell_name").repartition("cell_id").write.partitionBy("cell_id")
    by_cell.csv(f"{root}/cells", sep="\t", header=True)
    names = sorted(spark.read.text(f"{root}/cells").inputFiles(), key=lambda x: int(x.rpartition("cell_id=")[2].partition("/")[0]))
    spark.createDataFrame([("\n".join(names),)], "value string").coalesce(1).write.text(f"{root}/filelist.txt")
    config = written_dimensions(spark, root)
    config.input_format = "v2"
    given = wf.read_inputs(spark, config)
    return wf.base_maps(given["contacts"], given["sizes"], config, given["blacklist"])


@query(f"SELECT {OUT}, round(v, 6) AS v FROM sym")
def map_files(spark, d):
    """Maps written with one folder a chromosome, and read back."""
    root = shared_path(spark)
    files.write_maps(fx.maps(spark, d), root)
    return files.read_maps(spark, root).select(*KEYS, "v")


@query(", al AS (SELECT cell_id, chrom1 AS chrom, CAST(floor(least(pos1, pos2) / 500000.0) AS BIGINT) AS r, CAST(floor(greatest(pos1, pos2) / 500000.0) AS BIGINT) AS c, sum(cnt) AS v FROM close GROUP BY 1, 2, 3, 4) SELECT cell_id, chrom, r AS \"row\", c AS col, CAST(v AS DOUBLE) AS v FROM al")
def streamed_map(spark, d):
    """The map of contact files that arrive in micro-batches, merged into versioned buckets."""
    root = shared_path(spark)
    written_contacts(spark, d).repartition(6).write.csv(f"{root}/in", sep="\t", header=True)
    stream = inc.accumulate(inc.stream_contacts(spark, f"{root}/in", 2), fx.RESOLUTION, f"{root}/map", f"{root}/progress", buckets=4, merge=2)
    stream.awaitTermination()
    return inc.accumulated_map(spark, f"{root}/map")


@query(f"SELECT {OUT}, round(v, 6) AS v FROM sym")
def contact_map(spark, d):
    return fx.maps(spark, d)


@query(", bad AS (SELECT chrom, unnest([2, 7]) AS b FROM nb) SELECT " + OUT + ", round(v, 6) AS v FROM sym WHERE r NOT IN (2, 7) AND c NOT IN (2, 7)")
def blacklist_bins_mask(spark, d):
    bad = fx.bins(spark).select("chrom", F.explode(F.array(F.lit(2), F.lit(7))).alias("bin"))
    return nz.drop_bins(fx.maps(spark, d), bad)


@query(", k AS (SELECT cell_id, chrom, r // 4 AS r, c // 4 AS c, sum(v) AS v FROM sym GROUP BY 1, 2, 3, 4) SELECT " + OUT + ", round(v, 6) AS v FROM k")
def coarsen_map(spark, d):
    return nz.coarsen(fx.maps(spark, d), 4)


@query(f"SELECT {OUT}, round(v, 6) AS v FROM band")
def band_filter(spark, d):
    return nz.band(fx.maps(spark, d), fx.OFF_DIAG)


@query('SELECT chrom, r AS "row", c AS col, round(v, 6) AS v FROM blk')
def bulk_map(spark, d):
    return nz.bulk(fx.band(spark, d))


@query('SELECT chrom, r AS "row", c AS col, round(v / (SELECT count(*) FROM cells), 6) AS v FROM blk')
def bulk_mean(spark, d):
    n = qc.all_cells(fx.contact_pairs(spark, d)).count()
    return nz.bulk_mean(fx.band(spark, d), n)


@query('SELECT chrom, batch_id, r AS "row", c AS col, round(sum(v), 6) AS v FROM band GROUP BY 1, 2, 3, 4')
def batch_bulk(spark, d):
    return nz.bulk(fx.batch_of(fx.band(spark, d)), "batch_id")


MAPPING = ", vb AS (SELECT chrom, r AS bin, row_number() OVER (PARTITION BY chrom ORDER BY r) - 1 AS new_bin FROM blk GROUP BY chrom, r HAVING sum(v) > 0)"


@query(MAPPING + ' SELECT cell_id, b.chrom, x.new_bin AS "row", y.new_bin AS col, round(v, 6) AS v FROM band b JOIN vb x ON x.chrom = b.chrom AND x.bin = r JOIN vb y ON y.chrom = b.chrom AND y.bin = c')
def bin_compaction(spark, d):
    band = fx.band(spark, d)
    return nz.remap(band, nz.compact_bins(nz.bulk(band)))


@query(MAPPING + " SELECT chrom, bin, new_bin, round(cov, 6) AS cov FROM vb JOIN (SELECT chrom, r AS bin, sum(v) AS cov FROM blk GROUP BY 1, 2) USING (chrom, bin)")
def valid_bins(spark, d):
    sums = nz.bulk(fx.band(spark, d))
    return nz.compact_bins(sums).join(nz.coverage(sums), ["chrom", "bin"])


QC = """,
pr AS (SELECT DISTINCT chrom, r, c FROM up), pb2 AS (SELECT chrom, r FROM pr UNION ALL SELECT chrom, c FROM pr WHERE r <> c),
th AS (SELECT nb.chrom, count(w.r) AS thr FROM nb LEFT JOIN (SELECT p.chrom, p.r FROM pb2 p JOIN nb USING (chrom) GROUP BY p.chrom, p.r, n HAVING count(*) > 0.1 * n * 2) w USING (chrom) GROUP BY 1),
u AS (SELECT cells.cell_id, nb.chrom, count(up.v) AS u, coalesce(2 * sum(up.v), 0) AS reads FROM cells CROSS JOIN nb LEFT JOIN up ON up.cell_id = cells.cell_id AND up.chrom = nb.chrom GROUP BY 1, 2),
ru AS (SELECT u.chrom, thr, avg(CASE WHEN u > thr THEN 1.0 ELSE 0.0 END) AS share, quantile_cont(u, 0.5) AS med FROM u JOIN th USING (chrom) GROUP BY 1, 2),
pq AS (SELECT cell_id, u.chrom, u, reads, CASE WHEN share > 0.5 THEN u > thr ELSE u > med END AS passed FROM u JOIN ru USING (chrom)),
qq AS (SELECT cell_id, CAST(sum(u) AS BIGINT) AS n_unique, bool_and(passed) AS kept, ln(1 + sum(reads)) AS log_reads FROM pq GROUP BY 1)
"""


def quality(spark, d):
    return qc.cell_quality(fx.upper(spark, d), qc.all_cells(fx.contact_pairs(spark, d)), fx.bins(spark), fx.RESOLUTION)


@query(QC + "SELECT cell_id, n_unique, kept, round(log_reads, 6) AS log_reads FROM qq")
def cell_qc(spark, d):
    return quality(spark, d)


@query(QC + "SELECT cell_id, chrom, u AS n_unique, round(reads, 6) AS reads, passed FROM pq")
def chromosome_qc(spark, d):
    return qc.chromosome_quality(fx.upper(spark, d), qc.all_cells(fx.contact_pairs(spark, d)), fx.bins(spark), fx.RESOLUTION)


ORDER = ", oo AS (SELECT cell_id, kept, CAST(row_number() OVER (ORDER BY kept DESC, cell_id) - 1 AS BIGINT) AS cell_ord FROM qq)"


@query(QC + ORDER + " SELECT * FROM oo")
def cell_order(spark, d):
    return qc.cell_order(quality(spark, d))


@query(QC + ORDER + " SELECT cell_ord, oo.cell_id, n_unique AS x FROM oo JOIN qq ON qq.cell_id = oo.cell_id")
def restore_order(spark, d):
    cells = kept(quality(spark, d))
    order = qc.cell_order(cells)
    by_place = order.join(cells.select("cell_id", "n_unique"), "cell_id").select("cell_ord", F.col("n_unique").alias("x"))
    return qc.restore_order(by_place, order).select("cell_ord", "cell_id", "x")


@query("SELECT cell_id, concat('b', CAST(cell_id % 3 AS STRING)) AS batch_id, 'none' AS cell_type FROM cells")
def cell_labels(spark, d):
    cells = qc.all_cells(fx.contact_pairs(spark, d))
    return qc.with_labels(cells, fx.batch_of(cells), "cell_type")


# --- normalisation ------------------------------------------------------------------------------------------------

BATCH = """,
bb AS (SELECT chrom, batch_id, r, c, sum(v) AS v FROM band GROUP BY 1, 2, 3, 4),
cv AS (SELECT chrom, r AS i, sum(v) AS cov FROM blk GROUP BY 1, 2), cb AS (SELECT chrom, batch_id, r AS i, sum(v) AS cov FROM bb GROUP BY 1, 2, 3),
h0 AS (SELECT k.chrom, c - r AS d, k.v / ((sqrt(y.cov) + 1e-15) * (sqrt(x.cov) + 1e-15)) AS h FROM blk k JOIN cv x ON x.chrom = k.chrom AND x.i = r JOIN cv y ON y.chrom = k.chrom AND y.i = c),
hb AS (SELECT k.chrom, k.batch_id, c - r AS d, k.v / ((sqrt(y.cov) + 1e-15) * (sqrt(x.cov) + 1e-15)) AS h FROM bb k JOIN cb x ON x.chrom = k.chrom AND x.batch_id = k.batch_id AND x.i = r JOIN cb y ON y.chrom = k.chrom AND y.batch_id = k.batch_id AND y.i = c),
s0 AS (SELECT chrom, d, CASE WHEN d = 0 THEN 1 ELSE 2 END * sum(h) / (SELECT sum(h) FROM h0 z WHERE z.chrom = h0.chrom) AS s FROM h0 WHERE d BETWEEN 0 AND 5 GROUP BY chrom, d),
sb AS (SELECT chrom, batch_id, d, CASE WHEN d = 0 THEN 1 ELSE 2 END * sum(h) / ((SELECT sum(h) FROM hb z WHERE z.chrom = hb.chrom AND z.batch_id = hb.batch_id) + 1e-15) AS s FROM hb WHERE d BETWEEN 0 AND 5 GROUP BY chrom, batch_id, d),
qd AS (SELECT sb.chrom, batch_id, sb.d, sb.s / (coalesce(s0.s, 0) + 1e-15) AS q FROM sb LEFT JOIN s0 ON s0.chrom = sb.chrom AND s0.d = sb.d),
bn AS (SELECT b.cell_id, b.chrom, b.batch_id, r, c, b.v / (sqrt(p.cov) * sqrt(o.cov)) * sqrt(x.cov) * sqrt(y.cov) / (q + 1e-15) AS v FROM band b
  JOIN cb p ON p.chrom = b.chrom AND p.batch_id = b.batch_id AND p.i = r JOIN cb o ON o.chrom = b.chrom AND o.batch_id = b.batch_id AND o.i = c
  JOIN cv x ON x.chrom = b.chrom AND x.i = r JOIN cv y ON y.chrom = b.chrom AND y.i = c JOIN qd ON qd.chrom = b.chrom AND qd.batch_id = b.batch_id AND qd.d = abs(c - r))
"""


@query(BATCH + f"SELECT {OUT}, batch_id, round(v, 6) AS v FROM bn")
def batch_normalized(spark, d):
    return nz.batch_normalize(fx.batch_of(fx.band(spark, d)), fx.OFF_DIAG)


DEPTH = ", dn AS (SELECT cell_id, b.chrom, r, c, v * n / (sum(v) OVER (PARTITION BY b.chrom, cell_id) + 1e-15) AS v FROM {0} b JOIN nb ON nb.chrom = b.chrom)"


@query(DEPTH.format("band") + f" SELECT {OUT}, round(v, 6) AS v FROM dn")
def depth_normalized(spark, d):
    return nz.depth_normalize(fx.band(spark, d), fx.bins(spark).select("chrom", F.col("n_bin").alias("n")))


CLIP = ", lg AS (SELECT cell_id, chrom, r, c, ln(1 + v) AS v FROM {0}), lm AS (SELECT chrom, avg(v) + {1} * stddev_pop(v) AS lim FROM lg GROUP BY 1), lc AS (SELECT cell_id, chrom, r, c, least(v, lim) AS v FROM lg JOIN lm USING (chrom))"


@query(CLIP.format("band", 2) + f" SELECT {OUT}, round(v, 6) AS v FROM lc")
def log_clip(spark, d):
    return nz.log_clip(fx.band(spark, d), 2.0)


@query(MAPPING + BATCH + DEPTH.format("bn") + ", rm AS (SELECT cell_id, b.chrom, x.new_bin AS r, y.new_bin AS c, v FROM dn b JOIN vb x ON x.chrom = b.chrom AND x.bin = r JOIN vb y ON y.chrom = b.chrom AND y.bin = c)" + CLIP.format("rm", 15) + f" SELECT {OUT}, round(v, 6) AS v FROM lc")
def packed_tensor(spark, d):
    packed = nz.pack(fx.batch_of(fx.maps(spark, d)), fx.bins(spark), fx.OFF_DIAG, batch_norm=True)
    return packed.select(*KEYS, "v")


STRIPS = ", st AS (SELECT cell_id, chrom, r, CAST(r + floor((abs(c - r) + 1) / 3.0) * sign(c - r) AS BIGINT) AS c, sum(v) AS v FROM rm GROUP BY 1, 2, 3, 4)"


@query(MAPPING + DEPTH.format("band") + ", rm AS (SELECT cell_id, b.chrom, x.new_bin AS r, y.new_bin AS c, v FROM dn b JOIN vb x ON x.chrom = b.chrom AND x.bin = r JOIN vb y ON y.chrom = b.chrom AND y.bin = c)" + STRIPS + CLIP.format("st", 15) + f" SELECT {OUT}, round(v, 6) AS v FROM lc")
def packed_strips(spark, d):
    """The packed tensor with three offsets a strip."""
    return nz.pack(fx.maps(spark, d), fx.bins(spark), fx.OFF_DIAG, strips=3).select(*KEYS, "v")


@query("SELECT count(*) AS n_stored, (SELECT CAST(sum(n * n) * (SELECT count(*) FROM cells) AS BIGINT) FROM nb) AS n_dense, round(count(*) / (SELECT sum(n * n) * (SELECT count(*) FROM cells) FROM nb), 6) AS share FROM band")
def sparsity(spark, d):
    return nz.sparsity(fx.band(spark, d), fx.bins(spark), qc.all_cells(fx.contact_pairs(spark, d)).count())


@query("SELECT (SELECT count(*) FROM up JOIN nb USING (chrom) WHERE r < 0 OR c >= n OR r > c OR v <= 0 OR isnan(v)) AS out_of_range, (SELECT count(*) FROM sym a LEFT JOIN sym b ON a.cell_id = b.cell_id AND a.chrom = b.chrom AND a.r = b.c AND a.c = b.r WHERE b.v IS NULL OR a.v <> b.v) AS asymmetric, (SELECT count(*) FROM sym WHERE v IS NULL OR isnan(v) OR isinf(v) OR r < 0 OR c < 0 OR r >= 42 OR c >= 42) AS bad")
def tensor_integrity(spark, d):
    upper, maps = fx.upper(spark, d), fx.maps(spark, d)
    checks = (c.out_of_range(upper, fx.bins(spark)), c.asymmetric(maps), t.bad_entries(maps, {"row": 42, "col": 42}))
    one = [x.agg(F.count(F.lit(1)).alias(n)) for x, n in zip(checks, ("out_of_range", "asymmetric", "bad"), strict=True)]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))


EXPECTED = ", ex AS (SELECT k.chrom, c - r AS d, sum(v) / (n - (c - r)) AS e FROM blk k JOIN nb ON nb.chrom = k.chrom WHERE c >= r GROUP BY k.chrom, c - r, n)"


@query(EXPECTED + " SELECT chrom, d, round(e, 6) AS expected FROM ex")
def distance_expected(spark, d):
    return nz.expected_by_distance(nz.bulk(fx.band(spark, d)), fx.bins(spark), "chrom")


@query(EXPECTED + ' SELECT k.chrom, r AS "row", c AS col, round(CASE WHEN e = 0 THEN 0 ELSE v / e END, 6) AS v FROM blk k JOIN ex ON ex.chrom = k.chrom AND ex.d = abs(c - r)')
def observed_expected(spark, d):
    return nz.observed_over_expected(nz.bulk(fx.band(spark, d)), fx.bins(spark), "chrom")


RESCALE = " SELECT x.cell_id, x.chrom, x.r AS \"row\", x.c AS col, round(x.v * (SELECT sum(v) FROM band b WHERE b.cell_id = x.cell_id AND b.chrom = x.chrom) / (sum(x.v) OVER (PARTITION BY x.cell_id, x.chrom) + 1e-15), 6) AS v FROM x"
VC = ", cv AS (SELECT chrom, r AS i, {0}(sum(v)) + 1e-15 AS f FROM blk GROUP BY 1, 2), x AS (SELECT cell_id, b.chrom, r, c, v / (p.f * q.f) AS v FROM band b JOIN cv p ON p.chrom = b.chrom AND p.i = r JOIN cv q ON q.chrom = b.chrom AND q.i = c)"


@query(VC.format("") + RESCALE)
def vc_norm(spark, d):
    return nz.vanilla_coverage(fx.band(spark, d))


@query(VC.format("sqrt") + RESCALE)
def sqvc_norm(spark, d):
    return nz.vanilla_coverage(fx.band(spark, d), root=True)


@query(EXPECTED + ", x AS (SELECT cell_id, b.chrom, r, c, v / (e + 1e-15) AS v FROM band b JOIN ex ON ex.chrom = b.chrom AND ex.d = abs(c - r))" + RESCALE)
def oe_norm(spark, d):
    return nz.distance_normalize(fx.band(spark, d), fx.bins(spark))


LIMIT = ", li AS (SELECT {0}, avg(v) + stddev_pop(v) AS lim FROM band GROUP BY {0}) SELECT cell_id, chrom, r AS \"row\", c AS col, round(least(v, lim), 6) AS v FROM band JOIN li USING ({0})"


@query(LIMIT.format("chrom, r, c"))
def entry_clip(spark, d):
    return nz.clip_above(fx.band(spark, d))


@query(LIMIT.format("chrom, r"))
def row_clip(spark, d):
    return nz.clip_above(fx.band(spark, d), ("chrom", "row"))


@query(f"SELECT {OUT}, round(CASE WHEN r = c THEN v / 2 ELSE v END, 6) AS v FROM band")
def diag_half(spark, d):
    return nz.half_diagonal(fx.band(spark, d))


@query(f"SELECT {OUT}, round(CASE WHEN r = c THEN 0 ELSE v END, 6) AS v FROM band")
def diag_zero(spark, d):
    return nz.zero_diagonal(fx.band(spark, d))


VEC = ", cv AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS vec, label, concat('b', CAST(vec_id % 3 AS STRING)) AS batch_id FROM embeddings), fl AS (SELECT cell_id, batch_id, label, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM cv)"


def flat(frame: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, x): a row for each number of the vectors."""
    return frame.select(*keys, F.posexplode("vec").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def flat_vectors(spark, d):
    return fx.cell_vectors(spark, d).select("cell_id", "batch_id", "label", F.posexplode("vec").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query(VEC + " SELECT cell_id, batch_id, i, round(x - avg(x) OVER (PARTITION BY batch_id, i), 6) AS x FROM fl")
def group_center(spark, d):
    return nz.center_groups(flat_vectors(spark, d).drop("label"), "x", "batch_id", "i").select("cell_id", "batch_id", "i", "x")


@query(VEC + ", rk AS (SELECT *, row_number() OVER (PARTITION BY batch_id, i ORDER BY q, cell_id) AS f, rank() OVER (PARTITION BY batch_id, i ORDER BY q) AS l FROM (SELECT *, round(x * 8) / 8 AS q FROM fl)), mn AS (SELECT batch_id, f, avg(q) AS m FROM rk GROUP BY 1, 2) SELECT cell_id, rk.batch_id, i, round(m, 6) AS x FROM rk JOIN mn ON mn.batch_id = rk.batch_id AND mn.f = rk.l")
def quantile_norm(spark, d):
    # eighths: many ties, and sums and means over the 64 columns are exact
    flat = flat_vectors(spark, d).withColumn("x", F.round(F.col("x") * 8) / 8).select("cell_id", "batch_id", "i", "x")
    return nz.quantile_normalize(flat, "batch_id", "i", "cell_id", "x")


@query(", sz AS (SELECT concat('b', CAST(cell_id % 3 AS STRING)) AS batch_id, count(*) AS n FROM cells GROUP BY 1), mm AS (SELECT chrom, batch_id, c, sum(v) / max(n) AS m FROM band JOIN sz USING (batch_id) GROUP BY 1, 2, 3), ov AS (SELECT chrom, c, sum(m) / (SELECT count(*) FROM sz) AS o FROM mm GROUP BY 1, 2) SELECT cell_id, b.chrom, r AS \"row\", b.c AS col, b.batch_id, round(v * o / (m + 1e-15), 6) AS v FROM band b JOIN mm ON mm.chrom = b.chrom AND mm.batch_id = b.batch_id AND mm.c = b.c JOIN ov ON ov.chrom = b.chrom AND ov.c = b.c")
def column_batch_scale(spark, d):
    return nz.scale_column_batches(fx.batch_of(fx.band(spark, d)), fx.batch_of(qc.all_cells(fx.contact_pairs(spark, d))))


# --- tensors ------------------------------------------------------------------------------------------------------


@query('SELECT cell_id, chrom, r AS "row", c - r + 5 AS "offset", round(v, 6) AS v FROM band')
def banded_layout(spark, d):
    return t.banded(fx.maps(spark, d), fx.OFF_DIAG)


@query(f"SELECT {OUT}, round(v, 6) AS v FROM band")
def tilt_band(spark, d):
    return t.from_banded(t.banded(fx.maps(spark, d), fx.OFF_DIAG), fx.OFF_DIAG).select(*KEYS, "v")


@query("SELECT cell_id, r AS \"row\", c - r + 5 AS \"offset\", round(v, 6) AS v FROM sym WHERE chrom = 'chr1' AND c - r BETWEEN -5 AND 5 AND r NOT IN (2, 7) AND c NOT IN (2, 7)")
def band_reformat(spark, d):
    """The band of one chromosome's maps with the bins that are valid."""
    valid = spark.range(42).filter("id not in (2, 7)").select(F.col("id").alias("bin"))
    return t.reformatted(fx.maps(spark, d).filter("chrom = 'chr1'").drop("chrom"), fx.OFF_DIAG, 42, valid).select("cell_id", "row", "offset", "v")


@query("SELECT r AS \"row\", o AS \"offset\", r + o >= 5 AND r + o < 47 AS valid FROM (SELECT DISTINCT r FROM sym WHERE chrom = 'chr1') CROSS JOIN (SELECT unnest(range(11)) AS o)")
def band_mask(spark, d):
    """Which places of the band of each row of one chromosome are columns of the map."""
    return t.validity_mask(fx.maps(spark, d).filter("chrom = 'chr1'").select("row").distinct(), fx.OFF_DIAG, 42)


@query('SELECT cell_id, chrom, r AS "row", c - r AS strip, round(v, 6) AS v FROM sym WHERE c - r BETWEEN 0 AND 7')
def strip_slices(spark, d):
    return t.sliced_strips(fx.maps(spark, d), 8, 42)


@query('SELECT cell_id, chrom, r AS "row", c AS col, round(v, 6) AS v FROM sym WHERE c - r BETWEEN 0 AND 29 AND c < 30')
def strip_tilt(spark, d):
    return t.tilted_strips(t.sliced_strips(fx.maps(spark, d), 30, 42), 30).select(*KEYS, "v")


@query(', k AS (SELECT cell_id, chrom, r, CAST(floor((abs(c - r) + 1) / 3.0) * sign(c - r) AS BIGINT) AS o, v FROM band) SELECT cell_id, chrom, r AS "row", o AS "offset", round(sum(v), 6) AS v FROM k GROUP BY 1, 2, 3, 4')
def strip_coarsen(spark, d):
    return t.coarsen_offsets(fx.band(spark, d), 3, "cell_id", "chrom")


@query("SELECT chrom, (r * 42 + c) * 40 + cell_id AS i, round(v, 6) AS v FROM sym")
def linear_index(spark, d):
    return fx.maps(spark, d).select("chrom", t.linear_index(["row", "col", "cell_id"], [42, 42, 40]).alias("i"), "v")


@query("SELECT chrom, ((r * 42 + c) * 40 + cell_id) // 80 AS a, ((r * 42 + c) * 40 + cell_id) % 80 AS b, round(v, 6) AS v FROM sym")
def reshape_tensor(spark, d):
    return t.reshape(fx.maps(spark, d), ["row", "col", "cell_id"], [42, 42, 40], ["a", "b"], [-1, 80]).select("chrom", "a", "b", "v")


@query('SELECT chrom, cell_id AS "row", r AS col, c AS cell_id, round(v, 6) AS v FROM sym')
def permute_tensor(spark, d):
    return t.permute(fx.maps(spark, d), ["row", "col", "cell_id"], [2, 0, 1])


@query('SELECT cell_id, chrom, r - 3 AS "row", c AS col, round(v, 6) AS v FROM sym WHERE r >= 3 AND r < 9')
def slice_rows(spark, d):
    return t.slice_axis(fx.maps(spark, d), "row", 3, 9)


@query('SELECT cell_id, chrom, CAST(CASE WHEN r >= 20 THEN 2 WHEN r >= 8 THEN 1 ELSE 0 END AS BIGINT) AS part, r - CASE WHEN r >= 20 THEN 20 WHEN r >= 8 THEN 8 ELSE 0 END AS "row", c AS col, round(v, 6) AS v FROM sym')
def split_axis(spark, d):
    return t.split_axis(fx.maps(spark, d), "row", [8, 20])


@query('SELECT cell_id AS cell_ord, chrom, cell_id < 36 AS good, r // 10 AS bin_tile, CASE WHEN cell_id < 36 THEN cell_id // 12 ELSE (cell_id - 36) // 12 END AS cell_tile, r AS "row", c - greatest(r // 10 * 10 - 3, 0) AS col, round(v, 6) AS v FROM sym WHERE c >= r // 10 * 10 - 3 AND c < (r // 10 + 1) * 10 + 3')
def tile_assign(spark, d):
    return t.tiles(fx.maps(spark, d).withColumnRenamed("cell_id", "cell_ord"), 10, 12, 36, 3).select("cell_ord", "chrom", "good", "bin_tile", "cell_tile", "row", "col", "v")


@query('SELECT cell_id, chrom, r // 2 AS "row", c AS col, round(v, 6) AS v FROM sym WHERE r % 2 = 0')
def remap_ids(spark, d):
    mapping = spark.range(0, 42, 2).select(F.col("id").alias("old"), F.expr("id div 2").alias("new"))
    return t.remap_ids(fx.maps(spark, d), "row", mapping)


@query(f"SELECT {OUT}, round(sum(v), 6) AS v FROM sym WHERE v BETWEEN 3 AND 12 GROUP BY cell_id, chrom, r, c")
def trim_values(spark, d):
    return t.trim(fx.maps(spark, d), KEYS, 3, 12)


@query(f", cu AS (SELECT cell_id, chrom, quantile_cont(v, 0.75) AS q FROM sym GROUP BY 1, 2) SELECT {OUT}, round(v, 6) AS v FROM sym JOIN cu USING (cell_id, chrom) WHERE v > q")
def top_quantile(spark, d):
    return t.top_share(fx.maps(spark, d), ["cell_id", "chrom"], 0.25).select(*KEYS, "v")


@query(f'SELECT {OUT}, round(v, 6) AS v FROM sym UNION ALL SELECT cell_id, chrom, r + 42, c, round(v, 6) FROM band')
def append_rows(spark, d):
    return t.append_rows(fx.maps(spark, d), fx.band(spark, d), 42)


@query(f"SELECT {OUT}, round(CASE WHEN r = c THEN v / 2 ELSE v END, 6) AS v FROM sym WHERE r <= c")
def upper_triangle(spark, d):
    return t.store_upper(fx.maps(spark, d))


@query(f"SELECT {OUT}, round(v, 6) AS v FROM sym")
def mirror_upper(spark, d):
    return t.mirrored(t.store_upper(fx.maps(spark, d)), "cell_id", "chrom")


@query(", k AS (SELECT cell_id, chrom, r, c, v FROM up UNION ALL SELECT cell_id, chrom, c, r, v FROM up) SELECT " + OUT + ", round(CASE WHEN r = c THEN sum(v) / 2 ELSE sum(v) END, 6) AS v FROM k GROUP BY cell_id, chrom, r, c")
def symmetrize(spark, d):
    return t.symmetrized(fx.upper(spark, d), "cell_id", "chrom")


#: Coarse maps for dense operators: bins of 2 Mb.
COARSE = ", cn AS (SELECT chrom, CAST(ceil(n / 4.0) AS BIGINT) AS n FROM nb), cm AS MATERIALIZED (SELECT cell_id, chrom, r // 4 AS r, c // 4 AS c, sum(v) AS v FROM sym GROUP BY 1, 2, 3, 4), dm AS MATERIALIZED (SELECT cells.cell_id, cn.chrom, a.i AS r, b.i AS c, greatest(coalesce(v, 0), 1e-8) AS v FROM cells CROSS JOIN cn CROSS JOIN LATERAL (SELECT unnest(range(n)) AS i) a CROSS JOIN LATERAL (SELECT unnest(range(n)) AS i) b LEFT JOIN cm ON cm.cell_id = cells.cell_id AND cm.chrom = cn.chrom AND cm.r = a.i AND cm.c = b.i)"


def coarse(spark, d):
    bins = fx.bins(spark).select("chrom", F.ceil(F.col("n_bin") / 4).alias("n_bin"))
    return nz.coarsen(fx.maps(spark, d), 4), bins


@query(COARSE + f" SELECT {OUT}, round(v, 8) AS v8 FROM dm")
def dense_floor(spark, d):
    maps, bins = coarse(spark, d)
    return t.dense(maps, bins, qc.all_cells(fx.contact_pairs(spark, d))).select(*KEYS, F.round("v", 8).cast("decimal(20,8)").cast("double").alias("v8"))


@query(", st AS (SELECT unnest([-1, 0, 1]) AS o) SELECT cell_id, s.chrom, r + a.o AS \"row\", c + b.o AS col, round(sum(v / 9), 6) AS v FROM sym s JOIN nb ON nb.chrom = s.chrom CROSS JOIN st a CROSS JOIN st b WHERE r + a.o BETWEEN 0 AND n - 1 AND c + b.o BETWEEN 0 AND n - 1 GROUP BY 1, 2, 3, 4")
def mean_conv(spark, d):
    return sm.mean_smooth(fx.maps(spark, d), fx.bins(spark))


GAUSS = """,
kw AS (SELECT o, exp(-0.5 * o * o) / (1 + 2 * exp(-0.5)) AS w FROM (SELECT unnest([-1, 0, 1]) AS o)),
ax AS (SELECT chrom, n, unnest(range(n)) AS i FROM nb),
wt AS (SELECT chrom, i AS dst, CASE WHEN i + o < 0 THEN 1 WHEN i + o >= n THEN n - 2 ELSE i + o END AS src, w FROM ax CROSS JOIN kw),
g1 AS (SELECT cell_id, s.chrom, dst AS r, c, sum(v * w) AS v FROM sym s JOIN wt ON wt.chrom = s.chrom AND wt.src = r GROUP BY 1, 2, 3, 4),
g2 AS (SELECT cell_id, s.chrom, r, dst AS c, sum(v * w) AS v FROM g1 s JOIN wt ON wt.chrom = s.chrom AND wt.src = c GROUP BY 1, 2, 3, 4)
"""


@query(GAUSS + f"SELECT {OUT}, round(v, 6) AS v FROM g2")
def gauss_conv(spark, d):
    return sm.gauss_smooth(fx.maps(spark, d), fx.bins(spark))


@query('SELECT cell_id, s.chrom, r // 4 AS "row", c // 4 AS col, round(sum(v) / 16, 6) AS v FROM sym s JOIN nb ON nb.chrom = s.chrom WHERE r // 4 < n // 4 AND c // 4 < n // 4 GROUP BY 1, 2, 3, 4')
def block_pool(spark, d):
    return sm.block_pool(fx.maps(spark, d), fx.bins(spark), 4)


@query(COARSE + " SELECT cell_id, chrom, c AS col, round(1e-4 + sum(v), 6) AS cov FROM dm GROUP BY 1, 2, 3")
def bin_coverage(spark, d):
    maps, bins = coarse(spark, d)
    return sm.bin_coverage(t.dense(maps, bins, qc.all_cells(fx.contact_pairs(spark, d))))


def _walk(steps: int) -> str:
    q = ["w0 AS (SELECT cell_id, chrom, r, c, 1.0 AS v FROM dm WHERE r = c)"]
    for i in range(steps):
        q.append(f"w{i + 1} AS MATERIALIZED (SELECT cell_id, chrom, r, c, sum(v) AS v FROM (SELECT a.cell_id, a.chrom, a.r, b.c, 0.5 * a.v * b.v AS v FROM w{i} a JOIN pm b ON b.cell_id = a.cell_id AND b.chrom = a.chrom AND b.r = a.c UNION ALL SELECT cell_id, chrom, r, c, 0.5 * v FROM w0) GROUP BY 1, 2, 3, 4)")
    return (
        COARSE
        + ", s2 AS (SELECT a.cell_id, a.chrom, a.r, b.r AS c, CASE WHEN a.r = b.r THEN 0 ELSE sum(a.v * b.v) END AS v FROM dm a JOIN dm b ON a.cell_id = b.cell_id AND a.chrom = b.chrom AND a.c = b.c GROUP BY 1, 2, 3, 4)"
        + ", lk AS (SELECT cell_id, chrom, r, c, sum(v) AS v FROM (SELECT cell_id, chrom, r, c, 0.75 * v / (sum(v) OVER (PARTITION BY cell_id, chrom, c) + 1e-15) AS v FROM dm UNION ALL SELECT cell_id, chrom, r, c, 0.25 * v / (sum(v) OVER (PARTITION BY cell_id, chrom, c) + 1e-15) FROM s2) GROUP BY 1, 2, 3, 4)"
        + ", pm AS MATERIALIZED (SELECT cell_id, chrom, r, c, v / sum(v) OVER (PARTITION BY cell_id, chrom, c) AS v FROM lk), "
        + ", ".join(q)
        + f" SELECT a.cell_id, a.chrom, a.r AS \"row\", b.c AS col, round(sum(a.v * b.v), 6) AS v FROM w{steps} a JOIN dm b ON b.cell_id = a.cell_id AND b.chrom = a.chrom AND b.r = a.c GROUP BY 1, 2, 3, 4"
    )


@query(_walk(3))
def rwr_fixed_steps(spark, d):
    maps, bins = coarse(spark, d)
    return sm.walk_steps(t.dense(maps, bins, qc.all_cells(fx.contact_pairs(spark, d))), 3)


@query(None)
def rwr_auto(spark, d):
    maps, bins = coarse(spark, d)
    lengths = sm.walk_lengths(sm.walk_changes(maps, bins))
    return sm.walk_groups(maps, bins, lengths)


@query(None)
def rwr_col(spark, d):
    maps, bins = coarse(spark, d)
    return sm.walk_groups(maps, bins, bins.select("chrom", F.lit(3).cast("long").alias("n_steps")), conv=True, normalize_columns=True)


@query(None)
def imputed_map(spark, d):
    maps, bins = coarse(spark, d)
    lengths = sm.walk_lengths(sm.walk_changes(maps, bins)).withColumn("n_steps", F.least(F.col("n_steps") + 1, F.lit(60)).cast("long"))
    return t.symmetrized(sm.walk_groups(maps, bins, lengths), "cell_id", "chrom")


@query("SELECT " + OUT + ", round(v, 6) AS v FROM band WHERE c - r = 2")
def kth_diagonal(spark, d):
    return t.diagonal(fx.band(spark, d), 2)


@query("SELECT chrom, round(sqrt(sum(v * v)), 6) AS norm FROM band GROUP BY 1")
def frobenius_norm(spark, d):
    return t.frobenius(fx.band(spark, d), "chrom")


@query(VEC + " SELECT chrom, b.r AS \"row\", b.c AS col, i AS r, round(sum(v * x), 6) AS v FROM band b JOIN fl USING (cell_id) GROUP BY 1, 2, 3, 4")
def tensor_times_factor(spark, d):
    factor = flat_vectors(spark, d).select("cell_id", F.col("i").alias("r"), "x")
    return t.times_factor(fx.band(spark, d), factor, "cell_id", ["chrom", "row", "col"])


# --- graphs and embeddings ----------------------------------------------------------------------------------------

KNN = ", ds AS (SELECT a.cell_id AS src, b.cell_id AS dst, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM cv a JOIN cv b ON a.cell_id <> b.cell_id), kn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS \"rank\" FROM ds) WHERE \"rank\" <= 10)"


@query(VEC + KNN + ' SELECT src, dst, round(dist, 6) AS dist, "rank" FROM kn')
def knn_exact(spark, d):
    return g.nearest_cells(fx.cell_vectors(spark, d), 10)


@query(VEC + KNN + " SELECT x.src AS a, y.src AS b, count(*) AS n FROM kn x JOIN kn y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2")
def shared_neighbors(spark, d):
    return g.shared_neighbours(g.nearest_cells(fx.cell_vectors(spark, d), 10))


@query(None)
def neighbour_descent(spark, d):
    """About the ten nearest of each cell, by descent; tests hold its recall against knn_exact."""
    return g.descended(fx.cell_vectors(spark, d), 10)


@query(None)
def shared_spectrum(spark, d):
    """The eight leading components of the graph of shared neighbours among the ten nearest."""
    out, _ = g.shared_spectrum(g.nearest_cells(fx.cell_vectors(spark, d), 10), 8)
    return flat(out, "src")


@query(None)
def batch_mix_both(spark, d):
    """Both scores: among the nearest cells, and among the nearest by shared neighbours."""
    v = fx.cell_vectors(spark, d)
    return g.batch_mix_both(v, v.select("cell_id", "batch_id"), 10, 20)


@query(VEC + KNN + " SELECT src AS cell_id, round(avg(CASE WHEN p.batch_id = q.batch_id THEN 1.0 ELSE 0.0 END), 6) AS share FROM kn JOIN cv p ON p.cell_id = src JOIN cv q ON q.cell_id = dst GROUP BY 1")
def batch_mix(spark, d):
    v = fx.cell_vectors(spark, d)
    return g.batch_mix(v, v.select("cell_id", "batch_id"), 10)


@query(VEC + KNN + ", ed AS (SELECT p.label AS a, q.label AS b, 1 / (1 + dist) AS w FROM kn JOIN cv p ON p.cell_id = src JOIN cv q ON q.cell_id = dst), ks AS (SELECT a, sum(w) / (SELECT sum(w) FROM ed) AS k FROM ed GROUP BY 1) SELECT round(((SELECT sum(w) FROM ed WHERE a = b) / (SELECT sum(w) FROM ed) - (SELECT sum(k * k) FROM ks)) / (SELECT sum(k * (1 - k)) FROM ks), 6) AS modularity")
def modularity(spark, d):
    v = fx.cell_vectors(spark, d)
    edges = g.nearest_cells(v, 10).withColumn("w", 1 / (1 + F.col("dist")))
    return g.modularity(edges, v.select("cell_id", "label"), "label", normalize=True)


@query(VEC + ", co AS (SELECT cell_id, ln(1 + cell_id) AS z FROM cv) SELECT cell_id, i, round(x - (regr_slope(x, z) OVER (PARTITION BY i) * z + regr_intercept(x, z) OVER (PARTITION BY i)), 6) AS x FROM fl JOIN co USING (cell_id)")
def regress_out_linear(spark, d):
    out = g.regress_out(fx.cell_vectors(spark, d), [F.log1p("cell_id")])
    return out.select("cell_id", F.posexplode("vec").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query(VEC + " SELECT cell_id, i, round(x - avg(x) OVER (PARTITION BY batch_id, i), 6) AS x FROM fl")
def regress_out_onehot(spark, d):
    v = fx.cell_vectors(spark, d)
    out = g.regress_out(v, g.one_hot(v, "batch_id", ["b0", "b1", "b2"]))
    return out.select("cell_id", F.posexplode("vec").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query(VEC + ", nn AS (SELECT cell_id, sqrt(sum(x * x)) AS n FROM fl GROUP BY 1) SELECT cell_id, i, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS x FROM fl JOIN nn USING (cell_id)")
def l2_normalize(spark, d):
    return g.l2_normalize(fx.cell_vectors(spark, d)).select("cell_id", F.posexplode("vec").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


QUANT = f""",
xs AS (SELECT cell_id, i, round(x, 2) AS x FROM fl), xd AS (SELECT DISTINCT i, x FROM xs),
mk AS (SELECT i, unnest(range(100)) AS g, unnest(quantile_cont(x, [{', '.join(repr(k / 99) for k in range(100))}])) AS q FROM xs GROUP BY i),
sg AS (SELECT a.i, a.g, a.q AS lo, b.q AS hi FROM mk a JOIN mk b ON b.i = a.i AND b.g = a.g + 1 WHERE b.q > a.q),
qu AS (SELECT xd.i, x, max((g + (x - lo) / (hi - lo)) / 99.0) AS u FROM xd JOIN sg ON sg.i = xd.i AND x >= lo AND x < hi GROUP BY 1, 2),
qw AS (SELECT xd.i, x, max((g + (x - lo) / (hi - lo)) / 99.0) AS w FROM xd JOIN sg ON sg.i = xd.i AND x > lo AND x <= hi GROUP BY 1, 2),
en AS (SELECT i, min(q) AS least, max(q) AS most FROM mk GROUP BY i)
SELECT cell_id, xs.i, round(CASE WHEN xs.x = least THEN 0 WHEN xs.x = most THEN 1 ELSE (u + w) / 2 END, 6) AS x FROM xs JOIN en ON en.i = xs.i LEFT JOIN qu ON qu.i = xs.i AND qu.x = xs.x LEFT JOIN qw ON qw.i = xs.i AND qw.x = xs.x
"""


@query(VEC + QUANT)
def quantile_transform(spark, d):
    vectors = fx.cell_vectors(spark, d).withColumn("vec", F.transform("vec", lambda x: F.round(x, 2)))
    return flat(g.quantile_uniform_vectors(vectors), "cell_id")


@query(VEC + " SELECT a.i AS i, b.i AS j, round(sum(a.x * b.x), 6) AS v FROM fl a JOIN fl b USING (cell_id) GROUP BY 1, 2")
def gram_matrix(spark, d):
    gram = g.gram_of(fx.cell_vectors(spark, d))
    return spark.createDataFrame([(i, j, float(gram[i, j])) for i in range(len(gram)) for j in range(len(gram))], "i long, j long, v double")


@query(None)
def svd_embedding(spark, d):
    """The scores of the eight leading components; a component's sign is that of the sum of its cubes."""
    out, _ = g.svd_embedding(fx.cell_vectors(spark, d), 8)
    return flat(tl.vector_signs(out), "cell_id")


@query(None)
def wide_svd(spark, d):
    """The eight leading components of the cells' maps of all chromosomes, pooled to a megabase, as one wide sparse matrix."""
    place = F.expr("CASE chrom WHEN 'chr1' THEN 0 WHEN 'chr2' THEN 1 ELSE 2 END")
    pooled = nz.coarsen(fx.maps(spark, d), 2).withColumn("f", (place * 25 + F.col("row")) * 25 + F.col("col"))
    scores, _, _ = tl.truncated_svd(pooled.select(F.col("cell_id").alias("cell_ord"), "f", "v"), 8)
    return flat(scores.withColumnRenamed("cell_ord", "cell_id"), "cell_id")


# --- sampling and model -------------------------------------------------------------------------------------------


@query(None)
def downsample_cap(spark, d):
    return sp.downsample_cells(fx.upper(spark, d), 60.0)


@query(None)
def downsample_stratum(spark, d):
    return sp.downsample_batches(fx.upper(spark, d), fx.batch_of(qc.all_cells(fx.contact_pairs(spark, d))))


def packed(spark, d):
    """(tensor, bins, order, n_cells, n_good) of the packed maps, with cells in the order of a tensor."""
    order = kept(qc.cell_order(quality(spark, d)))
    counts = order.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kept"), 1)).alias("good")).first()
    maps = nz.pack(fx.maps(spark, d), fx.bins(spark), fx.OFF_DIAG)
    tensor = kept(maps.join(order.select("cell_id", "cell_ord"), "cell_id").drop("cell_id"))
    bins = {r["chrom"]: int(r["n"]) for r in tensor.groupBy("chrom").agg((F.max("row") + 1).alias("n")).orderBy("chrom").collect()}
    return tensor, bins, order, counts["n"], counts["good"]


def fitted(spark, d, sweeps: int = 3):
    tensor, bins, order, n_cells, n_good = packed(spark, d)
    widths = md.ranks(bins, fx.RESOLUTION, 0.6, 8)
    return tensor, bins, order, md.fit(tensor, bins, n_good, widths, 8, sweeps, pools=md.pools_of({fx.RESOLUTION: bins}))


@query(None)
def model_fit(spark, d):
    f = fitted(spark, d)[3]
    return spark.createDataFrame([(i, x) for i, x in enumerate(f.losses)], "sweep long, loss double")


@query(None)
def model_transform(spark, d):
    tensor, bins, order, f = fitted(spark, d, 1)
    return flat(md.meta_frame(order, md.transform(tensor, f, bins)), "cell_id")


def variants(frames: dict[str, DataFrame]) -> DataFrame:
    """(variant, cell_id, i, x) of all embeddings; each component's sign is that of the sum of its cubes."""
    first, *rest = [flat(tl.vector_signs(x), "cell_id").withColumn("variant", F.lit(name)) for name, x in frames.items()]
    for x in rest:
        first = first.unionByName(x)
    return first


@query(None)
def cell_embedding(spark, d):
    tensor, bins, order, f = fitted(spark, d, 1)
    meta = kept(md.meta_frame(order, md.transform(tensor, f, bins)))
    out = md.cell_embedding(meta, f, 6)
    reads = kept(quality(spark, d).select("cell_id", "log_reads"))
    every = kept(out["embed_all"].join(g.quantile_uniform(reads, "log_reads"), "cell_id"))
    out |= md.corrected_embedding(every, [F.col("log_reads")], 6)
    return variants(out)


def run_config(*resolutions: int) -> Config:
    return Config([name for name, _, _ in fx.CHROMS], resolution=fx.RESOLUTION, resolution_fh=list(resolutions), batch_id="batch_id")


@query(None)
def imputed_slices(spark, d):
    settings = wf.Settings(off_diag=fx.OFF_DIAG, conv=True, walk=True)
    return wf.impute(fx.contact_pairs(spark, d), fx.chrom_sizes(spark), run_config(fx.RESOLUTION), settings, fx.blacklist(spark))


@query(None)
def init_factors(spark, d):
    """The factor D of each chromosome and the meta-embedding V."""
    tensor, bins, _, _, n_good = packed(spark, d)
    f = md.init_factors(tensor.filter(F.col("cell_ord") < n_good), bins, md.ranks(bins, fx.RESOLUTION, 0.6, 8), 8, md.pools_of({fx.RESOLUTION: bins}))
    d = spark.createDataFrame([(c, m, r, float(x)) for c, own in f.d.items() for m, row in enumerate(own) for r, x in enumerate(row)], "name string, k long, i long, x double")
    return d.unionByName(flat(f.v, "cell_ord").select(F.lit("v").alias("name"), F.col("cell_ord").alias("k"), "i", "x"))


@query(None)
def embedding_run(spark, d):
    """From contacts to embeddings in one run: two resolutions, batches, smoothing in slices, two sweeps."""
    contacts, settings = fx.contact_pairs(spark, d), wf.Settings(fx.OFF_DIAG, batch_norm=True, conv=True, walk=True)
    labels = fx.batch_of(qc.all_cells(contacts))
    data = wf.prepare(contacts, fx.chrom_sizes(spark), run_config(fx.RESOLUTION, 2 * fx.RESOLUTION), settings, fx.blacklist(spark), labels)
    f, meta = wf.run_model(data, settings, rank=8, sweeps=2)
    out = wf.embed(data, f, meta, 6, restore_order=True)
    out |= wf.correct_linear(data, out["embed_all"], ["batch_id"], 6, add_intercept_back=True)
    return variants(out)
