"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, as SQL's translate does on any engine."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a temporary one only where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="chromloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's bounds of a table that a join broadcasts, by an estimate before it runs and by the size of what was shuffled.
BY_GUESS, BY_SIZE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Estimated bytes up to which a table is broadcast unseen. Estimates are those of files, which repeated numbers make small, and
#: don't grow with explode or a function over batches: rows can take a hundred times as much in the driver.
GUESSED = 256 * 1024


@contextmanager
def by_real_sizes(spark: SparkSession) -> Iterator[None]:
    """What is planned inside broadcasts tables up to the session's own bound by their real sizes, and by estimates only small ones."""
    own = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    before = {k: spark.conf.get(k, None) for k in (BY_GUESS, BY_SIZE)}
    if before[BY_SIZE] is None:
        spark.conf.set(BY_SIZE, str(own))
    spark.conf.set(BY_GUESS, str(min(own, GUESSED)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """Writes df as a compressed table in the shared folder and reads it back: cuts the lineage and survives lost executors.

    No success marker is written, which no one reads: where Hadoop's native library is missing, each local file of the driver's
    (and its checksum) starts a process for its permissions, which shares the driver's memory for a moment.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chromloom/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        with by_real_sizes(spark):
            df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made, once all that is read from it has been written itself."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if re.search("/chromloom/[0-9a-f]{32}$", folder):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Collects the driver's garbage, as Spark does each half-hour to forget what ended jobs leave (broadcasts, accumulators).

    For steps of very many jobs: their plans and task metrics are garbage soon, but until a full collection the driver's heap
    grows towards its limit, the more so where its threads wait for CPUs, and keeps what it has taken.
    """
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns the freed memory of this process to the system: workers outlive their tasks, and C's and Arrow's allocators keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over a task's batches, that gives memory back at the end of the task."""

    @wraps(run)
    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return inner


def set_aside(df: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of the taken names renamed, and the new names with the old ones, to rename them back."""
    names = {f"{c} (own)": c for c in df.columns if c in set(taken)}
    return df.withColumnsRenamed({old: new for new, old in names.items()}), names


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Null texts count as empty ones."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
