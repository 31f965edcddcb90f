"""Tables that a job keeps in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder in spark.checkpoint.dir; in a temporary folder only where that is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = tempfile.mkdtemp(prefix="chromloom-")
    return f"{root.rstrip('/')}/chromloom-maps/{uuid.uuid4().hex}"


#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(frame: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """frame written to the shared folder and read back, so that all that follows reads rows instead of working them out
    again, and survives lost executors. The write's shuffle files go with its end. settings: of the session, for
    the write alone."""
    spark, path = frame.sparkSession, shared_path(frame.sparkSession)
    wanted = {CLEANUP: "true"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        frame.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables that kept() made, once all that is read from them is kept itself."""
    for frame in frames:
        jvm = frame.sparkSession.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            if "/chromloom-maps/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
