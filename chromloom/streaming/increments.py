"""Contact maps from files that keep arriving: micro-batches are merged into versioned buckets behind an atomic pointer.

A map's folder holds one folder for each batch that is not merged yet (deltas/batch=n), versions of buckets
(buckets/version=n/bucket=b, by a hash of cell and chromosome) and the file LIVE, which names the last batch, the unmerged
batches and the version of each bucket. A batch writes its sums; every MERGE batches, the buckets that the unmerged ones
touch are written anew as sums of the old version and these. Only then is LIVE replaced, in one rename. So a batch that fails
leaves nothing that counts, one that is run again after it counted is left out, and readers see the map before or after a
batch, never between. Folders that neither LIVE nor the one before it names are deleted, so the number of files is bounded by the
buckets and MERGE.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chromloom.operators.contacts import close_contacts, upper_map
from chromloom.sources.files import CONTACT, contact_columns

BUCKETS, MERGE = 64, 8
MAP = "cell_id long, chrom string, row long, col long, v double"
KEYS = ["cell_id", "chrom", "row", "col"]


@dataclass
class Live:
    """What makes up the map: the last batch that counts, batches not merged yet, and the version of each bucket."""

    batch: int = -1
    deltas: list[int] = field(default_factory=list)
    buckets: dict[str, int] = field(default_factory=dict)

    def folders(self) -> list[str]:
        return [f"deltas/batch={n}" for n in self.deltas] + [f"buckets/version={v}/bucket={b}" for b, v in self.buckets.items()]


class MapFolder:
    """The folder of a map, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.conf)

    def live(self, name: str = "LIVE") -> Live:
        path, fs = self._path(name), self._fs()
        if not fs.exists(path):
            return Live()
        stream = fs.open(path)
        try:
            return Live(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _put(self, name: str, live: Live) -> None:
        """Writes a file beside and moves it over the old one in one step."""
        stream = self._fs().create(self._path(f"{name}.new"), True)
        try:
            stream.write(bytearray(json.dumps(asdict(live)).encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        files.rename(self._path(f"{name}.new"), self._path(name), options)

    def commit(self, live: Live) -> None:
        """Makes live the map, and deletes what neither it nor the map before it needs."""
        before = self.live()
        self._put("BEFORE", before)
        self._put("LIVE", live)
        needed, fs = {*live.folders(), *before.folders()}, self._fs()
        for pattern in ("deltas/batch=*", "buckets/version=*/bucket=*"):
            for status in fs.globStatus(self._path(pattern)) or []:
                name = "/".join(status.getPath().toString().rsplit("/", pattern.count("/") + 1)[1:])
                if name not in needed:
                    fs.delete(status.getPath(), True)
        for status in fs.globStatus(self._path("buckets/version=*")) or []:
            if not fs.globStatus(self.jvm.org.apache.hadoop.fs.Path(status.getPath().toString() + "/bucket=*")):
                fs.delete(status.getPath(), True)

    def read(self, live: Live, buckets: set[str] | None = None) -> DataFrame:
        """The sums of all that live names (or of some buckets' versions and all batches), not added up."""
        names = [f"deltas/batch={n}" for n in live.deltas] + [f"buckets/version={v}/bucket={b}" for b, v in live.buckets.items() if buckets is None or b in buckets]
        if not names:
            return self.spark.createDataFrame([], MAP)
        return self.spark.read.schema(MAP).parquet(*(f"{self.path}/{n}" for n in names))


def added_up(frame: DataFrame) -> DataFrame:
    return frame.groupBy(*KEYS).agg(F.sum("v").alias("v"))


def merge_batch(folder: MapFolder, sums: DataFrame, n: int, buckets: int = BUCKETS, merge: int = MERGE) -> None:
    """Adds a batch's map (cell_id, chrom, row, col, v) to the folder's, once for each n."""
    live = folder.live()
    if n <= live.batch:
        return
    bucket = F.pmod(F.xxhash64("cell_id", "chrom"), F.lit(buckets)).cast("string")
    added_up(sums).repartition(F.col("cell_id")).write.mode("overwrite").parquet(f"{folder.path}/deltas/batch={n}")
    after = Live(n, [*live.deltas, n], dict(live.buckets))
    if len(after.deltas) >= merge:
        touched = {r["b"] for r in folder.read(Live(n, after.deltas)).select(bucket.alias("b")).distinct().collect()}  # names of buckets
        whole = added_up(folder.read(after, touched)).withColumn("bucket", bucket)
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.path}/buckets/version={n}")
        after = Live(n, [], after.buckets | dict.fromkeys(touched, n))
    folder.commit(after)


def stream_contacts(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Tab-separated files with the standard header, as they arrive in a folder."""
    return contact_columns(spark.readStream.schema(CONTACT).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", max_files).csv(folder))


def accumulate(contacts: DataFrame, resolution: int, out: str, checkpoint: str, buckets: int = BUCKETS, merge: int = MERGE) -> StreamingQuery:
    """Merges the map of each micro-batch into the map in out; the same map has to keep its number of buckets."""

    def add(batch: DataFrame, n: int) -> None:
        merge_batch(MapFolder(batch.sparkSession, out), upper_map(close_contacts(batch), resolution), n, buckets, merge)

    return contacts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated_map(spark: SparkSession, out: str) -> DataFrame:
    """The live map; empty where there is none yet."""
    folder = MapFolder(spark, out)
    return added_up(folder.read(folder.live()))
