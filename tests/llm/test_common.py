import re
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from chromloom.llm.common import by_real_sizes, discard, written

HELD = """
import re
from pathlib import Path
from chromloom.llm import common

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

def run(batches):
    for n in batches:
        kept = [bytes(60_000) for _ in range(n)]  # below the size that C's allocator maps alone
        last.append(kept[-1])  # holds the end of the heap
        del kept
        yield n

last = []
list(common.frugal(run)(iter([1])))
before = held()
assert list(common.frugal(run)(iter([3_000]))) == [3_000]
print(held() - before)
"""


def test_a_task_gives_its_memory_back():
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", HELD], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout
    assert float(re.findall(r"[-\d.]+", out)[-1]) < 60  # of 180 MB


def test_a_written_table_has_no_success_marker_and_goes_whole(spark):
    table = written(spark.range(100).repartition(3))
    folder = Path(table.inputFiles()[0].removeprefix("file:")).parent
    assert table.count() == 100 and not [p for p in folder.iterdir() if "_SUCCESS" in p.name]
    discard(table)
    assert not folder.exists()


def test_estimates_of_files_alone_broadcast_no_large_table(spark):
    rows = written(spark.range(100_000).select(F.xxhash64("id").alias("k"), F.expr("id div 1000").alias("v")))
    many = rows.select("k", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("i"))  # 3,000,000 rows, estimated as the file

    def plan():
        return many.join(rows, "k")._jdf.queryExecution().executedPlan().toString()

    settings = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    assert "BroadcastHashJoin" in plan()
    with by_real_sizes(spark):
        assert "SortMergeJoin" in plan()
    assert {k: spark.conf.get(k, None) for k in settings} == settings
    assert "BroadcastHashJoin" in plan()
    discard(rows)
