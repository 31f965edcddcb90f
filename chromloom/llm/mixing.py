"""Mixing sources to target weights: proportionate-fair (Pfair) release times and deadlines, earliest deadline first.

Each source is one stream in a fixed pseudo-random order (md5 of the document id), cut into blocks of `block_chars`
characters. With integer weights a_s that add up to Q, block k of source s may be placed from slot floor(k*Q/a_s) on and
must be placed before slot ceil((k+1)*Q/a_s). Earliest deadline first keeps all of these windows on a single track of
slots, so in every prefix of the slots a source's blocks differ from their share by less than one block, until a
source runs out; its later slots then stay empty. No document is dropped or repeated.

The windows repeat after Q slots, so the schedule of one period (Q rows, a function of the weights alone) serves blocks
of any number: slot = (k div a_s) * Q + slot_in_period(s, k mod a_s). The running sizes inside a source come from two
levels, chunks of the md5 order and rows of a chunk, so that a source with a third of all rows is no single task's work.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromloom.llm.common import set_aside

#: Columns used on the way, and those that mix_sources() adds.
INNER = ["__h", "__size", "__tie", "__chunk", "__chunk_size", "__offset", "__j", "__t"]
ADDED = ["__source", "__weight", "__block", "__release", "__deadline", "__slot", "__start"]
#: Slots of one period, and so rows of the broadcast schedule, at most.
MAX_PERIOD = 100_000


def edf_period(weights: dict[str, int]) -> list[tuple[str, int, int, int, int, int]]:
    """One period as (source, weight, block in period, release, deadline, slot); ties between deadlines go to the smaller name."""
    q = sum(weights.values())
    if min(weights.values(), default=1) < 1 or q > MAX_PERIOD:
        raise ValueError(f"weights must be integers of at least 1 that add up to {MAX_PERIOD} at most")
    waiting = [(0, s, 0) for s in sorted(weights)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * q // weights[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, weights[s], k, release, deadline, t))
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * q // weights[s], s, k + 1))
    return out


def source_of(source: str) -> Column:
    return F.coalesce(F.col(source), F.lit(""))


def mix_sources(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block_chars: int = 1_000_000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chunk_rows: int = 20_000) -> DataFrame:
    """Adds __source, __weight, __block, __release, __deadline, __slot and __start (the offset in the source's stream) to docs.

    Reading by (__slot, __start) gives the mixture. A null source counts as the source '' (which takes the default weight
    unless named); sources that weights doesn't name take default_weight. A document belongs to the block in which it
    starts; null or empty texts have size 1. A text longer than a block leaves the later blocks that it covers empty, so the
    shares of a prefix in characters may be off by the length of a text besides the block. Columns of docs with the added
    names are replaced, all others stay. Rows that agree in everything are in either order. An empty table gives an empty result.
    More than MAX_PERIOD sources (or weights that add up to more) raise ValueError.
    """
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = F.greatest(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1)).cast("long")
    sources = docs.select(source_of(source_col).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).limit(MAX_PERIOD + 1).collect()
    if len(sources) > MAX_PERIOD:
        raise ValueError(f"more than {MAX_PERIOD} sources")
    rows, depth = sum(r["n"] for r in sources), 1
    while 16**depth * chunk_rows < rows and depth < 7:
        depth += 1
    named = {r["s"]: weights.get(r["s"], default_weight) for r in sources}
    spark = docs.sparkSession
    period = sum(named.values())
    schedule = spark.createDataFrame(edf_period(named), "__source string, __weight long, __j long, __r long, __d long, __t long").select("__source", "__weight", "__j", "__t") if named else spark.createDataFrame([], "__source string, __weight long, __j long, __t long")
    of_source = F.broadcast(schedule.filter("__j = 0").select("__source", "__weight"))  # MAX_PERIOD rows at most, checked above

    docs, own = set_aside(docs.drop(*ADDED), INNER)
    base = docs.withColumns({"__source": source_of(source_col), "__h": h, "__size": size, "__tie": F.xxhash64(text_col)}).withColumn("__chunk", F.substring("__h", 1, depth))
    sizes = base.groupBy("__source", "__chunk").agg(F.sum("__size").alias("__chunk_size"))
    offsets = sizes.select("__source", "__chunk", F.coalesce(F.sum("__chunk_size").over(Window.partitionBy("__source").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    in_chunk = Window.partitionBy("__source", "__chunk").orderBy("__h", id_col, "__tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(offsets, ["__source", "__chunk"]).withColumn("__start", F.col("__offset") + F.coalesce(F.sum("__size").over(in_chunk), F.lit(0)))
    placed = placed.withColumn("__block", F.expr(f"__start div {int(block_chars)}")).join(of_source, "__source").withColumn("__j", F.col("__block") % F.col("__weight"))
    placed = placed.join(F.broadcast(schedule.drop("__weight")), ["__source", "__j"])
    return placed.withColumns(
        {
            "__release": F.expr(f"(__block * {period}) div __weight"),
            "__deadline": F.expr(f"((__block + 1) * {period} + __weight - 1) div __weight"),
            "__slot": F.expr(f"(__block div __weight) * {period} + __t"),
        }
    ).drop(*INNER).withColumnsRenamed(own)


def mixture(docs: DataFrame, weights: dict[str, int], **options) -> DataFrame:
    """The documents alone, range-partitioned and sorted in the order of the mixture, so that the written files follow it."""
    kept, own = set_aside(docs, ADDED)
    mixed = mix_sources(kept, weights, **options)
    return mixed.repartitionByRange("__slot", "__start").sortWithinPartitions("__slot", "__start").select(*kept.columns).withColumnsRenamed(own)
