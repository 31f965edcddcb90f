"""Ranks over a whole table and exact quantiles, without a task that holds all rows of a table or group.

Rows are dealt in sorted ranges, numbered within each, and get the number of rows in the ranges before theirs; only the sizes of
the ranges reach the driver. A group's ranks are those numbers less its first, so a group may be spread over any number of ranges.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.sources.shared import kept

PLACE = 2**33 - 1


def numbered(frame: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """frame with its rows' places 0, 1, 2 ... in the order of the given columns, kept."""
    # in its low 33 bits the id has a row's place in its partition, above these the partition's number
    at = F.monotonically_increasing_id()
    parts = kept(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at).withColumn("__part", F.shiftright("__at", 33).cast("int")))
    sizes = sorted(tuple(r) for r in parts.groupBy("__part").agg(F.count(F.lit(1))).collect())
    starts = list(zip([p for p, _ in sizes], accumulate([0, *(n for _, n in sizes)]), strict=False))
    before = frame.sparkSession.createDataFrame(starts, "__part int, __before long")  # a number for each range
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__at").bitwiseAND(F.lit(PLACE)) + F.col("__before")).drop("__part", "__before", "__at")


def group_ranks(frame: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """frame with each row's place 0, 1, 2 ... within its group (by), in the order of the columns."""
    all_ = numbered(frame, *by, *order, name=name)
    first = all_.groupBy(*by).agg(F.min(name).alias("__start"))
    return all_.join(first, by).withColumn(name, F.col(name) - F.col("__start")).drop("__start")


def exact_quantiles(frame: DataFrame, by: list[str], value: str, grid: list[float]) -> DataFrame:
    """(by, q, x): for each group the quantiles at the shares of grid (numbered by q), linear between order statistics.

    Nulls don't count; a group without values has no rows. The values are ranked in sorted ranges, and only those at the
    places that a quantile needs are taken on.
    """
    some = frame.select(*by, F.col(value).cast("double").alias("__x")).filter("__x is not null")
    ranked = group_ranks(some.withColumn("__all", F.lit(0)), [*by, "__all"], ["__x"], name="__rank")
    size = ranked.groupBy(*by, "__all").agg(F.count(F.lit(1)).alias("__n"))
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("h")) for i, p in enumerate(grid)))).alias("p")
    asked = size.select(*by, "__all", places).select(*by, "__all", "p.q", "p.h")
    ends = asked.select(*by, "__all", "q", "h", F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("__rank")).distinct()
    met = ends.join(ranked, [*by, "__all", "__rank"])
    low, high = F.min(F.struct("__rank", "__x")), F.max(F.struct("__rank", "__x"))
    out = met.groupBy(*by, "q", "h").agg(low.alias("low"), high.alias("high"))
    return out.select(*by, "q", (F.col("low.__x") + (F.col("h") - F.floor("h")) * (F.col("high.__x") - F.col("low.__x"))).alias("x"))
