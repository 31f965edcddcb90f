"""What __spark_entry__ adds for this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from chromloom.llm import oracles, queries
from chromloom.sources.ship import ship_package


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship_package(spark), sf_dir)

    return run


QUERIES = {n: _shipped(getattr(queries, n)) for n in sorted((x for x in dir(queries) if x.startswith("op")), key=lambda x: int(x[2:].split("_")[0]))}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op1_substring_dedup": oracles._op1(), "op2_source_mixing": oracles._op2(), "op4_url_filter": oracles._op4()}
