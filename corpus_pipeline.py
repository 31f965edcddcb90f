"""A corpus from raw documents to token ids: five stages, each over all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
rereads as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.llm import queries as q
from chromloom.llm.common import set_aside, table, written
from chromloom.llm.mixing import mix_sources, mixture
from chromloom.llm.pieces import encode_pieces
from chromloom.llm.simhash import drop_near_duplicates
from chromloom.llm.substrings import remove_repeats
from chromloom.llm.toxicity import classify
from chromloom.sources.ship import ship_package

#: Words from which on a passage that an earlier document has is cut.
PASSAGE_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below q.TOXIC_FROM, unchanged."""
    ship_package(spark)
    kept, own = set_aside(docs, [f"p_{c}" for c in q.TOXICITY_CHAIN])
    scored = classify(kept, table(spark, sf_dir, "labels"), q.TOXICITY_CHAIN)
    return scored.filter(F.col("p_toxic") < q.TOXIC_FROM).select(*kept.columns).withColumnsRenamed(own)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates (five-word shingles that agree to 0.8), unchanged."""
    ship_package(spark)
    return drop_near_duplicates(docs, n=5, threshold=0.8)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of PASSAGE_WORDS words or more that a document with a smaller id has."""
    ship_package(spark)
    return remove_repeats(docs, window=PASSAGE_WORDS).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which blocks of the sources come by their target weights."""
    return mixture(docs, q.SOURCE_WEIGHTS, block_chars=q.BLOCK_CHARS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the place in the mixture and the ids of the public piece model, with parity and round trip.

    Reading a table back need not keep its order, so slot and start_char are found anew (they depend on the documents
    alone) and stay with the ids; the rows are range-partitioned and sorted by them.
    """
    ship_package(spark)
    placed = mix_sources(docs, q.SOURCE_WEIGHTS, block_chars=q.BLOCK_CHARS).select("doc_id", "source", "text", F.col("__slot").alias("slot"), F.col("__start").alias("start_char"))
    ordered = placed.repartitionByRange("slot", "start_char").sortWithinPartitions("slot", "start_char")
    return encode_pieces(ordered, q.PIECE_MODEL, forget=True).select("slot", "start_char", "doc_id", "source", "n_tokens", "ids", "parity", "round_trip")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("repeated_passages", cut_passages), ("mixing", mix), ("pieces", encode)]

#: SQL has neither the classifier nor the fingerprints and piece ids; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
