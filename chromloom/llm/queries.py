"""The registered queries of the text operators: thin, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.llm.common import table

#: op1: words of a window.
REPEAT_WORDS = 13
#: op2: target weights of the sources; those not named weigh 1.
SOURCE_WEIGHTS = {"src0": 4, "src1": 2, "src2": 2, "src3": 3}
BLOCK_CHARS = 50_000
#: op10: the chain of categories over the labels, and the probability from which a document is rejected.
TOXICITY_CHAIN = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
TOXIC_FROM = 0.5
#: op7: the public model file (a parameter; never copied here).
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: op4: (verdict, rule); a host is blocked by links from half of the distrust on that it would have if all hosts were blocked.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URL_DAMPING, URL_ROUNDS, URL_THRESHOLD = 0.85, 8, 0.5
#: op11: percent of the documents of LEAST_WORDS words or more that are drawn, the longest run of words that is a feature, buckets and seed.
DRAW_PERCENT, LEAST_WORDS, FEATURE_WORDS, FEATURE_BUCKETS, DRAW_SEED = 10, 20, 1, 10_000, 2024
#: op12: the public rank file (a parameter; never copied here).
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_sources(docs, SOURCE_WEIGHTS, block_chars=BLOCK_CHARS)
    return mixed.select("doc_id", F.col("__source").alias("source"), F.col("__weight").alias("weight"), F.col("__start").alias("start_char"), F.col("__block").alias("block"), F.col("__release").alias("release"), F.col("__deadline").alias("deadline"), F.col("__slot").alias("slot"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.urls import judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = judge_urls(pages, URL_RULES, URL_DAMPING, URL_ROUNDS, URL_THRESHOLD)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), F.round("trust_share", 9).alias("trust_share"), F.round("distrust_share", 9).alias("distrust_share"))


def op5_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.simhash import hex_fingerprint, near_duplicate_classes

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_duplicate_classes(docs, n=4, radius=4)
    return classes.select(F.col("id").alias("doc_id"), hex_fingerprint().alias("fingerprint"), "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.pieces import encode_pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, PIECE_MODEL).select("doc_id", "n_tokens", "ids", "parity", "round_trip")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.toxicity import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, table(spark, sf_dir, "labels"), TOXICITY_CHAIN)
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= TOXIC_FROM).alias("toxic"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.substrings import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=REPEAT_WORDS, report=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.language_model import lm_scores

    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.hnsw import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.quotes import build_conversations, link_conversations

    linked = link_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return build_conversations(linked)


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.images import image_classes, pictures

    media = pictures(table(spark, sf_dir, "embeddings"))
    return image_classes(media).withColumnRenamed("id", "media_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.resampling import importance_resample

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = importance_resample(docs, table(spark, sf_dir, "benchmark").select("text"), DRAW_PERCENT, LEAST_WORDS, FEATURE_WORDS, FEATURE_BUCKETS, DRAW_SEED, keep=["doc_id"])
    return drawn.select("doc_id", *(F.col(f"__{c}").alias(n) for c, n in (("features", "n_features"), ("weight", "weight"), ("score", "score"), ("rank", "rank"))))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.secret_scan import ACCESS, ASSIGN, HEX, RANDOM, scan_secrets, spans_text

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), RANK_FILE)
    base = F.filter("findings", lambda x: x["kind"] != RANDOM)
    counts = [F.expr(f"cast(size(filter(findings, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in (ASSIGN, ACCESS, HEX, RANDOM)]
    return found.select("doc_id", *counts, F.sha2(F.encode(spans_text(base), "utf-8"), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chromloom.llm.periodic import looped, periodic_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs, keep=["doc_id"], change=looped)
    lines = F.array_join(F.transform("__runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    longest = F.array_min(F.transform("__runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    top = found.withColumn("top", longest)
    return top.select(
        "doc_id", F.size("__runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.n")).alias("length"), F.col("top.period").alias("period"),
        F.expr("(-1000 * top.n) div top.period").alias("exponent_milli"), F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"), F.col("__sha256").alias("collapsed_sha256"),
    )
