import math
import random

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from chromloom.llm import queries as q
from chromloom.llm import toxicity as tx
from chromloom.llm.mixing import mix_sources


def test_last_table_carries_the_mixture(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, "word " * r.randrange(1, 2000), "en", r.choice(["src0", "src1", "src3", None]), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    want = [x["doc_id"] for x in sorted(mix_sources(docs, q.SOURCE_WEIGHTS, block_chars=q.BLOCK_CHARS).collect(), key=lambda x: (x["__slot"], x["__start"], x["doc_id"]))]
    pipeline.mix(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    out = pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mixed"), "")
    own = out.withColumn("part", F.spark_partition_id()).select("part", "slot", "start_char", "doc_id").collect()
    assert [x["doc_id"] for x in sorted(own, key=lambda x: (x["slot"], x["start_char"], x["doc_id"]))] == want
    # sorted within partitions, whose ranges follow each other
    places = [(x["slot"], x["start_char"]) for x in sorted(own, key=lambda x: x["part"])]
    assert places == sorted(places) and len({x["slot"] for x in own}) > 5


def words(text):
    return (text or "").encode().split()


def shingles(text):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def kept_by_similarity(rows):
    """The smallest id of each class of texts whose shingle sets agree to 0.8, one pair at a time."""
    sets, of = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        return i if of[i] == i else root(of[i])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and (x == y or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y))):
                of[max(root(a), root(b))] = min(root(a), root(b))
    return {i for i in ids if of[i] == i}


def without_passages(rows, n):
    """The words of each text without those of windows of n that start in a text of a smaller id."""
    first, out = {}, {}
    for i, t in sorted(rows):
        for k in range(len(own := words(t)) - n + 1):
            first.setdefault(tuple(own[k : k + n]), i)
    for i, t in rows:
        own = words(t)
        gone = {j for k in range(len(own) - n + 1) if first[tuple(own[k : k + n])] < i for j in range(k, k + n)}
        out[i] = [w for j, w in enumerate(own) if j not in gone]
    return out


def odd_documents(spark):
    r = random.Random(8)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(150).collect()
    long = " ".join(r.choices(["alpha", "beta", "gamma", "delta", "eps"], k=300))
    rows = [tuple(g) for g in given]
    rows += [(90_001, None, None, None, None), (90_002, "", "en", "src0", 0), (90_003, long, "en", "src0", 1), (90_003, long, "en", "src0", 1), (90_004, long + " more", "en", "src1", 1)]
    rows += [(90_005, "one text of this id here", "en", "src1", 1), (90_005, "another text with the same id", "en", "src1", 1), (90_006, "start " * 3 + long[:900] + " end", "en", "src3", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"own {c}") for c in ("p_toxic", "__h", "__slot", "__id", "id", "key", "n rows")})


def test_stages_against_plain_versions(spark):
    docs = odd_documents(spark)
    gone = pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    assert gone.columns == docs.columns and {x["p_toxic"] for x in gone.select("p_toxic").distinct().collect()} == {"own p_toxic"}
    assert gone.filter("doc_id > 90000").count() == 8
    docs = gone.persist()
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    single = [x for x in rows if x[0] != 90_005]
    apart = pipeline.drop_copies(spark, docs, "").persist()
    assert apart.columns == docs.columns
    left = [(x["doc_id"], x["text"]) for x in apart.collect()]
    assert {i for i, _ in left if i != 90_005} == kept_by_similarity(single) and len(left) == len(set(left))
    assert sorted(t for i, t in left if i == 90_005) == ["another text with the same id", "one text of this id here"]
    cut = pipeline.cut_passages(spark, apart.filter("doc_id <> 90005"), "").persist()
    assert cut.columns == docs.columns and all(x["n_chars"] == len(x["text"] or "") for x in cut.collect() if x["text"] is not None)
    want = without_passages([x for x in left if x[0] != 90_005], pipeline.PASSAGE_WORDS)
    assert {x["doc_id"]: words(x["text"]) for x in cut.collect()} == want and sum(map(len, want.values())) < sum(len(words(t)) for _, t in left) - 100
    mixed = pipeline.mix(spark, cut, "").persist()
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, cut.collect()))
    reference = sentencepiece.SentencePieceProcessor(model_file=q.PIECE_MODEL)
    texts = {x["doc_id"]: x["text"] or "" for x in mixed.collect()}
    for x in pipeline.encode(spark, mixed, "").collect():
        assert list(x["ids"]) == reference.encode(texts[x["doc_id"]]) and x["parity"]
    for stage in (pipeline.drop_copies, pipeline.cut_passages, pipeline.mix, pipeline.encode):
        assert stage(spark, docs.limit(0), "").count() == 0


def plain_toxic(chain, text):
    """The last probability of the chain, one text and one feature at a time."""
    own, before = sorted(f for f in tx.features_of(text) if f in chain.words), []
    for m in chain.models:
        odds = m.bias + sum(m.weights[chain.words[f]] for f in own) + sum(w * p for w, p in zip(m.before, before, strict=True))
        before.append(1 / (1 + math.exp(-odds)))
    return before[-1]


def test_toxicity_stage_against_a_plain_loop(spark, tmp_path):
    """Rejects what a plain loop over the fitted chain rejects, planted words among it, and keeps all else as it was."""
    r = random.Random(12)
    clean = [f"{a}{b}" for a in ("lo", "ma", "ne", "ti", "ur") for b in ("ra", "do", "sim", "vek", "pol", "zu")]
    rows, labels = [], []
    for i in range(600):
        own, toxic = r.choices(clean, k=r.randrange(5, 80)), i % 6 == 0
        rows.append((i, " ".join([*own, "vileword", *own[:3]] if toxic else own), "en", "src0", 1))
        if i % 2 == 0 or i % 3:
            labels.append((i, r.randrange(2), int(toxic)))
    planted = {i for i, *_ in rows if i % 6 == 0}
    rows += [(None, "lora vileword", "en", None, 1), (None, "lora", "en", None, 1), (900, None, None, None, None), (901, "", "en", "src1", 0), (5, rows[5][1], "en", "src0", 1), (902, "lora " * 60_000 + "vileword", "en", "src0", 1)]
    spark.createDataFrame([*labels, (None, 1, 1), (7_000, 0, 1), (11, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("p_toxic", F.lit("own"))
    chain = tx.fit_chain(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), q.TOXICITY_CHAIN)
    got = pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(*x, "own") for x in rows if plain_toxic(chain, x[1]) < q.TOXIC_FROM]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = [x["doc_id"] for x in got.collect()]
    assert not planted & set(kept) and 902 not in kept and kept.count(None) == 1  # toxic ones go, without an id or very long too
    assert {i for i, *_ in rows if i is not None} - planted - {902} == {i for i in kept if i is not None} and kept.count(5) == 2
    assert pipeline.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_writes_every_stage(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["slot", "start_char", "doc_id", "source", "n_tokens", "ids", "parity", "round_trip"]
    assert 100 < out.count() < 200 and out.select("doc_id").distinct().count() == out.count()
