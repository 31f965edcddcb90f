import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chromloom.llm import queries as q
from chromloom.llm.resampling import importance_resample, kth_key

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, targets, longest=1):
    """{row number: (doc_id, n_features, weight, score, rank)} by the definition."""

    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % 10_000 for f in runs]

    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in targets for b in features(x)[1])
    all_s, all_t = s.total(), t.total()
    scored = []
    for i, n, f in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([i, len(f), weight, score, None, n])
    mine = sorted((r for r in scored if r[0] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0], r[1]))
    for rank, r in enumerate(mine[: 10 * len(mine) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in scored]


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    out = q.op11_importance_resampling(spark, sf)
    assert dict(out.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    want = plain(rows, targets)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and sum(r[4] is not None for r in want) >= 10


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(spark, longest):
    r = random.Random(4)
    words = ["Alpha", "beta", "gamma9", "é", "x_y", "İ", "ſ", "\x00", "a-b"]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(60)))) for i in range(500)]
    rows += [(None, "alpha " * 30), (None, None), (7, rows[7][1]), (8, "beta " * 40), (900, None), (901, ""), (902, "long " * 30_000)] + [(903, "same text " * 20)] * 40
    targets = ["alpha beta", None, "", "é x é"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "__rank": F.lit(2)}).repartition(6)
    found = importance_resample(docs, spark.createDataFrame([(t,) for t in targets], "text string"), longest=longest)
    assert found.columns == ["doc_id", "text", "key (own)", "__rank (own)", "__features", "__weight", "__score", "__rank"]
    got = [tuple(x) for x in found.select("doc_id", "__features", "__weight", "__score", "__rank").collect()]
    assert sorted(got, key=str) == sorted(plain(rows, targets, longest), key=str)
    assert {x["text"] for x in found.filter("doc_id = 900").collect()} == {None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(i, "one two " * 20) for i in range(30)], "doc_id long, text string")
    assert importance_resample(docs.limit(0), docs).count() == 0
    drawn = importance_resample(docs, docs.limit(0)).filter("__rank is not null").collect()
    assert sorted(x["__rank"] for x in drawn) == [1, 2, 3]
    assert importance_resample(docs.limit(5), docs).filter("__rank is not null").count() == 0


def test_kth_key_is_that_of_a_sort(spark):
    r = random.Random(9)
    rows = [(r.randrange(-40, 40), r.randrange(3), 0) for _ in range(3000)] + [(5, 1, 0)] * 1500
    keys = spark.createDataFrame(rows, "a long, b long, c long").select(F.struct("a", "b", "c").alias("key")).repartition(5)
    order = sorted(rows)
    for k in (1, 2, 700, 2500, 4499, 4500):
        assert kth_key(keys, k) == order[k - 1]
