import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom.llm import queries as q
from chromloom.llm.periodic import follows, looped, periodic_runs, run_tiles, stride, tile_fragments, z_function


def plain_runs(words, least=6, exponent=4):
    """(start, length, period) by comparing the words of every distance."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, length, p) for (s, length), p in found.items())


def changed(words, doc_id):
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = changed((text or "").encode().split(), doc_id)
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    own = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *own, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def odd_texts():
    r = random.Random(5)
    texts = [None, "", " ", "a", "a " * 5, "a " * 6, "a " * 4000, "a b " * 3, "a b " * 4, "a b " * 4 + "a", "x " + "a b c " * 50 + "y", "é ü é ü é ü é ü z", "a\tb\na\rb a\x0bb a\x0cb"]
    texts += ["a b a b a b a b c " * 5, "a a a a a a b " * 4, "q " * 7 + "w e " * 9 + "q " * 8, "one\x00two three " * 6]
    texts += [" ".join(r.choices("ab", k=r.randrange(5, 400))) for _ in range(150)]
    for _ in range(60):
        block = r.choices("abcdefgh", k=r.randrange(1, 40))
        texts.append(" ".join(r.choices("uvw", k=r.randrange(0, 30)) + (block * 9)[: r.randrange(1, 9 * len(block))] + r.choices("xyz", k=r.randrange(0, 30))))
    return texts


def test_runs_collapse_and_digests_against_a_plain_search(spark, tmp_path):
    rows = list(enumerate(odd_texts()))
    rows += [(None, "a b " * 9), (3, "c d e " * 7), (3, "c d e " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("period", F.lit("own")).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in q.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 100


def test_given_documents_and_odd_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r[0]: (r[1], r[7]) for r in (expected(x["doc_id"], x["text"]) for x in docs.collect())}
    found = periodic_runs(docs.withColumns({"runs": F.lit(1), "__key": F.lit(2)}), change=looped)
    assert found.columns == ["doc_id", "text", "runs (own)", "__key (own)", "__n", "__runs", "__sha256"]
    assert {r["doc_id"]: (len(r["__runs"]), r["__sha256"]) for r in found.collect()} == want
    assert sum(n for n, _ in want.values()) > 5
    assert periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_z_function_and_tiles(seed):
    r = random.Random(seed)
    s = r.choices([1, 2], k=200)
    z = z_function(s)
    assert z == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    s = s[:70] + [1, 2, 3] * 30 + s[160:]
    kept, every = set(run_tiles(np.asarray(s, np.int32))), 0
    for octave in (1, 2, 4, 8, 16):
        fits = {c: [p for p in range(octave, min(2 * octave, 51)) if c + p + int(follows(p, octave)) <= 200 and s[c : c + follows(p, octave)] == s[c + p : c + p + follows(p, octave)]] for c in range(0, 200, octave)}
        for c, own in fits.items():
            tile = (octave, c, min(200, c + (4 + stride(octave)) * octave)) in kept
            every += bool(own)
            assert own or not tile
            if own and not tile:  # inside a stretch of boundaries of which others are kept
                assert all(p in fits[c - octave] and p in fits[c + octave] for p in own) and c // octave % stride(octave)
            first, end = max(0, c - octave), min(200, c + (4 + stride(octave)) * octave)
            for p, a, b in tile_fragments(s[first:end], c - first, octave):
                a, b = a + first, b + first
                assert all(s[i] == s[i + p] for i in range(a, b - p)) and (a == first or s[a - 1] != s[a - 1 + p]) and (b == end or s[b] != s[b - p])
    assert len(kept) < every and set(run_tiles(np.asarray(s, np.int32), 7)) == kept
