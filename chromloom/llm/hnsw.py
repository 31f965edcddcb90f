"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph for each shard of the vectors.

Rows go to shards by a hash of their id: SHARD_ROWS of them each (fewer if the vectors are long), or fewer still, down to
SMALL_SHARD, as long as there are no more than FEW_SHARDS. That depends on the rows alone, and so does the result. A shard's graph is stored as one row of flat arrays: its ids, vectors and, for each
layer, a table of neighbour numbers. Equal vectors of a shard are one node (its ids ranked), so that thousands of copies
make no clique. Each node's top layer is drawn with a sixteenth of the nodes going one up; nodes are numbered from the top
layer down, so a layer is the nodes below a number.

The graph is built by insertion, a batch of nodes at a time: each new node is searched for in the graph of those before
it, from the node found on the layer above; of the nodes found it gets as neighbours those that are nearer to it than to
any neighbour it already has, and is entered as a neighbour of its neighbours, which keep the best by the same rule.

Queries go in blocks of QUERY_BLOCK to every shard. A search walks down the layers and then keeps the `ef` nearest nodes found
on the ground layer, for many queries at once; scores are exact cosines of the original vectors in double precision. The
shards' answers are merged by rank. The work is one walk for each query and shard; a block's vectors and a shard's
arrays meet in one row, which the walks of a whole block outweigh.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromloom.llm.common import discard, written

#: Rows of a shard, and the bytes of its vectors, at most; rows from which on it may be one of several, and of how many then.
SHARD_ROWS, SHARD_BYTES, SMALL_SHARD, FEW_SHARDS = 65_536, 1 << 27, 4_096, 8
QUERY_BLOCK, AT_ONCE = 2_048, 512
#: Neighbours of a node on the ground layer and above; nodes kept in a search when building and when asking.
GROUND, UPPER, BUILD_EF, EF = 32, 16, 64, 384


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec: array of doubles, -0.0 as 0.0): without rows whose vector is null, zero or holds null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(sound)


def spread_neighbours(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    """Up to `keep` of each node's candidates (-1: none): first those nearer to the node than to any chosen before, then the nearest of the rest."""
    to_node = np.where(cand >= 0, np.einsum("ncd,nd->nc", x[cand], x[nodes]), -np.inf)
    order = np.argsort(-to_node, axis=1, kind="stable")
    cand, to_node = np.take_along_axis(cand, order, 1), np.take_along_axis(to_node, order, 1)
    v = x[cand]
    among = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(cand.shape, bool)
    closest = np.full(cand.shape, -2.0, np.float32)  # similarity of each candidate to the neighbours chosen so far
    count = np.zeros(len(nodes), np.int64)
    for j in range(cand.shape[1]):
        take = (closest[:, j] < to_node[:, j]) & (count < keep) & (cand[:, j] >= 0)
        chosen[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, among[:, j, :]), closest)
    best = np.argsort(~chosen, axis=1, kind="stable")[:, :keep]
    out = np.full((len(nodes), keep), -1, np.int64)
    out[:, : best.shape[1]] = np.take_along_axis(cand, best, 1)
    return out


def link_back(x: np.ndarray, table: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Enters new nodes as neighbours of those they chose; a full list keeps the best of old and new."""
    i, j = np.nonzero(chosen >= 0)
    into, source = chosen[i, j], new[i]
    order = np.argsort(into, kind="stable")
    into, source = into[order], source[order]
    targets, starts, n = np.unique(into, return_index=True, return_counts=True)
    have = (table[targets] >= 0).sum(axis=1)
    slot = np.arange(len(into)) - np.repeat(starts, n) + np.repeat(have, n)
    room = np.repeat(have + n <= table.shape[1], n)
    table[into[room], slot[room]] = source[room]
    full = np.flatnonzero(have + n > table.shape[1])
    for a in range(0, len(full), 256):
        some = full[a : a + 256]
        cand = np.full((len(some), table.shape[1] + n[some].max()), -1, np.int64)
        cand[:, : table.shape[1]] = table[targets[some]]
        for r, t in enumerate(some):
            cand[r, table.shape[1] : table.shape[1] + n[t]] = source[starts[t] : starts[t] + n[t]]
        table[targets[some]] = spread_neighbours(x, targets[some], cand, table.shape[1])


def layer_graph(x: np.ndarray, keep: int, entries: np.ndarray) -> np.ndarray:
    """Neighbour table (nodes x keep, -1: none) of one layer over unit vectors x, built by inserting them in order; entries: where each node's search starts (-1: at node 0)."""
    n = len(x)
    table = np.full((n, keep), -1, np.int64)
    done = 0
    while done < n:
        end = min(n, max(2 * done, 64), done + AT_ONCE)
        new = np.arange(done, end)
        sims = x[new] @ x[new].T
        np.fill_diagonal(sims, -np.inf)
        c = min(BUILD_EF // 2, len(new) - 1)
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c] + done if c else np.zeros((len(new), 0), np.int64)
        if done:
            start = np.where((entries[new] >= 0) & (entries[new] < done), entries[new], 0)[:, None]
            near = np.concatenate([near, walk(x[:done], table[:done], x[new], start, min(BUILD_EF, done))], axis=1)
        if near.shape[1]:
            chosen = spread_neighbours(x, new, near, keep // 2)
            table[new, : keep // 2] = chosen
            link_back(x, table, new, chosen)
        done = end
    return table.astype(np.int32)


def build_index(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Flat arrays of one shard. ids and vectors: original rows."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    nodes, node_of = np.unique(vectors, axis=0, return_inverse=True)
    top = np.floor(-np.log(1 - np.random.default_rng(len(nodes)).random(len(nodes))) / np.log(16)).astype(np.int64)
    shuffled = np.random.default_rng(len(nodes) + 1).permutation(len(nodes))
    by_layer = shuffled[np.argsort(-top[shuffled], kind="stable")]
    nodes, top = nodes[by_layer], top[by_layer]
    number = np.empty(len(nodes), np.int64)
    number[by_layer] = np.arange(len(nodes))
    node_of = number[node_of.ravel()]
    members = np.argsort(node_of, kind="stable")
    starts = np.searchsorted(node_of[members], np.arange(len(nodes) + 1))
    unit = unit_of(nodes)
    tables: list[np.ndarray] = []  # from the top layer down
    entries = np.full(len(nodes), -1, np.int64)
    for depth in range(int(top.max()), -1, -1):
        size = int((top >= depth).sum())
        tables.append(layer_graph(unit[:size], GROUND if depth == 0 else UPPER, entries[:size]))
        for a in range(size, len(nodes) if depth else size, AT_ONCE):  # where the nodes of lower layers start
            start = np.maximum(entries[a : a + AT_ONCE], 0)[:, None]
            entries[a : a + AT_ONCE] = walk(unit[:size], tables[-1], unit[a : a + AT_ONCE], start, 1)[:, 0]
    return {"ids": ids[members], "starts": starts.astype(np.int32), "vectors": nodes, "unit": unit, "tables": tables}


def unit_of(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def walk(x: np.ndarray, table: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> np.ndarray:
    """The ef nearest nodes found from `entry` (queries x start nodes, -1: none), nearest first (-1: none), for all queries at once."""
    n, m = len(q), len(x)
    seen = np.zeros((n, m), bool)
    best = np.full((n, ef), -1, np.int64)
    sims = np.full((n, ef), -np.inf, np.float32)
    done = np.ones((n, ef), bool)
    rows = np.arange(n)

    def put(who: np.ndarray, nodes: np.ndarray) -> None:
        fresh = (nodes >= 0) & ~seen[who[:, None], np.maximum(nodes, 0)]
        first = np.ones(nodes.shape, bool)
        if nodes.shape[1] > 1:  # a node may be listed twice
            o = np.argsort(nodes, axis=1, kind="stable")
            s = np.take_along_axis(nodes, o, 1)
            same = np.concatenate([np.zeros((len(who), 1), bool), s[:, 1:] == s[:, :-1]], axis=1)
            np.put_along_axis(first, o, ~same, 1)
        fresh &= first
        i, j = np.nonzero(fresh)
        seen[who[i], nodes[i, j]] = True
        s = np.full(nodes.shape, -np.inf, np.float32)
        s[i, j] = np.einsum("nd,nd->n", x[nodes[i, j]], q[who[i]])
        all_nodes = np.concatenate([best[who], np.where(fresh, nodes, -1)], axis=1)
        all_sims = np.concatenate([sims[who], s], axis=1)
        all_done = np.concatenate([done[who], ~fresh], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
        best[who], sims[who], done[who] = (np.take_along_axis(a, top, 1) for a in (all_nodes, all_sims, all_done))

    put(rows, entry)
    while True:
        who = np.flatnonzero(~done.all(axis=1))
        if not len(who):
            return best
        # the nearest nodes of each query that are not expanded yet, a few at a time
        at = np.argsort(done[who], axis=1, kind="stable")[:, :4]
        nodes = np.where(np.take_along_axis(done[who], at, 1), -1, np.take_along_axis(best[who], at, 1))
        sub = done[who]
        np.put_along_axis(sub, at, True, 1)
        done[who] = sub
        next_nodes = np.where(nodes[:, :, None] >= 0, table[np.maximum(nodes, 0)], -1).reshape(len(who), -1).astype(np.int64)
        put(who, next_nodes)


def search_index(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF) -> list[tuple[int, int, float]]:
    """(query number, id, cosine) of the k nearest rows found for each query, its own row (one of its id and vector) left out."""
    out = []
    for a in range(0, len(queries), AT_ONCE):
        own_ids, own = query_ids[a : a + AT_ONCE], queries[a : a + AT_ONCE]
        q = unit_of(own)
        found = np.zeros((len(q), 1), np.int64)
        for depth, table in enumerate(index["tables"]):
            found = walk(index["unit"][: len(table)], table, q, found, min(8 if depth + 1 < len(index["tables"]) else ef, len(table)))
        for n, (qi, vector, nodes) in enumerate(zip(own_ids.tolist(), own, found, strict=True), a):
            nodes = nodes[nodes >= 0]
            ranked = []
            for node, score in zip(nodes.tolist(), cosines(index["vectors"][nodes], vector).tolist(), strict=True):
                members = index["ids"][index["starts"][node] : index["starts"][node + 1]]
                lo = int(np.searchsorted(members, qi))
                own_row = lo < len(members) and members[lo] == qi and np.array_equal(index["vectors"][node], vector)
                others = members[lo + bool(own_row) :][:k]
                ranked += [(-score, i) for part in (members[:lo][:k], others) for i in part.tolist()]
            out += [(n, i, -s) for s, i in sorted(ranked)[:k]]
    return out


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of v with q in double precision; scaled first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    q = q / np.abs(q).max()
    return (v @ q) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


FLAT = "shard long, dim int, ids binary, starts binary, vectors binary, tables array<binary>"


def build_shards(vectors: DataFrame, n_shards: int) -> DataFrame:
    """One row of flat arrays for each shard; vectors: (id, vec), all of one length."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        i = build_index(pdf["id"].to_numpy(np.int64), x)
        flat = {n: [np.ascontiguousarray(i[n]).tobytes()] for n in ("ids", "starts", "vectors")}
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [x.shape[1]], **flat, "tables": [[np.ascontiguousarray(a).tobytes() for a in i["tables"]]]})

    keyed = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)))
    return keyed.groupBy("shard").applyInPandas(build, FLAT)


def opened(row: pd.Series) -> dict:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, int(row["dim"]))
    last = len(row["tables"]) - 1
    tables = [np.frombuffer(b, np.int32).reshape(-1, GROUND if depth == last else UPPER) for depth, b in enumerate(row["tables"])]
    return {"ids": np.frombuffer(row["ids"], np.int64), "starts": np.frombuffer(row["starts"], np.int32), "vectors": vectors, "unit": unit_of(vectors), "tables": tables}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest rows found by cosine, ties to the smaller id.

    queries: a DataFrame like vectors; each of its rows gets ranks of its own, also where ids repeat. Vectors that are
    null, zero or hold null or non-finite components take no part on either side, nor do those whose length differs from
    the most common one, nor rows with a null id. Candidates are all rows but the query's own: of the rows with its id and its
    vector one is left out. Rows that repeat an id are a candidate each.
    Other columns are left out, whatever their names. Empty tables give an empty result. shard_rows: rows of a shard.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d, n = (lengths[0]["d"], lengths[0]["n"]) if lengths else (1, 0)
    rows, asked = rows.filter(F.size("vec") == d), asked.filter(F.size("vec") == d)
    most = shard_rows or max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * d)))
    n_shards = max(1, -(-n // most), 0 if shard_rows else min(FEW_SHARDS, -(-n // SMALL_SHARD)))
    shards = written(build_shards(rows, n_shards))
    numbered = written(asked.withColumn("q", F.monotonically_increasing_id()))
    blocks = numbered.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-numbered.count() // QUERY_BLOCK)))))
    blocks = written(blocks.groupBy("block").agg(F.collect_list(F.struct("q", "id", "vec")).alias("members")))  # about QUERY_BLOCK of them each
    tasks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, row in f.iterrows():
                q, ids = (np.asarray([m[c] for m in row["members"]], np.int64) for c in ("q", "id"))
                x = np.asarray([m["vec"] for m in row["members"]], np.float64)
                found = pd.DataFrame(search_index(opened(row), ids, x, k), columns=["at", "id", "score"])
                at = found["at"].to_numpy(np.int64)
                yield pd.DataFrame({"q": q[at], "query_id": ids[at], "id": found["id"].to_numpy(np.int64), "score": found["score"].to_numpy(np.float64)})

    found = tasks.join(shards, "shard").mapInPandas(search, "q long, query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    out = written(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score"))
    for used in (shards, numbered, blocks):
        discard(used)
    return out
