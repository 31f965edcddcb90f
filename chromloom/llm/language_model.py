"""N-gram language-model scores from Elias-Fano tries.

Every word, bigram and trigram of the training texts is kept, whatever their number: nothing is pruned. p(w) is the
add-one unigram estimate, and longer contexts are smoothed towards shorter ones with PRIOR pseudo-counts:
p(w|ctx) = (c(ctx w) + PRIOR * p(w|shorter ctx)) / (c(ctx) + PRIOR).

Batches. Texts are split into words once and stored as batches of about BATCH_TOKENS tokens: the batch's distinct words by
64-bit hashes (XXH3) and the tokens as numbers of these. All that is shuffled afterwards is compressed arrays of a batch's
distinct n-grams, so a frequent n-gram appears once for each batch, not once for each occurrence.

Levels. For each order, a batch asks the shards that own its distinct n-grams, with their training counts in the batch;
the shard adds the counts of all batches, builds its part of the level and answers, and the batch is written anew with the
answers. Words are dealt by their hash and get a number that stands for them from then on, longer n-grams by their context; a context with more than SPLIT occurrences is dealt to the more shards the more it has
(its total is known from the order below), so that no context makes a shard grow. The number of shards grows with the
tokens. A shard's level is a trie of Elias-Fano sequences in one flat file that is mapped into memory: pointers from each
context to its successors, the successors in increasing order, and log probabilities and back-offs in 16 bits (steps of
STEP, so they add up as they are). An n-gram is found by searching the successors between its context's pointers.

Words whose hashes agree would be counted as one (0.03 such pairs are expected among a billion different words); longer
n-grams are told apart by the numbers of their words.
"""

from __future__ import annotations

import json
import tempfile
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import discard, frugal, give_back, written
from chromloom.llm.elias_fano import EliasFano

PRIOR = 2.0
#: Of log10 probabilities, between codes.
STEP = 1 / 4096
#: Tokens of a batch (a longer text is cut into pieces that know the two tokens before them) and, on average, of a shard.
BATCH_TOKENS, SHARD_TOKENS = 1 << 20, 1 << 20
#: Occurrences of a context for each of the shards that it is dealt to.
SPLIT = 1 << 16
#: N-grams that are searched for at a time.
FOUND = 1 << 16
END = b""  # no word is empty
U64 = np.uint64
#: Multipliers of the splitmix64 hash (fixed values).
MIX1, MIX2, MIX3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U64(30)) * MIX1
    x = (x ^ x >> U64(27)) * MIX2
    return x ^ x >> U64(31)


def tokens_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words and the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of the log10 of probabilities, down to 1e-16."""
    return np.minimum(np.rint(-np.log10(np.minimum(p, 1.0)) / STEP), 65535).astype(np.uint16)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and the number of each key among them; np.unique() takes about twice the memory."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first, keys = order[new], keys[new]
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    inverse = np.empty(len(order), np.int32)
    inverse[order] = number
    return keys, first, inverse


ZSTD = pa.Codec("zstd", 1)


def packed(a: np.ndarray) -> bytes:
    """The array's length and its bytes by significance, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
    return len(a).to_bytes(8, "little") + ZSTD.compress(planes.tobytes(), asbytes=True) if len(a) else b""


def unpacked(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(ZSTD.decompress(data[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


class Level:
    """One shard's level of the trie, over a flat file: an eight-byte length, a JSON header and arrays from multiples of 8 bytes."""

    def __init__(self, file: np.ndarray):
        size = int.from_bytes(bytes(file[:8]), "little")
        head, body = json.loads(bytes(file[8 : 8 + size])), file[8 + size :]
        self.meta = head["meta"]
        self.arrays = {name: body[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (at, kind, n) in head["arrays"].items()}
        self.pointers, self.successors = (EliasFano(*self.meta[n], *(self.arrays[f"{n}_{part}"] for part in ("low", "high", "ones"))) for n in ("pointers", "successors"))

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, count: np.ndarray, lower: np.ndarray, totals: np.ndarray, words: int) -> bytes:
        """A file of n-grams (context and word numbers, sorted by both, with count and the code of the lower order's probability); totals: occurrences of each context."""
        sequences = {"pointers": np.searchsorted(context, np.arange(len(totals) + 1)), "successors": context * words + word}
        arrays: dict[str, np.ndarray] = {}
        meta: dict = {"words": words}
        for name, values in sequences.items():
            e = EliasFano.of(values)
            meta[name] = [e.n, e.width]
            arrays |= {f"{name}_low": e.low, f"{name}_high": e.high, f"{name}_ones": e.ones}
        arrays["prob"] = quantise((count + PRIOR * 10 ** (-STEP * lower)) / (totals[context] + PRIOR))
        arrays["back"] = quantise(PRIOR / (totals + PRIOR))
        head, at = {"meta": meta, "arrays": {}}, 0
        for name, a in arrays.items():
            head["arrays"][name] = [at, a.dtype.str, len(a)]
            at += a.nbytes + -a.nbytes % 8
        raw = json.dumps(head).encode()
        raw += b" " * (-len(raw) % 8)
        return b"".join([len(raw).to_bytes(8, "little"), raw, *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())])

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of the n-grams, or -1: each is searched among the successors of its context."""
        lo, end = self.pointers.get(context), self.pointers.get(context + 1)
        want = context * self.meta["words"] + word
        hi = end.copy()
        going = np.flatnonzero(lo < hi)
        while len(going):
            mid = (lo[going] + hi[going]) >> 1
            less = self.successors.get(mid) < want[going]
            lo[going] = np.where(less, mid + 1, lo[going])
            hi[going] = np.where(less, hi[going], mid)
            going = going[lo[going] < hi[going]]
        out = np.full(len(want), -1, np.int64)
        there = np.flatnonzero(lo < end)
        there = there[self.successors.get(lo[there]) == want[there]]
        out[there] = lo[there]
        return out

    def codes(self, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The code of log10 p(word | context), where lower is that of the shorter context; FOUND n-grams at a time."""
        out = np.empty(len(context), np.uint16)
        for at in range(0, len(out), FOUND):
            own = slice(at, at + FOUND)
            place = self.find(context[own], word[own])
            part = np.minimum(self.arrays["back"][context[own]].astype(np.int64) + lower[own], 65535)
            part[place >= 0] = self.arrays["prob"][place[place >= 0]]
            out[own] = part
        return out


def mapped(data: bytes) -> np.ndarray:
    """The bytes as a file of the task, mapped into memory; it goes with its last user."""
    with tempfile.TemporaryFile(prefix="chromloom-") as f:
        f.write(data)
        f.flush()
        return np.memmap(f, np.uint8, "r")


# --- batches --------------------------------------------------------------------------------------------------------

BATCH = pa.schema([("batch", pa.int64()), ("n_tokens", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("tokens", pa.binary())])
BATCH_SQL = "batch long, n_tokens long, rows array<long>, ids array<string>, held array<boolean>, sizes array<long>, words binary, tokens binary"
#: What stays of a batch once its words are numbered.
BATCH_FIELDS = {"batch": "long", "rows": "array<long>", "ids": "array<string>", "held": "array<boolean>", "sizes": "array<long>", "tokens": "binary"}


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokenised(docs: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Batches of (id, text, held_out): each row of docs has a number of its own, and each piece two tokens of context before it (-1: none)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        row = part << 40
        numbers, tokens, pieces = _Numbers(), array("i"), []

        def flush() -> pa.RecordBatch:
            nonlocal made
            made += 1
            rows, ids, held, sizes = ([list(v)] for v in zip(*pieces, strict=True))
            words = packed(np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), U64, len(numbers)))
            values = [[(part << 24) + made], [sum(sizes[0])], rows, ids, held, sizes, [words], [packed(np.frombuffer(tokens, np.int32))]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BATCH, strict=True)], schema=BATCH)

        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                for i, text, held in zip(*(c.to_pylist() for c in whole.slice(start, 200).columns), strict=True):
                    own = tokens_of(text)
                    for at in range(0, len(own), batch_tokens):
                        piece = own[at : at + batch_tokens]
                        tokens.extend([numbers[w] for w in own[at - 2 : at]] if at else [-1, numbers[END]])
                        tokens.extend(map(numbers.__getitem__, piece))
                        pieces.append((row, i, held, len(piece)))
                        if len(tokens) >= batch_tokens:
                            yield flush()
                            numbers, tokens, pieces = _Numbers(), array("i"), []
                    row += 1
        if pieces:
            yield flush()

    return docs.select("id", "text", "held_out").mapInArrow(run, BATCH_SQL)


class Batch:
    """A batch's n-grams as numbers, found alike whenever the batch is read. What has an entry for each token or n-gram is kept in 32 bits or fewer, keys apart."""

    def __init__(self, row: pd.Series):
        self.row, self.tokens = row, unpacked(row["tokens"], np.int32)
        self.n_words = int(self.tokens.max()) + 1
        self.sizes, self.held = np.asarray(row["sizes"], np.int64), np.asarray(row["held"], bool)
        ends = np.cumsum(self.sizes + 2)
        self.begins = ends - self.sizes - 2
        self.inner = np.ones(len(self.tokens), bool)  # tokens that are scored
        self.inner[self.begins] = self.inner[self.begins + 1] = False
        self.learned = self.inner & np.repeat(~self.held, self.sizes + 2)

    def unigrams(self) -> np.ndarray:
        """Training counts of the words."""
        return np.bincount(self.tokens[self.learned], minlength=self.n_words)

    def bigrams(self, split: int) -> None:
        """pair_of: each token's bigram (-1: none); pair_first, pair_word: their words; pair_n: training counts; pair_key: what they are dealt by."""
        self.numbers, self.counts = unpacked(self.row["numbers"], np.int64), unpacked(self.row["counts"], np.int64)
        ask = self.inner.copy()
        ask[self.begins + 1] = self.tokens[self.begins] >= 0  # the context of a later piece
        before = np.append(ask[1:], False)
        keys, _, inverse = grouped(self.tokens[before].astype(np.int64) * self.n_words + self.tokens[ask])
        self.pair_of = np.full(len(self.tokens), -1, np.int32)
        self.pair_of[ask] = inverse
        self.pair_first, self.pair_word = (keys // self.n_words).astype(np.int32), (keys % self.n_words).astype(np.int32)
        self.pair_n = np.bincount(inverse[self.learned[ask]], minlength=len(keys)).astype(np.int32)
        del keys, inverse
        self.pair_key = context_key(self.numbers[self.pair_first].astype(U64), self.numbers[self.pair_word], self.counts[self.pair_first], split)

    def trigrams(self, split: int) -> None:
        """triple_at: whether a token's context of two was learned; triple_of: the trigrams of these; triple_pair, triple_word: first two words and last; triple_last: the last two; triple_n, triple_key."""
        self.pair_counts, self.pair_codes = unpacked(self.row["pair_counts"], np.int64), unpacked(self.row["pair_codes"], np.uint16)
        del self.pair_n, self.pair_key  # only the level before asks for them
        before = np.append(np.int32(-1), self.pair_of[:-1])
        self.triple_at = self.inner & (before >= 0) & (self.pair_counts > 0)[before]
        keys, first, self.triple_of = grouped(before[self.triple_at].astype(np.int64) * self.n_words + self.tokens[self.triple_at])
        self.triple_last = self.pair_of[self.triple_at][first]
        self.triple_pair, self.triple_word = (keys // self.n_words).astype(np.int32), (keys % self.n_words).astype(np.int32)
        self.triple_n = np.bincount(self.triple_of[self.learned[self.triple_at]], minlength=len(keys)).astype(np.int32)
        del keys, first, before
        numbers = self.numbers.astype(U64)
        pairs = mixed(numbers[self.pair_first] * MIX3 + numbers[self.pair_word])
        self.triple_key = context_key(pairs[self.triple_pair], self.numbers[self.triple_word], self.pair_counts[self.triple_pair], split)


def dealt(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): the numbers of n-grams by shard, and where each shard begins."""
    shard = ((mixed(key) >> U64(32)) * U64(shards) >> U64(32)).astype(np.min_scalar_type(shards))
    return np.argsort(shard, kind="stable"), np.append(0, np.cumsum(np.bincount(shard, minlength=shards)))


def context_key(context: np.ndarray, word: np.ndarray, totals: np.ndarray, split: int) -> np.ndarray:
    """What an n-gram is dealt by: its context, and for frequent contexts a part of it."""
    parts = (1 + totals // split).astype(U64)
    parts[parts > 1] = mixed(word[parts > 1].astype(U64)) % parts[parts > 1]
    parts[totals < split] = U64(0)
    return context + parts * MIX3


#: What a batch asks a shard: words (level 1: hashes, then numbers) and training counts; for longer n-grams, their contexts of one
#: or two words with how many n-grams follow each and its total, and for each n-gram the code of its lower order's probability.
ASK = ["words", "n", "first", "second", "lengths", "totals", "lower"]
ASK_SQL = "shard long, batch long, " + ", ".join(f"{c} binary" for c in ASK)
REPLY_SQL = "batch long, shard long, counts binary, values binary, total long, distinct long"


def ask_for_words(b: Batch, shards: int) -> pd.DataFrame:
    words, n = unpacked(b.row["words"], U64), b.unigrams().astype(np.int32)
    order, bounds = dealt(words, shards)
    rows = [{"shard": s, "batch": b.row["batch"], **dict.fromkeys(ASK, b""), "words": packed(words[own]), "n": packed(n[own])} for s in range(shards) if len(own := order[bounds[s] : bounds[s + 1]])]
    return pd.DataFrame(rows, columns=["shard", "batch", *ASK])


def ask_for_ngrams(b: Batch, key: np.ndarray, shards: int, context: np.ndarray, sides: list[np.ndarray], totals: np.ndarray, word: np.ndarray, n: np.ndarray, lower: np.ndarray) -> pd.DataFrame:
    """context: a number for each n-gram, equal ones side by side; sides and totals: the contexts' words and totals by number."""
    order, bounds = dealt(key, shards)
    rows = []
    for s in range(shards):
        own = order[bounds[s] : bounds[s + 1]]
        if len(own):
            starts = np.flatnonzero(np.append(True, context[own][1:] != context[own][:-1]))
            met = context[own[starts]]
            arrays = {"words": word[own], "n": n[own].astype(np.int32), "lengths": np.diff(np.append(starts, len(own))).astype(np.int32), "totals": totals[met], "lower": lower[own].astype(np.uint16)}
            arrays |= {c: side[met] for c, side in zip(("first", "second"), sides, strict=False)}
            rows.append({"shard": s, "batch": b.row["batch"], **dict.fromkeys(ASK, b""), **{c: packed(a) for c, a in arrays.items()}})
    return pd.DataFrame(rows, columns=["shard", "batch", *ASK])


def answers(replies: pd.DataFrame, key: np.ndarray, shards: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(counts, values) of the n-grams that were asked for with the same key."""
    order, _ = dealt(key, shards)
    own = replies.sort_values("shard")
    out = []
    for name, of in (("counts", np.int64), ("values", kind)):
        got = np.concatenate([np.zeros(0, of), *(unpacked(x, of) for x in own[name])])
        values = np.zeros(len(key), of)
        if len(got):
            values[order] = got
        out.append(values)
    return out[0], out[1]


def reply(pdf: pd.DataFrame, ends: np.ndarray, counts: np.ndarray | None, values: np.ndarray) -> pd.DataFrame:
    """A row for each batch that asked; its n-grams end at the next of ends."""
    cut = lambda a: [packed(x) for x in np.split(a, ends[:-1])] if a is not None else b""
    return pd.DataFrame({"batch": pdf["batch"], "shard": pdf["shard"], "counts": cut(counts), "values": cut(values), "total": 0, "distinct": 0})


def count_words(shards: int):
    """Level 1: the training counts and numbers of a shard's words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpacked(b, U64) for b in pdf["words"]]
        words, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([unpacked(b, np.int32) for b in pdf["n"]]), len(words)).astype(np.int64)
        out = reply(pdf, np.cumsum([len(a) for a in asked]), counts[inverse], inverse * shards + int(pdf["shard"].iloc[0]))
        out.loc[out.index[0], ["total", "distinct"]] = [int(counts.sum()), int((counts > 0).sum())]
        return out

    return run


def score_shard(level: int):
    """Levels 2 and 3: builds a shard's part of the trie and looks up all that the batches ask for."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda name, kind: np.concatenate([unpacked(x, kind) for x in pdf[name]])
        number = read("first", np.int64)
        if level == 3:
            second = read("second", np.int64)
            number = number * (int(second.max()) + 1) + second
            del second
        contexts, _, number = grouped(number)
        totals = np.zeros(len(contexts))
        totals[number] = read("totals", np.int64)
        del contexts
        asked = [unpacked(x, np.int64) for x in pdf["words"]]
        ends = np.cumsum([len(x) for x in asked])
        words, _, word = grouped(np.concatenate(asked))
        del asked
        n_words = len(words)
        del words
        key = np.repeat(number.astype(np.int64) * n_words, read("lengths", np.int32))
        key += word
        del number, word
        keys, first, place = grouped(key)
        del key
        lower = read("lower", np.uint16)[first].astype(np.int32)
        del first
        count = np.bincount(place, read("n", np.int32), len(keys))
        own, follow = keys // n_words, keys % n_words
        del keys
        kept = count > 0
        trie = Level(mapped(Level.build(own[kept], follow[kept], count[kept], lower[kept], totals, n_words)))
        counts = count.astype(np.int64)[place] if level == 2 else None
        del count, kept
        return reply(pdf, ends, counts, trie.codes(own, follow, lower)[place])

    return run


def by_shard(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """work, a function of a shard's requests, that gives its memory back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = work(pdf)
        give_back()
        return out

    return run


def by_batch(work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The same for a function of a batch and its replies."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = work(left, right)
        give_back()
        return out

    return run


def held_out_of(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def lm_scores(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH_TOKENS, shard_tokens: int = SHARD_TOKENS, split: int = SPLIT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, learning from those not held out.

    Null texts count as empty: one end token. Rows with a null id are scored (and learned from). Rows that repeat are each
    learned from and scored. Texts of any length are scored whole. Without training rows every token is unknown. Other
    columns of docs are left out, whatever their names. An empty table gives an empty result.
    """
    held = held_out_of(id_col) if held_out is None else held_out
    parted = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    batches = written(tokenised(parted, batch_tokens))
    n_shards = max(1, -(-(batches.agg(F.sum("n_tokens")).first()[0] or 0) // shard_tokens))

    def asking(ask):
        @frugal
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for _, row in f.iterrows():
                    yield ask(Batch(row))
                    give_back()

        return run

    def answered(table: DataFrame, replies: DataFrame, put, columns: dict[str, str]) -> DataFrame:
        """The batches with what put() makes of their replies, in place of the tables that it came from."""
        fields = BATCH_FIELDS | columns

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return left.assign(**{c: [v] for c, v in put(Batch(left.iloc[0]), right).items()})[list(fields)]

        out = written(table.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(by_batch(run), ", ".join(f"{c} {kind}" for c, kind in fields.items())))
        discard(table)
        discard(replies)
        return out

    def number_words(b: Batch, replies: pd.DataFrame) -> dict[str, bytes]:
        counts, numbers = answers(replies, unpacked(b.row["words"], U64), n_shards, np.int64)
        return {"numbers": packed(numbers), "counts": packed(counts)}

    one = written(batches.select("batch", "held", "sizes", "words", "tokens").mapInPandas(asking(lambda b: ask_for_words(b, n_shards)), ASK_SQL).groupBy("shard").applyInPandas(by_shard(count_words(n_shards)), REPLY_SQL))
    sums = one.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).first()
    total, space = int(sums["total"]), float(sums["total"] + sums["distinct"] + 1)
    numbered = answered(batches, one, number_words, {"numbers": "binary", "counts": "binary"})

    def ask_pairs(b: Batch) -> pd.DataFrame:
        b.bigrams(split)
        return ask_for_ngrams(b, b.pair_key, n_shards, b.pair_first, [b.numbers], b.counts, b.numbers[b.pair_word], b.pair_n, quantise((b.counts + 1) / space)[b.pair_word])

    def put_pairs(b: Batch, replies: pd.DataFrame) -> dict[str, bytes]:
        b.bigrams(split)
        counts, codes = answers(replies, b.pair_key, n_shards, np.uint16)
        return {"pair_counts": packed(counts), "pair_codes": packed(codes)}

    two = written(numbered.drop("rows", "ids").mapInPandas(asking(ask_pairs), ASK_SQL).groupBy("shard").applyInPandas(by_shard(score_shard(2)), REPLY_SQL))
    paired = answered(numbered, two, put_pairs, {c: "binary" for c in ("numbers", "counts", "pair_counts", "pair_codes")})

    def ask_triples(b: Batch) -> pd.DataFrame:
        b.bigrams(split)
        b.trigrams(split)
        return ask_for_ngrams(b, b.triple_key, n_shards, b.triple_pair, [b.numbers[b.pair_first], b.numbers[b.pair_word]], b.pair_counts, b.numbers[b.triple_word], b.triple_n, b.pair_codes[b.triple_last])

    def summed(left: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = Batch(left.iloc[0])
        b.bigrams(split)
        b.trigrams(split)
        _, triple_codes = answers(replies, b.triple_key, n_shards, np.uint16)
        codes = b.pair_codes[b.pair_of]
        codes[b.triple_at] = triple_codes[b.triple_of]
        del triple_codes
        per_piece = lambda v: np.add.reduceat(np.where(b.inner, v, 0), b.begins)
        base, known = np.log10((b.counts + 1) / space)[b.tokens], (b.counts > 0).astype(np.int64)[b.tokens]
        return pd.DataFrame({"row": np.asarray(b.row["rows"], np.int64), "id": list(b.row["ids"]), "held_out": b.held, "n_tokens": b.sizes, "n_known": per_piece(known), "base_score": per_piece(base), "score": -STEP * per_piece(codes.astype(np.int64))})

    three = written(paired.drop("rows", "ids").mapInPandas(asking(ask_triples), ASK_SQL).groupBy("shard").applyInPandas(by_shard(score_shard(3)), REPLY_SQL))
    pieces = paired.groupBy("batch").cogroup(three.groupBy("batch")).applyInPandas(by_batch(summed), "row long, id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = written(pieces.groupBy("row").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))))
    discard(paired)
    discard(three)
    return out.select(F.col("id").cast("long").alias("id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
