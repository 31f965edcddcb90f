"""SentencePiece models run by the tokenizers library.

The model file (a protobuf) is parsed here: pieces with scores and kinds, the normaliser's rules, the metaspace marker and
byte fallback. From these a tokenizers.Tokenizer is rebuilt: a unigram model keeps the scores; a BPE model (the public
32,000-piece file is one, so it has no unigram scores to rebuild) gets its merges from the order of the scores. Texts are
encoded and decoded in batches, which the library spreads over threads; the ids are its own. Every text is encoded a
second time by the sentencepiece library, whose ids only serve as a check: `parity` says whether both are the same.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chromloom.llm.common import give_back

MARK = "▁"
CHUNK = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Bytes of a model file, and remembered chunks of a worker, at most.
MAX_MODEL, MAX_KNOWN = 64_000_000, 300_000
#: Kinds of pieces and models in the protobuf (fixed values of the public file format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def wire_fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: integers for varints, bytes for all else."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = buf[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(buf):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = buf[i : i + size], i + size
        yield key >> 3, value


def parse_model(buf: bytes) -> PieceModel:
    m = PieceModel()
    for number, value in wire_fields(buf):
        if number == 1:
            f = dict(wire_fields(value))
            m.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(wire_fields(value))
            m.kind, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == 3:
            f = dict(wire_fields(value))
            m.charsmap, m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return m


def merges_of(m: PieceModel) -> list[tuple[str, str]]:
    """A BPE model's merges: each split of a piece into two pieces, best scores first."""
    rank = {p: (-score, i) for i, (p, score, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = [(rank[p], cut, p) for p in rank for cut in range(1, len(p)) if p[:cut] in rank and p[cut:] in rank]
    return [(p[:cut], p[cut:]) for _, cut, p in sorted(found)]


def build_tokenizer(m: PieceModel):
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    unk = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unk, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges_of(m), unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model kind {m.kind} is neither unigram nor BPE")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    steps += [normalizers.Prepend(" ")] if m.add_dummy_prefix else []
    steps += [normalizers.Replace(" ", MARK)] if m.escape_whitespaces else []
    t.normalizer = normalizers.Sequence(steps)
    whole = [p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)]
    if m.kind == BPE and not any(MARK in p.lstrip(MARK) or "\n" in p for p in whole):
        # no piece crosses these borders, so words can be merged (and cached) one by one
        t.pre_tokenizer = pre_tokenizers.Split(Regex(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+"), behavior="isolated")
    t.decoder = decoder_of(m.add_dummy_prefix)
    return t


def decoder_of(dummy_prefix: bool):
    from tokenizers import decoders

    return decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if dummy_prefix else []))


class PieceCodec:
    """Encodes and decodes batches of texts.

    Where no piece crosses a border of words or lines, each distinct chunk of a batch is merged once and texts are put
    together from the chunks' ids; other models encode whole texts.
    """

    def __init__(self, proto: bytes):
        import sentencepiece
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.model = parse_model(proto)
        self.tokenizer = build_tokenizer(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=proto)
        line = [i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE and p == "<0x0A>"]
        self.chunked = self.tokenizer.pre_tokenizer is not None and self.plain() and bool(line)
        if self.chunked:
            # lines of chunks: the id of a line break, which is no chunk's own, parts them again
            self.line = line[0]
            self.lines = Tokenizer(self.tokenizer.model)
            self.lines.pre_tokenizer = pre_tokenizers.Split(Regex(r"\n"), behavior="isolated")
            self.lines.decoder = decoder_of(False)  # a chunk's own first space stays
        self.known: dict[str, bytes] = {}  # the ids as int32
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()  # known or older chunks that don't decode to themselves

    def forget(self) -> None:
        self.known, self.older, self.odd = {}, {}, set()

    def plain(self) -> bool:
        m = self.model
        return not m.charsmap and not m.remove_extra_whitespaces and m.escape_whitespaces

    def _learn(self, chunks: set[str]) -> None:
        """Makes all chunks known; those seen in the last MAX_KNOWN new ones are kept, older ones are forgotten."""
        if len(self.known) > MAX_KNOWN:
            self.known, self.older = {}, self.known
            self.odd &= self.older.keys()
        missing = chunks.difference(self.known)
        old = missing & self.older.keys()
        self.known.update((c, self.older[c]) for c in old)
        self.known.setdefault("\n", np.int32(self.line).tobytes())
        fresh = list(missing - old - {"\n"})
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            encoded = self.lines.encode_batch_fast(["\n".join(part[k : k + 200]) for k in range(0, len(part), 200)], add_special_tokens=False)
            flat = np.asarray([x for e in encoded for x in (*e.ids, self.line)], np.int32)
            raw, ends = flat.tobytes(), np.flatnonzero(flat == self.line)
            ids = [raw[4 * a : 4 * b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)]
            self.known.update(zip(part, ids, strict=True))
            # lines decode as they were encoded, many chunks at once; only where a line differs are its chunks looked at one by one
            for k, e in zip(range(0, len(part), 200), encoded, strict=True):
                own = part[k : k + 200]
                if self.lines.decode(e.ids, skip_special_tokens=False) != "\n".join(own).replace(MARK, " "):
                    each = self.lines.decode_batch([np.frombuffer(self.known[c], np.int32).tolist() for c in own], skip_special_tokens=False)
                    self.odd.update(c for c, back in zip(own, each, strict=True) if back != c.replace(MARK, " "))

    def chunks(self, texts: list[str]) -> list[list[str]]:
        head = MARK if self.model.add_dummy_prefix else ""
        out = [CHUNK.findall(head + t.replace(" ", MARK)) if t else [] for t in texts]
        self._learn(set(chain.from_iterable(out)))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.chunked:
            return [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._joined(own) for own in self.chunks(texts)]

    def _joined(self, own: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.int32)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def checked(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round_trip) of each text, a bounded number of characters at a time."""
        for part in portions(texts):
            theirs = (np.asarray(x, np.int32) for x in self.reference.encode(part, num_threads=1))
            if not self.chunked:
                mine = self.encode(part)
                for ids, other, text, back in zip(mine, theirs, part, self.decode([x.tolist() for x in mine]), strict=True):
                    yield ids, np.array_equal(ids, other), back == text
                continue
            for own, other, text in zip(self.chunks(part), theirs, part, strict=True):
                ids = self._joined(own)
                # chunks decode one by one, as no piece or byte sequence crosses their borders
                yield ids, np.array_equal(ids, other), MARK not in text and self.odd.isdisjoint(own)


def portions(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


_CODECS: dict[int, PieceCodec] = {}


def codec_of(proto: bytes) -> PieceCodec:
    """One codec per worker process and model."""
    key = hash(proto)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(proto)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        proto = f.read(MAX_MODEL + 1)
    if len(proto) > MAX_MODEL:
        raise ValueError(f"the model has more than {MAX_MODEL} bytes")
    return proto


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", forget: bool = False) -> DataFrame:
    """Adds n_tokens, ids, parity and round_trip to docs, without a shuffle.

    ids are the rebuilt tokenizer's ids of the whole text. parity: the sentencepiece library gives the same. round_trip: the
    rebuilt tokenizer's decoder gives the text again. Null and empty texts have no ids (parity and round_trip true). Repeated rows are encoded
    each; an empty table gives an empty result. Columns of docs with these names are replaced. The model file is read by
    the driver and sent with the tasks (MAX_MODEL bytes at most). Workers remember chunks from task to task unless forget
    is set, which costs time and leaves their memory to the operators that follow.
    """
    proto = read_model(model_path)
    docs = docs.drop("n_tokens", "ids", "parity", "round_trip")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(proto)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                done = list(codec.checked([t or "" for t in batch.column(at).to_pylist()]))
                sizes = np.asarray([len(d[0]) for d in done], np.int64)
                ids = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.concatenate([d[0] for d in done])))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(sizes), ids.cast(pa.list_(pa.int32())), pa.array([d[1] for d in done]), pa.array([d[2] for d in done])],
                    names=[*batch.schema.names, "n_tokens", "ids", "parity", "round_trip"],
                )
        if forget:
            codec.forget()
            give_back()

    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def decode_pieces(docs: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the ids (null for null) to docs, without a shuffle; a column of that name is replaced."""
    proto = read_model(model_path)
    docs = docs.drop(out)
    at = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(proto)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                ids = batch.column(at).to_pylist()
                texts = codec.decode([x or [] for x in ids])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t if x is not None else None for x, t in zip(ids, texts, strict=True)], pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))
