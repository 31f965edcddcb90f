import random
import struct

import pytest
import sentencepiece

from chromloom.llm import pieces
from chromloom.llm.queries import PIECE_MODEL

ODD = ["", "  a  b ", "\n\n x", "é́\U0001f600 <s> </s> <0x0A> ▁▁a", " \t", "<unk>", "a" * 5000, "\x00\x01", "x" + " " * 40 + "y\n \n"]


@pytest.fixture(scope="module")
def proto():
    return pieces.read_model(PIECE_MODEL)


def test_model_file(proto):
    m = pieces.parse_model(proto)
    reference = sentencepiece.SentencePieceProcessor(model_proto=proto)
    assert (m.kind, m.byte_fallback, m.add_dummy_prefix, len(m.pieces)) == (pieces.BPE, True, True, 32_000)
    assert all(m.pieces[i][0] == reference.id_to_piece(i) and m.pieces[i][1] == pytest.approx(reference.get_score(i)) for i in range(0, 32_000, 97))


def test_every_text_has_parity_and_comes_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = pieces.encode_pieces(docs.unionByName(extra), PIECE_MODEL).collect()
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert len(got) == docs.count() + len(ODD)
    for r in got:
        assert list(r["ids"]) == reference.encode(r["text"]) and r["n_tokens"] == len(r["ids"]) and r["parity"]
        assert r["round_trip"] == (reference.decode(list(r["ids"])) == r["text"])
    assert sum(not r["round_trip"] for r in got) == 1  # the text that holds the marker itself
    back = pieces.decode_pieces(pieces.encode_pieces(extra, PIECE_MODEL), PIECE_MODEL).collect()
    assert {r["decoded"] == r["text"] for r in back if r["round_trip"]} == {True}


def test_ids_are_the_rebuilt_tokenizers(proto):
    """Where the two libraries differ, the check says so and the ids stay."""
    codec = pieces.PieceCodec(proto)
    real = codec.reference

    class Other:
        def encode(self, texts, num_threads):
            return [[*x, 5] if "b" in t else x for t, x in zip(texts, real.encode(texts), strict=True)]

    codec.reference = Other()
    got = list(codec.checked(["a", "b c", ""]))
    assert [g[0].tolist() for g in got] == real.encode(["a", "b c", ""]) and [g[1:] for g in got] == [(True, True), (False, True), (True, True)]


def test_chunks_equal_whole_texts(proto):
    codec = pieces.PieceCodec(proto)
    r = random.Random(4)
    texts = ODD + ["".join(r.choices(["in", "ing ", " the", "▁", "\n", "ü", "  ", "x1", "日本", "\t"], k=60)) for _ in range(200)]
    assert codec.chunked
    whole = [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in codec.encode(texts)] == whole == codec.reference.encode(texts)
    for text, (ids, parity, back) in zip(texts, codec.checked(texts), strict=True):
        assert parity and back == (codec.decode([ids.tolist()])[0] == text)


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2, len(value)]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 & 127 | 128 if number > 15 else number << 3]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
    return out


def test_a_unigram_model_keeps_its_scores():
    listed = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -1.5, 1), ("b", -2.5, 1), ("ab", -2.0, 1), ("▁a", -2.2, 1), ("ba", -3.9, 1)]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in listed)
    m = pieces.parse_model(body + message((2, message((3, 1)))) + message((3, message((3, 1), (4, 0), (5, 1)))))
    assert m.kind == pieces.UNIGRAM and [(p, s, k) for p, s, k in m.pieces] == [(p, pytest.approx(s), k) for p, s, k in listed]
    tokenizer = pieces.build_tokenizer(m)

    def best(text):
        scores = {p: s for p, s, k in listed if k == 1}
        table = [(0.0, [])] + [(-1e9, [])] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in scores:
                    table[j] = max(table[j], (table[i][0] + scores[text[i:j]], [*table[i][1], text[i:j]]), key=lambda x: x[0])
        return table[-1][1]

    for text in ("abab", "baab", "a b ab", "bbbaaa"):
        assert tokenizer.encode(text, add_special_tokens=False).tokens == best("▁" + text.replace(" ", "▁"))


def test_null_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "kept", [1]), (1, "a b", None, None)], "doc_id long, text string, note string, ids array<int>")
    got = pieces.encode_pieces(docs, PIECE_MODEL)
    assert got.columns == ["doc_id", "text", "note", "n_tokens", "ids", "parity", "round_trip"]
    assert sorted((r["note"] or "", r["n_tokens"]) for r in got.collect()) == [("", 2), ("kept", 0)]
    assert pieces.encode_pieces(docs.limit(0), PIECE_MODEL).count() == 0
