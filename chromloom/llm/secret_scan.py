"""Secrets in texts: fixed patterns, and random strings by their token efficiency.

Runs of key characters that the patterns did not cover are tokenised with a public byte-pair vocabulary. Its tokens are parts
of words, so words and names need few of them, while random strings need one for every one or two characters: a run with
fewer than `least_ratio` characters a token is a finding. Left out before are runs that are known not to be secrets, though
just as random: digests of the usual lengths, UUIDs, and identifiers made of words, numbers and dates.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which findings of one start stand; random is the token-efficiency test's.
ASSIGN, ACCESS, HEX, RANDOM = KINDS = ("assign", "access", "hex", "random")
# The patterns of the three kinds, and how long what they find has to be.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
# Fixed value: the pattern by which the public vocabulary splits texts.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Shortest run that is tested, and the characters a token below which it is random.
LEAST_RUN, LEAST_RATIO = 20, 2.2
#: Bytes of a vocabulary file, at most.
MAX_VOCABULARY = 16_000_000
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
_CLASSES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
# hexadecimal digests of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512; digests named by their function; UUIDs
_DIGEST = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|sha(?:1|224|256|384|512)[-=_][A-Za-z0-9+/]+={0,2}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})"
)
# words (three letters or more, joined in camel case too), numbers and short tags, parted by _ - / = or +
_PART = r"(?:[A-Z]{1,5}|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*|[a-z])?[0-9]{0,20}"
_IDENTIFIER = re.compile(rf"{_PART}(?:[_/=+-]++{_PART})*+")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        ranks = f.read(MAX_VOCABULARY + 1)
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary has more than {MAX_VOCABULARY} bytes")
    return ranks


_ENCODINGS: dict[int, tiktoken.Encoding] = {}


def encoding_of(ranks: bytes) -> tiktoken.Encoding:
    """One encoding per worker process and vocabulary."""
    key = hash(ranks)
    if key not in _ENCODINGS:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=merges, special_tokens={})
    return _ENCODINGS[key]


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the three patterns find, each kind without overlaps from the left."""
    found = [(m.start(), m.end(), ASSIGN) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), ACCESS) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), HEX) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def random_spans(text: str, known: list[tuple[int, int, str]], encoding: tiktoken.Encoding, least_ratio: float) -> Iterator[tuple[int, int, float]]:
    """(start, end, characters a token) of the random runs that meet none of the known spans."""
    for m in _RUN.finditer(text):
        run = m[0]
        if sum(c.search(run) is not None for c in _CLASSES) < 2 or _DIGEST.fullmatch(run) or _IDENTIFIER.fullmatch(run):
            continue
        if any(start < m.end() and m.start() < end for start, end, _ in known):
            continue
        ratio = len(run) / len(encoding.encode_ordinary(run))
        if ratio < least_ratio:
            yield m.start(), m.end(), ratio


def scan_secrets(docs: DataFrame, vocabulary: str, text_col: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """docs with `findings`: an array of (kind, start, end, ratio) by start, then kind; no shuffle.

    Offsets count code points, ends are exclusive. kind is assign (a name such as password, := and a value of 8 characters
    or more; the span is the whole match), access (AKIA ..., 16 or more), hex (32 or more) or random; ratio is the characters
    a token of a random run, else null. Random runs meet no span of the other kinds, which stay as they are. Whole texts are
    scanned; null and empty texts have no findings. Repeated rows and null ids are like any other; an empty table gives an
    empty result. A column named findings is replaced, all others stay. The driver reads the vocabulary (tiktoken's rank
    file, MAX_VOCABULARY bytes at most) and sends it with the tasks.
    """
    docs = docs.drop("findings")
    at = docs.columns.index(text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("ratio", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(ranks.value)
        form = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())]))
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows = []
                for text in batch.column(at).to_pylist():
                    own = pattern_spans(text := text or "")
                    found = [(a, b, k, None) for a, b, k in own]
                    found += [(a, b, RANDOM, ratio) for a, b, ratio in random_spans(text, own, encoding, least_ratio)]
                    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
                    rows.append([{"kind": k, "start": a, "end": b, "ratio": ratio} for a, b, k, ratio in found])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, form)], names=[*batch.schema.names, "findings"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("findings", T.ArrayType(kind))]))


def redacted(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """The text with each finding's span replaced by the mark (overlapping spans by one); null stays null."""
    merged = F.aggregate(
        findings,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("upto")),
        lambda a, x: F.when(x["end"] <= a["upto"], a)
        .when(x["start"] < a["upto"], F.struct(a["done"].alias("done"), x["end"].alias("upto")))
        .otherwise(F.struct(F.concat(a["done"], text.substr((a["upto"] + 1).cast("int"), (x["start"] - a["upto"]).cast("int")), F.lit(mark)).alias("done"), x["end"].alias("upto"))),
    )
    return F.when(F.size(findings) == 0, text).otherwise(F.concat(merged["done"], text.substr((merged["upto"] + 1).cast("int"), F.length(text))))


def spans_text(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
