"""Byte-level merge encoding and decoding through a sentencepiece model made from the vocabulary.

A rank file (base64 of a token's bytes, rank) becomes a sentencepiece model of the merge type, written out field by
field: each byte is mapped to a letter of its own, a token's piece is the text of its bytes' letters, its score the
negative of its rank, and nothing is normalised, escaped or prefixed. Joining the best-scored neighbours is then joining
those of the lowest rank. A text is cut by the vocabulary's pattern and every cut is encoded separately; a cut that is
itself a token gives that token, as such vocabularies are defined. Decoding maps ids back to bytes.

Cuts are remembered in a memory of bounded size that only saves time. The driver reads the rank file and sends the model
to the tasks; both are of the vocabulary's size. Long texts are cut and encoded some cuts at a time.

Results for odd input: null text gives null ids, bytes and digests; the empty text gives no ids; repeated rows give
repeated results; an empty table gives an empty result; a special token's text is ordinary text; columns of the input are
kept as asked, those that begin with ``_e_`` are replaced. Ids outside the vocabulary, and null ones, are an error in decoding.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import table, trimmed, without_prefix

RANKS = "byte_bpe_50k.tiktoken"
REMEMBERED = 100_000
SHORT = 48
CUTS = 1 << 15
WHOLE_TEXT = 1 << 18
BLOCK_IDS = 1 << 20

#: The letter of byte b; all of these letters are unlike the mark of spaces.
_LETTERS = {b: chr(0x100 + b) for b in range(256)}

#: Fields and values of the model format.
_PIECES, _TRAINER, _NORMALISER = 1, 2, 3
_NORMAL, _UNKNOWN, _MERGES = 1, 2, 2


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(_PIECES, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def lettered(token: bytes) -> str:
    """The bytes of a token as letters."""
    return token.decode("latin-1").translate(_LETTERS)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; ranks must go from 0 on without a gap."""
    by_rank: dict[int, bytes] = {}
    with open(path, "rb") as source:
        for token, rank in map(bytes.split, source):
            by_rank[int(rank)] = base64.b64decode(token)
    tokens = [by_rank[k] for k in range(len(by_rank))]
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"bytes without a token: {sorted(missing)}")
    return tokens


def model_of(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece k + 1 is the token of rank k (0 is the unknown piece, which bytes never need)."""
    out = [_piece("<unk>", 0.0, _UNKNOWN)]
    out += [_piece(lettered(token), -float(rank), _NORMAL) for rank, token in enumerate(tokens)]
    out.append(_bytes(_TRAINER, _number(3, _MERGES) + _number(4, len(tokens) + 1)))
    out.append(_bytes(_NORMALISER, _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class _Memory(dict):
    """Ids of cuts; what isn't there is encoded."""

    def __init__(self, coder: Coder) -> None:
        self.coder = coder

    def __missing__(self, cut: str) -> tuple[int, ...]:
        ids = self.coder.cut_ids(cut)
        if len(cut) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[cut] = ids
        return ids


class Coder:
    """Encodes and decodes whole texts."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str) -> None:
        self.tokens, self.rank = tokens, {token: k for k, token in enumerate(tokens)}
        self.names = [str(k) for k in range(len(tokens))]
        self.pattern = regex.compile(pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.memory = _Memory(self)

    def cut_ids(self, cut: str) -> tuple[int, ...]:
        token = cut.encode()
        whole = self.rank.get(token)
        return (whole,) if whole is not None else tuple(k - 1 for k in self.pieces.encode(lettered(token)))

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, some at a time."""
        if len(text) <= WHOLE_TEXT:
            yield list(chain.from_iterable(map(self.memory.__getitem__, self.pattern.findall(text))))
            return
        cuts = (found.group() for found in self.pattern.finditer(text))
        while some := list(islice(cuts, CUTS)):
            yield list(chain.from_iterable(map(self.memory.__getitem__, some)))

    def decode(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise ValueError("an id below 0")
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of their decimal forms joined by one space, digest of the bytes that they decode to."""
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.blocks(text):
            if ids:
                of_ids.update(((" " if n else "") + " ".join(map(self.names.__getitem__, ids))).encode())
                of_bytes.update(self.decode(ids))
                n += len(ids)
        return n, of_ids.hexdigest(), of_bytes.hexdigest()


@lru_cache(maxsize=2)
def coder(model: bytes, tokens: tuple[bytes, ...], pattern: str) -> Coder:
    return Coder(list(tokens), model, pattern)


def _given(path: str | None, pattern: str | None) -> tuple[str, str]:
    """The file and pattern asked for, else the public ones of the installed package."""
    if path and pattern:
        return path, pattern
    import public_tokenizers

    return path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN


def _shipped(spark: SparkSession, path: str | None, pattern: str | None):
    """Tokens, model and pattern as a broadcast: a few MB, whatever the data."""
    path, pattern = _given(path, pattern)
    tokens = tuple(read_ranks(path))
    return spark.sparkContext.broadcast((model_of(list(tokens)), tokens, pattern))


def with_ids(docs: DataFrame, text: str = "text", ids: bool = True, digests: bool = False, path: str | None = None, pattern: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and, as asked, ``_e_ids`` of each whole text, and ``_e_n``, ``_e_ids_sha256`` and ``_e_bytes_sha256``: the number of ids, the digest of
    their decimal forms joined by one space, and that of the bytes that they decode to, found without holding a long text's ids."""
    docs = without_prefix(docs, "_e_")
    names = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_e_text"))
    schema = source.drop("_e_text").schema
    if ids:
        schema = schema.add("_e_ids", T.ArrayType(T.IntegerType()))
    if digests:
        schema = schema.add("_e_n", "long").add("_e_ids_sha256", "string").add("_e_bytes_sha256", "string")
    shared = _shipped(docs.sparkSession, path, pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*shared.value)
        for batch in batches:
            texts, done = batch.column(batch.num_columns - 1), 0
            lists: list[np.ndarray | None] = []
            sums: list[tuple] = []
            held = 0
            for k, value in enumerate(texts, 1):
                t = value.as_py()
                if ids:
                    lists.append(None if t is None else np.concatenate([np.array(x, np.int32) for x in c.blocks(t)]))
                    held += 0 if t is None else len(lists[-1])
                if digests:
                    sums.append((None, None, None) if t is None else c.digests(t))
                if k == batch.num_rows or held >= BLOCK_IDS:  # bounded memory
                    more = []
                    if ids:
                        bounds = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in lists])))
                        flat = np.concatenate([np.zeros(0, np.int32), *[x for x in lists if x is not None]])
                        more.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in lists])))
                    if digests:
                        more += [pa.array([s[j] for s in sums], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*[x[done:k] for x in batch.columns[:-1]], *more], names=schema.fieldNames())
                    done, lists, sums, held = k, [], [], 0

    return source.mapInArrow(trimmed(each), schema)


def with_bytes(encoded: DataFrame, ids: str = "_e_ids", name: str = "_e_bytes", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the bytes that the ids of each row decode to (null for null ids)."""
    names = [c for c in (encoded.columns if keep is None else keep) if c != name]
    source = encoded.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").cast("array<int>").alias("_e_given"))
    schema = source.drop("_e_given").schema.add(name, "binary")
    shared = _shipped(encoded.sparkSession, path, None)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*shared.value)
        for batch in batches:
            found = [None if value is None else c.decode(value) for value in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=schema.fieldNames())

    return source.mapInArrow(trimmed(each), schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    out = with_ids(docs, ids=False, digests=True, keep=["doc_id"])
    return out.select("doc_id", F.col("_e_n").alias("n_tokens"), F.col("_e_ids_sha256").alias("ids_sha256"), F.col("_e_bytes_sha256").alias("decoded_sha256"))
