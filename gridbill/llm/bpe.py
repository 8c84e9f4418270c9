"""Byte-level BPE encoding and decoding through a sentencepiece BPE model (operator 1).

The model is serialised directly from a rank file: piece ``i`` is the token of rank
``i`` with each byte mapped to a printable character, its score is ``-i``, and the
normaliser is the identity. Sentencepiece then merges the adjacent pair of the best
score first, which is the merge of the lowest rank. Decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common
from gridbill.llm.chunks import Encoder, binary, byte_characters, gather, runs

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text that are encoded at once, and what a worker may remember of encoded stretches.
BATCH_BYTES, MEMORY_BYTES = 512 << 10, 16 << 20


@lru_cache(2)
def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token and rank on each line) in order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens) or len({*tokens}) != len(tokens):
        raise ValueError("ranks must be 0..n-1, one distinct token each")
    return tokens


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """A protobuf field: varint, 32-bit float or length-delimited, by the value's type."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model of type BPE whose piece ids are the ranks.

    The unknown piece that sentencepiece demands takes the id after the last rank;
    it never occurs, as every single byte is a token (checked here).
    """
    if not {bytes([b]) for b in range(256)} <= {*tokens}:
        raise ValueError("each single byte must be a token")
    table = byte_characters()
    piece, kind, bpe = 1, 3, 2  # field numbers and the type's number in sentencepiece_model.proto
    out = [_field(1, _field(piece, "".join(table[b] for b in t).encode()) + _field(2, -float(i)) + _field(kind, 1)) for i, t in enumerate(tokens)]
    out.append(_field(1, _field(piece, b"<unk>") + _field(2, -float(len(tokens))) + _field(kind, 2)))
    trainer = _field(kind, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def encoder(path: str, pattern: str) -> Encoder:
    """Whole texts to packed little-endian unsigned 32-bit ids."""

    def build() -> Encoder:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(read_ranks(path)))
        return Encoder(pattern, lambda pre: model.encode(pre, num_threads=1), most_bytes=MEMORY_BYTES)

    return common.held(("bpe", path, pattern), build)


def decoder(path: str):
    """Ids and where each text's ids end to an Arrow array of the bytes they stand for."""
    table = runs(read_ranks(path))

    def decode(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        text, stops = gather(table, ids, "u1")
        return binary(text, np.concatenate([[0], stops])[ends])

    return decode


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids (null: none) as ids and where each text's ids end."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) // 4)
    return np.frombuffer(b"".join([x for x in column.to_pylist() if x]), "<u4"), ends


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    A null text is an empty one and has no ids; null and repeated ids of rows are kept,
    one row out for each row in; other columns are ignored.
    """

    def make():
        enc = encoder(path, pattern)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), binary(*enc.batch(b.column(1)))], [id_col, "ids"])

    src = df.select(id_col, text_col)
    return common.map_batches(src, text_col, make, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, ids binary", BATCH_BYTES)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, decoded): the bytes that packed ``ids`` stand for; null ids decode to no bytes."""

    def make():
        dec = decoder(path)
        return lambda b: pa.RecordBatch.from_arrays([*(b.column(c) for c in (id_col, *keep)), dec(*unpacked(b.column("ids")))], [id_col, *keep, "decoded"])

    src = df.select(id_col, *dict.fromkeys([*keep, "ids"]))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return common.map_batches(src, "ids", make, f"{schema}, decoded binary", 8 << 20)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``encode``, then ``decode`` of the ids, in one pass of one worker process."""

    def make():
        enc, dec = encoder(path, pattern), decoder(path)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = enc.batch(b.column(1))
            return pa.RecordBatch.from_arrays([b.column(0), binary(ids, ends), dec(ids, ends)], [id_col, "ids", "decoded"])

        return one

    src = df.select(id_col, text_col)
    return common.map_batches(src, text_col, make, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, ids binary, decoded binary", BATCH_BYTES)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``docs`` (doc_id, text) under the public vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    return round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the packed ids and of the decoded bytes."""
    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"))
