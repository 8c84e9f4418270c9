"""Token ids in length-delimited binary records with an offset index (operator 7).

A shard ``part-NNNNNN.rec`` is a run of frames: length (unsigned 64 bit), its
masked CRC-32C, the payload, the payload's masked CRC-32C; all little-endian. A
payload is: the document id (signed 64 bit), flags (unsigned 32 bit: 1 the id is
null, 2 the ids take two bytes each), then the ids. Beside it ``part-NNNNNN.idx``
holds the start of each frame in the shard as unsigned 64-bit integers, so a
shuffled reader can fetch record ``i`` without reading what lies before it. Shards
in order of their names hold the documents in ascending order of id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common
from gridbill.llm.chunks import Encoder
from gridbill.llm.crc32c import crc32c, masked

VOCABULARY = "byte_bpe_50k.json"
HEAD, LENGTH = struct.Struct("<qI"), struct.Struct("<Q")
READ_BYTES = 8 << 20
#: What one worker may remember of encoded stretches.
MEMORY_BYTES = 208 << 20


def plain_encoder(path: str, pattern: str, **bounds: int) -> tuple[Encoder, list[str]]:
    """An encoder by the ``tokenizers`` library's model, pre-token by pre-token, to which added tokens are
    plain text; and the contents of the added tokens.

    Only for a tokenizer that is a byte-level BPE and its added tokens (checked), whose
    pre-tokens are those of ``pattern``.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer.from_file(path)
    if t.normalizer or not isinstance(t.model, models.BPE) or not isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) or t.pre_tokenizer.add_prefix_space:
        raise ValueError("a plain byte-level BPE tokenizer is asked for")
    tokenize = t.model.tokenize
    plain = Encoder(pattern, lambda pre: [[x.id for x in tokenize(p)] for p in pre], **bounds)
    return plain, [a.content for a in t.get_added_tokens_decoder().values()]


def encoder(path: str, pattern: str) -> Callable[[list[str | None]], list[bytes]]:
    """Whole texts to packed ids as the ``tokenizers`` library has them. A text that holds an
    added token literally is encoded by the library as a whole.
    """

    def build() -> Callable[[list[str | None]], list[bytes]]:
        from tokenizers import Tokenizer

        plain, added = plain_encoder(path, pattern, most_bytes=MEMORY_BYTES)
        library = Tokenizer.from_file(path)

        def encode(texts: list[str | None]) -> list[bytes]:
            whole = {i for i, x in enumerate(texts) if x and any(a in x for a in added)}
            out = plain([None if i in whole else x for i, x in enumerate(texts)])
            for i in whole:
                out[i] = np.array(library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
            return out

        return encode

    return common.held(("records", path, pattern), build)


def encoding(path: str, pattern: str, end_id: int) -> Callable[[list[str | None]], list[bytes]]:
    """Whole texts to packed unsigned 32-bit ids with ``end_id`` at the end; a null text is an empty one."""
    enc, end = encoder(path, pattern), struct.pack("<I", end_id)
    return lambda texts: [x + end for x in enc(texts)]


def payload(doc_id: int | None, ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    short = bool(len(wide)) and int(wide.max()) < 1 << 16
    return HEAD.pack(doc_id or 0, (doc_id is None) + 2 * short) + (wide.astype("<u2").tobytes() if short else ids)


def parsed(data: bytes) -> tuple[int | None, bytes]:
    doc_id, flags = HEAD.unpack_from(data)
    body = data[HEAD.size :]
    return None if flags & 1 else doc_id, np.frombuffer(body, "<u2").astype("<u4").tobytes() if flags & 2 else body


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [LENGTH.pack(len(p)) for p in payloads]
    of_length, of_data = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, of_length[i].tobytes(), p, of_data[i].tobytes())) for i, (n, p) in enumerate(zip(lengths, payloads, strict=True))]


def unframed(source) -> Iterator[list[bytes]]:
    """The payloads of a shard, some megabytes at a time; raises where a checksum or length does not hold."""
    held = b""
    while True:
        more = source.read(READ_BYTES)
        held += more
        at, lengths, datas, sums = 0, [], [], []
        while at + 12 <= len(held):
            (n,) = LENGTH.unpack_from(held, at)
            if at + 16 + n > len(held):
                break
            lengths.append(held[at : at + 8])
            datas.append(held[at + 12 : at + 12 + n])
            sums.append(held[at + 8 : at + 12] + held[at + 12 + n : at + 16 + n])
            at += 16 + n
        found = np.frombuffer(b"".join(sums), "<u4").reshape(-1, 2)
        if (masked(crc32c(lengths)) != found[:, 0]).any() or (masked(crc32c(datas)) != found[:, 1]).any():
            raise OSError("a record's checksum does not match")
        held = held[at:]
        if datas:
            yield datas
        if not more:
            if held:
                raise OSError("a record is cut off")
            return


def write(df: DataFrame, path: str, make: Callable[[], Callable[[list], list[bytes]]], id_col: str = "doc_id", column: str = "text") -> list[tuple[str, int, int]]:
    """Write a table that is in ascending order of id, partition after partition, as shards; (shard, records, ids)
    of each shard, in that order.

    ``make`` gives, once for each task, the function from values of ``column`` to packed
    ids. Each partition is a shard. It is written under a name of the task's attempt and
    then renamed, so a task that runs again replaces it by the same bytes. An empty
    table gives no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}"
        temporary = f"{base}/.{name}-{task.taskAttemptId()}"
        out, at, starts, n_ids = None, 0, [], 0
        for s in common.pieces(batches, column, 8 << 20):
            if out is None:
                pack = make()
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{temporary}.rec")
            ids = pack(s.column(column).to_pylist())
            n_ids += sum(map(len, ids)) // 4
            framed = frames([payload(d, x) for d, x in zip(s.column(id_col).to_pylist(), ids, strict=True)])
            for f in framed:
                starts.append(at)
                at += len(f)
            out.write(b"".join(framed))
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{temporary}.idx") as index:
            index.write(np.array(starts, "<u8").tobytes())
        for kind in ("idx", "rec"):
            store.move(f"{temporary}.{kind}", f"{base}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [name], "records": [len(starts)], "n_ids": [n_ids]})

    written = df.select(id_col, column).mapInArrow(run, "shard string, records long, n_ids long")
    return sorted(tuple(r) for r in written.collect())  # one row for each shard


def read(spark: SparkSession, path: str, shards: list[tuple[str, int, int]], take: Callable[[bytes], object] = bytes, kind: str = "binary", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_ids, value) of all records of ``shards``: ``start`` counts the ids of all records before,
    ``value`` is what ``take`` makes of the packed ids (as they are by default), of type ``kind``."""
    schema, before, rows = f"`{id_col}` long, start long, n_ids long, value {kind}", 0, []
    for shard, _, n_ids in shards:
        rows.append((shard, before))
        before += n_ids
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{shard}.rec") as source:
                    for datas in unframed(source):
                        both = [parsed(d) for d in datas]
                        counts = np.array([len(x) // 4 for _, x in both], np.int64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([d for d, _ in both], pa.int64()), pa.array(start + np.cumsum(counts) - counts, pa.int64()),
                            pa.array(counts), pa.array([take(x) for _, x in both]),
                        ], [id_col, "start", "n_ids", "value"])
                        start += int(counts.sum())

    return spark.createDataFrame(rows, "shard string, start long").repartition(len(rows)).mapInArrow(run, schema)


def fetch(path: str, shard: str, i: int) -> tuple[int | None, bytes]:
    """Record ``i`` of a shard by its offset index: (id, packed ids)."""
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}/{shard}.idx") as index:
        (at,) = LENGTH.unpack(index.read_at(8, 8 * i))
    with store.open_input_file(f"{base}/{shard}.rec") as source:
        (n,) = LENGTH.unpack(source.read_at(8, at))
        return parsed(next(unframed(pa.BufferReader(source.read_at(n + 16, at))))[0])


def in_order(docs: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """Rows dealt out by ranges of id, so shards are even whatever the ids are; equal ids in order of their content, null ids first."""
    return docs.select(id_col, column).repartitionByRange(id_col).sortWithinPartitions(id_col, column)


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the record files: ids before it, its ids with the end id, their CRC-32."""
    import public_tokenizers

    path, vocabulary, pattern = common.shared_dir(spark, "records"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    docs = in_order(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    shards = write(docs, path, lambda: encoding(vocabulary, pattern, 0))
    records = read(spark, path, shards, zlib.crc32, "long")
    return records.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.col("value").alias("ids_crc32"))
