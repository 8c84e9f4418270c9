"""Operators 1 and 7: ids against the public libraries, exact round trips, record files."""

import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridbill.llm import bpe, common, crc32c, records

PATH = P.path(bpe.VOCABULARY)
ODD = [None, "", " ", "a" * 5000, "  two  blanks\n\n and\tmore ", "é ß\x1c\x85x", "don't we'll 12345 !!! ?", "\U0001f600 ok", "x" + " " * 300 + "y", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_and_round_trip(text):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(PATH))}, special_tokens={}) if not hasattr(test_ids_and_round_trip, "enc") else test_ids_and_round_trip.enc
    test_ids_and_round_trip.enc = enc
    ids = bpe.encoder(PATH, P.PATTERN)([text])[0]
    assert ids == packed(enc.encode_ordinary(text))
    assert bpe.decoder(PATH)(*bpe.unpacked(pa.array([ids], pa.binary()))).to_pylist() == [text.encode()]


def test_model_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.model_proto([b"a", b"b"])


def test_encode_decode_frames(documents, reference):
    rows = [*enumerate(ODD), (3, "a" * 5000), (None, "null id"), (3, "other")]
    ids = bpe.encode(documents(rows), PATH, P.PATTERN)
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(ids, PATH, keep=("ids",)).collect())
    assert got == sorted((-1 if i is None else i, packed(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)


def test_empty_table(documents):
    assert bpe.digests(documents([]).select("doc_id", "text")).count() == 0


def test_op1_digests(spark, tiny, reference):
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, tiny).collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_memory_of_stretches_is_bounded():
    enc = bpe.Encoder(P.PATTERN, lambda pre: [[len(p)] for p in pre], most_bytes=2000)
    for k in range(200):
        enc([f"a{k} b{k} c{k}"])
        assert enc.held <= 2000 + 3 * 250 and len(enc.known) <= 15


_WORKER = """
import re, sys
import pyarrow as pa
import public_tokenizers as P
from gridbill.llm import bpe, common

def rss(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

batch = pa.ipc.open_stream(pa.OSFile(sys.argv[1])).read_next_batch()
path = P.path(bpe.VOCABULARY)
enc, dec = bpe.encoder(path, P.PATTERN), bpe.decoder(path)
enc.batch(pa.array(["a b"]))
common.give_back()
before = rss("VmRSS")
for s in common.slices(batch, "text", bpe.BATCH_BYTES):
    dec(*enc.batch(s.column("text")))
print(rss("VmHWM") - before)
"""


def test_memory_of_a_worker(tmp_path):
    """An executor holds two such processes beside a full heap: MB that encoding takes beside its input, if no word recurs."""
    name = str.maketrans("0123456789abcdef", "aeioubcdfgklmnpr")
    words = [f"{i * 2654435761 % (1 << 32):08x}".translate(name) for i in range(400_000)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]})
    with pa.ipc.new_stream(str(tmp_path / "texts"), batch.schema) as out:
        out.write_batch(batch)
    root = str(Path(bpe.__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", _WORKER, str(tmp_path / "texts")], cwd=root, capture_output=True, text=True, check=True, timeout=120)
    assert int(done.stdout) < 85


def test_long_stretches_are_not_remembered():
    enc = bpe.Encoder(P.PATTERN, lambda pre: [[len(p)] for p in pre])
    got = enc(["x" * 400 + f"{k} " + "y" * 900 + f"{k} z" for k in range(50)])
    assert set(enc.known) == {"z"} and enc.held < 300
    assert len(set(got)) == 50 or all(got)


PIECES = ["a", "don't", "x1.", "é", "\x1c", "\n", " ", "  ", "\t", "\u3000", "12", ".", "!?", "", "\U0001f600", "\u00a0"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12), max_size=6), st.sampled_from(["", " "]))
def test_batches_cut_where_white_space_meets(texts, between):
    texts = [between.join(t) for t in texts] + [None]
    enc = bpe.encoder(PATH, P.PATTERN)
    ref = test_ids_and_round_trip.enc if hasattr(test_ids_and_round_trip, "enc") else tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(PATH))}, special_tokens={})
    assert enc(texts) == [packed(ref.encode_ordinary(t or "")) for t in texts]


def test_crc32c():
    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (crc32c.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(1)
    data = [b"123456789", *(rng.randbytes(n) for n in (4, 5, 511, 512, 513, 2000))]
    assert crc32c.crc32c(data).tolist() == [slow(x) for x in data]
    assert crc32c.crc32c(data)[0] == 0xE3069283
    assert len(crc32c.crc32c([])) == 0


def test_record_files(spark, documents):
    tok = Tokenizer.from_file(P.path(records.VOCABULARY))
    rows = [(i * 7 % 10, t) for i, t in enumerate(ODD)] + [(4, "again"), (None, "no id")]
    path = common.shared_dir(spark, "test-records")
    ordered = documents(rows).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = records.write(ordered, path, lambda: records.encoding(P.path(records.VOCABULARY), P.PATTERN, 0))
    got = sorted(records.read(spark, path, shards).collect(), key=lambda r: r.start)
    expected = sorted(((i, t) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, expected, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, bytes(r.value)) == (i, start, packed(ids))
        start += len(ids)
    k = 0
    for shard, n, _ in shards:  # shuffled reads by the offset index
        for j in range(n):
            assert records.fetch(path, shard, j) == (expected[k + j][0], bytes(got[k + j].value))
        k += n


def test_added_tokens_as_the_library_has_them():
    tok = Tokenizer.from_file(P.path(records.VOCABULARY))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|> <|endoftext|>\n", "<|endoftext", None, "plain text"]
    got = records.encoding(P.path(records.VOCABULARY), P.PATTERN, 0)(texts)
    assert got == [packed([*tok.encode(t or "", add_special_tokens=False).ids, 0]) for t in texts]
    assert 50256 in np.frombuffer(got[0], "<u4")


def test_damaged_record_is_found(tmp_path):
    from pyarrow import BufferReader

    data = bytearray(b"".join(records.frames([records.payload(1, packed([1, 2, 3])), records.payload(None, packed([70000]))])))
    assert [records.parsed(d) for d in next(records.unframed(BufferReader(bytes(data))))] == [(1, packed([1, 2, 3])), (None, packed([70000]))]
    data[20] ^= 1
    with pytest.raises(OSError):
        next(records.unframed(BufferReader(bytes(data))))
    with pytest.raises(OSError):
        list(records.unframed(BufferReader(bytes(data[:-3]))))


def test_no_records(spark, documents):
    path = common.shared_dir(spark, "test-none")
    shards = records.write(records.in_order(documents([])), path, lambda: records.encoding(P.path(records.VOCABULARY), P.PATTERN, 0))
    assert shards == [] and records.read(spark, path, shards).count() == 0


def test_op7_against_library(spark, tiny):
    tok = Tokenizer.from_file(P.path(records.VOCABULARY))
    start, expected = 0, []
    for d in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 0]
        expected.append((d.doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted(map(tuple, records.op7_records(spark, tiny).collect())) == expected


def test_lines_of_a_stretch_are_remembered_apart():
    enc, _ = records.plain_encoder(P.path(records.VOCABULARY), P.PATTERN)
    tok = Tokenizer.from_file(P.path(records.VOCABULARY))
    texts = ["one end.\nNext word\n\nword\n", "a b.\nc\nd, e\r\nf g\n h\ti\nj %%%\n!! 1\n2 x's\n's", "\nNext x.\nNext y.\nNext"]
    for _ in range(2):
        assert enc(texts) == [packed(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    # only where other white space meets the line feed is a stretch remembered whole
    assert "\nNext" in enc.known and {w for w in enc.known if "\n" in w[1:]} == {"e\r\nf", "g\n", "word\n\nword\n"}
    joined, _ = records.plain_encoder(P.path(records.VOCABULARY), r" ?\w+|[^\w\s]+\n*|\s+")
    assert joined.lines("end.\nNext") == []  # a pattern that joins marks and line feeds
