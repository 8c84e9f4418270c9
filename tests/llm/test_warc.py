"""Operator 13: round trips, revisits, and salvage of damaged archives."""

import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from pyarrow import fs

from gridbill.llm import common, warc

BIG, OTHER = "<p>" + "x" * 200, "<p>" + "é" * 60
ODD = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, None), (4, "", ""), (5, "u\r\nWARC-Type: revisit", "a" * 99), (6, "ü ö", "a" * 99),
    (7, "h", "a" * 100), (8, "h", "a" * 100), (None, "null id", BIG), (None, "n", OTHER), (None, "n", OTHER), (-9, "neg", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9),
    (10, "same id", OTHER + "1"), (10, "same id", OTHER + "1"), (11, "x", OTHER + "1"), (12, "big", "".join(map(chr, range(32, 5000))) * 60), *[(i, "c", BIG + "c") for i in range(50, 90)],
]


@pytest.fixture()
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "d", 1, "x") for r in rows], "page_id long, url string, html string, digest string, n long, record_type string")


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in data:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in data:
        f = first.get(p)
        again = len(p) >= 100 and i != f
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def results(found):
    return sorted((tuple(r) for r in found.where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def written(spark, frame, **kw):
    path = common.shared_dir(spark, "test-warc")
    return path, warc.write(warc.planned(frame), path, **kw)


@pytest.mark.parametrize("size", [1 << 30, 500])
def test_round_trip(spark, pages, size):
    path, archives = written(spark, pages(ODD).repartition(3), archive_bytes=size)
    found = warc.read(archives, path, with_payload=True).cache()
    assert results(found) == expected(ODD)
    assert warc.gaps(found).count() == 0 and warc.dangling(found).count() == 0
    got = {(r.page_id, r.payload_digest): bytes(r.payload) for r in found.where("record_type = 'response'").collect()}
    assert got == {(i, hashlib.sha256((h or "").encode()).hexdigest()): (h or "").encode() for i, _, h in ODD for e in expected(ODD) if e[0] == i and e[3] == "response" and e[2] == hashlib.sha256((h or "").encode()).hexdigest()}
    assert archives.count() > (1 if size > 1000 else 20)


def test_no_pages(spark, pages):
    path, archives = written(spark, pages([]))
    assert archives.count() == 0 and warc.read(archives, path).count() == 0


def test_attempts_left_behind_are_not_read(spark, pages):
    path, archives = written(spark, pages(ODD))
    store, base = fs.FileSystem.from_uri(path)
    with store.open_output_stream(f"{base}/part-000000-999999-0000.warc.gz", compression=None) as out:
        out.write(member(77))
    assert results(warc.read(archives, path)) == expected(ODD)


def member(i, kind="response"):
    payload = random.Random(i).randbytes(3000 + i * 7)
    return warc.packed(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), kind, None, f"s{i}")


def salvaged(data):
    records, gaps = [], []
    for x in warc.Archive(pa.BufferReader(data)).read():
        (records if isinstance(x, warc.Record) else gaps).append(x)
    return [int(r.fields["x-page-id"]) for r in records], gaps


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("step", [1 << 20, 50])
def test_each_kind_of_damage(monkeypatch, plain, step):
    monkeypatch.setattr(warc, "READ_BYTES", step)
    each = [gzip.decompress(member(i)) if plain else member(i) for i in range(5)]
    at = [sum(map(len, each[:k])) for k in range(6)]
    whole = b"".join(each)
    assert salvaged(whole) == ([0, 1, 2, 3, 4], [])
    flipped = bytearray(whole)
    flipped[at[2] + len(each[2]) // 2] ^= 0x55
    ids, gaps = salvaged(bytes(flipped))
    assert ids == [0, 1, 3, 4] and [g[:2] for g in gaps] == [(at[2], at[3])]
    assert salvaged(whole[: at[4] + 100])[0] == [0, 1, 2, 3]  # cut off at the end
    assert salvaged(whole[: at[4] + 100])[1][0][:2] == (at[4], at[4] + 100)
    ids, gaps = salvaged(whole[: at[1]] + b"\x00garbage \x1f\x8b\x08 WARC/1. WARC/1.1\r\n\r\n" * 20 + whole[at[1] :])
    assert ids == [0, 1, 2, 3, 4] and len(gaps) == 1 and gaps[0][0] == at[1]
    ids, gaps = salvaged(whole[: at[1] + 40] + whole[at[3] :])  # bytes lost over a border
    assert ids == [0, 3, 4] and gaps[0][:2] == (at[1], at[1] + 40)
    assert salvaged(whole[50:])[0] == [1, 2, 3, 4] and salvaged(whole[50:])[1][0][:2] == (0, at[1] - 50)
    assert salvaged(b"") == ([], []) and salvaged(b"nothing")[1][0][:2] == (0, 7)


def test_damage_at_every_byte_loses_one_record():
    each = [member(i) for i in (1, 2, 3)]
    a, b = len(each[0]), len(each[0]) + len(each[1])
    for k in range(a, b, 37):
        data = bytearray(b"".join(each))
        data[k] ^= 0xFF
        ids, gaps = salvaged(bytes(data))
        assert (ids, [g[:2] for g in gaps]) in (([1, 3], [(a, b)]), ([1, 2, 3], []))  # bytes of gzip's own header that nothing depends on


def test_member_of_many_records_and_mixed_archives():
    raw = b"".join(gzip.decompress(member(i)) for i in (1, 2, 3))
    assert salvaged(gzip.compress(raw) + gzip.decompress(member(4)) + member(5)) == ([1, 2, 3, 4, 5], [])


def test_digests_of_other_writers():
    import base64

    block = b"hello"
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    record = lambda d: b"WARC/1.0\r\nWARC-Type: resource\r\nX-Page-ID: 3\r\nWARC-Block-Digest: " + d.encode() + b"\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert salvaged(record(f"sha1:{sha1}"))[0] == [3] and salvaged(record("own:1"))[0] == [3]
    assert salvaged(record("sha1:" + "A" * 32))[1][0][2] == "block digest"


def test_damaged_archive_through_spark(spark, pages):
    path, archives = written(spark, pages([(i, f"u{i}", f"<p>{i} " + "text " * 300) for i in range(40)]).coalesce(1))
    name = archives.first().archive
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}/{name}") as f:
        data = bytearray(f.read())
    data[len(data) // 2 : len(data) // 2 + 30] = bytes(30)
    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(bytes(data))
    found = warc.read(archives, path).cache()
    log = warc.gaps(found).collect()
    assert found.where("gap is null").count() in (38, 39) and len(log) == 1
    assert log[0].archive == name and log[0].start <= len(data) // 2 < log[0].stop


def test_op13_on_the_test_data(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(map(tuple, warc.op13_warc(spark, tiny).collect()), key=str)
    assert got == expected(rows)
