"""WARC archives of pages, written with revisits and read back by a salvage reader (operator 13).

Each page is one record in a gzip member of its own. Of pages with equal payloads the one of the
smallest id is a ``response`` and the others are ``revisit`` records that name it. The
reader checks members (gzip's own CRC), version lines, lengths, record ends and digests.
Where a check fails it searches for the next gzip member or version line from which a whole
valid record can be read, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common
from gridbill.operators.common import key_join

#: Payloads of fewer bytes are always stored in full.
LEAST_SHARED = 100
#: Compressed bytes after which a task begins another archive, so that none has to be read by one task for long.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
#: A record's header is at most so long; a longer one is no header.
HEADER_BYTES = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_START = re.compile(re.escape(GZIP) + b"|" + re.escape(VERSION))
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


class Damaged(Exception):
    """A check of a record failed; the message says which."""


@dataclass
class Record:
    start: int
    stop: int
    fields: dict[str, str]
    payload: bytes


def record_id(*what: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(map(str, what)))}>"


def packed(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, serial: str) -> bytes:
    """A record as a gzip member. ``digest``: hexadecimal SHA-256 of the payload, which a revisit leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    own = record_id(page_id, digest) if kind == "response" and len(payload) >= LEAST_SHARED else record_id(serial)
    fields = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": urllib.parse.quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")}
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": refers_to}
    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "X-Page-ID": page_id,
               "X-Payload-Length": len(payload), "Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _digest_holds(said: str, data: bytes) -> bool:
    """Whether ``algorithm:value`` (hexadecimal or base32) is the digest of ``data``; unknown algorithms hold."""
    name, _, value = said.partition(":")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return True
    got = hashlib.new(name, data).digest()
    return value.lower() == got.hex() or value.upper().rstrip("=") == base64.b32encode(got).decode().rstrip("=")


def header(data: bytes) -> tuple[dict[str, str], int]:
    """The fields of the record that begins ``data`` (names in lower case) and where its block begins."""
    if not _VERSION.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header has no end")
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit():
        raise Damaged("no length")
    return fields, end + 4


def checked(start: int, stop: int, fields: dict[str, str], block: bytes) -> Record:
    """A record whose digests hold. The payload is what follows the HTTP header of an HTTP block, else the block."""
    if not _digest_holds(fields.get("warc-block-digest", ""), block):
        raise Damaged("block digest")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if fields.get("warc-type") != "revisit" and not _digest_holds(fields.get("warc-payload-digest", ""), payload):
        raise Damaged("payload digest")
    return Record(start, stop, fields, payload)


class Archive:
    """An archive that is read forwards through a window, which holds no more than a record and a read ahead."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.size = source, source.size()
        self.base, self.held = 0, b""

    def take(self, at: int, n: int) -> bytes:
        """Bytes ``at`` to ``at + n``, fewer at the end."""
        n = max(0, min(n, self.size - at))
        if at < self.base or at > self.base + len(self.held):
            self.base, self.held = at, b""
        lacks = at + n - self.base - len(self.held)
        if lacks > 0:
            self.held = self.held[at - self.base :] + self.source.read_at(max(lacks, min(READ_BYTES, self.size - self.base - len(self.held))), self.base + len(self.held))
            self.base = at
        return self.held[at - self.base : at - self.base + n]

    def member(self, at: int) -> tuple[list[Record], int]:
        """The records of the gzip member at an offset, and where it ends."""
        z, parts, stop = zlib.decompressobj(31), [], at
        while not z.eof:
            data = self.take(stop, 1 << 16)
            if not data:
                raise Damaged("member is cut off")
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise Damaged(f"member: {e}") from None
            stop += len(data) - len(z.unused_data)
        data, found, i = b"".join(parts), [], 0
        while i < len(data):
            fields, begin = header(data[i : i + HEADER_BYTES])
            end = i + begin + int(fields["content-length"])
            if data[end : end + 4] != b"\r\n\r\n":
                raise Damaged("record does not end at its length")
            found.append(checked(at, stop, fields, data[i + begin : end]))
            i = end + 4
        if not found:
            raise Damaged("empty member")
        return found, stop

    def plain(self, at: int) -> tuple[list[Record], int]:
        """The uncompressed record at an offset, and where it ends."""
        fields, begin = header(self.take(at, HEADER_BYTES))
        n = int(fields["content-length"])
        if at + begin + n + 4 > self.size:
            raise Damaged("record is cut off")
        data = self.take(at, begin + n + 4)
        if data[-4:] != b"\r\n\r\n":
            raise Damaged("record does not end at its length")
        return [checked(at, at + len(data), fields, data[begin:-4])], at + len(data)

    def at(self, offset: int) -> tuple[list[Record], int]:
        first = self.take(offset, len(VERSION))
        if first.startswith(GZIP):
            return self.member(offset)
        if first == VERSION:
            return self.plain(offset)
        raise Damaged("neither a member nor a version line")

    def next_start(self, offset: int) -> int:
        """The next offset that a member or a version line could begin at; the size if there is none."""
        while offset < self.size:
            data = self.take(offset, READ_BYTES)
            found = _START.search(data)
            if found:
                return offset + found.start()
            offset += max(1, len(data) - len(VERSION) + 1)
        return self.size

    def read(self) -> Iterator[Record | tuple[int, int, str]]:
        """Every record that can be recovered, and (start, stop, reason) of each gap between them."""
        at, bad, why = 0, None, ""
        while at < self.size:
            try:
                found, stop = self.at(at)
            except Damaged as e:
                if bad is None:
                    bad, why = at, str(e)
                at = self.next_start(at + 1)
                continue
            if bad is not None:
                yield bad, at, why
                bad = None
            yield from found
            at = stop
        if bad is not None:
            yield bad, self.size, why


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to): what is to be written for each page.

    Payload: the html in UTF-8 (null: empty). Of pages whose payloads are equal and of at least ``LEAST_SHARED``
    bytes those of the smallest id are responses (rows that repeat that id all are; null ids
    count as greater than others) and the others revisit it. Only digests that come twice
    or more are joined back, and a payload that a third of the pages share is spread.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    shared = p.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = common.stored(shared.where("n > 1").drop("n"), "shared-payloads").withColumn("is_shared", F.lit(True))
    joined = key_join(p, firsts, "digest", "left", counted=p.select("digest"))
    revisits = F.coalesce("is_shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisits, F.col("first")).alias("refers_to"))


def write(plan: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records to archives under ``path``; (archive, records, bytes) of each, as a stored table.

    The names hold the task's attempt, and only archives of tasks that ended well are in the
    table, so what a lost or repeated attempt leaves is never read. No pages give no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        out, name, size, records, k = None, "", 0, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

        for s in common.pieces(batches, "payload"):
            for row in s.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, size, records = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz", 0, 0
                    out, k = store.open_output_stream(f"{base}/{name}", compression=None), k + 1
                member = packed(row["page_id"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"], f"{path}/{name}/{records}")
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return common.stored(plan.mapInArrow(run, "archive string, records long, bytes long"), "archives")


READ = "archive string, start long, stop long, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, gap string"


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name, "")
    return int(value) if re.fullmatch(r"-?[0-9]{1,19}", value) else None


def _row(r: Record, archive: str, with_payload: bool) -> tuple:
    revisit = r.fields.get("warc-type") == "revisit"
    said = r.fields.get("warc-payload-digest", "").partition(":")[2].lower()
    return (archive, r.start, r.stop, _number(r.fields, "x-page-id"), r.fields.get("warc-target-uri"), r.payload if with_payload and not revisit else None,
            _number(r.fields, "x-payload-length") if revisit else len(r.payload), said if revisit else hashlib.sha256(r.payload).hexdigest(),
            r.fields.get("warc-type"), _number(r.fields, "x-refers-to-page"), None)


def read(archives: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """All rows of ``READ``: a row for each record that can be recovered from the archives of a table
    (archive), gzip members or plain, and a row with ``gap`` (the reason) for each quarantined range of bytes.

    A task reads an archive record by record. Length and digest are those of the full payload; a revisit's
    are what its header says of it. Records of other writers have a null ``page_id``.
    """
    names = [c.split()[0] for c in READ.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for n, c in zip(names, READ.split(", "), strict=True)])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{base}/{name}") as source:
                    for found in Archive(source).read():
                        if isinstance(found, Record):
                            rows.append(_row(found, name, with_payload))
                            held += len(found.payload) if with_payload else 0
                        else:
                            rows.append((name, found[0], found[1], *[None] * 8))
                            rows[-1] = (*rows[-1][:-1], found[2])
                        if len(rows) >= 4096 or held >= common.BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, READ)


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: (archive, start, stop, gap)."""
    return found.where(F.col("gap").isNotNull()).select("archive", "start", "stop", "gap")


def dangling(found: DataFrame) -> DataFrame:
    """Revisits whose response was not recovered."""
    kept = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return found.where("record_type = 'revisit'").join(kept, ["refers_to", "payload_digest"], "left_anti")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the archives: length and digest of its payload, its record's type and the page it revisits."""
    path = common.shared_dir(spark, "warc")
    archives = write(planned(common.table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    found = read(archives, path)
    return found.where(F.col("gap").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
