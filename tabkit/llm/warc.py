"""WARC archives: one gzip member per record, written and read by tasks over the shared folder.

Writer. One response record per row; a row whose payload another row has, too, becomes a revisit record of
the one with the smallest id (identical-payload-digest profile, HTTP header only). Each task fills archives of
at most about `archive_bytes` under names of its own, and reports them in segments; only the segments of tasks
that ended are listed, so that retried tasks and lost executors leave no doubled records.

Reader. Each segment is read on its own: chunks are decompressed as they come, a record's header ends at the
first empty line, its Content-Length frames the block, and both SHA-1 digests are compared. Damage raises.

Defined results: a null payload is empty; a null id counts as the largest (two rows with the smallest id are
both responses; if all ids of a payload are null, all are responses); a null url has no target header; an
empty table gives no archive and no rows; other columns are ignored. A payload is held whole by one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.session import scratch_path, written

# Fixed values of the format
VERSION = b"WARC/1.1"
SAME_PAYLOAD = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENTS = "archive string, start long, stop long, records long"
RECORDS = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: bytes, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind]
    lines += [f"{k}: {v}".encode() for k, v in headers]
    lines += [f"WARC-Block-Digest: sha1:{sha1(block)}".encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(id_) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{id_}')}>"


def _page_record(id_, url, payload: bytes, digest: str, first, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Record-ID", _urn(id_)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if id_ is not None:
        headers.append(("WARC-Page-ID", str(id_)))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is None:
        return _record(b"response", headers, http + payload)
    headers += [("WARC-Refers-To", _urn(first)), ("WARC-Refers-To-Page-ID", str(first))]
    headers.append(("WARC-Profile", SAME_PAYLOAD.decode()))
    return _record(b"revisit", headers, http)


class _Archive:
    """One archive that grows member by member."""

    def __init__(self, folder: str, date: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        store, name = fs.FileSystem.from_uri(self.path)
        self.out, self.size, self.start, self.records = store.open_output_stream(name, compression=None), 0, 0, 0
        info = b"format: WARC File Format 1.1\r\n"
        self.add(_record(b"warcinfo", [("WARC-Record-ID", _urn(self.path)), ("WARC-Date", date),
                                       ("Content-Type", "application/warc-fields")], info))
        self.records = 0

    def add(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.size += len(member)
        self.records += 1

    def segment(self) -> tuple:
        found = (self.path, self.start, self.size, self.records)
        self.start, self.records = self.size, 0
        return found


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
        names=["archive", "start", "stop", "records"],
    )


def write_warc(
    pages: DataFrame,
    folder: str,
    id_: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = 64 << 20,
    segment_bytes: int = 8 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write the rows into archives under `folder`; returns the written table of segments.

    Only digests are shuffled to find equal payloads. The table of repeated payloads is broadcast if Spark's
    limit allows it; otherwise rows and table meet in a shuffle, whose hot digests Spark splits.
    """
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_).cast("long").alias("id"), F.col(url).alias("url"), data.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.where(F.length("payload") >= min_bytes).groupBy("digest")
    firsts = same.agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(written(firsts, "warc-firsts"), "digest", "left")
    is_first = F.col("id").eqNullSafe(F.col("first")) | (F.length("payload") < min_bytes)
    rows = rows.withColumn("first", F.when(~is_first, F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            found = []
            ids, urls, digests, firsts_ = (batch.column(c).to_pylist() for c in ("id", "url", "digest", "first"))
            for i, body in enumerate(batch.column("payload")):
                archive = archive or _Archive(folder, date)
                digest = base64.b32encode(bytes.fromhex(digests[i])).decode()
                archive.add(_page_record(ids[i], urls[i], body.as_py(), digest, firsts_[i], date))
                if archive.size - archive.start >= segment_bytes:
                    found.append(archive.segment())
                if archive.size >= archive_bytes:
                    if archive.records:
                        found.append(archive.segment())
                    archive.out.close()
                    archive = None
            if found:
                yield _segments(found)
        if archive:
            archive.out.close()
            if archive.records:
                yield _segments([archive.segment()])

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    return written(rows.select("id", "url", "payload", "digest", "first").mapInArrow(write, SEGMENTS), "warc-segments")


class _Members:
    """Decompressed bytes of one gzip member after the other, `chunk` compressed bytes at a time."""

    def __init__(self, stream, left: int, chunk: int = 1 << 16):
        self.stream, self.left, self.chunk, self.rest = stream, left, chunk, b""
        self.unpack, self.ready = None, b""

    def open(self) -> bool:
        if not self.rest and not self._fetch():
            return False
        self.unpack, self.ready = zlib.decompressobj(31), b""
        return True

    def _fetch(self) -> bool:
        data = self.stream.read(min(self.chunk, self.left)) if self.left else b""
        self.left -= len(data)
        self.rest += data
        return bool(data)

    def _more(self) -> bool:
        """Decompress what is there; False at the member's end."""
        if self.unpack.eof:
            return False
        if not self.rest and not self._fetch():
            raise ValueError("the archive ends inside a record")
        self.ready += self.unpack.decompress(self.rest)
        self.rest = self.unpack.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record's header does not end")
        found, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return found

    def exactly(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise ValueError("a record is shorter than its Content-Length")
        found, self.ready = self.ready[:n], self.ready[n:]
        return found

    def close(self) -> None:
        while self._more():
            pass
        if self.ready:
            raise ValueError("a record is longer than its Content-Length")


def _fields(head: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = head.split(b"\r\n")
    pairs = (x.decode().partition(":") for x in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def records(stream, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record in `size` bytes of a stream; the digests are verified."""
    members = _Members(stream, size)
    while members.open():
        version, fields = _fields(members.until(b"\r\n\r\n"))
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        block = members.exactly(int(fields["content-length"]))
        if members.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        members.close()
        if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1(block)}":
            raise ValueError(f"block digest differs in {fields.get('warc-record-id')}")
        payload = block
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            fields["http-content-length"] = _fields(head)[1].get("content-length", "0")
        if fields["warc-type"] == "response" and fields.get("warc-payload-digest") != f"sha1:{sha1(payload)}":
            raise ValueError(f"payload digest differs in {fields.get('warc-record-id')}")
        yield fields, payload


def read_warc(segments: DataFrame, payloads: bool = True) -> DataFrame:
    """Response and revisit records of the segments, one task per few segments.

    A revisit's payload is null; its size is the one in its HTTP header and its digest the one in its header.
    """
    spark = segments.sparkSession
    schema = RECORDS + (", payload binary" if payloads else "")
    arrow = [("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    arrow = pa.schema(arrow + [("payload", pa.binary())] * payloads)
    number = lambda x: None if x is None else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(part["archive"])
                rows, held = [], 0
                with store.open_input_file(name) as stream:
                    stream.seek(part["start"])
                    for fields, payload in records(stream, part["stop"] - part["start"]):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        n = len(payload) if kind == "response" else int(fields["http-content-length"])
                        row = [number(fields.get("warc-page-id")), fields.get("warc-target-uri"), kind,
                               number(fields.get("warc-refers-to-page-id")), n,
                               fields["warc-payload-digest"].removeprefix("sha1:")]
                        rows.append(row + [payload if kind == "response" else None] * payloads)
                        held += len(payload) * payloads + 100
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], arrow)

    n = max(1, segments.count())
    cores = spark.sparkContext.defaultParallelism
    return segments.repartition(max(min(n, cores), n // 4)).mapInArrow(read, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archive the pages in the shared folder and read the archives back, without payloads."""
    return read_warc(write_warc(pages, scratch_path(pages.sparkSession, "warc"), **options), payloads=False)
