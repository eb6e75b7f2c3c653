"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file with stored members: ``archive/*.warc.gz`` (each record a gzip member of its own) and
``indexes/*.cdxj`` (sorted lines, one per record: the address as a SURT key, the time, and member, offset and length). The reader takes the file's tail, parses the end record, the
ZIP64 end record where there is one, and the central directory, finds the stored members from their local headers, reads the
index and then the records by their ranges, adjacent ones in one read of bounded size. Nothing is unpacked to disk and no archive is read whole.

Packages lie in the shared folder and are reached through pyarrow.fs, so it can be a local path, HDFS or an object store.
A task writes under a temporary name and renames at the end, so a repeated task leaves one whole package; readers take the
paths from the rows of the tasks that succeeded.

Null payloads count as empty; an empty table gives no package and no rows; a very long payload is a record like any other. Ids are percent-encoded in the records' names, a null id has a name of its own. Payloads are equal if
their SHA-256, SHA-1 and length are: SHA-1 alone, which the records state, has known collisions. Records with equal payloads of at least ``revisit_bytes`` bytes: rows with the smallest page_id (null
ids come last) are responses, the others revisit it. Repeated rows with that id are all responses. Smaller payloads are always responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, scratch, utf8

MEMBER_BYTES = 8 << 20
PACKAGE_BYTES = 256 << 20
READ_AHEAD = 4 << 20
#: Fixed values of the ZIP format: signatures and the extra field of ZIP64.
LOCAL, CENTRAL, END, END64, LOCATOR, ZIP64_EXTRA = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x0001
M32, M16 = 0xFFFFFFFF, 0xFFFF
_DATE, _TIME = "2024-01-01T00:00:00Z", "20240101000000"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class PackageWriter:
    """Writes stored members one after the other; sizes beyond 32 bits, or ``zip64``, give ZIP64 records."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        big = self.zip64 or len(data) >= M32
        extra = struct.pack("<HHQQ", ZIP64_EXTRA, 16, len(data), len(data)) if big else b""
        size = M32 if big else len(data)
        self._write(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._write(data)
        self.entries.append((raw, crc, len(data), start))

    def close(self) -> None:
        first = self.at
        for raw, crc, size, start in self.entries:
            far = [size, size] * (self.zip64 or size >= M32) + ([start] if self.zip64 or start >= M32 else [])
            extra = struct.pack(f"<HH{len(far)}Q", ZIP64_EXTRA, 8 * len(far), *far) if far else b""
            s, o = (M32 if self.zip64 or size >= M32 else size), (M32 if self.zip64 or start >= M32 else start)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if far else 20, 0x800, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        length, n = self.at - first, len(self.entries)
        if self.zip64 or n >= M16 or first >= M32 or length >= M32:
            end = self.at
            self._write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, first) + struct.pack("<IIQI", LOCATOR, 0, end, 1))
            n, length, first = M16, M32, M32
        self._write(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, first, 0))


class PackageReader:
    """Members of a ZIP file of which only ranges are read."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        tail_at = max(0, size - 22 - M16)
        tail = self.range(tail_at, size - tail_at)
        k = tail.rfind(struct.pack("<I", END))
        if k < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        n, length, first = struct.unpack_from("<HII", tail, k + 10)
        if n == M16 or length == M32 or first == M32:
            where = k - 20
            there = tail[where:k] if where >= 0 else self.range(tail_at + where, 20)
            signature, _, at, _ = struct.unpack("<IIQI", there)
            if signature == LOCATOR:
                record = self.range(at, 56)
                if struct.unpack_from("<I", record)[0] != END64:
                    raise ValueError("no ZIP64 end of central directory")
                n, length, first = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, p = self.range(first, length), 0
        for _ in range(n):
            if struct.unpack_from("<I", directory, p)[0] != CENTRAL:
                raise ValueError("damaged central directory")
            method, crc, packed, size_, n_name, n_extra, n_note, start = struct.unpack_from("<10xH4xIIIHHH8xI", directory, p)
            name = directory[p + 46 : p + 46 + n_name].decode()
            extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                kind, m = struct.unpack_from("<HH", extra, q)
                if kind == ZIP64_EXTRA:
                    far = iter(struct.unpack_from(f"<{m // 8}Q", extra, q + 4))
                    size_ = next(far) if size_ == M32 else size_
                    packed = next(far) if packed == M32 else packed
                    start = next(far) if start == M32 else start
                q += 4 + m
            self.members[name] = (method, packed, start, crc)
            p += 46 + n_name + n_extra + n_note

    def range(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the file is shorter than its directory says")
        return data

    def data_at(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and their number."""
        method, size, start, _ = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        signature, n_name, n_extra = struct.unpack("<I22xHH", self.range(start, 30))
        if signature != LOCAL:
            raise ValueError(f"no local header of {name}")
        return start + 30 + n_name + n_extra, size


def warc_record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record as a gzip member; a revisit has no payload but says its size and digest."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": _DATE, "WARC-Target-URI": (uri or "").replace("\r", "").replace("\n", "") or "urn:none"}
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": str(len(payload)), "Content-Type": "text/html"}
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    body = b"" if kind == "revisit" else payload
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + f"Content-Length: {len(body)}\r\n\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", 4, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(data)
    k = raw.index(b"\r\n\r\n")
    lines = raw[:k].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    return head, raw[k + 4 : k + 4 + int(head["Content-Length"])]


#: Name of a record whose page has no id; no encoded id begins like it.
NO_ID = "urn:no-page"


def _urn(page_id) -> str:
    return NO_ID if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def surt(url: str | None) -> str:
    """Sort key of an address: its host's parts from the last to the first, then port, path and query."""
    try:
        parts = urlsplit("".join((url or "").split()))
        host, port = (parts.hostname or ""), parts.port
    except ValueError:  # an address that can't be taken apart
        return "-)/"
    if not host:
        return "-)/" + quote(parts.path, safe="/%:@")
    key = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _write(batches: Iterator[pa.RecordBatch], folder: str, zip64: bool) -> Iterator[pa.RecordBatch]:
    """Packages of a task's records; a row for each: path and number of records."""
    fs, base = _open(folder)
    task = TaskContext.get().partitionId()
    serial, rows = 0, []
    out = package = None
    warc, lines, members = io.BytesIO(), [], 0

    def begin():
        nonlocal out, package, temporary, members
        members = 0
        fs.create_dir(base, recursive=True)
        temporary = f"{base}/.{task:06d}-{uuid.uuid4().hex}"
        out = fs.open_output_stream(temporary)
        package = PackageWriter(out, zip64)

    def member() -> None:
        nonlocal warc, lines, members
        if lines:
            name = f"{members:05d}"
            package.add(f"archive/{name}.warc.gz", warc.getvalue())
            package.add(f"indexes/{name}.cdxj", "".join(sorted(f"{key} {_TIME} {json.dumps(x | {'filename': f'archive/{name}.warc.gz'})}\n" for key, x in lines)).encode())
            members += 1
        warc, lines = io.BytesIO(), []

    def end(n: int) -> None:
        nonlocal serial, package
        member()
        package.close()
        out.close()
        final = f"{base}/{task:06d}-{serial:04d}-{uuid.uuid4().hex[:8]}.wacz"
        fs.move(temporary, final)
        rows.append((f"{folder}/{os.path.basename(final)}", n))
        serial, package = serial + 1, None

    temporary, n = "", 0
    for batch in batches:
        for page_id, url, first, html in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "first", "html")), strict=True):
            if package is None:
                begin()
                n = 0
            revisit = first is not None and first != page_id
            digest = base32_sha1(html)
            record = warc_record("revisit" if revisit else "response", _urn(page_id), url, html, digest, _urn(first) if revisit else None)
            lines.append((surt(url), {"url": url or "", "digest": f"sha1:{digest}", "offset": warc.tell(), "length": len(record)}))
            warc.write(record)
            n += 1
            if warc.tell() >= MEMBER_BYTES:
                member()
                if package.at >= PACKAGE_BYTES:
                    end(n)
    if package is not None:
        end(n)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], ["path", "n_records"])


def payload_key(payload: Column) -> Column:
    """What equal payloads share, and others don't."""
    return F.concat_ws(" ", F.sha2(payload, 256), F.sha1(payload), F.octet_length(payload).cast("string"))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, zip64: bool = False) -> DataFrame:
    """Write a record for each page; returns path and n_records of each package (written when that is evaluated)."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), utf8(pages[html_col]).alias("html"))
    keyed = rows.withColumn("key", payload_key(F.col("html")))
    large = keyed.where(F.octet_length("html") >= revisit_bytes)
    # Only payloads that occur again are joined, found from their keys alone and written, so that their number is known: where they are few they are broadcast
    # by Spark's own bound and no payload is shuffled; where they are many, rows of a hot payload are split by the skew join, since the other side has one row.
    firsts = materialize(large.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "warc-repeated")
    first = F.when(F.octet_length("html") >= revisit_bytes, F.col("first"))
    joined = keyed.join(firsts, "key", "left").select("page_id", "url", first.alias("first"), "html")
    return joined.mapInArrow(lambda it: _write(it, folder, zip64), "path string, n_records long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the packages, by ranges: the index of a member, then its records in order."""
    names = ["urn", "url", "record_type", "digest", "length", "refers_to", "payload"]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, at = _open(path)
            with fs.open_input_file(at) as file:
                package = PackageReader(file, file.size())
                for index in sorted(m for m in package.members if m.startswith("indexes/")):
                    entries = [json.loads(line.split(" ", 2)[2]) for line in package.range(*package.data_at(index)).decode().splitlines()]
                    where = {name: package.data_at(name)[0] for name in {e["filename"] for e in entries}}
                    out: list[list] = []
                    held = 0
                    for data in _ranges(package, [(where[e["filename"]] + e["offset"], e["length"]) for e in entries]):
                        head, body = parse_record(data)
                        refers = head.get("WARC-Refers-To")
                        if head["WARC-Type"] == "response" and (head["WARC-Payload-Digest"] != f"sha1:{base32_sha1(body)}" or int(head["WARC-Payload-Length"]) != len(body)):
                            raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} isn't what its header says")
                        out.append([head["WARC-Record-ID"][1:-1], head["WARC-Target-URI"], head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"]), refers and refers[1:-1], body])
                        held += len(body)
                        if held >= READ_AHEAD:
                            yield _records(out, names)
                            out, held = [], 0
                    if out:
                        yield _records(out, names)


def _ranges(package: PackageReader, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of ranges, in the order of their places; runs of adjacent ones are read at once, up to ``READ_AHEAD`` bytes."""
    ranges = sorted(ranges)
    k = 0
    while k < len(ranges):
        start, length = ranges[k]
        end, n = start + length, k + 1
        while n < len(ranges) and ranges[n][0] == end and end + ranges[n][1] - start <= READ_AHEAD:
            end += ranges[n][1]
            n += 1
        data = package.range(start, end - start)
        yield from (data[a - start : a - start + m] for a, m in ranges[k:n])
        k = n


def _records(out: list[list], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def read_packages(paths: DataFrame) -> DataFrame:
    """Records of the packages in ``path``: urn, url, record_type, digest, length, refers_to, payload (empty for revisits)."""
    return paths.select("path").mapInArrow(_read, "urn string, url string, record_type string, digest string, length long, refers_to string, payload binary")


def round_trip(pages: DataFrame, revisit_bytes: int = 0, id_col: str = "page_id", **columns) -> DataFrame:
    """Write packages and read them again: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType
    folder = scratch(spark, "warc")
    written = materialize(write_packages(pages, folder, id_col=id_col, revisit_bytes=revisit_bytes, **columns), "warc-packages")
    records = read_packages(written.repartition(partitions(spark)))
    plain = lambda c: F.when(F.col(c) != NO_ID, F.url_decode(F.substring(c, 10, 1 << 30))).cast(id_type)
    return records.select(plain("urn").alias(id_col), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", plain("refers_to").alias("refers_to"))
