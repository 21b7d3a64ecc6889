"""WARC records in ZIP packages: a writer, and a reader that extracts nothing.

A package is a ZIP file with two stored (not deflated) members, a WARC file of
gzip members, one per record, and an index with a line per record. The reader
takes the end record from the package's tail, follows it (or its ZIP64 form) to the
central directory, finds where the stored members begin, reads the index and then
only the byte ranges of the records that it names.

Packages go to the folder that all executors share, under names that depend on
their content's first and last id; a task that is run again writes the same
package anew and renames it into place, so a lost executor leaves no half file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch

#: Fixed values of the ZIP format: signatures, sizes of the fixed parts, the mark of a ZIP64 value.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
END_SIZE, END64_SIZE, LOCATOR64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 56, 20, 46, 30
IN_ZIP64, IN_ZIP64_SHORT, MAX_COMMENT = 0xFFFFFFFF, 0xFFFF, 65535

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
URN = "urn:page:"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


class RangeFile:
    """Range reads from a file in any store that pyarrow reaches; counts what it reads."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self._file = fs.open_input_file(path)
        self.size = self._file.size()
        self.bytes_read = 0

    def read(self, at: int, n: int) -> bytes:
        out = self._file.read_at(n, at)
        if len(out) != n:
            raise ValueError(f"wanted {n} bytes at {at}, got {len(out)}")
        self.bytes_read += n
        return out

    def close(self) -> None:
        self._file.close()


# -- reading ----------------------------------------------------------------


def directory_place(f: RangeFile) -> tuple[int, int, int]:
    """(offset, size, number of entries) of the central directory."""
    n = min(f.size, END_SIZE + MAX_COMMENT + LOCATOR64_SIZE)
    start = f.size - n
    tail = f.read(start, n)
    at = len(tail)
    while (at := tail.rfind(END, 0, at)) >= 0:
        if at + END_SIZE <= len(tail) and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    else:
        raise ValueError("no end record: not a ZIP package")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries != IN_ZIP64_SHORT and size != IN_ZIP64 and offset != IN_ZIP64:
        return offset, size, entries
    if at < LOCATOR64_SIZE or tail[at - LOCATOR64_SIZE : at - LOCATOR64_SIZE + 4] != LOCATOR64:
        raise ValueError("a ZIP64 locator is announced but missing")
    end64 = f.read(struct.unpack_from("<Q", tail, at - LOCATOR64_SIZE + 8)[0], END64_SIZE)
    if end64[:4] != END64:
        raise ValueError("the ZIP64 locator points to no end record")
    entries, size, offset = struct.unpack_from("<QQQ", end64, 32)
    return offset, size, entries


def zip64_values(extra: bytes, wanted: list[int]) -> list[int]:
    """The values that stand in the ZIP64 extra field, in place of those that are its mark."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, out, i = extra[at + 4 : at + 4 + n], [], 0
            for value in wanted:
                if value == IN_ZIP64:
                    value, i = struct.unpack_from("<Q", body, i)[0], i + 8
                out.append(value)
            return out
        at += 4 + n
    return wanted


def members(f: RangeFile) -> list[Member]:
    """The entries of the central directory, by one range read."""
    offset, size, entries = directory_place(f)
    raw, at, out = f.read(offset, size), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", raw, at + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header_at = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n_name].decode()
        extra = raw[at + CENTRAL_SIZE + n_name : at + CENTRAL_SIZE + n_name + n_extra]
        plain, packed, header_at = zip64_values(extra, [plain, packed, header_at])
        out.append(Member(name, method, packed, header_at))
        at += CENTRAL_SIZE + n_name + n_extra + n_comment
    return out


def member_start(f: RangeFile, m: Member) -> int:
    """Where the bytes of a stored member begin."""
    if m.method != 0:
        raise ValueError(f"{m.name} is not stored; its ranges can't be read in place")
    head = f.read(m.header_at, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {m.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header_at + LOCAL_SIZE + n_name + n_extra


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def read_record(f: RangeFile, at: int, n: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of the record in a byte range."""
    raw = gzip.decompress(f.read(at, n))
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = parse_headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, parse_headers(http), payload


def read_package(uri: str) -> Iterator[tuple[int | None, dict[str, str], dict[str, str], bytes]]:
    """(page_id, WARC headers, HTTP headers, payload) of each record that the package's index names."""
    f = RangeFile(uri)
    try:
        by_name = {m.name: m for m in members(f)}
        data, index = by_name[DATA_MEMBER], by_name[INDEX_MEMBER]
        base = member_start(f, data)
        for line in f.read(member_start(f, index), index.size).decode().splitlines():
            entry = json.loads(line.split(" ", 2)[2])
            yield entry["page_id"], *read_record(f, base + entry["offset"], entry["length"])
    finally:
        f.close()


# -- writing ----------------------------------------------------------------


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP headers alone, which keep the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


class PackageWriter:
    """Builds one package in memory; its size is bounded by the caller, who starts a new one."""

    def __init__(self, zip64: bool = False) -> None:
        self.data, self.index, self.n, self.zip64 = io.BytesIO(), [], 0, zip64

    def add(self, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> None:
        record = warc_record(page_id, url, payload, digest, refers_to)
        entry = {"page_id": page_id, "offset": self.data.tell(), "length": len(record), "digest": f"sha1:{digest}", "filename": DATA_MEMBER}
        self.index.append(f"{page_id} 0 {json.dumps(entry)}")
        self.data.write(record)
        self.n += 1

    def tobytes(self) -> bytes:
        out, central = io.BytesIO(), io.BytesIO()
        for name, body in ((DATA_MEMBER, self.data.getvalue()), (INDEX_MEMBER, "\n".join(self.index).encode())):
            at, crc, size = out.tell(), zlib.crc32(body), len(body)
            wide = self.zip64 or max(at, size) >= IN_ZIP64
            n = IN_ZIP64 if wide else size
            extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
            out.write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 33, crc, n, n, len(name), len(extra)) + name.encode() + extra)
            out.write(body)
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            central.write(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, n, n, len(name), len(extra), 0, 0, 0, 0, IN_ZIP64 if wide else at) + name.encode() + extra)
        at, size = out.tell(), central.tell()
        out.write(central.getvalue())
        if self.zip64 or at >= IN_ZIP64:
            end64_at = out.tell()
            out.write(struct.pack("<4sQHHIIQQQQ", END64, END64_SIZE - 12, 45, 45, 0, 0, 2, 2, size, at))
            out.write(struct.pack("<4sIQI", LOCATOR64, 0, end64_at, 1))
            out.write(struct.pack("<4sHHHHIIH", END, 0, 0, IN_ZIP64_SHORT, IN_ZIP64_SHORT, IN_ZIP64, IN_ZIP64, 0))
        else:
            out.write(struct.pack("<4sHHHHIIH", END, 0, 0, 2, 2, size, at, 0))
        return out.getvalue()


def put(folder: str, name: str, body: bytes) -> str:
    """Write a file whole: under a name of its own first, then renamed into place."""
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(body)
    fs.move(draft, f"{path}/{name}")
    return f"{folder.rstrip('/')}/{name}"


# -- the operator -----------------------------------------------------------


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Each page with payload, digest and the page that it revisits.

    Digests are reduced to their largest id before anything meets (partial sums per
    task). Rows that revisit are told by id and digest, so payloads are shuffled once,
    by a key that parts copies from each other.
    """
    whole = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    whole = whole.withColumn("digest", F.sha1("payload"))
    large = whole.filter(F.length("payload") >= min_bytes).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = large.join(firsts, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return whole.join(revisits, ["page_id", "digest"], "left")


def write_packages(records: DataFrame, folder: str, package_bytes: int = 16 << 20, zip64: bool = False) -> DataFrame:
    """Write planned records to packages of bounded size; a row (uri, n_records) for each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, ids = PackageWriter(zip64), []

        def close() -> pa.RecordBatch:
            nonlocal package, ids
            body, n = package.tobytes(), package.n
            uri = put(folder, f"{ids[0]}-{ids[-1]}-{n}-{hashlib.sha1(body).hexdigest()[:8]}.wacz", body)
            package, ids = PackageWriter(zip64), []
            return pa.RecordBatch.from_pydict({"uri": [uri], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                package.add(page_id, url, payload, digest, refers_to)
                ids.append(page_id)
                if package.data.tell() >= package_bytes:
                    yield close()
        if ids:
            yield close()

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "uri string, n_records long")


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of all packages that column uri names, a row each; payloads are measured, then let go."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (uri for batch in batches for uri in batch.column(0).to_pylist()):
            rows = []
            for page_id, warc, http, payload in read_package(uri):
                kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{uri}: the payload of page {page_id} differs from its digest")
                to = warc.get("warc-refers-to", "").strip("<>").removeprefix(URN)
                rows.append((page_id, warc["warc-target-uri"], int(http["content-length"]), digest, kind, int(to) if to else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

    return packages.select("uri").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, spark: SparkSession, package_bytes: int = 16 << 20) -> DataFrame:
    """Write every page to a record, read all packages back; a row per page.

    Null html is an empty payload and null url an empty one. Rows that repeat an id
    are written each, by their own payload; rows with equal payloads and the same
    largest id are all responses, and so are rows without an id, which nothing refers
    to. Extra columns are not read. An empty table gives no rows.
    """
    written = cut(write_packages(plan_records(pages), scratch(spark, "packages"), package_bytes))
    n = max(1, written.count())
    return read_packages(written.repartition(min(n, 4096)))
