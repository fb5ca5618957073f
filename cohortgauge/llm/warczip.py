"""WARC archives packaged in ZIP files: written by tasks, and read by ranges.

A package holds two stored (not compressed) members: ``archive/data.warc.gz``, in which every
record is a gzip member of its own, and ``indexes/index.cdxj``, which names each record's
offset and length inside that member. The reader never extracts a package. It reads the end of
the file, follows it to the central directory (by way of the ZIP64 records where a field
overflows), finds where the members' bytes lie, reads the index, and fetches records by range.

Payloads are compared by digest in the shuffle before anything is written. Only the first
record of equal payloads carries it; the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.tables import new_path, raw_bytes, stored, task_count

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Compressed bytes after which a task starts its next package.
PACKAGE = 64 << 20
#: Bytes of neighbouring records that are fetched at once.
FETCH = 4 << 20
#: Bytes of packages that one task reads.
READ_BYTES = 64 << 20
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LARGE = 0xFFFFFFFF


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store behind a path, and the path as it knows it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


# ---------------------------------------------------------------- ZIP packages

class PackageWriter:
    """Writes stored members one after the other; sizes may exceed 4 GiB."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        # Sizes and checksum follow the data (flag bit 3), so that it can be streamed. The
        # ZIP64 field tells readers that the descriptor's sizes have 8 bytes.
        raw = name.encode()
        self.members.append({"name": raw, "header": self.at, "size": 0, "crc": 0})
        self._write(struct.pack("<4s5H3L2H", b"PK\3\4", 45, 8 | 0x800, 0, 0, 0x21, 0, LARGE, LARGE, len(raw), 20))
        self._write(raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def put(self, data: bytes) -> None:
        member = self.members[-1]
        member["size"] += len(data)
        member["crc"] = zlib.crc32(data, member["crc"])
        self._write(data)

    def end(self) -> None:
        member = self.members[-1]
        self._write(struct.pack("<4sLQQ", b"PK\7\x08", member["crc"], member["size"], member["size"]))

    def close(self) -> int:
        start = self.at
        for m in self.members:
            extra = struct.pack("<2H3Q", 1, 24, m["size"], m["size"], m["header"])
            self._write(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 8 | 0x800, 0, 0, 0x21, m["crc"], LARGE, LARGE, len(m["name"]), len(extra), 0, 0, 0, 0, LARGE))
            self._write(m["name"] + extra)
        size, count = self.at - start, len(self.members)
        tail = self.at
        self._write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, start))
        self._write(struct.pack("<4sLQL", b"PK\6\7", 0, tail, 1))
        self._write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, LARGE), LARGE, 0))
        return self.at


def read_range(file, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"package ends early: {size} bytes wanted at {at}, {len(data)} found")
    return data


def directory(file) -> dict[str, tuple[int, int]]:
    """Where each stored member's bytes begin and how many there are.

    Raises for files without an end record, for several disks, and for members that are
    compressed or encrypted, since those have no byte ranges of their own.
    """
    size = file.size()
    tail = min(size, 22 + 0xFFFF)
    data = read_range(file, size - tail, tail)
    end = data.rfind(b"PK\5\6")
    while end >= 0 and (end + 22 > len(data) or end + 22 + struct.unpack_from("<H", data, end + 20)[0] != len(data)):
        end = data.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("not a ZIP package: no end of central directory")
    disk, first, _, count, length, start, _ = struct.unpack_from("<4H2LH", data, end + 4)
    at = size - tail + end
    if 0xFFFF in (disk, first, count) or LARGE in (length, start):
        mark, _, where, _ = struct.unpack("<4sLQL", read_range(file, at - 20, 20))
        if mark != b"PK\6\7":
            raise ValueError("ZIP64 locator is missing")
        mark, _, _, _, disk, first, _, count, length, start = struct.unpack("<4sQ2H2L4Q", read_range(file, where, 56))
        if mark != b"PK\6\6":
            raise ValueError("ZIP64 end of central directory is missing")
    if disk or first:
        raise ValueError("packages over several disks are not read")
    central, at, found = read_range(file, start, length), 0, {}
    for _ in range(count):
        mark, _, _, flags, method, _, _, _, packed, plain, names, extras, comments, _, _, _, header = struct.unpack_from("<4s6H3L5H2L", central, at)
        if mark != b"PK\1\2":
            raise ValueError("central directory entry expected")
        name = central[at + 46:at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = central[at + 46 + names:at + 46 + names + extras]
        packed, header = _wide(extra, plain, packed, header)
        if method or flags & 1:
            raise ValueError(f"member {name} is compressed or encrypted")
        local = struct.unpack("<4s5H3L2H", read_range(file, header, 30))
        found[name] = header + 30 + local[-2] + local[-1], packed
        at += 46 + names + extras + comments
    return found


def _wide(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int]:
    """Sizes and offset from the ZIP64 field where their own fields overflow."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            if plain == LARGE:
                values.pop(0)
            packed = values.pop(0) if packed == LARGE else packed
            header = values.pop(0) if header == LARGE else header
        at += 4 + size
    return packed, header


# ---------------------------------------------------------------- WARC records

def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("WARC record expected")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str | None) -> str:
    return "".join(c if c.isprintable() else "%" + c.encode().hex().upper() for c in text or "")


def _record_of(page_id, url, payload: bytes, refers_to, digest: str) -> tuple[bytes, str]:
    """The record's bytes and its type."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", datetime.fromtimestamp(0, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Target-URI", _one_line(url)),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", SAME_PAYLOAD), ("X-Refers-To-Page-ID", str(refers_to))]
    return record(fields, answer + (payload if kind == "response" else b"")), kind


# ---------------------------------------------------------------- Spark

def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` as ``page_id, url, html`` with ``refers_to``: the smallest id of the equal payloads, if another's.

    Rows that share the smallest id are all first ones. Payloads below ``least_bytes`` refer to none.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = rows.withColumn("key", F.sha1("html"))
    several = key.where(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # Stored, so that the join can split the rows of one payload between tasks.
    firsts = stored(several.where("n > 1").drop("n"), "first-payloads").hint("shuffle_hash")
    joined = key.join(firsts, "key", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write every page as a record; one stored row per package: ``path, records, bytes``.

    ``folder`` must be shared by all executors (by default a new one in ``spark.checkpoint.dir``).
    A task that runs again writes new files; the rows name those that count.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        package = None
        for batch in batches:
            urls, payloads = raw_bytes(batch.column("url")), raw_bytes(batch.column("html"))
            for page, url, payload, first in zip(batch.column("page_id").to_pylist(), urls, payloads, batch.column("refers_to").to_pylist(), strict=True):
                if package is None:
                    store.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{root}/{name}")
                    package, index, offset = PackageWriter(out), [], 0
                    package.begin(ARCHIVE)
                digest = base32_sha1(payload)
                data, kind = _record_of(page, url.decode() if url is not None else None, payload, first, digest)
                packed = gzip_member(data)
                package.put(packed)
                index.append(json.dumps({"offset": offset, "length": len(packed), "type": kind, "digest": digest}))
                offset += len(packed)
                if offset >= PACKAGE:
                    yield _finish(package, out, index, f"{folder}/{name}")
                    package = None
        if package is not None:
            yield _finish(package, out, index, f"{folder}/{name}")

    fields = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
    return stored(with_first(pages, least_bytes).mapInArrow(run, fields), "packages")


def _finish(package: PackageWriter, out, index: list[str], path: str) -> pa.RecordBatch:
    package.end()
    package.begin(INDEX)
    package.put("".join(line + "\n" for line in index).encode())
    package.end()
    size = package.close()
    out.close()
    return pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)], "bytes": [size]})


def read_tasks(packages: DataFrame) -> int:
    """Tasks to read the packages with: one for each 64 MiB, or for each package as far as there are cores.

    The rows that name packages are short and stand for megabytes. A stated number keeps adaptive
    execution from merging them by their own bytes.
    """
    sizes = packages.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    return max(1, -(-(sizes["bytes"] or 0) // READ_BYTES), min(sizes["n"], task_count(packages.sparkSession)))


def index_rows(packages: DataFrame) -> DataFrame:
    """``path, first, bytes, offsets, lengths``: stretches of neighbouring records of about 4 MiB, from the indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = filesystem(path)
                with store.open_input_file(name) as file:
                    members = directory(file)
                    base = members[ARCHIVE][0]
                    lines = read_range(file, *members[INDEX]).decode().splitlines()
                rows, held = [], None
                for line in lines:
                    entry = json.loads(line)
                    at, size = base + entry["offset"], entry["length"]
                    if held is None or at + size - held["first"] > FETCH:
                        held = {"path": path, "first": at, "bytes": 0, "lengths": []}
                        rows.append(held)
                    held["lengths"].append(size)
                    held["bytes"] += size
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("first", pa.int64()), ("bytes", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    return packages.select("path").repartition(read_tasks(packages), "path").mapInArrow(run, "path string, first long, bytes long, lengths array<long>")


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the packages: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    Ids are read back as longs. The length and digest of a response are those of the payload
    that was read, and must be those in its header; a revisit's come from its headers. With
    ``payloads=True`` also ``payload`` (null for revisits).
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, size, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "bytes", "lengths")), strict=True):
                store, name = filesystem(path)
                with store.open_input_file(name) as file:
                    data = read_range(file, first, size)
                at, rows = 0, []
                for length in lengths:
                    rows.append(_row(*parse_record(zlib.decompress(data[at:at + length], 31)), payloads))
                    at += length
                yield pa.RecordBatch.from_pylist(rows, schema)

    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index_rows(packages).repartition(read_tasks(packages), "path", "first").mapInArrow(run, fields + (", payload binary" if payloads else ""))


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(head.rpartition(b"Content-Length: ")[2])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"payload of page {fields.get('X-Page-ID')} is damaged")
    page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    row = {
        "page_id": None if page is None else int(page), "url": fields["WARC-Target-URI"], "payload_bytes": length,
        "payload_digest": digest, "record_type": kind, "refers_to": None if first is None else int(first),
    }
    return row | ({"payload": payload if kind == "response" else None} if payloads else {})
