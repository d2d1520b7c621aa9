"""WARC records in ZIP packages, read back by byte ranges.

A package is a ZIP archive whose members are stored, not compressed: ``archive/data.warc.gz`` with one gzip member
a record, and ``indexes/index.cdxj`` with each record's offset and length. Tasks write packages as files in the shared folder. The
reader opens a file, parses the end record, the ZIP64 locator and end record, and the central directory, finds where members' bytes begin,
and reads single records by range; nothing is extracted, and what isn't asked for isn't read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, checkpointed, shared_dir, table

DEDUP_BYTES = 1000
PACKAGE_BYTES = 2 << 20
SALTS = 16
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_U32, _U16 = 0xFFFFFFFF, 0xFFFF
_EPOCH = "2000-01-01T00:00:00Z"


class ZipWriter:
    """A ZIP archive of stored members; ZIP64 fields where a number needs them, or always on request."""

    def __init__(self, zip64: bool = False) -> None:
        self.parts: list[bytes] = []
        self.at = 0
        self.zip64 = zip64
        self.members: list[tuple[bytes, int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.parts.append(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        big = self.zip64 or len(data) >= _U32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = _U32 if big else len(data)
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x2821, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append((raw, crc, len(data), start))

    def close(self, comment: bytes = b"") -> bytes:
        start = self.at
        for raw, crc, size, offset in self.members:
            big = self.zip64 or size >= _U32 or offset >= _U32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            s, o = (_U32, _U32) if big else (size, offset)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 0x2821, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or n >= _U16 or start >= _U32:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            n, size, start = _U16, _U32, _U32
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, size, start, len(comment)) + comment)
        return b"".join(self.parts)


#: read(offset, size) of a store, such as a slice of bytes or a range request
Read = Callable[[int, int], bytes]


class ZipReader:
    """Members of a ZIP archive by byte ranges: ``members`` maps names to (method, offset of the local header, stored size)."""

    def __init__(self, read: Read, size: int) -> None:
        self.read = read
        tail_at = max(0, size - (1 << 16) - 22)
        tail = read(tail_at, size - tail_at)
        at = len(tail)
        while True:
            at = tail.rfind(b"PK\5\6", 0, at)
            if at < 0:
                raise ValueError("no end of central directory")
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        _, _, _, n, length, start = struct.unpack_from("<HHHHII", tail, at + 4)
        if _U16 in (n,) or _U32 in (length, start):
            locator = read(tail_at + at - 20, 20)
            if locator[:4] == b"PK\6\7":
                end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != b"PK\6\6":
                    raise ValueError("the ZIP64 locator points to no ZIP64 end record")
                n, length, start = struct.unpack_from("<QQQ", end, 32)
        directory, at = read(start, length), 0
        self.members: dict[str, tuple[int, int, int]] = {}
        for _ in range(n):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("a damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, full, names, extras, comments = struct.unpack_from("<IIHHH", directory, at + 20)
            offset = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = directory[at + 46 + names : at + 46 + names + extras], 0
            while e + 4 <= len(extra):
                kind, width = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # 64-bit values stand only for the fields that are full, in this order
                    values = iter(struct.unpack_from(f"<{width // 8}Q", extra, e + 4))
                    full = next(values) if full == _U32 else full
                    packed = next(values) if packed == _U32 else packed
                    offset = next(values) if offset == _U32 else offset
                e += 4 + width
            self.members[name] = method, offset, packed
            at += 46 + names + extras + comments

    def locate(self, name: str) -> tuple[int, int]:
        """(offset, size) of a stored member's bytes."""
        method, offset, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed, so its records have no ranges")
        head = self.read(offset, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        names, extras = struct.unpack_from("<HH", head, 26)
        return offset + 30 + names + extras, size


def _name(page: int | None) -> str:
    return f"urn:page:{'none' if page is None else page}"


def _page(name: str) -> int | None:
    tail = name.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with a response record, or with a revisit, which has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_name(page)}>", f"WARC-Date: {_EPOCH}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record's gzip member; header names in lower case."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    head = _headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    if head["warc-type"] in ("response", "revisit", "request"):
        http, _, payload = block.partition(b"\r\n\r\n")
        return head, _headers(http), payload
    return head, {}, block


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


class Package:
    """Records on their way into one ZIP package."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.index: list[str] = []
        self.at = 0

    def add(self, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        data = record(page, url, payload, digest, refers_to)
        self.index.append(f"{_name(page)} 20000101000000 " + json.dumps({"filename": "data.warc.gz", "offset": self.at, "length": len(data)}))
        self.parts.append(data)
        self.at += len(data)

    def close(self, zip64: bool = False) -> bytes:
        out = ZipWriter(zip64)
        out.add(ARCHIVE, b"".join(self.parts))
        out.add(INDEX, "".join(x + "\n" for x in sorted(self.index)).encode())
        return out.close()


def records(read: Read, size: int, wanted: Callable[[int | None], bool] | None = None) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Every record that a package's indexes list, or those of wanted pages, each by one range."""
    package = ZipReader(read, size)
    starts: dict[str, int] = {}
    for name in package.members:
        if not name.startswith("indexes/"):
            continue
        start, length = package.locate(name)
        for line in read(start, length).decode().splitlines():
            if wanted is not None and not wanted(_page(line.split(" ", 1)[0])):
                continue
            entry = json.loads(line[line.index("{") :])
            member = "archive/" + entry["filename"]
            if member not in starts:
                starts[member] = package.locate(member)[0]
            yield parse(read(starts[member] + entry["offset"], entry["length"]))


def decide(pages: DataFrame, least: int = DEDUP_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of at least ``least`` bytes all but the largest page revisit it.

    A null html is an empty payload. Rows that share the largest page_id are all responses. Payloads of pages
    with null ids only have no largest id, so they are responses; beside others a null id revisits. Page ids are whole numbers; other
    columns than page_id, url and html aren't read. Payloads are equal if their SHA-256 is. Smaller payloads aren't shuffled, and the
    pages of one payload meet its largest id in SALTS places.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html"), F.sha1(body).alias("digest"))
    big = F.coalesce(F.octet_length("html") >= least, F.lit(False))
    large = pages.where(big).withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    copied = large.groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    out = salted.join(copied, ["key", "salt"], "left").select("page_id", "url", "html", "digest", revisits.alias("refers_to"))
    return out.unionByName(pages.where(~big).withColumn("refers_to", F.lit(None).cast("long")))


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path there) of a folder or file, given by URI or by path; raises for a store that can't be opened by ranges."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _packages(batches: Iterator[pa.RecordBatch], package_bytes: int, zip64: bool) -> Iterator[bytes]:
    open_ = Package()
    for batch in batches:
        for page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
            open_.add(page, url, (html or "").encode(), digest, refers_to)
            if open_.at >= package_bytes:
                yield open_.close(zip64)
                open_ = Package()
    if open_.parts:
        yield open_.close(zip64)


def write_files(decided: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """(path, size) of the ZIP files that hold the rows of decide(), of about ``package_bytes`` each, in a folder that all executors share.

    A task names its files anew each time it runs, so a task that is run again leaves files that no row lists. Checkpoint the rows before reading.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        for data in _packages(batches, package_bytes, zip64):
            name = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64())], names=["path", "size"])

    return decided.mapInArrow(run, "path string, size long")


def read_files(files: DataFrame, pages: Sequence[int] | None = None) -> DataFrame:
    """The records of ZIP files (path, size), or those of some pages, as read() gives them; each file is opened and read by ranges."""
    wanted = None if pages is None else set(pages).__contains__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = filesystem(path)
                with store.open_input_file(name) as f:
                    yield _rows(records(lambda at, n, f=f: f.read_at(n, at), size, wanted))

    return files.select("path", "size").mapInArrow(run, SCHEMA)


def write(decided: DataFrame, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """(package): the same packages as cells of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _packages(batches, package_bytes, zip64):
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["package"])

    return decided.mapInArrow(run, "package binary")


def read(packages: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of all records of all packages.

    A revisit has no payload; its length and digest are those that its headers give.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                data = memoryview(blob.as_buffer())
                yield _rows(records(lambda a, n, d=data: bytes(d[a : a + n]), len(data)))

    return packages.mapInArrow(run, SCHEMA)


FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _rows(found: Iterator[tuple[dict[str, str], dict[str, str], bytes]]) -> pa.RecordBatch:
    rows: list[tuple] = []
    for head, http, payload in found:
        kind = head["warc-type"]
        full = kind == "response"
        rows.append((
            _page(head["warc-record-id"]), head.get("warc-target-uri"), kind, None if full else _page(head["warc-refers-to"]), len(payload) if full else int(http["content-length"]),
            hashlib.sha1(payload).hexdigest() if full else head["warc-payload-digest"].removeprefix("sha1:"), payload if full else None))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(FIELDS)], names=[n for n, _ in FIELDS])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes packages to the shared folder, then reads each record back from them."""
    arrow_batches(spark)
    folder = shared_dir(spark)
    filesystem(folder)
    out = read_files(checkpointed(write_files(decide(table(spark, sf_dir, "pages")), folder)))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
firsts AS (SELECT body, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY body)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id OR p.page_id IS NULL THEN f.first END AS refers_to
FROM p LEFT JOIN firsts f ON p.n >= 1000 AND p.body = f.body
"""
