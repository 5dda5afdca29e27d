"""WARC records in ZIP packages: writer, and reader without extraction.

A package is a ZIP archive with stored (not compressed) members: `archive/data.warc.gz`, one gzip
member for each record, and `indexes/index.cdxj`, a line for each record (sort key of the address,
time stamp, JSON with the place in that file), sorted by key.  The reader reads the end of a package, parses the end-of-central-directory record, its ZIP64
form where sizes or counts overflow (or the writer was asked for it), and the central directory;
finds the stored members; reads the index; and range-reads each record at its place.

Records with equal payloads: the one with the smallest id is a response, the others are revisits
that name it.  A null payload is an empty one.  Rows with one id and one payload (repeated rows) are
each written, the repeats as responses, too.  Empty tables give empty results.

Packages go to the folder that all machines share.  A task writes each package under a name of its
own and reports it; packages of tasks that were lost are never reported, so never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20
_WRITTEN = datetime(2024, 1, 1, tzinfo=timezone.utc)
_DATE, STAMP = _WRITTEN.strftime("%Y-%m-%dT%H:%M:%SZ"), _WRITTEN.strftime("%Y%m%d%H%M%S")
_BIG32, _BIG16 = 0xFFFFFFFF, 0xFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(uri: str):
    """(file system, path) of a shared folder's address."""
    import pyarrow.fs

    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri)


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """One WARC record; a revisit carries no payload, only its digest and length."""
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}"]
    target = "".join(c for c in url or "" if c not in "\r\n")
    if target:
        lines.append(f"WARC-Target-URI: {target}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload), names in lower case."""
    fields = lambda part: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode().split("\r\n")[1:])}
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def sort_key(url: str | None, page_id: object) -> str:
    """The key of an index line: host names from the right, then the path; without blanks or control characters."""
    parts = re.match(r"(?s)[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?(.*)", url or "")
    if not parts:
        return quote(f"urn:page:{page_id}" if not url else url, safe=":/?=&,()")
    return quote(",".join(reversed(parts[1].lower().split("."))) + ")" + (parts[2] or "/"), safe=":/?=&,()%")


class PackageWriter:
    """Writes one package to a binary stream; memory holds the index only."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.out, self.zip64, self.at, self.crc, self.size = out, zip64, 0, 0, 0
        self.lines: list[str] = []
        self.members: list[tuple[bytes, int, int, int, int]] = []
        # sizes and checksum of the data follow it (flag bit 3), in ZIP64 form
        self._put(self._local(DATA.encode(), 0, 0, 0x0808))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    @staticmethod
    def _local(name: bytes, crc: int, size: int, flags: int) -> bytes:
        extra = struct.pack("<HHQQ", 1, 16, size, size)
        return struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, flags, 0, 0, 33, crc, _BIG32, _BIG32, len(name), len(extra)) + name + extra

    def add(self, page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        body = packer.compress(record(page_id, url, payload, refers_to)) + packer.flush()
        about = json.dumps({"url": url, "id": str(page_id), "offset": str(self.size), "length": str(len(body)), "filename": DATA})
        self.lines.append((sort_key(url, page_id), f"{STAMP} {about}"))
        self._put(body)
        self.crc = zlib.crc32(body, self.crc)
        self.size += len(body)

    def close(self) -> None:
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", self.crc, self.size, self.size))
        self.members.append((DATA.encode(), self.crc, self.size, 0, 0x0808))
        self.lines.sort(key=lambda x: x[0])
        index = "".join(f"{key} {rest}\n" for key, rest in self.lines).encode()
        crc, start = zlib.crc32(index), self.at
        self._put(self._local(INDEX.encode(), crc, len(index), 0x0800) + index)
        self.members.append((INDEX.encode(), crc, len(index), start, 0x0800))
        begin = self.at
        for name, crc, size, place, flags in self.members:
            wide = [x for x in (size, size, place) if self.zip64 or x >= _BIG32]
            narrow = lambda x: _BIG32 if self.zip64 or x >= _BIG32 else x
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            self._put(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, flags, 0, 0, 33, crc, narrow(size), narrow(size), len(name), len(extra), 0, 0, 0, 0, narrow(place)) + name + extra)
        length, n = self.at - begin, len(self.members)
        if self.zip64 or begin >= _BIG32 or length >= _BIG32:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, begin))
            self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
            n, length, begin = _BIG16, _BIG32, _BIG32
        self._put(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, n, n, length, begin, 0))


class PackageReader:
    """Stored members of a package, read by ranges from a random-access file (seek, read, size)."""

    def __init__(self, file) -> None:
        self.file = file
        self.members = self._directory()

    def read_at(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(length)
        if len(got) != length:
            raise ValueError(f"the package ends inside a range: {at}+{length}")
        return got

    def _directory(self) -> dict[str, tuple[int, int]]:
        """name -> (offset of the local header, size)."""
        total = self.file.size()
        tail_at = max(0, total - 22 - _BIG16)
        tail = self.read_at(tail_at, total - tail_at)
        found = tail.rfind(b"PK\x05\x06")
        while found >= 0 and found + 22 + int.from_bytes(tail[found + 20 : found + 22], "little") != len(tail):
            found = tail.rfind(b"PK\x05\x06", 0, found)
        if found < 0:
            raise ValueError("no end of a central directory: not a ZIP package")
        n, length, begin = struct.unpack("<HII", tail[found + 10 : found + 20])
        if n == _BIG16 or length == _BIG32 or begin == _BIG32:
            mark, _, wide_at, _ = struct.unpack("<4sIQI", self.read_at(tail_at + found - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator before the end record")
            wide = self.read_at(wide_at, 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record at its place")
            n, length, begin = struct.unpack("<QQQ", wide[32:56])
        raw, at, out = self.read_at(begin, length), 0, {}
        for _ in range(n):
            head = struct.unpack("<4s6H3I5H2I", raw[at : at + 46])
            if head[0] != b"PK\x01\x02":
                raise ValueError("a broken entry in the central directory")
            method, packed, size, n_name, n_extra, n_note, place = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, k = struct.unpack("<HH", extra[:4])
                if kind == 1:
                    wide = iter(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                    size = next(wide) if size == _BIG32 else size
                    packed = next(wide) if packed == _BIG32 else packed
                    place = next(wide) if place == _BIG32 else place
                extra = extra[4 + k :]
            if method == 0 and packed == size:
                out[name] = (place, size)
            at += 46 + n_name + n_extra + n_note
        return out

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin; the local header has its own lengths of name and extra field."""
        place, _ = self.members[name]
        head = struct.unpack("<4s5H3I2H", self.read_at(place, 30))
        if head[0] != b"PK\x03\x04":
            raise ValueError("no local header at its place")
        return place + 30 + head[9] + head[10]

    def member(self, name: str) -> bytes:
        return self.read_at(self.start(name), self.members[name][1])

    def index(self) -> list[dict]:
        """The index's lines, sorted by key: what stands behind the key and the time stamp."""
        found = [json.loads(x.split(" ", 2)[2]) for x in self.member(INDEX).decode().split("\n")[:-1]]
        return [x | {"offset": int(x["offset"]), "length": int(x["length"])} for x in found]


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each row; returns the written list of packages (path, first, last record).

    Which rows revisit: payloads meet as SHA-1 digests, added up before the shuffle; only the repeats
    join the rows again, so they are broadcast where Spark finds them small, and shuffled where not.  A null id
    counts as larger than all others: such a row revisits the one with the smallest id, if there is one.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    keyed = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("sha"))
    first = keyed.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    later = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    repeats = keyed.join(first, "sha").filter(later).select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), "first").distinct()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha")).join(repeats, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out = writer = None
        n = 0

        def done() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, body, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if writer is None:
                    path = f"{root}/{uuid.uuid4().hex}.wacz"
                    out = fs.open_output_stream(path)
                    writer, n = PackageWriter(out), 0
                writer.add("" if page_id is None else page_id, url, body, refers_to)
                n += 1
                if writer.at >= package_bytes:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    made = rows.select("id", "url", "payload", "first").mapInArrow(run, "path string, records bigint")
    return table(spark, made.withColumn("folder", F.lit(folder)), "manifest")


def read_packages(manifest: DataFrame, records_a_task: int = 2000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every record, by range reads.

    Ranges of records, not packages, are dealt to tasks, so a large package is read by several.
    """
    ranges = manifest.select("folder", "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.lit(records_a_task).cast("bigint"))).alias("lo"))
    dealt = ranges.repartition(max(1, min(10_000, ranges.count())))
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, path, lo in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with file_system(folder)[0].open_input_file(path) as file:
                    package = PackageReader(file)
                    base = package.start(DATA)
                    rows, size = [], 0
                    for entry in package.index()[lo : lo + records_a_task]:
                        warc, http, payload = parse_record(zlib.decompress(package.read_at(base + entry["offset"], entry["length"]), 31))
                        revisit = warc["warc-type"] == "revisit"
                        n, sha = (int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")) if revisit else (len(payload), digest(payload))
                        rows.append((number(warc["warc-record-id"]), warc.get("warc-target-uri"), None if revisit else payload, n, sha, warc["warc-type"], number(warc.get("warc-refers-to"))))
                        size += len(payload)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return dealt.mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
