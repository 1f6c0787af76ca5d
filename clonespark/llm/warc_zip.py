"""WARC records in ZIP packages: a writer, and a reader by ranges.

A package is a ZIP file with a stored (not deflated) member of WARC records, each its own gzip member, and a stored CDXJ
index with each record's offset and length. The reader parses the end of central directory record, the ZIP64 one if
there is one, and the central directory; finds the stored members through their local headers; reads the index; and then
reads just the records' ranges from the open file. Nothing is extracted.

Files are opened with pyarrow.fs, so the folder can be any file system that pyarrow knows and executors share. Each attempt of a task
writes packages under names of its own, and the table of (path, records), which Spark commits once, alone says which of them count. So
an attempt that is lost, repeated or late changes nothing; what it leaves in the folder is in no table. The reader compares a package's number of
records with the table's.

Of pages with equal payloads of at least ``LEAST`` bytes, the smallest page_id is a response and the others are revisit records
that refer to it; smaller payloads are always responses. Null html is an empty payload, a null url an
empty one. Rows that repeat the smallest page_id are all responses. A row without a page_id revisits the smallest id
of its payload, or is a response if no equal payload has an id. A page is a record whole, whatever its length. Columns other than page_id, url and html are
not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.plans.lineage import scratch, stored

LEAST = 100
#: Compressed bytes of records at which a package is closed, and the largest gap and size of one read.
PACKAGE, GAP, READ = 1 << 23, 1 << 16, 1 << 22
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


# -- records --------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record: a response, or a revisit with the response's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (url or '') + hashlib.sha256(payload).hexdigest())}"
    head = [f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=SAFE)}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "%\"<>")


def _headers(text: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in text.decode().split("\r\n")[1:] if ":" in line)}


def parse_record(raw: bytes) -> dict:
    """The fields of RECORDS and the payload (None for a revisit); a payload unlike its digest or length raises ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), int(_headers(http)["content-length"])
    page = fields["warc-record-id"].strip("<>").removeprefix("urn:page:")
    out = {"page_id": None if page.startswith("urn:uuid:") else int(page), "url": unquote(fields["warc-target-uri"]), "record_type": kind, "refers_to": None, "payload_digest": digest, "payload_bytes": size, "payload": None}
    if kind == "revisit":
        return out | {"refers_to": int(fields["warc-refers-to"].strip("<>").removeprefix("urn:page:"))}
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {page}: the payload does not match its digest")
    return out | {"payload": payload}


# -- packages -------------------------------------------------------------------------------------


class Package:
    """Records on their way into one ZIP package."""

    def __init__(self) -> None:
        self.parts, self.lines, self.size = [], [], 0

    def add(self, url: str | None, raw: bytes, level: int) -> None:
        squeeze = zlib.compressobj(level, wbits=31)
        data = squeeze.compress(raw) + squeeze.flush()
        self.lines.append(f"{quote(url or '', safe=SAFE) or '-'} {json.dumps({'offset': self.size, 'length': len(data), 'filename': DATA})}")
        self.parts.append(data)
        self.size += len(data)

    def write(self, out) -> None:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in ((DATA, b"".join(self.parts)), (INDEX, "\n".join(sorted(self.lines)).encode())):
                z.writestr(zipfile.ZipInfo(name), data)


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipRanges:
    """The members of a ZIP file that is open for random access, found without reading anything else."""

    def __init__(self, file, size: int) -> None:
        self._file = file
        tail_at = max(0, size - (1 << 16) - 22)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = tail_at + end - 20
            found = self.read(locator, 20) if locator >= 0 else b""
            if found[:4] == b"PK\x06\x07":
                wide = self.read(struct.unpack_from("<Q", found, 8)[0], 56)
                if wide[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory")
                count, length, start = struct.unpack_from("<QQQ", wide, 32)
        self.members = {m.name: m for m in self._directory(self.read(start, length), count)}

    def read(self, at: int, length: int) -> bytes:
        self._file.seek(at)
        return self._file.read(length)

    @staticmethod
    def _directory(data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            method, = struct.unpack_from("<H", data, at + 10)
            small, large, n, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
            header, = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + n].decode()
            field, stop = at + 46 + n, at + 46 + n + extra
            while field + 4 <= stop:  # the ZIP64 field holds just the values that did not fit, in this order
                kind, size = struct.unpack_from("<HH", data, field)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", data, field + 4))
                    large = next(wide) if large == 0xFFFFFFFF else large
                    small = next(wide) if small == 0xFFFFFFFF else small
                    header = next(wide) if header == 0xFFFFFFFF else header
                field += 4 + size
            yield Member(name, method, small, header)
            at = stop + comment

    def stored_at(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the file."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.read(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n + extra, member.size


def read_package(file, size: int) -> Iterator[dict]:
    """The records of a package, by the ranges in its index; ranges that lie close together are read at once."""
    ranges = ZipRanges(file, size)
    for name in sorted(m for m in ranges.members if m.startswith("indexes/")):
        at, length = ranges.stored_at(name)
        # a quoted URL may have braces, but no space
        lines = [json.loads(x[x.index(b" {") + 1 :]) for x in ranges.read(at, length).splitlines()]
        for data in sorted({x["filename"] for x in lines}):
            start, _ = ranges.stored_at(data)
            spans = sorted((x["offset"], x["length"]) for x in lines if x["filename"] == data)
            while spans:
                stop, n = spans[0][0], 0
                while n < len(spans) and spans[n][0] <= stop + GAP and (n == 0 or sum(spans[n]) - spans[0][0] <= READ):
                    stop, n = sum(spans[n]), n + 1
                base = spans[0][0]
                block = ranges.read(start + base, stop - base)
                for offset, size_ in spans[:n]:
                    yield parse_record(zlib.decompress(block[offset - base : offset - base + size_], wbits=31))
                spans = spans[n:]


# -- tables ---------------------------------------------------------------------------------------


def _decided(pages: DataFrame, least: int) -> DataFrame:
    """pages with refers_to: the smallest id among the pages of the same payload, for those that revisit it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    groups = known.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared, _ = stored(groups.where("n > 1 and first is not null").select("digest", "first"), "shared-payloads")
    revisits = F.when(F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return known.join(shared, "digest", "left").select("page_id", "url", "html", revisits.alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, least: int = LEAST, level: int = 2, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as packages into a folder; returns the table of (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        own = uuid.uuid4().hex  # of this attempt

        def close(package: Package) -> None:
            name = f"pages-{task.partitionId():06d}-{len(done):05d}-{own}.zip"
            with where.open_output_stream(f"{root}/{name}") as out:
                buffer = io.BytesIO()
                package.write(buffer)
                out.write(buffer.getbuffer())
            done.append((name, len(package.lines)))

        package = Package()
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(i) for i in range(4)), strict=True):
                url, payload = url.as_py(), (html.as_py() or "").encode()
                package.add(url, record(page_id.as_py(), url, payload, refers_to.as_py(), date), level)
                if package.size >= PACKAGE:
                    close(package)
                    package = Package()
        if package.lines:
            close(package)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return stored(_decided(pages, least).mapInArrow(run, "path string, records long"), "packages")[0]


def read_packages(packages: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the packages (path, records): RECORDS, and the payload (null for revisits) unless it is not wanted.

    A package with another number of records raises ValueError.
    """
    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * payload
    schema = RECORDS + ", payload string" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
        arrow = pa.schema([(n, types.get(n, pa.string())) for n in names])
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, name = fs.FileSystem.from_uri(path)
                size = where.get_file_info(name).size
                with where.open_input_file(name) as file:
                    rows, n = [], 0
                    for n, r in enumerate(read_package(file, size), 1):  # noqa: B007
                        if payload and r["payload"] is not None:
                            r["payload"] = r["payload"].decode()
                        rows.append({n: r[n] for n in names})
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                    if n != records:
                        raise ValueError(f"{path}: {n} records, not {records}")
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("path", "records").repartition(tasks).mapInArrow(run, schema)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))
    return read_packages(packages, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL of op2_warc_zip.
ORACLE = """
with p as (select page_id, coalesce(html, '') html from pages),
f as (select html, min(page_id) first, count(*) n from p where strlen(html) >= 100 group by html),
d as (select page_id, p.html, case when n > 1 and (page_id > first or page_id is null) then first end refers_to from p left join f on p.html = f.html)
select page_id, cast(strlen(html) as bigint) payload_bytes, sha256(html) payload_digest, case when refers_to is null then 'response' else 'revisit' end record_type, refers_to from d
"""
