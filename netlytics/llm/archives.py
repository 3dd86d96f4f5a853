"""Web archives inside ZIP packages, written and read by byte ranges.

A package holds stored (uncompressed) members: WARC data and a line index with each record's offset and
length.  The reader finds the end record (ZIP64 where needed), parses the central directory, locates a
member's data by its local header, reads the index and then only the byte ranges of records.  Nothing is
extracted.  It needs no more than ``read(offset, n)`` and a size, so it serves files as well as packages
kept as rows of a Parquet table, which any store that Spark knows can hold.  A row is a whole package, so its
records are read in the task that scans it, without a shuffle.

Of equal payloads of at least ``min_revisit`` bytes the one with the smallest page id is a response and
the others revisit it; rows that repeat the smallest id are responses, too.  A revisit's digest and length are those that its writer
measured; the reader can check them only where a record has its payload.  Null html is an empty payload, null urls
leave out the target, rows without a page id are written with an empty id and are never revisited.  An empty table gives an
empty result; a page longer than ``archive_bytes`` has a package of its own; ids may be of any type that a string can be cast to; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, shuffle_partitions

_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_M16, _M32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc", "indexes/index.txt"


# ---------------------------------------------------------------- WARC records


def _urn(page_id: str | None) -> str:
    return f"<urn:page:{'' if page_id is None else 'id-' + quote(page_id, safe='')}>"


def warc_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The named fields of one record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than its index says")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    page = lambda name: unquote(m[1]) if (m := re.fullmatch(r"<urn:page:id-(.*)>", fields.get(name, ""))) else None
    if fields["warc-type"] == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload that does not match its length or digest")
    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": full, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page("warc-refers-to"), "payload": payload}


# ---------------------------------------------------------------- ZIP packages


class PackageWriter:
    """Streams a package to ``out``: WARC records as they come, then the index and the directory."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.entries, self.index, self.zip64 = out, 0, [], [], zip64
        self._begin(DATA)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        # Sizes are not known yet: flag bit 3, a descriptor follows the data.
        self.name, self.header, self.crc = name.encode(), self.at, 0
        self._write(struct.pack("<4s5H3I2H", _LOCAL, 45, 8, 0, 0, 33, 0, 0, 0, len(self.name), 0) + self.name)
        self.data = self.at

    def _finish(self) -> None:
        size = self.at - self.data
        wide = self.zip64 or size >= _M32
        self._write(struct.pack("<4sI2Q" if wide else "<4s3I", b"PK\x07\x08", self.crc, size, size))
        self.entries.append((self.name, self.crc, size, self.header))

    def add(self, record: bytes, page_id: str | None, kind: str) -> None:
        self.index.append(f"{quote(page_id or '', safe='')} {self.at - self.data} {len(record)} {kind}\n")
        self.crc = zlib.crc32(record, self.crc)
        self._write(record)

    def close(self) -> None:
        self._finish()
        self._begin(INDEX)
        lines = "".join(self.index).encode()
        self.crc = zlib.crc32(lines)
        self._write(lines)
        self._finish()
        start = self.at
        for name, crc, size, header in self.entries:
            extra = b""
            if wide := self.zip64 or max(size, header) >= _M32:
                extra = struct.pack("<2H3Q", 1, 24, size, size, header)
                size = header = _M32
            self._write(struct.pack("<4s6H3I5H2I", _ENTRY, 45, 45 if wide else 20, 8, 0, 0, 33, crc, size, size, len(name), len(extra), 0, 0, 0, 0, header) + name + extra)
        size, n = self.at - start, len(self.entries)
        if self.zip64 or max(start, size) >= _M32 or n >= _M16:
            end64 = self.at
            self._write(struct.pack("<4sQ2H2I4Q", _END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<4sIQI", _LOCATOR64, 0, end64, 1))
            size, start, n = _M32, _M32, _M16
        self._write(struct.pack("<4s4H2IH", _END, 0, 0, n, n, size, start, 0))


class FileRange:
    """Byte ranges of a local file."""

    def __init__(self, path: str):
        self.file, self.size = open(path, "rb"), os.path.getsize(path)  # noqa: SIM115

    def read(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)


class BufferRange:
    """Byte ranges of a package in memory, without copying it."""

    def __init__(self, buffer):
        self.view = memoryview(buffer)
        self.size = len(self.view)

    def read(self, offset: int, n: int) -> bytes:
        return bytes(self.view[offset : offset + n])


class PackageReader:
    """Members of a ZIP package by their central directory."""

    def __init__(self, source):
        self.source = source
        tail_at = max(0, source.size - 22 - _M16)
        tail = source.read(tail_at, source.size - tail_at)
        end = tail.rfind(_END)
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(_END, 0, end)
        if end < 0:
            raise ValueError("not a ZIP package")
        n, size, start = struct.unpack("<10xH2I2x", tail[end : end + 22])
        if _M32 in (size, start) or n == _M16:
            locator = source.read(tail_at + end - 20, 20)
            if locator[:4] == _LOCATOR64:
                at64 = struct.unpack("<8xQ4x", locator)[0]
                n, size, start = struct.unpack("<32x3Q", source.read(at64, 56))
        self.members = self._directory(source.read(start, size), n)

    @staticmethod
    def _directory(raw: bytes, n: int) -> dict[str, tuple[int, int, int]]:
        members, at = {}, 0
        for _ in range(n):
            sig, method, packed, size, names, extras, comments, header = struct.unpack("<4s6xH8x2I3H8xI", raw[at : at + 46])
            if sig != _ENTRY:
                raise ValueError("a broken central directory")
            name = raw[at + 46 : at + 46 + names].decode()
            extra = raw[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:
                kind, length = struct.unpack("<2H", extra[:4])
                if kind == 1:  # ZIP64: only the fields that did not fit
                    wide = list(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                    size, packed, header = (wide.pop(0) if v == _M32 and wide else v for v in (size, packed, header))
                extra = extra[4 + length :]
            members[name] = (method, size, header)
            at += 46 + names + extras + comments
        return members

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's data lies: offset and size."""
        method, size, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        sig, names, extras = struct.unpack("<4s22x2H", self.source.read(header, 30))
        if sig != _LOCAL:
            raise ValueError("a broken local header")
        return header + 30 + names + extras, size

    def records(self) -> Iterator[dict]:
        """All records, each read by its range."""
        data, size = self.stored(DATA)
        for line in self.source.read(*self.stored(INDEX)).decode().splitlines():
            _, offset, length, _ = line.split(" ")
            if int(offset) + int(length) > size:
                raise ValueError("an index entry beyond its archive")
            yield parse_record(self.source.read(data + int(offset), int(length)))


# ---------------------------------------------------------------- tables of packages

_PACKAGES = "archive string, data binary"
#: A package is a row of up to ``archive_bytes``: row groups are cut by bytes from the first row on, not after a hundred.
_ROW_GROUPS = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def _originals(rows: DataFrame, min_revisit: int) -> tuple[DataFrame, DataFrame]:
    """(digest, first) of the payloads that several pages have: those with very many pages, and the others.

    Counts are combined before the shuffle.  At most ``4 * partitions`` payloads can have a share of more than ``1 / (4 * partitions)`` each.
    """
    same = rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL")
    same = materialize(same, "originals")
    total = same.agg(F.sum("c")).first()[0] or 0
    many = F.col("c") * 4 * shuffle_partitions(rows.sparkSession) > total
    return same.where(many).select("digest", "first"), same.where(~many).select("digest", "first")


def write_packages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100, archive_bytes: int = 16 << 20) -> DataFrame:
    """The pages as packages of about ``archive_bytes``, a table of (archive, data)."""
    bounded(pages)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    hot, others = _originals(rows, min_revisit)
    # Pages of a payload that very many share learn its first page without being dealt by it.
    dealt = rows.join(F.broadcast(hot.withColumnRenamed("first", "known")), "digest", "left")
    key = F.when(F.col("known").isNull(), F.col("digest")).otherwise(F.concat(F.lit("="), F.xxhash64("page_id", "url").cast("string")))
    linked = dealt.withColumn("key", key).join(others.withColumnRenamed("digest", "key"), "key", "left")
    first = F.coalesce("known", "first")
    linked = linked.select("page_id", "url", "html", "digest", F.when(F.coalesce(F.col("page_id") != first, first.isNotNull()), first).alias("refers_to"))
    linked = linked.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})

    def write(batches):
        part, k, out, writer = TaskContext.get().partitionId(), 0, None, None

        def package():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:06d}"]), pa.array([out.getvalue()], pa.binary())], names=["archive", "data"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if writer is None:
                    out = io.BytesIO()
                    writer = PackageWriter(out)
                page, to = page_id.as_py(), refers_to.as_py()
                writer.add(warc_record(page, url.as_py(), (html.as_py() or "").encode(), digest.as_py(), to), page, "response" if to is None else "revisit")
                if writer.at >= archive_bytes:
                    writer.close()
                    yield package()
                    k, writer = k + 1, None
        if writer is not None:
            writer.close()
            yield package()

    return linked.mapInArrow(write, _PACKAGES)


_RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _batches(records: Iterator[dict], payloads: bool, most: int = 1000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The records in batches of a bounded number of rows and bytes."""
    kinds = {"page_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string()} | ({"payload": pa.binary()} if payloads else {})

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in kinds.items()], names=list(kinds))

    held, size = [], 0
    for record in records:
        if payloads:
            size += len(record["payload"])
        else:
            del record["payload"]
        held.append(record)
        if len(held) >= most or size >= most_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_packages(packages: DataFrame, *, payloads: bool = False) -> DataFrame:
    """The records of a table of packages; a task holds one package at a time."""
    bounded(packages)

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                yield from _batches(PackageReader(BufferRange(data.as_buffer())).records(), payloads)

    return packages.select("data").mapInArrow(read, _RECORD + (", payload binary" if payloads else ""))


def read_package_files(paths: DataFrame, *, path_col: str = "path", payloads: bool = False) -> DataFrame:
    """The records of package files on a file system that all executors mount, by ranges of each file."""
    bounded(paths)

    def read(batches):
        for batch in batches:
            for path in batch.column(0):
                yield from _batches(PackageReader(FileRange(path.as_py())).records(), payloads)

    return paths.select(path_col).mapInArrow(read, _RECORD + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, *, id_col: str = "page_id", **options) -> DataFrame:
    """The pages' records, written as packages to the shared folder and read back."""
    records = read_packages(materialize(write_packages(pages, id_col=id_col, **options), "packages", **_ROW_GROUPS))
    kind = pages.schema[id_col].dataType
    return records.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
