"""WARC records in ZIP-packaged archives: writer, and a reader by byte ranges.

An archive is a ZIP file whose members are stored, not deflated::

    archive/data.warc.gz    WARC/1.1 records, each its own gzip member
    indexes/index.cdx       "offset length" of every record in that member

so any record is one byte range of the ZIP file.  The reader parses the end
record, the ZIP64 locator and end record, and the central directory with its
ZIP64 extra fields, finds members and indexes in it, and reads records by
range; nothing is extracted.

Writing tasks stream archives into the shared folder under names of their own
and report them in a manifest table.  Spark commits one attempt of each task to
the manifest, so archives of lost or repeated attempts are never read.  Files
are opened through ``pyarrow.fs`` from the folder's URI.

Defined cases: a NULL html is the empty payload; a NULL url is written as the
record's own URN.  Of rows with one payload those with the largest page_id are
responses (repeated rows of that id all are), the others revisit it; a NULL
page_id counts as smaller than any other, and if all are NULL all are
responses.  An empty table gives no archives and no rows; other columns are not
read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, new_folder, read_table, staged, whole_text

ARCHIVE_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdx"
ARCHIVE_BYTES = 256 << 20
CHUNK_BYTES = 4 << 20
WARC_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST_SCHEMA = "archive string, n_bytes long, n_records long"
CHUNK_SCHEMA = "archive string, start long, lengths array<long>"
RECORD_SCHEMA = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
                 "record_type string, refers_to long")


def _urn(page_id: str | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None):
    digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def record_bytes(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record: a response, or a revisit of the page ``refers_to``."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {WARC_DATE}",
            f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~') if url else _urn(page_id)}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != size or found != digest:
            raise ValueError(f"damaged record {fields['warc-record-id']}")
    url = fields["warc-target-uri"]
    return (_page_of(fields["warc-record-id"]), None if url.startswith("<urn:x-page:") else url,
            payload if kind == "response" else None, size, digest, kind,
            _page_of(fields.get("warc-refers-to")))


# ---- ZIP -------------------------------------------------------------------

class RangeFile:
    """Byte ranges of one file of any store that ``pyarrow.fs`` opens."""

    def __init__(self, uri: str):
        from pyarrow import fs
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(length, start)


def central_directory(src) -> dict[str, tuple[int, int, int]]:
    """Member name -> (compression method, local header offset, stored size)."""
    tail_size = min(src.size, 22 + 0xFFFF + 20)
    tail_start = src.size - tail_size
    tail = src.read(tail_start, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != tail_size:
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no ZIP end record")
    entries, size, offset = struct.unpack("<HII", tail[at + 10:at + 20])
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        end64 = src.read(int.from_bytes(tail[at - 12:at - 4], "little"), 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        entries, size, offset = struct.unpack("<QQQ", end64[32:56])
    raw, found, p = src.read(offset, size), {}, 0
    for _ in range(entries):
        if raw[p:p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, = struct.unpack("<H", raw[p + 10:p + 12])
        stored, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[p + 20:p + 34])
        header, = struct.unpack("<I", raw[p + 42:p + 46])
        name = raw[p + 46:p + 46 + n_name].decode("utf-8")
        extra = raw[p + 46 + n_name:p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, length = struct.unpack("<HH", extra[:4])
            if tag == 1:        # ZIP64: only the fields that overflow, in this order
                body = io.BytesIO(extra[4:4 + length])
                if full == 0xFFFFFFFF:
                    body.read(8)
                if stored == 0xFFFFFFFF:
                    stored = int.from_bytes(body.read(8), "little")
                if header == 0xFFFFFFFF:
                    header = int.from_bytes(body.read(8), "little")
            extra = extra[4 + length:]
        found[name] = (method, header, stored)
        p += 46 + n_name + n_extra + n_comment
    return found


def member_range(src, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Start and size of a stored member's bytes in the file."""
    method, header, stored = entry
    if method != 0:
        raise ValueError("member is compressed; only stored members can be read by range")
    local = src.read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the central directory points")
    n_name, n_extra = struct.unpack("<HH", local[26:30])
    return header + 30 + n_name + n_extra, stored


class _ArchiveWriter:
    """Streams one archive; holds only its index."""

    def __init__(self, uri: str):
        from pyarrow import fs
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out = uri, system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE_MEMBER), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, record: bytes):
        packed = gzip.compress(record, compresslevel=6, mtime=0)
        self.index.append(f"{self.size} {len(packed)}\n")
        self.member.write(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as index:
            for line in self.index:
                index.write(line.encode())
        self.zip.close()
        self.out.close()
        return self.uri, self.size, len(self.index)


def _write_archives(folder: str, archive_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, writer, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(
                    batch["page_id"], batch["url"], batch["payload"], batch["refers_to"]):
                writer = writer or _ArchiveWriter(f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.zip")
                writer.add(record_bytes(page_id, url, html.encode(), refers_to))
                if writer.size >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pd.DataFrame(done, columns=["archive", "n_bytes", "n_records"])
    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page below ``folder``; the manifest of archives."""
    importable(pages.sparkSession)
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                         whole_text("html").alias("payload"))
                 .withColumn("digest", F.sha1("payload")))
    largest = (rows.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
                   .where("n > 1 and largest is not null").drop("n"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return staged(rows.join(largest, "digest", "left")
                      .select(F.col("page_id").cast("string"), "url", "payload",
                              refers.cast("string").alias("refers_to"))
                      .mapInPandas(_write_archives(folder, archive_bytes), MANIFEST_SCHEMA), "warc-manifest")


def _list_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of neighbouring records, about ``CHUNK_BYTES`` each, from the archives' indexes."""
    for batch in batches:
        for uri in batch["archive"]:
            src = RangeFile(uri)
            members = central_directory(src)
            data, _ = member_range(src, members[ARCHIVE_MEMBER])
            start, size = member_range(src, members[INDEX_MEMBER])
            chunks, first, lengths, held = [], None, [], 0
            for line in src.read(start, size).decode().splitlines():
                offset, length = map(int, line.split())
                first = data + offset if first is None else first
                lengths.append(length)
                held += length
                if held >= CHUNK_BYTES:
                    chunks.append((uri, first, lengths))
                    first, lengths, held = None, [], 0
            if lengths:
                chunks.append((uri, first, lengths))
            yield pd.DataFrame(chunks, columns=["archive", "start", "lengths"])


def _read_records(payloads: bool):
    columns = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start, lengths in zip(batch["archive"], batch["start"], batch["lengths"]):
                raw, at, rows = RangeFile(uri).read(int(start), int(sum(lengths))), 0, []
                for length in lengths:
                    rows.append(parse_record(gzip.decompress(raw[at:at + length])))
                    at += length
                frame = pd.DataFrame(rows, columns=columns)
                for name in ("page_id", "refers_to"):
                    frame[name] = pd.array([r[columns.index(name)] for r in rows], dtype="Int64")
                if not payloads:
                    frame["payload"] = None
                yield frame
    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's archives, read by range and checked against its
    digest; ``payloads=False`` leaves the bytes out of the rows."""
    importable(manifest.sparkSession)
    chunks = manifest.select("archive").mapInPandas(_list_records, CHUNK_SCHEMA)
    return chunks.repartition("archive", "start").mapInPandas(_read_records(payloads), RECORD_SCHEMA)


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as WARC records in ZIP archives and read them back."""
    manifest = write_archives(read_table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read_archives(manifest, payloads=False).drop("payload", "url")
