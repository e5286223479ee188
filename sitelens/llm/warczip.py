"""WARC records in ZIP archives: writer, ZIP and ZIP64 directory reader, range reads.

An archive holds two stored (uncompressed) members: archive/data.warc.gz, in
which every record is a gzip member of its own, and indexes/index.cdxj, one
line per record with its offset and length in that member. A reader fetches
the end of the file, the central directory, a member's local header and then
only the bytes of the records it wants; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import Callable, NamedTuple, Optional

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized, shared_folder

WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
MIN_PAYLOAD = 0          # smaller payloads are never revisits
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3                # of gzip
READ_AHEAD = 4 << 20     # neighbouring records are fetched in ranges of about so many bytes
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ReadRange = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    header: int      # offset of the local header
    size: int
    stored: bool
    crc: int


class BadArchive(ValueError):
    pass


def _wide(extra: bytes, values: list[int], limits: list[int]) -> list[int]:
    """Replace the values that are at their limit by those of the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, pos, out = extra[at + 4:at + 4 + size], 0, []
            for value, limit in zip(values, limits):
                if value == limit:
                    width = 8 if limit == 0xFFFFFFFF else 4
                    if pos + width > len(body):
                        raise BadArchive("ZIP64 field is too short")
                    value = int.from_bytes(body[pos:pos + width], "little")
                    pos += width
                out.append(value)
            return out
        at += 4 + size
    return values


def directory(read: ReadRange, size: int) -> list[Member]:
    """Members of a ZIP file of ``size`` bytes, from its central directory (ZIP64 included)."""
    tail_at = max(0, size - 65_557 - 20)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise BadArchive("no end of central directory")
    disk, cd_disk, _, count, cd_size, cd_at = struct.unpack_from("<HHHHII", tail, at + 4)
    if 0xFFFF in (disk, cd_disk, count) or 0xFFFFFFFF in (cd_size, cd_at):
        if at < 20 or tail[at - 20:at - 16] != b"PK\x06\x07":
            raise BadArchive("no ZIP64 locator")
        end_at = struct.unpack_from("<Q", tail, at - 12)[0]
        end = read(end_at, 56)
        if end[:4] != b"PK\x06\x06":
            raise BadArchive("no ZIP64 end of central directory")
        disk, cd_disk, _, count, cd_size, cd_at = struct.unpack_from("<IIQQQQ", end, 16)
    if disk or cd_disk:
        raise BadArchive("archives of several disks are not read")
    raw, pos, out = read(cd_at, cd_size), 0, []
    for _ in range(count):
        if raw[pos:pos + 4] != b"PK\x01\x02":
            raise BadArchive("damaged central directory")
        flags, method = struct.unpack_from("<HH", raw, pos + 8)
        crc, packed, full, n_name, n_extra, n_note, start_disk = struct.unpack_from("<IIIHHHH", raw, pos + 16)
        header = struct.unpack_from("<I", raw, pos + 42)[0]
        name = raw[pos + 46:pos + 46 + n_name]
        extra = raw[pos + 46 + n_name:pos + 46 + n_name + n_extra]
        full, packed, header, _ = _wide(extra, [full, packed, header, start_disk], [0xFFFFFFFF] * 3 + [0xFFFF])
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), header, packed,
                          method == 0 and not flags & 1, crc))
        pos += 46 + n_name + n_extra + n_note
    return out


def member_start(read: ReadRange, member: Member) -> int:
    """Offset of a stored member's first byte; its local header can have other extra fields than the directory."""
    if not member.stored:
        raise BadArchive(f"{member.name} is compressed or encrypted: it has no ranges")
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise BadArchive(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _safe(value: Optional[str]) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(row: int, url: Optional[str], payload: bytes, sha1: str, refers_to: Optional[int]) -> bytes:
    """One WARC response, or a revisit without payload that refers to another record."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode("ascii")
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{row}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """WARC headers (lower-cased names) and block of one record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise BadArchive("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise BadArchive("record is cut short")
    return headers, rest[:n]


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write this task's rows to one archive; an archive counts only if its manifest row is kept."""
        fs, base = None, None
        path = f"{folder}/{uuid.uuid4().hex}.wacz"
        index, count, at, archive, member, stream = io.BytesIO(), 0, 0, None, None, None
        for batch in batches:
            for page, url, html, refers, is_first in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if archive is None:
                    fs, base = _filesystem(path)
                    fs.create_dir(base.rpartition("/")[0], recursive=True)
                    stream = fs.open_output_stream(base, compression=None)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    member = archive.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
                payload = (html or "").encode("utf-8", "replace")
                sha1 = digest(payload)
                raw = record(page, url, payload, sha1, None if is_first else refers)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                member.write(packed)
                entry = {"offset": at, "length": len(packed), "digest": f"sha1:{sha1}"}
                index.write(f"{count:012d} {json.dumps(entry)}\n".encode())
                at += len(packed)
                count += 1
        if archive is not None:
            member.close()
            archive.writestr(zipfile.ZipInfo(INDEX_MEMBER), index.getvalue())
            archive.close()
            stream.close()
            size = fs.get_file_info(base).size
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([size], pa.int64()), pa.array([count], pa.int64())],
                names=["path", "size", "records"])
    return run


def _open(path: str) -> tuple[ReadRange, Callable[[], None]]:
    fs, base = _filesystem(path)
    f = fs.open_input_file(base)

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        got = f.read(n)
        if len(got) != n:
            raise BadArchive(f"{path}: {n} bytes at {at} are not there")
        return got
    return read, f.close


def records(read: ReadRange, size: int) -> Iterator[tuple[dict, bytes]]:
    """All records of an archive, through its index, by range reads."""
    members = {m.name: m for m in directory(read, size)}
    start = member_start(read, members[WARC_MEMBER])
    index = members[INDEX_MEMBER]
    raw = read(member_start(read, index), index.size)
    if zlib.crc32(raw) != index.crc:
        raise BadArchive("the index is damaged")
    spans = sorted((e["offset"], e["length"]) for e in
                   (json.loads(line.partition(b" ")[2]) for line in raw.splitlines()))
    lo = 0
    while lo < len(spans):
        hi = lo + 1
        while hi < len(spans) and spans[hi][0] + spans[hi][1] - spans[lo][0] <= READ_AHEAD:
            hi += 1
        first = spans[lo][0]
        part = read(start + first, spans[hi - 1][0] + spans[hi - 1][1] - first)
        for at, n in spans[lo:hi]:
            yield parse_record(zlib.decompress(part[at - first:at - first + n], 31))
        lo = hi


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            read, close = _open(path)
            rows: list = []
            for headers, block in records(read, size):
                head, _, payload = block.partition(b"\r\n\r\n")
                length = next(int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n"))
                              if k.lower() == b"content-length")
                sha1 = headers["warc-payload-digest"].removeprefix("sha1:")
                kind = headers["warc-type"]
                if kind == "response" and (len(payload) != length or digest(payload) != sha1):
                    raise BadArchive(f"{path}: payload does not match its digest")
                rows.append((_number(headers["warc-record-id"]), length, sha1, kind,
                             _number(headers.get("warc-refers-to"))))
            close()
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _number(uri: Optional[str]) -> Optional[int]:
    text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write a record per page to archives below ``folder``; returns the manifest: path, size, records.

    Of records with equal payloads of at least ``min_payload`` bytes the one
    with the largest page_id is a response and others are revisits of it (rows
    that repeat that page_id with that payload are responses too). Pages with
    a null page_id are responses, and nothing refers to them. A null html is an empty payload;
    an empty table writes no archive; other columns are not looked at.

    The folder must be one that driver and executors share. Only digests and
    ids are grouped; an adaptive join sends the largest id back, so that a
    payload with any number of copies is split. Every task writes one archive
    under a name of its own, and the manifest lists those of the attempts that counted.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.when(F.length(body) >= min_payload, F.sha1(body)).alias("same"))
    largest = (rows.filter("page_id is not null and same is not null").groupBy("same")
               .agg(F.max("page_id").alias("largest")))
    first = F.col("largest").isNull() | F.col("page_id").isNull() | (F.col("page_id") == F.col("largest"))
    planned = (rows.join(largest, "same", "left")
               .select("page_id", "url", "html", "largest", first.alias("is_first")))
    return materialized(planned.mapInArrow(_writer(folder), "path string, size long, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Archives are dealt evenly to tasks. Each response's payload is checked against its digest.
    """
    n = manifest.agg(F.count("*")).first()[0]
    return manifest.select("path", "size").repartition(max(1, n)).mapInArrow(
        _reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, then read them back."""
    return read_archives(write_archives(pages, shared_folder(pages.sparkSession, "warc")))
