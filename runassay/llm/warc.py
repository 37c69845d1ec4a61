"""Web archives in ZIP packages: records written per page, found by directory and index.

A package is a ZIP file with stored members: ``archive/*.warc.gz``, one gzip member per
record, and ``indexes/*.cdxj``, a line with file name, offset and length per record. The
reader takes byte ranges only: the end of the package, its (ZIP64) central directory, blocks
of the index, and the ranges of the records. Nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import mapped, pin, scratch_dir, slices
from runassay.scale import spread

#: A payload of at least this many bytes that occurred before becomes a revisit record.
LEAST_REVISIT = 0
#: A package is closed at these sizes; index lines wait in memory until then.
PACKAGE_BYTES, PACKAGE_RECORDS = 1 << 30, 100_000
#: Bytes of an index that one row reads; records read at once, and gaps read over.
INDEX_BLOCK, READ_BYTES, READ_GAP = 1 << 18, 4 << 20, 1 << 16
#: Parts that a group of equal payloads is dealt to when pages meet their first record.
SALTS = 16

# Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_MARK, END64_MARK, LOCATOR_MARK = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ENTRY_MARK, LOCAL_MARK = b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
UTF8_NAME = 0x800

RECORD = (
    "package string, file string, offset long, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a plain path is a local or mounted one."""
    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing ----


def first_pages(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, body, first``: ``first`` is the smallest id with the same payload.

    Only payloads of two ids at least are looked up, and each of them in ``SALTS`` copies, so
    a payload that a third of all pages share is met by many tasks.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body")
    )
    digest = F.unhex(F.sha2("body", 256))
    long_enough = rows.where(F.length("body") >= least)
    groups = (
        long_enough.select("page_id", digest.alias("digest")).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count_if(F.col("page_id").isNull()).alias("unnamed"))
    )
    shared = groups.where((F.col("first") != F.col("last")) | (F.col("unnamed") > 0)).where("first IS NOT NULL")
    shared = pin(
        shared.select(F.col("digest").alias("_digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")),
        "payloads",
    )
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    met = (digest == F.col("_digest")) & (salt == F.col("_salt")) & (F.length("body") >= least)
    return rows.join(shared, met, "left").select("page_id", "url", "body", "first")


def record_of(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response record, or a revisit record without payload if ``first`` is another page."""
    revisit = first is not None and first != page_id
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = answer if revisit else answer + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """A package being written: records go straight to the sink, index lines follow at the end."""

    def __init__(self, path: str):
        self.path = path
        system, inner = _place(path)
        self.sink = system.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.lines: list[str] = []
        self.bytes = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.member.write(data)
        line = {"filename": "data.warc.gz", "offset": self.bytes, "length": len(data)}
        self.lines.append(f"{'' if page_id is None else page_id} {json.dumps(line)}\n")
        self.bytes += len(data)

    def close(self) -> dict:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "".join(self.lines))
        self.zip.close()
        self.sink.close()
        return {"package": self.path, "records": len(self.lines)}


def _write(batches, folder: str, most_bytes: int, most_records: int) -> Iterator[pa.RecordBatch]:
    """Packages of a task. Names are new for every attempt; only a finished one is listed."""
    system, inner = _place(folder)
    system.create_dir(inner, recursive=True)
    open_, done = None, []
    for batch in slices(batches, "body"):
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "body", "first")]
        for page_id, url, body, first in zip(*columns, strict=True):
            if open_ is None:
                open_ = Package(f"{folder}/{uuid.uuid4().hex}.wacz")
            open_.add(page_id, record_of(page_id, url, body, first))
            if open_.bytes >= most_bytes or len(open_.lines) >= most_records:
                done.append(open_.close())
                open_ = None
    if open_ is not None:
        done.append(open_.close())
    yield pa.RecordBatch.from_pylist(done, pa.schema([("package", pa.string()), ("records", pa.int64())]))


def write_packages(
    pages: DataFrame,
    folder: str,
    least: int = LEAST_REVISIT,
    package_bytes: int = PACKAGE_BYTES,
    package_records: int = PACKAGE_RECORDS,
) -> DataFrame:
    """``package, records`` of the packages that hold a record per row of ``pages``.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is
    a response and the others are revisits; rows that share the smallest id are responses,
    and so are equal payloads none of which has an id. The list is written by Spark, so
    packages left by lost tasks are never read.
    """
    return pin(
        mapped(first_pages(pages, least), _write, "package string, records long", folder, package_bytes, package_records),
        "packages",
    )


# ---- reading ----


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


class Directory(NamedTuple):
    """Where the central directory lies; ``shift`` is what precedes the ZIP data."""

    start: int
    size: int
    entries: int
    shift: int


def _at(file: BinaryIO, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"package ends within the {size} bytes from {start}")
    return data


def directory(file: BinaryIO, size: int) -> Directory:
    """Find the end record, behind a comment of any length, and its ZIP64 form if it has one."""
    tail_start = max(0, size - 22 - FULL16)
    tail = _at(file, tail_start, size - tail_start)
    at = tail.rfind(END_MARK)
    while at >= 0:
        if at + 22 <= len(tail) and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail):
            break
        at = tail.rfind(END_MARK, 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP package")
    entries, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = tail_start + at
    if end >= 20:
        locator = _at(file, end - 20, 20)
        if locator[:4] == LOCATOR_MARK:
            place = int.from_bytes(locator[8:16], "little")
            # Data in front of the package moves everything by as much.
            for start in (place, end - 20 - 56):
                if 0 <= start <= end - 20 - 56 and _at(file, start, 4) == END64_MARK:
                    entries, length, offset = struct.unpack("<QQQ", _at(file, start, 56)[32:56])
                    return Directory(start - length, length, entries, start - length - offset)
            raise ValueError("no ZIP64 end record where the locator points")
    if FULL32 in (length, offset):
        raise ValueError("a ZIP64 package without locator")
    return Directory(end - length, length, entries, end - length - offset)


def members(file: BinaryIO, size: int, block: int = 1 << 16) -> Iterator[Member]:
    """Entries of the central directory, a block of it at a time."""
    place = directory(file, size)
    held, at, read = b"", 0, 0
    for _ in range(place.entries):
        need = 46
        for _ in range(2):  # the fixed part, then names, extras and comment
            while len(held) - at < need:
                more = min(max(block, need), place.size - read)
                if more <= 0:
                    raise ValueError("central directory ends within an entry")
                held, at = held[at:] + _at(file, place.start + read, more), 0
                read += more
            if held[at : at + 4] != ENTRY_MARK:
                raise ValueError("no entry in the central directory where one is due")
            n_name, n_extra, n_comment = struct.unpack("<HHH", held[at + 28 : at + 34])
            need = 46 + n_name + n_extra + n_comment
        flags, method = struct.unpack("<HH", held[at + 8 : at + 12])
        stored, whole = struct.unpack("<II", held[at + 20 : at + 28])
        header = int.from_bytes(held[at + 42 : at + 46], "little")
        name = held[at + 46 : at + 46 + n_name].decode("utf-8" if flags & UTF8_NAME else "cp437")
        extra = held[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, length = struct.unpack("<HH", extra[:4])
            if kind == 1:  # 64-bit values, only of the fields that are full, in this order
                wide = [int.from_bytes(extra[4 + k : 12 + k], "little") for k in range(0, length - 7, 8)]
                whole = wide.pop(0) if whole == FULL32 else whole
                stored = wide.pop(0) if stored == FULL32 else stored
                header = wide.pop(0) if header == FULL32 else header
            extra = extra[4 + length :]
        at += need
        if flags & 1:
            raise ValueError(f"{name} is encrypted")
        yield Member(name, method, stored, header + place.shift)


def data_start(file: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin: behind its local header, whose extras may differ."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; ranges need stored members")
    head = _at(file, member.header, 30)
    if head[:4] != LOCAL_MARK:
        raise ValueError(f"no local header for {member.name}")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


def _members(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("package", pa.string()), ("name", pa.string()), ("start", pa.int64()), ("size", pa.int64())])
    for batch in batches:
        for path in batch.column("package").to_pylist():
            system, inner = _place(path)
            rows = []
            with system.open_input_file(inner) as file:
                for m in members(file, file.size()):
                    if not m.name.startswith(("archive/", "indexes/")) or m.name.endswith("/"):
                        continue
                    rows.append({"package": path, "name": m.name, "start": data_start(file, m), "size": m.size})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def _index_lines(batches) -> Iterator[pa.RecordBatch]:
    """Lines that begin within a block of an index."""
    schema = pa.schema([("package", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            system, inner = _place(row["package"])
            begin, end = row["block"] * row["width"], min(row["size"], (row["block"] + 1) * row["width"])
            with system.open_input_file(inner) as file:
                # The byte before tells whether a line begins at the block's first byte.
                before = 1 if begin else 0
                data = _at(file, row["start"] + begin - before, end - begin + before)
                while end < row["size"] and not data.endswith(b"\n"):
                    more = _at(file, row["start"] + end, min(4096, row["size"] - end))
                    cut = more.find(b"\n") + 1
                    data, end = data + (more[:cut] if cut else more), end + (cut or len(more))
            first = data.find(b"\n") + 1 if before else 0
            found = []
            if first or not before:
                for line in data[first:].split(b"\n"):
                    if b"{" in line:
                        entry = json.loads(line[line.index(b"{") :])
                        found.append((row["package"], f"archive/{entry['filename']}", int(entry["offset"]), int(entry["length"])))
            columns = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parse_record(data: bytes) -> dict:
    """Fields of one record; a response's payload must have the digest that the record names."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompressobj(31).decompress(data)
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no archive record in the range that the index names")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    answer, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    if kind == "revisit":
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", answer)[1])
    else:
        size = len(payload)
        if digest and digest != digest_of(payload):
            raise ValueError(f"payload of {fields.get('warc-record-id')} has another digest than its record")
        digest = digest or digest_of(payload)
    return {
        "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
        "payload_bytes": size, "payload_digest": digest, "refers_to": _page(fields.get("warc-refers-to")),
        "payload": None if kind == "revisit" else payload,
    }


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _ranges(rows: list[dict]) -> Iterator[tuple[int, int, list[dict]]]:
    """Neighbouring records of a package together, as ranges of about ``READ_BYTES``."""
    begin, end, held = 0, 0, []
    for row in rows:
        start, stop = row["at"], row["at"] + row["length"]
        if held and (start - end > READ_GAP or max(stop, end) - begin > READ_BYTES):
            yield begin, end, held
            held = []
        if not held:
            begin, end = start, stop
        held.append(row)
        end = max(end, stop)
    if held:
        yield begin, end, held


def _records(batches, payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("package", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
         ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
        + ([("payload", pa.binary())] if payload else [])
    )
    for batch in batches:
        by_package: dict[str, list[dict]] = {}
        for row in batch.to_pylist():
            by_package.setdefault(row["package"], []).append(row)
        for path, rows in by_package.items():
            rows.sort(key=lambda r: r["at"])
            system, inner = _place(path)
            with system.open_input_file(inner) as file:
                for begin, end, held in _ranges(rows):
                    data = memoryview(_at(file, begin, end - begin))
                    out = [
                        row | parse_record(bytes(data[row["at"] - begin : row["at"] - begin + row["length"]])) for row in held
                    ]
                    yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in schema} for r in out], schema)


def read_packages(packages: DataFrame, payload: bool = False, block: int = INDEX_BLOCK) -> DataFrame:
    """Every record that the packages' indexes name, with its ``payload`` if asked for.

    In: ``package`` paths. Directories are read a block at a time, an index in blocks of
    ``block`` bytes that any task may take, records as ranges of neighbouring ones. An empty
    package gives no rows; an index without archive, a compressed or encrypted member, a cut
    package or a wrong digest stops the job. ``package``, ``file`` and ``offset`` name a record.
    """
    kinds = "package string, name string, start long, size long"
    found = pin(mapped(packages.select("package"), _members, kinds), "members")
    blocks = found.where(F.col("name").startswith("indexes/") & (F.col("size") > 0)).select(
        "package", "start", "size", F.lit(block).cast("long").alias("width"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block) - 1)).alias("block"),
    )
    # Few bytes stand for much reading, so the blocks stay apart.
    lines = mapped(spread(blocks, "package", "block"), _index_lines, "package string, file string, offset long, length long")
    archives = found.where(F.col("name").startswith("archive/")).select(
        F.col("package").alias("_package"), F.col("name").alias("_name"), F.col("start").alias("_start"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    salt = F.pmod(F.xxhash64("offset"), F.lit(SALTS)).cast("int")
    same = (F.col("package") == F.col("_package")) & (F.col("file") == F.col("_name")) & (salt == F.col("_salt"))
    missing = F.raise_error(F.concat(F.lit("no archive "), F.col("file"), F.lit(" in "), F.col("package")))
    start = F.when(F.col("_start").isNotNull(), F.col("_start")).otherwise(missing.cast("long"))
    placed = lines.join(archives, same, "left").select(
        "package", "file", "offset", "length", (start + F.col("offset")).alias("at")
    )
    return mapped(placed, _records, RECORD + (", payload binary" if payload else ""), payload)


def archived_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` as packages and read them back: a row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A null html is an empty
    payload, whose copies are revisits as well unless ``least`` is above 0; a null url leaves
    the record without target; a null id stays null and is never referred to; repeated rows
    are a record each; other columns are ignored; an empty table gives no rows.
    """
    where = folder or scratch_dir(pages.sparkSession, "archives")
    records = read_packages(write_packages(pages, where, least))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archived_pages_sql(least: int = LEAST_REVISIT) -> str:
    """DuckDB SQL for :func:`archived_pages`; base32 is written out from the hexadecimal digest."""
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
h AS (SELECT page_id, n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + (i // 4) * 5 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31
    AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN n >= {least} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {least} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h"""
