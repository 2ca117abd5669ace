"""Legacy web archives (ARC, versions 1 and 2) to WARC/1.1, with revisit records for equal payloads.

An ARC file, plain or gzip-compressed, begins with a version block that names its version and its
header fields; every record is one header line, whose last field is the declared length, that
many bytes, and a line feed.  Version 1 lines have 5 fields, version 2 lines 10.  The converter
parses the lines by the declared version, takes exactly the declared bytes, and synthesises what
WARC has and ARC lacks: record identifiers (from archive name and offset), ISO timestamps (from
14-digit dates), record types and SHA-1 digests in base32, of the block and of the payload.

Types: the version block becomes a ``warcinfo``; a block that begins with an HTTP header, and an
answer of a ``dns:`` address, become a ``response``; anything else is a ``resource`` of its own
content type.  Of responses with an HTTP header whose payloads are equal and hold at least
``least`` bytes, the one with the smallest key (or date) is kept whole and the others become a
``revisit`` of it that stores their HTTP header only.

Headers and payloads are bytes throughout; nothing is decoded.  What cannot be converted (a broken
header line, a record that ends early, a date that is none, broken compression, no version block)
becomes a row with ``problem`` and its place in the archive, and parsing goes on at the next line
that looks like a header; ``rejects`` lists these rows.

WARC files are compressed with one gzip member a record, so a record can be read alone by its
file and offset; a file ends once it holds ``file_bytes``.  Reading streams a file member by
member.

Defined results: a null html is an empty payload, and the empty payload counts as equal to
itself; a null or empty url is written as '-' in ARC and left out in WARC, white space in it is
escaped; rows with a null key are always responses and are never referred to; if the smallest
key is repeated, all its rows are responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.llm.storage import Scratch, atomic_output, bounded_batches, file_system, new_path, trim_memory

FILE_BYTES = 64_000_000
ARCHIVE_BYTES = 1_000_000
CHUNK_BYTES = 1 << 20
BROADCAST_ROWS = 200_000
BATCH_ROWS = 256
# The field lines of both ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_AFTER_TYPE = {1: 1, 2: 6}  # fields behind the content type, which may hold spaces
_HEADER = re.compile(rb"(?m)^(?:-|[A-Za-z][A-Za-z0-9+.-]*:[^ \n]*) [^ \n]+ [0-9]{14} [^\n]*[0-9]\r?$")
_EPOCH = datetime(1997, 1, 1)
_PAGE = re.compile(rb"(?im)^X-Page-Id: (-?[0-9]+)\r?$")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- ARC ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class ArcRecord:
    """A record; about: it is the archive's version block."""

    version: int
    offset: int
    url: str
    ip: str
    date: str
    content_type: str
    status: str
    block: bytes
    about: bool = False


@dataclass(frozen=True)
class Broken:
    """A place of an archive that holds no readable record."""

    offset: int
    problem: str


def write_arc(name: str, version: int, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An archive of (url, ip, date, content type, block) records."""
    about = f"{version} 0 Archive\n{FIELDS[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 19970101000000 text/plain"
    parts = [f"{head} {len(about)}\n".encode() if version == 1 else f"{head} 200 - - 0 {name} {len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, parts))
    for url, ip, date, kind, block in records:
        line = f"{url} {ip} {date} {kind} {len(block)}\n" if version == 1 else f"{url} {ip} {date} {kind} 200 - - {at} {name} {len(block)}\n"
        parts += [line.encode(), block, b"\n"]
        at += len(parts[-3]) + len(block) + 1
    return b"".join(parts)


def unpacked(data: bytes) -> tuple[bytes, str | None]:
    """The bytes of an archive that may be compressed (in one gzip member or many), and what was wrong with the compression."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    parts = []
    while data[:2] == b"\x1f\x8b":
        tool = zlib.decompressobj(31)
        try:
            parts.append(tool.decompress(data))
        except zlib.error as e:
            return b"".join(parts), f"broken compression: {e}"
        if not tool.eof:
            return b"".join(parts), "compressed data end early"
        data = tool.unused_data
    return b"".join(parts), None


def _next_header(data: bytes, at: int) -> int:
    found = _HEADER.search(data, at)
    return found.start() if found else len(data)


def _is_date(text: str) -> bool:
    try:
        return bool(re.fullmatch("[0-9]{14}", text)) and bool(datetime.strptime(text, "%Y%m%d%H%M%S"))
    except ValueError:
        return False


def parse_arc(data: bytes) -> Iterator[ArcRecord | Broken]:
    """The records of an archive, its version block first, and the places that hold none."""
    data, trouble = unpacked(data)
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # blank lines between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        fields = line.split(" ")
        if end < 0 or len(fields) < (len(FIELDS[version].split()) if version else 5) or not re.fullmatch("[0-9]+", fields[-1]):
            yield Broken(at, f"broken header line: {line[:80]}")
            if not version:
                return
            at = _next_header(data, end + 1) if end >= 0 else len(data)
            continue
        size = int(fields[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            yield Broken(at, f"the record ends early: {line[:80]}")
            if not version:
                return
            at = _next_header(data, end + 1)
            continue
        if not version:
            first = block.split(b"\n", 1)[0].split(b" ")[0]
            if not fields[0].startswith("filedesc://") or first not in (b"1", b"2"):
                yield Broken(at, "no version block")
                return
            version = int(first)
            if _is_date(fields[2]):
                yield ArcRecord(version, at, fields[0], fields[1], fields[2], "text/plain", "", block, True)
        elif _is_date(fields[2]):
            kind = " ".join(fields[3 : len(fields) - _AFTER_TYPE[version]])
            yield ArcRecord(version, at, fields[0], fields[1], fields[2], kind, fields[-6] if version == 2 else "", block)
        else:
            yield Broken(at, f"no date: {line[:80]}")
        at = end + 1 + size
    if trouble:
        yield Broken(len(data), trouble)


def arc_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(name, archive): pages as ARC archives of about ARCHIVE_BYTES, of both versions in turn; the key travels in the HTTP header."""
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            version = 1 + (held[0][4][-1] if held[0][4] else 0) % 2
            name = f"{hashlib.md5(b''.join(r[4][:400] + r[0].encode() for r in held)).hexdigest()[:16]}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_arc(name, version, held)], pa.binary())], names=["name", "archive"])

        for batch in batches:
            for k, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{'' if k is None else f'X-Page-Id: {k}\r\n'}\r\n"
                date = (_EPOCH + timedelta(seconds=(k or 0) % 2_000_000_000)).strftime("%Y%m%d%H%M%S")
                held.append((re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), u) if u else "-", "0.0.0.0", date, "text/html", header.encode() + h))
                size += len(h)
                if size > ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        trim_memory()

    return rows.mapInArrow(run, "name string, archive binary")


# -- conversion -----------------------------------------------------------------------------
RECORDS = "archive string, offset long, problem string, record_id string, record_type string, uri string, ip string, date string, content_type string, header binary, payload binary, payload_bytes long, payload_digest string, block_digest string, header_digest string, page long"
_NAMES = [f.split(" ")[0] for f in RECORDS.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split(" ")[1]] for f in RECORDS.split(", ")]


def _converted(archive: str, r: ArcRecord) -> tuple:
    """The row of a record."""
    record_id = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive}:{r.offset}'.encode()).digest(), version=4)}>"
    date = datetime.strptime(r.date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    cut = 0
    if r.about:
        kind, content = "warcinfo", "application/warc-fields"
        r = ArcRecord(r.version, r.offset, "-", r.ip, r.date, content, "", f"software: gavelframe\r\nformat: WARC File Format 1.1\r\narc-version: {r.version}\r\narc-name: {archive}\r\n".encode())
    elif r.block.startswith(b"HTTP/"):
        kind, content = "response", "application/http; msgtype=response"
        end = r.block.find(b"\r\n\r\n")
        cut = end + 4 if end >= 0 else len(r.block)
    else:
        kind, content = ("response", "text/dns") if r.url.startswith("dns:") else ("resource", r.content_type if "/" in r.content_type else "application/octet-stream")
    header, payload = r.block[:cut], r.block[cut:]
    found = _PAGE.search(header)
    return archive, r.offset, None, record_id, kind, None if r.url == "-" else r.url, r.ip, date, content, header, payload, len(payload), base32_sha1(payload), base32_sha1(r.block), base32_sha1(header), int(found[1]) if found else None


def convert_arc(archives: DataFrame, name: str = "name", archive: str = "archive") -> DataFrame:
    """One row a record of every archive, with what WARC needs, and one with a problem for every place that holds none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(label, r.offset, r.problem, *[None] * (len(_NAMES) - 3)) if isinstance(r, Broken) else _converted(label, r) for r in parse_arc(data.as_py() or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
        trim_memory()

    return archives.select(F.col(name).cast("string"), F.col(archive)).mapInArrow(run, RECORDS)


def rejects(records: DataFrame) -> DataFrame:
    """(archive, offset, problem) of what convert_arc() could not read."""
    return records.where("problem is not null").select("archive", "offset", "problem")


def with_revisits(scratch: Scratch, records: DataFrame, least: int = 0, order: str = "page") -> DataFrame:
    """The readable records of a saved table with refers_id, refers_uri, refers_date: set for revisits only.

    order: the column that says which of equal payloads is first, page (rows without one stay
    responses) or date.
    """
    good = records.where("problem is null")
    able = good.where((F.col("record_type") == "response") & (F.octet_length("header") > 0) & (F.col("payload_bytes") >= least) & F.col(order).isNotNull())
    groups = able.groupBy("payload_digest").agg(F.min(F.struct(F.col(order).alias("by"), "record_id", "uri", "date")).alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    groups = scratch.save(groups, "warc-groups", compact=True)
    later = F.col("page") != F.col("first.by") if order == "page" else F.col("record_id") != F.col("first.record_id")
    again = able.select("record_id", "page", "payload_digest").join(groups, "payload_digest").where(later)
    again = scratch.save(again.select("record_id", F.col("first.record_id").alias("refers_id"), F.col("first.uri").alias("refers_uri"), F.col("first.date").alias("refers_date")), "warc-revisits", compact=True)
    return good.join(again, "record_id", "left")


# -- WARC -----------------------------------------------------------------------------------
def warc_record(row: dict) -> bytes:
    """One WARC/1.1 record of a row of with_revisits()."""
    revisit = row["refers_id"] is not None
    block = row["header"] if revisit else row["header"] + row["payload"]
    fields = {
        "WARC-Type": "revisit" if revisit else row["record_type"],
        "WARC-Record-ID": row["record_id"],
        "WARC-Target-URI": row["uri"],
        "WARC-Date": row["date"],
        "WARC-IP-Address": row["ip"] if row["record_type"] == "response" else None,
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "WARC-Block-Digest": f"sha1:{row['header_digest'] if revisit else row['block_digest']}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": row["refers_id"],
        "WARC-Refers-To-Target-URI": row["refers_uri"],
        "WARC-Refers-To-Date": row["refers_date"],
        "Content-Type": row["content_type"],
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


MANIFEST = "file string, n_records long, n_bytes long"


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of with_revisits() as WARC files below path; returns the manifest, one row a file (to be saved before use: reading it writes).

    A task that runs again writes other names, so the manifest, not the folder, says what counts.
    """
    columns = ["record_id", "record_type", "uri", "ip", "date", "content_type", "header", "payload", "payload_digest", "block_digest", "header_digest", "refers_id", "refers_uri", "refers_date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = f"{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex[:8]}"
        rows = (row for batch in batches for row in batch.to_pylist())
        row, n = next(rows, None), 0
        while row is not None:
            file, count, size = f"{path}/part-{task}-{n:05d}.warc.gz", 0, 0
            with atomic_output(file) as sink:
                while row is not None and size < file_bytes:
                    member = gzip.compress(warc_record(row), 6, mtime=0)
                    sink.write(member)
                    count, size, row = count + 1, size + len(member), next(rows, None)
            yield pa.RecordBatch.from_pylist([{"file": file, "n_records": count, "n_bytes": size}], schema=pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))
            n += 1
        trim_memory()

    return records.select(*columns).mapInArrow(run, MANIFEST)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of uncompressed data."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} ends early")
        yield headers, block
        at = end + 8 + size


def members(source) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member of a file, read in pieces of CHUNK_BYTES."""
    at, held = 0, source.read(CHUNK_BYTES)
    while held:
        tool, parts, size = zlib.decompressobj(31), [], 0
        while not tool.eof:
            if not held:
                held = source.read(CHUNK_BYTES)
                if not held:
                    raise ValueError(f"the member at byte {at} ends early")
            parts.append(tool.decompress(held))
            size += len(held)
            held = tool.unused_data
        yield at, b"".join(parts)
        at += size - len(held)
        held = held or source.read(CHUNK_BYTES)


def read_record(file: str, offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a file, by the offset that read_warc() gives."""
    fs, at = file_system(file)
    with fs.open_input_file(at) as source:
        source.seek(offset)
        return next(parse_warc(next(members(source))[1]))


READ = "file string, offset long, record_id string, record_type string, uri string, date string, refers_id string, page long, payload_bytes long, payload_digest string"


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row a record of the files of a saved manifest; digests of stored payloads are checked."""
    names = [f.split(" ")[0] for f in READ.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in READ.split(", ")]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in (f for batch in batches for f in batch.column(0).to_pylist()):
            rows = []
            fs, path = file_system(file)
            with fs.open_input_file(path) as source:
                for offset, content in members(source):
                    for headers, block in parse_warc(content):
                        kind, http = headers["warc-type"], headers["content-type"].startswith("application/http")
                        end = block.find(b"\r\n\r\n") if http else -4
                        cut = end + 4 if end >= 0 or not http else len(block)
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind != "revisit" and base32_sha1(block[cut:]) != digest:
                            raise ValueError(f"payload digest of {headers['warc-record-id']} does not match")
                        found = _PAGE.search(block[:cut])
                        rows.append((file, offset, headers["warc-record-id"], kind, headers.get("warc-target-uri"), headers["warc-date"], headers.get("warc-refers-to"), int(found[1]) if found else None, None if kind == "revisit" else len(block) - cut, digest))
                    if len(rows) >= 1000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)
        trim_memory()

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(run, READ)


def warc_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, path: str | None = None) -> DataFrame:
    """Pages through ARC archives and the converter into WARC files, read back: (key, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    with bounded_batches(spark, BATCH_ROWS):
        records = scratch.save(convert_arc(arc_archives(pages, key, url, html)), "warc-records")
        manifest = scratch.save(write_warc(with_revisits(scratch, records, least), path or new_path(spark, "warc")), "warc-manifest", compact=True)
        scratch.drop("warc-records", "warc-revisits", "warc-groups")
        read = scratch.save(read_warc(manifest), "warc-read")
    stored = read.where("record_type = 'response'").select(F.col("page").alias(key), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    targets = read.where("record_type = 'response'").select(F.col("record_id").alias("i"), F.col("page").alias("target"), F.col("payload_bytes").alias("target_bytes"))
    again = read.where("record_type = 'revisit'")
    wanted = scratch.save(targets.join(again.select(F.col("refers_id").alias("i")).distinct(), "i", "left_semi"), "warc-targets", compact=True)
    again = again.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, F.col("refers_id") == F.col("i"))
    again = again.select(F.col("page").alias(key), F.col("target_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("target").alias("refers_to"))
    return scratch.result(stored.unionByName(again), "warc-pages")
