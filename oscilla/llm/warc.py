"""Legacy archives: ARC files (versions 1 and 2) converted to WARC, and both read and written.

An archive is a row (name, data) of at most about ARCHIVE_BYTES, complete in
itself: an ARC one starts with its version block, a WARC one with a warcinfo
record, so any task can read any archive. Archives are kept as a table in the
shared folder, the only place that driver and executors both see.

The ARC reader takes the field list that the version block's version implies (a
header line of five fields in version 1, ten in version 2), reads as many bytes
as the line declares, and goes on after the newline that ends a record. The
converter makes from each record a WARC identifier (a UUID of version 8 that
holds the page's number and a hash of address and date), a WARC-Date of the
14-digit date, the type (response for HTTP content, resource otherwise) and
SHA-256 digests of payload and block.

Of records with equal payloads of MIN_BYTES or more, the one with the smallest
page number stays response, the others become revisits with the HTTP head only.
The first of each such group is found by a map-side combined minimum; no group
is gathered.

Nulls: a null html is an empty payload; a null url is written as an unknown
address; a record with null page_id is never the first of a group, and is a
revisit if the group has one with a number. Rows that repeat the first's page_id
and payload are responses too. Extra columns are ignored.

Archives from elsewhere: one in gzip members is read member by member. A record that is
shorter than declared has ``whole`` false, and WARC-Truncated in its WARC record. Bytes
where a header line should stand give a row with ``error`` and are stepped over up to the
next header line.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small, staged, table, tune

ARCHIVE_BYTES = 4_000_000
MIN_BYTES = 100
DATE = "20260101000000"
IP = "0.0.0.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_GZIP = b"\x1f\x8b"
#: A record's header line: an address, its fields, a date among them, and the declared length. Where one is looked for, the address has a scheme.
_LINE = re.compile(rb"[^\n]* (?:\d{12}|\d{14}) [^\n]*?\d{1,15}\r?\n")
_HEADER = re.compile(rb"^[A-Za-z][A-Za-z0-9+.\-]*:[^\n]* (?:\d{12}|\d{14}) [^\n]*?\d{1,15}\r?\n", re.M)
_RECORD = "page_id bigint, record_id string, uri string, ip string, date string, mime string, head binary, payload binary, payload_bytes bigint, payload_digest string, whole boolean, error string"


# ---- ARC ---------------------------------------------------------------------


def arc_head(name: str, version: int, date: str = DATE) -> bytes:
    block = f"{version} 0 oscilla\n{_V1 if version == 1 else _V2}\n\n".encode()
    middle = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    return f"filedesc://{name} {IP} {date} {middle} {len(block)}\n".encode() + block


def arc_record(version: int, name: str, offset: int, url: str, date: str, mime: str, body: bytes) -> bytes:
    address = quote(url, safe=":/?#[]@!$&'()*+,;=%~._-") or "unknown:"
    middle = mime if version == 1 else f"{mime} 200 {hashlib.md5(body).hexdigest()} - {offset} {name}"
    return f"{address} {IP} {date} {middle} {len(body)}\n".encode() + body + b"\n"


def unzipped(data: bytes) -> bytes:
    """An archive as it is, or the content of all its gzip members; a damaged member gives what can be read of it."""
    if not data.startswith(_GZIP):
        return data
    out, at = [], 0
    while at >= 0:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data[at:]))
            out.append(member.flush())
            rest = len(member.unused_data)
            at = data.find(_GZIP, len(data) - rest) if rest else -1
        except zlib.error:
            at = data.find(_GZIP, at + 1)
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str] | None, bytes, bool]]:
    """(fields, content, whole) of every record after the version block.

    Where no header line of a record stands, reading goes on at the next line that is one;
    what lies between is given out without fields. So is all that comes before a version block.
    """
    at, fields = 0, None
    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        found = _LINE.match(data, at)
        if not found or fields is None and not data.startswith(b"filedesc://", at):
            following = _HEADER.search(data, at + 1)
            end = following.start() if following else len(data)
            if at < end:
                yield None, data[at:end], False
            at = end
            continue
        line = found[0].decode("utf-8", "replace").rstrip("\r\n")
        size, begin = int(line.rpartition(" ")[2]), found.end()
        content = data[begin : begin + size]
        at = begin + size
        whole = len(content) == size
        if line.startswith("filedesc://"):
            version, _, rest = content.partition(b"\n")
            named = rest.partition(b"\n")[0].decode("utf-8", "replace").split()
            fields = named if named[-1:] == ["Archive-length"] else (_V2 if version.startswith(b"2") else _V1).split()
            continue
        yield dict(zip(fields, line.rsplit(" ", len(fields) - 1), strict=False)), content, whole


def http_head(page_id: int | None, size: int) -> bytes:
    number = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {size}\r\n\r\n".encode()


def header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def packed(records: Iterator[tuple], first: bytes, add) -> Iterator[bytes]:
    """Archives of about ARCHIVE_BYTES: ``first`` and what ``add`` makes of each record."""
    out, size = [first], len(first)
    for record in records:
        made = add(record, size)
        out.append(made)
        size += len(made)
        if size >= ARCHIVE_BYTES:
            yield b"".join(out)
            out, size = [first], len(first)
    if len(out) > 1:
        yield b"".join(out)


def blobs(name: str, parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for k, data in enumerate(parts):
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{k}"]), pa.array([data], pa.binary())], names=["name", "data"])


def write_arc(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> ARC archives, of version 1 and 2 by turns."""

    def make():
        turn = [0]

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            turn[0] += 1
            version = 1 + turn[0] % 2
            name = f"part{turn[0]}.arc"

            def add(row, offset):
                page_id, url, html = row
                payload = (html or "").encode("utf-8", "surrogatepass")
                return arc_record(version, name, offset, url or "", DATE, "text/html", http_head(page_id, len(payload)) + payload)

            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            return blobs(name, packed(rows, arc_head(name, version), add))

        return each

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), make, "name string, data binary")


# ---- conversion --------------------------------------------------------------


def warc_date(date: str) -> str:
    """The ISO form of an ARC date of 14 digits (or 12, without seconds); anything else is the epoch."""
    if not re.fullmatch(r"\d{12}(\d\d)?", date):
        return "1970-01-01T00:00:00Z"
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page_id: int | None, uri: str, date: str) -> str:
    """A version-8 UUID: 48 bits of a hash, the number's presence, and its 64 bits."""
    mark = int.from_bytes(hashlib.sha256(f"{uri} {date}".encode("utf-8", "surrogatepass")).digest()[:6])
    number = 0 if page_id is None else page_id & (2**64 - 1)
    middle = (page_id is not None) << 2 | number >> 62
    return f"urn:uuid:{uuid.UUID(int=mark << 80 | 8 << 76 | middle << 64 | 2 << 62 | number & (2**62 - 1))}"


def page_of(identifier: str) -> int | None:
    bits = uuid.UUID(identifier.removeprefix("urn:uuid:")).int
    if not bits >> 66 & 1:
        return None
    number = (bits >> 64 & 3) << 62 | bits & (2**62 - 1)
    return number - 2**64 if number >> 63 else number


def converted(data: bytes) -> Iterator[tuple]:
    """The records of an ARC archive as rows of _RECORD; what is no record is one with an error and without an identifier."""
    for fields, content, whole in read_arc(unzipped(data)):
        if fields is None:
            yield None, None, None, None, None, None, b"", content, len(content), hashlib.sha256(content).hexdigest(), False, f"{len(content)} bytes without a header line"
            continue
        uri, date = fields.get("URL", "unknown:"), warc_date(fields.get("Archive-date", ""))
        head, payload = b"", content
        if content.startswith(b"HTTP/"):
            end = content.find(b"\r\n\r\n")
            head, payload = (content[: end + 4], content[end + 4 :]) if end >= 0 else (content, b"")
        number = header(head, "X-Page-Id")
        page_id = int(number) if number and re.fullmatch(r"-?\d+", number) else None
        yield page_id, record_id(page_id, uri, date), uri, fields.get("IP-address", IP), date, fields.get("Content-type", "application/octet-stream"), head, payload, len(payload), hashlib.sha256(payload).hexdigest(), whole, None


def convert_arc(archives: DataFrame) -> DataFrame:
    """ARC archives (name, data; gzip members or not) -> their records with WARC identifiers, dates and digests, and rows with an error."""
    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for data in batch.column("data"):
                if rows := list(converted(data.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return each

    return arrow_map(archives.select("data"), make, _RECORD)


def first_of_equal(records: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """(payload_digest, first, first_id): the record with the smallest page number of payloads that occur more than once."""
    of = records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
    found = of.agg(F.min("page_id").alias("first"), F.min_by("record_id", "page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return found.filter("n > 1 and first is not null").select("payload_digest", "first", "first_id")


# ---- WARC --------------------------------------------------------------------


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def write_warc(records: DataFrame) -> DataFrame:
    """Records with first and first_id (null: a payload of its own) -> WARC archives (name, data)."""

    def add(row, _):
        page_id, identifier, uri, ip, date, mime, head, payload, digest, whole, first, first_id = row
        kind = "revisit" if first is not None and first != page_id else "response" if head else "resource"
        block = head if kind == "revisit" else head + payload
        headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identifier}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-IP-Address", ip)]
        headers += [("Content-Type", "application/http; msgtype=response" if head else mime), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
        if not whole:
            headers.append(("WARC-Truncated", "length"))
        if kind == "revisit":
            headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{first_id}>")]
        return warc_record(headers, block)

    columns = ["page_id", "record_id", "uri", "ip", "date", "mime", "head", "payload", "payload_digest", "whole", "first", "first_id"]

    def make():
        turn = [0]

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            turn[0] += 1
            values = {c: batch.column(c).to_pylist() for c in columns}
            info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", warc_date(DATE)), ("Content-Type", "application/warc-fields")], b"software: oscilla\r\nformat: WARC File Format 1.0\r\n")
            return blobs(f"part{turn[0]}.warc", packed(zip(*values.values(), strict=True), info, add))

        return each

    return arrow_map(records.select(*columns), make, "name string, data binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """WARC archives -> page_id, payload_bytes, payload_digest, record_type, refers_to of their content records."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def rows(data: bytes):
        for headers, block in read_warc(data):
            kind = headers["WARC-Type"]
            if kind == "warcinfo":
                continue
            head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
            digest = headers["WARC-Payload-Digest"].rpartition(":")[2]
            size = int(header(head, "Content-Length") or 0) if kind == "revisit" else len(payload)
            if kind != "revisit":
                digest = hashlib.sha256(payload).hexdigest()
            yield page_of(headers["WARC-Record-ID"].strip("<>")), size, digest, kind, page_of(headers["WARC-Refers-To"].strip("<>")) if kind == "revisit" else None

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for data in batch.column("data"):
                if found := list(rows(data.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        return each

    return arrow_map(archives.select("data"), make, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive(pages: DataFrame) -> DataFrame:
    """The WARC archives of pages, by way of ARC archives, as a table in the shared folder."""
    tune(pages.sparkSession)
    return archived(write_arc(pages))


def archived(archives: DataFrame) -> DataFrame:
    """ARC archives (name, data) as WARC archives, a table in the shared folder; rows with an error are left to ``convert_arc``."""
    records = convert_arc(archives).filter("error is null")
    firsts = staged(first_of_equal(records.select("page_id", "record_id", "payload_bytes", "payload_digest")), "warc-firsts").withColumnRenamed("payload_digest", "digest")
    marked = records.join(small(firsts), (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= MIN_BYTES), "left")
    return staged(write_warc(marked), "warc")


def query(spark, sf_dir: str) -> DataFrame:
    return read_archives(archive(table(spark, sf_dir, "pages")))


ORACLE = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest AS digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM p LEFT JOIN f ON digest = payload_digest AND payload_bytes >= 100
"""
