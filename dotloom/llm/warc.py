"""Legacy archive converter: ARC files, version 1 and 2, to WARC 1.0 records, and WARC files read back.

``parse_arc`` reads the version block, whose second line names the fields of the header lines, and cuts records by
their declared lengths. ``to_warc`` synthesises what WARC asks for and ARC lacks: record ids (from the archive's name,
the record's offset in it and its content, so equal records differ and a rerun gives the same), W3C timestamps, record
types and SHA-1 digests of block and payload. Records with a payload seen before become ``revisit`` records of the
identical-payload-digest profile, which name the response's record id, target and date.

Archives travel as rows of bytes of about a megabyte, one row an archive; WARC archives have one gzip member a record.

Defined results: null html is an empty payload; a null url is written as ``unknown:``; rows with a null page_id revisit
the group's response, or are responses if no row of the group has an id; rows that share the smallest page_id are all
responses (revisits name that of the least record id); an empty table gives an empty one; further columns are ignored. A damaged archive gives its records up to
the damage and one row with ``error`` set.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import stored, with_only

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 1 << 20
DEFAULT_DATE = "20000101000000"


def sha1_32(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- ARC
def arc_head(version: int, name: str, date: str = DEFAULT_DATE) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 dotloom\n{ARC_FIELDS[version]}\n".encode()
    extra = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, offset: int, name: str) -> bytes:
    """One record: header line, block, line feed."""
    extra = f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {mime}{extra} {len(block)}\n".encode() + block + b"\n"


def gunzip_members(data: bytes, step: int = 1 << 15) -> tuple[bytes, str | None]:
    """All whole gzip members behind each other, and what ended them early; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    out, at = [], 0
    while at < len(data):
        d, pos, own = zlib.decompressobj(31), at, []
        try:
            while not d.eof:
                if pos >= len(data):
                    return b"".join(out), "gzip member without end"
                own.append(d.decompress(data[pos : pos + step]))
                pos = min(pos + step, len(data))
        except zlib.error as e:
            return b"".join(out), str(e)
        out += own
        at = pos - len(d.unused_data)
    return b"".join(out), None


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file as their header fields, ``version``, ``offset`` and ``block``. Raises ValueError at damage."""
    data, damage = gunzip_members(data)
    fields, version, at = None, 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end, offset = data.find(b"\n", at), at
        if end < 0:
            raise ValueError("header line without end")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        names = fields or ARC_FIELDS[1].split()
        parts = line.rsplit(" ", len(names) - 1)
        if fields is None and line.startswith("filedesc://"):
            length = line.rsplit(" ", 1)[-1]
        elif len(parts) != len(names):
            raise ValueError(f"header line with {len(parts)} fields")
        else:
            length = parts[-1]
        if not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError("declared length past the end")
        block = data[end + 1 : end + 1 + int(length)]
        at = end + 1 + int(length)
        if fields is None:
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0])
            fields = (lines[1] if len(lines) > 1 else ARC_FIELDS[version]).split()
            if fields[0] != "URL" or fields[-1] != "Archive-length":
                raise ValueError("unknown header fields")
            continue
        yield dict(zip(names, parts, strict=True)) | {"version": version, "offset": offset, "block": block}
    if damage:
        raise ValueError(damage)


# ---------------------------------------------------------------- WARC
def iso_date(arc_date: str) -> str:
    """A 14-digit ARC date as W3C timestamp; missing digits are those of the earliest time."""
    d = (arc_date if arc_date.isdigit() else "") + DEFAULT_DATE[len(arc_date) :] if arc_date.isdigit() else DEFAULT_DATE
    d = d[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    """A version 5 UUID of what the parts say."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; a block without HTTP head is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip().decode("latin-1")
    return None


def to_warc(url: str, date: str, head: bytes, payload: bytes, digest: str, own_id: str, response: dict | None = None) -> bytes:
    """A WARC record, one gzip member. ``response`` (page_id, record_id, url, date) makes it a revisit of that record, which keeps the HTTP head alone; the digest is the payload's."""
    block = head if response else head + payload
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if response else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {own_id}",
        f"WARC-Date: {iso_date(date)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_32(block)}",
    ]
    if response:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {response['record_id']}", f"WARC-Refers-To-Target-URI: {response['url']}",
            f"WARC-Refers-To-Date: {iso_date(response['date'])}", f"X-Refers-To-Page: {response['page_id']}",
        ]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else 'application/octet-stream'}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and blocks of a WARC file. Raises ValueError at damage."""
    data, damage = gunzip_members(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError("no WARC header")
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        length = fields.get("content-length", "")
        if not length.isdigit() or end + 4 + int(length) > len(data):
            raise ValueError("declared length past the end")
        at = end + 4 + int(length)
        yield fields, data[end + 4 : at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record without end")
        at += 4
    if damage:
        raise ValueError(damage)


# ---------------------------------------------------------------- DataFrame operators
ARC_SCHEMA = "name string, version int, bytes binary"
RECORD_SCHEMA = "url string, date string, mime string, page_id long, head binary, payload binary, payload_bytes long, payload_digest string, record_id string, error string"
WARC_SCHEMA = "bytes binary"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, record_date string, url string, error string"


def _url(url: str | None) -> str:
    """A url that can stand in a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "unknown:"


def pages_to_arc(pages: DataFrame, date: str = DEFAULT_DATE) -> DataFrame:
    """(page_id, url, html) as ARC archives, named by partition and number: even ids in version 1, others in version 2."""

    def run(batches):
        open_: dict[int, list[bytes]] = {}
        size, number, part = {1: 0, 2: 0}, {1: 0, 2: 0}, TaskContext.get().partitionId()

        def close(version):
            out = pa.RecordBatch.from_arrays([pa.array([named(version)]), pa.array([version], pa.int32()), pa.array([b"".join(open_.pop(version))], pa.binary())], ["name", "version", "bytes"])
            size[version], number[version] = 0, number[version] + 1
            return out

        def named(version):
            return f"{part:06d}-{number[version]:06d}-v{version}.arc"

        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                version = 2 if page is None else 1 + page % 2
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head += ("" if page is None else f"X-Page-Id: {page}\r\n") + "\r\n"
                name = named(version)
                parts = open_.setdefault(version, [arc_head(version, name, date)])
                parts.append(arc_record(version, _url(url), date, "text/html", head.encode() + payload, size[version], name))
                size[version] += len(parts[-1])
                if size[version] >= ARCHIVE_BYTES:
                    yield close(version)
        for version in list(open_):
            yield close(version)

    return with_only(pages, "page_id", "url", "html").mapInArrow(run, ARC_SCHEMA)


def read_arc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """ARC archives (name, bytes) to records: HTTP head, payload (both null without ``payloads``), its length and digest, record id."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def rows(name, data):
        try:
            for r in parse_arc(data or b""):
                head, payload = split_http(r["block"])
                page, digest = http_field(head, b"x-page-id"), sha1_32(payload)
                own = record_id(name or "", str(r["offset"]), r["URL"], digest)
                bodies = (head, payload) if payloads else (None, None)
                yield (r["URL"], r["Archive-date"], r["Content-type"], int(page) if page and page.lstrip("-").isdigit() else None, *bodies, len(payload), digest, own, None)
        except (ValueError, IndexError, KeyError) as e:
            yield (None,) * 9 + (str(e),)

    def run(batches):
        schema = pa.schema([("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("page_id", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()), ("error", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                got = list(rows(batch.column("name")[k].as_py(), batch.column("bytes")[k].as_py()))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), schema.types, strict=True)], names)

    return with_only(archives, "name", "bytes").mapInArrow(run, RECORD_SCHEMA)


def write_warc(records: DataFrame) -> DataFrame:
    """Records with ``response`` (see ``mark_revisits``) to WARC archives of about a megabyte of payload."""
    cols = ("url", "date", "head", "payload", "payload_digest", "record_id", "response")

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in cols]
                parts.append(to_warc(*row))
                size += len(row[3])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["bytes"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["bytes"])

    return with_only(records, *cols).mapInArrow(run, WARC_SCHEMA)


def read_warc(archives: DataFrame) -> DataFrame:
    """WARC archives (bytes) to one row a record. A response's digest is computed anew; a wrong one is an error."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]

    def rows(data):
        try:
            for f, block in parse_warc(data or b""):
                head, payload = split_http(block)
                page, refers, digest = http_field(head, b"x-page-id"), f.get("x-refers-to-page"), f.get("warc-payload-digest", "").removeprefix("sha1:")
                kind, error = f.get("warc-type"), None
                if kind == "revisit":
                    size = int(http_field(head, b"content-length") or 0)
                else:
                    size, own = len(payload), sha1_32(payload)
                    error = None if own == digest else "payload digest differs"
                    digest = own
                yield (int(page) if page else None, size, digest, kind, int(refers) if refers else None, f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-date"), f.get("warc-target-uri"), error)
        except ValueError as e:
            yield (None,) * 9 + (str(e),)

    def run(batches):
        for batch in batches:
            for data in batch.column("bytes").to_pylist():
                got = list(rows(data))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names)

    return with_only(archives, "bytes").mapInArrow(run, READ_SCHEMA)


def first_responses(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(payload_digest, first): page_id, record_id, url and date of the row with the smallest page_id, of payloads of at least ``least_bytes``."""
    first = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "url", "date"))
    return records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(first).alias("first"))


def mark_revisits(records: DataFrame, first: DataFrame) -> DataFrame:
    """Adds ``response``: what a record revisits, null for responses. Null ids revisit; rows of the smallest page_id don't.

    ``first`` is a stored table with a row a digest, so the join's sides are plain exchanges whose hot digests adaptive
    execution can split.
    """
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return records.join(first, "payload_digest", "left").withColumn("response", F.when(again, F.col("first"))).drop("first")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as ARC, converted to WARC archives in the shared folder, which are then read back.

    The ARC archives are parsed twice, for the digests and for the payloads, so that payloads lie in one exchange and
    in the WARC archives alone.
    """
    arc = pages_to_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    first = stored(first_responses(read_arc(arc, payloads=False).where("error IS NULL")), "warc-first")
    archives = stored(write_warc(mark_revisits(read_arc(arc).where("error IS NULL"), first.df)), "warc-archives")
    first.drop()
    return read_warc(archives.df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest
  FROM p
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
