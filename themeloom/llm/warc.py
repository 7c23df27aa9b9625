"""WARC files from a converter of legacy ARC archives.

An ARC file opens with a version block that names the fields of its header lines: five
for version 1, ten for version 2.  Each record is a header line with a declared length
and as many bytes.  The converter reads the fields its version declares, cuts records by
their lengths, and gives each a WARC identifier, date, type and digests made from what
the ARC record holds, so a repeated conversion gives the same records.

Of records with equal payloads of at least ``min_bytes`` bytes the first by ``order`` is a
response; the others are revisits of it and carry no payload.  Payloads stay with their
archive: only digests are exchanged between tasks.

Archives are files of about ``archive_bytes``; a larger record is an archive of its own.
They are written and read with Spark's sources, so any file system that Spark knows will do.

Defined results: a null payload is an empty one; null and empty addresses are "-"; white
space and percent signs in a header field are percent-encoded; repeated rows are records
of their own, all but one of them revisits; rows without order come last; an empty table
gives an empty archive folder, which reads as no records.  A record cut short by the end
of its file fails the task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.session import materialize

ARCHIVE_BYTES = 4 << 20
# The header fields of both ARC versions, in order.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
UNDATED = "19700101000000"


def _unpacked(content: bytes) -> bytes:
    """The bytes of a file, whether gzip or not; gzip members follow each other."""
    if content[:2] != b"\x1f\x8b":
        return bytes(content)
    out = []
    while content[:2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
        out.append(reader.decompress(content) + reader.flush())
        content = reader.unused_data
    return b"".join(out)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value) -> str:
    return quote(str(value), safe="!#$&'()*+,/:;=?@[]~|^`{}\"<>\\") if value not in (None, "") else "-"


def _http(payload: bytes, mime: str) -> bytes:
    return (f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload


def _archives(pieces: Iterator[bytes], head: bytes, limit: int, end: bytes) -> Iterator[pa.RecordBatch]:
    """Records put together to archives; the writer adds the last ``end``."""
    held, size = [head] if head else [], 0

    def out():
        content = b"".join(held)
        return pa.RecordBatch.from_arrays([pa.array([content[:-len(end)]], pa.binary())], ["content"])

    for piece in pieces:
        if size and size + len(piece) > limit:
            yield out()
            held, size = [head] if head else [], 0
        held.append(piece)
        size += len(piece)
    if size:
        yield out()


def _write(archives: DataFrame, path: str, end: str) -> None:
    """One file for each row."""
    archives.select(F.col("content").cast("string").alias("value")).write.option("lineSep", end).option(
        "maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    )


def write_arc(
    df: DataFrame, path: str, version: int, uri: Column, payload: Column, date: Column | None = None,
    mime: str = "text/html", archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Archives of the legacy format from rows."""
    stamp = UNDATED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        note = f"{version} 0 themeloom\n{FIELDS[version]}\n"
        head = f"filedesc://pages.arc 0.0.0.0 {stamp} text/plain "
        if version == 2:
            head += f"200 - - 0 pages.arc "
        head = f"{head}{len(note)}\n{note}\n".encode()

        def records():
            offset = len(head)
            for batch in batches:
                for where, when, text in zip(*batch.columns):
                    body = _http((text.as_py() or "").encode(), mime)
                    line = f"{_field(where.as_py())} 0.0.0.0 {when.as_py() or stamp} {_field(mime)} "
                    if version == 2:
                        line += f"200 {digest(body)} - {offset} pages.arc "
                    record = f"{line}{len(body)}\n".encode() + body + b"\n"
                    offset += len(record)
                    yield record

        return _archives(records(), head, archive_bytes, b"\n")

    date = F.lit(None).cast("string") if date is None else date
    _write(df.select(uri.cast("string"), date.cast("string"), payload.cast("string")).mapInArrow(run, "content binary"),
           path, "\n")


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header fields and body of every record of an ARC file but version blocks."""
    at, fields = 0, None
    while at < len(content):
        if content[at:at + 1] == b"\n":
            at += 1
            continue
        stop = content.index(b"\n", at)
        parts = content[at:stop].decode().split(" ")
        length = int(parts[-1])
        body = content[stop + 1:stop + 1 + length]
        if len(body) < length:
            raise ValueError(f"record at {at} declares {length} bytes and has {len(body)}")
        if parts[0].startswith("filedesc://"):
            # The block says which fields the lines after it have.
            fields = body.decode().split("\n")[1].split(" ")
        elif fields is None or len(parts) != len(fields):
            raise ValueError(f"header line at {at} does not have the fields of its version")
        else:
            yield at, dict(zip(fields, parts)), body
        at = stop + 1 + length


def _payload(body: bytes) -> bytes:
    """What follows the HTTP header; the whole body if there is none."""
    if body[:5] != b"HTTP/":
        return body
    head, gap, rest = body.partition(b"\r\n\r\n")
    return rest if gap else b""


def _identity(path: str, at: int, fields: dict[str, str]) -> str:
    name = hashlib.sha1(f"{path.rsplit('/', 1)[-1]} {at} {fields['URL']} {fields['Archive-date']}".encode()).digest()
    return str(uuid.UUID(bytes=name[:16], version=5))


def _date(stamp: str) -> str:
    s = (stamp + UNDATED[len(stamp):])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


SUMMARY = "path string, at long, uri string, date string, mime string, payload_bytes long, payload_digest string, record_id string"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: where it lies, its header fields, and its payload's digest."""
    schema = pa.schema([
        ("path", pa.string()), ("at", pa.int64()), *((c, pa.string()) for c in ("uri", "date", "mime")),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                name, rows = name.as_py(), []
                for at, fields, body in arc_records(_unpacked(content.as_buffer().to_pybytes())):
                    payload = _payload(body)
                    rows.append((
                        name, at, unquote(fields["URL"]), fields["Archive-date"], unquote(fields["Content-type"]),
                        len(payload), digest(payload), _identity(name, at, fields)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return _files(spark, path).mapInArrow(run, SUMMARY)


def _warc(name: str, content: bytes, revisits: dict[int, dict]) -> Iterator[bytes]:
    for at, fields, body in arc_records(content):
        payload = _payload(body)
        again = revisits.get(at)
        head = [
            "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{_identity(name, at, fields)}>",
            f"WARC-Date: {_date(fields['Archive-date'])}", f"WARC-Target-URI: {fields['URL']}",
            f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
            f"Payload-Length: {len(payload)}",
            f"WARC-Identified-Payload-Type: {unquote(fields['Content-type'])}",
        ]
        if again:
            body = body[:len(body) - len(payload)]
            head += [
                f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{again['record_id']}>",
                f"WARC-Refers-To-Target-URI: {_field(again['uri'])}", f"WARC-Refers-To-Date: {_date(again['date'])}",
            ]
        head += [
            f"WARC-Block-Digest: sha1:{digest(body)}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(body)}",
        ]
        yield ("\r\n".join(head) + "\r\n\r\n").encode() + body + RECORD_END.encode()


def convert(
    spark: SparkSession, arc_path: str, warc_path: str, order: Column | None = None, min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """ARC files of a folder as WARC files.

    ``order`` is over the columns of ``read_arc``; the default is date and address.
    """
    order = F.struct("date", "uri") if order is None else order
    records = materialize(
        read_arc(spark, arc_path).withColumn("order", F.struct(order.isNull().alias("n"), order.alias("v"))), "records")
    first = materialize(
        records.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.min_by(F.struct("record_id", "uri", "date"), F.struct("order", "record_id")).alias("first"),
             F.count("*").alias("copies"))
        .where("copies > 1"), "first")
    again = (
        records.join(first, ["payload_digest", "payload_bytes"]).where("record_id != first.record_id")
        .groupBy("path").agg(F.collect_list(F.struct("at", "first.record_id", "first.uri", "first.date")).alias("again"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for name, content, again in zip(*batch.columns):
                    known = {r["at"]: r for r in again.as_py() or []}
                    yield from _warc(name.as_py(), _unpacked(content.as_buffer().to_pybytes()), known)

        return _archives(pieces(), b"", archive_bytes, RECORD_END.encode())

    files = _files(spark, arc_path).join(again, "path", "left").select("path", "content", "again")
    _write(files.mapInArrow(run, "content binary"), warc_path, RECORD_END)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record, by declared lengths."""
    at = 0
    while content[at:at + 5] == b"WARC/":
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode().split("\r\n")[1:]
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        length = int(fields["content-length"])
        block = content[stop + 4:stop + 4 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} declares {length} bytes and has {len(block)}")
        yield fields, block
        at = stop + 4 + length + 4
    if at < len(content):
        raise ValueError(f"no record at {at}")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each WARC record; digests are checked against what was read.

    Columns: ``record_id, record_type, uri, date, payload_bytes, payload_digest,
    refers_to_id, refers_to_uri`` and ``payload`` (null for revisits).
    """
    names = ["record_id", "record_type", "uri", "date", "payload_bytes", "payload_digest", "refers_to_id", "refers_to_uri"]
    schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in names]
                       + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(_unpacked(content.as_buffer().to_pybytes())):
                    kind, own = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    payload = _payload(block) if kind == "response" else None
                    size = int(fields["payload-length"])
                    if digest(block) != fields["warc-block-digest"].removeprefix("sha1:") or (
                            payload is not None and (digest(payload) != own or len(payload) != size)):
                        raise ValueError(f"{fields['warc-record-id']}: digest does not match")
                    refers = fields.get("warc-refers-to")
                    row = (
                        fields["warc-record-id"][10:-1], kind, unquote(fields["warc-target-uri"]), fields["warc-date"],
                        size, own, refers and refers[10:-1],
                        unquote(fields["warc-refers-to-target-uri"]) if refers else None)
                    rows.append((*row, payload) if with_payload else row)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    ddl = ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'string'}" for c in names)
    return _files(spark, path).select("content").mapInArrow(run, ddl + ", payload binary" * with_payload)


# The same in SQL, over table ``pages``.
SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
  SELECT page_id, strlen(html) AS payload_bytes,
         first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first,
         row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS nth,
         [('0x' || substr(hex, 5 * k + 1, 5))::INTEGER for k in range(8)] AS parts FROM hashed
)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15) % 32, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 10) % 32, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 5) % 32, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v % 32, 1) for v in parts], 'string_agg', '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN first END AS refers_to
FROM grouped
"""
