"""Legacy archive converter: ARC records become WARC records.

``parse_arc`` walks an ARC file by its declared lengths. The version line says which header fields follow:
version 1 has ``URL IP-address Archive-date Content-type Archive-length``, version 2 adds
``Result-code Checksum Location Offset Filename`` before the length. ``to_warc`` makes a WARC 1.1 record of each: a record id
(UUID 5 of URL, date and file name, so reruns agree), a timestamp from the 14-digit date, type, and SHA-256 digests. The block of
a record is an HTTP response header made from the ARC fields and, but for revisits, the payload.

Files: WARC text files (UTF-8 payloads) in the shared folder, written and read back by Spark's own writers and readers.
A null html is an empty payload, a null url is written as "-", a null page_id as "null". Records with equal payloads of at
least MIN_REVISIT bytes: the one with the smallest page_id is the response, rows with the same page_id as that one too
(repeated rows), all others (null ids included) revisit it. An empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_exit, new_path, read

#: Payloads below this many bytes are always stored.
MIN_REVISIT = 100
#: A file is closed after FILE_CHUNKS chunks of about CHUNK bytes; that bounds the memory of a reader.
CHUNK, FILE_CHUNKS = 1 << 22, 16

ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}


def _token(value: str | None) -> str:
    """A header field without white space: ARC separates fields by single spaces."""
    return re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]), value) if value else "-"


def arc_file(records: list[dict], version: int = 2, name: str = "batch.arc") -> bytes:
    """An ARC file: the version block, then a header line and the payload of each record."""
    fields = ARC_FIELDS[version]
    names = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "mime": "Content-type", "status": "Result-code", "length": "Archive-length"}
    about = f"{version} 0 veilspark\n{' '.join(names.get(f, f.capitalize()) for f in fields)}\n".encode()
    start = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "19700101000000", "mime": "text/plain", "status": "200", "filename": name, "length": str(len(about))}
    out = [" ".join(start.get(f, "-") for f in fields).encode() + b"\n", about, b"\n"]
    for r in records:
        head = {**r, "length": str(len(r["payload"]))}
        out += [" ".join(_token(head.get(f)) for f in fields).encode() + b"\n", r["payload"], b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file. The payload is what the declared length says, whatever the bytes in it are."""
    end = data.index(b"\n")
    first = data[:end].decode().split(" ")
    block = data[end + 1 : end + 1 + int(first[-1])]
    version = int(block.split(b" ", 1)[0])
    fields = ARC_FIELDS[version]
    if len(first) != len(fields):
        raise ValueError(f"ARC version {version} has {len(fields)} header fields, not {len(first)}")
    at = end + 1 + len(block)
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        head = dict(zip(fields, data[at:end].decode().rstrip("\r").split(" "), strict=True))
        length = int(head["length"])
        if end + 1 + length > len(data):
            raise ValueError(f"{head['url']}: {length} bytes declared, {len(data) - end - 1} left")
        yield {**head, "payload": data[end + 1 : end + 1 + length]}
        at = end + 1 + length


def to_warc(record: dict, revisit_of: str | None = None) -> bytes:
    """A WARC record; ``revisit_of``: file name of the ARC record with the same payload, whose body then isn't repeated."""
    payload, date = record["payload"], record["date"]
    digest = hashlib.sha256(payload).hexdigest()
    stamp = datetime.datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")

    def identity(name: str) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {date}')}>"

    http = f"HTTP/1.1 {record.get('status', '200')} OK\r\nContent-Type: {record['mime']}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if revisit_of is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if revisit_of is None else 'revisit'}", f"WARC-Record-ID: {identity(record.get('filename', record['url']))}",
        f"WARC-Date: {stamp}", f"WARC-Target-URI: {record['url']}", f"WARC-IP-Address: {record['ip']}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"X-ARC-Filename: {record.get('filename', '-')}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit_of is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {identity(revisit_of)}", f"X-Refers-To-Filename: {revisit_of}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        length = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield head, block
        at = end + 8 + length


def _convert(most: int):
    """Rows of about ``most`` bytes of records, or of one longer record."""

    def chunk(records):
        whole = b"".join(records)[:-1]  # the writer adds the last line feed
        return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary()).cast(pa.string())], ["value"])

    def run(batches):
        for batch in batches:
            ids, urls, pages, refs = (batch.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to"))
            source = [{"url": u, "ip": "0.0.0.0", "date": "19700101000000", "mime": "text/html", "status": "200", "filename": f"page-{'null' if i is None else i}", "payload": h} for i, u, h in zip(ids, urls, pages, strict=True)]
            out, size = [], 0
            for record, ref in zip(parse_arc(arc_file(source)), refs, strict=True):
                out.append(to_warc(record, None if ref is None else f"page-{ref}"))
                size += len(out[-1])
                if size > most:
                    yield chunk(out)
                    out, size = [], 0
            if out:
                yield chunk(out)

    return run


def convert(pages: DataFrame) -> DataFrame:
    """A WARC record of every row of ``pages`` (page_id, url, html), many to a row of text, by way of ARC segments."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("long", F.octet_length("html") >= MIN_REVISIT)
    first = rows.where("long").groupBy("digest").agg(F.min("page_id").alias("first_id")).withColumn("long", F.lit(True))
    rows = rows.join(first, ["digest", "long"], "left")
    ref = F.when(~F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False)), F.col("first_id"))
    return rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), ref.alias("refers_to")).mapInArrow(_convert(CHUNK), "value string")


def write_archives(pages: DataFrame, path: str) -> None:
    convert(pages).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_CHUNKS).text(path)


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string"


def _number(name: str | None):
    return None if name in (None, "page-null") else int(name.removeprefix("page-"))


def _read(batches):
    import zlib

    for batch in batches:
        for data in batch.column("content").to_pylist():
            if data[:2] == b"\x1f\x8b":
                data = zlib.decompress(data, 31)
            rows = []
            for head, block in parse_warc(data):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't match its digest")
                size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
                rows.append((_number(head["X-ARC-Filename"]), head["WARC-Target-URI"], size, digest, kind, _number(head.get("X-Refers-To-Filename")), head["WARC-Record-ID"], head["WARC-Date"]))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _READ.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``, plain or gzip; a payload that doesn't match its digest is an error."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, _READ)


def archive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    delete_at_exit(spark, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND p.page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND p.page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
