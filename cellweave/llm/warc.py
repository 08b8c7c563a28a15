"""Web archives: ARC to WARC conversion, WARC writing with revisits, and reading back.

The converter reads ARC bytes: the ``filedesc`` record names the version and
the fields of the header lines, each record is a header line and as many bytes
as it declares.  For each record it synthesises what WARC needs and ARC lacks:
a record identifier, an ISO timestamp, the record type, and SHA-256 digests of
block and payload.

Archives are written by Spark's text writer, one record a row: a record ends in
CR LF CR LF and the writer's line separator is that last LF.  Thus files appear
by Spark's commit protocol on any file system it knows, and a lost executor's
part is written again whole.

Of records with equal payloads of at least ``min_revisit`` bytes the one with
the smallest page_id is a response and the others are revisits of it.  Payloads
are grouped by digest with a partial minimum before the shuffle, so a payload
that a third of all pages share costs a row per task.  Digests alone meet by
digest; pages, with their payloads, then meet their revisits' rows by page_id and
digest, so the pages that share a payload are spread over all tasks.

Defined cases: a null html is an empty payload; a null url becomes ``about:blank``;
white space and control characters in URLs are percent-encoded; a null page_id
is kept as null and never the target of a revisit while another page_id exists
(if a payload has null page_ids only, all of them are responses); rows that
repeat the smallest page_id are all responses; an empty table writes an archive
without records; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import fresh_path

#: Field names of header lines by ARC version. Fixed values of the format.
ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_UNSAFE = re.compile(r"[\s\x00-\x1f\x7f]")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def arc_file(records: list[tuple[str, str, str, bytes]], version: str = "1", name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    """An ARC file of (url, date, content type, block) records."""
    fields = " ".join(ARC_FIELDS[version])
    about = f"{version} 0 archive\n{fields}\n\n".encode()

    def line(url: str, when: str, kind: str, length: int, at: int) -> bytes:
        values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": when, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(at), "Filename": name, "Archive-length": str(length)}
        return (" ".join(values[f] for f in ARC_FIELDS[version]) + "\n").encode()

    out = [line(f"filedesc://{name}", date, "text/plain", len(about), 0), about]
    at = sum(map(len, out))
    for url, when, kind, block in records:
        head = line(url, when, kind, len(block), at)
        out += [head, block, b"\n"]
        at += len(head) + len(block) + 1
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, by its own version's header fields and declared lengths."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = data.index(b"\n", at)
        words = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            if not words[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with a filedesc record")
            length = int(words[-1])
            about = data[end + 1 : end + 1 + length].decode("utf-8", "replace").splitlines()
            fields = tuple(about[1].split(" ")) if len(about) > 1 and about[1] else ARC_FIELDS[about[0].split(" ")[0]]
            at = end + 1 + length
            continue
        if len(words) < len(fields):
            raise ValueError(f"a header line of {len(words)} fields where the version has {len(fields)}")
        extra = len(words) - len(fields)  # blanks in the URL
        words = [" ".join(words[: extra + 1]), *words[extra + 1 :]]
        head = dict(zip(fields, words))
        length = int(head["Archive-length"])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError("an ARC record is cut short")
        yield {"url": head["URL"], "ip": head["IP-address"], "date": head["Archive-date"], "type": head["Content-type"], "block": block}
        at = end + 1 + length


def warc_date(arc_date: str) -> str:
    """An ARC date of 8 to 14 digits as WARC's ISO form."""
    digits = (re.sub(r"\D", "", arc_date) + "00000000000000")[:14]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload); no head: (b"", block)."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def record_id(url: str, date: str, payload_digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join((url, date, payload_digest, key)))}>"


def warc_from_arc(record: dict, refers_to: int | None = None) -> bytes:
    """The WARC record for a parsed ARC record, without the last LF; a revisit if ``refers_to`` is given."""
    head, payload = split_http(record["block"])
    digest = hashlib.sha256(payload).hexdigest()
    key = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    date = warc_date(record["date"])
    is_http = bool(head)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response' if is_http else 'resource'}",
        f"WARC-Record-ID: {record_id(record['url'], date, digest, key[1].decode() if key else '')}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {record['url']}",
        f"WARC-IP-Address: {record['ip']}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {'application/http;msgtype=response' if is_http else record['type']}",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if key:
        lines.append(f"WARC-Page-Id: {key[1].decode()}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of WARC bytes, by declared lengths; a compressed archive is unpacked record by record."""
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("no WARC record where one must begin")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line[:-2].decode("utf-8", "replace").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record {head.get('WARC-Record-ID')} does not end where it declares")
        yield head, block


def _page_block(page_id, html: bytes) -> bytes:
    key = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(html)}\r\n\r\n".encode() + html


def write_warc(pages: DataFrame, path: str, min_revisit: int = 100, date: str = "20000101000000", compression: str = "gzip", archive_records: int = 10_000) -> None:
    """Writes a WARC record per row of ``pages`` (page_id, url, html), through ARC blocks of a batch each; an archive holds ``archive_records`` at most."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    shared = pages.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # rows of an identifier and two hashes; those that are copies of another page
    copies = pages.select("page_id", "digest").join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    marked = pages.join(copies, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))

    def convert(batches):
        for n, b in enumerate(batches):
            ids, urls, html, refers = (b.column(i).to_pylist() for i in range(4))
            arc = arc_file([(_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", u or "about:blank"), date, "text/html", _page_block(k, h.encode())) for k, u, h in zip(ids, urls, html)], version="12"[n % 2])
            yield pa.RecordBatch.from_arrays([pa.array([warc_from_arc(r, to) for r, to in zip(arc_records(arc), refers)], type=pa.binary())], names=["record"])

    # the cast keeps the bytes as they are; the writer's separator is the record's last byte
    records = marked.mapInArrow(convert, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("maxRecordsPerFile", archive_records).option("lineSep", "\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives in ``path``: page_id, url, date, record_type, payload_bytes, payload_digest, refers_to, record_id.

    A response's payload is hashed and must match its digest; a revisit has its
    full payload's length and digest from its headers.
    """

    def parse(batches):
        for b in batches:
            rows = []
            for data in b.column(0).to_pylist():
                for head, block in warc_records(data):
                    digest = head["WARC-Payload-Digest"].split(":", 1)[1]
                    size = int(head["WARC-Payload-Length"])
                    if head["WARC-Type"] != "revisit":
                        payload = split_http(block)[1]
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
                    rows.append((int(head["WARC-Page-Id"]) if "WARC-Page-Id" in head else None, head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Type"], size, digest, int(head["WARC-Refers-To-Page-Id"]) if "WARC-Refers-To-Page-Id" in head else None, head["WARC-Record-ID"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(list(zip(*rows)) or [[]] * 8, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["page_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the ARC files in ``path``, as the WARC record that the converter makes of it."""

    def parse(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                records = [(r["url"], warc_from_arc(r) + b"\n") for r in arc_records(data)]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in records], type=pa.string()), pa.array([w for _, w in records], type=pa.binary())], names=["url", "record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "url string, record binary")


def archive_pages(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, min_revisit)
    return read_warc(spark, path)
