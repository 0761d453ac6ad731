"""Legacy ARC archives converted to WARC, written as files and read back.

Pages are laid down as ARC records of version 1 or 2 (a version block, then header lines of five or ten fields with
declared lengths). The converter reads such bytes by the declared lengths alone, so a payload may hold whatever
looks like a header, and synthesises WARC/1.1 headers: a record id that depends on page and payload, the
timestamp from the ARC date, the content type, and the SHA-1 of the payload. Of records with equal payloads of at
least least_bytes, the one with the smallest page_id is a response and the others are revisits that name it and carry no payload.

Files are written by Spark's text writer, with the blank lines that end a record as its separator and gzip. Records are
dealt to as many files as their bytes ask for, at most RECORDS_IN_FILE to each; a file is read back in one task, record by
record. A file is one gzip member: Spark's writers make no member for each record, so a reader can't seek inside one.

A null html is an empty payload; a null url is written as `-`. A row without page_id is an archive record too, keeps
a null id, counts as later than all others, and isn't named by a revisit unless all equal ones lack an id. Rows that
repeat an id are records each; of equal ones one is the response, whichever, as what is returned is alike. White space and control signs in a url, of any
script, are written as %20. Payloads of any length are written whole. Other columns, whatever their names, aren't
read. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import read, scratch_dir, stored

#: Records of a file at most, payload bytes of a file about, and what ends a record.
RECORDS_IN_FILE, FILE_BYTES, END = 2000, 16 << 20, b"\r\n\r\n"
_SPACE = re.compile(r"[\s\x00-\x1f]+")
#: Fields of the header lines of ARC versions 1 and 2 (fixed by the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}


def arc_date(page: int | None) -> str:
    """A 14-digit date for pages that carry none: a second for each id from 2000-01-01 on, over some 28 years."""
    s = abs(page or 0) % (28 * 365 * 86_400)
    day, s = divmod(s, 86_400)
    year, day = divmod(day, 365)
    month, day = divmod(day, 28)
    return f"{2000 + year + month // 12:04d}{month % 12 + 1:02d}{day + 1:02d}{s // 3600:02d}{s // 60 % 60:02d}{s % 60:02d}"


def write_arc(records: list[tuple[str, str, bytes]], version: int, filename: str = "legacy.arc") -> bytes:
    """An ARC file of (url, date, payload)."""
    names = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "length": "Archive-length", "result": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename"}[f] for f in ARC_FIELDS[version])
    block = f"{version} 0 legacy\n{names}\n".encode()
    extra = [] if version == 1 else ["200", "-", "-", "0", filename]
    out = [(" ".join([f"filedesc://{filename}", "0.0.0.0", "20000101000000", "text/plain", *extra, str(len(block))]) + "\n").encode(), block, b"\n"]
    offset = sum(map(len, out))
    for url, date, payload in records:
        extra = [] if version == 1 else ["200", "-", "-", str(offset), filename]
        head = (" ".join([url, "0.0.0.0", date, "text/html", *extra, str(len(payload))]) + "\n").encode()
        out += [head, payload, b"\n"]
        offset += len(head) + len(payload) + 1
    return b"".join(out)


def read_arc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record after the version block."""
    at, fields = 0, None
    while at < len(raw):
        end = raw.index(b"\n", at)
        parts = raw[at:end].decode("utf-8").split(" ")
        size = int(parts[-1])
        payload = raw[end + 1 : end + 1 + size]
        if len(payload) < size:
            raise ValueError(f"record at byte {at} ends before its declared length of {size}")
        if fields is None:
            fields = ARC_FIELDS[int(payload.split(b" ", 1)[0])]
        else:
            if len(parts) != len(fields):
                raise ValueError(f"record at byte {at} has {len(parts)} header fields instead of {len(fields)}")
            yield dict(zip(fields, parts, strict=True)), payload
        at = end + 1 + size
        at += raw[at : at + 1] == b"\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) -> the fields of the WARC record that its ARC record becomes. A batch's archives alternate in version."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            ids, urls, texts = (batch.column(k).slice(low, 256).to_pylist() for k in range(3))
            records = [(_SPACE.sub("%20", u) if u else "-", arc_date(i), (t or "").encode()) for i, u, t in zip(ids, urls, texts, strict=True)]
            found = read_arc(write_arc(records, 1 + low // 256 % 2))
            rows = []
            for i, (head, payload) in zip(ids, found, strict=True):
                sha = digest(payload)
                record = uuid.uuid5(uuid.NAMESPACE_URL, f"{head['url']} {head['date']} {i} {sha}")
                rows.append((i, head["url"], _iso(head["date"]), head["type"], f"<urn:uuid:{record}>", sha, len(payload), payload.decode("utf-8")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


_NAMES = ["page_id", "uri", "date", "type", "record_id", "sha1", "n_bytes", "payload"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]


def arc_to_warc(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(_convert, "page_id long, uri string, date string, type string, record_id string, sha1 string, n_bytes long, payload string")


def with_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """records with the page_id and record_id that they refer to, null for responses.

    Digests alone are grouped and joined, without payloads; a frequent one meets as partial minima and in a join that Spark can split.
    """
    slim = records.where(F.col("n_bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    first = slim.groupBy("sha1", "n_bytes").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select("sha1", "n_bytes", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_to_record"))
    return records.join(stored(first).hint("shuffle_merge"), ["sha1", "n_bytes"], "left")


def record_text(df: DataFrame) -> DataFrame:
    """A column value with each record's headers and block, without the lines that end it."""
    revisit = F.col("is_revisit")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Target-URI", F.col("uri")), line("WARC-Date", F.col("date")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", F.col("refers_to_record")))).otherwise(F.lit("")),
        optional("X-Page-Id", F.col("page_id").cast("string")), optional("X-Refers-To-Page", F.when(revisit, F.col("refers_to").cast("string"))), line("X-Payload-Length", F.col("n_bytes").cast("string")),
        line("Content-Type", F.col("type")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))), F.lit("\r\n"),
    )
    return df.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """records with is_revisit, as gzipped WARC files."""
    record_text(records).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_IN_FILE).text(path)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, one after another."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record but {first[:40]!r}")
        head = {}
        while line := stream.readline().removesuffix(b"\r\n"):
            name, value = line.decode("utf-8").split(": ", 1)
            head[name] = value
        size = int(head["Content-Length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != END:
            raise ValueError(f"record {head.get('WARC-Record-ID')} doesn't end where it should")
        yield head, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            rows = []
            for head, payload in parse_warc(gzip.GzipFile(fileobj=pa.BufferReader(raw.as_buffer()))):
                number = lambda name: int(head[name]) if name in head else None  # noqa: B023,E731
                sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and digest(payload) != sha:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't have its digest")
                rows.append((number("X-Page-Id"), head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Record-ID"], number("X-Payload-Length"), sha, head["WARC-Type"], number("X-Refers-To-Page"), payload.decode("utf-8") if head["WARC-Type"] == "response" else None))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ_TYPES, strict=True)], _READ_NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ_TYPES, strict=True)], _READ_NAMES)


_READ_NAMES = ["page_id", "uri", "date", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_READ_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives, its digest checked against its payload. A file is a row of one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse, "page_id long, uri string, date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes WARC files of pages to path and returns what they hold."""
    records = arc_to_warc(pages)
    slim = records.select("page_id", "record_id", "sha1", "n_bytes")
    number = F.row_number().over(Window.partitionBy("record_id").orderBy("page_id"))
    flags = with_revisits(slim, least_bytes).select("record_id", "refers_to", "refers_to_record").dropDuplicates(["record_id"])
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    dealt = records.repartition(max(1, -(-total // FILE_BYTES)), "record_id")  # the window and the join keep to it
    whole = dealt.withColumn("copy", number).join(flags.hint("shuffle_merge"), "record_id")
    whole = whole.withColumn("is_revisit", F.col("refers_to_record").isNotNull() & ((F.col("refers_to_record") != F.col("record_id")) | (F.col("copy") > 1)))
    write_warc(whole, path)
    return read_warc(pages.sparkSession, path)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive(read(spark, sf_dir, "pages"), f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The SHA-1's bits in groups of five, as letters; a response is the smallest page_id of its payload.
OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
letters AS (
    SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) AS INTEGER), 1), '' ORDER BY k) AS digest
    FROM (SELECT DISTINCT h FROM p) AS hashes, range(32) AS places(k) GROUP BY h
),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM g JOIN letters USING (h)
"""
