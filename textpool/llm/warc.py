"""WARC archives: writing, reading, and revisit resolution.

Archives are files of a few megabytes that Spark writes and reads, so any
file system of the cluster will do. Resolution reads the records' headers,
shuffles them by payload digest, joins every record to the first response of
its digest, and writes the archives again: that response keeps its payload,
the others become revisit records that refer to it. A payload crosses the
network at most once, in the join with the revisits when those are too many
to broadcast.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpool.llm.common import NO_ID, materialise
from textpool.session import scratch_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"
#: An archive is closed when its records reach this many bytes; a longer record has one of its own.
ARCHIVE_BYTES = 8 << 20
#: Pages carry no capture time; the records' date is this parameter.
CAPTURED = "1970-01-01T00:00:00Z"
#: Headers of one digest are dealt over this many keys before they meet.
SALTS = 64

HEADER = "record_id string, record_type string, uri string, digest string, payload_bytes long, refers_to string, refers_uri string"
RECORD = HEADER + ", payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _field(name: str, value: str | None) -> bytes:
    if value is None:
        return b""
    clean = "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in value)
    return f"{name}: {clean}\r\n".encode()


def format_record(rec: dict, date: str = CAPTURED) -> bytes:
    """One record without the line breaks that end it; a revisit holds the HTTP head only."""
    revisit = rec["record_type"] == "revisit"
    payload = b"" if revisit else (rec["payload"] or b"")
    size = rec["payload_bytes"] if revisit else len(payload)
    digest = rec["digest"] if revisit else payload_digest(payload)
    length = b"" if size is None else b"Content-Length: %d\r\n" % size
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + length + b"\r\n" + payload
    head = (VERSION + b"\r\n" + _field("WARC-Type", rec["record_type"]) + _field("WARC-Record-ID", f"<{rec['record_id']}>")
            + _field("WARC-Date", date) + _field("WARC-Target-URI", rec["uri"])
            + _field("WARC-Payload-Digest", None if digest is None else f"sha1:{digest}")
            + _field("WARC-Block-Digest", f"sha1:{payload_digest(block)}"))
    if revisit:
        head += (_field("WARC-Profile", PROFILE) + _field("WARC-Refers-To", rec["refers_to"] and f"<{rec['refers_to']}>")
                 + _field("WARC-Refers-To-Target-URI", rec["refers_uri"]))
    return head + _field("Content-Type", "application/http; msgtype=response") + b"Content-Length: %d" % len(block) + BREAK + block


def parse_records(data: bytes) -> Iterator[dict]:
    """The response and revisit records of an archive, by their stated lengths; others are skipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    pos = 0
    while pos < len(data):
        end = data.index(BREAK, pos)
        lines = data[pos:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {pos}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        start = end + len(BREAK)
        block = data[start:start + int(fields[b"content-length"])]
        pos = start + len(block) + len(BREAK)
        kind = fields.get(b"warc-type")
        if kind not in ("response", "revisit"):
            continue
        payload = block
        if fields.get(b"content-type", "").startswith("application/http"):
            payload = block.partition(BREAK)[2]
        digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
        refers = fields.get(b"warc-refers-to")
        response = kind == "response"
        yield {"record_id": fields[b"warc-record-id"].strip("<>"), "record_type": kind, "uri": fields.get(b"warc-target-uri"),
               "digest": payload_digest(payload) if response else digest, "payload_bytes": len(payload) if response else None,
               "refers_to": refers and refers.strip("<>"), "refers_uri": fields.get(b"warc-refers-to-target-uri"),
               "payload": payload if response else None}


def write_archives(records: DataFrame, path: str) -> None:
    """Write ``records`` (columns RECORD) as gzipped archives of about ``ARCHIVE_BYTES`` (before compression)."""
    def pack(batches):
        parts, size = [], 0
        for batch in batches:
            for rec in batch.to_pylist():
                parts.append(format_record(rec))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([BREAK.join(parts)], pa.binary())})
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([BREAK.join(parts)], pa.binary())})

    # one row is one file; the separator that the writer adds ends its last record
    (records.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string"))
     .write.option("lineSep", BREAK.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under ``path``; without ``payloads``, their headers only."""
    names = [f.split()[0] for f in (RECORD if payloads else HEADER).split(", ")]
    schema = pa.schema([(n, {"payload": pa.binary(), "payload_bytes": pa.int64()}.get(n, pa.string())) for n in names])

    def parse(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = [{n: r[n] for n in names} for r in parse_records(data.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD if payloads else HEADER)


def _place():
    """Records are taken in the order of their numbers; identifiers without a number come last, by their text."""
    number = F.regexp_extract("record_id", r"^urn:page:(-?\d+):", 1).try_cast("long")
    return F.struct(F.coalesce(number, F.lit(NO_ID)).alias("number"), F.col("record_id"))


def with_originals(headers: DataFrame) -> DataFrame:
    """``headers`` with ``original struct<record_id, uri, payload_bytes>``: the first response with the same payload digest.

    Headers of one digest meet per salt only; null where no response has it.
    """
    dealt = headers.withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)))
    first = F.min(F.when(F.col("record_type") == "response", F.struct(_place().alias("place"), "record_id", "uri", "payload_bytes")))
    partial = dealt.filter("digest IS NOT NULL").groupBy("digest", "_salt").agg(first.alias("first"))
    whole = partial.groupBy("digest").agg(F.min("first").alias("first"))
    originals = partial.select("digest", "_salt").join(whole, "digest").select("digest", "_salt", F.struct(
        *[F.col(f"first.{c}").alias(c) for c in ("record_id", "uri", "payload_bytes")]).alias("original")).filter(
        "original.record_id IS NOT NULL")
    return dealt.join(originals, ["digest", "_salt"], "left").drop("_salt")


def dedup_archives(spark: SparkSession, source: str, target: str) -> None:
    """Write the archives under ``source`` again under ``target``, each payload once.

    The first response of a payload keeps it; every other record of the same
    digest becomes a revisit with fresh headers that name it. A revisit whose
    response is in none of the archives stays as it is.
    """
    found = with_originals(read_archives(spark, source)).filter("original.record_id <> record_id")
    revisits = materialise(spark, found.select("record_id", F.col("original.record_id").alias("to_id"), F.col("original.uri").alias("to_uri"),
                                               F.col("original.payload_bytes").alias("to_bytes")), "warc-revisits")
    joined = read_archives(spark, source, payloads=True).join(revisits, "record_id", "left")
    is_copy = F.col("to_id").isNotNull()
    write_archives(joined.select(
        "record_id", F.when(is_copy, F.lit("revisit")).otherwise(F.col("record_type")).alias("record_type"), "uri", "digest",
        F.coalesce("to_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("to_id", "refers_to").alias("refers_to"),
        F.when(is_copy, F.col("to_uri")).otherwise(F.col("refers_uri")).alias("refers_uri"),
        F.when(~is_copy, F.col("payload")).alias("payload")), target)


def page_records(pages: DataFrame) -> DataFrame:
    """A response record per row of ``pages``; its identifier holds the page_id and the row's place in the input."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select(
        F.concat(F.lit("urn:page:"), page, F.lit(":"), F.monotonically_increasing_id()).alias("record_id"),
        F.lit("response").alias("record_type"), F.col("url").alias("uri"), F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))


def archive_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the deduplicated archives of ``pages``.

    The pages are written as archives, resolved, written again and read back;
    a revisit gets its size from the response that it refers to. A null html
    is an empty payload and takes part like any other. Of rows with equal
    payloads the smallest page_id holds the payload; rows without a page_id
    come after all others. Rows that repeat a page_id are records of their
    own: the first in the input is taken as the smaller. Control characters of
    a url are percent-encoded in its header, a null url has none. Other
    columns are ignored. No pages give no rows.
    """
    raw, deduplicated = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_archives(page_records(pages.select("page_id", "url", "html")), raw)
    dedup_archives(spark, raw, deduplicated)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):", 1).try_cast("long")
    records = with_originals(materialise(spark, read_archives(spark, deduplicated), "warc-headers"))
    return records.select(page(F.col("record_id")).alias("page_id"), F.col("original.payload_bytes").alias("payload_bytes"),
                          F.col("digest").alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"))


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, octet_length(payload) AS payload_bytes, h, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(h, CAST(i // 4 AS BIGINT) * 5 + 1, 5))::BIGINT >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS digest FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d
"""
