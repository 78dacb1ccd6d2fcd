"""WARC archives: written with revisits, segments and chunked framing, and read back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import new_path, saved, small_batches

#: A block of more bytes is written as a first segment and continuation records.
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
#: Records in a file: with segments, no file outgrows a task's memory.
FILE_RECORDS = 1000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_RECORDS = "record_id string, type string, uri string, page_id long, refers_to string, digest string, segment int, origin string, total long, block binary"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in _RECORDS.split(", ")]


def _id(page_id: int | None, sha1: str, number: int, segment: int = 1) -> str:
    """Record ids follow from the page, its payload, the number among equal rows and the segment."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{sha1}/{number}/{segment}')}>"


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where a chunk is cut short or its size is no number."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where it should")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("a response without an end of its header")
    return dechunked(body) if re.search(rb"\r\ntransfer-encoding:\s*chunked\s*(\r\n|$)", head, re.I) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last line feed, which the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r"


def _records(page_id: int | None, url: str | None, payload: bytes, sha1: str, number: int, response: tuple[int | None, str] | None) -> Iterator[bytes]:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    fields = [("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page_id)]
    own = _id(page_id, sha1, number)
    if response is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(response[0], sha1, 1)), *fields], head)
        return
    block = head + chunked(payload)
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *fields, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = len(block) if i == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _id(page_id, sha1, number, i)), ("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Number", i), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Total-Length", last)], part)


def write(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of ``pages(page_id, url, html)`` to gzipped archives at ``path``.

    Of rows with equal payloads, that with the largest page_id is the response, the
    others are revisits that refer to it; of equal rows of one page one is the response, and rows
    without a page_id come before all others.  A null html is an empty payload, a null
    url is named after the page.  Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # The key of a page and its payload is never null, so that rows, decisions and numbers share one exchange.
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("_key", F.concat_ws("/", F.col("page_id").cast("string"), "sha1"))
    keyed = rows.select("page_id", "sha1").distinct().select("sha1", F.concat_ws("/", F.col("page_id").cast("string"), "sha1").alias("_key"))
    largest = rows.groupBy("sha1").agg(F.max("page_id").alias("_response"))
    decided = keyed.join(largest, "sha1").select("_key", "_response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, url, payload, sha1, number, response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "_number", "_response")), strict=True):
                new = list(_records(page, url, payload, sha1, number, None if page == response and number == 1 else (response, sha1)))
                out += new
                held += sum(map(len, new))
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    number = F.row_number().over(Window.partitionBy("_key").orderBy("url"))
    records = rows.join(decided, "_key").withColumn("_number", number).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _parse(content: bytes) -> Iterator[tuple]:
    """The records of one archive, gzipped (one member or many) or plain."""
    if content[:2] == b"\x1f\x8b":
        parts = []
        while content:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(content))
            content = d.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut short")
        at = end + 4 + size + 4
        number = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
        yield (
            head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), number("x-page-id"), head.get("warc-refers-to"),
            head.get("warc-payload-digest"), number("warc-segment-number"), head.get("warc-segment-origin-id"), number("warc-segment-total-length"), block,
        )


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives at ``path``, as they stand: segments are rows of their own."""

    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for r in _parse(content.as_py()):
                    rows.append(r)
                    held += len(r[-1])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Whole records with their payload: ``record_id, type, uri, page_id, refers_to, digest, payload``.

    Continuation records are grouped by the record where they started, ordered by
    segment number and checked: numbers without a gap, and the total length that
    the last one names.  Chunked framing is undone.  A revisit has no payload.  Only
    records in segments are shuffled.
    """
    found = records(spark, path)
    named = ["record_id", "type", "uri", "page_id", "refers_to", "digest"]
    parts = found.where("segment is not null").groupBy(F.coalesce("origin", "record_id").alias("of"))
    head = F.min_by(F.struct(*named), "segment")
    whole = parts.agg(head.alias("head"), F.array_sort(F.collect_list(F.struct("segment", "block", "total"))).alias("parts"))
    block = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.block))")
    complete = F.expr("transform(parts, p -> p.segment) = sequence(1, size(parts))") & F.element_at("parts", -1)["total"].eqNullSafe(F.length(block).cast("long"))
    checked = F.when(complete, block).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), F.col("of"))).cast("binary"))
    whole = whole.select("head.*", checked.alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("type").to_pylist()
            payload = [http_payload(b) if k == "response" else None if k == "revisit" else b for k, b in zip(kinds, batch.column("block").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in named), pa.array(payload, pa.binary())], names=[*named, "payload"])

    schema = "record_id string, type string, uri string, page_id long, refers_to string, digest string, payload binary"
    return found.where("segment is null").select(*named, "block").union(whole).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """``payload_bytes`` and ``payload_digest`` (base32 of SHA-1) of rows with a payload, which leaves."""
    kept = [f.name for f in found.schema if f.name != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = batch.column("payload").to_pylist()
            size = [None if p is None else len(p) for p in payload]
            digest = [None if p is None else base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payload]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(size, pa.int64()), pa.array(digest, pa.string())], names=[*kept, "payload_bytes", "payload_digest"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "payload"] + ["payload_bytes long", "payload_digest string"])
    return found.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, reads them back and reports each page.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to`` from what was read, a row for each row of ``pages``;
    a revisit has the figures of the response it refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    found = saved(digests(read(spark, path).select("record_id", "type", "page_id", "refers_to", "payload")), "records")
    response = found.where("type = 'response'")
    target = response.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    revisit = found.where("type = 'revisit'").select("page_id", "refers_to").join(target, "refers_to")
    out = response.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return out.union(revisit.select("page_id", "b", "d", F.lit("revisit"), "target"))
