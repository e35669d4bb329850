"""Web archives: write pages as WARC records, read them back, put segmented records together.

Writing: one record for each page, with the body in chunked transfer framing; files are compressed with gzip.  Of the pages with
equal payloads the one with the smallest id is a response; the others are revisits that refer to it
and hold no body, only its length in their response head.  A record longer than ``segment_bytes`` is cut into a first record and
continuation records with the same origin id; the last states the total length.

Reading: archives are inflated piece by piece and parsed by the length that each record states.  Whole records are decoded where
they are read; only segments are shuffled: they are grouped by origin id and ordered by segment number, the total length is verified, and the
chunked framing is decoded.  Every payload is checked against its digest.

Cases: null html is an empty payload; a null id counts as larger than any other.  Rows that repeat
the smallest id of their payload are all responses; an id may stand for several payloads.  Payloads are equal if SHA-1, length and a second hash
are.  Null urls leave the field out; line ends in a url
are percent-encoded.  An empty table gives no archives and no rows.  Missing segments, a wrong total, a broken
frame or digest raise an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialise

RECORDS_PER_FILE = 4096
SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 12
INFLATE_BYTES = 1 << 20
#: Payloads that occur more than once are broadcast up to so many (50 MB), else joined by a shuffle.
SMALL = 500_000
END = b"\r\n"
HTTP_HEAD = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Transfer-Encoding: chunked", b"", b""])
REVISIT_HEAD = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d", b"", b""])


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 digest of a binary column in upper-case base 32."""
    digest = F.sha1(payload)
    part = lambda at, n, to: F.lpad(F.conv(F.substring(digest, at, n), 16, 32), to, "0")
    digits = F.upper(F.concat(part(1, 15, 12), part(16, 15, 12), part(31, 10, 8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(body: bytes, chunk: int = CHUNK_BYTES) -> bytes:
    """``body`` in chunked transfer framing."""
    out = []
    for at in range(0, len(body), chunk):
        piece = body[at : at + chunk]
        out += [b"%x\r\n" % len(piece), piece, END]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(block: bytes, at: int = 0) -> bytes:
    """The body in chunked transfer framing from ``at`` to the end of ``block``."""
    out = []
    while True:
        line = block.index(END, at)
        size = int(block[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            break
        if block[at + size : at + size + 2] != END:
            raise ValueError("a chunk does not end where its length says")
        out.append(block[at : at + size])
        at += size + 2
    if block[at:] != END:
        raise ValueError("bytes after the last chunk")
    return b"".join(out)


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + END + block


def _records(page, record_id: str, date: str, segment_bytes: int) -> Iterator[bytes]:
    url = page["url"] and page["url"].replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + page["digest"])]
    kind = ("Content-Type", "application/http; msgtype=response")
    if not page["response"]:
        refers = [("WARC-Refers-To", f"<urn:page:{page['first']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record([("WARC-Type", "revisit"), *common, *refers, kind], REVISIT_HEAD % len(page["payload"]))
        return
    block = HTTP_HEAD + chunked(page["payload"])
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common, kind], block)
        return
    cuts = range(0, len(block), segment_bytes)
    for number, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        if number == 1:
            yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1), kind], part)
        else:
            total = len(block) if number == len(cuts) else None
            yield _record([
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{number}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<{record_id}>"),
                ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total),
            ], part)


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``, in any file system that Spark writes.

    A file holds ``records_per_file`` records of ``segment_bytes`` and their heads at most.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    payload = F.col("payload")
    rows = rows.withColumn("digest", base32_sha1(payload)).withColumns({"n_bytes": F.octet_length(payload), "mark": F.xxhash64(payload)})
    same = ["digest", "n_bytes", "mark"]
    several = materialise(rows.groupBy(*same).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(*same, "first", F.lit(True).alias("several")), "payloads")
    rows = rows.join(F.broadcast(several) if several.count() <= SMALL else several, same, "left")
    rows = rows.withColumn("response", F.col("several").isNull() | F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                for page in batch.slice(at, 256).to_pylist():
                    n += 1
                    out += _records(page, f"urn:page:{page['page_id']}:{task}-{n}", date, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = rows.select("page_id", "url", "payload", "digest", "first", "response").mapInArrow(run, "value binary")
    text = records.select(F.col("value").cast("string").alias("value"))  # the bytes as they are
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


_WHOLE = "id string, kind string, digest string, refers_to string, payload_bytes bigint, payload binary"
_SEGMENT = "id string, kind string, digest string, refers_to string, origin string, number int, total bigint, block binary"


def inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a file of gzip members, or of one that isn't compressed, in pieces of about ``INFLATE_BYTES``."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = d.decompress(data, INFLATE_BYTES)
            if not piece and not d.eof:
                raise ValueError("a compressed archive is cut off")
            data = d.unconsumed_tail or d.unused_data
            yield piece


def _read(spark: SparkSession, path: str, schema: str, segmented: bool) -> DataFrame:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch["content"]:
                out, size = [], 0
                for record_id, kind, digest, refers_to, origin, number, total, block in _parse(inflated(value.as_buffer().to_pybytes())):
                    if (number is not None) != segmented:
                        continue
                    out.append((record_id, kind, digest, refers_to, *((origin, number, total, block) if segmented else _decoded(kind, block))))
                    size += len(block)
                    if len(out) == 1024 or size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, digest, refers_to, payload_bytes, payload) of the records under ``path`` that aren't segmented, with their framing decoded."""
    return _read(spark, path, _WHOLE, False)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, digest, refers_to, origin, number, total, block) of first records and their continuations."""
    return _read(spark, path, _SEGMENT, True)


def _parse(chunks: Iterable[bytes]) -> Iterator[tuple]:
    held = b""
    for chunk in chunks:
        held += chunk
        at = 0
        while (head := held.find(b"\r\n\r\n", at)) >= 0:
            version, *lines = held[at:head].decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no record where one should begin: {version[:20]!r}")
            f = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
            end = head + 4 + int(f["content-length"])
            if end + 4 > len(held):
                break
            if held[end : end + 4] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            at, block = end + 4, held[head + 4 : end]
            number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
            yield (
                f["warc-record-id"].strip("<>"), f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:") or None, (f.get("warc-refers-to") or "").strip("<>") or None,
                (f.get("warc-segment-origin-id") or (number and f["warc-record-id"]) or "").strip("<>") or None, number and int(number), total and int(total), block,
            )
        held = held[at:]
    if held:
        raise ValueError("the archive ends within a record")


def reassemble(segments: DataFrame) -> DataFrame:
    """(id, kind, digest, refers_to, payload_bytes, payload): segments joined in their order, and the framing decoded."""
    part = F.struct("number", "total", "block")
    columns = ["id", "kind", "digest", "refers_to"]
    first = F.col("number") == 1
    joined = segments.groupBy("origin").agg(*(F.max(F.when(first, F.col(c))).alias(c) for c in columns), F.sort_array(F.collect_list(part)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                piece = batch.slice(at, 64)
                found = [_decoded(kind, _joined(parts)) for kind, parts in zip(piece["kind"].to_pylist(), piece["parts"].to_pylist(), strict=True)]
                size, payload = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*(piece[c] for c in columns), pa.array(size, pa.int64()), pa.array(payload, pa.binary())], names=[*columns, "payload_bytes", "payload"])

    return joined.select(*columns, "parts").mapInArrow(run, _WHOLE)


def _joined(parts: list[dict]) -> bytes:
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing or occur twice")
    block = b"".join(p["block"] for p in parts)
    if parts[-1]["total"] != len(block):
        raise ValueError("the segments' total length is not the stated one")
    return block


def _decoded(kind: str, block: bytes) -> tuple[int, bytes | None]:
    """The payload's length, and the payload itself where the record holds it."""
    head = block.index(b"\r\n\r\n") + 4
    if kind == "revisit":
        return next(int(x[15:]) for x in block[:head].split(END) if x.lower().startswith(b"content-length:")), None
    payload = unchunked(block, head)
    return len(payload), payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload, payload_bytes, payload_digest, record_type, refers_to) of all pages under ``path``.

    A revisit has no payload of its own; its head states the length.
    """
    found = read_whole(spark, path).unionByName(reassemble(read_segments(spark, path)))
    page_id = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) as bigint)")
    right = F.col("payload").isNull() | (base32_sha1(F.col("payload")) == F.col("digest"))
    digest = F.when(right, F.col("digest")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    return found.select(
        page_id("id").alias("page_id"), "payload", "payload_bytes", digest.alias("payload_digest"), F.col("kind").alias("record_type"), page_id("refers_to").alias("refers_to")
    )
