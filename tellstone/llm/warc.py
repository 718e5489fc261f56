"""WARC archives: writing with segmentation and chunked framing, reading with reassembly."""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import folder, joined

CRLF = b"\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(k + b": " + v for k, v in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block


def chunked(payload: bytes, size: int) -> bytes:
    """payload in the chunked transfer framing of HTTP."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload in a chunked body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk isn't followed by CRLF")
        out.append(body[at : at + size])
        at += size + 2


def _clean(url: str | None) -> bytes:
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in (url or "").encode()) or b"urn:none"


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = 32768, chunk_bytes: int = 8192, records_per_file: int = 1000, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages (page_id, url, html) under path.

    Of equal payloads of at least min_revisit_bytes, the row with the largest
    page_id is a response, the others are revisits of it; smaller payloads are
    all responses.  Rows that repeat that largest page_id with that payload are
    all responses; null page_ids count as smallest.  A null html is an empty
    payload.  A block beyond segment_bytes goes into a first segment and
    continuation records.  Other columns are not used.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter(F.col("n") > 1).drop("n")
    rows = joined(rows, groups, ["digest"], "left", F.struct("page_id", "url"))
    revisit = (F.octet_length("payload") >= min_revisit_bytes) & F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("refers_to")).alias("refers_to"))
    stamp = date.encode()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            columns = [batch.column(i) for i in range(5)]
            columns[2] = columns[2].cast(pa.binary())
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (c[i].as_py() for c in columns)
                row += 1
                name = hashlib.sha1(f"{part}:{row}:{page}:{digest}".encode()).hexdigest()
                origin = f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>".encode()
                same = [(b"WARC-Date", stamp), (b"WARC-Target-URI", _clean(url))]
                named = [(b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(bytes.fromhex(digest)))]
                if page is not None:
                    named.append((b"WARC-X-Page-ID", b"%d" % page))
                if refers is not None:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    out.append(_record([(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", origin), *same, (b"WARC-Profile", PROFILE), *named, (b"WARC-X-Refers-To-Page-ID", b"%d" % refers), (b"Content-Type", b"application/http; msgtype=response")], block))
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
                    head = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", origin), *same, *named, (b"Content-Type", b"application/http; msgtype=response")]
                    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
                    if len(parts) == 1:
                        out.append(_record(head, block))
                    else:
                        out.append(_record([*head, (b"WARC-Segment-Number", b"1")], parts[0]))
                        for k, piece in enumerate(parts[1:], 2):
                            last = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if k == len(parts) else []
                            out.append(_record([(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", origin[:-1] + b"-%d>" % k), *same, (b"WARC-Segment-Origin-ID", origin), (b"WARC-Segment-Number", b"%d" % k), *last], piece))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # A record ends with two empty lines; Spark's text writer sets them between records on any file system.
    lines = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def _parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """The records of an archive, gzipped as a whole or by record."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data
    data = b"".join(parts) if parts else data
    at = 0
    while at < len(data):
        if data[at : at + 2] == CRLF:
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError("a record doesn't start with WARC/")
        end = data.index(b"\r\n\r\n", at)
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in data[at:end].split(CRLF)[1:])}
        size = int(headers[b"content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a record is shorter than its Content-Length")
        yield headers, block
        at = end + 4 + size


SEGMENTS = "origin string, segment int, segments_end long, record_type string, page_id long, digest string, refers_to long, block binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each WARC record under path, continuation records included.

    segment is null for a record that is whole; segments_end is the total
    length that the last segment states.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows):
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            names = ["origin", "segment", "segments_end", "record_type", "page_id", "digest", "refers_to", "block"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        whole = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in _parse(content.as_py()):
                    digest = h.get(b"warc-payload-digest", b"").decode().rpartition(":")[2] or None
                    kind = h[b"warc-type"].decode()
                    origin = h.get(b"warc-segment-origin-id", h[b"warc-record-id"]).decode()
                    rows.append((origin, whole(h, b"warc-segment-number"), whole(h, b"warc-segment-total-length"), kind, whole(h, b"warc-x-page-id"), digest, whole(h, b"warc-x-refers-to-page-id"), block))
                    held += len(block)
                    if held > 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, SEGMENTS)


PAYLOADS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def reassemble(segments: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row for each origin record: its payload, decoded from all its segments.

    Continuation records are grouped by the origin they name and ordered by
    segment number.  intact tells whether the numbers run from 1 without gaps,
    the lengths sum to the stated total, the framing decodes and the payload
    has the stated digest; what isn't intact has null bytes and the stated
    digest.  A revisit has no payload; its length is the one its HTTP headers
    state.
    """
    whole = segments.filter(F.col("segment").isNull()).select("record_type", "page_id", "digest", "refers_to", F.array("block").alias("blocks"), F.lit(True).alias("complete"))
    pieces = segments.filter(F.col("segment").isNotNull()).groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"),
        F.max("segments_end").alias("total"),
        *[F.first(c, ignorenulls=True).alias(c) for c in ("page_id", "digest", "refers_to")],
        F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"),
    )
    length = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x["block"]))
    in_order = F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("s"))
    pieces = pieces.select("record_type", "page_id", "digest", "refers_to", F.transform("s", lambda x: x["block"]).alias("blocks"), (in_order & (length == F.col("total"))).alias("complete"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                kind, page, stated, refers, blocks, complete = (c[i].as_py() for c in columns)
                payload, n, digest = None, None, stated
                if complete and kind is not None:
                    head, _, body = b"".join(blocks).partition(b"\r\n\r\n")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(CRLF)[1:])}
                    if kind == "revisit":
                        n = int(fields.get(b"content-length", b"0"))
                    else:
                        try:
                            payload = unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                        except ValueError:
                            payload = None
                        if payload is not None:
                            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                good = n is not None and (stated is None or digest == stated)
                for column, value in zip(out, (page, n if good else None, digest if good else stated, kind, refers, good, payload if keep_payload else None), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "payload"]
            keep = 7 if keep_payload else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:keep], kinds, strict=False)], names[:keep])

    return whole.unionByName(pieces).mapInArrow(decode, PAYLOADS + (", payload binary" if keep_payload else ""))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages as WARC archives in the shared folder, read them back and reassemble."""
    path = folder(pages.sparkSession)
    write_warc(pages, path, **options)
    return reassemble(read_segments(pages.sparkSession, path), keep_payload=False)
