"""WARC archives: a writer with segments, and a reader that reassembles them.

Writer: each executor task writes its records to gzip archives (a member per record) of about
``archive_bytes`` through the file system that the target folder names; a file appears under its
final name, which holds the task's attempt, only when it is whole. The names that successful tasks return
are written as a table beside the archives, which Spark commits once a task; a repeated, failed or late
attempt may leave files, but none that this table names. A payload is an
HTTP message in chunked transfer framing; a block longer than ``segment_bytes`` is cut into a first
segment and continuation records. Of equal payloads of at least ``REVISIT_BYTES`` the one with the
smallest id is a response, the others are revisits that name it and carry no payload.

Reader: the archives that the table names (all of a folder without one) are read as binary files and
parsed record by record. Records in one piece go straight on; segments are grouped by the record where they begin (its id), ordered by segment
number, joined, and held against the total length that the last segment states; then the chunked
framing is decoded. A missing or short segment fails the read rather than giving part of a payload.

Defined results: null html is an empty payload, null urls are written as empty; repeated rows (one id)
are written and read as separate records, and all rows of the smallest id are responses; a null id
comes back null and is never referred to; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut

#: Equal payloads shorter than this are all responses.
REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Table of the archives that successful tasks wrote; file sources pass over names that begin so.
WRITTEN = "_written"
_DATE = "2024-01-01T00:00:00Z"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    first = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(first, "payload_digest", "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "payload_digest", F.when(~other, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(other, F.col("first_id")).alias("refers_to"))


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _head(headers: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode()


def records(page_id, url, digest, payload, payload_bytes, refers_to, name: str, segment_bytes: int) -> Iterator[bytes]:
    """The WARC records of one page: one, or a first segment and its continuations."""
    origin = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    base = [("WARC-Date", _DATE), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", payload_bytes), ("X-Page-Id", "" if page_id is None else page_id)]
    if payload is None:
        headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *base, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", refers_to)]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
        yield _head([*headers, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, part in enumerate(cuts):
        headers = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{k}')}>" if k else origin)]
        headers += [("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", origin)] if k else base
        if len(cuts) > 1:
            headers.append(("WARC-Segment-Number", k + 1))
            if k == len(cuts) - 1:
                headers.append(("WARC-Segment-Total-Length", len(block)))
        yield _head([*headers, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(part))]) + part + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part, attempt = context.partitionId(), context.taskAttemptId()
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    number, held, size, row, wrote = 0, [], 0, 0, []

    def flush():
        nonlocal number, held, size
        if held:
            own, final = f"{root}/_{part:06d}-{number:05d}-{attempt}.tmp", f"{root}/{part:06d}-{number:05d}-{attempt}.warc.gz"
            with files.open_output_stream(own, compression=None) as out:
                out.write(b"".join(held))
            files.move(own, final)
            wrote.append(final.rpartition("/")[2])
            number, held, size = number + 1, [], 0

    for batch in batches:
        for r in zip(*[batch.column(c) for c in ("page_id", "url", "payload_digest", "payload", "payload_bytes", "refers_to")], strict=True):
            for record in records(*[x.as_py() for x in r], f"{part}/{row}", segment_bytes):
                member = gzip.compress(record, 6, mtime=0)
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    flush()
            row += 1
    flush()
    yield pa.RecordBatch.from_pydict({"archive": pa.array(wrote, pa.string())})


def write_archives(marked: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> int:
    """Write the rows of ``mark_revisits`` as archives below ``folder``; how many there are."""
    made = marked.mapInArrow(lambda it: _write(it, folder, archive_bytes, segment_bytes), "archive string")
    return cut(made, f"{folder.rstrip('/')}/{WRITTEN}").count()


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's block is not as long as its header says")
    return headers, rest[:size]


RECORDS = "kind string, record_id string, origin_id string, segment int, total_length long, url string, payload_digest string, payload_bytes long, page_id long, refers_to long, block binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("block", pa.binary())])
    whole = lambda x: int(x) if x else None
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            view = memoryview(content.as_buffer())
            for member in members(view):
                h, block = _parse(member)
                rows.append({
                    "kind": h["warc-type"], "record_id": h["warc-record-id"], "origin_id": h.get("warc-segment-origin-id", h["warc-record-id"]), "segment": whole(h.get("warc-segment-number")),
                    "total_length": whole(h.get("warc-segment-total-length")), "url": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None, "payload_bytes": whole(h.get("x-payload-length")),
                    "page_id": whole(h.get("x-page-id")), "refers_to": whole(h.get("x-refers-to-page")), "block": block,
                })
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def members(data: memoryview, step: int = 64 << 10) -> Iterator[bytes]:
    """The gzip members of an archive, without copying what is still to come."""
    at = 0
    while at < len(data):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            piece = data[at : at + step]
            if not len(piece):
                raise ValueError("an archive ends inside a record")
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def _whole(parts: list[dict], total: int | None) -> bytes:
    """The block of one record, from its segments in order."""
    block = b"".join(x["block"] for x in parts)
    if total is None and parts[0]["segment"] is None:
        return block
    if len(block) != total or [x["segment"] for x in parts] != [*range(1, len(parts) + 1)]:
        raise ValueError("segments are missing or do not add up to the stated length")
    return block


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for kind, parts, total, digest, size in zip(*[batch.column(c) for c in ("kind", "parts", "total_length", "payload_digest", "payload_bytes")], strict=True):
            if kind.as_py() == "revisit":
                out.append(None)
                continue
            head, _, body = _whole(parts.as_py(), total.as_py()).partition(b"\r\n\r\n")
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            if len(payload) != size.as_py() or hashlib.sha256(payload).hexdigest() != digest.as_py():
                raise ValueError("a payload is not what its record says")
            out.append(payload)
        keep = [batch.column(c) for c in ("page_id", "url", "payload_bytes", "payload_digest", "kind", "refers_to")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.binary())], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


PAYLOADS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _named(spark: SparkSession, folder: str) -> list[str] | None:
    """Paths of the archives that the table of ``folder`` names; None without such a table."""
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{WRITTEN}")
    if not table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(table):
        return None
    return [f"{folder}/{r.archive}" for r in spark.read.schema("archive string").parquet(f"{folder}/{WRITTEN}").collect()]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page: what its records hold, segments joined and chunks decoded.

    The driver holds the archives' paths, as it does for any file source.
    """
    folder = folder.rstrip("/")
    paths = _named(spark, folder)
    if paths == []:
        return spark.createDataFrame([], PAYLOADS)
    source = spark.read.format("binaryFile")
    files = source.option("pathGlobFilter", "*.warc.gz").load(folder) if paths is None else source.load(paths)
    found = files.select("content").mapInArrow(_read, RECORDS)
    part = F.struct("segment", "block")
    names = ["kind", "url", "payload_digest", "payload_bytes", "page_id", "refers_to", "total_length", "parts"]
    one = found.filter("segment IS NULL").withColumn("parts", F.array(part)).select(*names)
    cuts = found.filter("segment IS NOT NULL").groupBy("origin_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.lit("response").alias("kind"),
        *[F.max(c).alias(c) for c in ("total_length", "url", "payload_digest", "payload_bytes", "page_id", "refers_to")],
    ).select(*names)
    return one.unionByName(cuts).mapInArrow(_decode, PAYLOADS)
