"""Web archives (WARC 1.1, one gzip member a record) written from pages and read back as a chunked record table.

``write_warc`` writes one record per page: ``response`` with the html as payload, or, where an equal payload
of at least ``min_revisit_bytes`` has a smaller page_id, ``revisit`` with HTTP headers only, referring to that
page's record. ``read_chunks`` streams the archives back: every payload becomes rows (record, chunk number)
of at most ``chunk_bytes``, each with the digest of the payload up to its end, so that neither side ever
holds a second copy of a payload; the row marked ``last`` has the full length and digest.

Cases: null html = empty payload (its record has one chunk of 0 bytes); a null url leaves the target header
out; line breaks in a url become spaces; a null page_id is kept: its record never is a response that others
refer to unless no equal payload has an id (all are then responses); rows repeated with the smallest page_id
of their payload are all responses; an empty table gives no archives and no rows; other columns are not read.

Plan: digests are taken by Spark (sha1), the smallest page_id per (digest, length) is a partial aggregate, and
only payloads that occur twice or more join back; a payload that a third of all pages share is a skewed join
side that adaptive execution splits. The tasks after the join write the archives; the manifest (one row per
archive) is written by Spark, so archives of lost attempts are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import open_fs, shared_folder, slices, value_views

MANIFEST = "path string, records bigint"
CHUNKS = ("page_id bigint, chunk_no int, offset bigint, chunk_bytes bigint, digest_so_far string, last boolean, "
          "record_type string, refers_to bigint, payload_bytes bigint, header_digest string, data binary")
DATE = "1970-01-01T00:00:00Z"               # records carry no capture time: runs give the same bytes


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    tail = record.strip().rstrip(">").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def pieces(payload: memoryview, size: int) -> Iterator[memoryview]:
    for a in range(0, len(payload), size):
        yield payload[a:a + size]


def put_record(out, page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None,
               revisit: bool, chunk_bytes: int) -> int:
    """Append one record as a gzip member, payload piece by piece; the bytes written."""
    sha = hashlib.sha1()
    for p in pieces(payload, chunk_bytes):
        sha.update(p)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " "))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32(sha.digest())}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (0 if revisit else len(payload))}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    n = out.write(z.compress(("\r\n".join(lines) + "\r\n\r\n").encode() + http)) or 0
    if not revisit:
        for p in pieces(payload, chunk_bytes):
            n += out.write(z.compress(p)) or 0
    return n + (out.write(z.compress(b"\r\n\r\n") + z.flush()) or 0)


def get_headers(stream: io.BufferedReader) -> dict[str, str]:
    """Header lines up to the empty line; the first line under the empty name."""
    out = {"": stream.readline().decode().strip()}
    for line in iter(stream.readline, b"\r\n"):
        if not line:
            break
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def get_chunks(stream: io.BufferedReader, chunk_bytes: int, with_data: bool) -> Iterator[dict]:
    """Chunk rows of all records of one archive, in order; checks every payload against its header's digest."""
    while stream.peek(1):
        warc = get_headers(stream)
        if warc[""] != "WARC/1.1":
            raise ValueError(f"not a record: {warc['']!r}")
        http = get_headers(stream)
        revisit = warc["warc-type"] == "revisit"
        total = int(http["content-length"])
        row = {"page_id": page_of(warc["warc-record-id"]), "record_type": warc["warc-type"],
               "refers_to": page_of(warc["warc-refers-to"]) if revisit else None, "payload_bytes": total,
               "header_digest": warc["warc-payload-digest"].partition(":")[2]}
        sha, at, no = hashlib.sha1(), 0, 0
        left = 0 if revisit else total
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise ValueError("archive ends inside a record")
            sha.update(data)
            left -= len(data)
            so_far = None if revisit else base32(sha.digest())
            if not left and not revisit and so_far != row["header_digest"]:
                raise ValueError(f"payload digest of page {row['page_id']} differs from its header")
            yield row | {"chunk_no": no, "offset": at, "chunk_bytes": len(data), "digest_so_far": so_far,
                         "last": not left, "data": data if with_data else None}
            at, no = at + len(data), no + 1
            if not left:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")


def decisions(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to and revisit."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha1(html.cast("binary")).alias("_digest"),
                        F.octet_length(html).alias("_bytes"))
    first = (rows.where(F.col("_bytes") >= min_revisit_bytes).groupBy("_digest", "_bytes")
                 .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (rows.join(first, ["_digest", "_bytes"], "left")
                .select("page_id", "url", "html", F.when(revisit, F.col("_first")).alias("refers_to"),
                        revisit.alias("revisit")))


def _writer(folder: str, archive_bytes: int, chunk_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, records, files = None, "", 0, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

        for b in slices(batches, "html"):
            narrow = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit")))
            for (page_id, url, refers_to, revisit), payload in zip(narrow, value_views(b.column("html"))):
                if out is None:
                    path = f"{root}/{part:06d}-{files:06d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, size, records, files = fs.open_output_stream(path, compression=None), 0, 0, files + 1
                size += put_record(out, page_id, url, payload, refers_to, revisit, chunk_bytes)
                records += 1
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()
    return write


def write_warc(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = 64 << 20,
               chunk_bytes: int = 1 << 20, folder: str | None = None) -> DataFrame:
    """Write every page as a WARC record; the manifest of archives: path, records, folder."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    made = decisions(pages, min_revisit_bytes).mapInArrow(_writer(folder, archive_bytes, chunk_bytes), MANIFEST)
    return materialize(made, spark, "warc-manifest").withColumn("folder", F.lit(folder))


def _reader(chunk_bytes: int, with_data: bool):
    types = {"page_id": pa.int64(), "chunk_no": pa.int32(), "offset": pa.int64(), "chunk_bytes": pa.int64(),
             "digest_so_far": pa.string(), "last": pa.bool_(), "record_type": pa.string(), "refers_to": pa.int64(),
             "payload_bytes": pa.int64(), "header_digest": pa.string(), "data": pa.binary()}
    schema = pa.schema(list(types.items()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, _ = open_fs(r["folder"])
                with fs.open_input_stream(r["path"], compression=None, buffer_size=1 << 18) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18)
                    rows, held = [], 0
                    for row in get_chunks(stream, chunk_bytes, with_data):
                        rows.append(row)
                        held += row["chunk_bytes"] if with_data else 0
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)
    return read


def read_chunks(manifest: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives of a manifest; ``data`` is null unless ``with_data``."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "path").mapInArrow(_reader(chunk_bytes, with_data), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from the chunk that ends it: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those of the bytes read; a revisit has no payload, its headers say them."""
    own = F.col("record_type") == "response"
    return chunks.where("last").select(
        "page_id", F.when(own, F.col("offset") + F.col("chunk_bytes")).otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type", "refers_to")
