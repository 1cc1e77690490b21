"""WARC archives: a writer with revisit records and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.llm.common import read_table, save, text_bytes
from jobatlas.llm.shared_files import new_folder, open_output, open_stream

#: Compressed bytes after which a task begins another archive, and bytes read at once.
ARCHIVE_BYTES, CHUNK = 256 << 20, 1 << 20
#: Fixed values of the format.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head of its response, with the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, body, refers_to, revisit): of equal payloads of ``least_bytes`` or more, the smallest id responds.

    Rows that repeat that id respond as well; a null id never responds for others unless all ids of a payload are null.
    """
    rows = pages.select("page_id", "url", text_bytes("html").alias("body")).withColumn("key", F.sha2("body", 256))
    first = rows.where(F.length("body") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"))
    met = rows.join(first, "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select("page_id", "url", "body", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html, ...) as .warc.gz files below the shared folder: (archive, records, bytes)."""
    folder = new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, size, n = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    uri, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_output(uri)
                member = record(*row)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return save(mark_revisits(pages, least_bytes).mapInArrow(run, "archive string, records long, bytes long"))


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, read in order: one gzip member each, framed by its length."""
    raw = b""
    while True:
        unpack, plain = zlib.decompressobj(31), []
        while not unpack.eof:
            if not raw:
                raw = stream.read(CHUNK)
                if not raw:
                    if plain:
                        raise ValueError("archive ends within a record")
                    return
            plain.append(unpack.decompress(raw))
            raw = unpack.unused_data
        data = b"".join(plain)
        head, mark, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.get("content-length", -1))
        if not first.startswith("WARC/") or not mark or size < 0 or rest[size:] != b"\r\n\r\n":
            raise ValueError("record without proper framing")
        yield headers, rest[:size]


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, digest_ok, payload) of every record.

    ``digest_ok``: the block has its digest, and a response's payload its own.  A revisit has no payload; its figures
    are those of the full payload, from its headers.
    """

    def bare(x: str) -> str | None:
        return x.removeprefix("<urn:page:").removesuffix(">") or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "digest_ok", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_stream(uri) as stream:
                    for headers, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        good = headers["warc-block-digest"] == f"sha1:{payload_digest(block)}"
                        if kind == "response":
                            good = good and payload_digest(payload) == digest and len(payload) == size
                        page, first = bare(headers["warc-record-id"]), bare(headers.get("warc-refers-to", ""))
                        rows.append((
                            None if page is None else int(page), headers["warc-target-uri"], kind, size, digest,
                            None if first is None else int(first), good, payload if kind == "response" else None,
                        ))
                        held += len(payload)
                        if held >= 8 * CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean, payload binary"
    return archives.select("archive").mapInArrow(run, schema)


def op8_warc(spark, sf_dir) -> DataFrame:
    """The contract query over all pages; a record whose digest fails has no digest in the result."""
    got = read_archives(write_archives(read_table(spark, sf_dir, "pages")))
    return got.select("page_id", "payload_bytes", F.when(F.col("digest_ok"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS f, sha1(encode(h)) AS x FROM p
), v AS (
  SELECT *, [CAST('0x' || substr(x, 5 * g + 1, 5) AS INTEGER) FOR g IN range(8)] AS five FROM r
)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1, 1) FOR j IN range(32)], '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM f OR f IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM v
"""
