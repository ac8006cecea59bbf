"""WARC archives: one gzip member per record, written in tasks and read back as a stream.

Writing: payload digests are grouped first (partial sums, so a hot payload costs one row a task), then every page is
written as a ``response`` or, if its payload belongs to a larger page id, as a ``revisit`` without a body. Each task
writes archives of bounded size under names of their own and returns them as rows; the listing is a written table, so
archives of lost or repeated task attempts are never read.

Reading: archives are dealt out one by one; a task reads a block at a time, inflates member by member, takes the body
by its content length and checks block and payload digests. Memory is bounded by a block and a record.

Defined cases: a null html is an empty payload; null urls are left out; equal page ids with equal payloads are all
``response`` when theirs is the largest id; a null page id is smaller than any other; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import prepare, scratch, written

ARCHIVE_BYTES = 256 << 20
MIN_REVISIT_BYTES = 0
BLOCK = 1 << 18
LEVEL = 3
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"  # fixed, so that equal inputs give equal archives


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
           payload_digest: str) -> bytes:
    """One record: the WARC header, an HTTP response as its block, and the closing blank lines."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
            ("WARC-Date", _DATE), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{payload_digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%-._")))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES,
                   min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``; the listing (path, records, bytes)."""
    spark = pages.sparkSession
    prepare(spark)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    src = pages.select("page_id", "url", body.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    size = F.octet_length("payload")
    again = (src.where(size >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
             .where("n > 1").select("sha", "top"))
    rows = src.join(again, "sha", "left").select(
        "page_id", "url", "payload", "sha", "top",
        (F.col("top").isNotNull() & (size >= min_revisit_bytes) & ~F.col("top").eqNullSafe(F.col("page_id"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        sink, path, records, size = None, "", 0, 0

        def listed():
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]},
                                              schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for page_id, url, payload, sha, top, revisit in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(path, compression=None)
                data = member(record(page_id, url, payload, top, revisit, base64.b32encode(sha).decode()))
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    sink.close()
                    sink = None
                    yield listed()
        if sink is not None:
            sink.close()
            yield listed()

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-listing")


def members(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other; a cut-off or damaged member raises."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or read(BLOCK)
        rest = b""
        if not data:
            if parts or z.unconsumed_tail:
                raise ValueError("archive ends inside a member")
            return
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            rest, z, parts = z.unused_data, zlib.decompressobj(31), []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of a record; the block is framed by its content length and its digest is checked."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(head["content-length"])
    block = data[end + 4: end + 4 + n]
    if len(block) != n or data[end + 4 + n:] != b"\r\n\r\n":
        raise ValueError("content length does not frame the block")
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    return head, block


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value and value != "None" else None


def read_archives(spark: SparkSession, listing: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the listed archives: page_id, record_type, refers_to, url, payload_digest, payload_bytes (null for
    revisits), payload (null for revisits, and without ``with_payload``)."""
    prepare(spark)
    schema = ("page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, "
              "payload binary")
    arrow = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                       ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def rows(path: str):
        store, _ = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(path, compression=None) as f:
            for data in members(f.read):
                head, block = parse(data)
                payload = block[block.index(b"\r\n\r\n") + 4:]
                given = head["warc-payload-digest"].removeprefix("sha1:")
                revisit = head["warc-type"] == "revisit"
                if not revisit and digest(payload) != given:
                    raise ValueError("payload digest differs")
                yield (_page(head["warc-record-id"]), head["warc-type"], _page(head.get("warc-refers-to")),
                       head.get("warc-target-uri"), given, None if revisit else len(payload),
                       payload if with_payload and not revisit else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                out, size = [], 0
                for r in rows(path):
                    out.append(r)
                    size += len(r[-1] or b"")
                    if len(out) >= 1000 or size >= 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return listing.select("path").repartition(max(1, listing.count())).mapInArrow(run, schema)  # a task for each archive


def resolve(records: DataFrame) -> DataFrame:
    """Give revisits the payload length of the response they name (same digest, same page id)."""
    cut = written(records.drop("payload"), "warc-records")
    full = (cut.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d"), F.col("page_id").alias("p"))
            .agg(F.max("payload_bytes").alias("n")))
    return (cut.join(full, (cut.payload_digest == full.d) & (cut.refers_to == full.p), "left")
            .select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
                    "url"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return resolve(read_archives(spark, write_archives(pages, folder), folder, with_payload=False))
