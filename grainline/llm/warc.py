"""WARC archives with revisit records (operator 5).

Headers (digest, size, page_id, url) are shuffled by payload digest and joined to the smallest page_id of each payload; the
pages then meet their header, by digest and page_id, so that no payload is a hot task, and records with an equal payload become
revisit records that refer to the response. Tasks write gzip members, one a record behind a warcinfo record, to files of
their own in a shared folder, with record ids and dates of their own; a manifest table names the files of the tasks that
succeeded, so files of lost or repeated attempts are never read. Reading streams each file record by record and checks every
payload's digest.

Defined results: null html is an empty payload; a null url gives no target URI; of rows that repeat the smallest page_id of
a payload one is the response, the others revisit it (they meet in one task, in order); rows with a null page_id revisit the
smallest page_id of their payload and, where it has none, are responses each, as no record could name another; a text page_id may be empty; empty input writes no file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, new_dir

BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 1 << 29


def base32(hex40):
    """RFC 4648 base32 of 40 hex digits: five digits make four letters."""
    part = lambda k: F.translate(F.lpad(F.conv(F.substring(hex40, 5 * k + 1, 5), 16, 32), 4, "0"), DIGITS32, BASE32)
    return F.concat(*(part(k) for k in range(8)))


def resolve(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, first_id, first_url of each page, and revisit. Rows that repeat the smallest
    page_id of a payload are not told apart here: they follow each other in one partition, and `write` makes all but the first revisits."""
    html = F.coalesce("html", F.lit(""))
    named_id = F.coalesce(F.concat(F.lit("="), F.col("page_id").cast("string")), F.lit(""))  # a key without nulls: payloads are shuffled once
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("payload_bytes"), named_id.alias("_id"))
    digest, key = ["sha1", "payload_bytes"], ["sha1", "payload_bytes", "_id"]
    headers = rows.select(*key, "page_id", "url")
    firsts = cut(headers.groupBy(*digest).agg(F.min("page_id").alias("first_id"), F.min_by("url", F.struct("page_id", "url")).alias("first_url")), "firsts")
    named = headers.select(*key).distinct().join(firsts, digest)
    joined = rows.repartition(*key).join(named, key).sortWithinPartitions(*key, "url")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= min_payload)
    repeats = F.col("payload_bytes") >= min_payload
    return joined.select("page_id", "url", F.when(revisit, "").otherwise(F.col("payload")).alias("payload"), base32("sha1").alias("digest"), "payload_bytes", F.when(repeats, F.col("first_id")).alias("first_id"), F.when(repeats, F.col("first_url")).alias("first_url"), revisit.alias("revisit"))


def _name(page_id, digest: str) -> str:
    """The record id of a payload's response: by page and payload, so that revisits can name it from another task."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id!r} {digest}').urn}>"


def _uri(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url, payload: bytes, digest: str, size: int, first_id, first_url, revisit: bool, date: str, name: str | None = None) -> bytes:
    """A response or revisit record. The page_id and that of the response stand in headers of their own, for reading back."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name or _name(page_id, digest)}", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"Page-ID: {quote(str(page_id))}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(first_id, digest)}"]
        if first_id is not None:
            lines.append(f"Refers-To-Page-ID: {quote(str(first_id))}")
        if first_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(first_url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(file: str, date: str) -> bytes:
    """The warcinfo record at the head of a file."""
    block = b"format: WARC File Format 1.1\r\ndescription: deduplicated by payload digest\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid4().urn}>", f"WARC-Date: {date}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(data: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write(resolved: DataFrame, folder: str, date: str | None = None, level: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The manifest: file, records, bytes of each archive written under folder. date: the time of writing by default."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        out, name, records, size = None, "", 0, 0
        last = None  # the response written last: rows that repeat it come next

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page_id, url, payload, digest, n, first_id, first_url, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    head = _packed(info(name, date), level)
                    out.write(head)
                    size = len(head)
                own = (page_id, digest, n)
                again = not revisit and own == last and page_id == first_id and page_id is not None
                if not revisit:
                    last = own
                data = _packed(record(page_id, url, payload.encode(), digest, n, first_id, first_url, revisit or again, date, f"<{uuid.uuid4().urn}>" if revisit or again else None), level)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return cut(resolved.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            headers[k.lower()] = v.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read(manifest: DataFrame) -> DataFrame:
    """page_id (as text), payload_bytes, payload_digest, record_type, refers_to (as text), url of every record."""
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = open_fs(file)
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as raw, gzip.open(raw) as plain:
                    for headers, block in parse(io.BufferedReader(plain, 1 << 20)):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"damaged record {headers['warc-record-id']}")
                        ids = [unquote(headers[k]) if k in headers else None for k in ("page-id", "refers-to-page-id")]
                        rows.append((ids[0], size, digest, kind, ids[1], headers.get("warc-target-uri")))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.select("file").repartition(files, "file").mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")


def archive(spark: SparkSession, pages: DataFrame, min_payload: int = 0, **options) -> DataFrame:
    """Write the pages' records to a new folder of archives and read them back, with page_id's own type."""
    kind = pages.schema["page_id"].dataType
    back = read(write(resolve(pages, min_payload), new_dir(spark, "warc"), **options))
    return back.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
