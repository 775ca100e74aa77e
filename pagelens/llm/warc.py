"""WARC archives with revisit records.

Headers (page, digest and address; no payload) are shuffled by digest to find, of equal
payloads of at least `least` bytes, the page with the smallest id. That one is written as a
response; the others are written as revisit records that refer to it and carry no payload. What
was found for a revisit goes back to its page by page_id and digest, so payloads move at most
once and never to the task of a digest that many pages share.
Archives are gzip files with one member a record, written by the tasks to the shared folder
under names of their own, with headers made anew and the date of the run; only files that the
manifest lists, a table that Spark commits, are read, so a task that runs again leaves nothing
that counts. When read, revisit records are joined to their responses to get length and digest
of the full payload back.

Cases: a null html is the empty payload; payloads below `least` bytes are all responses. Rows
that repeat a page_id become records of their own; among equal payloads the smallest page_id
is the response and a row with that same id and payload too. A null page_id is written and
read as null, and never becomes the original of others unless no id is known, when all such
rows are responses. A null url is written as an empty target. An empty table gives an empty
archive and result; other columns are not read. Payloads of any length are written and read as
streams of one record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import new_folder, stored, table
from pagelens.llm.words import blocks

LEAST, LEVEL, FILE_BYTES = 100, 1, 64 << 20
SPACE = uuid.UUID("8d5a2e1c-6c0f-4f0f-9a57-1f6f3f0c7d11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def _target(url: str | None) -> str:
    """The url with control characters and blanks escaped: a header is one line."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def record(kind: str, date: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", date), *headers, ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + body + b"\r\n\r\n"


def page_record(date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, original_url: str | None) -> bytes:
    """A response, or a revisit of `original` where that is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Target-URI", _target(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if original is None:
        return record("response", date, [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(http + payload).hexdigest()}")], http + payload)
    refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, digest)), ("WARC-Refers-To-Target-URI", _target(original_url)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", str(original))]
    return record("revisit", date, headers + refers, http)


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, and original and original_url of revisits."""
    spark = pages.sparkSession
    whole = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    whole = whole.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    headers = whole.where(F.octet_length("payload") >= least).select("page_id", "url", "digest")
    first = headers.groupBy("digest").agg(F.min("page_id").alias("original"), F.min_by("url", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("original_url"), F.count("*").alias("copies"))
    # only digests that occur again take part; stored, so that a join can split the pages of one digest
    first = stored(spark, first.where("copies > 1 AND original is not null").drop("copies"), "originals")
    again = headers.select("page_id", "digest").join(first, "digest").where("NOT page_id <=> original").distinct()
    again = stored(spark, again, "revisits").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "original", "original_url")
    return whole.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "payload", "digest", "original", "original_url")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_archives(resolved: DataFrame, folder: str) -> DataFrame:
    """Writes *.warc.gz to the folder; the manifest (path, records, bytes) of what was written, as a stored table."""

    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, path, records, size, done = None, "", 0, 0, []
        for batch in blocks(batches, "payload"):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, records = store.open_output_stream(path, compression=None), 0
                    head = gzip.compress(record("warcinfo", date, [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"software: pagelens\r\nformat: WARC File Format 1.1\r\n"), LEVEL, mtime=0)
                    out.write(head)
                    size = len(head)
                page_id, url, payload, digest, original, original_url = row
                member = gzip.compress(page_record(date, page_id, url, payload.encode(), digest, original, original_url), LEVEL, mtime=0)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((path, records, size))
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(list, zip(*done, strict=True))], ["path", "records", "bytes"])

    columns = resolved.select("page_id", "url", "payload", "digest", "original", "original_url")
    return stored(resolved.sparkSession, columns.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def members(stream: io.RawIOBase, size: int = 1 << 20) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one after another."""
    inflate, parts, left = zlib.decompressobj(31), [], b""
    while True:
        chunk = left or stream.read(size)
        left = b""
        if not chunk:
            break
        parts.append(inflate.decompress(chunk))
        if inflate.eof:
            yield b"".join(parts)
            left, parts, inflate = inflate.unused_data, [], zlib.decompressobj(31)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        headers[k.decode().strip().lower()] = v.decode().strip()
    return headers, rest[: int(headers["content-length"])]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the manifest's archives: page_id, record_type, refers_to, record_id, payload_bytes and payload_digest
    (of responses: taken from the payload as read, which has to agree with its header)."""
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in members(stream):
                        h, block = parse(raw)
                        if h["warc-type"] == "warcinfo":
                            continue
                        page = int(h["x-page-id"]) if h["x-page-id"] else None
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        if h["warc-type"] == "revisit":
                            rows.append((page, "revisit", int(h["x-refers-to-page"]), None, digest))
                        else:
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: a payload differs from its digest")
                            rows.append((page, "response", None, len(payload), digest))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    spread = max(1, min(10_000, manifest.count()))
    return manifest.select("path").repartition(spread).mapInArrow(run, schema)


def expand_revisits(records: DataFrame) -> DataFrame:
    """Records with the length of the full payload, which revisits take from the response that they refer to."""
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("r_id"), F.col("payload_digest").alias("r_digest")).distinct()
    full = records.where("record_type = 'response'").join(wanted, (F.col("page_id") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left_semi")
    full = full.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    full = stored(records.sparkSession, full, "full")
    out = records.join(full, ["refers_to", "payload_digest"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "warc")
    manifest = write_archives(resolve(pages), folder)
    records = stored(spark, read_archives(manifest, folder), "records")
    return expand_revisits(records)


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
