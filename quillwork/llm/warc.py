"""WARC archives with a two-level capture index.

Writing: every page becomes a WARC record, compressed as a gzip member of its own;
members are packed into archives of about ``archive_bytes``.  A row of text is
what Spark's text sink writes byte for byte, so an archive is one row and one
file, in any file system Spark can write to.  The sink ends a file with a line
separator; a zero byte serves, which is what an empty gzip member ends with, so
each archive is closed by such a member.

Indexing: archives are read back and each record's place becomes a capture.
Captures are sorted by key (the URL with its host reversed, then time and record)
and packed into compressed blocks; a sparse directory holds each block's first
key.  Finding a URL takes a binary search in the directory, the decoding of the
blocks it names, and range reads of the records' bytes alone.

Of pages with equal payloads the one with the largest id is stored as a response
and the others as revisits that refer to it; payloads below ``revisit_bytes`` are
always stored.  A repeated row of that largest id is a response too.  Null
payloads are empty, null URLs have an empty key.  Pages without an id only refer
to others.  No pages make no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.plans.materialize import broadcast_if_small, fresh_path, materialize

ARCHIVE_BYTES, BLOCK_LINES, REVISIT_BYTES = 16 << 20, 3000, 0
TIME = "2024-01-01T00:00:00Z"
CLOSING = gzip.compress(b"", mtime=0)
_SPLIT = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^#]*)")


def url_key(url: str | None) -> str:
    """Reversed-host key: com,example)/path?query, lower-case host, no port of the scheme, no leading www."""
    scheme, host, rest = _SPLIT.match((url or "").strip()).groups()
    host = (host or "").rpartition("@")[2].lower()
    host, _, port = host.partition(":")
    host = host.removeprefix("www.").rstrip(".")
    if port in ("", {"http": "80", "https": "443"}.get((scheme or "").lower(), "")):
        port = ""
    parts = ",".join(reversed(host.split("."))) if host else ""
    return f"{parts}{':' + port if port else ''}){rest if rest.startswith('/') else '/' + rest}".replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """The bytes of one record, uncompressed.

    A revisit has no payload, but its digest; the payload's length stands in a
    header of our own.
    """
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    sha = digest(payload)
    name = "none" if page_id is None else page_id
    body = payload if kind == "response" else b""
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    block = "\r\n".join(head).encode() + body
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {TIME}",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; checks the lengths and, for responses, the digest of the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if digest(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    payload = block.partition(b"\r\n\r\n")[2]
    name = lambda x: None if x is None or x == "<urn:page:none>" else int(x[len("<urn:page:") : -1])
    kind = fields["WARC-Type"]
    length = int(fields["X-Payload-Length"])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != sha):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": name(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": sha,
        "record_type": kind, "refers_to": name(fields.get("WARC-Refers-To")), "payload": payload,
    }


def classify(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds refers_to: for revisits the page that holds the payload, else null."""
    sha, size = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.coalesce(F.octet_length("html"), F.lit(0))
    hashed = pages.select("page_id", "url", "html", sha.alias("_sha"), size.alias("_size"))
    shared = hashed.groupBy("_sha", "_size").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n"))
    shared = shared.filter((F.col("_n") > 1) & (F.col("_size") >= revisit_bytes) & F.col("_keeper").isNotNull()).drop("_n")
    # Payloads that several pages share, counted before they are broadcast.
    shared = broadcast_if_small(materialize(shared, "warc-shared"))
    joined = hashed.join(shared, ["_sha", "_size"], "left")
    revisit = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("_keeper")).alias("refers_to"))


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives of pages(page_id, url, html) below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for page in batch.to_pylist():
                payload = (page["html"] or "").encode("utf-8", "surrogatepass")
                kind = "response" if page["refers_to"] is None else "revisit"
                parts.append(gzip.compress(record(page["page_id"], page["url"], payload, kind, page["refers_to"]), 4, mtime=0))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, CLOSING[:-1]])], pa.binary())], names=["archive"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, CLOSING[:-1]])], pa.binary())], names=["archive"])

    archives = classify(pages, revisit_bytes).mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\u0000").option("maxRecordsPerFile", 1).text(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, uncompressed bytes) of each gzip member that isn't empty."""
    at = 0
    while at < len(data):
        reader = zlib.decompressobj(wbits=31)
        raw = reader.decompress(data[at : at + (1 << 16)])
        end = at + (1 << 16)
        chunks = [raw]
        while not reader.eof:
            if end >= len(data):
                raise ValueError("archive ends inside a record")
            chunks.append(reader.decompress(data[end : end + (1 << 20)]))
            end += 1 << 20
        length = min(end, len(data)) - at - len(reader.unused_data)
        if raw := b"".join(chunks):
            yield at, length, raw
        at += length


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(key, time, page_id, file, offset, length, record_type) of each record in the archives below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for offset, length, raw in members(row["content"]):
                    head = dict(line.split(": ", 1) for line in raw.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
                    out.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], row["file"], offset, length, head["WARC-Type"]))
                if out:
                    names = ["key", "time", "file", "offset", "length", "record_type"]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    return archives(spark, path).mapInArrow(run, "key string, time string, file string, offset bigint, length bigint, record_type string")


def build_index(found: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Blocks (first_key, last_key, lines, block): sorted captures, `block_lines` at most in each, compressed.

    Blocks never hold a key range that another block of another partition holds,
    except for keys so frequent that they fill several.
    """
    order = ["key", "time", "file", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []

        def block(some: list[str]) -> pa.RecordBatch:
            packed = zlib.compress("\n".join(some).encode(), 6)
            keys = [some[0].split(" ", 1)[0], some[-1].split(" ", 1)[0]]
            return pa.RecordBatch.from_arrays([pa.array([keys[0]]), pa.array([keys[1]]), pa.array([len(some)], pa.int32()), pa.array([packed], pa.binary())], names=["first_key", "last_key", "lines", "block"])

        for batch in batches:
            for c in batch.to_pylist():
                lines.append(f"{c['key']} {c['time']} {c['offset']} {c['length']} {c['record_type']} {c['file']}")
                if len(lines) == block_lines:
                    yield block(lines)
                    lines = []
        if lines:
            yield block(lines)

    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "first_key string, last_key string, lines int, block binary")


def unpack(block: bytes) -> list[tuple[str, str, int, int, str, str]]:
    out = []
    for line in zlib.decompress(block).decode().split("\n"):
        key, time, offset, length, kind, file = line.split(" ", 5)
        out.append((key, time, int(offset), int(length), kind, file))
    return out


class Directory:
    """First keys of the blocks, in order; sparse, one entry for each block."""

    def __init__(self, blocks: DataFrame) -> None:
        self.blocks = blocks
        rows = sorted((r[0], r[1]) for r in blocks.select("first_key", "last_key").collect())
        self.first, self.last = [r[0] for r in rows], [r[1] for r in rows]

    def names(self, key: str) -> list[str]:
        """First keys of the blocks that may hold key, by binary search."""
        lo = max(bisect_left(self.first, key) - 1, 0)
        hi = bisect_right(self.first, key)
        return [self.first[i] for i in range(lo, hi) if self.first[i] <= key <= self.last[i]]


def range_read(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Just these bytes of a file, through Hadoop's file systems."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
    try:
        stream.seek(offset)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def find(spark: SparkSession, directory: Directory, url: str) -> list[dict]:
    """The records of a URL: directory search, blocks it names, range reads."""
    key = url_key(url)
    blocks = directory.blocks.filter(F.col("first_key").isin(directory.names(key))).select("block").collect()
    places = [c for b in blocks for c in unpack(bytes(b[0])) if c[0] == key]
    return [parse(gzip.decompress(range_read(spark, c[5], c[2], c[3]))) for c in sorted(places, key=lambda c: c[1:])]


RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_all(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """Every record that the index lists, read at its place: file by file, its entries in the order of offsets."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("block").to_pylist():
                lines = unpack(packed)
                yield pa.RecordBatch.from_arrays([pa.array([c[5] for c in lines]), pa.array([c[2] for c in lines]), pa.array([c[3] for c in lines])], names=["file", "offset", "length"])

    def read(key: tuple, files: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(places):
            data = memoryview(files["content"].iloc[0])
            for offset, length in sorted(zip(places["offset"], places["length"], strict=True)):
                found = parse(gzip.decompress(data[offset : offset + length]))
                out.append([found[n] for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")])
        frame = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    listed = blocks.select("block").mapInArrow(entries, "file string, offset bigint, length bigint")
    return archives(spark, path).groupBy("file").cogroup(listed.groupBy("file")).applyInPandas(read, RECORD)


def round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes archives and their index to the shared folder, and reads every record back through the index."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, revisit_bytes=revisit_bytes)
    blocks = materialize(build_index(captures(spark, path)), "warc-index")
    return read_all(spark, path, blocks)
