"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole WARC
records, and a skippable frame at its end with the seek table (compressed and
decompressed size of each frame). The index maps a record to its bundle, its
frame and its offset within the decompressed frame, so that one record is read
by decompressing one frame.

Tasks write bundles straight to the shared folder under names of their own.
The index, which Spark commits, lists the bundles of successful attempts;
others are swept away.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm.common import attach, materialize, scratch

#: Decompressed bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES = 128 << 10
BUNDLE_BYTES = 64 << 20
#: Payloads of so many bytes or more are written once and revisited by their equals.
MIN_REVISIT = 0
#: Fixed values of the seekable format and of the archive format.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3


def located(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI."""
    if uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (arrow_fs.LocalFileSystem(), uri) if "://" not in uri else arrow_fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark's default file system gives it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


class BundleWriter:
    """Writes records to one bundle."""

    def __init__(self, uri: str) -> None:
        self.uri, self.frames, self.size, self.pending = uri, [], 0, bytearray()
        system, path = located(uri)
        self.out = system.open_output_stream(path, compression=None)  # the name would choose one
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.pending and len(self.pending) + len(record) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), len(self.pending)
        self.pending += record
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.compressor.compress(bytes(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.pending)))
            self.size += len(packed)
            self.pending = bytearray()

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC))
        self.out.close()


class BundleReader:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, uri: str) -> None:
        system, path = located(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def _name(record_id: int | None) -> str:
    return f"<urn:record:{'none' if record_id is None else record_id}>"


def encode(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(record_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record that starts at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no record starts here")
    fields = dict(line.split(": ", 1) for line in lines)
    end = stop + 4 + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, data[stop + 4 : end], end + 4


def _number(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:record:").removesuffix(">")
    return int(text) if text not in ("", "none") else None


def describe(fields: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(record_id, payload_bytes, payload_digest, record_type, refers_to, payload) with the payload's digest checked."""
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(http.split(b"Content-Length: ")[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return _number(fields["WARC-Record-ID"]), size, digest, kind, _number(fields.get("WARC-Refers-To")), payload if kind == "response" else None


def roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Pages with digest (hexadecimal) and top: the largest id of equal payloads, null if the page has no equal."""
    plain = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    plain = plain.withColumn("digest", F.sha1("payload"))
    large = plain.where(F.octet_length("payload") >= MIN_REVISIT)
    equal = large.groupBy("digest").agg(F.max("record_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    equal = materialize(equal, "equal")
    return attach(plain, equal, "digest", "n", "left").drop("n")


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page to bundles under out; the index (record_id, bundle, frame, offset, length).

    The payload is the text in UTF-8, empty for null. Of equal payloads of at
    least MIN_REVISIT bytes the page with the largest id is a response and the
    others revisit it; a page whose id is null revisits the largest id, or is
    a response if there is none. Rows that repeat the largest id are all
    responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    base = qualified(spark, out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: BundleWriter | None = None
        system, path = located(base)
        system.create_dir(path, recursive=True)
        for batch in batches:
            found = []
            for record_id, url, payload, digest, top in zip(*[batch.column(c).to_pylist() for c in (0, 1)], batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if writer is None:
                    writer = BundleWriter(f"{base}/{uuid.uuid4().hex}.warc.zst")
                revisit = top is not None and record_id != top
                record = encode(record_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), top if revisit else None, revisit, date)
                found.append((record_id, writer.uri, *writer.add(record), len(record)))
                if writer.size >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            columns = list(zip(*found)) if found else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["record_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    rows = roles(pages, id_col, url_col, payload_col).select("record_id", "url", "payload", "digest", "top")
    return materialize(rows.mapInArrow(run, "record_id long, bundle string, frame int, offset long, length long"), "warc-index")


def bundles(index: DataFrame) -> DataFrame:
    """One row (bundle, frames) per bundle of an index, dealt to a task each."""
    found = index.groupBy("bundle").agg(F.count("*").alias("records"))
    return found.repartition(max(1, min(found.count(), 20_000)), "bundle")


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the bundles, read frame by frame from the files alone.

    Rows (record_id, payload_bytes, payload_digest, record_type, refers_to,
    payload); the payload is null for revisits, and for all unless asked for.
    A damaged record raises an error.
    """
    names = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                reader = BundleReader(uri)
                for k in range(len(reader.frames)):
                    data, at, found = reader.frame(k), 0, []
                    while at < len(data):
                        fields, block, at = decode(data, at)
                        row = describe(fields, block)
                        found.append(row if payloads else (*row[:5], None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
                reader.close()

    return bundles(index).select("bundle").mapInArrow(run, "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read_record(uri: str, frame: int, offset: int) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """One record by its place in the index, from one frame."""
    reader = BundleReader(uri)
    fields, block, _ = decode(reader.frame(frame), offset)
    reader.close()
    return describe(fields, block)


def sweep(index: DataFrame, out: str) -> int:
    """Delete bundles under out that the index does not list (of failed attempts); how many."""
    system, path = located(qualified(index.sparkSession, out))
    listed = {r.bundle.rsplit("/", 1)[1] for r in index.select("bundle").distinct().toLocalIterator()}
    orphans = [f.path for f in system.get_file_info(arrow_fs.FileSelector(path)) if f.base_name not in listed]
    for orphan in orphans:
        system.delete_file(orphan)
    return len(orphans)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages in a new folder and return what the archives say of each; bundles of failed attempts go."""
    out = scratch(pages.sparkSession, "warc")
    index = write_archives(pages, out)
    sweep(index, out)
    return read_archives(index).drop("payload").withColumnRenamed("record_id", "page_id")


#: DuckDB SQL of `round_trip` but for payload_digest, which it has no base32 for: the digest is spelt by 5-bit groups.
ROUND_TRIP_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, hex,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS top
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to FROM b
"""
