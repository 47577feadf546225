"""Zip archives as a source: entries, XML articles of a gazette, and paragraphs of word-processor documents.

Spark lists the archives with their sizes. Each is dealt to tasks as ranges of
bytes, and a task reads the archive's directory (at its end) and then only the
entries whose header lies in its range, so that one large archive is read by
many tasks and many small ones by as many. Nothing but a count of ranges comes
to the driver. What can't be read is a row that says why, never a failed job:
a broken archive one such row, a broken entry its own.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.functions.text import norm_ws

#: Bytes of an archive that a task reads; entries above MOST bytes are told of, with their size, instead of being read.
RANGE, MOST = 64 << 20, 512 << 20
#: Content in a batch, and ranges dealt to tasks of their own.
BATCH, TASKS = 16 << 20, 20_000
ENTRY = "archive string, entry string, place long, size long, content binary, error string"
_ENTRY = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError)


def open_uri(uri: str) -> BinaryIO:
    """A file that can be read from any place: local ones, and those of stores that Arrow knows."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    system, path = arrow_fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _entries(uri: str, start: int, end: int, keep: Callable[[str], bool], most: int, opener: Callable[[str], BinaryIO]) -> Iterator[tuple]:
    try:
        with opener(uri) as file, zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                if info.is_dir() or not start <= info.header_offset < end or not keep(info.filename):
                    continue
                content, error = None, None
                if info.file_size > most:
                    error = f"entry of {info.file_size} bytes, the bound is {most}"
                else:
                    try:
                        content = archive.read(info)
                    except _BROKEN as broken:
                        error = f"{type(broken).__name__}: {broken}"
                yield uri, info.filename, info.header_offset, info.file_size, content, error
    except _BROKEN as broken:
        # Every range meets a broken directory; the first one tells.
        if start == 0:
            yield uri, None, None, None, None, f"{type(broken).__name__}: {broken}"


def read_entries(spark: SparkSession, path: str | list[str] | DataFrame, suffix: str | None = None, bytes_a_task: int = RANGE, most: int = MOST, opener: Callable[[str], BinaryIO] = open_uri) -> DataFrame:
    """Entries (archive, entry, place, size, content, error) of archives under a path, or of a table (archive, length), folders left out.

    suffix keeps entries whose name ends so, in whatever case. place is the
    offset of the entry's header, which tells entries of one name apart. An
    archive without entries has no rows, nor has a file of no bytes, which
    Spark's listing leaves out; content is null where error isn't.
    """
    keep = lambda name: suffix is None or name.lower().endswith(suffix.lower())
    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "length")
    ranges = files.select("archive", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(bytes_a_task).cast("long"))).alias("start"))
    tasks = min(TASKS, max(1, ranges.count()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for uri, start in zip(batch["archive"].to_pylist(), batch["start"].to_pylist()):
                for row in _entries(uri, start, start + bytes_a_task, keep, most, opener):
                    rows.append(row)
                    held += len(row[4] or b"")
                    if held >= BATCH or len(rows) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ENTRY)], schema=_ENTRY)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ENTRY)], schema=_ENTRY)

    return ranges.repartition(tasks, "archive", "start").mapInArrow(run, ENTRY)


def _plain(text: Column) -> Column:
    return norm_ws(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))


def read_gazette(spark: SparkSession, path: str | list[str] | DataFrame, **options) -> DataFrame:
    """Articles of archives of XML entries: attributes and texts (without tags) as columns, empty where they lack; and an error.

    The first article of an entry counts. An entry that isn't XML, or has no
    article, is a row with an error.
    """
    inner = "_artType string, _artCategory string, _pubDate string, _pdfPage string, _idMateria string, body struct<Identifica: string, Ementa: string, Texto: string>"
    entries = read_entries(spark, path, ".xml", **options).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    parsed = entries.withColumn("x", F.from_xml("text", F.lit(f"article array<struct<{inner}>>, _corrupt string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    a = F.try_element_at("x.article", F.lit(1))
    attribute = lambda name: F.coalesce(a[f"_{name}"], F.lit(""))
    why = F.coalesce("error", F.when(F.col("x._corrupt").isNotNull() | F.col("x").isNull(), F.lit("not XML")).when(a.isNull(), F.lit("no article")))
    return parsed.select(
        "archive", "entry", "place", attribute("idMateria").alias("native"), attribute("artType").alias("type"), F.substring_index(attribute("artCategory"), "/", 1).alias("org"), attribute("pubDate").alias("day"),
        attribute("pdfPage").alias("url"), _plain(a["body"]["Identifica"]).alias("title"), _plain(a["body"]["Ementa"]).alias("summary"), _plain(a["body"]["Texto"]).alias("body"), why.alias("error"))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraphs(content: bytes) -> tuple[list[str] | None, str | None]:
    """Texts of a document's paragraphs, tabs and breaks as white space, and why there are none."""
    try:
        root = ElementTree.fromstring(content)
    except (ElementTree.ParseError, ValueError, LookupError) as broken:
        return None, f"not XML: {broken}"
    found = []
    for paragraph in root.iter(f"{_WORD}p"):
        parts = []
        for node in paragraph.iter():
            if node.tag == f"{_WORD}t":
                parts.append(node.text or "")
            elif node.tag in (f"{_WORD}tab", f"{_WORD}br", f"{_WORD}cr"):
                parts.append(" ")
        if text := "".join(parts).strip():
            found.append(text)
    return found, None


def read_word_documents(spark: SparkSession, path: str | list[str] | DataFrame, **options) -> DataFrame:
    """Word-processor documents (archive, paragraphs, error): the texts of their paragraphs in order, empty ones left out."""
    body = read_entries(spark, path, "word/document.xml", **options).select("archive", "content", "error")
    schema = pa.schema([("archive", pa.string()), ("paragraphs", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, error in zip(*(batch[c] for c in ("archive", "content", "error"))):
                found, why = (None, error.as_py()) if not content.is_valid else _paragraphs(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((archive.as_py(), found, why), schema)], schema=schema)

    return body.mapInArrow(run, "archive string, paragraphs array<string>, error string")


def write_archives(entries: DataFrame, folder: str, bytes_each: int = RANGE) -> DataFrame:
    """Write entries (entry string, content binary) to archives of about a size; a row (archive, length, n) for each.

    A task writes its own files, under names of its attempt, so the rows tell
    which count: files of lost attempts are in none. Keep the rows as a table,
    which `read_entries` takes; computing them again writes again. folder is one that all
    executors write to. Null names are the empty name, null content is empty.
    """
    schema = pa.schema([("archive", pa.string()), ("length", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = arrow_fs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (arrow_fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        made, sink, archive, n = 0, None, None, 0
        name = lambda: f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}-{made:04d}.zip"

        def finish() -> pa.RecordBatch:
            archive.close()
            length = sink.tell()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name()}"]), pa.array([length], pa.int64()), pa.array([n], pa.int64())], schema=schema)

        for batch in batches:
            for entry, content in zip(batch["entry"], batch["content"]):
                if archive is None:
                    sink = system.open_output_stream(f"{base}/{name()}")
                    archive, n = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED), 0
                # A fixed moment, so that reruns write the same bytes.
                archive.writestr(zipfile.ZipInfo(entry.as_py() or "", (1980, 1, 1, 0, 0, 0)), content.as_py() or b"", zipfile.ZIP_DEFLATED)
                n += 1
                if sink.tell() >= bytes_each:
                    yield finish()
                    made, archive = made + 1, None
        if archive is not None:
            yield finish()

    return entries.select("entry", "content").mapInArrow(run, "archive string, length long, n long")
