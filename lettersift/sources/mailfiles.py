"""Folders of mail files as a Spark data source, with header-only reading and uids that stay.

A file is one mail (``*.eml``) or an mbox of many. The name of a file's directory is its folder. Files are
listed once and dealt into partitions by size; a large mbox is cut into byte ranges, and the mails that begin in a range
belong to it. A header scan reads ``.eml`` files no further than their first empty line. Bodies are read later, only those of
the mails that are left, by path and place: no content is ever shuffled.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .tables import write_version

SCHEMA = (
    "mailbox string, source_folder string, path string, position long, length long, modified timestamp, raw binary"
)
# Bytes of files that one partition reads, and mails that are handed on together.
PARTITION_BYTES = 64_000_000
ROWS, BATCH_BYTES = 500, 16_000_000
_QUOTED = re.compile(rb"^>(>*From )", re.M)
_PLACE = ["mailbox", "source_folder", "path", "position"]


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _open(path: str) -> io.BufferedReader:
    system, place = _file_system(path)
    return io.BufferedReader(system.open_input_file(place), 1 << 16)


@dataclass
class Range(InputPartition):
    """Parts of files: ``(path, modified in microseconds, first byte, end)``."""

    parts: list[tuple[str, int, int, int]]


def list_files(path: str, pattern: str) -> list[tuple[str, int, int]]:
    """``(path, modified in microseconds, size)`` of the files whose name matches a regular expression, by age and path."""
    from pyarrow import fs

    system, place = _file_system(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted(
        ((scheme + f.path, f.mtime_ns // 1000, f.size) for f in found if f.is_file and re.fullmatch(pattern, f.base_name)),
        key=lambda f: (f[1], f[0]))


def deal(files: list[tuple[str, int, int]], bytes_each: int) -> list[Range]:
    """Partitions of about ``bytes_each``: several small files, or ranges of a large mbox."""
    ranges, own, held = [], [], 0
    for path, modified, size in files:
        step = size if path.endswith(".eml") else bytes_each
        for first in range(0, max(size, 1), max(step, 1)):
            end = min(size, first + step)
            own.append((path, modified, first, end))
            held += end - first
            if held >= bytes_each:
                ranges.append(Range(own))
                own, held = [], 0
    return [*ranges, Range(own)] if own else ranges


def mbox_mails(file: io.BufferedReader, first: int, end: int, headers_only: bool) -> Iterator[tuple[int, int, bytes]]:
    """``(position, length, bytes)`` of the mails whose separator line begins in ``[first, end)``.

    A separator is a line that starts with ``From `` at the start of the file or behind an empty line; quoted ones lose a ``>``.
    """
    file.seek(max(0, first - 2))
    back = file.read(min(2, first))
    blank = first == 0 or back.endswith(b"\n\n")
    if first and not back.endswith(b"\n"):
        file.readline()  # the rest of a line that began before
        blank = False
    at, start, lines, in_head = file.tell(), None, [], True
    while True:
        line = file.readline()
        if not line or (blank and line.startswith(b"From ")):
            if start is not None:
                yield start, at - start, _QUOTED.sub(rb"\1", b"".join(lines))
            if not line or at >= end:
                return
            start, lines, in_head, blank = at + len(line), [], True, False
        else:
            blank = line in (b"\n", b"\r\n")
            if start is None and at >= end:
                return
            if start is not None and (in_head or not headers_only):
                lines.append(line)
            in_head = in_head and not blank
        at += len(line)


def eml_mail(file: io.BufferedReader, size: int, headers_only: bool) -> bytes:
    """The bytes of a single mail, or those up to its first empty line."""
    if not headers_only:
        return file.read()
    lines = []
    while line := file.readline():
        lines.append(line)
        if line in (b"\n", b"\r\n"):
            break
    return b"".join(lines)


def _rows(part: Range, mailbox: str, headers_only: bool) -> Iterator[tuple]:
    from urllib.parse import unquote

    for path, modified, first, end in part.parts:
        folder = unquote(path.rsplit("/", 2)[-2]).removeprefix("source_folder=")
        with _open(path) as file:
            if path.endswith(".eml"):
                yield mailbox, folder, path, 0, end, modified, eml_mail(file, end, headers_only)
            else:
                for position, length, raw in mbox_mails(file, first, end, headers_only):
                    yield mailbox, folder, path, position, length, modified, raw


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("mailbox", pa.string()), ("source_folder", pa.string()), ("path", pa.string()), ("position", pa.int64()),
        ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("raw", pa.binary())])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class _Reading:
    """What batch and stream reading share."""

    def __init__(self, options: dict) -> None:
        self.path, self.mailbox = options["path"], options.get("mailbox", "")
        self.pattern = options.get("pattern", r".*\.(eml|mbox|txt)")
        self.headers_only = str(options.get("headersOnly", "false")).lower() == "true"
        self.bytes_each = int(options.get("partitionBytes", PARTITION_BYTES))

    def files(self) -> list[tuple[str, int, int]]:
        return list_files(self.path, self.pattern)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(_rows(partition, self.mailbox, self.headers_only))


class MailReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return deal(self.files(), self.bytes_each)


class MailStreamReader(_Reading, DataSourceStreamReader):
    """Files in order of age and path; an offset is the last file that was read. A file that changes is read again."""

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"modified": files[-1][1], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after, upto = (start["modified"], start["path"]), (end["modified"], end["path"])
        return deal([f for f in self.files() if after < (f[1], f[0]) <= upto], self.bytes_each)


class MailFiles(DataSource):
    """``spark.read.format("mailfiles")`` and ``readStream``: options path, mailbox, pattern, headersOnly, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "mailfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> MailReader:
        return MailReader(self.options)

    def streamReader(self, schema: T.StructType) -> MailStreamReader:
        return MailStreamReader(self.options)


def mail_files(spark: SparkSession, path: str, mailbox: str, headers_only: bool = False, **options) -> DataFrame:
    """Raw mails below a path: places and bytes, or with ``headers_only`` the bytes up to the first empty line."""
    spark.dataSource.register(MailFiles)
    reader = spark.read.format("mailfiles").options(mailbox=mailbox, headersOnly=str(headers_only).lower(), **options)
    return reader.load(path)


def mail_file_stream(spark: SparkSession, path: str, mailbox: str, headers_only: bool = False, **options) -> DataFrame:
    """The same as a stream: each trigger takes the files that came since."""
    spark.dataSource.register(MailFiles)
    reader = spark.readStream.format("mailfiles").options(mailbox=mailbox, headersOnly=str(headers_only).lower(), **options)
    return reader.load(path)


def known_uids(spark: SparkSession, table: str) -> DataFrame:
    """``(mailbox, source_folder, path, position, uid)`` of all mails that were numbered; empty before the first time."""
    schema = "mailbox string, source_folder string, path string, position long, uid long"
    try:
        return spark.read.schema(schema).option("basePath", table).parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def number_mails(mails: DataFrame, table: str, version: int) -> DataFrame:
    """Give mails their uid: those numbered before keep it, whatever files have gone; others count on in their folder.

    New mails are numbered by age, path and place and written as one version of the table; a version that is written again
    replaces itself. Only places are shuffled, without the bytes. Returns ``mails`` with ``uid`` and ``id``.
    """
    spark = mails.sparkSession
    earlier = known_uids(spark, table)
    if version > 0 and "version" in earlier.columns:
        earlier = earlier.where(F.col("version") < version)
    places = mails.select(*_PLACE, "modified").distinct().join(earlier.select(*_PLACE), _PLACE, "left_anti")
    last = earlier.groupBy("mailbox", "source_folder").agg(F.max("uid").alias("_last"))
    order = Window.partitionBy("mailbox", "source_folder").orderBy("modified", "path", "position")
    new = places.withColumn("_n", F.row_number().over(order)).join(last, ["mailbox", "source_folder"], "left")
    write_version(new.select(*_PLACE, (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long").alias("uid")), table, version)
    uids = known_uids(spark, table).select(*_PLACE, "uid")
    return mails.join(uids, _PLACE).withColumn("id", F.concat_ws(":", F.element_at(F.split("path", "/"), -1), "position"))


def with_raw(found: DataFrame) -> DataFrame:
    """Add the bytes of mails by their place; each is read where its row is. A file that has gone gives null."""
    schema = T.StructType([*found.schema.fields, T.StructField("raw", T.BinaryType())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                raws = []
                for path, position, length in zip(*(rows.column(n).to_pylist() for n in ("path", "position", "length")), strict=True):
                    try:
                        with _open(path) as file:
                            file.seek(position)
                            raw = file.read(length)
                        raws.append(raw if path.endswith(".eml") else _QUOTED.sub(rb"\1", raw))
                    except FileNotFoundError:
                        raws.append(None)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(raws, pa.binary())], [*rows.schema.names, "raw"])

    return found.mapInArrow(fetch, schema)
