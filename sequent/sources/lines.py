"""Lines of files, strictly: byte ranges as partitions, LF framing, strict UTF-8, a bound on a line's bytes, places and numbers.

A file is cut into ranges of bytes, and a line belongs to the range it begins in, so ranges are read apart from each
other whatever the lines' lengths.  A line that grows over the bound is dropped while it is read: a task holds a chunk
and one line of at most the bound.  A row says where its line stands (file, part, place in the part, byte offset), so the
physical order of a file is known; line numbers are prefix sums over the parts' counts, and are made for rows that need them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, part int, local long, offset long, bytes long, value string, fault string"
#: Bytes that are read at once, and lines of a batch.
CHUNK, BATCH = 1 << 20, 8_192
OVERLONG, NOT_UTF8, RETURN, UNENDED, BLANK = "over-long", "not UTF-8", "carriage return", "no line feed at the end", "blank line"


def lines_between(source: BinaryIO, start: int, end: int, most: int, chunk: int = CHUNK) -> Iterator[tuple[int, int, bytes | None, bool]]:
    """(offset, bytes, content, ended) of the lines that begin from start up to end; content is None over `most` bytes."""
    source.seek(max(0, start - 1))
    at, skipping = max(0, start - 1), start > 0  # a line begins at start if the byte before is a line feed
    begin, size, held = start, 0, bytearray()
    while data := source.read(chunk):
        cursor = 0
        while (stop := data.find(b"\n", cursor)) >= 0:
            if not skipping:
                size += stop - cursor
                yield begin, size, bytes(held) + data[cursor:stop] if size <= most else None, True
            begin, size, skipping = at + stop + 1, 0, False
            held.clear()
            cursor = stop + 1
            if begin >= end:
                return
        if not skipping:
            size += len(data) - cursor
            if size <= most:
                held += data[cursor:]
            else:
                held.clear()
        at += len(data)
    if size:
        yield begin, size, bytes(held) if size <= most else None, False


def judged(content: bytes | None, ended: bool) -> tuple[str | None, str | None]:
    """(text, fault) of a line."""
    if content is None:
        return None, OVERLONG
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return None, NOT_UTF8
    return text, UNENDED if not ended else RETURN if text.endswith("\r") else BLANK if not text else None


@dataclass
class Range(InputPartition):
    file: str
    part: int
    start: int
    end: int


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self._path, self._most, self._size = options["path"], int(options.get("maxlinebytes", 64 << 20)), int(options.get("partbytes", 128 << 20))

    def partitions(self) -> list[Range]:
        """Ranges of all files under the path; names that begin with _ or . are not data."""
        from pyarrow import fs

        system, path = opened(self._path)
        one = system.get_file_info(path)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = [x for x in found if x.type == fs.FileType.File and x.size and not any(p[0] in "_." for p in x.path[len(path) :].split("/") if p)]
        return [Range(x.path, k, k * self._size, min(x.size, (k + 1) * self._size)) for x in sorted(files, key=lambda x: x.path) for k in range(-(-x.size // self._size))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        system, _ = opened(self._path)
        rows, held = [], 0
        with system.open_input_file(partition.file) as source:
            for local, (offset, size, content, ended) in enumerate(lines_between(source, partition.start, partition.end, self._most)):
                rows.append((partition.file, partition.part, local, offset, size, *judged(content, ended)))
                held += size if content is not None else 0
                if len(rows) == BATCH or held > 16 << 20:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class StrictLines(DataSource):
    """Options: path (a file or a folder, read with all below it), maxLineBytes (64 MiB), partBytes (128 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "strict_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options)


def read_lines(spark: SparkSession, path: str, most: int = 64 << 20, part_bytes: int = 128 << 20) -> DataFrame:
    """file, part, local, offset, bytes, value, fault: a row for each line under the path.

    fault says why a line is no good (its value is null if it is over-long or no UTF-8), else it is null.  The path is
    one that pyarrow opens and that driver and executors share.
    """
    spark.dataSource.register(StrictLines)
    return spark.read.format("strict_lines").option("path", path).option("maxLineBytes", most).option("partBytes", part_bytes).load()


def numbered_lines(lines: DataFrame, some: DataFrame) -> DataFrame:
    """`some` rows of `lines` with `line`, their number in the file from 1: a running sum over one row a part."""
    counts = lines.groupBy("file", "part").agg(F.count("*").alias("__n"))
    before = W.Window.partitionBy("file").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select("file", "part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return some.join(offsets, ["file", "part"]).withColumn("line", F.col("__before") + F.col("local") + 1).drop("__before")


def physical_runs(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each run of equal keys in physical order (file, part, local), with `after`, the key of the run before it (null at a file's start).

    No window is wider than a part: what stood before a part comes from the last rows of the parts, one row each.
    """
    inside = W.Window.partitionBy("file", "part").orderBy("local")
    last = rows.groupBy("file", "part").agg(F.max_by(F.struct(F.col(key).alias("key")), "local").alias("last"))
    border = last.select("file", "part", F.lag("last").over(W.Window.partitionBy("file").orderBy("part")).alias("border"))
    own = F.struct(F.col(key).alias("key"))
    placed = rows.join(border, ["file", "part"]).withColumn("__was", F.coalesce(F.lag(own).over(inside), F.col("border")))
    return placed.where(F.col("__was").isNull() | ~F.col("__was.key").eqNullSafe(F.col(key))).withColumn("after", F.col("__was.key")).drop("__was", "border")


def file_order(rows: DataFrame, game: str, schedule: str) -> tuple[DataFrame, DataFrame]:
    """(games, breaks) of rows in physical order.

    games: file, game, runs, rows; a game that lies in one piece has one run.  breaks: file, game, after, offset of each run that
    stands behind a run of a game that the schedule has later.
    """
    key = F.struct(F.col(schedule).alias("schedule"), F.col(game).alias("game"))
    runs = physical_runs(rows.withColumn("__key", key), "__key")
    counts = rows.groupBy("file", game).agg(F.count("*").alias("rows"))
    games = runs.groupBy("file", game).agg(F.count("*").alias("runs")).join(counts, ["file", game]).select("file", game, "runs", "rows")
    breaks = runs.where(F.col("after.schedule") > F.col(schedule)).select("file", game, F.col("after.game").alias("after"), "offset")
    return games, breaks
