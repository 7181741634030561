"""A sink that commits all files with their manifest at once, or nothing.

Tasks write JSON lines to a staging folder beside the target and report file, rows, bytes and SHA-256.  The commit removes
what killed or repeated attempts left, writes the manifest and renames the staging folder to the target, in one step:
the target has data/ and manifest.json, or is not there.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST, DATA = "manifest.json", "data"
FIELDS = ["file", "rows", "bytes", "sha256"]


def local(path: str) -> str:
    """The path of a folder that driver and executors share, without its scheme."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"not a mounted folder: {path}")
    return os.path.abspath(path.removeprefix("file://"))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    bytes: int
    sha256: str


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self._path = local(path)
        if os.path.lexists(self._path):
            raise FileExistsError(f"{path} already exists")
        self._staging = f"{self._path}.staging-{uuid.uuid4().hex}"
        os.makedirs(f"{self._staging}/{DATA}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file a task: the only column of the rows, a line each."""
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.jsonl"
        digest, rows, size = hashlib.sha256(), 0, 0
        with open(f"{self._staging}/{DATA}/{name}", "xb") as out:
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    data = line.encode() + b"\n"
                    out.write(data)
                    digest.update(data)
                    rows, size = rows + 1, size + len(data)
            out.flush()
            os.fsync(out.fileno())
        return Written(name, rows, size, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        own = sorted((m for m in messages if m is not None), key=lambda m: m.file)
        kept = [m for m in own if m.rows]
        for name in set(os.listdir(f"{self._staging}/{DATA}")) - {m.file for m in kept}:
            os.unlink(f"{self._staging}/{DATA}/{name}")
        files = [{f: getattr(m, f) for f in FIELDS} for m in kept]
        with open(f"{self._staging}/{MANIFEST}", "x") as out:
            json.dump({"files": files, "rows": sum(m.rows for m in kept), "bytes": sum(m.bytes for m in kept)}, out, sort_keys=True)
        if os.path.lexists(self._path):  # another writer was first; renaming onto a folder with files fails as well
            shutil.rmtree(self._staging)
            raise FileExistsError(f"{self._path} already exists")
        os.rename(self._staging, self._path)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self._staging, ignore_errors=True)


class CommittedLines(DataSource):
    """Option: path, which must not exist yet."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("committed lines are never overwritten")
        return Writer(self.options["path"])


def write_lines(rows: DataFrame, path: str) -> DataFrame:
    """Rows as JSON lines with sorted keys, a file for each part of `rows` that has some, where nothing is yet; returns the manifest."""
    rows.sparkSession.dataSource.register(CommittedLines)
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.format("committed_lines").mode("append").option("path", path).save()
    return read_manifest(rows.sparkSession, path)


def read_manifest(spark, path: str) -> DataFrame:
    """file, rows, bytes, sha256 of a committed folder."""
    text = spark.read.text(f"{path}/{MANIFEST}", wholetext=True)
    kind = "files array<struct<file: string, rows: bigint, bytes: bigint, sha256: string>>"
    return text.select(F.explode(F.from_json("value", kind)["files"]).alias("f")).select("f.*")


def hashed_files(files: DataFrame, task_bytes: int = 1 << 30, chunk: int = 8 << 20) -> DataFrame:
    """`files` (path, length) with `sha256`: files are dealt to tasks by size and hashed as streams, whatever their length."""
    from pyspark.sql import window as W

    order = W.Window.orderBy(F.desc("length"), "path").rowsBetween(W.Window.unboundedPreceding, -1)  # a row a file
    task = F.floor(F.coalesce(F.sum("length").over(order), F.lit(0)) / task_bytes)
    placed = files.select("path", "length").withColumn("task", task)
    number = (files.agg(F.sum("length")).first()[0] or 0) // task_bytes + 1

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                own = hashlib.sha256()
                with system.open_input_stream(name, compression=None) as source:
                    while data := source.read(chunk):
                        own.update(data)
                found.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], pa.array(found, pa.string())], names=["path", "length", "sha256"])

    return placed.repartition(int(number), "task").select("path", "length").mapInArrow(digest, "path string, length long, sha256 string")
