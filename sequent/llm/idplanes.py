"""Token-id output in bit or byte planes.

Documents are range-sorted by id; each part of that order becomes one shard file in the shared folder:

    block 0 | block 1 | ... | index | 8-byte length of the index | b"IDPLANE1"

A block holds `block_ids` ids (the last may hold fewer) as 4 byte planes or 32 bit planes, least significant
first, each compressed with zstandard.  The index (zstandard over JSON header and little-endian int64 arrays)
is the chunk index: for each block its place in the file, its number of ids and the size of each plane, and for
each document its id and number of ids.  Any block can be read alone.

A task names its file after its attempt and hands the name to Spark's own committed manifest table, so that a
repeated or speculative task leaves no half-written shard in use.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequent.llm.shared import fresh_path, part_offsets, stored
from sequent.llm.tokens import encoder

MAGIC = b"IDPLANE1"


def planes_of(ids: np.ndarray, plane: str) -> list[bytes]:
    """Byte or bit planes of 32-bit ids, least significant first."""
    by_byte = np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    if plane == "byte":
        return [row.tobytes() for row in by_byte]
    bits = np.unpackbits(by_byte[:, :, None], axis=2, bitorder="little")  # byte, id, bit
    return [np.packbits(bits[b, :, k], bitorder="little").tobytes() for b in range(4) for k in range(8)]


def ids_of(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    """The ids again."""
    if plane == "byte":
        by_byte = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes])
        by_byte = np.packbits(bits.reshape(4, 8, n), axis=1, bitorder="little")[:, 0]
    return np.ascontiguousarray(by_byte.T).view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard, block by block."""

    def __init__(self, sink, block_ids: int, plane: str):
        import zstandard

        self._sink, self._block_ids, self._plane = sink, block_ids, plane
        self._squeeze = zstandard.ZstdCompressor(level=1).compress
        self._held, self._size, self._at = [], 0, 0
        self._blocks: list[list[int]] = []
        self._docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id or 0, doc_id is None, len(ids)))
        self._held.append(ids)
        self._size += len(ids)
        if self._size >= self._block_ids:
            ids, at = np.concatenate(self._held), 0
            while self._size - at >= self._block_ids:
                self._write(ids[at : at + self._block_ids])
                at += self._block_ids
            self._held, self._size = [ids[at:]], self._size - at

    def _write(self, ids: np.ndarray) -> None:
        parts = [self._squeeze(p) for p in planes_of(ids, self._plane)]
        self._blocks.append([self._at, len(ids), *map(len, parts)])
        self._sink.write(b"".join(parts))
        self._at += sum(map(len, parts))

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        if self._size:
            self._write(np.concatenate(self._held))
        blocks = np.array(self._blocks, "<i8").reshape(len(self._blocks), -1)
        docs = np.array(self._docs, "<i8").reshape(-1, 3)
        head = json.dumps({"plane": self._plane, "block_ids": self._block_ids, "blocks": list(blocks.shape), "docs": len(docs)}).encode()
        index = self._squeeze(len(head).to_bytes(8, "little") + head + blocks.tobytes() + docs.tobytes())
        self._sink.write(index + len(index).to_bytes(8, "little") + MAGIC)
        return len(docs), int(blocks[:, 1].sum()) if len(blocks) else 0


class ShardReader:
    """Reads a shard's index, then any block."""

    def __init__(self, source):
        import zstandard

        self._source, self._expand = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard of id planes")
        length = int.from_bytes(tail[:8], "little")
        raw = self._expand(source.read_at(length, size - 16 - length))
        n = int.from_bytes(raw[:8], "little")
        head = json.loads(raw[8 : 8 + n])
        self.plane, shape = head["plane"], head["blocks"]
        body = np.frombuffer(raw[8 + n :], "<i8")
        cells = shape[0] * shape[1] if len(shape) > 1 else 0
        self.blocks, self.docs = body[:cells].reshape(shape) if cells else [], body[cells:].reshape(-1, 3)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.blocks[k])
        raw = self._source.read_at(sum(sizes), at)
        stops = np.cumsum(sizes).tolist()
        return ids_of([self._expand(raw[b - s : b]) for s, b in zip(sizes, stops, strict=True)], n, self.plane)

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document's id and its ids in runs, reading one block at a time."""
        k, left = 0, np.zeros(0, "<u4")
        for doc_id, null, n in self.docs.tolist():
            runs = []
            while n:
                if not len(left):
                    left, k = self.block(k), k + 1
                runs.append(left[:n])
                n -= len(runs[-1])
                left = left[len(runs[-1]) :]
            yield (None if null else doc_id), runs


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block_ids: int = 1 << 16, plane: str = "byte") -> DataFrame:
    """Encode `docs` (doc_id, text) and write shard files under path; returns the stored manifest.

    Each document's ids are followed by end_id.  Documents go in ascending doc_id order; null ids come first;
    rows of one doc_id by a hash of the text.  A null text is empty: its ids are the end id alone.  No rows: no
    shards.  Other columns are not read.  Manifest: shard, file, n_docs, n_ids, start (ids of all shards before).
    """
    if plane not in ("byte", "bit"):
        raise ValueError("plane must be 'byte' or 'bit'")
    _make(path)
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, encode = None, encoder(vocabulary)
        task = TaskContext.get()
        name = f"{path}/shard-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
        end = np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if writer is None:
                    system, place = _open(name)
                    sink = system.open_output_stream(place)
                    writer = ShardWriter(sink, block_ids, plane)
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode.texts(part["text"].to_pylist()), strict=True):
                    writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = stored(ordered.mapInArrow(write, "shard long, file string, n_docs long, n_ids long"), "id-shards")
    starts = part_offsets(manifest, F.sum("n_ids"), "shard").withColumnRenamed("before", "start")
    return manifest.join(starts, "shard")


def _make(path: str) -> None:
    system, place = _open(path)
    system.create_dir(place, recursive=True)


READ = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType(), False) for c in ("start", "n_tokens", "ids_crc32")), T.StructField("shard", T.LongType(), False)])


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of the shard files: doc_id, start, n_tokens, ids_crc32, shard.

    One task reads about one shard, however few bytes the manifest has.  A very long document's ids pass block by
    block; an empty manifest gives no rows.
    """
    files = manifest.select("shard", "file", "start")
    shards = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                system, place = _open(row["file"])
                with system.open_input_file(place) as source:
                    rows, start = [], row["start"]
                    for doc_id, runs in ShardReader(source).documents():
                        crc, n = 0, 0
                        for run in runs:
                            crc, n = zlib.crc32(run, crc), n + len(run)
                        rows.append((doc_id, start, n, crc, row["shard"]))
                        start += n
                    for at in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 10_000], strict=True), schema, strict=True)], schema=schema)

    return files.repartitionByRange(shards, "shard").mapInArrow(read, READ)


def id_planes(docs: DataFrame, vocabulary: str, end_id: int = 2, block_ids: int = 1 << 16, plane: str = "byte") -> DataFrame:
    """Write the ids of all documents as shard files and read them back, document by document.

    A null text is empty; an empty text has the end id alone.  A text of any length is encoded whole: its ids go to as
    many blocks as they need, and a task holds one such text at a time.  Null and repeated doc_ids are documents of
    their own; of one doc_id those go first whose text has the smaller hash, and rows alike in both may change places,
    which changes nothing.  No rows: no rows.  Other columns are not read, whatever their names.
    """
    manifest = write_shards(docs, fresh_path(docs.sparkSession, "id-planes"), vocabulary, end_id, block_ids, plane)
    return read_documents(manifest)
