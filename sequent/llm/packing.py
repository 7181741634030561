"""Bulk-synchronous best-fit packing of token pieces into sequences of one length.

Lengths are worked off in levels, (capacity / 2, capacity] first, each half as long as the one before.  In a round the
pieces of a level and the gaps that can take one are range-sorted together by size, and a sweep looks for successors:
every gap, in ascending order, takes the largest piece below it that no smaller gap has taken.  That is the matching of
parentheses, a piece opening and a gap closing one, so a part of the range sort is swept by itself, and what it leaves
open meets later parts' gaps by rank: pieces and gaps of one depth pair up in the order of the parts.  A gap that is at
least as long as the level's longest piece offers several places at once.  Gaps are updated, and rounds go on until
none takes a piece; the pieces that are left open new sequences, longest first.

Between rounds there are tables only: of pieces left, of gaps, and of (piece, sequence) pairs.  The driver sees counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.llm.shared import part_offsets, range_numbered, stored
from sequent.llm.tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of each document (doc_id, text): its ids, then end_id, cut every `capacity` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, rows = batch.slice(first, 256), []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode.texts(part["text"].to_pylist()), strict=True):
                    ids = np.concatenate([ids, end])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        rows.append((doc_id, k, at, len(own), zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


#: The last level holds all pieces up to this length.
SHORT = 16
#: Rows that a part of a sweep gets: parts follow the number of pieces and gaps, so that a task's memory does not grow.
PART = 1 << 18


def levels(capacity: int) -> list[tuple[int, int]]:
    """(above, up to) of each level's lengths, longest first."""
    found, top = [], capacity
    while top > SHORT:
        found.append((top // 2, top))
        top //= 2
    return [*found, (0, top)]


def paired(opens: np.ndarray) -> np.ndarray:
    """For each place of a sequence of parentheses the place of its partner, -1 if it has none."""
    depth = np.cumsum(np.where(opens, 1, -1))
    level = np.where(opens, depth, depth + 1)
    order = np.argsort(level, kind="stable")  # in a level opening and closing ones take turns
    left, right = order[:-1], order[1:]
    met = (level[left] == level[right]) & opens[left] & ~opens[right]
    partner = np.full(len(opens), -1)
    partner[left[met]], partner[right[met]] = right[met], left[met]
    return partner


SWEPT = "part int, kind int, depth long, number long, length long, sequence long"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's pieces (length) and gaps (sequence), sorted by size: pairs (kind 2), and what has no partner here.

    depth counts what is left from the part's start: gaps (kind 1) take away 0, 1, ..., pieces (kind 0) follow them.
    """
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    number, length, sequence = (table[c].combine_chunks().fill_null(-1).to_numpy() for c in ("number", "length", "sequence"))
    opens = sequence < 0
    partner = paired(opens)
    met = np.flatnonzero(opens & (partner >= 0))
    gaps, pieces = np.flatnonzero(~opens & (partner < 0)), np.flatnonzero(opens & (partner < 0))
    rows = np.concatenate([met, gaps, pieces])
    kind = np.repeat([2, 1, 0], [len(met), len(gaps), len(pieces)]).astype(np.int32)
    depth = np.concatenate([np.zeros(len(met), np.int64), -np.arange(len(gaps)), 1 - len(gaps) + np.arange(len(pieces))])
    target = np.concatenate([sequence[partner[met]], sequence[gaps], np.full(len(pieces), -1)])
    part = np.full(len(rows), TaskContext.get().partitionId(), np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, kind, depth, number[rows], length[rows], target)], names=[c.split()[0] for c in SWEPT.split(", ")])


def matched(pieces: DataFrame, n_pieces: int, able: DataFrame, n_gaps: int, top: int) -> DataFrame:
    """One round: (number, length, sequence) of each piece (number, length); sequence is null if no gap took it.

    able: sequence, gap.  No more places are offered than there are pieces and gaps.
    """
    places = F.least(F.greatest(F.lit(1), F.floor(F.col("gap") / top)), F.lit(-(-n_pieces // n_gaps)))
    offers = able.select(F.col("gap").alias("size"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("long").alias("length"), "sequence", F.explode(F.sequence(F.lit(1), places.cast("int"))).alias("place"))
    wants = pieces.select(F.col("length").alias("size"), F.lit(0).alias("kind"), "number", "length", F.lit(None).cast("long").alias("sequence"), F.lit(0).alias("place"))
    keys = ["size", "kind", "number", "sequence", "place"]
    swept = stored(wants.unionByName(offers).repartitionByRange((2 * n_pieces + n_gaps) // PART + 1, *keys).sortWithinPartitions(*keys).mapInArrow(sweep, SWEPT), "swept")
    rest = swept.where("kind < 2")
    before = part_offsets(rest, F.sum(1 - 2 * F.col("kind")))  # a row a part
    same = W.Window.partitionBy("level").orderBy("part", F.desc("kind"))  # two rows a part at most
    rest = rest.join(before, "part").withColumn("level", F.col("before") + F.col("depth"))
    rest = rest.withColumn("sequence", F.when(F.lead("kind").over(same) == 1, F.lead("sequence").over(same))).where("kind = 0")
    return stored(swept.where("kind = 2").select("number", "length", "sequence").unionByName(rest.select("number", "length", "sequence")), "met")


def opened(pieces: DataFrame, n_pieces: int, capacity: int, turn: int) -> DataFrame:
    """(number, length, sequence) of pieces in new sequences: longest first, each part fills one after the other."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        total = np.cumsum(table["length"].to_numpy())
        starts, at, done = [], 0, 0
        while at < len(total):
            starts.append(at)
            at = int(np.searchsorted(total, done + capacity, side="right"))
            done = int(total[at - 1])
        first = (turn << 52) | (TaskContext.get().partitionId() << 32)
        own = first + np.repeat(np.arange(len(starts)), np.diff(starts, append=len(total)))
        for batch in table.append_column("sequence", pa.array(own, pa.int64())).to_batches():
            yield batch

    order = [F.desc("length"), "number"]
    return stored(pieces.select("number", "length").repartitionByRange(n_pieces // PART + 1, *order).sortWithinPartitions(*order).mapInArrow(fill, "number long, length long, sequence long"), "opened")


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add `sequence_id` and `offset` to rows that have a `length` of 1 to capacity.

    Rows of one length are interchangeable; columns doc_id and piece order them, and rows alike in these too may
    change places.  Sequences have no gaps from offset 0 on.  Columns that have these names already are replaced,
    others are kept.  No rows: no sequences.
    """
    kept = [c for c in found.columns if c not in ("sequence_id", "offset")]
    order = [F.desc("length"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("piece")]
    held = range_numbered(found.select(F.struct(*kept).alias("__row"), "length", "doc_id", "piece"), order, "pieces")
    numbered = held.join(part_offsets(held, F.count("*")), "part").select("__row", F.col("length").cast("long").alias("length"), (F.col("before") + F.col("local")).alias("number"))
    pieces = stored(numbered.select("number", "length"), "lengths")
    level = reduce(lambda x, k: x.when((F.col("length") > k[1][0]) & (F.col("length") <= k[1][1]), k[0]), enumerate(levels(capacity)), F.when(F.lit(False), -1))
    counts = {r["level"]: (r["n"], r["least"]) for r in pieces.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("length").alias("least")).collect()}  # a row a level
    if None in counts:
        raise ValueError("a piece must have 1 to capacity ids")
    gaps = pieces.select(F.col("number").alias("sequence"), F.col("length").alias("gap")).limit(0)
    turn, placed = 0, []
    for k, (above, top) in enumerate(levels(capacity)):
        left = pieces.where((F.col("length") > above) & (F.col("length") <= top))
        number, least = counts.get(k, (0, 0))
        while number:
            able = gaps.where(F.col("gap") >= least)
            n_gaps = able.count()
            if not n_gaps:  # what a round leaves over is longer than every gap that took nothing
                break
            met = matched(left, number, able, n_gaps, top)
            took, left = met.where("sequence is not null"), met.where("sequence is null").select("number", "length")
            placed.append(took)
            used = took.groupBy("sequence").agg(F.sum("length").alias("used"))
            gaps = gaps.join(used, "sequence", "left").select("sequence", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
            gaps = stored(gaps.where("gap > 0"), "gaps")
            number, least = left.agg(F.count("*"), F.min("length")).first()
        if number:
            turn += 1
            new = opened(left, number, capacity, turn)
            placed.append(new)
            made = new.groupBy("sequence").agg((F.lit(capacity) - F.sum("length")).alias("gap")).where("gap > 0")
            gaps = stored(gaps.unionByName(made), "gaps")
    if not placed:
        return found.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    where = reduce(DataFrame.unionByName, placed)
    ahead = W.Window.partitionBy("sequence").orderBy("number").rowsBetween(W.Window.unboundedPreceding, -1)
    where = where.select("number", F.col("sequence").alias("sequence_id"), F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
    return numbered.select("__row", "number").join(where, "number").select("__row.*", "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents (doc_id, text) with the sequence and the place each goes to.

    A null or empty text is one piece, the end id.  Null and repeated doc_ids are documents of their own, and rows
    alike in doc_id, piece and length may change places.  Only documents of more than capacity ids are cut; a very long
    text is encoded whole and gives as many pieces as it needs.  No rows: no rows.  Other columns are not read.
    """
    return pack(stored(pieces(docs, vocabulary, capacity, end_id), "pieces-cut"), capacity)
