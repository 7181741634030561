"""Vector code compression: product codes whose codebooks come from member-resident Lloyd rounds.

A vector of whole numbers is cut into parts, and each part position has a codebook.  The members of an entry live in
tables dealt by (position, entry, salt); the salts of an entry follow the number of its members, so that an entry that
holds a third of all parts is dealt like many.  A round reads the members where they are.  Owners add up the members
that stay; only the members whose nearest entry has changed are written out, added up for their new owner and dealt to
it in the next shuffle.  A stored member is not rewritten and not marked when it leaves: whether it still lives where it
was dealt follows from the codebooks since (a few kilobytes), which every task has.  So a round shuffles and writes
what moved and nothing else, and any lost piece can be computed again from stored tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequent.llm.shared import stored

#: Whole numbers are held within this size, so that squared distances and their sums stay exact in 64 bits.
LARGEST = 1 << 27
#: Members that an owner has at most: an entry with more of them has more salts.
OWNED = 16_384
#: Members that a table's part holds on average: some owners each.
TOGETHER = 131_072


def finite(embedding: str) -> Column:
    """Whether the vector is there and holds neither null nor non-finite components."""
    v = F.col(embedding)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole_numbers(vectors: pa.Array, scale: int, largest: int = LARGEST) -> np.ndarray:
    """floor(scale * x) of every component of vectors of one length, one row a vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(scale * flat), -largest, largest).astype(np.int64).reshape(len(vectors), -1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest row of the codebook, the lower index among ties, and the squared distance."""
    entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    small = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0))) ** 2 * 4 * x.shape[1] < 1 << 53
    kind = np.float64 if small else np.int64  # products of doubles are exact while they stay under 2^53
    for at in range(0, len(x), 1 << 14):
        own, c = x[at : at + (1 << 14)].astype(kind), book.astype(kind)
        distance = (own * own).sum(1)[:, None] - 2 * (own @ c.T) + (c * c).sum(1)
        best = distance.argmin(1)
        entry[at : at + (1 << 14)], error[at : at + (1 << 14)] = best, distance[np.arange(len(own)), best].astype(np.int64)
    return entry, error


def columns_of(width: int) -> list[str]:
    return [f"x{i}" for i in range(width)]


def table_of(position, entry, n, x: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    own = {"position": pa.array(position.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), **{k: pa.array(v) for k, v in more.items()}, "n": pa.array(n.astype(np.int64))}
    return pa.RecordBatch.from_pydict(own | {c: pa.array(np.ascontiguousarray(x[:, i])) for i, c in enumerate(columns_of(x.shape[1]))})


def added(position: np.ndarray, entry: np.ndarray, x: np.ndarray, total: np.ndarray) -> None:
    """Adds numbers (place 0: how many, then the sums) to total[position, entry]."""
    np.add.at(total, (position, entry), np.column_stack([np.ones(len(x), np.int64), x]))


def sums_schema(width: int, more: str = "") -> str:
    return f"position int, entry int, {more}n long, " + ", ".join(f"{c} long" for c in columns_of(width))


def first_dealt(vectors: DataFrame, book: np.ndarray, scale: int, salts: np.ndarray | None) -> DataFrame:
    """Parts at their first owners, one row a part with its salt; without salts: the sums for each owner, a row a task and owner."""
    parts, _, width = book.shape

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((*book.shape[:2], width + 1), np.int64), 0
        for batch in batches:
            x = whole_numbers(batch["vector"], scale).reshape(batch.num_rows, parts, width)
            for p in range(parts):
                entry, _ = nearest(x[:, p], book[p])
                if salts is None:
                    added(np.full(len(x), p), entry, x[:, p], total)
                else:
                    salt = ((seen + np.arange(len(x))) % salts[p][entry]).astype(np.int32)
                    yield table_of(np.full(len(x), p), entry, np.ones(len(x)), x[:, p], salt=salt)
            seen += batch.num_rows
        if salts is None:
            yield from totals(total)

    return vectors.mapInArrow(deal, sums_schema(width, "" if salts is None else "salt int, "))


def totals(total: np.ndarray, **more) -> Iterator[pa.RecordBatch]:
    p, e = np.nonzero(total[:, :, 0])
    if len(p):
        yield table_of(p, e, total[p, e, 0], total[p, e, 1:], **{k: np.full(len(p), v) for k, v in more.items()})


def moved(members: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """One round over the members dealt at one time, books being the codebooks since; the last one decides now.

    A row for each member that changes its entry (moves: true), and for each owner the sums of those that stay.
    """
    parts, entries, width = books[0].shape

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            position, entry = batch["position"].to_numpy(), batch["entry"].to_numpy().astype(np.int64)
            x = np.column_stack([batch[c].to_numpy() for c in columns_of(width)])
            for p in np.unique(position):
                own = np.flatnonzero(position == p)
                for book in books[:-1]:  # those that left in an earlier round live elsewhere since
                    own = own[nearest(x[own], book[p])[0] == entry[own]]
                now, _ = nearest(x[own], books[-1][p])
                stays = now == entry[own]
                added(position[own[stays]], now[stays], x[own[stays]], total)
                go = own[~stays]
                if len(go):
                    yield table_of(position[go], now[~stays], np.ones(len(go)), x[go], moves=np.ones(len(go), bool))
        yield from totals(total, moves=False)

    return members.select("position", "entry", *columns_of(width)).mapInArrow(judge, sums_schema(width, "moves boolean, "))


def owner_sums(rows: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums for each owner, in exact whole numbers, of all rows and of those that move: two rows an owner at most."""
    parts, entries, width = shape
    total, arrivals = (np.zeros((parts, entries, width + 1), object) for _ in range(2))
    sums = (F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *columns_of(width)))
    for r in rows.groupBy("position", "entry", "moves").agg(*sums).collect():
        own = np.array([int(r[c]) for c in ("n", *columns_of(width))], object)
        total[r["position"], r["entry"]] += own
        if r["moves"]:
            arrivals[r["position"], r["entry"]] += own
    return total, arrivals


def updated(book: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Every entry with members becomes the floor of their mean; the others stay."""
    new = book.copy()
    for p, e in zip(*np.nonzero(total[:, :, 0]), strict=True):
        new[p, e] = [s // total[p, e, 0] for s in total[p, e, 1:]]
    return new


def salts_for(total: np.ndarray, entries: int) -> np.ndarray:
    """Salts of each owner: it holds no more than an even share of its position's members, and OWNED at most."""
    counts = total[:, :, 0].astype(np.int64)
    share = np.minimum(OWNED, np.maximum(1, -(-counts.sum(1, keepdims=True) // entries)))
    return np.maximum(1, -(-counts // share))


def dealt(rows: DataFrame, number: int) -> DataFrame:
    """So many members at their owners: the shuffle by (position, entry, salt)."""
    return rows.repartition(min(-(-number // TOGETHER), 16_384), "position", "entry", "salt").drop("salt", "n")


def learned(vectors: DataFrame, book: np.ndarray, rounds: int, scale: int) -> np.ndarray:
    """The codebooks after the rounds, from vectors of one length and the first codebooks (positions, entries, width)."""
    entries, width = book.shape[1:]
    total, _ = owner_sums(first_dealt(vectors, book, scale, None).withColumn("moves", F.lit(False)), book.shape)
    books, members = [book, updated(book, total)], []
    kept = [c for c in ("position", "entry", *columns_of(width))]
    salts = salts_for(total, entries)
    if rounds > 1:
        members.append(stored(dealt(first_dealt(vectors, book, scale, salts), int(total[:, :, 0].sum())).select(*kept), "members"))
    for k in range(1, rounds):
        # Members dealt in round g have the codebooks g + 1 to k since; all of them are judged by the last.
        judged = reduce(DataFrame.unionByName, [moved(m, books[g + 1 : k + 1]) for g, m in enumerate(members)])
        judged = stored(judged, "moved")
        total, arrivals = owner_sums(judged, book.shape)
        books.append(updated(books[-1], total))
        if not arrivals[:, :, 0].sum():
            return books[-1]  # nothing moved, so nothing will
        if k + 1 < rounds:
            salts = salts_for(arrivals, entries)
            number = F.element_at(F.array(*(F.array(*(F.lit(int(s)) for s in row)) for row in salts)), F.col("position") + 1)
            salt = F.pmod(F.monotonically_increasing_id(), F.element_at(number, F.col("entry") + 1)).cast("int")
            members.append(stored(dealt(judged.where("moves").withColumn("salt", salt), int(arrivals[:, :, 0].sum())).select(*kept), "members"))
    return books[-1] if rounds else book


def encoded(rows: DataFrame, book: np.ndarray, scale: int) -> DataFrame:
    """vec_id, label, code, error of rows (vec_id, label, vector) of one length: a pass without any shuffle."""
    parts, _, width = book.shape
    label = rows.schema["label"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch["vector"], scale).reshape(batch.num_rows, parts, width)
            found = [nearest(x[:, p], book[p]) for p in range(parts)]
            entry = np.column_stack([e for e, _ in found]).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "label": batch["label"], "code": pa.array([e.tobytes().hex() for e in entry], pa.string()), "error": pa.array(sum(d for _, d in found))})

    return rows.mapInArrow(encode, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long")


def first_book(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The parts of the rows with the smallest vec_ids: (positions, entries, width); None if their vectors can't be cut."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()  # `entries` rows
    if not first or not len(first[0]["vector"]) or len(first[0]["vector"]) % parts:
        return None
    own = [r["vector"] for r in first if len(r["vector"]) == len(first[0]["vector"])]
    x = whole_numbers(pa.array(own, pa.list_(pa.float64())), scale)
    return np.ascontiguousarray(x.reshape(len(own), parts, -1).transpose(1, 0, 2))


def vector_codes(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row with a usable vector.

    A row whose vector is null or holds a null or non-finite component is dropped; zeros are usable.  The codebooks
    begin with the rows of the smallest vec_ids (null ids last, ties by vector); with fewer rows they have fewer
    entries.  Rows that repeat a vec_id are rows of their own, in this and in the means.  All vectors have the length
    of the first of those rows: a row of another length has neither code nor error (null), and no row has one if that
    length is not a multiple of `parts` (codebooks_sha256 is then that of no text).  label_error adds up the errors of
    equal labels, null labels together.  Scaled components are held within 2^27 in size.  entries is 256 at most.
    No rows: no rows.  Other columns are not read, whatever their names.
    """
    kept = rows.where(finite(embedding)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    book = first_book(kept, parts, entries, scale)
    alone = F.lit(True)
    if book is not None:
        fits = F.size("vector") == book.shape[0] * book.shape[2]
        book, alone = learned(kept.where(fits).select("vector"), book, rounds, scale), ~fits
    coded = kept.where(alone).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if book is not None:
        coded = encoded(kept.where(fits), book, scale).unionByName(coded)
    coded = stored(coded, "codes")
    digest = hashlib.sha256(",".join(map(str, (book if book is not None else np.zeros(0, int)).ravel().tolist())).encode()).hexdigest()
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
