"""Exact top-k search among binary codes by incremental multi-index hashing.

A code of 64 bits is cut into m substrings.  The index holds every distinct code once per substring, dealt by
(substring, leading bits of its value): a cell.  At radius s a query probes, for each substring, the values that are s
bits off its own: it visits the cells whose leading bits are j <= s bits off, and looks up the rest of the value s - j
bits off inside.  After radius s every code within m (s + 1) - 1 bits is known, since a further one has more than s bits
off in each substring.  The small radii, which have few values, are one round, and every further radius is a round.  Candidates are verified on the whole code, the k best so far of each query are kept in a table
between rounds, and a query stops once its k-th verified distance is covered.  A query starts with the k-th distance
among a block of the first substring's cell it lies in: an upper bound, beyond which nothing is reported.  Cells with many codes or many visits are
cut into blocks and slabs, so that a piece of work is bounded whatever the codes look like.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.llm.neardup import usable
from sequent.llm.shared import stored

BITS = 64


def sign_code(vector: Column) -> Column:
    """Bit i is set if component i of the first 64 is positive."""
    bits = [F.shiftleft((F.get(vector, F.lit(i)) > 0).cast("long"), i) for i in range(BITS)]
    code = F.coalesce(bits[0], F.lit(0).cast("long"))
    for bit in bits[1:]:
        code = code.bitwiseOR(F.coalesce(bit, F.lit(0).cast("long")))
    return code


def flips(width: int, radius: int) -> np.ndarray:
    """All values with `radius` of `width` bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


def parts_of(codes: np.ndarray, substrings: int) -> list[np.ndarray]:
    width = BITS // substrings
    return [((codes >> np.uint64(t * width)) & np.uint64((1 << width) - 1)).astype(np.int64) for t in range(substrings)]


def placed(index: DataFrame, substrings: int, lead: int) -> DataFrame:
    """(code, first, t, cell) for each substring of each code."""
    width = BITS // substrings
    cells = [F.struct(F.lit(t).alias("t"), F.shiftrightunsigned("code", t * width + width - lead).bitwiseAND(F.lit((1 << lead) - 1)).cast("int").alias("cell")) for t in range(substrings)]
    return index.select("code", F.get("ids", F.lit(0)).alias("first"), F.explode(F.array(*cells)).alias("p")).select("code", "first", "p.t", "p.cell")


def rounds(width: int, together: int = 1024) -> list[list[int]]:
    """The radii of each round: the first ones as long as they have `together` values at most, then one by one."""
    first = [s for s in range(width + 1) if sum(comb(width, r) for r in range(s + 1)) <= together] or [0]
    return [first, *([s] for s in range(len(first), width + 1))]


def visits(live: DataFrame, substrings: int, lead: int, radii: list[int]) -> DataFrame:
    """(code, within, t, cell, radius, left) for each cell that a query visits; left: bits that are off inside."""
    width = BITS // substrings
    masks = [(m, s, s - j) for s in radii for j in range(max(0, s - (width - lead)), min(s, lead) + 1) for m in flips(lead, j).tolist()]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, radius, left = (np.array(x, np.int64) for x in zip(*masks, strict=True))
        for batch in batches:
            step = max(1, (1 << 20) // len(mask))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                code = part["code"].to_numpy()
                for t, own in enumerate(parts_of(code.view(np.uint64), substrings)):
                    cell = (own >> (width - lead))[:, None] ^ mask
                    n = len(mask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(code, n)), pa.array(np.repeat(part["within"].to_numpy(), n)), pa.array(np.full(cell.size, t, np.int32)), pa.array(cell.ravel().astype(np.int32)), *(pa.array(np.tile(x, len(code)).astype(np.int32)) for x in (radius, left))],
                        names=["code", "within", "t", "cell", "radius", "left"],
                    )

    return live.select("code", "within").mapInArrow(visit, "code long, within int, t int, cell int, radius int, left int")


def looked_up(substrings: int, lead: int, k: int):
    """A piece's codes and visits -> (query, code, first, distance): the k best that the round finds in it for each query.

    Best are the nearest, of one distance those with the smallest first id.  A code is reported at a radius by the first substring that has so many bits off, if none has fewer: so once in all.
    """
    width = BITS // substrings

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query": pa.array([], pa.int64()), "code": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "distance": pa.array([], pa.int32())})
        if not left.num_rows or not right.num_rows:
            return none
        t = left["t"][0].as_py()
        codes = left["code"].to_numpy().view(np.uint64)
        low = parts_of(codes, substrings)[t] & ((1 << (width - lead)) - 1)
        order = np.argsort(low, kind="stable")
        codes, low, first_id = codes[order], low[order], left["first"].to_numpy()[order]
        every, within = right["code"].to_numpy().view(np.uint64), right["within"].to_numpy()
        radius, off = right["radius"].to_numpy(), right["left"].to_numpy()
        own = parts_of(every, substrings)[t] & ((1 << (width - lead)) - 1)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for s, inside in sorted(set(zip(radius.tolist(), off.tolist(), strict=True))):
            mine = np.flatnonzero((radius == s) & (off == inside))
            masks = flips(width - lead, inside)
            probe = len(masks) * 4 <= len(codes)  # else comparing all values is the shorter way to the same matches
            step = max(1, (1 << 20) // (len(masks) if probe else len(codes)))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                if probe:
                    values = (own[some][:, None] ^ masks).ravel()
                    first, last = np.searchsorted(low, values), np.searchsorted(low, values, side="right")
                    size = last - first
                    hit = np.flatnonzero(size)
                    first, size = first[hit], size[hit]
                    query = np.repeat(some[hit // len(masks)], size)
                    place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                else:
                    query, place = np.nonzero(np.bitwise_count(own[some][:, None] ^ low) == inside)
                    query = some[query]
                diff = every[query] ^ codes[place]
                bits = [np.bitwise_count(x) for x in parts_of(diff, substrings)]
                new = sum(b.astype(np.int32) for b in bits) <= within[query]
                for u in range(substrings):
                    if u != t:
                        new &= bits[u] > s if u < t else bits[u] >= s
                query, place, distance = query[new], place[new], np.bitwise_count(diff[new]).astype(np.int32)
                order = np.lexsort((first_id[place], distance, query))
                query, place, distance = query[order], place[order], distance[order]
                best = np.arange(len(query)) - np.searchsorted(query, query) < k
                for held, found in zip(out, (every[query[best]].view(np.int64), codes[place[best]].view(np.int64), first_id[place[best]], distance[best]), strict=True):
                    held.append(found)
        if not out[0]:
            return none
        return pa.table(dict(zip(("query", "code", "first", "distance"), map(np.concatenate, out), strict=True)))

    return look


def nearby(k: int):
    """A block's codes and queries -> (code, within): the k-th distance in the block, all bits if it holds fewer."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, every = left["code"].to_numpy().view(np.uint64), right["code"].to_numpy().view(np.uint64)
        within = np.full(len(every), BITS, np.int32)
        if len(codes) >= k:
            for at in range(0, len(every), 256):
                distance = np.bitwise_count(every[at : at + 256, None] ^ codes)
                within[at : at + 256] = np.partition(distance, k - 1, axis=1)[:, k - 1]
        return pa.table({"code": right["code"], "within": within})

    return scan


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, substrings: int = 4, block: int = 4_096, slab: int = 4_096) -> DataFrame:
    """The k nearest rows of `codes` (id, code) for each row of `queries` (id, code), by Hamming distance.

    Returns query_id, rank (from 1), neighbor_id, distance.  Ties go to the smaller id.  A row is not its own
    neighbour: rows with the query's id are left out.  Rows with a null id or code are left out on both sides, and
    a repeated query is one query.  Fewer than k other rows give fewer neighbours.  No codes or no queries: no rows.
    Other columns are not read, whatever their names.  substrings divides 64.
    Equal codes stand in the index once, with their k + 1 smallest ids (no more of them can be in a result), and
    equal queries are searched once.  A piece of work holds about `block` codes and `slab` visits.
    """
    rows = codes.select("id", "code").where("id is not null and code is not null").distinct()
    few = rows.withColumn("n", F.row_number().over(W.Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    held = stored(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = stored(queries.select("id", "code").where("id is not null and code is not null").distinct(), "queries")
    count, width = held.count(), BITS // substrings
    if not count:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("neighbor_id"), F.lit(0).alias("distance")).limit(0)
    lead = min(width - 1, max(0, (max(count, 1) - 1) // block).bit_length())
    index = stored(placed(held, substrings, lead), "code-cells")
    stock = index.groupBy("t", "cell").agg(F.count("*").alias("codes")).withColumn("blocks", F.ceil(F.col("codes") / block).cast("int"))
    stock = stored(stock, "cells")

    parts = max(1, min(2 * stock.agg(F.sum("blocks")).first()[0], 16_384))
    wanted = min(k + 1, count)  # as many codes hold at least as many ids, and the query's own may be one of them
    one, keys = asked.select("code").distinct(), ["cell", "s"]
    home = placed(one.withColumn("ids", F.array().cast("array<bigint>")), substrings, lead).where("t = 0").select("code", "cell")
    slabs = home.groupBy("cell").agg(F.ceil(F.count("*") / slab).cast("int").alias("slabs"))
    near = index.where("t = 0").join(stock.where("t = 0").select("cell", "blocks"), "cell").where(F.pmod(F.xxhash64("code"), F.col("blocks")) == 0)
    left = near.join(slabs, "cell").select("code", "cell", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("s"))
    right = home.join(slabs, "cell").select("code", "cell", F.pmod(F.xxhash64("code"), F.col("slabs")).cast("int").alias("s"))
    live, best = stored(left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)).applyInArrow(nearby(wanted), "code long, within int"), "live"), None
    for radii in rounds(width):
        seen = visits(live, substrings, lead, radii)
        cells = seen.groupBy("t", "cell").agg(F.count("*").alias("visits")).join(stock, ["t", "cell"])
        cells = cells.withColumn("slabs", F.ceil(F.col("visits") / slab).cast("int"))  # a row a cell
        keys = ["t", "cell", "b", "s"]
        mine = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
        left = index.join(cells.select("t", "cell", "blocks", "slabs"), ["t", "cell"])
        left = left.select("code", "first", "t", "cell", mine.alias("b"), F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("s"))
        right = seen.join(cells.select("t", "cell", "blocks", "slabs"), ["t", "cell"])
        right = right.select("code", "within", "radius", "left", "t", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.pmod(F.xxhash64("code"), F.col("slabs")).cast("int").alias("s"))
        left, right = (x.repartition(parts, *keys).groupBy(*keys) for x in (left, right))
        found = left.cogroup(right).applyInArrow(looked_up(substrings, lead, wanted), "query long, code long, first long, distance int")
        best = found if best is None else best.unionByName(found)
        place = F.row_number().over(W.Window.partitionBy("query").orderBy("distance", "first"))
        best = stored(best.withColumn("place", place).where(F.col("place") <= wanted).drop("place"), "best")
        known = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        within = F.when(F.col("n") >= wanted, F.col("far")).otherwise(BITS)
        within = F.least("within", F.coalesce(within, F.lit(BITS))).cast("int")
        live = live.join(known, F.col("code") == F.col("query"), "left").select("code", within.alias("within"))
        live = stored(live.where(F.col("within") > substrings * (radii[-1] + 1) - 1), "live")
        if live.isEmpty():
            break

    near = best.join(held, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    first = F.row_number().over(W.Window.partitionBy("query").orderBy("distance", "neighbor_id"))
    near = near.withColumn("n", first).where(F.col("n") <= k + 1).drop("n")
    near = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    answers = asked.join(near, asked["code"] == near["query"]).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("id")), 1, k).alias("near"))
    answers = answers.select("query_id", F.posexplode("near").alias("pos", "x"))
    return answers.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def codes_of(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, code) of the rows with a usable vector: the signs of its first 64 components.

    A null or zero vector, one with a null or non-finite component and a row without an id give no code; a shorter
    vector has zeros for the components it lacks.  Repeated rows and ids stay as they are.  No rows: no rows.
    """
    return rows.where(usable(vec_id, embedding)).select(F.col(vec_id).alias("id"), sign_code(F.col(embedding)).alias("code"))
