"""Jaccard join of documents on word shingles by chosen paths.

1. Documents with the same set of shingles are one node.  A node's set is embedded as `SIZE` min-hash tokens, so
   that two nodes share a fraction of tokens near their similarity.
2. In each of a number of runs a node follows the tokens that a hash of (path, token) samples, `branch` of them on
   average, as similar nodes do: nodes on one path form a bucket.  A bucket of over `limit` nodes is split by the
   next sampled token, up to `depth` tokens, unless its nodes are so alike that all of them would follow on; the
   other buckets are brute-forced on their tokens.
   The number of runs follows from the recall asked for at the threshold.
3. A bucket gives links enough to connect the nodes that look similar, not their pairs.  Connected nodes form a
   group, and in each group the exact similarity of all pairs of shingle sets is computed, which finds also pairs
   that no bucket held.
Buckets and groups of over `block` nodes (groups also by the bytes of their sets) are worked on in pairs of blocks, so
no task holds a whole one.  A group of several blocks sends its min-hash tokens round first, and only the nodes that
look like another one of a pair of blocks have their shingle sets fetched for it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequent.llm import words
from sequent.llm.components import components
from sequent.llm.neardup import joined_roots
from sequent.llm.shared import sent_whole, stored

#: Min-hash tokens of a node.
SIZE = 128
#: Bytes (as JSON) of the nodes of groups that are sent whole to the texts; with more of them the texts are shuffled.
SENT = 64 << 20


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `size` words; of fewer words, of them all; of none, nothing."""
    hashes, counts = words.word_hashes(texts)
    runs = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(hashes))):
        runs[: len(hashes) - k] = (runs[: len(hashes) - k] + hashes[k:]) * np.uint64(0x9E3779B97F4A7C15)
    runs = words.mixed(runs)
    found, at = [], 0
    for n in counts.tolist():
        if n >= size:
            found.append(np.unique(runs[at : at + n - size + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)  # an array, as its products may wrap
            for h in hashes[at : at + n]:
                whole = (whole + h) * np.uint64(0x9E3779B97F4A7C15)
            found.append(words.mixed(whole))
        else:
            found.append(hashes[:0])
        at += n
    return found


def min_hashes(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """SIZE 32-bit min-hashes of a set."""
    best = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(best, ((found[at : at + 2048, None] * factors) >> np.uint64(32)).min(0), out=best)
    return best.astype("<u4")


def survival(shared: float, branch: float, depth: int) -> float:
    """The chance that two nodes with a fraction of shared tokens are together on a path of each length up to depth."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-branch * shared * q)
    return q


def sketched(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, h (hash of the text), key (of the shingle set), size (of that set), sketch; documents without a word are left out."""
    factors = np.random.default_rng(seed).integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part["text"].to_pylist(), size)
                full = pa.array([len(s) > 0 for s in sets])
                sets = [s for s in sets if len(s)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sketches = [min_hashes(s, factors).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part["doc_id"].filter(full), part["h"].filter(full), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "h", "key", "size", "sketch"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return hashed.mapInArrow(sketch, "doc_id long, h long, key binary, size long, sketch binary")


def followed(nodes: DataFrame, salts: list[int] | None, branch: float) -> DataFrame:
    """(path, node) one token further: from the run salts on, or from `path` where nodes have one."""
    threshold = np.uint64(int(branch / SIZE * 2**64))
    places = np.arange(SIZE, dtype=np.uint64) << np.uint64(32)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                tokens = words.mixed(np.frombuffer(b"".join(part["sketch"].to_pylist()), "<u4").reshape(-1, SIZE).astype(np.uint64) | places)
                node = part["node"].to_numpy()
                starts = [part["path"].to_numpy().view(np.uint64)] if salts is None else [np.full(len(node), s, np.uint64) for s in salts]
                for start in starts:
                    reached = words.mixed(tokens ^ start[:, None])
                    row, token = np.nonzero(reached < threshold)
                    path = words.mixed(reached[row, token], 1)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[row])], names=["path", "node"])

    return nodes.mapInArrow(follow, "path long, node long")


def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows with `mine` (a block of their key) dealt to all pairs (i, j) of the key's blocks."""
    dealt = rows.withColumn("__blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("__blocks")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    return dealt.withColumn("__p", F.explode(pairs)).withColumn("i", F.col("__p.i")).withColumn("j", F.col("__p.j")).drop("__p", "__blocks")


def likeness(buckets: DataFrame, probes: int = 32) -> DataFrame:
    """(path, likeness): about the mean fraction of tokens that two nodes of a bucket share.

    By tug of war: of signs that a bit of the token gives, the squared sum over a bucket is expected to be the number
    of pairs with equal tokens.  So a bucket costs one aggregate, and no row is made.
    """

    def sign(k: int) -> Column:
        return 1 - 2 * (F.conv(F.hex(F.substring("sketch", 4 * k + 1, 1)), 16, 10).cast("int") % 2)

    sums = buckets.groupBy("path", "rows").agg(*(F.sum(sign(k)).alias(f"s{k}") for k in range(probes)))
    pulls = sum((F.pow(F.col(f"s{k}") / F.col("rows"), F.lit(2.0)) for k in range(probes)), F.lit(0.0))
    return sums.select("path", (pulls / probes).alias("likeness"))


def sides(mine: np.ndarray, i: int, j: int) -> tuple[np.ndarray, slice, slice]:
    """An order of a piece of work's rows, and its left and right rows in it."""
    order = np.argsort(mine, kind="stable")
    if i == j:
        return order, slice(0, len(order)), slice(0, len(order))
    split = int((mine == i).sum())
    return order, slice(0, split), slice(split, len(order))


def shared_tokens(sketches: list[bytes], order: np.ndarray, left: slice, right: slice) -> Iterator[tuple[int, np.ndarray]]:
    """(first left row, how many min-hash tokens some left rows share with all right rows)."""
    tokens = np.frombuffer(b"".join(sketches), "<u4").reshape(-1, SIZE)[order].astype(np.uint16)
    columns = np.ascontiguousarray(tokens[right].T)
    for at in range(left.start, left.stop, 64):
        own = np.ascontiguousarray(tokens[at : min(at + 64, left.stop)].T)
        same = np.zeros((own.shape[1], columns.shape[1]), np.uint8)
        for k in range(SIZE):
            same += own[k][:, None] == columns[k]
        yield at, same


def look_alike(least: float):
    """A bucket's (or pair of blocks') nodes -> links that connect those sharing a fraction `least` of tokens."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        order, left, right = sides(table["mine"].to_numpy(), i, j)
        node = table["node"].to_numpy()[order]
        root = np.arange(len(order))
        for at, same in shared_tokens(table["sketch"].to_pylist(), order, left, right):
            x, y = np.nonzero(same >= least * SIZE)
            root = joined_roots(root, x + at, y + right.start)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": node[far], "b": node[root[far]]})

    return compare


def worth_fetching(least: float):
    """A pair of blocks of a large group -> the nodes in it that share a fraction `least` of tokens with another one."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        grp, i, j = (x.as_py() for x in key)
        order, left, right = sides(table["mine"].to_numpy(), i, j)
        found = np.zeros(len(order), bool)
        for at, same in shared_tokens(table["sketch"].to_pylist(), order, left, right):
            alike = same >= least * SIZE
            if i == j:
                alike[np.arange(len(alike)), np.arange(len(alike)) + at] = False
            found[at : at + len(alike)] |= alike.any(1)
            found[right] |= alike.any(0)
        node = table["node"].to_numpy()[order][found]
        n = len(node)
        return pa.table({"grp": np.full(n, grp, np.int64), "i": np.full(n, i, np.int64), "j": np.full(n, j, np.int64), "mine": table["mine"].to_numpy()[order][found].astype(np.int64), "node": node})

    return compare


def similar(threshold: float):
    """A group's (or pair of blocks') shingle sets -> each node's links, weighted, and links that connect them."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        order, left, right = sides(table["mine"].to_numpy(), i, j)
        node, number = table["node"].to_numpy()[order], table["number"].to_numpy()[order]
        sets = table["shingles"].to_pylist()
        sets = [np.frombuffer(sets[k], "<u8") for k in order]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = times > 1  # only these can be shared
        number_of = np.cumsum(often) - 1
        keep = often[column]
        owner, column = owner[keep], number_of[column[keep]]
        by_column = np.argsort(column, kind="stable")
        owner, column = owner[by_column], column[by_column]
        shared = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
        for low in range(0, int(often.sum()), 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            has = np.zeros((len(sets), 4096), np.float32)
            has[owner[a:b], column[a:b] - low] = 1
            shared += has[left] @ has[right].T
        union = size[left][:, None] + size[right] - shared
        x, y = np.nonzero(shared >= threshold * union - 1e-9)
        y = y + right.start
        if i == j:
            x, y = x[x < y], y[x < y]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, x, number[y])
        np.add.at(links, y, number[x])
        root = joined_roots(np.arange(len(node)), x, y)
        some, far = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"node": np.concatenate([node[some], node[far]]), "links": np.concatenate([links[some], np.zeros(len(far), np.int64)]), "to": pa.array([None] * len(some) + node[root[far]].tolist(), pa.int64())})

    return compare


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999, branch: float = 2.0, depth: int = 4, limit: int = 512, block: int = 1024, block_bytes: int = 16 << 20, seed: int = 0) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, h, class_id, n_links, kept.

    Two documents link if the Jaccard similarity of their sets of `size`-word shingles (words stand between ASCII
    white space, as they are; a text of fewer words has one shingle, all of it) is `threshold` or more; n_links
    counts the other documents a document links with, copies included.  class_id is the smallest doc_id that links
    reach.  One text of each class is kept: the one of the smallest doc_id, null ids last, then smallest h (a hash
    of the text).  Rows alike in doc_id and text are kept or not together.  A null, empty or blank text links with
    nothing and is kept.  A very long text is shingled whole.  No rows: no rows.  Other columns are not read, whatever
    their names.  `block` and `block_bytes` bound the nodes of a group and the bytes of their shingle sets that one
    side of a piece of work holds; they change no result.
    """
    rows = stored(sketched(docs, size, seed), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    grouped = rows.groupBy("key").agg(F.min(place).alias("rep"), F.count("*").alias("number"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = stored(grouped.withColumn("node", F.xxhash64("key")), "nodes")

    spread = math.sqrt(threshold * (1 - threshold) / SIZE)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold - 2 * spread, branch, depth)))
    salts = np.random.default_rng(seed + 1).integers(1, 1 << 63, runs).tolist()
    at, edges = nodes, None
    for level in range(1, depth + 1):
        paths = stored(followed(at.select("node", "sketch") if level == 1 else at, salts if level == 1 else None, branch), "paths")
        counts = paths.groupBy("path").agg(F.count("*").alias("rows")).where("rows > 1")
        met = stored(paths.join(counts, "path").join(nodes.select("node", "sketch"), "node"), "buckets")
        small, large = met.where(F.col("rows") <= limit), met.where(F.col("rows") > limit)
        ready = met
        if level < depth:
            large = large.join(likeness(large), "path")
            ready = small.unionByName(large.where(F.col("likeness") * branch >= 1).drop("likeness"))
            large = large.where(F.col("likeness") * branch < 1)
        work = in_blocks(ready.drop("size"), F.ceil(F.col("rows") / (2 * limit))).drop("rows")
        alike = stored(work.groupBy("path", "i", "j").applyInArrow(look_alike(threshold - 4 * spread), "a long, b long"), "alike")
        edges = alike if edges is None else edges.union(alike)
        at = large.select("path", "node", "sketch")
        if level < depth and at.isEmpty():
            break

    groups = components(edges)
    members = nodes.join(groups, "node").select("node", "number", "size", F.col("component").alias("grp"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.h").alias("rep_h"))
    sizes = stored(members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(8 * F.sum("size") / block_bytes)).alias("blocks")), "group-blocks")
    members = stored(members.join(sizes, "grp").drop("size"), "members")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    texts = texts.join(sent_whole(members, SENT), (texts["h"] == members["rep_h"]) & texts["doc_id"].eqNullSafe(members["rep_id"])).select("grp", "blocks", "node", "number", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = shingle_sets(part["text"].to_pylist(), size)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("grp", "blocks", "node", "number")), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["grp", "blocks", "node", "number", "shingles"])

    sets = stored(texts.mapInArrow(shingled, "grp long, blocks long, node long, number long, shingles binary").dropDuplicates(["node"]), "sets")
    piece = ["grp", "i", "j"]
    large = nodes.select("node", "sketch").join(members.where("blocks > 1").select("grp", "blocks", "node"), "node")
    large = in_blocks(large, F.col("blocks"))
    alike = stored(large.groupBy(*piece).applyInArrow(worth_fetching(threshold - 6 * spread), "grp long, i long, j long, mine long, node long"), "fetched")
    fetched = alike.join(sets.select("node", "number", "shingles"), "node")
    one = F.lit(0).cast("long")
    work = sets.where("blocks = 1").select("grp", one.alias("i"), one.alias("j"), one.alias("mine"), "node", "number", "shingles")
    work = work.unionByName(fetched)
    found = stored(work.groupBy("grp", "i", "j").applyInArrow(similar(threshold), "node long, links long, to long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    base = nodes.select("node", "key", "rep", "number").join(links, "node", "left").join(joined, "node", "left")
    base = base.withColumn("component", F.coalesce("component", "node"))
    classes = base.groupBy("component").agg(F.min("rep").alias("first"))
    per_key = base.join(classes, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("number") - 1).alias("n_links"), "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    linked = rows.select("doc_id", "h", "key").join(per_key, "key").select("doc_id", "h", F.col("first.doc_id").alias("class_id"), "n_links", kept.alias("kept"))
    blank = docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    blank = blank.select("doc_id", F.xxhash64("text").alias("h"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return linked.unionByName(blank)
