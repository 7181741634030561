"""Near duplicates among embeddings by Euclidean p-stable hashing.

Equal vectors are put together first.  Each of L tables has K hashes floor((a.v + b) / width) of the normalised vector,
a drawn from the normal distribution (which is 2-stable) and b from [0, width).  K makes the mean bucket hold about
`load` unrelated vectors at any number of vectors, and L makes a pair at the threshold meet with a chance of `recall`.
In a bucket the cosines of all pairs are computed in double precision.  A pair that meets in several buckets counts in
the first table only, which both vectors' hashes tell; they are computed again where there is a pair, and as they are
sums of whole numbers they are the same everywhere.  Buckets over `block` vectors are split into blocks, and each pair
of blocks is a piece of work of its own, so that no task holds a whole hot bucket.  Pairs are not written: a piece of
work gives each vector's number of links, and links enough to connect them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequent.llm.components import components
from sequent.llm.shared import stored


def normal_below(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def meeting(distance: float, width: float) -> float:
    """The chance that one hash puts two vectors of a distance together."""
    if distance == 0:
        return 1.0
    r = width / distance
    return 1 - 2 * normal_below(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, cosine: float, width: float, load: int, recall: float) -> tuple[int, int]:
    """Hashes a table, and tables."""
    far, near = meeting(math.sqrt(2), width), meeting(math.sqrt(2 - 2 * cosine), width)
    k = max(2, math.ceil(math.log(max(n, 2) / load) / -math.log(far))) if n > load else 2
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def usable(vec_id: str, embedding: str):
    """Whether a row can link: it has an id, and its vector no null, no non-finite component and not zeros only."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vec_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector of doubles) of the rows that can link."""
    return rows.where(usable(vec_id, embedding)).select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))


def normalised(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


#: Binary places that vectors and directions are rounded to before they are hashed.
FINE, COARSE = 24, 12


class Tables:
    """The hashes of vectors of d components; a bucket is a 64-bit mix of its table's K cells."""

    def __init__(self, d: int, k: int, tables: int, width: float, seed: int):
        draw = np.random.default_rng([seed, d])
        self.k, self.tables = k, tables
        self._a = np.rint(draw.standard_normal((d, tables * k)) * (1 << COARSE))
        self._width = float(round(width * (1 << (FINE + COARSE))))
        self._b = np.rint(draw.uniform(0, self._width, tables * k))
        self._mix = draw.integers(1, 1 << 62, (tables, k), dtype=np.int64) | 1

    def buckets(self, unit: np.ndarray, first: int, last: int) -> np.ndarray:
        """Bucket of each vector in the tables from first up to last: exact, as all sums are of whole numbers under 2^53."""
        own = slice(first * self.k, last * self.k)
        cells = np.floor((np.rint(unit * (1 << FINE)) @ self._a[:, own] + self._b[own]) / self._width).astype(np.int64)
        keys = (cells.reshape(len(unit), last - first, self.k) * self._mix[first:last]).sum(2)
        return keys ^ (keys >> 29)


def near_duplicates(rows: DataFrame, cosine: float = 0.9, recall: float = 0.99, width: float = 2.0, load: int = 8_192, block: int = 16_384, seed: int = 0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row of `rows`: vec_id, n_links, component_id, kept.

    Two rows link if their cosine is `cosine` or more; n_links counts the other rows a row links with, and
    component_id is the smallest vec_id that links reach.  A vector that is null or zero or holds a null or
    non-finite component links with nothing, and vectors of different lengths do not link.  Rows that repeat a
    vec_id are rows of their own: they link if their vectors do.  A row with a null vec_id links with nothing.
    No rows: no rows.  Other columns are not read, whatever their names.
    """
    kind = "<f4" if rows.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    vectors = valid_vectors(rows, vec_id, embedding)
    alike = stored(vectors.withColumn("key", F.sha2(F.array_join("vector", ","), 256)), "vectors")
    groups = alike.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("number"), F.first("vector").alias("vector"))
    groups = stored(groups.withColumn("node", F.xxhash64("key")), "directions")
    sizes = groups.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()  # a row for each vector length
    dims = {r["d"]: tables_for(r["n"], cosine, width, load, recall) for r in sizes}
    parts = max(1, min(16_384, sum(r["n"] * dims[r["d"]][1] for r in sizes) // load))

    def hashed(whole: bool):
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute as pc

            for batch in batches:
                for d, (k, tables) in dims.items():
                    own = batch.filter(pc.equal(pc.list_value_length(batch["vector"]), d))
                    hashes = Tables(d, k, tables, width, seed)
                    for at in range(0, own.num_rows, 512):
                        part = own.slice(at, 512)
                        n = part.num_rows
                        v = part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(n, d)
                        unit = normalised(v)
                        raw = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary()) if whole else None
                        for tab in range(tables):  # a batch a table: its vectors are written once in it
                            found = {"d": pa.array(np.full(n, d, np.int32)), "tab": pa.array(np.full(n, tab, np.int32)), "bucket": pa.array(hashes.buckets(unit, tab, tab + 1)[:, 0])}
                            if whole:
                                found |= {"node": part["node"], "number": part["number"], "raw": raw}
                            yield pa.RecordBatch.from_pydict(found)

        return places

    keys = ["d", "tab", "bucket"]
    counts = groups.select("vector").mapInArrow(hashed(False), "d int, tab int, bucket long").groupBy(*keys).agg(F.count("*").alias("rows"))
    hot = stored(counts.where(F.col("rows") > block).withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")).drop("rows"), "hot-buckets")
    places = groups.select("node", "number", "vector").mapInArrow(hashed(True), "d int, tab int, bucket long, node long, number long, raw binary")
    shared = places.join(hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    work = shared.withColumn("mine", mine).withColumn("p", F.explode(pairs)).select(*keys, "p.i", "p.j", "mine", "node", "number", "raw")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        d, tab, _, i, j = (x.as_py() for x in key)
        mine = table["mine"].to_numpy()
        order = np.argsort(mine, kind="stable")
        node, number = table["node"].to_numpy()[order], table["number"].to_numpy()[order]
        unit = normalised(np.frombuffer(b"".join(table["raw"].take(pa.array(order)).to_pylist()), kind).reshape(-1, d).astype(np.float64))
        split = len(order) if i == j else int((mine == i).sum())
        right = slice(0, split) if i == j else slice(split, len(order))
        found = Found(unit, number, Tables(d, *dims[d], width, seed), tab, cosine)
        for at in range(0, split, 128):
            found.add(slice(at, min(at + 128, split)), right)
        links, root = found.links, found.root
        some, a = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        return pa.table({
            "node": pa.array(np.concatenate([node[some], node[a]]).astype(np.int64)), "links": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])),
            "to": pa.array([None] * len(some) + node[root[a]].tolist(), pa.int64()),
        })

    split = [*keys, "i", "j"]
    found = stored(work.repartition(parts, *split).groupBy(*split).applyInArrow(compare, "node long, links long, to long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    base = groups.join(links, "node", "left").join(joined, "node", "left").select("node", "key", "rep", "number", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", F.col("node")).alias("component"))
    base = stored(base, "linked")
    lowest = stored(base.groupBy("component").agg(F.min("rep").alias("component_id")), "lowest")
    per_key = base.join(lowest, "component").select("key", (F.col("links") + F.col("number") - 1).alias("n_links"), "component_id")
    linked = alike.select("vec_id", "key").join(per_key, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(vec_id, embedding)).select(F.col(vec_id).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


class Found:
    """Links of a piece of work: their number for each vector, and the lowest vector that each is connected with."""

    def __init__(self, unit: np.ndarray, number: np.ndarray, tables: Tables, tab: int, cosine: float):
        self._unit, self._rough, self._number = unit, unit.astype(np.float32), number
        self._tables, self._tab, self._cosine = tables, tab, cosine
        self._buckets, self._known = np.zeros((len(unit), tab), np.int64), np.zeros(len(unit), bool)
        self.links, self.root = np.zeros(len(unit), np.int64), np.arange(len(unit))

    def add(self, rows: slice, right: slice) -> None:
        """Links between two runs of vectors, of pairs that did not meet in an earlier table; of one run with itself, each pair once."""
        linked = self._rough[rows] @ self._rough[right].T >= np.float32(self._cosine - 1e-4)  # the exact cosine follows
        if right.start == 0:
            linked &= np.arange(right.start, right.stop) > np.arange(rows.start, rows.stop)[:, None]
        x, y = np.nonzero(linked)
        if not len(x):
            return
        if len(x) * 16 > linked.size:
            linked &= self._unit[rows] @ self._unit[right].T >= self._cosine
        else:
            linked[x, y] = np.einsum("ij,ij->i", self._unit[rows][x], self._unit[right][y]) >= self._cosine
        if self._tab:
            new = np.union1d(np.flatnonzero(linked.any(1)) + rows.start, np.flatnonzero(linked.any(0)) + right.start)
            new = new[~self._known[new]]
            self._buckets[new], self._known[new] = self._tables.buckets(self._unit[new], 0, self._tab), True
            for tab in range(self._tab):
                linked &= self._buckets[rows, tab][:, None] != self._buckets[right, tab]
        self.links[rows] += linked @ self._number[right]
        self.links[right] += self._number[rows] @ linked
        x, y = np.nonzero(linked)
        self.root = joined_roots(self.root, x + rows.start, y + right.start)


def joined_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The lowest place that each place is connected with, once x and y are linked too."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while ((up := root[root]) != root).any():
            root = up
