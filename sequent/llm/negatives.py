"""Hard-negative mining by Fagin's threshold algorithm.

Scores are inner products of whole-number vectors.  Candidates are cut into blocks, and a block has a sorted list of its
candidates for each dimension.  An anchor reads the lists from the end that its component's sign makes the better one
(a zero component's list is not read), step by step in all dimensions at once.  A candidate that turns up in any list
is scored whole.  What no list has shown yet scores the anchor's product with the last values read at most: the
threshold.  An anchor's windows (a low, a high, the k best between them) are done once the threshold falls strictly
below their k-th score, so that ties are seen too, or below their low end.

First an anchor's positives are sought among the rows of its label, then its windows among all rows.  Anchors come in
slabs, and each pair of a block and a slab is a piece of work of its own, so no task holds a whole label.  Between a
block and a slab only each window's k best are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.llm.codes import finite, whole_numbers
from sequent.llm.shared import stored

#: Whole numbers are held within this size, so that scores of up to 32,768 components fit 64 bits.
LARGEST = 1 << 24
#: Entries of each list that are read in the first step; every further step doubles what has been read.
FIRST = 16


class Lists:
    """A block's candidates (whole-number vectors, ids) in a sorted list for each dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self._ids, n = ids, len(x)
        self._order = x.argsort(0, kind="stable")
        self._values = np.take_along_axis(x, self._order, 0)
        self._depths = sorted({min(FIRST << k, n) for k in range(max(1, n.bit_length()))})
        self._x = x

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """What an unseen candidate can score for each anchor: before the first step, and after each of them."""
        n = len(self._x)
        last = np.array([1, *self._depths])
        return np.maximum(anchors, 0) @ self._values[n - last].T + np.minimum(anchors, 0) @ self._values[last - 1].T

    def search(self, anchor: np.ndarray, threshold: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) its k best allowed candidates: places in the block and scores, best first, ties by id."""
        n, up, down = len(self._x), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, before = np.zeros(n, bool), 0
        places, scores = np.zeros(0, np.int64), np.zeros(0, self._x.dtype)
        live = threshold[0] >= low
        for step, depth in enumerate(self._depths, 1):
            if not live.any():
                break
            shown = np.zeros(n, bool)
            shown[self._order[n - depth : n - before, up]] = True
            shown[self._order[before:depth, down]] = True
            if not len(up) and not len(down):
                shown[:] = True  # an anchor of zeros scores 0 with all
            new = np.flatnonzero(shown & ~seen)
            seen |= shown
            before = depth
            new_scores = self._x[new] @ anchor
            fit = allowed[new] & (new_scores >= low.min()) & (new_scores <= high.max())
            places, scores = np.concatenate([places, new[fit]]), np.concatenate([scores, new_scores[fit]])
            for w in np.flatnonzero(live):
                inside = scores[(scores >= low[w]) & (scores <= high[w])]
                kth = np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else None
                live[w] = threshold[step] >= low[w] and (kth is None or threshold[step] >= kth)
        found = []
        for first, last in zip(low, high, strict=True):
            own = np.flatnonzero((scores >= first) & (scores <= last))
            best = own[np.lexsort((self._ids[places[own]], -scores[own]))][:k]
            found.append((places[best], scores[best]))
        return found


def whole(vectors: pa.ChunkedArray, scale: int) -> np.ndarray:
    return whole_numbers(vectors.combine_chunks(), scale, LARGEST)


def candidates(left: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, ids, place of each row's label) of a block; rows that repeat id and label count once, with the smallest vector."""
    x, ids = whole(left["vector"], scale), left["vec_id"].to_numpy()
    label = np.unique(left["label"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.lexsort((*x.T[::-1], label, ids))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(ids[order]) != 0) | (np.diff(label[order]) != 0)
    return x[order[first]], ids[order[first]], label[order[first]]


def exact(x: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As doubles where all products and sums of them stay under 2^53, else as they are."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(a).max(initial=0)) * x.shape[1]
    return (x.astype(np.float64), a.astype(np.float64)) if most < 1 << 53 else (x, a)


def positives_in(k: int, scale: int):
    """A block of a label's rows and a slab of its anchors -> each anchor's k best other rows."""

    def seek(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            x, ids, _ = candidates(left, scale)
            x, a = exact(x, whole(right["vector"], scale))
            lists, anchor_ids = Lists(x, ids), right["vec_id"].to_numpy()
            bounds, all_scores = lists.thresholds(a), (np.array([-np.inf]), np.array([np.inf]))
            for i, (own, at) in enumerate(zip(anchor_ids, right["at"].to_numpy(), strict=True)):
                ((places, scores),) = lists.search(a[i], bounds[i], ids != own, *all_scores, k)
                for held, new in zip(out, (np.full(len(places), at), ids[places], scores), strict=True):
                    held.append(new.astype(np.int64))
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *held]) for c, held in zip(("at", "positive_id", "positive_score"), out, strict=True)})

    return seek


def negatives_in(k: int, low: int, high: int, scale: int):
    """A block of rows and a slab of anchors with their positives' scores -> the k best of other labels in each window."""

    def seek(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            x, ids, label = candidates(left, scale)
            known = {v: n for n, v in enumerate(np.unique(left["label"].to_numpy(zero_copy_only=False)).tolist())}
            x, a = exact(x, whole(right["vector"], scale))
            lists = Lists(x, ids)
            bounds = lists.thresholds(a)
            for i, (at, own_label, windows) in enumerate(zip(right["at"].to_pylist(), right["label"].to_pylist(), right["scores"].to_pylist(), strict=True)):
                score = np.array(windows, np.int64)
                found = lists.search(a[i], bounds[i], label != known.get(own_label, -1), -(-low * score // 100), high * score // 100, k)
                for (places, scores), of in zip(found, windows, strict=True):
                    for held, new in zip(out, (np.full(len(places), at), np.full(len(places), of), ids[places], scores), strict=True):
                        held.append(new.astype(np.int64))
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *held]) for c, held in zip(("at", "positive_score", "negative_id", "negative_score"), out, strict=True)})

    return seek


def pieces(rows: DataFrame, anchors: DataFrame, keys: list[str], block: int, slab: int):
    """Blocks of rows and slabs of anchors, grouped for each pair of them that has equal keys; and the number of pairs."""
    stock = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    stock = stored(stock.join(anchors.groupBy(*keys).agg(F.ceil(F.count("*") / slab).cast("int").alias("slabs")), keys), "pieces")
    number = stock.agg(F.sum(F.col("blocks").cast("long") * F.col("slabs"))).first()[0] or 0
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(stock, keys).withColumn("b", place("blocks")).withColumn("s", every("slabs")).drop("blocks", "slabs")
    right = anchors.join(stock, keys).withColumn("s", place("slabs")).withColumn("b", every("blocks")).drop("blocks", "slabs")
    parts, split = max(1, min(2 * number, 16_384)), [*keys, "b", "s"]
    return left.repartition(parts, *split).groupBy(*split).cogroup(right.repartition(parts, *split).groupBy(*split))


def best(found: DataFrame, of: list[str], score: str, then: str, k: int) -> DataFrame:
    """The k best rows of each group of at most k rows a block, with their place from 1."""
    place = F.row_number().over(W.Window.partitionBy(*of).orderBy(F.col(score).desc(), then))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = 4_096, slab: int = 1_024, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its `positives` best other rows of the same label; for each of them the `negatives` best
    rows of other labels whose score is from low % to high % of the positive's score (none if that is negative).
    Higher scores come first, ties by the smaller vec_id; all, if there are fewer.
    A row takes no part, on either side, if its id, label or vector is null or the vector holds a null or non-finite
    component or none at all.  Rows that repeat vec_id and label count once, with the smallest vector; with another
    label they are other rows, but a row of the anchor's vec_id is never its positive.  Vectors of different lengths
    are not compared.  Scaled components are held within 2^24 in size.  No rows or no anchors: no rows.  Other columns
    are not read, whatever their names.
    """
    def fit(df: DataFrame) -> DataFrame:
        usable = df.where(finite(embedding) & F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(embedding) > 0))
        return usable.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.size(embedding).alias("d"), F.col(embedding).alias("vector"))

    held = fit(rows)
    numbers = F.transform("vector", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    asked = fit(anchors).groupBy("vec_id", "label", "d").agg(F.min_by("vector", numbers).alias("vector"))
    asked = stored(asked.withColumn("at", F.monotonically_increasing_id()), "anchors")

    near = pieces(held, asked, ["label", "d"], block, slab).applyInArrow(positives_in(positives, scale), "at long, positive_id long, positive_score long")
    near = stored(best(near, ["at"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    # Positives of one score have one window.
    windows = near.where("positive_score >= 0").groupBy("at").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    found = pieces(held, asked.join(windows, "at"), ["d"], block, slab).applyInArrow(negatives_in(negatives, low, high, scale), "at long, positive_score long, negative_id long, negative_score long")
    found = best(found, ["at", "positive_score"], "negative_score", "negative_id", negatives)
    return near.join(found, ["at", "positive_score"]).join(asked.select("at", F.col("vec_id").alias("anchor_id")), "at").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
