"""Hits and controls paired one after the other, without reuse, in one pass over groups that lie sorted in their tasks.

Hits are served in hash order, and each takes the nearest control that is left: the outcome depends on the order, so a
group is one sweep.  What makes it cheap is a next-free structure: distinct places with controls form two chains of
pointers, one to the left and one to the right, and a place that has run out points past itself.  Finding the nearest
free place and taking it cost almost constant time, so a group of n rows takes about n log n steps for sorting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema


class Free:
    """Controls that are left, by place; of those at one place the one with the smallest tie goes first."""

    def __init__(self, at: np.ndarray, tie: np.ndarray):
        order = np.lexsort((tie, at))
        self._at, self._tie = at[order], tie[order]
        self.places, self._head = np.unique(self._at, return_index=True)
        self._end = np.append(self._head[1:], len(self._at))
        self._head = self._head.copy()
        n = len(self.places)
        # Place k is k + 1 in the chains; 0 and n + 1 are the ends.
        self._left, self._right = list(range(n + 2)), list(range(n + 2))

    @staticmethod
    def _find(chain: list[int], k: int) -> int:
        root = k
        while chain[root] != root:
            root = chain[root]
        while chain[k] != root:
            chain[k], k = root, chain[k]
        return root

    def take(self, at) -> object | None:
        """The nearest place that has a control left, which is taken; of two equally near ones that with the smaller tie."""
        k = int(np.searchsorted(self.places, at, side="right"))  # the last place at or before `at`, as chains number them
        left, right = self._find(self._left, k), self._find(self._right, min(k + 1, len(self.places) + 1))
        options = [x - 1 for x in (left, right) if 0 < x <= len(self.places)]
        if not options:
            return None
        best = min(options, key=lambda x: (abs(self.places[x] - at), self._tie[self._head[x]], self.places[x]))
        self._head[best] += 1
        if self._head[best] == self._end[best]:
            self._left[best + 1], self._right[best + 1] = best, best + 2
        return self.places[best]


def swept(rows: DataFrame, group: list[str], work: Callable[[dict[str, np.ndarray]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """work() over the rows of each group, which holds one group's columns at a time: one exchange, groups sorted in their parts."""
    out_schema = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = [c for c in rows.columns if c not in group]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held)
                out = work({c: own.astype(str) if (own := whole[c].to_numpy()).dtype == object else own for c in columns})
                size = len(next(iter(out.values())))
                if size:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name] if f.name in out else [key[group.index(f.name)]] * size, f.type) for f in out_schema], schema=out_schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.Table.from_batches([batch]).select(group).to_pydict()
            own = list(zip(*(keys[c] for c in group), strict=True))
            starts = [0, *(k for k in range(1, len(own)) if own[k] != own[k - 1]), len(own)]
            for first, last in zip(starts, starts[1:], strict=False):
                if own[first] != key:
                    yield from done()
                    key, held = own[first], []
                held.append(batch.slice(first, last - first))
        yield from done()

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(sweep, schema)


def _served(group: np.ndarray, at: np.ndarray, hit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the hits that got a control, and its place, for rows that lie by group (numbered from 0) and turn.

    All groups are worked on together; Python runs once a hit.  Chains as in Free, a group's places between its two ends.
    """
    values, rank = np.unique(at, return_inverse=True)
    code = group * len(values) + rank
    controls = np.flatnonzero(~hit)
    controls = controls[np.lexsort((turn[controls], code[controls]))]
    places, head = np.unique(code[controls], return_index=True)
    if not len(places):
        return np.empty(0, np.int64), values[:0]
    of = places // len(values)
    hits = np.flatnonzero(hit)
    # Group g's place k, of all places, is node k + 2 g + 1; the nodes before and after a group's places are its ends.
    firsts = np.searchsorted(of, np.arange(int(group[-1]) + 2))
    node = np.arange(len(places)) + 2 * of + 1
    size = len(places) + 2 * int(group[-1]) + 2
    where, first, end = np.zeros(size, at.dtype), np.zeros(size, np.int64), np.zeros(size, np.int64)
    where[node], first[node], end[node] = values[places % len(values)], head, np.append(head[1:], len(controls))
    where, first, end, turns = where.tolist(), first.tolist(), end.tolist(), turn[controls].tolist()
    left, right = list(range(size)), list(range(size))
    own = group[hits]
    begin = np.searchsorted(places, code[hits], side="right") + 2 * own  # the last place at or before the hit, or the end before
    found, taken = [], []
    for row, x, k, low, high in zip(hits.tolist(), at[hits].tolist(), begin.tolist(), (firsts[own] + 2 * own).tolist(), (firsts[own + 1] + 2 * own + 1).tolist(), strict=True):
        a, b = Free._find(left, k), Free._find(right, k + 1)
        if a == low:
            if b == high:
                continue
            best = b
        elif b == high:
            best = a
        else:
            before, behind = x - where[a], where[b] - x
            best = a if before < behind or (before == behind and turns[first[a]] < turns[first[b]]) else b
        found.append(row)
        taken.append(where[best])
        first[best] += 1
        if first[best] == end[best]:
            left[best], right[best] = best - 1, best + 1
    return np.array(found, np.int64), np.array(taken, at.dtype)


def nearest_in_turn(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, at, control, distance: each hit of `rows` (group, at, hit, tie), in order of tie, with the nearest other row of its group that is left.

    Spark numbers a group's rows by tie, so ties, which may be long, do not go to Python, and rows that already lie by
    a part of the group are not exchanged again.  A task works on all groups that end in a batch at once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in group), f"at {kinds['at']}", f"control {kinds['at']}", f"distance {kinds['at']}"])
    out_schema = to_arrow_schema(T.StructType.fromDDL(schema))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            at, turn = whole["at"].to_numpy(), whole["turn"].to_numpy()
            found, control = _served(np.cumsum(turn == 1) - 1, at, whole["hit"].to_numpy().astype(bool), turn)
            if len(found):
                own = whole.select([*group, "at"]).take(pa.array(found))
                more = [pa.array(x, out_schema.field("at").type) for x in (control, np.abs(control - at[found]))]
                yield from pa.Table.from_arrays([*own.columns, *more], schema=out_schema).to_batches(10_000)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch["turn"].to_numpy() == 1)
            if len(begins) and (held or begins[-1]):
                yield from done([*held, batch.slice(0, begins[-1])])
                held = []
            held.append(batch.slice(begins[-1]) if len(begins) else batch)
        if held:
            yield from done(held)

    order = ["tie", "at"]
    turn = F.row_number().over(W.Window.partitionBy(*group).orderBy(*order))
    # The window's own order, asked for so that it is certain; Spark does not sort again.
    return rows.withColumn("turn", turn).sortWithinPartitions(*group, *order).select(*group, "at", "hit", "turn").mapInArrow(sweep, schema)


def pairs_in_turn(rows: DataFrame, game: str, pairs: str) -> DataFrame:
    """game, pair, hit, control: pairs of `rows` (game, side, band, turn, at, hit, tie, and how many the game may have).

    Bands take turns in the order of `turn`; a band gives its next hit, by tie, for which a control of its side and band
    is left.  A game stops once it has as many pairs as it may have, so it looks at few of its hits.  hit and control are
    the rows' `row` values.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pair(own: dict[str, np.ndarray]) -> dict[str, list]:
        hit, most = own["hit"].astype(bool), int(own[pairs][0])
        waiting, free, by_place = {}, {}, {}
        side = np.unique(own["side"], return_inverse=True)[1]
        for turn in np.unique(own["turn"]):
            here = own["turn"] == turn
            mine = np.flatnonzero(here & hit)
            waiting[turn] = iter(mine[np.lexsort((own["at"][mine], own["tie"][mine]))].tolist())
            for s in np.unique(side[here]):
                controls = np.flatnonzero(here & ~hit & (side == s))
                free[turn, s] = Free(own["at"][controls], own["tie"][controls])
                by_place[turn, s] = {}
                for k in controls[np.lexsort((own["tie"][controls], own["at"][controls]))].tolist():
                    by_place[turn, s].setdefault(own["at"][k], []).append(k)
        found: list[tuple] = []
        while waiting and len(found) < most:
            for turn in sorted(waiting):
                for k in waiting[turn]:
                    at = free[turn, side[k]].take(own["at"][k])
                    if at is not None:
                        found.append((len(found), own["row"][k], own["row"][by_place[turn, side[k]][at].pop(0)]))
                        break
                else:
                    del waiting[turn]
                if len(found) == most:
                    break
        return dict(zip(("pair", "from", "to"), map(list, zip(*found, strict=True)) if found else ([], [], []), strict=True))

    out = swept(rows, [game], pair, f"{game} {kinds[game]}, pair int, from {kinds['row']}, to {kinds['row']}")
    return out.select(game, "pair", F.col("from").alias("hit"), F.col("to").alias("control"))
