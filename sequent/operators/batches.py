"""Row scores of distributions that stand in arrays, over Arrow batches: one matrix of rows and classes for each system, and nothing exchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores of a row, as metrics.row_scores names them.
SCORES = "p_truth double, above long, tied long, confidence double, brier double, sum_error double, nll double, credit_1 double, credit_3 double, credit_5 double"
MEASURES = (("credit_1", "top_1"), ("credit_3", "top_3"), ("credit_5", "top_5"), ("nll", "nll"), ("brier", "brier"))


def matrix(lists: pa.Array, fill) -> np.ndarray:
    """Lists of a batch as rows of a matrix; what is null or beyond a list's end is `fill`."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    flat = pc.fill_null(flat, fill).to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    inside = np.arange(width) < sizes[:, None]
    found = np.full(inside.shape, fill, flat.dtype)
    found[inside] = flat
    return found


def total(values: np.ndarray) -> np.ndarray:
    """Sums of rows, added from the left."""
    found = np.zeros(len(values))
    for k in range(values.shape[1]):
        found += values[:, k]
    return found


def normalized(weights: np.ndarray) -> np.ndarray:
    """Rows of weights as shares of their sums; all 0 where there is none."""
    sums = total(weights)[:, None]
    return np.divide(weights, sums, out=np.zeros(weights.shape), where=sums > 0)


def softmax(logits: np.ndarray) -> np.ndarray:
    """Softmax of each row, whose NaN (eliminated classes) get 0."""
    live = ~np.isnan(logits)
    top = np.max(np.where(live, logits, -np.inf), axis=1, initial=-np.inf, keepdims=True)
    shifted = np.where(live, logits - np.where(np.isfinite(top), top, 0.0), 0.0)
    return normalized(np.where(live, np.exp(shifted), 0.0))


def scores(p: np.ndarray, there: np.ndarray, hit: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of each row over the classes that are there; hit: which one is the truth.  NaN where a score is null."""
    own = hit & there
    known = own.any(1)
    p_truth = np.max(np.where(own, p, -np.inf), axis=1, initial=-np.inf)
    above = (there & (p > p_truth[:, None]) & known[:, None]).sum(1)
    tied = (there & (p == p_truth[:, None]) & known[:, None]).sum(1)
    classes = there.sum(1)
    off = np.where(there, p - own, 0.0)
    found = {"p_truth": np.where(known, p_truth, np.nan), "above": above, "tied": tied, "confidence": np.where(classes > 0, np.max(np.where(there, p, -np.inf), axis=1, initial=-np.inf), np.nan)}
    found |= {"brier": total(off * off), "sum_error": np.abs(total(np.where(there, p, 0.0)) - 1)}
    massive = known & (p_truth > 0)
    found["nll"] = np.where(massive, -np.log(np.where(massive, p_truth, 1.0)), np.nan)
    for k in (1, 3, 5):
        slots = np.minimum(k, classes) - above
        found[f"credit_{k}"] = np.where(known, np.where(slots <= 0, 0.0, np.minimum(1.0, slots / np.maximum(tied, 1))), np.nan)
    return found


def values_of(batch: pa.RecordBatch, fields: list[str], prefix: str = "") -> dict[str, np.ndarray]:
    """Fields of a batch by name: matrices of those that are lists, a value a row of the others."""
    found = {}
    for f in fields:
        own = batch[prefix + f]
        if pa.types.is_list(own.type):
            found[f] = matrix(own, False if pa.types.is_boolean(own.type.value_type) else np.nan)
        else:
            found[f] = own.to_numpy(zero_copy_only=False)
    return found


def column(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values)) if values.dtype.kind == "f" else pa.array(values.astype(np.int64))


#: What a system gives of a batch: its labels, the matrix of p, which classes are there (None: all of the row), and columns besides, by name.
System = tuple[tuple, np.ndarray, np.ndarray | None] | tuple[tuple, np.ndarray, np.ndarray | None, dict]


def _systems(batch: pa.RecordBatch, fields: list[str], each) -> Iterator[tuple[tuple, dict]]:
    """(labels, scores and what else a system gives) of each system of a batch."""
    ids = batch["class_id"]
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(pc.list_flatten(ids))
    names = coded.dictionary.to_pylist()
    codes = matrix(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), coded.indices), -1)
    truth = pc.index_in(batch["truth"], value_set=coded.dictionary).fill_null(-2).to_numpy(zero_copy_only=False)
    whole, hit = codes >= 0, codes == truth[:, None]
    for labels, p, there, *more in each(values_of(batch, fields), codes, names):
        yield labels, scores(p, whole if there is None else there, hit) | (more[0] if more else {})


def _labelled(batch: pa.RecordBatch, labels: tuple, names: list[str], schema: pa.Schema) -> dict[str, pa.Array]:
    return {n: pa.array([x], schema.field(n).type).take(pa.array(np.zeros(len(batch), np.int32))) for n, x in zip(names, labels, strict=True)}


def _read(rows: DataFrame, options: str, fields: dict[str, Column], kept: list[str]) -> DataFrame:
    own = F.col(options)
    return rows.select(*kept, *(["truth"] if "truth" not in kept else []), own["class_id"].alias("class_id"), *(c.alias(n) for n, c in fields.items()))


def _types(df: DataFrame, names: list[str]) -> list[str]:
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]


def row_scores(rows: DataFrame, options: str, fields: dict[str, Column], kept: list[str], labels: str, each: Callable[[dict, np.ndarray, list], Iterable[System]], more: str = "") -> DataFrame:
    """(labels, kept, truth, scores, more): as metrics.array_scores, of several systems of each row, made from `fields` in numpy.

    options: an array of structs with class_id; fields: arrays of its classes' values, or one value a row.  each(values,
    codes, names) gives the systems of a batch, names[codes] being the classes of its rows (-1: none).
    """
    source, asked = _read(rows, options, fields, kept), list(fields)
    own, held, wanted = [x.split()[0] for x in labels.split(", ")], [k for k in kept if k != "truth"], [x.split()[0] for x in SCORES.split(", ")]
    besides = [x.split()[0] for x in more.split(", ") if x]
    kinds = {"string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in labels.split(", ")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, found in _systems(batch, asked, each):
                named = _labelled(batch, names, own, schema)
                yield pa.RecordBatch.from_pydict(named | {k: batch[k] for k in [*held, "truth"]} | {c: column(found[c]) for c in wanted} | {c: pa.array(found[c]) for c in besides})

    return source.mapInArrow(score, ", ".join([labels, *_types(source, [*held, "truth"]), SCORES, *([more] if more else [])]))


def computed(rows: DataFrame, options: str, fields: dict[str, Column], kept: list[str], each: Callable[[dict, np.ndarray], dict[str, np.ndarray]], out: list[str]) -> DataFrame:
    """(kept, class_id, out): a row for each class of a row's array, with values made from `fields` in numpy; nothing is exchanged.

    each(values, whole) gives a matrix for each name of `out`, whole telling which places of it are classes of the row.
    """
    own, asked = F.col(options), list(fields)
    source = rows.select(*kept, own["class_id"].alias("class_id"), *(c.alias(n) for n, c in fields.items()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch["class_id"]), 0).to_numpy(zero_copy_only=False)
            whole = np.arange(int(sizes.max()) if len(sizes) else 0) < sizes[:, None]
            found = each(values_of(batch, asked), whole)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = {n: pa.ListArray.from_arrays(offsets, pa.array(found[n][whole], pa.float64())) for n in out}
            yield pa.RecordBatch.from_pydict({k: batch[k] for k in [*kept, "class_id"]} | lists)

    found = source.mapInArrow(work, ", ".join([*_types(source, [*kept, "class_id"]), *(f"`{n}` array<double>" for n in out)]))
    return found.select(*kept, F.explode(F.arrays_zip("class_id", *out)).alias("__o")).select(*kept, "__o.*")


def track_parts(rows: DataFrame, options: str, fields: dict[str, Column], track: list[str], labels: str, each: Callable[[dict, np.ndarray, list], Iterable[System]], bins: int = 15) -> DataFrame:
    """(labels, scorable, track, sums): metrics.track_sums of several systems of each row, apart by whether the truth is among the classes.

    A batch gives a row for each run of rows of one track, so sums of a track are still to be added up (metrics.added_tracks).
    """
    source, asked = _read(rows, options, fields, track), list(fields)
    own = [x.split()[0] for x in labels.split(", ")]
    kinds = {"string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in labels.split(", ")])
    sums = ["n", *(f"{k}_{b}" for _, b in MEASURES for k in "sn"), *(f"gap_{b}" for b in range(bins))]
    types = ", ".join(f"{c} {'long' if c[0] == 'n' else 'double'}" for c in sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            new[0] = True
            for k in track:
                codes = pc.dictionary_encode(batch[k], null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            run = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            for names, found in _systems(batch, asked, each):
                known = ~np.isnan(found["p_truth"])
                for scorable in (True, False):
                    mine = known if scorable else ~known
                    n = np.bincount(run, mine, len(starts)).astype(np.int64)
                    at = np.flatnonzero(n)
                    if not len(at):
                        continue
                    part = {"n": n}
                    for a, b in MEASURES:
                        good = mine & ~np.isnan(found[a])
                        part[f"s_{b}"], part[f"n_{b}"] = np.bincount(run, np.where(good, found[a], 0.0), len(starts)), np.bincount(run, good, len(starts)).astype(np.int64)
                    confident = mine & known
                    bin_of = np.minimum(np.floor(np.where(confident, found["confidence"], 0.0) * bins), bins - 1).astype(np.int64)
                    gap = np.bincount(run * bins + bin_of, np.where(confident, np.nan_to_num(found["credit_1"]) - found["confidence"], 0.0), len(starts) * bins).reshape(-1, bins)
                    part |= {f"gap_{b}": gap[:, b] for b in range(bins)}
                    picked = batch.take(pa.array(starts[at]))
                    named = _labelled(picked, names, own, schema)
                    yield pa.RecordBatch.from_pydict(named | {"scorable": pa.array(np.full(len(at), scorable))} | {k: picked[k] for k in track} | {c: pa.array(part[c][at]) for c in sums})

    return source.mapInArrow(add, ", ".join([labels, "scorable boolean", *_types(source, track), types]))
