"""All comparator systems of the same rows, and their class views: arrays of classes, worked on as matrices of a batch, so that nothing is exchanged before the report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequent.operators import batches
from sequent.operators import metrics as m


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized(weights: Column) -> Column:
    """An array of weights as shares of its sum; all 0 if it has none."""
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda t, x: t + x)
    return let(weights, lambda w: let(total(w), lambda t: F.transform(w, lambda x: F.when(t > 0, x / t).otherwise(0.0))))


def tiers(prior: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, room) of each class, as fusion.rank_fusion has them: log prior, and how far it may move without meeting another one."""
    alive = live & (prior > 0)
    own = np.log(np.where(alive, prior, 1.0))
    below, above = np.full(own.shape, -np.inf), np.full(own.shape, np.inf)
    for k in range(own.shape[1]):
        other, there = own[:, k : k + 1], alive[:, k : k + 1]
        below = np.where(there & (other < own), np.maximum(below, other), below)
        above = np.where(there & (other > own), np.minimum(above, other), above)
    lowest = np.min(np.where(alive, own, np.inf), axis=1, initial=np.inf, keepdims=True)
    lowest = np.where(np.isfinite(lowest), lowest, 0.0) - 1e6
    room = np.minimum(1.0, np.minimum((own - below) / 4, (above - own) / 4))
    return np.where(alive, own, lowest), np.where(alive, room, 1.0)


def fused(residual: np.ndarray, base: np.ndarray, room: np.ndarray, live: np.ndarray, alpha: float) -> np.ndarray:
    """Logits of a residual that cannot change the order of the prior; NaN for eliminated classes."""
    signal = batches.softmax(np.where(live, residual, np.nan))
    n = np.maximum(live.sum(1, keepdims=True), 1)
    return np.where(live, base + alpha * room * (signal - 1 / n), np.nan)


def fields_of(options: str, temperature: Column) -> dict[str, Column]:
    """What `every` reads of each row."""
    o = F.col(options)
    return {"eliminated": o["eliminated"], "prior": o["prior"], "frequency": o["frequency"], "residuals": F.flatten(o["residuals"]), "temperature": temperature.cast("double")}


def every(values: dict[str, np.ndarray], members: list[str], alpha: float) -> dict[str, np.ndarray]:
    """p of each system, as `systems` has them, of a batch of rows."""
    there = ~np.isnan(values["prior"])
    live = there & ~values["eliminated"]
    weighted = lambda w: batches.normalized(np.where(live, np.nan_to_num(w), 0.0))
    base, room = tiers(np.nan_to_num(values["prior"]), live)
    residuals = [values["residuals"][:, k :: len(members)] for k in range(len(members))]  # a class's stand together
    mean = np.zeros(live.shape)
    for r in residuals:
        mean = mean + r
    ensemble = fused(mean / len(members), base, room, live, alpha)
    found = {"uniform": weighted(np.ones(live.shape)), "training-frequency": weighted(values["frequency"]), "symbolic-only": weighted(values["prior"])}
    found |= {name: batches.softmax(fused(r, base, room, live, alpha)) for name, r in zip(members, residuals, strict=True)}
    return found | {"uncalibrated-ensemble": batches.softmax(ensemble), "calibrated-ensemble": batches.softmax(ensemble / values["temperature"][:, None])}


def systems(rows: DataFrame, options: str, members: list[str], alpha: float, temperature: Column, into: str = "o") -> DataFrame:
    """One row for each row and system, with an array `into` of (class_id, p) and without `options`.

    options: an array of (class_id, eliminated, prior, frequency, residuals), residuals with one entry for each of
    `members`.  The systems: uniform, training-frequency and symbolic-only over the classes that are not eliminated, each
    member's residual fused with the prior in its order, the fused mean residual (uncalibrated-ensemble), and its softmax
    at the row's temperature (calibrated-ensemble).  A system without mass gives zeros.  Nothing is exchanged.
    """
    kept = [c for c in rows.columns if c != options]
    fields = fields_of(options, temperature)
    asked = list(fields)
    source = rows.select(*kept, F.col(options)["class_id"].alias("__class"), *(c.alias(f"__{n}") for n, c in fields.items()))

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids = pa.concat_arrays([batch["__class"]])
            sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            borders = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            for name, p in every(batches.values_of(batch, asked, "__"), members, alpha).items():
                inside = np.arange(p.shape[1]) < sizes[:, None]
                each = pa.StructArray.from_arrays([pc.list_flatten(ids), pa.array(p[inside])], ["class_id", "p"])
                yield pa.RecordBatch.from_pydict({k: batch[k] for k in kept} | {"system": pa.array([name] * len(batch), pa.string()), into: pa.ListArray.from_arrays(borders, each)})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != options]
    return source.mapInArrow(make, ", ".join([*kinds, "system string", f"`{into}` array<struct<class_id: string, p: double>>"]))


def system_tracks(rows: DataFrame, options: str, members: list[str], alpha: float, temperature: Column, track: list[str], views: dict[str, list[str]] | None = None, digits: int | None = None) -> DataFrame:
    """(view, system, scorable, track, sums): metrics.track_sums of every system in each class view, still to be added up over a track.

    views: as `viewed` has them (none: one view with all classes); digits: decimals that a view's p are rounded to.
    """

    def each(values: dict, codes: np.ndarray, names: list[str]) -> Iterator[batches.System]:
        for name, p in every(values, members, alpha).items():
            for view, classes in views.items() if views else [("all", None)]:
                there = codes >= 0 if classes is None else np.isin(codes, [k for k, c in enumerate(names) if c in classes])
                q = p if classes is None else batches.normalized(np.where(there, p, 0.0))
                yield (view, name), q if digits is None else np.floor(q * 10.0**digits + 0.5) / 10.0**digits, there

    return batches.track_parts(rows, options, fields_of(options, temperature), track, "view string, system string", each)


def viewed(rows: DataFrame, options: str, views: dict[str, list[str]]) -> DataFrame:
    """One row for each row and view: the distribution on the view's classes, renormalised (zeros, if they have no mass)."""
    def own(classes: list[str]) -> Column:
        kept = F.filter(options, lambda x: x["class_id"].isin(classes))
        return let(kept, lambda k: F.zip_with(k, normalized(F.transform(k, lambda x: x["p"])), lambda x, q: F.struct(x["class_id"].alias("class_id"), q.alias("p"))))

    every = F.array(*(F.struct(F.lit(name).alias("view"), own(classes).alias(options)) for name, classes in views.items()))
    return rows.withColumn("__v", F.explode(every)).drop(options).select("*", "__v.*").drop("__v")


def view_report(rows: DataFrame, options: str, row: list[str], by: tuple[str, ...] = ("view", "system", "side")) -> DataFrame:
    """(by, metric, value): each group's report of the rows whose truth is in the view, and how many are not (unscorable, if any): one pass."""
    scored = m.array_scores(rows, options, [*(b for b in by if b not in row), *row])
    return tracks_report(m.track_sums(scored.withColumn("scorable", F.col("p_truth").isNotNull()), (*by, "scorable")), by)


def tracks_report(parts: DataFrame, by: tuple[str, ...] = ("view", "system", "side")) -> DataFrame:
    """As view_report, of sums (by, scorable, track, sums) of tracks, which may come in parts."""
    found = m.reported(m.added_tracks(parts, (*by, "scorable")), (*by, "scorable")).where("scorable or metric = 'row_support'")
    return found.withColumn("metric", F.when(F.col("scorable"), F.col("metric")).otherwise("unscorable")).drop("scorable")


def agents_that_change(rows: DataFrame, agent: str, contract: list[str]) -> DataFrame:
    """Agents that do not keep one contract (as style and strength), with how many they have; a null is a value of its own."""
    return rows.groupBy(agent).agg(F.count_distinct(F.struct(*contract)).alias("contracts")).where("contracts > 1")
