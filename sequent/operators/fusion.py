"""Calibration, fusion and blending of long distributions, and selection over grids."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.operators import batches

#: Bounds of a temperature (fixed values).
LOW_T, HIGH_T = 0.05, 10.0


def softmax(rows: DataFrame, row: list[str], logit: Column, alive: Column, into: str = "p") -> DataFrame:
    """Adds the softmax over a row's rows that are alive; the others get exactly 0."""
    same = W.Window.partitionBy(*row)
    own = rows.withColumn("__x", F.when(alive, logit))
    own = own.withColumn("__e", F.coalesce(F.exp(F.col("__x") - F.max("__x").over(same)), F.lit(0.0)))
    total = F.sum("__e").over(same)
    return own.withColumn(into, F.when(total > 0, F.col("__e") / total).otherwise(0.0)).drop("__x", "__e")


def long_logits(rows: DataFrame, key: str, logits: str, truth: str, mask: Column | None = None) -> DataFrame:
    """(key, c, logit, truth, eliminated) from arrays of logits."""
    found = rows.select(key, F.col(truth).alias("truth"), F.posexplode(logits).alias("c", "logit"))
    gone = F.lit(False) if mask is None else mask
    return found.withColumn("logit", F.col("logit").cast("double")).withColumn("eliminated", gone & (F.col("c") != F.col("truth")))


def temperature_nll(logits: DataFrame, key: str, grid: list[float] | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean negative log likelihood of the truth at each temperature of a grid (or of a row's own), by one pass over the logits."""
    live = ~F.col("eliminated")
    rows = logits.groupBy(*by, key).agg(F.max(F.when(live, F.col("logit"))).alias("top"), F.max(F.when(F.col("c") == F.col("truth"), F.col("logit"))).alias("own"), F.collect_list(F.when(live, F.col("logit"))).alias("all"))
    each = rows.select(*by, key, "top", "own", "all", F.explode(F.array(*map(F.lit, grid)) if isinstance(grid, list) else grid).alias("t"))
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("top")) / F.col("t")))
    return each.withColumn("nll", F.log(total) - (F.col("own") - F.col("top")) / F.col("t")).groupBy(*by, "t").agg(F.avg("nll").alias("nll"))


def calibration(logits: DataFrame, key: str, by: str, fitted: dict) -> DataFrame:
    """by, t, before, after, improved, regained, each_side, accepted: the truth's loss at temperature 1 and at the fitted one of each of a few groups.

    regained: eliminated classes that the fitted temperature gives mass.  accepted: the mean of the groups' losses falls
    strictly, and nothing is regained; each_side: it falls in every group.
    """
    own = F.element_at(F.create_map(*(x for g, t in fitted.items() for x in (F.lit(g), F.lit(float(t))))), F.col(by))
    before = temperature_nll(logits, key, [1.0], (by,)).select(by, F.col("nll").alias("before"))
    after = temperature_nll(logits, key, F.array(own), (by,)).select(by, "t", F.col("nll").alias("after"))
    regained = softmax(logits, [key], F.col("logit") / own, ~F.col("eliminated")).groupBy(by).agg(F.count_if(F.col("eliminated") & (F.col("p") != 0)).alias("regained"))
    found = before.join(after, by).join(regained, by).withColumn("improved", F.col("after") < F.col("before"))
    every = found.agg((F.avg("after") < F.avg("before")).alias("__less"), F.min("improved").alias("each_side"), F.sum("regained").alias("__regained"))
    return found.crossJoin(every).withColumn("accepted", F.col("__less") & (F.col("__regained") == 0)).drop("__less", "__regained")  # one row


def fit_temperature(logits: DataFrame, key: str, rounds: int = 4, points: int = 33) -> tuple[float, float]:
    """The temperature of the least mean nll within bounds, and that nll; of ties the smaller one.

    Each round is one aggregate over a log grid around the last best point: the nll is convex in 1 / T.
    """
    every = fit_temperatures(logits.withColumn("__all", F.lit(0)), key, "__all", rounds, points)
    return every[0]


def fit_temperatures(logits: DataFrame, key: str, by: str, rounds: int = 5, points: int = 33) -> dict:
    """{group: (temperature, nll)} for each of the few values of `by`; all groups share each round's aggregate."""
    held, bounds = logits.cache(), None
    try:
        for _ in range(rounds):
            if bounds is None:
                bounds = {r[0]: (math.log(LOW_T), math.log(HIGH_T)) for r in held.select(by).distinct().collect()}
            grids = {g: [math.exp(low + k * (high - low) / (points - 1)) for k in range(points)] for g, (low, high) in bounds.items()}
            own = F.create_map(*(x for g, grid in grids.items() for x in (F.lit(g), F.array(*map(F.lit, grid)))))
            found = temperature_nll(held, key, F.element_at(own, F.col(by)), (by,)).collect()  # points rows a group
            best = {g: min((r["nll"], r["t"]) for r in found if r[by] == g) for g in bounds}
            steps = {g: (high - low) / (points - 1) for g, (low, high) in bounds.items()}
            bounds = {g: (max(math.log(LOW_T), math.log(t) - steps[g]), min(math.log(HIGH_T), math.log(t) + steps[g])) for g, (_, t) in best.items()}
    finally:
        held.unpersist()
    return {g: (t, nll) for g, (nll, t) in best.items()}


def hard_mask_fusion(rows: DataFrame, row: list[str], prior: str, residual: str, alpha: float | Column, smoothing: float | Column) -> DataFrame:
    """softmax(log((1 - s) prior + s / n) + alpha residual) over the survivors; alpha 0 gives the smoothed prior.

    alpha and smoothing may be columns, as of a grid that was exploded; then they belong to `row`.
    """
    n = F.count_if(~F.col("eliminated")).over(W.Window.partitionBy(*row))
    mixed = (1 - smoothing) * F.col(prior) + smoothing / n
    return softmax(rows.withColumn("__m", mixed), row, F.log("__m") + alpha * F.col(residual), ~F.col("eliminated") & (F.col("__m") > 0)).drop("__m")


def hard_masked(prior: np.ndarray, residual: np.ndarray, live: np.ndarray, alpha: float, smoothing: float) -> np.ndarray:
    """p of hard_mask_fusion for a matrix of rows and classes; live: which are not eliminated."""
    mixed = (1 - smoothing) * prior + smoothing / np.maximum(live.sum(1, keepdims=True), 1)
    alive = live & (mixed > 0)
    return batches.softmax(np.where(alive, np.log(np.where(alive, mixed, 1.0)) + alpha * residual, np.nan))


def log_prior_fusion(rows: DataFrame, row: list[str], prior: str, logit: str) -> DataFrame:
    """softmax(logit + log(max(prior, 1e-12))) over the survivors."""
    return softmax(rows, row, F.col(logit) + F.log(F.greatest(F.col(prior), F.lit(1e-12))), ~F.col("eliminated"))


def ratio_fusion(a: DataFrame, b: DataFrame, row: list[str], classes: int, weight: float = 0.35) -> DataFrame:
    """p max(q V, 1e-12)^w, renormalised; a class that q lacks is neutral, an eliminated one stays 0."""
    q = b.select(*row, "class_id", F.col("p").alias("__q"))
    both = a.join(q, [*row, "class_id"], "left")
    own = F.when(F.col("eliminated"), 0.0).otherwise(F.col("p") * F.when(F.col("__q").isNull(), 1.0).otherwise(F.pow(F.greatest(F.col("__q") * classes, F.lit(1e-12)), F.lit(weight))))
    both = both.withColumn("__v", own)
    total = F.sum("__v").over(W.Window.partitionBy(*row))
    return both.withColumn("p", F.when(total > 0, F.col("__v") / total).otherwise(0.0)).drop("__q", "__v")


def ratio_fused(p: np.ndarray, q: np.ndarray, gone: np.ndarray, classes: int, weight: float = 0.35) -> np.ndarray:
    """p of ratio_fusion for a matrix of rows and classes; q: NaN where it lacks a class."""
    with np.errstate(invalid="ignore"):
        ratio = np.where(np.isnan(q), 1.0, np.maximum(q * classes, 1e-12) ** weight)
    return batches.normalized(np.where(gone, 0.0, p * ratio))


def rank_fused(prior: np.ndarray, residual: np.ndarray, live: np.ndarray, alpha: float) -> np.ndarray:
    """p of rank_fusion for a matrix of rows and classes; live: which are there and not eliminated."""
    share = batches.softmax(np.where(live, residual, np.nan))
    ranked = live & (prior > 0)
    tier = np.log(np.where(ranked, prior, np.nan))
    order = np.argsort(tier, 1)  # NaN last
    own = np.take_along_axis(tier, order, 1)
    rises = own[:, 1:] > own[:, :-1]
    below, above = np.full(own.shape, -np.inf), np.full(own.shape, np.inf)
    below[:, 1:] = np.where(rises, own[:, :-1], -np.inf)
    above[:, :-1] = np.where(rises, own[:, 1:], np.inf)
    # Of equal tiers the first one sees the tier below and the last one the tier above; the others take it from them.
    below, above = np.maximum.accumulate(below, 1), np.minimum.accumulate(above[:, ::-1], 1)[:, ::-1]
    room = np.ones(own.shape)
    np.put_along_axis(room, order, np.where(np.isnan(own), 1.0, np.minimum(1.0, np.minimum((own - below) / 4, (above - own) / 4))), 1)
    lowest = np.where(ranked.any(1), np.where(ranked, tier, np.inf).min(1, initial=np.inf), 0.0)
    base = np.where(ranked, tier, lowest[:, None] - 1e6)
    return batches.softmax(np.where(live, base + alpha * room * (share - 1 / np.maximum(live.sum(1, keepdims=True), 1)), np.nan))


def row_inversions(prior: np.ndarray, p: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """order_inversions in a matrix of rows and classes: 1 where a class has more prior and less p than its neighbour in prior order, else 0."""
    order = np.lexsort((np.where(whole, p, np.inf), np.where(whole, prior, np.inf)), axis=1)
    a, b = (np.take_along_axis(x, order, 1) for x in (prior, p))
    there = np.take_along_axis(whole, order, 1)
    found = np.zeros(whole.shape)
    turned = np.zeros(whole.shape)
    turned[:, 1:] = there[:, 1:] & there[:, :-1] & (a[:, :-1] < a[:, 1:]) & (b[:, :-1] > b[:, 1:])
    np.put_along_axis(found, order, turned, 1)
    return found


def rank_fusion(rows: DataFrame, row: list[str], prior: str, residual: str, alpha: float) -> DataFrame:
    """A residual signal that cannot change the order of the prior.

    Distinct priors of a row's survivors are tiers of log(prior).  A tier may move by its headroom, a quarter of the
    smaller gap to its neighbours and 1 at most, times alpha times (softmax(residual) - 1 / n), which is below 1 in
    size; so tiers never meet.  Survivors without prior mass stand 1e6 below the lowest tier.
    """
    alive = ~F.col("eliminated")
    same = W.Window.partitionBy(*row)
    ordered = same.orderBy("__tier")
    found = softmax(rows, row, F.col(residual), alive, "__r").withColumn("__n", F.count_if(alive).over(same))
    found = found.withColumn("__tier", F.when(alive & (F.col(prior) > 0), F.log(prior)))
    # Of equal tiers the first one sees the tier below and the last one the tier above; the others take it from them.
    found = found.withColumn("__below", F.lag("__tier").over(ordered)).withColumn("__above", F.lead("__tier").over(ordered))
    below = F.last(F.when(F.col("__below") < F.col("__tier"), F.col("__below")), ignorenulls=True).over(ordered.rowsBetween(W.Window.unboundedPreceding, 0))
    above = F.first(F.when(F.col("__above") > F.col("__tier"), F.col("__above")), ignorenulls=True).over(ordered.rowsBetween(0, W.Window.unboundedFollowing))
    found = found.withColumn("__below", below).withColumn("__above", above)
    room = F.least(F.lit(1.0), F.coalesce((F.col("__tier") - F.col("__below")) / 4, F.lit(1.0)), F.coalesce((F.col("__above") - F.col("__tier")) / 4, F.lit(1.0)))
    lowest = F.min("__tier").over(same)
    base = F.coalesce("__tier", F.coalesce(lowest, F.lit(0.0)) - 1e6)
    logit = base + alpha * room * (F.col("__r") - 1 / F.col("__n"))
    return softmax(found.withColumn("__l", logit), row, F.col("__l"), alive).drop("__r", "__n", "__tier", "__below", "__above", "__l")


def order_inversions(rows: DataFrame, row: list[str], prior: str) -> DataFrame:
    """Neighbours in prior order whose fused probabilities are the other way round."""
    spec = W.Window.partitionBy(*row).orderBy(prior, "p")
    return rows.withColumn("__b", F.lag("p").over(spec)).withColumn("__c", F.lag(prior).over(spec)).where((F.col("__c") < F.col(prior)) & (F.col("__b") > F.col("p"))).drop("__b", "__c")


def ensemble_mean(members: DataFrame, row: list[str]) -> DataFrame:
    """Mean of members' probabilities; `ok` if all have the same mask there."""
    return members.groupBy(*row, "class_id").agg(F.avg("p").alias("p"), (F.count_distinct("eliminated") == 1).alias("ok"), F.max("eliminated").alias("eliminated"))


def row_ensemble(rows: DataFrame, members: list[tuple[str, str]]) -> DataFrame:
    """As ensemble_mean, where each row has every member's (p, eliminated) in columns of its own: nothing is exchanged."""
    masks = [F.col(gone) for _, gone in members]
    same = reduce(lambda a, b: a & b, (x.eqNullSafe(masks[0]) for x in masks[1:]), masks[0].isNotNull())
    return rows.withColumns({"p": sum((F.col(p) for p, _ in members), F.lit(0.0)) / len(members), "ok": same, "eliminated": reduce(lambda a, b: a | b, masks)})


def blend_grid(a: DataFrame, b: DataFrame, row: list[str], weights: list[float]) -> DataFrame:
    """One distribution for each blend weight."""
    q = b.select(*row, "class_id", F.col("p").alias("__q"))
    both = a.join(q, [*row, "class_id"])
    each = both.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    return each.withColumn("p", (1 - F.col("weight")) * F.col("p") + F.col("weight") * F.col("__q")).drop("__q")


def blended(rows: DataFrame, options: str, weights: list[float]) -> DataFrame:
    """As blend_grid, of rows whose array `options` has p and `other` of each class: one row for each weight."""
    each = rows.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    return each.withColumn(options, F.transform(options, lambda x: F.struct(x["class_id"].alias("class_id"), x["eliminated"].alias("eliminated"), ((1 - F.col("weight")) * x["p"] + F.col("weight") * x["other"]).alias("p"))))


def ordered_choice(candidates: DataFrame, order: list, by: tuple[str, ...] = ()) -> DataFrame:
    """The first candidate of each group in an order of columns."""
    rank = F.row_number().over(W.Window.partitionBy(*by).orderBy(*order))
    return candidates.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def earliest_good(epochs: DataFrame, epoch: str, nll: str, within: float = 0.005) -> DataFrame:
    """The earliest epoch whose nll is within a margin of the least."""
    least = F.min(nll).over(W.Window.partitionBy())
    return epochs.withColumn("__least", least).where(F.col(nll) <= F.col("__least") + within).agg(F.min(epoch).alias(epoch))
