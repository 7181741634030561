"""Identifiability: what hypotheses' histories of permitted sets still tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.operators.contracts import violations


def survivors(rows: DataFrame, row: list[str]) -> DataFrame:
    """Surviving hypotheses and classes, whether one class is left, and the credit of a uniform guess among them."""
    live = ~F.col("eliminated")
    found = rows.groupBy(*row).agg(F.count_if(live).alias("hypotheses"), F.count_distinct(F.when(live, F.col("class_id"))).alias("classes"))
    credits = {f"credit_{k}": F.when(F.col("classes") > 0, F.least(F.lit(1.0), k / F.col("classes"))) for k in (1, 3, 5)}
    return found.withColumn("identifiable", F.col("classes") == 1).withColumns(credits)


def mask_classes(rows: DataFrame, row: list[str], signature: str) -> DataFrame:
    """Survivors grouped by equal signature: groups, the size of the truth's group, and the partition's entropy (nats)."""
    live = rows.where(~F.col("eliminated"))
    groups = live.groupBy(*row, signature).agg(F.count("*").alias("n"), F.max((F.col("class_id") == F.col("truth")).cast("int")).alias("own"), F.count_distinct("class_id").alias("labels"))
    total = F.sum("n").over(W.Window.partitionBy(*row))
    share = groups.withColumn("q", F.col("n") / total)
    return share.groupBy(*row).agg(F.count("*").alias("groups"), F.max(F.when(F.col("own") == 1, F.col("n"))).alias("own_size"), F.max(F.when(F.col("own") == 1, F.col("labels"))).alias("own_labels"), (-F.sum(F.col("q") * F.log("q"))).alias("entropy"))


def set_changes(rows: DataFrame, track: list[str], order: str, ordinary: str, permitted: str) -> DataFrame:
    """Moves removed and added by the truth's rule at each step, and how often it did something so far."""
    removed, added = F.size(F.array_except(ordinary, permitted)), F.size(F.array_except(permitted, ordinary))
    spec = W.Window.partitionBy(*track).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    found = rows.withColumn("removed", removed).withColumn("added", added)
    acts = ((F.col("removed") + F.col("added")) > 0).cast("int")
    return found.withColumns({"acts": F.sum(acts).over(spec), "rate": F.avg(acts).over(spec), "first": F.min(F.when(acts == 1, F.col(order))).over(spec)})


def model_top(classes: DataFrame, row: list[str]) -> DataFrame:
    """The model's top set: size, tie credit, whether the truth is in it, and whether a single top is right or wrong."""
    best = F.max("p").over(W.Window.partitionBy(*row))
    top = classes.withColumn("best", best).where(F.col("p") == F.col("best"))
    found = top.groupBy(*row).agg(F.count("*").alias("size"), F.max((F.col("class_id") == F.col("truth")).cast("int")).alias("has_truth"))
    return found.select(*row, "size", (F.col("has_truth") == 0).alias("excludes_truth"), (F.col("has_truth") / F.col("size")).alias("credit"), ((F.col("size") == 1) & (F.col("has_truth") == 1)).alias("unique_correct"), ((F.col("size") == 1) & (F.col("has_truth") == 0)).alias("unique_error"))


def slices(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means over all rows, by each key, and by all keys together."""
    sets = [[], *([k] for k in keys), keys]
    aggregates = [F.count("*").alias("n"), *(F.avg(F.col(v).cast("double")).alias(v) for v in values)]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*aggregates, F.grouping_id(*keys).alias("level"))


def observation_faults(rows: DataFrame, horizon: str, indices: str, ordinary: str, truth: str, truth_id: str, hypotheses: str) -> DataFrame:
    """Observations that break a rule, with `violations`.

    indices: an array of steps, positive, strictly rising, the last within the horizon; ordinary: an entry for each of
    them; hypotheses: an array of (id, class_id, eliminated, history, posterior).  horizon: above 0; indices; alignment:
    ordinary and every history have an entry for each index; hypotheses: some, with ids of their own; truth: the true
    hypothesis is there, of the true class, not eliminated; posterior: all have one or none, finite, not below 0, 0 if
    eliminated, summing to 1 within 1e-6.  A null breaks the rule that needs it.
    """
    steps, hyps = F.col(indices), F.col(hypotheses)
    rising = F.forall(F.sequence(F.lit(1), F.size(steps)), lambda n: F.coalesce(F.element_at(steps, n) > F.when(n > 1, F.element_at(steps, F.greatest(n - 1, F.lit(1)))).otherwise(0), F.lit(False)))
    mine = F.filter(hyps, lambda x: x["id"] == F.col(truth_id))
    known = F.filter(hyps, lambda x: x["posterior"].isNotNull())
    sound = F.forall(known, lambda x: (x["posterior"] >= 0) & (x["posterior"] < float("inf")) & (~x["eliminated"] | (x["posterior"] == 0)))
    total = F.aggregate(known, F.lit(0.0), lambda t, x: t + x["posterior"])
    rules = {
        "horizon": F.col(horizon) > 0,
        "indices": F.when(F.size(steps) > 0, rising & (F.element_at(steps, -1) <= F.col(horizon))),
        "alignment": (F.size(ordinary) == F.size(steps)) & F.forall(hyps, lambda x: F.size(x["history"]) == F.size(steps)),
        "hypotheses": (F.size(hyps) > 0) & (F.size(F.array_distinct(F.transform(hyps, lambda x: x["id"]))) == F.size(hyps)),
        "truth": (F.size(mine) > 0) & F.forall(mine, lambda x: (x["class_id"] == F.col(truth)) & ~x["eliminated"]),
        "posterior": (F.size(known) == 0) | ((F.size(known) == F.size(hyps)) & sound & (F.abs(total - 1) <= 1e-6)),
    }
    return violations(rows, rules)


def longitudinal(rows: DataFrame, track: list[str], order: str, then: tuple[str, ...], truth: str, move: Column, past: str, hypotheses: str, mask: str) -> DataFrame:
    """Rows with `faults`, for all that break what must hold along a track: in constant state a row, however long the track is.

    truth, hypotheses: the track's first row has the same; order: it rises strictly; history: the row's digest of its past
    is the last row's, with that row's move added (sequences.with_past), and that of nothing at the start; restored: a
    bit of the mask (eliminated) that was set is not; duplicate: another row of the track stands at the same place.
    """
    spec = W.Window.partitionBy(*track).orderBy(order, *then)
    last = lambda c: F.lag(c).over(spec)
    placed = rows.withColumn("__move", move)
    expected = F.when(F.row_number().over(spec) == 1, F.lit(0)).otherwise(last(past) + last("__move"))
    checks = {
        "truth": F.col(truth).eqNullSafe(F.first(truth).over(spec)), "order": F.coalesce(last(order) < F.col(order), F.lit(True)), "history": F.col(past) == expected,
        "hypotheses": F.col(hypotheses).eqNullSafe(F.first(hypotheses).over(spec)), "restored": F.coalesce(last(mask).bitwiseAND(F.bitwise_not(mask)) == 0, F.lit(True)), "duplicate": F.count("*").over(W.Window.partitionBy(*track, order)) == 1,
    }
    faults = F.filter(F.array(*(F.when(~F.coalesce(good, F.lit(False)), name) for name, good in checks.items())), lambda x: x.isNotNull())
    return placed.withColumn("faults", faults).where(F.size("faults") > 0).drop("__move")
