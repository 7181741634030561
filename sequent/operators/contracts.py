"""Closed-world contracts: filters that report violations instead of dropping rows silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequent.functions.nested import canonical_json


def key_difference(raw: Column, expected: list[str]) -> tuple[Column, Column]:
    """Missing and unknown top-level keys of a JSON object, sorted."""
    keys, wanted = F.json_object_keys(raw), F.array(*map(F.lit, expected))
    return F.array_sort(F.array_except(wanted, keys)), F.array_sort(F.array_except(keys, wanted))


def closed_keys(rows: DataFrame, raw: str, expected: list[str]) -> DataFrame:
    """Rows whose key set is not the expected one, with what is missing and unknown; no object at all: all is missing."""
    missing, unknown = key_difference(F.col(raw), expected)
    none = F.json_object_keys(raw).isNull()
    wanted = F.array_sort(F.array(*map(F.lit, expected)))
    found = rows.withColumn("missing", F.when(none, wanted).otherwise(missing)).withColumn("unknown", F.when(none, F.array().cast("array<string>")).otherwise(unknown))
    return found.where((F.size("missing") > 0) | (F.size("unknown") > 0))


def leaks(rows: DataFrame, raw: str, forbidden: list[str]) -> DataFrame:
    """Rows of features that hold a field reserved for labels or evaluation."""
    found = F.array_sort(F.array_intersect(F.json_object_keys(raw), F.array(*map(F.lit, forbidden))))
    return rows.withColumn("leaked", found).where(F.size("leaked") > 0)


def split_groups(rows: DataFrame, keys: list[str], features: list[str], labels: list[str], evaluation: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, labels and evaluation metadata as three tables that share the keys."""
    return tuple(rows.select(*keys, *group) for group in (features, labels, evaluation))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break; a rule that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.withColumn("violations", broken).where(F.size("violations") > 0)


def bad_distributions(pred: DataFrame, row: list[str], tolerance: float = 1e-6, zero: bool = True, truth: bool = False) -> DataFrame:
    """Rows whose probabilities leave [0, 1] or do not sum to 1 (or exactly 0, if `zero`); with `truth`, lack their truth."""
    found = pred.groupBy(*row).agg(F.sum("p").alias("total"), F.min("p").alias("low"), F.max("p").alias("high"), F.max((F.col("class_id") == F.col("truth")).cast("int")).alias("has_truth"), F.count_if(F.col("p").isNull() | F.isnan("p")).alias("unknown"))
    good = (F.abs(F.col("total") - 1) <= tolerance) | (F.lit(zero) & (F.col("total") == 0))
    good = good & (F.col("low") >= 0) & (F.col("high") <= 1) & (F.col("unknown") == 0)
    return found.where(~(good & (F.col("has_truth") == 1) if truth else good))


def bad_masks(pred: DataFrame, row: list[str], classes: int) -> DataFrame:
    """Rows whose mask has not one entry a class, eliminates everything or the truth, or leaves mass on what it eliminates."""
    gone = F.col("eliminated")
    found = pred.groupBy(*row).agg(F.count(gone).alias("entries"), F.min(gone).alias("all_gone"), F.max(F.when(F.col("class_id") == F.col("truth"), gone)).alias("truth_gone"), F.sum(F.when(gone, F.col("p")).otherwise(0.0)).alias("mass"))
    return found.where((F.col("entries") != classes) | F.col("all_gone") | F.col("truth_gone") | (F.col("mass") > 0))


def unit_tensor(x: Column, width: int) -> Column:
    """Whether an array has a fixed width and all values in [0, 1]."""
    return (F.size(x) == width) & F.forall(x, lambda v: v.isNotNull() & (v >= 0) & (v <= 1))


def constraint_fault(constraint: str, position: str, request: str, legal: str) -> Column:
    """What is wrong with a stored constraint, null if nothing is or there is none.

    Its position key and request digest must be those of the canonical JSON of `position` and `request`, and its best
    move one of the legal ones.
    """
    own = lambda field: F.col(f"{constraint}.{field}")
    fields = ("provider", "policyId", "positionKey", "requestDigest", "bestMoveUci", "engineFingerprint")
    empty = reduce(lambda x, y: x | y, (F.coalesce(own(f), F.lit("")) == "" for f in fields))
    fault = (
        F.when(empty, "missing field").when(own("provider") != "uci-best-move", "provider").when(~own("positionKey").eqNullSafe(canonical_json(position)), "stale position key")
        .when(~F.coalesce(F.array_contains(legal, own("bestMoveUci")), F.lit(False)), "best move not legal").when(~own("requestDigest").eqNullSafe(F.sha2(canonical_json(request), 256)), "stale request digest")
    )
    return F.when(F.col(constraint).isNotNull(), fault)


def of_partition(rows: DataFrame, seeds: DataFrame, seed: str) -> DataFrame:
    """Rows whose seed belongs to a partition."""
    return rows.join(seeds.select(seed).distinct(), seed, "left_semi")


def identities(rows: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """How many different identities there are; uniform if one."""
    return rows.groupBy(*by).agg(F.count_distinct(F.struct(*columns)).alias("identities")).withColumn("uniform", F.col("identities") == 1)


def active_side(white: str, black: str, side: str = "side") -> Column:
    return F.when(F.col(side) == "white", F.col(white)).otherwise(F.col(black))


def unscorable(target: Column, known: Column, components: Column) -> Column:
    """Why a parameter target cannot be scored; null if it can."""
    return F.when(target.isNull(), "unobserved").when(components == 0, "no-supervised-components").when(~known, "out-of-vocabulary")


def is_opportunity(triggered: Column, ordinary: Column, allowed: Column) -> Column:
    """Triggered, or the two sets of moves differ."""
    return triggered | (F.array_sort(F.array_distinct(ordinary)) != F.array_sort(F.array_distinct(allowed)))


def head_weights(white: Column, black: Column) -> tuple[Column, Column]:
    """Weights of the side heads that a row supervises: equal, and 1 together; 0 if none is."""
    n = white.cast("int") + black.cast("int")
    return tuple(F.when(n > 0, x.cast("int") / n).otherwise(0.0) for x in (white, black))


def ablated(x: Column, width: int, keep: bool) -> Column:
    """A tensor as it is, or zeros of its width."""
    return x if keep else F.when(x.isNotNull(), F.array_repeat(F.lit(0.0), width))
