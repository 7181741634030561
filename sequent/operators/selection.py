"""Choosing among candidates of one experiment: comparable runs only, one order of preference, and checks before a promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.operators import gates as g

#: Better is more of the first two and less of the third; then the smaller multiplier, then the smaller seed.
PERFORMANCE = ("track_top_1", "track_top_3", "track_nll")
TIES = ("multiplier", "seed")


def preference(ties: tuple[str, ...] = TIES) -> list[Column]:
    """Sort order of candidates, best first; metrics to nine decimals, so that the order of a sum decides nothing."""
    top_1, top_3, nll = (F.round(c, 9) for c in PERFORMANCE)
    return [top_1.desc_nulls_last(), top_3.desc_nulls_last(), nll.asc_nulls_last(), *(F.col(c).asc() for c in ties)]


def selected(candidates: DataFrame, identity: list[str], inputs: list[str], ties: tuple[str, ...] = TIES) -> DataFrame:
    """The best candidate, one row, with candidates, repeated, inputs and valid.

    candidates: one row each, a handful of finished runs.  repeated: identities that stand more than once; inputs: how many
    different inputs there are.  Valid only with two or more candidates, no identity twice and the same inputs everywhere.
    No candidates: no rows.
    """
    everyone = W.Window.partitionBy()  # candidates, not data
    same = F.row_number().over(W.Window.partitionBy(*identity).orderBy(*ties))
    marked = candidates.withColumn("__again", (same == 2).cast("long")).withColumn("__input", F.to_json(F.struct(*inputs)))
    counts = {"candidates": F.count("*").over(everyone), "repeated": F.sum("__again").over(everyone), "inputs": F.size(F.collect_set("__input").over(everyone)).cast("long")}
    placed = marked.withColumns(counts).withColumn("__place", F.row_number().over(everyone.orderBy(*preference(ties))))
    valid = (F.col("candidates") >= 2) & (F.col("repeated") == 0) & (F.col("inputs") == 1)
    return placed.where("__place = 1").drop("__again", "__input", "__place").withColumn("valid", valid)


def ablation_pairs(runs: DataFrame, match: list[str], control: str, treatment: str, metrics: list[str]) -> DataFrame:
    """control, treatment, the gain of each metric, fault: runs of the two modes that agree in `match` (seed, configuration, inputs).

    A run whose partner is missing has the fault 'no control' or 'no treatment' and null gains, and so have runs that share
    their match with another one of their mode ('several'); each run stands in one row.  Nulls match nulls.
    """
    def side(mode: str, name: str) -> DataFrame:
        own = runs.where(F.col("mode") == mode).groupBy(*match).agg(F.sort_array(F.collect_list(F.struct("name", *metrics))).alias(name))  # runs of one key
        return own.withColumnsRenamed({m: f"{name}_{m}" for m in match})

    both = reduce(lambda a, b: a & b, (F.col(f"x_{m}").eqNullSafe(F.col(f"y_{m}")) for m in match))
    met = side(control, "x").join(side(treatment, "y"), both, "full_outer")
    fault = F.when(F.col("x").isNull(), "no control").when(F.col("y").isNull(), "no treatment").when((F.size("x") > 1) | (F.size("y") > 1), "several")
    own = lambda c: F.coalesce(c, F.array().cast(met.schema[c].dataType))
    each = met.withColumn("fault", fault).withColumn("p", F.explode(F.zip_with(own("x"), own("y"), lambda x, y: F.struct(x.alias("x"), y.alias("y")))))
    gains = [F.when(F.col("fault").isNull(), F.col(f"p.y.{m}") - F.col(f"p.x.{m}")).alias(m) for m in metrics]
    return each.select(F.col("p.x.name").alias("control"), F.col("p.y.name").alias("treatment"), *gains, "fault")


def comparison_faults(runs: DataFrame, control: str, config: list[str], validation: str, train: str, ablation: tuple[str, str]) -> DataFrame:
    """Runs other than `control` with an array `faults` of what makes them incomparable with it.

    config: columns that must agree; validation: the input that must agree; a run whose mode differs from the control's must
    be an ablation (modes control, treatment in this order) and agree in seed, multiplier and training input too.
    """
    one = runs.where(F.col("name") == control).select(*(F.col(c).alias(f"__{c}") for c in {*config, validation, train, "mode", "seed", "multiplier"}))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"__{c}"))
    crossed = ~same("mode")
    rules = {"configuration": reduce(lambda a, b: a & b, map(same, config)), "validation": same(validation), "modes": ~crossed | ((F.col("__mode") == ablation[0]) & (F.col("mode") == ablation[1]))}
    rules |= {c: ~crossed | same(c) for c in ("seed", "multiplier", train)}
    faults = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    met = runs.where(F.col("name") != control).join(F.broadcast(one))  # one row
    return met.withColumn("faults", faults).drop(*(c for c in met.columns if c.startswith("__")))


def compared(table: DataFrame, best: DataFrame, control: str, extra: list = ()) -> DataFrame:
    """name, primary, failed, decision of a best treatment (one row with its name) against the control.

    table: long metrics (system, metric, value) of all runs.  Promoted only if every check passes.
    """
    chosen = best.select(F.col("name").alias("__best"))
    role = F.when(F.col("system") == control, "control").when(F.col("system") == F.col("__best"), "treatment")
    own = table.join(F.broadcast(chosen)).withColumn("system", role).where("system is not null").drop("__best")  # one row
    checks = g.reliability(own, "control", "treatment", extra)
    found = checks.agg(F.coalesce(F.max(F.when(F.col("check") == "primary", F.col("ok"))), F.lit(False)).alias("primary"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check")))), ",").alias("failed"))
    return chosen.join(F.broadcast(found)).select(F.col("__best").alias("name"), "primary", "failed", F.when(F.col("failed") == "", "promote").otherwise("retain").alias("decision"))


def treatment_comparison(runs: DataFrame, table: DataFrame, control: str, config: list[str], validation: str, train: str, ablation: tuple[str, str]) -> DataFrame:
    """`compared` for the best treatment; a run that cannot be compared with the control refuses the whole comparison (decision 'refused')."""
    others = comparison_faults(runs, control, config, validation, train, ablation)
    bad = others.agg(F.count_if(F.size("faults") > 0).alias("incomparable"))
    best = others.withColumn("__place", F.row_number().over(W.Window.partitionBy().orderBy(*preference()))).where("__place = 1")  # runs, not data
    found = compared(table, best, control).join(F.broadcast(bad))
    return found.withColumn("decision", F.when(F.col("incomparable") > 0, "refused").otherwise(F.col("decision")))
