"""Priors, hypothesis posteriors and what is summed from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.sources.tables import numbered


def uniform(pred: DataFrame, row: list[str], survivors: bool = False) -> DataFrame:
    """Equal mass over a row's classes, or over those not eliminated (none, if all are)."""
    same = W.Window.partitionBy(*row)
    if not survivors:
        return pred.withColumn("p", 1 / F.count("*").over(same))
    live = F.count_if(~F.col("eliminated")).over(same)
    return pred.withColumn("p", F.when(F.col("eliminated") | (live == 0), 0.0).otherwise(1 / live))


def game_prior(assignments: DataFrame, vocabulary: DataFrame, game: str = "game", sides: tuple[str, ...] = ("white_class", "black_class")) -> DataFrame:
    """Class prior from game assignments: every game counts each side once; classes without a game get 0."""
    each = assignments.select(game, *sides).distinct().select(F.explode(F.array(*sides)).alias("class_id"))
    counts = each.groupBy("class_id").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.Window.partitionBy())
    return vocabulary.join(counts.withColumn("p", F.col("n") / total), "class_id", "left").fillna({"n": 0, "p": 0.0})


def conflicting_assignments(assignments: DataFrame, game: str, columns: list[str]) -> DataFrame:
    """Games that are assigned in more than one way."""
    return assignments.groupBy(game).agg(F.count_distinct(F.struct(*columns)).alias("ways")).where("ways > 1")


def training_frequency(rows: DataFrame, keys: list[str], side: str, label: str) -> DataFrame:
    """Class frequency per side, one count for each key; rows of several sources add up."""
    counts = rows.select(*keys, side, label).distinct().groupBy(side, label).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.Window.partitionBy(side)))


def masked(pred: DataFrame, row: list[str]) -> DataFrame:
    """Eliminated mass set to 0 and the rest renormalised; `lost` marks rows where nothing is left."""
    same = W.Window.partitionBy(*row)
    kept = F.when(F.col("eliminated"), 0.0).otherwise(F.col("p"))
    found = pred.withColumn("__kept", kept).withColumn("__total", F.sum("__kept").over(same))
    return found.withColumn("p", F.when(F.col("__total") > 0, F.col("__kept") / F.col("__total")).otherwise(0.0)).withColumn("lost", F.col("__total") == 0).drop("__kept", "__total")


def class_view(pred: DataFrame, row: list[str], view: list[str]) -> DataFrame:
    """A distribution on a subset of classes, renormalised; the other classes are not there, which is not eliminated."""
    kept = pred.where(F.col("class_id").isin(view))
    total = F.sum("p").over(W.Window.partitionBy(*row))
    return kept.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(0.0))


def class_posterior(post: DataFrame, row: list[str]) -> DataFrame:
    """Mass of each class over its variants; eliminated if all are; live and all variants."""
    return post.groupBy(*row, "class_id").agg(F.sum("p").alias("p"), F.min("eliminated").alias("eliminated"), F.count_if(~F.col("eliminated")).alias("live"), F.count("*").alias("variants"))


def posterior_vector(classes: DataFrame, row: list[str], vocabulary: list[str]) -> DataFrame:
    """Class posteriors as arrays in vocabulary order; a class that is not there has 0 and is eliminated."""
    ps = [F.coalesce(F.max(F.when(F.col("class_id") == c, F.col("p"))), F.lit(0.0)) for c in vocabulary]
    gone = [F.coalesce(F.max(F.when(F.col("class_id") == c, F.col("eliminated"))), F.lit(True)) for c in vocabulary]
    return classes.groupBy(*row).agg(F.array(*ps).alias("p"), F.array(*gone).alias("eliminated"))


def parameter_posterior(post: DataFrame, row: list[str], parameter: str) -> DataFrame:
    """Per class and parameter value: mass, the class's covered mass, and the value's share of it."""
    mass = post.groupBy(*row, "class_id", F.col(parameter).alias("value")).agg(F.sum("p").alias("mass"))
    covered = F.sum("mass").over(W.Window.partitionBy(*row, "class_id"))
    return mass.withColumn("covered", covered).withColumn("share", F.when(covered > 0, F.col("mass") / covered))


def opportunity(rows: DataFrame, row: list[str], weight: str, of: int) -> DataFrame:
    """Per class, by weights before the observation normalised inside it: known, allowed, triggered and forced mass.

    Unknown variants stay in the denominator.  A class without weight has zeros.
    """
    total = F.sum(weight)
    share = lambda cond, x=1.0: F.when(total > 0, F.sum(F.when(cond, F.col(weight) * x).otherwise(0.0)) / total).otherwise(0.0)
    known = F.col("known")
    allowed = F.col("allowed").cast("double")
    return rows.groupBy(*row, "class_id").agg(share(known).alias("known_mass"), share(known, allowed / of).alias("allowed_mass"), share(known & (allowed < of)).alias("triggered_mass"), share(known & (allowed == 1)).alias("forced_mass"))


def track_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics of each track: counts and sums."""
    return scores.groupBy(*keys).agg(F.count("*").alias("example_count"), F.sum("credit_1").alias("top_1_sum"), F.sum("credit_3").alias("top_3_sum"), F.sum("credit_5").alias("top_5_sum"), F.sum("nll").alias("nll_sum"), F.sum("brier").alias("brier_sum"))


def parameter_coverage(rows: DataFrame, side: str, reason: str, right: str) -> DataFrame:
    """Per side: rows, scorable rows, rows of each reason, coverage, and accuracy of the scorable ones."""
    ok = F.col(reason).isNull()
    return rows.groupBy(side).agg(F.count("*").alias("eligible"), F.count_if(ok).alias("scorable"), F.count_if(F.col(reason) == "unobserved").alias("unobserved"), F.count_if(F.col(reason) == "out-of-vocabulary").alias("out_of_vocabulary"), F.avg(ok.cast("double")).alias("coverage"), F.avg(F.when(ok, F.col(right).cast("double"))).alias("accuracy"))


def class_opportunity(rows: DataFrame, vocabulary: DataFrame, side: str, track: list[str], triggered: str) -> DataFrame:
    """Per side and class: rows, tracks and triggered rows; all classes of the vocabulary are listed."""
    found = rows.groupBy(side, F.col("truth").alias("class_id")).agg(F.count("*").alias("rows"), F.count_distinct(*track).alias("tracks"), F.count_if(triggered).alias("triggered"))
    every = vocabulary.select("class_id").join(F.broadcast(rows.select(side).distinct()))
    return every.join(found, [side, "class_id"], "left").fillna(0, ["rows", "tracks", "triggered"])


def label_coverage(rows: DataFrame, label: str, supported: list[str]) -> DataFrame:
    """Labels that are supported, and not; shares."""
    yes = F.col(label).isin(supported)
    return rows.agg(F.count("*").alias("labels"), F.count_if(yes).alias("supported"), F.count_if(~yes).alias("unsupported"), F.avg(yes.cast("double")).alias("share"))


def rule_coverage(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Observed against expected counts per key, both ways; only what differs."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("observed"))
    both = expected.join(found, keys, "full_outer").fillna(0, ["observed", "expected"])
    return both.where("observed <> expected")


def attrition(ledger: DataFrame) -> DataFrame:
    """Of a ledger (game, rows, sides): games with rows, without, with one side only; and all rows."""
    return ledger.agg(F.count("*").alias("games"), F.count_if(F.col("rows") > 0).alias("row_bearing"), F.count_if(F.col("rows") == 0).alias("zero_row"), F.count_if(F.col("sides") == 1).alias("one_sided"), F.sum("rows").alias("rows"))


def balance(assignments: DataFrame, classes: DataFrame, white: str, black: str) -> DataFrame:
    """How often each ordered pair of classes is assigned; pairs that are missing have 0."""
    grid = classes.select(F.col("class_id").alias(white)).join(F.broadcast(classes.select(F.col("class_id").alias(black))))
    found = assignments.groupBy(white, black).agg(F.count("*").alias("games"))
    return grid.join(found, [white, black], "left").fillna(0, ["games"])


def counts_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def vocabulary(rows: DataFrame, value: Column, most: int | None = None) -> DataFrame:
    """Sorted distinct values with their places; with `most`, no more than so many are allowed."""
    found = rows.select(value.alias("token")).where("token is not null").distinct()
    if most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"the vocabulary has more than {most} values")
    return numbered(found, ["token"], "id")


def track_weights(rows: DataFrame, track: list[str], triggered: str, multiplier: float) -> DataFrame:
    """A row's weight: multiplier if triggered, else 1, over the track's sum."""
    own = F.when(F.col(triggered), float(multiplier)).otherwise(1.0)
    return rows.withColumn("weight", own / F.sum(own).over(W.Window.partitionBy(*track)))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def corpus_set(corpora: DataFrame, same: list[str], different: list[str]) -> DataFrame:
    """Whether corpora agree on some fields and differ on others: field, values, ok."""
    n = F.count("*")
    parts = [corpora.agg(F.lit(c).alias("field"), F.count_distinct(c).alias("values"), (F.count_distinct(c) == 1 if c in same else F.count_distinct(c) == n).alias("ok")) for c in [*same, *different]]
    return reduce(DataFrame.unionByName, parts)
