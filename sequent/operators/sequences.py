"""Window operators over ordered steps of a track.

Every window is partitioned by the track (or by the track and a hypothesis) and ordered by the step, so that a chain of
them shares one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def so_far(track: list[str], order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*track).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)


def before(track: list[str], order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*track).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)


def entropy_bits(p: Column) -> Column:
    """Aggregate: entropy in bits; 0 log 0 is 0."""
    return -F.sum(F.when(p > 0, p * F.log2(F.when(p > 0, p))).otherwise(0.0))


def entropy_delta(pred: DataFrame, row: list[str], track: list[str], order: str) -> DataFrame:
    """Entropy before and after each step."""
    rows = pred.groupBy(*row).agg(entropy_bits(F.col("p")).alias("entropy_after"))
    return rows.withColumn("entropy_before", F.lag("entropy_after").over(W.Window.partitionBy(*track).orderBy(order)))


def eliminated(evidence: DataFrame, keys: list[str], order: str, contradiction: Column) -> DataFrame:
    """Adds `eliminated`: a hypothesis that was contradicted once stays out; unknown evidence contradicts nothing."""
    hit = F.coalesce(contradiction, F.lit(False)).cast("int")
    return evidence.withColumn("eliminated", F.max(hit).over(so_far(keys, order)) == 1)


def posterior(evidence: DataFrame, keys: list[str], row: list[str], order: str, log_likelihood: Column, log_prior: Column) -> DataFrame:
    """Adds `log_weight` (prior and all log likelihoods so far; unknown ones count 0) and `p` among what is not eliminated.

    If all of a row is eliminated every p is 0.
    """
    weight = log_prior + F.sum(F.coalesce(log_likelihood, F.lit(0.0))).over(so_far(keys, order))
    return renormalized(evidence.withColumn("log_weight", weight), row)


def renormalized(rows: DataFrame, row: list[str], log_weight: str = "log_weight") -> DataFrame:
    """Adds `p`: exp of log weights, made to sum to 1 over the row's rows that are not eliminated."""
    same = W.Window.partitionBy(*row)
    live = F.when(~F.col("eliminated"), F.col(log_weight))
    shifted = rows.withColumn("__e", F.coalesce(F.exp(live - F.max(live).over(same)), F.lit(0.0)))
    total = F.sum("__e").over(same)
    return shifted.withColumn("p", F.when(total > 0, F.col("__e") / total).otherwise(0.0)).drop("__e")


def log_sum_exp(x: Column, over: W.WindowSpec) -> Column:
    """Stable log of the sum of exponentials over a window; nulls are left out."""
    top = F.max(x).over(over)
    return top + F.log(F.sum(F.exp(x - top)).over(over))


def marginal_outcomes(rows: DataFrame, keys: list[str], log_p: str, log_likelihood: str, compatible: str) -> DataFrame:
    """Log likelihood of a hypothesis with random outcomes: log-sum-exp over the compatible ones; null if none is."""
    value = F.when(F.col(compatible), F.col(log_p) + F.col(log_likelihood))
    tops = rows.groupBy(*keys).agg(F.max(value).alias("top"), F.collect_list(value).alias("values"))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    return tops.select(*keys, F.when(F.col("top").isNotNull(), F.col("top") + F.log(total)).alias("log_likelihood"), F.col("top").isNull().alias("contradicted"))


def carried(rows: DataFrame, game: list[str], order: str, value: str, sides: tuple[str, str], side: str = "side") -> DataFrame:
    """Adds, for each side, its latest value at or before the row."""
    spec = W.Window.partitionBy(*game).orderBy(order, side).rowsBetween(W.Window.unboundedPreceding, 0)
    return rows.withColumns({f"{value}_{s}": F.last(F.when(F.col(side) == s, F.col(value)), ignorenulls=True).over(spec) for s in sides})


def new_eliminations(pred: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows where a class is eliminated and was not one step before."""
    was = F.coalesce(F.lag("eliminated").over(W.Window.partitionBy(*keys).orderBy(order)), F.lit(False))
    return pred.withColumn("__was", was).where("eliminated and not __was").drop("__was")


def ranked(pred: DataFrame, row: list[str]) -> DataFrame:
    """Adds `rank`: live classes first, then by probability, then by id."""
    return pred.withColumn("rank", F.row_number().over(W.Window.partitionBy(*row).orderBy("eliminated", F.desc("p"), "class_id")))


def top_ids(options: Column, top: int) -> Column:
    """The first ids in the order of `ranked`, of an array of a row's classes (class_id, eliminated, p)."""
    order = F.array_sort(F.transform(options, lambda x: F.struct(x["eliminated"].alias("gone"), x["p"].isNull().alias("none"), (-x["p"]).alias("n"), x["class_id"].alias("class_id"))))
    return F.slice(F.transform(order, lambda x: x["class_id"]), 1, top)


def first_events(timeline: DataFrame, track: list[str], order: str) -> DataFrame:
    """Of the truth's rows of a ranked timeline: first step at rank 1, first step eliminated, last rank and probability."""
    truth = timeline.where(F.col("class_id") == F.col("truth"))
    return truth.groupBy(*track).agg(F.min(F.when(F.col("rank") == 1, F.col(order))).alias("first_top"), F.min(F.when(F.col("eliminated"), F.col(order))).alias("first_eliminated"), F.max_by("rank", order).alias("last_rank"), F.max_by("p", order).alias("last_p"))


def continuity(rows: DataFrame, track: list[str], order: str, start: int = 0) -> DataFrame:
    """Tracks whose order does not run start, start + 1, ... without gaps or repeats: the first bad value and the count."""
    place = F.row_number().over(W.Window.partitionBy(*track).orderBy(order)) - 1 + start
    bad = rows.withColumn("__place", place).where(F.col("__place") != F.col(order))
    return bad.groupBy(*track).agg(F.min(order).alias("first_bad"), F.count("*").alias("bad"))


def repeats_of_side(rows: DataFrame, track: list[str], order: str, side: str) -> DataFrame:
    """Rows whose side is the side of the row before."""
    last = F.lag(side).over(W.Window.partitionBy(*track).orderBy(order))
    return rows.withColumn("__last", last).where(F.col("__last") == F.col(side)).drop("__last")


def chain_breaks(rows: DataFrame, track: list[str], order: str, after: str, ahead: str) -> DataFrame:
    """Rows that do not continue the row before: the step advances by one, and what it left is what this one finds."""
    spec = W.Window.partitionBy(*track).orderBy(order)
    bad = (F.lag(order).over(spec) + 1 != F.col(order)) | ~F.lag(after).over(spec).eqNullSafe(F.col(ahead)) & F.lag(order).over(spec).isNotNull()
    return rows.withColumn("__bad", bad).where("__bad").drop("__bad")


def not_constant(rows: DataFrame, track: list[str], columns: list[str]) -> DataFrame:
    """Tracks where a column has several values: track, column, values."""
    counts = rows.groupBy(*track).agg(*(F.count_distinct(c).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns))
    return counts.select(*track, F.explode(pairs).alias("x")).where("x.values > 1").select(*track, "x.*")


def restored(pred: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows where an eliminated class comes back."""
    was = F.lag("eliminated").over(W.Window.partitionBy(*keys).orderBy(order))
    return pred.withColumn("__was", was).where("__was and not eliminated").drop("__was")


def history(rows: DataFrame, track: list[str], order: str, value: str, last: int | None = None) -> DataFrame:
    """Adds `history`: the track's values before each row, in order; with `last`, only so many."""
    spec = before(track, order) if last is None else W.Window.partitionBy(*track).orderBy(order).rowsBetween(-last, -1)
    return rows.withColumn("history", F.collect_list(value).over(spec))


def move_digest(place: str, value: str, half: int) -> Column:
    """60 pseudo-random bits of a value at its place; half 1 or 2 of one hash."""
    text = F.sha2(F.concat_ws(":", F.col(place).cast("string"), F.col(value).cast("string")), 256)
    return F.conv(F.substring(text, 15 * half - 14, 15), 16, 10).cast("decimal(20,0)")


def with_past(rows: DataFrame, track: list[str], order: str, value: str, *halves: int) -> DataFrame:
    """Adds `past` (and `past_2`): a digest of the track's values before each row, each at its place; 0 before the first.

    A digest is the sum of the values' pseudo-random numbers, so it is carried on by one addition, and a row needs no more than a
    number, however long its history is.  Two histories that differ have one sum with a chance of 2^-60 for each half.
    The order must number the track's rows.
    """
    digest = lambda half: F.coalesce(F.sum(move_digest(order, value, half)).over(before(track, order)), F.lit(0)).cast("decimal(38,0)")
    return rows.withColumns({"past" if half == 1 else f"past_{half}": digest(half) for half in halves or (1, 2)})


def list_past(values: Column, half: int) -> Column:
    """The digest of a history that a row carries whole, its values standing at 1, 2, ..."""
    numbers = F.transform(values, lambda x, k: F.conv(F.substring(F.sha2(F.concat_ws(":", (k + 1).cast("string"), x.cast("string")), 256), 15 * half - 14, 15), 16, 10).cast("decimal(20,0)"))
    return F.aggregate(numbers, F.lit(0).cast("decimal(38,0)"), lambda total, x: (total + x).cast("decimal(38,0)"))


def history_breaks(rows: DataFrame, track: list[str], order: str, value: str, carried: str) -> DataFrame:
    """Rows whose carried history (an array) is not the track's values before them, from the first on."""
    found = with_past(rows, track, order, value)
    return found.where(~(F.col("past").eqNullSafe(list_past(F.col(carried), 1)) & F.col("past_2").eqNullSafe(list_past(F.col(carried), 2)))).drop("past", "past_2")


def history_features(rows: DataFrame, track: list[str], order: str, kind: str, kinds: list[str]) -> DataFrame:
    """Shares of each kind before the row, the two last kinds, and the length of the running streak of one kind."""
    past, here = before(track, order), W.Window.partitionBy(*track).orderBy(order)
    n = F.count(kind).over(past)
    shares = {f"share_{k}": F.when(n > 0, F.sum(F.when(F.col(kind) == k, 1).otherwise(0)).over(past) / n).otherwise(0.0) for k in kinds}
    change = F.when(F.coalesce(F.lag(kind).over(here) == F.col(kind), F.lit(False)), 0).otherwise(1)
    found = rows.withColumns(shares).withColumn("last_1", F.lag(kind, 1).over(here)).withColumn("last_2", F.lag(kind, 2).over(here)).withColumn("__run", F.sum(change).over(so_far(track, order)))
    return found.withColumn("streak", F.row_number().over(W.Window.partitionBy(*track, "__run").orderBy(order))).drop("__run")


def cumulative(rows: DataFrame, track: list[str], order: str, flag: str) -> DataFrame:
    """Running count and rate of a flag, and the step where it first is set."""
    spec = so_far(track, order)
    hit = F.col(flag).cast("long")
    return rows.withColumns({"seen": F.sum(hit).over(spec), "rate": F.avg(hit.cast("double")).over(spec), "first": F.min(F.when(F.col(flag), F.col(order))).over(spec)})


def rank_changes(timeline: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows where a class's rank is not what it was one step before: from, to."""
    last = F.lag("rank").over(W.Window.partitionBy(*keys).orderBy(order))
    return timeline.withColumn("before", last).where("before is not null and before <> rank")
