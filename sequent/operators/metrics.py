"""Tie-aware classification metrics over long predictions.

A prediction is a set of rows (row keys, truth, class_id, p, eliminated), or one row with an array of (class_id, p).
`row_scores` and `array_scores` turn it into one row of scores, the latter without any exchange, and every metric is an
aggregate of those; so all metrics of a table share one exchange on the track.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

TRACK = ("game", "side")
HORIZONS = (5, 10, 15, 20)


def credit(k: int, classes: Column, above: Column, tied: Column) -> Column:
    """The share of the truth's tie that fits into the first k places; null if the truth is not among the classes."""
    slots = F.least(F.lit(k), classes) - above
    return F.when(tied == 0, None).when(slots <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(slots, tied)))


def row_scores(pred: DataFrame, row: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: truth, p_truth, above, tied, credits at 1, 3 and 5, nll (null at 0), brier, confidence, sum_error."""
    p_truth = F.max(F.when(F.col("class_id") == F.col("truth"), F.col("p"))).over(W.Window.partitionBy(*row))
    marked = pred.withColumn("p_truth", p_truth)
    hit = F.when(F.col("class_id") == F.col("truth"), 1).otherwise(0)
    found = marked.groupBy(*row, "truth", *keep).agg(
        F.first("p_truth").alias("p_truth"), F.count_if(F.col("p") > F.col("p_truth")).alias("above"), F.count_if(F.col("p") == F.col("p_truth")).alias("tied"),
        F.count("*").alias("classes"), F.max("p").alias("confidence"), F.sum((F.col("p") - hit) * (F.col("p") - hit)).alias("brier"), F.abs(F.sum("p") - 1).alias("sum_error"),
    )
    return _scored(found, [*row, "truth", *keep])


def array_scores(rows: DataFrame, options: str, row: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """As row_scores, of rows that have their classes in an array of structs (class_id, p)."""
    ps = F.transform(options, lambda x: x["p"])
    own = F.transform(F.filter(options, lambda x: x["class_id"] == F.col("truth")), lambda x: x["p"])
    found = rows.select(*row, "truth", *keep, options, ps.alias("__ps"), F.array_max(own).alias("p_truth"))
    hit = lambda x: F.when(x["class_id"] == F.col("truth"), 1).otherwise(0)
    found = found.select(
        *row, "truth", *keep, "p_truth", F.size(F.filter("__ps", lambda p: p > F.col("p_truth"))).cast("long").alias("above"), F.size(F.filter("__ps", lambda p: p == F.col("p_truth"))).cast("long").alias("tied"),
        F.size("__ps").cast("long").alias("classes"), F.array_max("__ps").alias("confidence"),
        F.aggregate(options, F.lit(0.0), lambda a, x: a + (x["p"] - hit(x)) * (x["p"] - hit(x))).alias("brier"), F.abs(F.aggregate("__ps", F.lit(0.0), lambda a, p: a + p) - 1).alias("sum_error"),
    )
    return _scored(found, [*row, "truth", *keep])


def _scored(found: DataFrame, kept: list[str]) -> DataFrame:
    credits = [credit(k, F.col("classes"), F.col("above"), F.col("tied")).alias(f"credit_{k}") for k in (1, 3, 5)]
    nll = F.when(F.col("p_truth") > 0, -F.log("p_truth")).alias("nll")
    return found.select(*kept, "p_truth", "above", "tied", "confidence", "brier", "sum_error", nll, *credits)


def top_k(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(*(F.avg(f"credit_{k}").alias(f"top_{k}") for k in (1, 3, 5)), F.count("*").alias("n"))


def mean_nll(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """nll is null, and infinite true, if some row gives its truth no mass."""
    none = F.count_if(F.col("nll").isNull())
    return scores.groupBy(*by).agg(F.when(none == 0, F.avg("nll")).alias("nll"), (none > 0).alias("infinite"))


def mean_brier(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("brier").alias("brier"))


def reliability(scores: DataFrame, bins: int = 15, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, accuracy and confidence sums of equal-width confidence bins."""
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("long")
    return scores.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.sum("credit_1").alias("accuracy_sum"), F.sum("confidence").alias("confidence_sum"))


def ece(scores: DataFrame, bins: int = 15, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error of the greatest probability."""
    return reliability(scores, bins, by).groupBy(*by).agg((F.sum(F.abs(F.col("accuracy_sum") - F.col("confidence_sum"))) / F.sum("n")).alias("ece"))


MEANS = (("credit_1", "top_1"), ("credit_3", "top_3"), ("credit_5", "top_5"), ("nll", "nll"), ("brier", "brier"))


def game_normalized(scores: DataFrame, track: tuple[str, ...] = TRACK, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean within each track, then over tracks."""
    tracks = scores.groupBy(*by, *(t for t in track if t not in by)).agg(*(F.avg(a).alias(b) for a, b in MEANS))
    return tracks.groupBy(*by).agg(*(F.avg(b).alias(b) for _, b in MEANS), F.count("*").alias("tracks"))


def at_horizons(scores: DataFrame, order: str = "step", track: tuple[str, ...] = TRACK, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Each track's last row at or before each horizon."""
    values = F.struct(*(c for c in scores.columns if c not in track))
    picks = [F.max_by(values, F.when(F.col(order) <= h, F.col(order))).alias(f"h{h}") for h in horizons]
    wide = scores.groupBy(*track).agg(*picks)
    options = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("v")) for h in horizons))
    return wide.select(*track, F.explode(options).alias("o")).where("o.v is not null").select(*track, "o.horizon", "o.v.*")


def horizon(scores: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Top-1 and top-3 at each horizon, by each track's last row so far; null if there is no track."""
    found = at_horizons(scores, horizons=horizons).groupBy("horizon").agg(F.avg("credit_1").alias("top_1"), F.avg("credit_3").alias("top_3"), F.count("*").alias("tracks"))
    every = scores.sparkSession.createDataFrame([(h,) for h in horizons], "horizon int")
    return every.join(found, "horizon", "left").fillna(0, ["tracks"])


def first_rank_one(scores: DataFrame, order: str = "step", track: tuple[str, ...] = TRACK) -> DataFrame:
    """When the truth first is the only maximum: mean and median over the tracks where it is, tracks with and without."""
    unique = (F.col("above") == 0) & (F.col("tied") == 1)
    tracks = scores.groupBy(*track).agg(F.min(F.when(unique, F.col(order))).alias("first"))
    return tracks.agg(F.avg("first").alias("mean_first"), F.median("first").alias("median_first"), F.count("first").alias("reached"), F.count_if(F.col("first").isNull()).alias("never"))


def by_class(scores: DataFrame, family: DataFrame) -> DataFrame:
    """Top-1 by true class and by its family."""
    named = scores.join(F.broadcast(family), scores["truth"] == family["class_id"])
    one = named.groupBy(F.lit("class").alias("level"), F.col("truth").alias("name")).agg(F.avg("credit_1").alias("top_1"), F.count("*").alias("n"))
    two = named.groupBy(F.lit("family").alias("level"), F.col("family").cast("string").alias("name")).agg(F.avg("credit_1").alias("top_1"), F.count("*").alias("n"))
    return one.unionByName(two)


def summary(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Support and means of one slice."""
    return scores.groupBy(*by).agg(F.count("*").alias("support"), *(F.avg(a).alias(b) for a, b in MEANS))


def confusion_fractional(pred: DataFrame, row: list[str]) -> DataFrame:
    """truth x predicted; a tie of n maxima gives 1 / n to each."""
    best = F.max("p").over(W.Window.partitionBy(*row))
    top = pred.withColumn("best", best).where(F.col("p") == F.col("best"))
    share = top.withColumn("share", 1 / F.count("*").over(W.Window.partitionBy(*row)))
    return share.groupBy("truth", F.col("class_id").alias("predicted")).agg(F.sum("share").alias("weight"))


def confusion_counts(pred: DataFrame, row: list[str]) -> DataFrame:
    """truth x predicted in whole rows; of a tie the first class counts."""
    first = pred.groupBy(*row, "truth").agg(F.min(F.struct((-F.col("p")).alias("n"), "class_id"))["class_id"].alias("predicted"))
    return first.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def diagnostics(pred: DataFrame, row: list[str]) -> DataFrame:
    """Greatest sum error, rows with a mask, eliminated classes that have mass, and the greatest such mass."""
    gone = F.col("eliminated")
    rows = pred.groupBy(*row).agg(F.abs(F.sum("p") - 1).alias("error"), F.max(gone).alias("masked"), F.count_if(gone & (F.col("p") != 0)).alias("violations"), F.max(F.when(gone, F.col("p"))).alias("most"))
    return rows.agg(F.max("error").alias("max_sum_error"), F.count_if("masked").alias("masked_rows"), F.count_if(~F.col("masked")).alias("unmasked_rows"), F.sum("violations").alias("violations"), F.coalesce(F.max("most"), F.lit(0.0)).alias("max_eliminated_p"))


def gap_sums(bins: int = 15) -> list[Column]:
    """Aggregates gap_0, gap_1, ...: accuracy less confidence, summed over each confidence bin."""
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    return [F.sum(F.when(place == b, F.col("credit_1") - F.col("confidence"))).alias(f"gap_{b}") for b in range(bins)]


def gap_error(bins: int = 15) -> Column:
    """The calibration error of n rows from their gap sums."""
    return sum((F.abs(F.coalesce(F.col(f"gap_{b}"), F.lit(0.0))) for b in range(bins)), F.lit(0.0)) / F.col("n")


def sums(scores_of: tuple = MEANS) -> list[Column]:
    """Aggregates n, and sum and count of each measure."""
    return [F.count("*").alias("n"), *(x for a, b in scores_of for x in (F.sum(a).alias(f"s_{b}"), F.count(a).alias(f"n_{b}")))]


def added(bins: int = 15) -> list[Column]:
    """Aggregates that add up what `sums` and `gap_sums` made."""
    return [F.sum(c).alias(c) for c in ["n", *(f"{k}_{b}" for _, b in MEANS for k in "sn"), *(f"gap_{b}" for b in range(bins))]]


def column_scores(rows: DataFrame, classes: list[str], systems: dict[str, list[str]], truth: str, kept: list[str]) -> DataFrame:
    """kept, and credit_1_<system> and nll_<system>, as in row_scores, of rows whose classes' weights stand in a column each.

    systems: names of those columns, in the order of classes, by system; null weights are classes that are not there.
    Of a fixed vocabulary these are plain comparisons, which Spark compiles, step by step so that methods stay small: no
    arrays and nothing sent to Python.
    """
    total = lambda values: reduce(lambda x, y: x + y, values)
    whole = {s: total([F.coalesce(F.col(w), F.lit(0)) for w in names]) for s, names in systems.items()}
    own = {s: F.coalesce(*(F.when(F.col(truth) == name, F.col(w)) for name, w in zip(classes, names, strict=True))) for s, names in systems.items()}
    found = rows.withColumns({f"__own_{s}": x for s, x in own.items()} | {f"__all_{s}": x for s, x in whole.items()})
    tied = {f"__tied_{s}": total([(F.coalesce(F.col(w), F.lit(-1)) == F.col(f"__own_{s}")).cast("int") for w in names]) for s, names in systems.items()}
    found = found.withColumns(tied | {f"__top_{s}": F.greatest(*names) for s, names in systems.items()})
    scores = []
    for s in systems:
        mine, share = F.col(f"__own_{s}"), F.try_divide(f"__own_{s}", f"__all_{s}")
        scores += [F.when(mine == F.col(f"__top_{s}"), 1 / F.col(f"__tied_{s}")).when(mine.isNotNull(), 0.0).alias(f"credit_1_{s}"), F.when(mine > 0, -F.log(share)).alias(f"nll_{s}")]
    return found.select(*kept, *scores)


def track_sums(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What a report needs of each track: sums that can be added to those of other rows of the track."""
    return scores.groupBy(*by, *(t for t in TRACK if t not in by)).agg(*sums(), *gap_sums())


def added_tracks(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of tracks from several parts, as one row a track."""
    return parts.groupBy(*by, *(t for t in TRACK if t not in by)).agg(*added())


def summed(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As `summary`, of sums that are still to be added up."""
    found = parts.groupBy(*by).agg(*added())
    return found.select(*by, F.col("n").alias("support"), *(F.try_divide(f"s_{b}", f"n_{b}").alias(b) for _, b in MEANS))


def reported(tracks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The report of track sums."""
    means = [F.avg(F.try_divide(f"s_{b}", f"n_{b}")).alias(f"track_{b}") for _, b in MEANS]
    found = tracks.groupBy(*by).agg(*added(), F.count("*").cast("double").alias("track_tracks"), *means)
    rows = [F.try_divide(f"s_{b}", f"n_{b}").alias(f"row_{b}") for _, b in MEANS]
    wide = found.select(*by, F.col("n").cast("double").alias("row_support"), *rows, "track_tracks", *(f"track_{b}" for _, b in MEANS), gap_error().alias("ece"))
    return melted(wide if by else wide.where("row_support is not null"), by)


def report(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row and track means, calibration error and counts, as one long table (metric, value): one pass over the rows."""
    return reported(track_sums(scores, by), by)


def melted(wide: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    names = [c for c in wide.columns if c not in by]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))
    return wide.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")


def binary_sums(rows: DataFrame, label: str, p: str, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """What `binary_of` needs, as sums that can be added."""
    y, q = F.col(label), F.col(p)
    own = F.when(y, q).otherwise(1 - q)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((q >= threshold) == y).alias("right"), F.count_if(own <= 0).alias("zero"), F.sum(-F.log(F.when(own > 0, own))).alias("loss"), F.sum(F.pow(q - y.cast("double"), 2)).alias("square"))


def binary_of(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    found = parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "right", "zero", "loss", "square")))
    return found.select(*by, "n", (F.col("right") / F.col("n")).alias("accuracy"), F.when(F.col("zero") == 0, F.col("loss") / F.col("n")).alias("nll"), (F.col("square") / F.col("n")).alias("brier"))


def binary(rows: DataFrame, label: str, p: str, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy at a threshold, negative log likelihood (null if infinite) and Brier score of a Boolean label."""
    return binary_of(binary_sums(rows, label, p, threshold, by), by)


MASK_SUMS = ("rows", "exact", "tp", "fp", "fn", "bce", "cells", "zero")


def mask_sums(cells: DataFrame, row: list[str], truth: str, p: str, threshold: float = 0.5) -> DataFrame:
    """What `mask_of` needs, as sums that can be added; the cells of a row must be together."""
    y, yes = F.col(truth), F.col(p) >= threshold
    own = F.when(y, F.col(p)).otherwise(1 - F.col(p))
    rows = cells.groupBy(*row).agg(F.min((yes == y).cast("int")).alias("exact"), F.count_if(yes & y).alias("tp"), F.count_if(yes & ~y).alias("fp"), F.count_if(~yes & y).alias("fn"), F.sum(-F.log(F.when(own > 0, own))).alias("bce"), F.count("*").alias("cells"), F.count_if(own <= 0).alias("zero"))
    return rows.withColumn("rows", F.lit(1)).agg(*(F.sum(c).alias(c) for c in MASK_SUMS))


def mask_array_sums(rows: DataFrame, cells: str, truth: str, p: str, threshold: float = 0.5) -> DataFrame:
    """As mask_sums, of rows whose cells stand in one array: nothing is exchanged to bring them together."""
    exact = F.array_min(F.transform(cells, lambda c: ((c[p] >= threshold) == c[truth]).cast("int")))
    each = rows.select(exact.alias("exact"), F.posexplode(cells).alias("__at", "__cell"))
    y, q, first = F.col("__cell")[truth], F.col("__cell")[p], F.col("__at") == 0
    yes, own = q >= threshold, F.when(y, q).otherwise(1 - q)
    sums = {"exact": F.sum(F.when(first, F.col("exact"))), "tp": F.count_if(yes & y), "fp": F.count_if(yes & ~y), "fn": F.count_if(~yes & y), "bce": F.sum(-F.log(F.when(own > 0, own))), "cells": F.count("*"), "zero": F.count_if(own <= 0), "rows": F.count_if(first)}
    return each.agg(*(sums[c].alias(c) for c in MASK_SUMS))


def mask_of(parts: DataFrame) -> DataFrame:
    sums = parts.agg(*(F.sum(c).alias(c) for c in MASK_SUMS))
    over = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select((F.col("exact") / F.col("rows")).alias("exact_match"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), F.when(F.col("zero") == 0, F.col("bce") / F.col("cells")).alias("bce"))


def mask_metrics(cells: DataFrame, row: list[str], truth: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Multi-label cells: exact match by row, micro precision, recall and F1 (0 where undefined), mean cross entropy."""
    return mask_of(mask_sums(cells, row, truth, p, threshold))


def mask_balanced_loss(cells: DataFrame, truth: str, p: str) -> DataFrame:
    """Cross entropy over positives and over negatives, half each."""
    y = F.col(truth)
    own = F.when(y, F.col(p)).otherwise(1 - F.col(p))
    loss = -F.log(F.when(own > 0, own))
    return cells.agg((0.5 * (F.avg(F.when(y, loss)) + F.avg(F.when(~y, loss)))).alias("loss"))


def by_side(scores: DataFrame) -> DataFrame:
    """Means over all rows and over each side's."""
    found = scores.rollup("side").agg(F.count("*").alias("support"), *(F.avg(a).alias(b) for a, b in MEANS))
    return found.withColumn("side", F.coalesce("side", F.lit("all")))


def zero_truth(scores: DataFrame, track: tuple[str, ...] = TRACK) -> DataFrame:
    """Tracks that give their truth no mass somewhere; the mean nll of the rest is flagged as partial."""
    tracks = scores.groupBy(*track).agg(F.count_if(F.col("p_truth") == 0).alias("zero"), F.avg("nll").alias("nll"))
    return tracks.agg(F.count("*").alias("tracks"), F.count_if(F.col("zero") > 0).alias("zero_tracks"), F.when(F.max("zero") == 0, F.avg("nll")).alias("nll"), (F.max("zero") > 0).alias("infinite"))


def horizon_full(scores: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """All means and the calibration error at each horizon and at the last step (-1), by side and for both: one pass."""
    measures = ["confidence", *(a for a, _ in MEANS)]
    values = F.struct(*measures)
    picks = [F.max_by(values, F.when(F.col("step") <= h, F.col("step"))).alias(f"h{h}") for h in horizons]
    wide = scores.groupBy(*TRACK).agg(*picks, F.max_by(values, "step").alias("h"))
    options = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("v")) for h in horizons), F.struct(F.lit(-1).alias("horizon"), F.col("h").alias("v")))
    rows = wide.select("side", F.explode(options).alias("o")).where("o.v is not null").select("side", "o.horizon", "o.v.*")
    cells = rows.groupBy("horizon", "side").agg(*sums(), *gap_sums())  # a few rows
    groups = cells.withColumn("group", F.explode(F.array("side", F.lit("both")))).groupBy("horizon", "group").agg(*added())
    return groups.select("horizon", "group", F.col("n").alias("support"), *(F.try_divide(f"s_{b}", f"n_{b}").alias(b) for _, b in MEANS), gap_error().alias("ece"))


def gate_metrics(scores: DataFrame, classes: list[str], heads: dict[str, tuple[Column, Column]], right: Column, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(system, metric, value): all that the gates read of each system, from one row a track, so in one pass over the rows.

    scores: row scores with system, track and step, and for each row violations (eliminated classes with mass),
    max_eliminated (the greatest such mass) and masked (whether it has a mask).  heads: a Boolean label and its
    probability for each auxiliary head; right: whether the parameters are right (null: not scored).  A class that is
    no row's truth has no metric; other metrics of what no row has are null.
    """
    own = lambda y, p: F.when(y, p).otherwise(1 - p)
    parts = [x for h, (y, p) in heads.items() for x in (F.sum(((p >= 0.5) == y).cast("double")).alias(f"{h}_right"), F.sum(-F.log(F.when(own(y, p) > 0, own(y, p)))).alias(f"{h}_loss"), F.sum((p - y.cast("double")) ** 2).alias(f"{h}_square"))]
    masks = [F.sum("violations").alias("violations"), F.max("max_eliminated").alias("most"), F.count_if("masked").alias("masked")]
    picks = [F.max_by("credit_1", F.when(F.col("step") <= h, F.col("step"))).alias(f"h{h}") for h in horizons]
    tracks = scores.groupBy("system", *TRACK).agg(F.first("truth").alias("truth"), *sums(), *gap_sums(), *parts, *masks, *picks, F.sum(right.cast("double")).alias("right"), F.count(right).alias("judged"))
    mean = {b: F.try_divide(f"s_{b}", f"n_{b}") for _, b in MEANS}
    of = lambda c, cond: F.when(cond, c) if cond is not None else c
    found = {f"track_{b}": F.avg(x) for b, x in mean.items()} | {f"{side}_track_{b}": F.avg(of(mean[b], F.col("side") == side)) for side in ("white", "black") for b in ("top_1", "top_3", "nll")}
    found |= {f"horizon_{h}": F.avg(f"h{h}") for h in horizons}
    found |= {f"class_{c}": F.try_divide(F.sum(of(F.col("s_top_1"), F.col("truth") == c)), F.sum(of(F.col("n"), F.col("truth") == c))) for c in classes}
    rows = F.sum("n")
    for h in heads:
        found |= {h: F.sum(f"{h}_right") / rows, f"{h}_nll": F.sum(f"{h}_loss") / rows, f"{h}_brier": F.sum(f"{h}_square") / rows}
    gaps = sum((F.abs(F.coalesce(F.sum(f"gap_{b}"), F.lit(0.0))) for b in range(15)), F.lit(0.0))
    found |= {"parameters": F.try_divide(F.sum("right"), F.sum("judged")), "ece": gaps / rows, "checked": rows, "masked": F.sum("masked"), "violations": F.sum("violations"), "max_eliminated": F.max("most")}
    long = melted(tracks.groupBy("system").agg(*(x.cast("double").alias(name) for name, x in found.items())), ("system",))
    return long.where(~F.col("metric").startswith("class_") | F.col("value").isNotNull())


def parameters(truth: DataFrame, predicted: DataFrame, row: list[str]) -> DataFrame:
    """Accuracy of each named parameter and of all; a parameter that is not predicted is wrong."""
    joined = truth.join(predicted.withColumnRenamed("value", "guess"), [*row, "name"], "left")
    right = F.coalesce(F.col("value") == F.col("guess"), F.lit(False)).cast("double")
    return joined.rollup("name").agg(F.avg(right).alias("accuracy"), F.count("*").alias("n")).withColumn("name", F.coalesce("name", F.lit("all")))


def entropy_means(rows: DataFrame) -> DataFrame:
    """Mean entropy reduction and mean information gain, of the rows that have them."""
    return rows.agg(F.avg(F.col("entropy_before") - F.col("entropy_after")).alias("entropy_reduction"), F.avg("information_gain").alias("information_gain"))
