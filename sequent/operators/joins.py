"""Joins that check what they join."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from sequent.operators.pairing import nearest_in_turn


def both_sides(rows: DataFrame, game: str, side: str, label: str, sides: tuple[str, str] = ("white", "black")) -> DataFrame:
    """Every row with both sides' labels; `conflict` if a side has several labels or none."""
    parts = [x for s in sides for x in (F.max(F.when(F.col(side) == s, F.col(label))).alias(f"{s}_label"), F.count_distinct(F.when(F.col(side) == s, F.col(label))).alias(f"__{s}"))]
    games = rows.groupBy(game).agg(*parts)
    games = games.withColumn("conflict", (F.col(f"__{sides[0]}") != 1) | (F.col(f"__{sides[1]}") != 1)).drop(*(f"__{s}" for s in sides))
    return rows.join(games, game)


def cover(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How two tables cover each other by a key that each should have once: matched, missing, unknown, repeated."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer").fillna(0, ["a", "b"])
    return both.agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("matched"), F.count_if(F.col("b") == 0).alias("missing"), F.count_if(F.col("a") == 0).alias("unknown"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"))


@F.pandas_udf(T.StringType())
def folded(titles: pd.Series) -> pd.Series:
    """NFKC, then case folded."""
    return titles.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def title_key(title: Column) -> Column:
    """NFKC, straight quotes, single blanks, case folded.  Only titles beyond ASCII need Python; they alone are sent there."""
    beyond = title.rlike(r"[^\x00-\x7F]")
    folded_title = F.when(beyond, folded(F.when(beyond, title))).otherwise(F.lower(title))
    straight = F.translate(folded_title, "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(straight, r"\s+", " "))


def by_title(left: DataFrame, right: DataFrame, title: str, other: str) -> DataFrame:
    """Left rows with the one right row of the same title key; titles that several right rows have match nothing."""
    keyed = right.withColumn("__key", title_key(F.col(other)))
    single = keyed.withColumn("__n", F.count("*").over(W.Window.partitionBy("__key"))).where("__n = 1").drop("__n")
    return left.withColumn("__key", title_key(F.col(title))).join(single, "__key").drop("__key")


def ledger_check(ledger: DataFrame, rows: DataFrame, game: str, count: str) -> DataFrame:
    """Ledger games with their rows; games without rows stay: expected, found, ok."""
    found = rows.groupBy(game).agg(F.count("*").alias("found"))
    joined = ledger.select(game, F.col(count).alias("expected")).join(found, game, "left").fillna(0, ["found"])
    return joined.withColumn("ok", F.col("expected") == F.col("found"))


def misaligned(a: DataFrame, b: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Keys that one system lacks or where targets differ: how many."""
    both = a.select(*keys, F.col(target).alias("x"), F.lit(True).alias("in_a")).join(b.select(*keys, F.col(target).alias("y"), F.lit(True).alias("in_b")), keys, "full_outer")
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(F.col("x") != F.col("y")).alias("different"), F.count_if(F.col("x") == F.col("y")).alias("aligned"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Track summaries of two systems side by side, and their differences; unequal example counts are marked."""
    left = a.select(*keys, "example_count", *(F.col(v).alias(f"a_{v}") for v in values))
    right = b.select(*keys, F.col("example_count").alias("other_count"), *(F.col(v).alias(f"b_{v}") for v in values))
    both = left.join(right, keys, "full_outer")
    return both.withColumn("ok", F.col("example_count").eqNullSafe(F.col("other_count"))).withColumns({f"d_{v}": F.col(f"a_{v}") - F.col(f"b_{v}") for v in values})


def _nearest(rows: DataFrame, group: list[str]) -> DataFrame:
    """Hits of `rows` (group, at, hit, tie) with the nearest other row of their group: choice (distance, tie, at)."""
    own = W.Window.partitionBy(*group)
    control = F.when(~F.col("hit"), F.struct("at", "tie"))
    # Of controls at one place the one with the smallest tie is seen first from either side.
    before = F.last(control, ignorenulls=True).over(own.orderBy("at", F.desc("tie")).rowsBetween(W.Window.unboundedPreceding, 0))
    behind = F.last(control, ignorenulls=True).over(own.orderBy(F.desc("at"), F.desc("tie")).rowsBetween(W.Window.unboundedPreceding, 0))
    found = rows.withColumn("before", before).withColumn("behind", behind).where("hit")
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.at")).alias("distance"), F.col(f"{c}.tie").alias("tie"), F.col(f"{c}.at").alias("at")))
    return found.withColumn("choice", F.least(option("before"), option("behind"))).where("choice is not null").select(*group, "at", "tie", "choice")


def nearest_any(rows: DataFrame, key: list[str], band: Column, order: str, flag: str, tie: Column) -> DataFrame:
    """For each flagged row the unflagged row of the same key and band that is nearest in order; ties by hash; by windows alone."""
    slim = rows.select(*key, band.alias("band"), F.col(order).alias("at"), F.col(flag).alias("hit"), tie.alias("tie"))
    return _nearest(slim, [*key, "band"]).select(*key, "at", F.col("choice.at").alias("control"), "choice.distance")


def nearest_control(rows: DataFrame, key: list[str], band: Column, order: str, flag: str, tie: Column) -> DataFrame:
    """As nearest_any, but no row serves twice: key, at, control, distance.

    Flagged rows are served one after the other in hash order, and each takes the nearest row that is left (of equally
    near ones that with the smaller hash); the last ones may get none.  One exchange at most and one sweep (pairing.py).
    """
    slim = rows.select(*key, band.alias("band"), F.col(order).alias("at"), F.coalesce(F.col(flag), F.lit(False)).alias("hit"), tie.alias("tie"))
    return nearest_in_turn(slim.where("at is not null"), [*key, "band"]).select(*key, "at", "control", "distance")


def expand_outcomes(hypotheses: DataFrame, outcomes: DataFrame, key: str, p: str) -> DataFrame:
    """Each hypothesis with its random outcomes; `ok` if their probabilities are positive and sum to 1 within 1e-12.

    A hypothesis without outcomes stays, with null ones, and is not ok.
    """
    checked = outcomes.groupBy(key).agg(((F.min(p) > 0) & (F.count(p) == F.count("*")) & (F.abs(F.sum(p) - 1) <= 1e-12)).alias("ok"))
    return hypotheses.join(outcomes, key, "left").join(checked, key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def blend(a: DataFrame, b: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """(1 - weight) a + weight b, row by row; masks must agree, which `ok` tells."""
    other = b.select(*keys, F.col("p").alias("__q"), F.col("eliminated").alias("__m"))
    both = a.join(other, keys)
    return both.withColumn("p", (1 - weight) * F.col("p") + weight * F.col("__q")).withColumn("ok", F.col("eliminated") == F.col("__m")).drop("__q", "__m")


def parity(a: DataFrame, b: DataFrame, row: list[str], top: int = 5) -> DataFrame:
    """Per row of two runtimes: same vocabulary, greatest difference, same top ids, same zero set."""
    def ids(p: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col(p).isNotNull(), F.struct((-F.col(p)).alias("n"), "class_id"))))
        return F.array_join(F.slice(F.transform(ordered, lambda x: x["class_id"]), 1, top), ",")

    both = a.select(*row, "class_id", F.col("p").alias("x")).join(b.select(*row, "class_id", F.col("p").alias("y")), [*row, "class_id"], "full_outer")
    return both.groupBy(*row).agg((F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("same_vocabulary"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_difference"), (ids("x") == ids("y")).alias("same_top"), (F.count_if((F.col("x") == 0) != (F.col("y") == 0)) == 0).alias("same_zeros"))


def row_parity(rows: DataFrame, options: str, row: list[str], top: int = 5) -> DataFrame:
    """As parity, of rows whose array `options` has p and `other` of each class (null: that runtime lacks it): nothing is exchanged."""
    def ids(name: str) -> Column:
        ordered = F.array_sort(F.transform(F.filter(options, lambda x: x[name].isNotNull()), lambda x: F.struct((-x[name]).alias("n"), x["class_id"])))
        return F.array_join(F.slice(F.transform(ordered, lambda x: x["class_id"]), 1, top), ",")

    lacking = F.filter(options, lambda x: x["p"].isNull() | x["other"].isNull())
    differing = F.filter(options, lambda x: (x["p"] == 0) != (x["other"] == 0))
    greatest = F.array_max(F.transform(options, lambda x: F.abs(x["p"] - x["other"])))
    return rows.select(*row, (F.size(lacking) == 0).alias("same_vocabulary"), greatest.alias("max_difference"), (ids("p") == ids("other")).alias("same_top"), (F.size(differing) == 0).alias("same_zeros"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """What both tables have."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def set_difference(required: DataFrame, observed: DataFrame, column: str) -> DataFrame:
    """missing and unexpected values of a column."""
    want, have = required.select(column).distinct(), observed.select(column).distinct()
    return want.join(have, column, "left_anti").withColumn("status", F.lit("missing")).unionByName(have.join(want, column, "left_anti").withColumn("status", F.lit("unexpected")))


def sample_by_hash(rows: DataFrame, stratum: list[str], k: int, key: Column, tie: list[str]) -> DataFrame:
    """The k rows of each stratum that hash lowest: the same ones in any order of input."""
    rank = F.row_number().over(W.Window.partitionBy(*stratum).orderBy(F.sha2(key, 256), *tie))
    return rows.withColumn("draw", rank).where(F.col("draw") <= k)
