"""Deterministic sampling by hash order: the same rows whatever the order of the input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.operators.pairing import pairs_in_turn
from sequent.sources.tables import numbered, stored


def hashed(seed: str, *key: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in key)), 256)


def game_balanced(rows: DataFrame, game: str, row: str, k: int, seed: str) -> DataFrame:
    """Exactly k rows of each game: the k that hash lowest, or, of a shorter game, all rows over and over."""
    spec = W.Window.partitionBy(game).orderBy(hashed(seed, game, row), row)
    placed = rows.withColumn("__place", F.row_number().over(spec) - 1).withColumn("__n", F.count("*").over(W.Window.partitionBy(game)))
    kept = placed.where(F.col("__place") < k)
    times = F.when(F.col("__place") < k % F.col("__n"), F.floor(k / F.col("__n")) + 1).otherwise(F.floor(k / F.col("__n")))
    times = F.when(F.col("__n") >= k, F.lit(1)).otherwise(times)
    return kept.withColumn("draw", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("__place", "__n")


def plan(tracks: DataFrame, strata: list[str], source: str, share: float = 0.25) -> DataFrame:
    """Equal quota per stratum: the smallest primary stratum; how many of them may be supplemental."""
    counts = tracks.groupBy(*strata).agg(F.count_if(F.col(source) == "primary").alias("primary"), F.count_if(F.col(source) != "primary").alias("supplemental"))
    quota = F.min("primary").over(W.Window.partitionBy())
    return counts.withColumn("quota", quota).withColumn("cap", F.floor(quota * share)).withColumn("use_supplemental", F.least("supplemental", "cap"))


def stratified(tracks: DataFrame, strata: list[str], source: str, key: str, seed: str, share: float = 0.25) -> DataFrame:
    """The plan's tracks: supplemental ones first up to their cap, then primary ones, in hash order."""
    planned = plan(tracks, strata, source, share).select(*strata, "quota", "use_supplemental")
    spec = W.Window.partitionBy(*strata, source).orderBy(hashed(seed, key), key)
    placed = tracks.withColumn("place", F.row_number().over(spec)).join(planned, strata)
    extra = F.col(source) != "primary"
    return placed.where((extra & (F.col("place") <= F.col("use_supplemental"))) | (~extra & (F.col("place") <= F.col("quota") - F.col("use_supplemental")))).drop("quota", "use_supplemental")


#: First steps of the horizon bands that pairs are made in (fixed values).
BANDS = (0, 5, 10, 20, 40)


def opportunity_paired(rows: DataFrame, game: str, step: str, hit: str, k: int = 24, pairs: int = 4, anchors: int = 8, side: tuple[str, ...] = ()) -> DataFrame:
    """k rows of each game: anchors, then pairs of a hit and its nearest other row of the same side and band, then others.

    Anchors and others are the rows that hash lowest.  Pairs are made without reuse among the rows that are no anchors:
    bands take turns in giving one, from a band on that the game's hash names, hits in hash order, each with the nearest
    control that is left (pairing.pairs_in_turn): at most `pairs` of them, and as many as fit into k.  A game of fewer than k rows gives all of them, and then rows drawn
    by hash.  Returns game, the row's columns, role and place (from 0).
    """
    row = [game, *side, step]
    number = lambda c: F.conv(F.substring(c, 1, 12), 16, 10).cast("long")
    own = W.Window.partitionBy(game)
    first = min(anchors, k)
    held = rows.select(*row, hit, hashed("pairs", *row).alias("__h"))
    held = held.withColumn("__n", F.count("*").over(own)).withColumn("__place", F.row_number().over(own.orderBy("__h", *row)) - 1)
    held = stored(held, "paired-rows")
    band = sum((F.when(F.col(step) >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
    start = number(hashed("bands", game)) % len(BANDS)
    side_key = F.concat_ws(":", *(F.col(c).cast("string") for c in side)) if side else F.lit("")
    free = held.where((F.col("__n") >= k) & (F.col("__place") >= first))
    free = free.select(game, side_key.alias("side"), F.pmod(band - start, F.lit(len(BANDS))).alias("turn"), F.col(step).alias("at"), F.coalesce(F.col(hit), F.lit(False)).alias("hit"), F.col("__h").alias("tie"), F.col("__place").cast("long").alias("row"), F.lit(min(pairs, (k - first) // 2)).alias("most"))
    made = pairs_in_turn(free, game, "most")
    both = F.array(F.struct(F.col("hit").alias("__place"), F.lit("hit").alias("__role"), (first + 2 * F.col("pair")).alias("__at")), F.struct(F.col("control").alias("__place"), F.lit("control").alias("__role"), (first + 2 * F.col("pair") + 1).alias("__at")))
    made = made.select(game, F.explode(both).alias("x")).select(game, "x.*")
    marked = held.join(made, [game, "__place"], "left")
    role = F.when(F.col("__n") < k, "all").when(F.col("__place") < first, "anchor").otherwise(F.coalesce("__role", F.lit("fill")))
    marked = marked.withColumn("role", role)
    order = F.when(F.col("role") == "fill", k).otherwise(F.coalesce("__at", F.col("__place")))
    placed = marked.withColumn("place", F.row_number().over(own.orderBy(order, "__h", *row)) - 1).where((F.col("place") < k) | (F.col("role") == "all"))
    again = placed.where(F.col("role") == "all").select(game, "__n").distinct().select(game, "__n", F.explode(F.sequence(F.col("__n"), F.lit(k - 1))).alias("place"))
    again = again.withColumn("__draw", number(F.sha2(F.concat_ws(":", F.lit("again"), F.col(game).cast("string"), F.col("place").cast("string")), 256)) % F.col("__n"))
    again = again.join(placed.select(*row, F.col("place").alias("__draw")), [game, "__draw"]).select(*row, F.lit("again").alias("role"), "place")
    return placed.select(*row, "role", "place").unionByName(again)


def shuffled(rows: DataFrame, seed: str, *key: str) -> DataFrame:
    """Rows with their `place` from 0 in a seeded order."""
    return numbered(rows.withColumn("__h", hashed(seed, *key)), ["__h", *key], "place").drop("__h")


def scored(rows: DataFrame, predict, schema: str) -> DataFrame:
    """Any row -> distribution function over Arrow batches: predict takes and gives pandas frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield predict(frame)

    return rows.mapInPandas(run, schema)
