"""Bootstrap intervals over clusters, and fail-closed gates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.sources.tables import stored

#: SplitMix64's increment and multipliers, and the seed of the fixed bootstrap (fixed values).
INCREMENT, FACTORS, SEED = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), 633_454_611
#: Clusters of a block, draws of the least piece of work, and pieces that are wanted.
BLOCK, PIECE, PIECES = 1 << 16, 1 << 22, 128


def mixed64(state: np.ndarray) -> np.ndarray:
    """SplitMix64's output for each 64-bit state."""
    z = (state ^ (state >> np.uint64(30))) * np.uint64(FACTORS[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(FACTORS[1])
    return z ^ (z >> np.uint64(31))


def drawn(seed: int, counter: np.ndarray, n: int) -> np.ndarray:
    """A place from 0 to n - 1 for each draw number: SplitMix64's value of that number modulo n.

    Values in the last, incomplete run of n are rejected, so that no place is favoured; the draw takes the next value
    of a sequence of its own.
    """
    state = (counter.astype(np.uint64) + np.uint64(1)) * np.uint64(INCREMENT) + np.uint64(seed & (2**64 - 1))
    value = mixed64(state)
    if excess := (1 << 64) % n:
        limit = np.uint64((1 << 64) - excess)
        while (over := value >= limit).any():
            value[over] = mixed64(value[over] + np.uint64(INCREMENT))
    return (value % np.uint64(n)).astype(np.int64)


class Drawer:
    """Draws as of `drawn` for draw numbers that follow each other, in runs that stay in a core's cache, counted by place."""

    def __init__(self, seed: int, n: int, run: int = 1 << 14):
        self._seed, self._n, self._run = seed & (2**64 - 1), n, run
        self._steps = np.arange(run, dtype=np.uint64) * np.uint64(INCREMENT)
        self._state, self._other = np.empty(run, np.uint64), np.empty(run, np.uint64)
        self._limit = (1 << 64) - (1 << 64) % n  # 2^64: nothing is rejected

    def add(self, first: int, count: int, times: np.ndarray) -> None:
        """Adds to `times` how often each place is drawn by the numbers from first to first + count - 1."""
        n = np.uint64(self._n)
        for at in range(0, count, self._run):
            size = min(self._run, count - at)
            z, other = self._state[:size], self._other[:size]
            np.add(self._steps[:size], np.uint64(((first + at + 1) * INCREMENT + self._seed) & (2**64 - 1)), out=z)
            for shift, factor in ((30, FACTORS[0]), (27, FACTORS[1]), (31, None)):
                np.right_shift(z, np.uint64(shift), out=other)
                np.bitwise_xor(z, other, out=z)
                if factor:
                    np.multiply(z, np.uint64(factor), out=z)
            if self._limit < 1 << 64 and z.max() >= np.uint64(self._limit):
                while (over := z >= np.uint64(self._limit)).any():
                    z[over] = mixed64(z[over] + np.uint64(INCREMENT))
            np.floor_divide(z, n, out=other)  # of a constant by multiplication, unlike the remainder
            np.multiply(other, n, out=other)
            np.subtract(z, other, out=z)
            times += np.bincount(z.view(np.int64), minlength=self._n)


def shares(seed: int, sizes: np.ndarray, block: int, count: int) -> np.ndarray:
    """How many of a replicate's sum(sizes) draws fall into a block, for each of `count` replicates.

    The draws are split binomially from the whole down to the block; every block that splits a run of blocks does it
    alike, so the blocks' shares add up.
    """
    low, high = 0, len(sizes)
    own = np.full(count, int(sizes.sum()), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(own, sizes[low:middle].sum() / sizes[low:high].sum())
        low, high, own = (low, middle, left) if block < middle else (middle, high, own - left)
    return own


def _blocks(clusters: DataFrame, key: str, count: int) -> tuple[DataFrame, np.ndarray, int]:
    """Clusters dealt to (block, run of replicates), sizes of the blocks, and replicates of a run."""
    clusters = stored(clusters, "clusters")  # they are counted, sized and drawn from, and made once
    n = clusters.count()
    dealt = clusters.withColumn("__block", F.pmod(F.xxhash64(F.col(key)), F.lit(max(1, -(-n // BLOCK)))).cast("int"))
    sizes = np.zeros(max(1, -(-n // BLOCK)), np.int64)
    for row in dealt.groupBy("__block").agg(F.count("*").alias("n")).collect():  # a row for each 65,536 clusters
        sizes[row["__block"]] = row["n"]
    step = max(1, min(count, PIECE // max(1, int(sizes.max()))))
    # Every run has a copy of its block's clusters, so there are no more runs than it takes to have pieces enough.
    step = max(step, -(-count // max(1, PIECES // len(sizes))))
    runs = -(-count // step)
    pieces = dealt.withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return pieces.repartition(min(len(sizes) * runs, 16_384), "__block", "__run").groupBy("__block", "__run"), sizes, step


def _times(key: tuple, sizes: np.ndarray, step: int, count: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first replicate, times each cluster is drawn in each of some replicates) of a piece."""
    block, run = (x.as_py() for x in key)
    n, first, last = int(sizes[block]), run * step, min(count, (run + 1) * step)
    own = shares(seed, sizes, block, count)[first:last]
    stream = seed if len(sizes) == 1 else int(mixed64(np.array([seed + INCREMENT * (block + 1) & (2**64 - 1)], np.uint64))[0])
    most = int(sizes.sum())
    few = max(1, (1 << 20) // n)
    draw = Drawer(stream, n)
    for at in range(0, last - first, few):
        part = own[at : at + few]
        times = np.zeros((len(part), n), np.int64)
        for k, draws in enumerate(part.tolist()):
            draw.add((first + at + k) * most, draws, times[k])
        yield first + at, times


def resampled_sums(clusters: DataFrame, key: str, columns: list[str], count: int, seed: int = SEED) -> DataFrame:
    """(r, *columns): for each of `count` replicates, which draw as many clusters as there are, the sums of columns.

    clusters has one row a cluster (key) with sufficient statistics, so what is resampled is that table, not its rows.
    All columns see the same draws.  Clusters are dealt to blocks of about 65,536; a replicate's draws are split over
    the blocks binomially, and in a block they go to clusters in the order of their keys by SplitMix64 with rejection.
    Up to that size there is one block, and the draws are those of one plain SplitMix64 sequence.  Null statistics
    count as 0.  No clusters: no rows.
    """
    pieces, sizes, step = _blocks(clusters.select(key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns)), key, count)

    def add_up(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(key, "ascending")])
        values = np.stack([table[c].to_numpy() for c in columns], 1)
        found = [(first, times @ values) for first, times in _times(group, sizes, step, count, seed)]
        numbers = np.concatenate([np.arange(len(x)) + first for first, x in found])
        sums = np.concatenate([x for _, x in found])
        return pa.table({"r": pa.array(numbers, pa.int64()), **{c: sums[:, k] for k, c in enumerate(columns)}})

    found = pieces.applyInArrow(add_up, ", ".join(["r long", *(f"`{c}` double" for c in columns)]))
    return found.groupBy("r").agg(*(F.sum(c).alias(c) for c in columns))


def resampled(clusters: DataFrame, key: str, count: int, seed: int = SEED) -> DataFrame:
    """(r, times and the clusters' columns): every cluster that a replicate draws, and how often; draws as in resampled_sums."""
    pieces, sizes, step = _blocks(clusters, key, count)
    columns = clusters.columns

    def draw(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(key, "ascending")]).select(columns)
        parts = []
        for first, times in _times(group, sizes, step, count, seed):
            r, place = np.nonzero(times)
            own = table.take(pa.array(place))
            parts.append(pa.table([pa.array(r + first, pa.int64()), pa.array(times[r, place], pa.int64()), *own.columns], names=["r", "times", *own.column_names]))
        return pa.concat_tables(parts)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clusters.schema)
    return pieces.applyInArrow(draw, f"r long, times long, {kinds}")


def bootstrap(clusters: DataFrame, key: str, total: str, weight: str, count: int, seed: int = SEED) -> DataFrame:
    """(r, value): sum(total) / sum(weight) of each replicate."""
    return resampled_sums(clusters, key, [total, weight], count, seed).select("r", F.try_divide(total, weight).alias("value"))


def paired_bootstrap(clusters: DataFrame, key: str, a: str, b: str, weight: str, count: int, seed: int = SEED) -> DataFrame:
    """(r, measure, value) of two systems and their difference, from identical resamples: sum / sum(weight)."""
    sums = resampled_sums(clusters, key, [a, b, weight], count, seed)
    parts = [("candidate", F.col(a)), ("comparator", F.col(b)), ("difference", F.col(a) - F.col(b))]
    each = F.array(*(F.struct(F.lit(n).alias("measure"), F.try_divide(x, F.col(weight)).alias("value")) for n, x in parts))
    return sums.select("r", F.explode(each).alias("m")).select("r", "m.measure", "m.value")


def interval(values: DataFrame, level: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """Percentile interval by linear interpolation."""
    tail = (1 - level) / 2
    return values.groupBy(*by).agg(F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"), F.avg("value").alias("mean"), F.count("*").alias("replicates"))


def lower_bound(values: DataFrame, place: int) -> DataFrame:
    """The value at a place in ascending order (from 1) of a row for each replicate."""
    rank = F.row_number().over(W.Window.orderBy("value", "r"))
    return values.withColumn("rank", rank).where(F.col("rank") == place).select("value")


def splitmix64(x: Column) -> Column:
    """The 64-bit mixer's output as an unsigned decimal string, for signed 64-bit input; by an Arrow UDF, as it wraps."""
    @F.pandas_udf("string")
    def mix(values: pd.Series) -> pd.Series:
        return pd.Series(mixed64(values.to_numpy(np.int64).view(np.uint64) + np.uint64(INCREMENT)).astype(str))

    return mix(x)


def track_deltas(a: DataFrame, b: DataFrame, track: list[str], game: str, value: str) -> DataFrame:
    """Per game the mean over its two sides of the difference of track means; games with one side are left out."""
    mean = lambda t, n: t.groupBy(*track).agg(F.avg(value).alias(n))
    return game_deltas(mean(a, "x").join(mean(b, "y"), track), game)


def game_deltas(tracks: DataFrame, game: str) -> DataFrame:
    """As track_deltas, of a table of tracks with both means x and y."""
    return tracks.groupBy(game).agg(F.avg(F.col("x") - F.col("y")).alias("delta"), F.count("*").alias("sides")).where("sides = 2").select(game, "delta")


def gates(metrics: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """thresholds (keys, gate, op, bound) against metrics (keys, value): passed, failed or missing.

    A metric that is absent, null, NaN or infinite is missing.  op is one of >=, >, <=, <, =.
    """
    joined = thresholds.join(metrics, keys, "left")
    v, b = F.col("value"), F.col("bound")
    gone = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    ok = F.when(F.col("op") == ">=", v >= b).when(F.col("op") == ">", v > b).when(F.col("op") == "<=", v <= b).when(F.col("op") == "<", v < b).when(F.col("op") == "=", v == b)
    return joined.withColumn("status", F.when(gone, "missing").when(F.coalesce(ok, F.lit(False)), "passed").otherwise("failed"))


def deltas(metrics: DataFrame, keys: list[str], candidate: str, comparator: str) -> DataFrame:
    """candidate - comparator for each metric that the candidate has."""
    a = metrics.where(F.col("system") == candidate).select(*keys, F.col("value").alias("x"))
    b = metrics.where(F.col("system") == comparator).select(*keys, F.col("value").alias("y"))
    return a.join(b, keys, "left").select(*keys, (F.col("x") - F.col("y")).alias("value"))


def decide(found: DataFrame) -> DataFrame:
    """Passed only if nothing failed and nothing is missing; a gate named twice decides nothing."""
    n = lambda s: F.count_if(F.col("status") == s)
    line = F.concat_ws("|", "gate", "op", F.format_number("bound", 6))
    return found.agg(n("passed").alias("passed"), n("failed").alias("failed"), n("missing").alias("missing"), ((n("failed") == 0) & (n("missing") == 0) & (F.count("*") == F.count_distinct("gate")) & (F.count("*") > 0)).alias("accepted"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("contract"))


def bootstrap_statistic(clusters: DataFrame, key: str, statistic: Column, count: int, seed: int = SEED) -> DataFrame:
    """(r, value): any aggregate expression over the drawn clusters' columns, `times` telling how often each was drawn."""
    return resampled(clusters, key, count, seed).groupBy("r").agg(statistic.alias("value"))


#: Absolute bounds of a side's metrics, and of its horizons: top k after so many observed steps (fixed values).
ABSOLUTE = [("track_top_1", ">=", 0.10), ("track_top_3", ">=", 0.25), ("track_top_5", ">=", 0.35), ("row_nll", "<=", 4.50), ("row_brier", "<=", 0.970), ("ece", "<=", 0.080)]
HORIZONS = [("top_1", 10, 0.040), ("top_1", 15, 0.070), ("top_1", 20, 0.100), ("top_3", 20, 0.250)]


def absolute(report: DataFrame, horizons: DataFrame, sides: tuple[str, ...] = ("white", "black")) -> DataFrame:
    """gate, side, metric, op, bound, value, status of each side's bounds, from a report (side, metric, value) and horizons (group, horizon, top_1, top_3)."""
    bounds = [*ABSOLUTE, *((f"horizon_{h}_{m}", ">=", b) for m, h, b in HORIZONS)]
    wanted = [(f"{side}.{metric}", side, metric, op, bound) for side in sides for metric, op, bound in bounds]
    pairs = F.explode(F.array(*(F.struct(F.concat(F.lit("horizon_"), F.col("horizon").cast("string"), F.lit(f"_{m}")).alias("metric"), F.col(m).alias("value")) for m in ("top_1", "top_3")))).alias("m")
    own = report.select("side", "metric", "value").unionByName(horizons.select(F.col("group").alias("side"), pairs).select("side", "m.*"))
    return gates(own, report.sparkSession.createDataFrame(wanted, "gate string, side string, metric string, op string, bound double"), ["side", "metric"])


def slices_complete(rows: DataFrame, dims: list[str], truth: str, classes: int) -> DataFrame:
    """rows, a sum over the slices of each dimension, classes, complete: one aggregate over all slices.

    complete: every dimension's slices add up to all rows (no row lacks a value), and every class has rows on its own.
    """
    cells = rows.groupingSets([[F.col(d)] for d in dims], *dims).agg(F.count("*").alias("n"), F.grouping_id(*dims).alias("level"))
    mine = {d: F.col("level") == (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - k)) for k, d in enumerate(dims)}
    every = lambda d: F.sum(F.when(mine[d], F.col("n")))
    named = lambda d: F.coalesce(F.sum(F.when(mine[d] & F.col(d).isNotNull(), F.col("n"))), F.lit(0))
    found = cells.agg(every(dims[0]).alias("rows"), *(named(d).alias(f"by_{d}") for d in dims), F.count_if(mine[truth] & F.col(truth).isNotNull()).alias("classes"))
    same = reduce(lambda a, b: a & b, (F.col(f"by_{d}") == F.col("rows") for d in dims))
    return found.withColumn("complete", F.coalesce(same & (F.col("classes") == classes), F.lit(False)))


def coverage(scores: DataFrame, diagnostics: DataFrame, unscorable: Column) -> DataFrame:
    """rows, scored, unscorable, max_sum_error, violations, passed: every row is scored or known to be unscorable, distributions sum to 1 within 1e-6, and no eliminated class has mass."""
    counts = scores.agg(F.count("*").alias("rows"), F.count_if(F.col("nll").isNotNull() & ~unscorable).alias("scored"), F.count_if(unscorable).alias("unscorable"))
    found = counts.crossJoin(diagnostics.select("max_sum_error", "violations", "max_eliminated_p"))  # one row each
    passed = (F.col("scored") + F.col("unscorable") == F.col("rows")) & (F.col("max_sum_error") <= 1e-6) & (F.col("violations") == 0) & (F.col("max_eliminated_p") == 0)
    return found.withColumn("passed", passed & (F.col("rows") > 0)).drop("max_eliminated_p")


def calibration_gates(before: DataFrame, after: DataFrame) -> DataFrame:
    """side, gate, value, passed: calibration moves no top-k credit by more than 1e-12, its error is no greater and its loss strictly less.

    before, after: reports (side, metric, value) of the same rows.  A metric that is missing on one side of the comparison fails its gate.
    """
    ranking = [f"{grain}_top_{k}" for grain in ("row", "track") for k in (1, 3, 5)]
    both = before.select("side", "metric", F.col("value").alias("x")).join(after.select("side", "metric", F.col("value").alias("y")), ["side", "metric"], "full_outer").where(F.col("metric").isin(*ranking, "ece", "row_nll"))
    change = F.col("y") - F.col("x")
    value = F.when(F.col("metric").isin(*ranking), F.abs(change)).otherwise(change)
    passed = F.when(F.col("metric").isin(*ranking), value <= 1e-12).when(F.col("metric") == "ece", value <= 0).otherwise(value < 0)
    return both.select("side", F.col("metric").alias("gate"), value.alias("value"), F.coalesce(passed & ~F.isnan(value), F.lit(False)).alias("passed"))


#: Checks of a treatment against its control: metrics (or their common beginning), whether more is better, and how much may be lost.
RELIABILITY = [
    ("top_1", "track_top_1", True, 0.0), ("top_3", "track_top_3", True, 0.0), ("nll", "track_nll", False, 0.0), ("brier", "track_brier", False, 0.0), ("calibration", "ece", False, 0.0), ("horizons", "horizon_%", True, 0.0),
    ("trigger", "trigger", True, 0.0), ("forced", "forced", True, 0.0), ("classes", "class_%", True, 0.01),
]

#: What a blend must pass besides: top 5, each side, the heads' losses, parameters.
BLEND = [
    ("top_5", "track_top_5", True, 0.0), *(("sides", f"{side}_track_{m}", more, 0.0) for side in ("white", "black") for m, more in (("top_1", True), ("top_3", True), ("nll", False))),
    *(("auxiliary", f"{head}_{m}", False, 0.0) for head in ("trigger", "forced") for m in ("nll", "brier")), ("parameters", "parameters", True, 0.0),
]


def reliability(table: DataFrame, control: str, treatment: str, extra: list = ()) -> DataFrame:
    """check, ok: the eleven checks of a treatment against its control, from long metrics (system, metric, value), and `extra` ones (as BLEND).

    A check of several entries needs all of them.  primary: (top 1, top 3, -nll) of the treatment is greater, compared in this order.  authority: for both, rows were
    checked, none of them without a mask, no eliminated class has mass.  A metric that one system lacks, or that is null
    or not finite, fails its check, and so does a check that finds no metric at all.
    """
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    one = lambda name: table.where(F.col("system") == name).select("metric", finite.alias(name))
    both = one(control).withColumnRenamed(control, "x").join(one(treatment).withColumnRenamed(treatment, "y"), "metric", "full_outer")
    x, y = F.col("x"), F.col("y")
    passed: dict[str, Column] = {}
    for check, name, more, slack in [*RELIABILITY, *extra]:
        kept = F.coalesce(F.min(F.when(F.col("metric").like(name), F.coalesce((y - x if more else x - y) >= -slack, F.lit(False)).cast("int"))) == 1, F.lit(False))
        passed[check] = passed[check] & kept if check in passed else kept
    every = [kept.alias(check) for check, kept in passed.items()]
    value = lambda c, name: F.max(F.when(F.col("metric") == name, c))
    order = [(value(c, "track_top_1"), value(c, "track_top_3"), -value(c, "track_nll")) for c in (y, x)]
    known = F.array(*order[0], *order[1])
    primary = F.struct(*order[0]) > F.struct(*order[1])
    clean = [(value(c, "checked") > 0) & (value(c, "masked") == value(c, "checked")) & (value(c, "violations") == 0) & (value(c, "max_eliminated") == 0) for c in (x, y)]
    wide = both.agg((primary & F.forall(known, lambda v: v.isNotNull())).alias("primary"), *every, F.coalesce(clean[0] & clean[1], F.lit(False)).alias("authority"))
    names = ["primary", *passed, "authority"]
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in names))).alias("c")).select("c.*")


def claim(scores: DataFrame, game: str, track: list[str], truth: str, p_truth: str, claimed: list[str], known: list[str], least_games: int = 2_000, least_tracks: int = 10) -> DataFrame:
    """games, undercovered, unknown, zero_tracks, failures, satisfied: whether what is claimed of classes can be said.

    There must be `least_games` games, `least_tracks` tracks of each claimed class, no claimed class that is not known, and no
    track that gives its truth no mass; nothing claimed satisfies nothing.
    """
    tracks = scores.groupBy(*track).agg(F.max(truth).alias("__truth"), F.min(p_truth).alias("__p"))
    wanted = scores.sparkSession.createDataFrame([(c, c in known) for c in claimed], "__truth string, known boolean")
    support = wanted.join(tracks.groupBy("__truth").agg(F.count("*").alias("n")), "__truth", "left").fillna(0, ["n"])
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("__truth")))), ",")
    covered = support.agg(names(F.col("n") < least_tracks).alias("undercovered"), names(~F.col("known")).alias("unknown"), F.count("*").alias("claims"))  # the claimed classes
    counts = scores.agg(F.count_distinct(game).alias("games")).crossJoin(tracks.agg(F.count_if(F.col("__p") == 0).alias("zero_tracks"))).crossJoin(covered)  # one row each
    failures = F.filter(F.array(F.when(F.col("games") < least_games, "games"), F.when(F.col("unknown") != "", "unknown"), F.when(F.col("undercovered") != "", "tracks"), F.when(F.col("zero_tracks") > 0, "zero truth")), lambda x: x.isNotNull())
    return counts.withColumn("failures", F.array_join(failures, ",")).withColumn("satisfied", (F.col("failures") == "") & (F.col("claims") > 0)).drop("claims")


def release_checks(table: DataFrame, control: str, treatment: str, deltas: DataFrame, values: DataFrame, place: int, least_gain: float = 0.001) -> DataFrame:
    """check, ok: all of reliability and BLEND, and that the paired gain agrees with the metrics, is large enough and surely above 0.

    deltas: a row for each game (delta: treatment less control); values: bootstrap replicates (r, value) of their mean.
    agreement: the mean delta and the difference of track_top_1 are within 1e-12.
    """
    both = table.where(F.col("metric") == "track_top_1").agg((F.max(F.when(F.col("system") == treatment, F.col("value"))) - F.max(F.when(F.col("system") == control, F.col("value")))).alias("change"))
    found = deltas.agg(F.avg("delta").alias("gain"), F.lit(1).alias("one")).join(lower_bound(values, place).withColumn("one", F.lit(1)), "one", "left").crossJoin(both)  # one row each
    rules = {"agreement": F.abs(F.col("gain") - F.col("change")) <= 1e-12, "gain": F.col("gain") >= least_gain, "bound": F.col("value") > 0}
    paired = found.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for name, ok in rules.items()))).alias("c")).select("c.*")
    return reliability(table, control, treatment, BLEND).unionByName(paired)


#: Bounds of a side's classes and parameters, and of a member's means over both sides (fixed values).
CLASS_BOUNDS = [("above_uniform", ">=", 0.80), ("macro_top_3", ">=", 0.18), ("starved", "=", 0.0), ("parameters", ">=", 0.20), ("parameter_coverage", ">=", 0.95)]
MEMBER_BOUNDS = [("mean_top_3", ">=", 0.18), ("mean_nll", "<=", 4.90)]


def class_metrics(scores: DataFrame, classes: list[str], track: list[str], right: Column, eligible: Column, least_tracks: int = 25) -> DataFrame:
    """(part, metric, value) of each side: means over classes, classes without any top-5 credit though they have tracks enough (starved), parameters.

    Means over classes are null unless every class has rows.  right: whether a row's parameters are right (null: not
    scorable); eligible: whether the row has parameters at all.
    """
    tracks = scores.groupBy("side", "truth", *(t for t in track if t != "side")).agg(F.sum("credit_3").alias("c3"), F.sum("credit_5").alias("c5"), F.count("*").alias("n"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & right.isNotNull()).alias("judged"), F.count_if(eligible & right).alias("right"))
    cells = tracks.groupBy("side", "truth").agg((F.sum("c3") / F.sum("n")).alias("top_3"), (F.sum("c5") / F.sum("n")).alias("top_5"), F.count("*").alias("tracks"), *(F.sum(c).alias(c) for c in ("eligible", "judged", "right")))
    known = F.col("truth").isin(classes)
    every = F.count_if(known) == len(classes)
    found = cells.groupBy(F.col("side").alias("part")).agg(
        F.when(every, F.avg(F.when(known, (F.col("top_5") > 5 / len(classes)).cast("double")))).alias("above_uniform"), F.when(every, F.avg(F.when(known, F.col("top_3")))).alias("macro_top_3"),
        F.count_if((F.col("tracks") >= least_tracks) & (F.col("top_5") == 0)).cast("double").alias("starved"), F.try_divide(F.sum("right"), F.sum("judged")).alias("parameters"), F.try_divide(F.sum("judged"), F.sum("eligible")).alias("parameter_coverage"),
    )
    return found.select("part", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c, *_ in CLASS_BOUNDS))).alias("m")).select("part", "m.*")


def member_metrics(scores: DataFrame, track: list[str]) -> DataFrame:
    """(part, metric, value) of each system: the mean of both sides' track top-3 and of their row losses; null if a side is missing or its loss infinite."""
    tracks = scores.groupBy("system", *track).agg(F.avg("credit_3").alias("t3"), F.sum("nll").alias("loss"), F.count("nll").alias("finite"), F.count("*").alias("n"))
    sides = tracks.groupBy("system", "side").agg(F.avg("t3").alias("t3"), F.when(F.sum("finite") == F.sum("n"), F.sum("loss") / F.sum("n")).alias("nll"))
    both = F.count("*") == 2
    found = sides.groupBy(F.col("system").alias("part")).agg(F.when(both, F.avg("t3")).alias("mean_top_3"), F.when(both & (F.count("nll") == 2), F.avg("nll")).alias("mean_nll"))
    return found.select("part", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c, *_ in MEMBER_BOUNDS))).alias("m")).select("part", "m.*")


def class_gates(metrics: DataFrame, members: list[str], sides: tuple[str, ...] = ("white", "black")) -> DataFrame:
    """gate, part, metric, op, bound, value, status of every side's and member's bounds; what has no metric is missing."""
    wanted = [(f"{part}.{m}", part, m, op, bound) for parts, bounds in ((sides, CLASS_BOUNDS), (members, MEMBER_BOUNDS)) for part in parts for m, op, bound in bounds]
    return gates(metrics, metrics.sparkSession.createDataFrame(wanted, "gate string, part string, metric string, op string, bound double"), ["part", "metric"])
