"""Bindings of the star-schema tables to the engine's tables, in integer arithmetic, so that ties are exact.

A track is (game, side): a customer and the parity of the supplier.  Steps number a track's lineitems.  Every step
has a distribution over the six part types, with some eliminated; truth is the greatest part type of the track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
#: Multipliers of a system's weights: order key, step, class, modulus.
SYSTEMS = {"A": (7, 13, 17, 23), "B": (5, 11, 19, 29)}
TRACK = ["game", "side"]
ROW = ["game", "side", "step"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, side, step, okey, truth.

    A track's lines of one order and date follow each other and differ in nothing that is told of a step, so what is
    brought together and sorted is a row an order, with each side's number of lines and greatest part type.
    """
    white = F.col("l_suppkey") % 2 == 0
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.coalesce(white, F.lit(False)).alias("white"))
    kinds = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "white", "p_type")
    sides = {"white": F.col("white"), "black": ~F.col("white")}
    each = [x for name, own in sides.items() for x in (F.count_if(own).alias(f"n_{name}"), F.max(F.when(own, F.col("p_type"))).alias(f"kind_{name}"))]
    # Dealt by order first: lines of an order hardly meet before, and strings are sorted to be added up.
    orders = kinds.repartition("l_orderkey").groupBy("l_orderkey").agg(*each)
    orders = orders.join(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("game"), "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    game = W.Window.partitionBy("game")
    until = game.orderBy("o_orderdate", "l_orderkey").rowsBetween(W.Window.unboundedPreceding, 0)
    own = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"n_{name}").alias("n"), F.sum(f"n_{name}").over(until).alias("last"), F.max(f"kind_{name}").over(game).alias("truth"))
    tracks = orders.select("game", F.col("l_orderkey").alias("okey"), F.array(*map(own, sides)).alias("sides")).select("game", "okey", F.explode("sides").alias("s")).where("s.n > 0")
    each_step = F.explode(F.sequence(F.col("s.last") - F.col("s.n") + 1, F.col("s.last"))).alias("step")
    return tracks.select("game", "s.side", "okey", each_step, "s.truth").select(*ROW, "okey", "truth")


def distributions(spark: SparkSession, sf_dir: str, systems: str = "A") -> DataFrame:
    """game, side, step, okey, truth, o: one row for each step, with an array of its classes.

    Each has class_id, family, eliminated, w and p of the first system; with two systems, `other` is the second one's p.
    """
    rows, weights = steps(spark, sf_dir).select(*ROW, "okey", "truth"), {}
    for s in systems:
        weights[s] = system_weights(s)
    rows = rows.withColumns({f"__w{s}": F.array(*w) for s, w in weights.items()})
    totals = {s: F.aggregate(f"__w{s}", F.lit(0).cast("long"), lambda t, x: t + x) for s in systems}
    rows = rows.withColumns({f"__t{s}": t for s, t in totals.items()})
    options = []
    for k, name in enumerate(CLASSES):
        w = [F.get(f"__w{s}", F.lit(k)) for s in systems]
        p = [(w[n] / F.col(f"__t{s}")).alias(("p", "other")[n]) for n, s in enumerate(systems)]
        options.append(F.struct(F.lit(name).alias("class_id"), F.lit(k % 2).alias("family"), gone(k, name).alias("eliminated"), w[0].alias("w"), *p))
    return rows.select(*ROW, "okey", "truth", F.array(*options).alias("o"))


def system_weights(system: str) -> list[Column]:
    """A system's weight of each class of a step."""
    a, b, c, m = SYSTEMS[system]
    return [F.when(gone(k, name), 0).otherwise(1 + (F.col("okey") * a + F.col("step") * b + k * c) % m).cast("long") for k, name in enumerate(CLASSES)]


def gone(k: int, name: str) -> Column:
    """Whether a step eliminates class k."""
    return ((F.col("okey") + k) % 5 == 0) & (F.col("truth") != name)


def predictions(spark: SparkSession, sf_dir: str, systems: str = "A") -> DataFrame:
    """game, side, step, okey, truth and what `distributions` has of each class: one row for each step and class."""
    return distributions(spark, sf_dir, systems).select(*ROW, "okey", "truth", F.explode("o").alias("o")).select(*ROW, "okey", "truth", "o.*")


CLASS_VALUES = ", ".join(f"({k}, '{name}')" for k, name in enumerate(CLASSES))

STEPS_SQL = """
line AS (
  SELECT o_custkey AS game, CASE WHEN l_suppkey % 2 = 0 THEN 'white' ELSE 'black' END AS side, l_orderkey AS okey, p_type AS kind,
    row_number() OVER (PARTITION BY o_custkey, l_suppkey % 2 ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS step
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
steps AS (SELECT *, max(kind) OVER (PARTITION BY game, side) AS truth FROM line)"""


def pred_sql(system: str = "A", name: str = "pred") -> str:
    a, b, c, m = SYSTEMS[system]
    return f"""
{name}_w AS (
  SELECT game, side, step, okey, truth, class_id, c % 2 AS family, (okey + c) % 5 = 0 AND truth <> class_id AS eliminated,
    CASE WHEN (okey + c) % 5 = 0 AND truth <> class_id THEN 0 ELSE 1 + (okey * {a} + step * {b} + c * {c}) % {m} END AS w
  FROM steps, (VALUES {CLASS_VALUES}) AS k(c, class_id)),
{name} AS (SELECT *, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY game, side, step) AS DOUBLE) AS p FROM {name}_w)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join([STEPS_SQL, *parts])


#: Row scores of `pred`, for SQL that builds on them.
SCORE_SQL = """
pt AS (SELECT *, max(CASE WHEN class_id = truth THEN p END) OVER (PARTITION BY game, side, step) AS pt FROM {pred}),
{name} AS (
  SELECT game, side, step, truth, any_value(pt) AS p_truth,
    count(*) FILTER (p > pt) AS above, count(*) FILTER (p = pt) AS tied, max(p) AS confidence,
    sum((p - CASE WHEN class_id = truth THEN 1 ELSE 0 END) * (p - CASE WHEN class_id = truth THEN 1 ELSE 0 END)) AS brier,
    CASE WHEN any_value(pt) > 0 THEN -ln(any_value(pt)) END AS nll,
    abs(sum(p) - 1) AS sum_error,
    CASE WHEN 1 - count(*) FILTER (p > pt) <= 0 THEN 0.0 ELSE least(1.0, (1 - count(*) FILTER (p > pt)) / count(*) FILTER (p = pt)) END AS credit_1,
    CASE WHEN 3 - count(*) FILTER (p > pt) <= 0 THEN 0.0 ELSE least(1.0, (3 - count(*) FILTER (p > pt)) / count(*) FILTER (p = pt)) END AS credit_3,
    CASE WHEN 5 - count(*) FILTER (p > pt) <= 0 THEN 0.0 ELSE least(1.0, (5 - count(*) FILTER (p > pt)) / count(*) FILTER (p = pt)) END AS credit_5
  FROM pt GROUP BY game, side, step, truth)"""


def score_sql(name: str = "s", pred: str = "pred") -> str:
    return SCORE_SQL.format(name=name, pred=pred)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
HYPOTHESIS = ["game", "hypothesis"]
#: Weights of a class's four variants.
VARIANT_WEIGHTS = (1, 2, 3, 4)


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, step, event_id, kind, k, truth: a user's events in order; truth is the user's greatest event type."""
    user = W.Window.partitionBy("game")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("game"), "event_id", "ts", F.col("event_type").alias("kind"), F.from_json("props", "k int")["k"].alias("k"))
    return events.select("game", F.row_number().over(user.orderBy("ts", "event_id")).cast("long").alias("step"), "event_id", "kind", "k", F.max("kind").over(user).alias("truth"))


def hypotheses(spark: SparkSession) -> DataFrame:
    """h, class_id, variant, prior: twenty hypotheses, four to a class."""
    rows = [(4 * c + v, name, v, VARIANT_WEIGHTS[v] / sum(VARIANT_WEIGHTS) / len(EVENT_TYPES)) for c, name in enumerate(EVENT_TYPES) for v in range(4)]
    return spark.createDataFrame(rows, "h long, class_id string, variant int, prior double")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event and hypothesis: known, allowed (of 5), legal, log_likelihood (null if unknown), prior."""
    rows = event_steps(spark, sf_dir).join(F.broadcast(hypotheses(spark)))
    mixed = F.col("event_id") + F.col("h")
    known = mixed % 7 != 0
    legal = (mixed % 11 != 0) | (F.col("class_id") == F.col("truth"))
    allowed = F.when(known, 1 + mixed % 5)
    return rows.select("game", "step", "event_id", "kind", "truth", "h", "class_id", "variant", "prior", known.alias("known"), allowed.alias("allowed"), legal.alias("legal"), F.when(known, -F.log(allowed.cast("double"))).alias("log_likelihood"))


EVENTS_SQL = """
ev AS (
  SELECT user_id AS game, event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, max(event_type) OVER (PARTITION BY user_id) AS truth FROM events)"""

HYPOTHESES_SQL = "hyp(h, class_id, variant, prior) AS (VALUES " + ", ".join(f"({4 * c + v}, '{name}', {v}, {VARIANT_WEIGHTS[v] / sum(VARIANT_WEIGHTS) / len(EVENT_TYPES)!r}::DOUBLE)" for c, name in enumerate(EVENT_TYPES) for v in range(4)) + ")"

EVIDENCE_SQL = """
evidence AS (
  SELECT game, step, event_id, kind, truth, h, class_id, variant, prior, (event_id + h) % 7 <> 0 AS known,
    CASE WHEN (event_id + h) % 7 <> 0 THEN 1 + (event_id + h) % 5 END AS allowed,
    (event_id + h) % 11 <> 0 OR class_id = truth AS legal,
    CASE WHEN (event_id + h) % 7 <> 0 THEN -ln(1 + (event_id + h) % 5) END AS log_likelihood
  FROM ev CROSS JOIN hyp)"""

POSTERIOR_SQL = """
acc AS (
  SELECT *, max(CASE WHEN known AND NOT legal THEN 1 ELSE 0 END) OVER w = 1 AS eliminated, ln(prior) + sum(coalesce(log_likelihood, 0)) OVER w AS log_weight
  FROM evidence WINDOW w AS (PARTITION BY game, h ORDER BY step ROWS UNBOUNDED PRECEDING)),
top AS (SELECT *, max(CASE WHEN NOT eliminated THEN log_weight END) OVER (PARTITION BY game, step) AS m FROM acc),
ex AS (SELECT *, CASE WHEN eliminated THEN 0.0 ELSE exp(log_weight - m) END AS e FROM top),
post AS (SELECT *, CASE WHEN sum(e) OVER (PARTITION BY game, step) > 0 THEN e / sum(e) OVER (PARTITION BY game, step) ELSE 0.0 END AS p FROM ex)"""

CLASS_SQL = """
cls AS (
  SELECT game, step, truth, class_id, sum(p) AS p, bool_and(eliminated) AS eliminated, count(*) FILTER (NOT eliminated) AS live, count(*) AS variants
  FROM post GROUP BY game, step, truth, class_id)"""


def posterior_sql() -> str:
    return "WITH " + ",".join([EVENTS_SQL, HYPOTHESES_SQL, EVIDENCE_SQL, POSTERIOR_SQL, CLASS_SQL])
