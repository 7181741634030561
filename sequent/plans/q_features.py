"""Function, identifiability, sampling and extension queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.functions import columns as c
from sequent.operators import identify as i
from sequent.operators import metrics as m
from sequent.operators import sampling as p
from sequent.operators import sequences as s
from sequent.operators.comparators import let
from sequent.plans import adapters as a
from sequent.plans.adapters import ROW, TRACK, posterior_sql, pred_sql, predictions, read, with_sql
from sequent.plans.q_metrics import rounded
from sequent.plans.q_sequences import EV, classes, post

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


PRED = with_sql(pred_sql())
P = posterior_sql()


@query("f_logsumexp", "SELECT l_orderkey, round(ln(sum(exp(l_discount * 10))), 6) AS total FROM lineitem GROUP BY l_orderkey")
def f_logsumexp(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount").cast("double") * 10).alias("x"))
    return rounded(rows.withColumn("total", s.log_sum_exp(F.col("x"), W.Window.partitionBy("l_orderkey"))).groupBy("l_orderkey").agg(F.max("total").alias("total")))


@query("f_probability", f"{P} SELECT game, step, h, round(CASE WHEN eliminated THEN 0 ELSE exp(log_weight) END, 6) AS p FROM post")
def f_probability(spark, d):
    return rounded(post(spark, d).select(*EV, "h", c.probability(F.col("log_weight"), F.col("eliminated")).alias("p")))


@query("f_entropy_bits", PRED + " SELECT game, side, step, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS bits FROM pred GROUP BY game, side, step")
def f_entropy_bits(spark, d):
    return rounded(predictions(spark, d).groupBy(*ROW).agg(s.entropy_bits(F.col("p")).alias("bits")))


@query("f_move_loglik", "SELECT event_id, round(-ln(1 + event_id % 7) * 0.8 + CASE WHEN event_id % 7 = 0 THEN 0.1 ELSE 0 END + CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.05 END * (0.5 * -(event_id % 3) + 0.25 * -(user_id % 5)), 6) AS ll FROM events")
def f_move_loglik(spark, d):
    signals = {"a": -(F.col("event_id") % 3).cast("double"), "b": -(F.col("user_id") % 5).cast("double")}
    ll = c.move_log_likelihood(1 + F.col("event_id") % 7, F.col("event_id") % 7 == 0, F.col("event_type") == "click", signals, {"a": 0.5, "b": 0.25}, 0.8, 0.1)
    return rounded(read(spark, d, "events").select("event_id", ll.alias("ll")))


@query("f_prior_expand", "SELECT s_suppkey, round((1.0 / 25) * (s_suppkey % 9 + 1) / sum(s_suppkey % 9 + 1) OVER (PARTITION BY s_nationkey), 6) AS prior FROM supplier")
def f_prior_expand(spark, d):
    rows = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.lit(1 / 25).alias("q"), (F.col("s_suppkey") % 9 + 1).alias("w"))
    return rounded(rows.select("s_suppkey", c.expanded_prior("q", "w", ["s_nationkey"]).alias("prior")))


def parameters():
    return F.create_map(F.lit("size"), (F.col("p_partkey") % 7).cast("string"), F.lit("kind"), F.col("p_type"), F.lit("seed"), F.lit("1"))


@query("f_canonical_params", """SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN p_brand || '::{"a":[' || (p_partkey % 7) || ',0,{"kind":"' || p_type || '","none":null}],"big":1e+21,"small":1.5e-7,"é":' || CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE CAST(p_partkey % 7 AS VARCHAR) END || '.5}' END AS id FROM part""")
def f_canonical_params(spark, d):
    """Nested parameters with unsorted keys, blanks, signed zeros and exponents; every thirteenth has a number that is not finite."""
    size = (F.col("p_partkey") % 7).cast("string")
    text = F.concat(F.lit('{"é": '), size, F.lit('.50, "small":15e-8, "big": 1000000000000000000000, "a" : ['), size, F.lit('.0, -0.0, {"none":null,"kind":"'), F.col("p_type"), F.lit('"}]}'))
    text = F.when(F.col("p_partkey") % 13 == 0, F.lit('{"a": NaN}')).otherwise(text)
    return read(spark, d, "part").select("p_partkey", c.hypothesis_id(F.col("p_brand"), text).alias("id"))


@query("f_supervised_params", "SELECT p_partkey, '{\"kind\":\"' || p_type || '\",\"size\":\"' || (p_partkey % 7) || '\"}' AS label FROM part")
def f_supervised_params(spark, d):
    return read(spark, d, "part").select("p_partkey", c.canonical_parameters(c.supervised_parameters(parameters())).alias("label"))


@query("f_encode_params", "WITH v AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part WHERE p_partkey % 2 = 0)) SELECT p_partkey, coalesce(v.id, -1) AS id, v.id IS NOT NULL AS observed FROM part LEFT JOIN v USING (p_type)")
def f_encode_params(spark, d):
    from sequent.operators import posteriors as o

    part = read(spark, d, "part")
    found = o.vocabulary(part.where("p_partkey % 2 = 0"), F.col("p_type"))
    return part.join(found, part["p_type"] == found["token"], "left").select("p_partkey", F.coalesce(F.col("id"), F.lit(-1)).cast("long").alias("id"), F.col("id").isNotNull().alias("observed"))


U = "CAST('0x' || substr(sha256('{salt}:' || o_custkey), 1, 13) AS BIGINT) / 4503599627370496.0"


@query("f_hash_split", f"SELECT o_orderkey, CASE WHEN {U.format(salt='split')} < 0.8 THEN 'train' WHEN {U.format(salt='split')} < 0.9 THEN 'validation' ELSE 'test' END AS part FROM orders")
def f_hash_split(spark, d):
    return read(spark, d, "orders").select("o_orderkey", c.hash_split("split", F.col("o_custkey"), [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).alias("part"))


@query("f_validation_partition", f"SELECT o_orderkey, CASE WHEN {U.format(salt='valid')} < 0.7 THEN 'selection' WHEN {U.format(salt='valid')} < 0.85 THEN 'calibration-fit' ELSE 'gate' END AS part FROM orders")
def f_validation_partition(spark, d):
    return read(spark, d, "orders").select("o_orderkey", c.hash_split("valid", F.col("o_custkey"), [("selection", 0.7), ("calibration-fit", 0.15), ("gate", 0.15)]).alias("part"))


@query("f_horizon_band", a.with_sql() + " SELECT CASE WHEN step < 5 THEN '0-4' WHEN step < 10 THEN '5-9' WHEN step < 20 THEN '10-19' WHEN step < 40 THEN '20-39' ELSE '40+' END AS band, count(*) AS n FROM steps GROUP BY 1")
def f_horizon_band(spark, d):
    return a.steps(spark, d).groupBy(c.horizon_band(F.col("step")).alias("band")).agg(F.count("*").alias("n"))


MOVE = "chr(CAST(97 + event_id % 8 AS INT)) || (1 + user_id % 8) || chr(CAST(97 + (event_id * 3) % 8 AS INT)) || (1 + event_id % 7) || CASE WHEN event_id % 5 = 0 THEN 'q' ELSE '' END"


def moves(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    letter = lambda x: F.char((97 + x % 8).cast("int"))
    uci = F.concat(letter(e), (1 + u % 8).cast("string"), letter(e * 3), (1 + e % 7).cast("string"), F.when(e % 5 == 0, "q").otherwise(""))
    return read(spark, d, "events").select("event_id", uci.alias("uci"))


@query("f_move_index", "SELECT event_id, ((event_id % 8 + 8 * (user_id % 8)) * 64 + (event_id * 3) % 8 + 8 * (event_id % 7)) * 5 + CASE WHEN event_id % 5 = 0 THEN 4 ELSE 0 END AS idx FROM events")
def f_move_index(spark, d):
    return moves(spark, d).select("event_id", c.move_index(F.col("uci")).cast("long").alias("idx"))


@query("f_semantic_hash", f"SELECT event_id, sha256('{{\"moves\":\"' || {MOVE} || '\",\"start\":\"s\"}}') AS h FROM events")
def f_semantic_hash(spark, d):
    return moves(spark, d).select("event_id", c.semantic_hash(start=F.lit("s"), moves=F.col("uci")).alias("h"))


@query("f_title_key", "SELECT c_custkey, lower(c_mktsegment) || ' ''x' AS k FROM customer")
def f_title_key(spark, d):
    from sequent.operators.joins import title_key

    return read(spark, d, "customer").select("c_custkey", title_key(F.concat(F.lit(" "), "c_mktsegment", F.lit(" \t ‘X "))).alias("k"))


@query("f_token_vocab", "WITH t AS (SELECT DISTINCT role AS token FROM conversations) SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM t UNION ALL VALUES ('<pad>', 0), ('<unknown>', 1)")
def f_token_vocab(spark, d):
    from sequent.operators import posteriors as o

    found = o.vocabulary(read(spark, d, "conversations"), F.col("role"))
    reserved = spark.createDataFrame([("<pad>", 0), ("<unknown>", 1)], "token string, id long")
    return found.select("token", (F.col("id") + 2).cast("long").alias("id")).unionByName(reserved)


@query("f_encode_sequence", "WITH x AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id), y AS (SELECT conv_id, list_transform(list_slice(r, greatest(1, len(r) - 3), len(r)), lambda t: CASE t WHEN 'assistant' THEN 2 WHEN 'user' THEN 3 ELSE 1 END) AS e FROM x) SELECT conv_id, array_to_string(e || list_transform(range(4 - len(e)), lambda z: 0), ',') AS ids FROM y")
def f_encode_sequence(spark, d):
    ids = F.create_map(F.lit("assistant"), F.lit(2), F.lit("user"), F.lit(3))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", F.array_join(F.transform(c.encoded_sequence(F.col("t"), ids, 4), lambda x: x.cast("string")), ",").alias("ids"))


@query("f_quantile_linear", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
def f_quantile_linear(spark, d):
    return rounded(read(spark, d, "events").groupBy("event_type").agg(*(F.percentile("value", F.lit(q)).alias(n) for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975)))))


@query("f_symbolic_vector", "SELECT vec_id, 2 * len(embedding) AS width, CAST(len(list_filter(embedding, lambda x: x > 0)) AS DOUBLE) AS ones FROM embeddings")
def f_symbolic_vector(spark, d):
    e = F.col("embedding").cast("array<double>")
    v = c.symbolic_vector(e, F.transform(e, lambda x: x > 0))
    return read(spark, d, "embeddings").select("vec_id", F.size(v).alias("width"), F.aggregate(F.slice(v, F.size(e) + 1, F.size(e)), F.lit(0.0), lambda t, x: t + x).alias("ones"))


@query("i_survivors", f"{P}, x AS (SELECT game, step, count(*) FILTER (NOT eliminated) AS hypotheses, count(DISTINCT CASE WHEN NOT eliminated THEN class_id END) AS classes FROM post GROUP BY game, step) SELECT game, step, hypotheses, classes, classes = 1 AS identifiable, round(CASE WHEN classes > 0 THEN least(1.0, 1.0 / classes) END, 6) AS credit_1, round(CASE WHEN classes > 0 THEN least(1.0, 3.0 / classes) END, 6) AS credit_3, round(CASE WHEN classes > 0 THEN least(1.0, 5.0 / classes) END, 6) AS credit_5 FROM x")
def i_survivors(spark, d):
    return rounded(i.survivors(post(spark, d), EV))


@query("i_mask_classes", f"{P}, x AS (SELECT game, step, truth, (event_id + h) % 5 AS sig, count(*) AS n, max(CASE WHEN class_id = truth THEN 1 ELSE 0 END) AS own, count(DISTINCT class_id) AS labels FROM post WHERE NOT eliminated GROUP BY ALL), y AS (SELECT *, n / sum(n) OVER (PARTITION BY game, step) AS q FROM x) SELECT game, step, count(*) AS groups, max(CASE WHEN own = 1 THEN n END) AS own_size, max(CASE WHEN own = 1 THEN labels END) AS own_labels, round(-sum(q * ln(q)), 6) + 0.0::DOUBLE AS entropy FROM y GROUP BY game, step")
def i_mask_classes(spark, d):
    rows = post(spark, d).withColumn("sig", (F.col("event_id") + F.col("h")) % 5)
    return rounded(i.mask_classes(rows, EV, "sig"))


@query("i_opportunity", f"WITH {a.EVENTS_SQL}, x AS (SELECT game, step, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS removed, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS added FROM ev) SELECT game, step, removed, added, CAST(sum(CAST(removed + added > 0 AS INT)) OVER w AS BIGINT) AS acts, round(avg(CAST(removed + added > 0 AS INT)) OVER w, 6) AS rate, min(CASE WHEN removed + added > 0 THEN step END) OVER w AS first FROM x WINDOW w AS (PARTITION BY game ORDER BY step ROWS UNBOUNDED PRECEDING)")
def i_opportunity(spark, d):
    rows = a.event_steps(spark, d)
    ordinary = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    permitted = F.concat(F.when(F.col("k") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(ordinary), F.when(F.col("k") % 4 == 0, F.array(F.lit("z"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("ordinary", ordinary).withColumn("permitted", permitted)
    return rounded(i.set_changes(rows, ["game"], "step", "ordinary", "permitted").select(*EV, "removed", "added", "acts", "rate", "first"))


@query("i_model_top", PRED + ", b AS (SELECT *, max(p) OVER (PARTITION BY game, side, step) AS best FROM pred), t AS (SELECT game, side, step, count(*) AS size, max(CAST(class_id = truth AS INT)) AS h FROM b WHERE p = best GROUP BY ALL) SELECT game, side, step, size, h = 0 AS excludes_truth, round(h / size, 6) AS credit, size = 1 AND h = 1 AS unique_correct, size = 1 AND h = 0 AS unique_error FROM t")
def i_model_top(spark, d):
    return rounded(i.model_top(predictions(spark, d), ROW))


@query("i_slices", PRED + ", b AS (SELECT *, max(p) OVER (PARTITION BY game, side, step) AS best FROM pred), t AS (SELECT game, side, step, truth, count(*) AS size, max(CAST(class_id = truth AS INT)) AS h FROM b WHERE p = best GROUP BY ALL), hz(horizon) AS (VALUES (5), (10), (15), (20)), l AS (SELECT horizon, t.* FROM t JOIN hz ON step <= horizon QUALIFY row_number() OVER (PARTITION BY horizon, game, side ORDER BY step DESC) = 1) SELECT horizon, side, truth, count(*) AS n, round(avg(size), 6) AS size, round(avg(h / size), 6) AS credit, CAST(grouping(horizon, side, truth) AS BIGINT) AS level FROM l GROUP BY GROUPING SETS ((), (horizon), (side), (truth), (horizon, side, truth))")
def i_slices(spark, d):
    """What the model's top set says at each horizon: over all, by horizon, by side, by class, and by all three."""
    rows = m.at_horizons(i.model_top(predictions(spark, d), [*ROW, "truth"]))
    return rounded(i.slices(rows, ["horizon", "side", "truth"], ["size", "credit"]))


LONG_SQL = f"""WITH {a.EVENTS_SQL}, h AS (SELECT *, CAST('0x' || substr(sha256(step || ':' || kind), 1, 15) AS HUGEINT) AS one FROM ev),
p AS (SELECT game, step, event_id, kind, one, coalesce(sum(one) OVER (PARTITION BY game ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CAST(event_id % 29 = 0 AS INT) AS past FROM h),
t AS (SELECT *, 0 AS copy FROM p UNION ALL SELECT *, 1 FROM p WHERE event_id % 41 = 0),
v AS (SELECT *, CASE WHEN event_id % 37 = 0 THEN 'other' ELSE 'own' END AS truth, CASE WHEN event_id % 43 = 0 THEN 'h19' ELSE 'h20' END AS hyp, CAST(step * 3 % 8 AS BIGINT) AS mask FROM t),
w AS (SELECT *, row_number() OVER o AS n, first_value(truth) OVER o AS t0, first_value(hyp) OVER o AS h0, lag(step) OVER o AS s1, lag(past) OVER o AS p1, lag(one) OVER o AS o1, lag(mask) OVER o AS m1, count(*) OVER (PARTITION BY game, step) AS same FROM v WINDOW o AS (PARTITION BY game ORDER BY step, copy))
SELECT * FROM (SELECT game, step, copy, array_to_string(list_filter([CASE WHEN truth <> t0 THEN 'truth' END, CASE WHEN s1 >= step THEN 'order' END, CASE WHEN past <> CASE WHEN n = 1 THEN 0 ELSE p1 + o1 END THEN 'history' END, CASE WHEN hyp <> h0 THEN 'hypotheses' END, CASE WHEN (m1 & (7 - mask)) <> 0 THEN 'restored' END, CASE WHEN same > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL), ',') AS faults FROM w) WHERE faults <> ''"""


@query("i_longitudinal", LONG_SQL)
def i_longitudinal(spark, d):
    """Rows that carry a digest of their history; truths, histories, hypothesis sets, masks and keys are broken in some."""
    rows = s.with_past(a.event_steps(spark, d), ["game"], "step", "kind", 1).withColumn("past", F.col("past") + (F.col("event_id") % 29 == 0).cast("int"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("event_id") % 41 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("truth", F.when(F.col("event_id") % 37 == 0, "other").otherwise("own")).withColumn("hypotheses", F.when(F.col("event_id") % 43 == 0, "h19").otherwise("h20")).withColumn("mask", F.col("step") * 3 % 8)
    found = i.longitudinal(rows, ["game"], "step", ("copy",), "truth", s.move_digest("step", "kind", 1), "past", "hypotheses", "mask")
    return found.select(*EV, "copy", F.array_join("faults", ",").alias("faults"))


VALIDATE = {"indices": "event_id % 29 = 0", "alignment": "event_id % 31 = 0", "hypotheses": "event_id % 37 = 0", "truth": "event_id % 19 = 0 OR event_id % 23 = 0", "posterior": "event_id % 13 = 0 OR event_id % 17 = 0"}


@query("i_validate", "SELECT * FROM (SELECT event_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in VALIDATE.items()) + "], lambda x: x IS NOT NULL), ',') AS violations FROM events) WHERE violations <> ''")
def i_validate(spark, d):
    """Each event as an observation with twenty hypotheses; every kind of fault is planted in some."""
    at = lambda n: F.col("event_id") % n == 0
    rows = a.event_steps(spark, d).select("event_id", "step", "truth")
    steps = F.when(at(29), F.array(F.lit(0).cast("long"), F.col("step"))).when(F.col("step") > 1, F.array(F.lit(1).cast("long"), F.col("step"))).otherwise(F.array("step"))
    own = F.array_position(F.array(*map(F.lit, a.EVENT_TYPES)), F.col("truth")) * 4 - 4
    rows = rows.withColumn("indices", steps).withColumn("own", own)

    def hypothesis(h):
        class_id = F.element_at(F.array(*map(F.lit, a.EVENT_TYPES)), F.floor(h / 4).cast("int") + 1)
        gone = F.when(h == F.col("own"), at(19)).otherwise(((F.col("event_id") + h) % 11 == 0) & (class_id != F.col("truth")))
        history = F.when(at(31) & (h == 3), F.array().cast("array<long>")).otherwise(F.col("indices"))
        return F.struct(F.when(at(37) & (h == 5), F.lit("h4")).otherwise(F.concat(F.lit("h"), h.cast("string"))).alias("id"), class_id.alias("class_id"), gone.alias("eliminated"), history.alias("history"))

    def weighed(every, live):
        mass = lambda x: F.when(at(17) & (x["id"] == "h0"), None).otherwise(F.when(x["eliminated"], 0.0).otherwise(F.when(at(13), 2.0).otherwise(1.0) / live))
        return F.transform(every, lambda x: F.struct(x["id"].alias("id"), x["class_id"].alias("class_id"), x["eliminated"].alias("eliminated"), x["history"].alias("history"), mass(x).alias("posterior")))

    # A generator stands between what makes the array and what reads it, so that no reader makes it again.
    rows = rows.withColumn("all", F.explode(F.array(F.transform(F.sequence(F.lit(0), F.lit(19)), hypothesis))))
    made = let(F.size(F.filter("all", lambda x: ~x["eliminated"])), lambda live: weighed(F.col("all"), live))
    rows = rows.withColumn("hypotheses", F.explode(F.array(made)))
    rows = rows.withColumn("truth_id", F.when(at(23), "none").otherwise(F.concat(F.lit("h"), F.col("own").cast("string"))))
    found = i.observation_faults(rows, "step", "indices", "indices", "truth", "truth_id", "hypotheses")
    return found.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("p_game_balanced", a.with_sql() + ", x AS (SELECT game, side, step, row_number() OVER (PARTITION BY game ORDER BY sha256('e1:' || game || ':' || (step * 2 + CAST(side = 'white' AS INT))), step * 2 + CAST(side = 'white' AS INT)) - 1 AS pl, count(*) OVER (PARTITION BY game) AS n FROM steps) SELECT game, side, step, count(*) AS times FROM x, LATERAL (SELECT unnest(range(CASE WHEN n >= 6 THEN 1 ELSE 6 // n + CASE WHEN pl < 6 % n THEN 1 ELSE 0 END END)) AS r) WHERE pl < 6 GROUP BY game, side, step")
def p_game_balanced(spark, d):
    rows = a.steps(spark, d).withColumn("row", F.col("step") * 2 + (F.col("side") == "white").cast("int"))
    return p.game_balanced(rows, "game", "row", 6, "e1").groupBy(*ROW).agg(F.count("*").alias("times"))


STRATA = a.with_sql() + ", tk AS (SELECT game, side, any_value(truth) AS truth, CASE WHEN game % 4 = 0 THEN 'extra' ELSE 'primary' END AS source FROM steps GROUP BY game, side), ct AS (SELECT truth, side, count(*) FILTER (source = 'primary') AS \"primary\", count(*) FILTER (source <> 'primary') AS supplemental FROM tk GROUP BY truth, side), pn AS (SELECT *, min(\"primary\") OVER () AS quota, CAST(floor(min(\"primary\") OVER () * 0.25) AS BIGINT) AS cap FROM ct), ps AS (SELECT *, least(supplemental, cap) AS use_supplemental FROM pn)"


def tracks(spark, d):
    rows = a.steps(spark, d).groupBy(*TRACK).agg(F.first("truth").alias("truth"))
    return rows.withColumn("source", F.when(F.col("game") % 4 == 0, "extra").otherwise("primary"))


@query("p_plan", f"{STRATA} SELECT * FROM ps")
def p_plan(spark, d):
    return p.plan(tracks(spark, d), ["truth", "side"], "source")


@query("p_stratified", f"{STRATA}, pl AS (SELECT game, side, truth, source, row_number() OVER (PARTITION BY truth, side, source ORDER BY sha256('z:' || game), game) AS place FROM tk) SELECT game, side, truth, source, CAST(place AS INT) AS place FROM pl JOIN ps USING (truth, side) WHERE (source <> 'primary' AND place <= use_supplemental) OR (source = 'primary' AND place <= quota - use_supplemental)")
def p_stratified(spark, d):
    return p.stratified(tracks(spark, d), ["truth", "side"], "source", "game", "z").select("game", "side", "truth", "source", "place")


@query("p_opportunity_paired")
def p_opportunity_paired(spark, d):
    rows = a.event_steps(spark, d).withColumn("hit", F.col("k") > 6)
    return p.opportunity_paired(rows, "game", "step", "hit")


@query("p_shuffle", "SELECT event_id, row_number() OVER (ORDER BY sha256('s1:' || event_id), event_id) - 1 AS place FROM events")
def p_shuffle(spark, d):
    return p.shuffled(read(spark, d, "events").select("event_id"), "s1", "event_id")


@query("x_likelihood", f"{P} SELECT game, step, h, CASE WHEN known THEN round(-2 * ln(1 + allowed), 6) END AS log_likelihood FROM evidence")
def x_likelihood(spark, d):
    scorer = lambda allowed: -2 * F.log(1 + allowed.cast("double"))
    return rounded(a.evidence(spark, d).select(*EV, "h", F.when(F.col("known"), scorer(F.col("allowed"))).alias("log_likelihood")))


PREDICTED = f"WITH {a.EVENTS_SQL}, kk(c, class_id) AS (VALUES {', '.join(f'({k}, {chr(39)}{e}{chr(39)})' for k, e in enumerate(a.EVENT_TYPES))}), x AS (SELECT event_id, kind AS truth, class_id, exp((event_id * (c + 3)) % 7 / 2.0) AS e FROM ev CROSS JOIN kk), y AS (SELECT *, e / sum(e) OVER (PARTITION BY event_id) AS p FROM x), z AS (SELECT *, max(CASE WHEN class_id = truth THEN p END) OVER (PARTITION BY event_id) AS own FROM y), s AS (SELECT event_id, any_value(own) AS own, count(*) FILTER (p > own + 1e-12) AS above, count(*) FILTER (abs(p - own) <= 1e-12) AS tied FROM z GROUP BY event_id)"


@query("x_predictor", f"{PREDICTED} SELECT round(avg(CASE WHEN 1 - above <= 0 THEN 0.0 ELSE least(1.0, (1 - above) / tied) END), 6) AS top_1, round(avg(CASE WHEN 3 - above <= 0 THEN 0.0 ELSE least(1.0, (3 - above) / tied) END), 6) AS top_3, round(avg(-ln(own)), 6) AS nll, count(*) AS n FROM s")
def x_predictor(spark, d):
    """A model of rows -> distributions, in Arrow batches, scored by the metric suite."""
    names = list(a.EVENT_TYPES)

    def predict(frame: pd.DataFrame) -> pd.DataFrame:
        logits = np.stack([frame["event_id"].to_numpy() * (k + 3) % 7 / 2.0 for k in range(len(names))], 1)
        p = np.exp(logits)
        p = np.round(p / p.sum(1, keepdims=True), 12)  # equal logits give equal probabilities
        return pd.DataFrame({"event_id": frame["event_id"].repeat(len(names)), "truth": frame["truth"].repeat(len(names)), "class_id": names * len(frame), "p": p.ravel()})

    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("truth"))
    pred = p.scored(rows, predict, "event_id long, truth string, class_id string, p double")
    own = m.row_scores(pred, ["event_id"])
    return rounded(own.agg(F.avg("credit_1").alias("top_1"), F.avg("credit_3").alias("top_3"), F.avg("nll").alias("nll"), F.count("*").alias("n")))


@query("x_constraint", f"{P} SELECT class_id, count(*) FILTER (eliminated) AS eliminated FROM cls GROUP BY class_id")
def x_constraint(spark, d):
    return classes(spark, d).groupBy("class_id").agg(F.count_if("eliminated").alias("eliminated"))
