"""Posterior, window and prior queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequent.operators import posteriors as o
from sequent.operators import sequences as s
from sequent.operators import trees
from sequent.plans import adapters as a
from sequent.plans.adapters import CLASSES, EVENT_TYPES, ROW, TRACK, posterior_sql, pred_sql, predictions, read, with_sql
from sequent.plans.q_metrics import rounded
from sequent.plans.q_sources import tree_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


EV = ["game", "step"]
P = posterior_sql()
PRED = with_sql(pred_sql())


def post(spark, d):
    rows = s.eliminated(a.evidence(spark, d), ["game", "h"], "step", F.col("known") & ~F.col("legal"))
    return s.posterior(rows, ["game", "h"], EV, "step", F.col("log_likelihood"), F.log("prior"))


def classes(spark, d):
    return o.class_posterior(post(spark, d), [*EV, "truth"])


#: Posteriors are often whole multiples of a power of two, which end in a 5: moved by this they are no ties of rounding.
OFF = 1e-8


def moved(df, *columns):
    return rounded(df.withColumns({c: F.col(c) + OFF for c in columns}))


@query("w_posterior", f"{P} SELECT game, step, h, round(log_weight, 6) AS log_weight, round(p + {OFF}, 6) AS p FROM post")
def w_posterior(spark, d):
    return moved(post(spark, d).select(*EV, "h", "log_weight", "p"), "p")


@query("w_elimination", f"{P} SELECT game, h, min(CASE WHEN eliminated THEN step END) AS since, count(*) FILTER (eliminated) AS rows FROM post GROUP BY game, h")
def w_elimination(spark, d):
    rows = s.eliminated(a.evidence(spark, d), ["game", "h"], "step", F.col("known") & ~F.col("legal"))
    return rows.groupBy("game", "h").agg(F.min(F.when(F.col("eliminated"), F.col("step"))).alias("since"), F.count_if("eliminated").alias("rows"))


@query("w_unknown_evidence", f"{P} SELECT game, h, round(sum(coalesce(log_likelihood, 0)), 6) AS total, count(*) FILTER (NOT known) AS unknown FROM evidence GROUP BY game, h")
def w_unknown_evidence(spark, d):
    rows = a.evidence(spark, d)
    return rounded(rows.groupBy("game", "h").agg(F.sum(F.coalesce("log_likelihood", F.lit(0.0))).alias("total"), F.count_if(~F.col("known")).alias("unknown")))


@query("w_renormalize", f"{P} SELECT game, step, round(sum(p), 6) AS total, count(*) FILTER (NOT eliminated) AS live FROM post GROUP BY game, step")
def w_renormalize(spark, d):
    return rounded(post(spark, d).groupBy(*EV).agg(F.sum("p").alias("total"), F.count_if(~F.col("eliminated")).alias("live")))


@query("w_marginal_outcomes", "WITH x AS (SELECT event_id, u.o, ln(CASE u.o WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END) AS lp, -ln(1 + (event_id + u.o) % 4) AS ll, (event_id * 3 + u.o) % 5 <> 0 AND event_id % 13 <> 0 AS ok FROM events, (VALUES (0), (1), (2)) AS u(o)), v AS (SELECT event_id, max(CASE WHEN ok THEN lp + ll END) AS m FROM x GROUP BY event_id) SELECT event_id, round(m + ln(sum(CASE WHEN ok THEN exp(lp + ll - m) END)), 6) AS log_likelihood, m IS NULL AS contradicted FROM x JOIN v USING (event_id) GROUP BY event_id, m")
def w_marginal_outcomes(spark, d):
    parts = F.array(*(F.struct(F.lit(k).alias("o"), F.log(F.lit(q)).alias("lp")) for k, q in enumerate((0.5, 0.3, 0.2))))
    rows = read(spark, d, "events").select("event_id", F.explode(parts).alias("x")).select("event_id", "x.*")
    rows = rows.withColumn("ll", -F.log((1 + (F.col("event_id") + F.col("o")) % 4).cast("double"))).withColumn("ok", ((F.col("event_id") * 3 + F.col("o")) % 5 != 0) & (F.col("event_id") % 13 != 0))
    return rounded(s.marginal_outcomes(rows, ["event_id"], "lp", "ll", "ok"))


@query("w_carry_opponent", a.with_sql() + ", g AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY step, side) AS n FROM steps) SELECT game, side, step, last_value(CASE WHEN side = 'white' THEN okey END IGNORE NULLS) OVER w AS okey_white, last_value(CASE WHEN side = 'black' THEN okey END IGNORE NULLS) OVER w AS okey_black FROM g WINDOW w AS (PARTITION BY game ORDER BY step, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w_carry_opponent(spark, d):
    return s.carried(a.steps(spark, d), ["game"], "step", "okey", ("white", "black")).select(*ROW, "okey_white", "okey_black")


@query("w_entropy_delta", PRED + ", h AS (SELECT game, side, step, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS e FROM pred GROUP BY game, side, step) SELECT game, side, step, round(e, 6) AS entropy_after, round(lag(e) OVER (PARTITION BY game, side ORDER BY step), 6) AS entropy_before FROM h")
def w_entropy_delta(spark, d):
    return rounded(s.entropy_delta(predictions(spark, d), ROW, TRACK, "step"))


@query("w_new_elimination", f"{P}, l AS (SELECT *, lag(eliminated) OVER (PARTITION BY game, class_id ORDER BY step) AS was FROM cls) SELECT game, step, class_id FROM l WHERE eliminated AND NOT coalesce(was, false)")
def w_new_elimination(spark, d):
    return s.new_eliminations(classes(spark, d), ["game", "class_id"], "step").select(*EV, "class_id")


# Classes of one step can tie up to rounding, so ranks are of rounded probabilities.
RANK = f"{P}, rc AS (SELECT game, step, truth, class_id, round(p, 6) AS p, eliminated FROM cls), rk AS (SELECT *, row_number() OVER (PARTITION BY game, step ORDER BY eliminated, p DESC, class_id) AS rank FROM rc)"


def timeline(spark, d):
    """Thirteen decimals first: a probability that ends in a 5 is a tie of the rounding, which the last bits of a sum must not decide."""
    return s.ranked(settled(classes(spark, d)), EV)


def settled(rows):
    return rows.withColumn("p", F.round(F.round("p", 13), 6))


@query("w_timeline", f"{RANK} SELECT game, step, class_id, p, CAST(rank AS INT) AS rank FROM rk WHERE rank = 1")
def w_timeline(spark, d):
    return timeline(spark, d).where("rank = 1").select(*EV, "class_id", "p", "rank")


@query("w_first_events", f"{RANK} SELECT game, min(CASE WHEN rank = 1 THEN step END) AS first_top, min(CASE WHEN eliminated THEN step END) AS first_eliminated, CAST(max_by(rank, step) AS INT) AS last_rank, max_by(p, step) AS last_p FROM rk WHERE class_id = truth GROUP BY game")
def w_first_events(spark, d):
    return s.first_events(timeline(spark, d), ["game"], "step")


@query("w_rank_change", f"{RANK}, ch AS (SELECT *, lag(rank) OVER (PARTITION BY game, class_id ORDER BY step) AS b FROM rk) SELECT game, step, class_id, CAST(b AS INT) AS before, CAST(rank AS INT) AS rank FROM ch WHERE b <> rank")
def w_rank_change(spark, d):
    return s.rank_changes(timeline(spark, d), ["game", "class_id"], "step").select(*EV, "class_id", "before", "rank")


@query("w_observed_index", a.with_sql() + " SELECT game, side, okey, count(*) AS n, max(step) AS last FROM steps GROUP BY game, side, okey")
def w_observed_index(spark, d):
    return a.steps(spark, d).groupBy(*TRACK, "okey").agg(F.count("*").alias("n"), F.max("step").alias("last"))


@query("w_ply_continuity", "WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) SELECT conv_id, min(turn) AS first_bad, count(*) AS bad FROM x WHERE n <> turn GROUP BY conv_id")
def w_ply_continuity(spark, d):
    return s.continuity(read(spark, d, "conversations"), ["conv_id"], "turn")


@query("w_side_alternation", "WITH x AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) SELECT conv_id, turn, role FROM x WHERE was = role")
def w_side_alternation(spark, d):
    return s.repeats_of_side(read(spark, d, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "role")


@query("w_observation_chain", f"WITH {a.EVENTS_SQL}, c AS (SELECT game, step, kind, k, lag(k) OVER w AS after, lag(step) OVER w AS s0 FROM ev WINDOW w AS (PARTITION BY game ORDER BY step)) SELECT game, step FROM c WHERE s0 IS NOT NULL AND (s0 + 1 <> step OR (after + 3) % 10 IS DISTINCT FROM k)")
def w_observation_chain(spark, d):
    rows = a.event_steps(spark, d).withColumn("after", (F.col("k") + 3) % 10)
    return s.chain_breaks(rows, ["game"], "step", "after", "k").select(*EV)


@query("w_constant_identity", a.with_sql() + ", n AS (SELECT game, side, count(DISTINCT truth) AS truth, count(DISTINCT okey) AS okey FROM steps GROUP BY game, side) SELECT game, side, 'truth' AS \"column\", truth AS \"values\" FROM n WHERE truth > 1 UNION ALL SELECT game, side, 'okey', okey FROM n WHERE okey > 1")
def w_constant_identity(spark, d):
    return s.not_constant(a.steps(spark, d), TRACK, ["truth", "okey"])


@query("w_monotone_mask", PRED + ", l AS (SELECT *, lag(eliminated) OVER (PARTITION BY game, side, class_id ORDER BY step) AS was FROM pred) SELECT game, side, step, class_id FROM l WHERE was AND NOT eliminated")
def w_monotone_mask(spark, d):
    return s.restored(predictions(spark, d), [*TRACK, "class_id"], "step").select(*ROW, "class_id")


PAST = "CAST(coalesce(sum(CAST('0x' || substr(sha256(step || ':' || kind), {}, 15) AS HUGEINT)) OVER (PARTITION BY game ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS VARCHAR)"


@query("w_history_prefix", f"WITH {a.EVENTS_SQL} SELECT game, step, coalesce(string_agg(kind, ' ') OVER (PARTITION BY game ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history, {PAST.format(1)} AS past, {PAST.format(16)} AS past_2 FROM ev")
def w_history_prefix(spark, d):
    """Whole histories: the kinds of all events before each one, in order, and their digests."""
    rows = s.history(s.with_past(a.event_steps(spark, d), ["game"], "step", "kind"), ["game"], "step", "kind")
    return rows.select(*EV, F.array_join("history", " ").alias("history"), F.col("past").cast("string").alias("past"), F.col("past_2").cast("string").alias("past_2"))


@query("w_history_breaks", f"WITH {a.EVENTS_SQL} SELECT game, step FROM ev WHERE event_id % 31 = 0 AND step > 1")
def w_history_breaks(spark, d):
    """Documents' histories: every event carries those before it, and some carry one that is not."""
    moves = a.event_steps(spark, d)
    whole = moves.groupBy("game").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "kind"))), lambda x: x["kind"]).alias("moves"))
    own = F.slice("moves", F.lit(1), (F.col("step") - 1).cast("int"))
    carried = F.when(F.col("event_id") % 31 == 0, F.slice("moves", F.lit(1), F.greatest(F.lit(0), F.col("step") - 2).cast("int"))).otherwise(own)
    return s.history_breaks(moves.join(whole, "game").withColumn("carried", carried), ["game"], "step", "kind", "carried").select(*EV)


SHARES = ", ".join(f"CASE WHEN count(kind) OVER b > 0 THEN round(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) OVER b / count(kind) OVER b, 6) ELSE 0.0 END AS share_{k}" for k in EVENT_TYPES)


@query("w_history_features", f"WITH {a.EVENTS_SQL}, c AS (SELECT *, lag(kind) OVER (PARTITION BY game ORDER BY step) AS l1, lag(kind, 2) OVER (PARTITION BY game ORDER BY step) AS l2 FROM ev), r AS (SELECT *, sum(CASE WHEN l1 = kind THEN 0 ELSE 1 END) OVER (PARTITION BY game ORDER BY step) AS run FROM c) SELECT game, step, {SHARES}, l1 AS last_1, l2 AS last_2, CAST(row_number() OVER (PARTITION BY game, run ORDER BY step) AS INT) AS streak FROM r WINDOW b AS (PARTITION BY game ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w_history_features(spark, d):
    rows = s.history_features(a.event_steps(spark, d), ["game"], "step", "kind", EVENT_TYPES)
    return rounded(rows.select(*EV, *(f"share_{k}" for k in EVENT_TYPES), "last_1", "last_2", "streak"))


@query("w_cumulative_opportunity", f"WITH {a.EVENTS_SQL} SELECT game, step, CAST(sum(CAST(k > 6 AS INT)) OVER w AS BIGINT) AS seen, round(avg(CAST(k > 6 AS INT)) OVER w, 6) AS rate, min(CASE WHEN k > 6 THEN step END) OVER w AS first FROM ev WINDOW w AS (PARTITION BY game ORDER BY step ROWS UNBOUNDED PRECEDING)")
def w_cumulative_opportunity(spark, d):
    rows = a.event_steps(spark, d).withColumn("hit", F.col("k") > 6)
    return rounded(s.cumulative(rows, ["game"], "step", "hit").select(*EV, "seen", "rate", "first"))


@query("a_uniform", PRED + ", u AS (SELECT *, count(*) FILTER (NOT eliminated) OVER (PARTITION BY game, side, step) AS live FROM pred) SELECT game, side, step, class_id, round(CASE WHEN eliminated OR live = 0 THEN 0 ELSE 1.0 / live END, 6) AS p FROM u")
def a_uniform(spark, d):
    return rounded(o.uniform(predictions(spark, d), ROW, survivors=True).select(*ROW, "class_id", "p"))


ASSIGNED = a.with_sql() + ", asg AS (SELECT game, max(CASE WHEN side = 'white' THEN truth END) AS white_class, max(CASE WHEN side = 'black' THEN truth END) AS black_class FROM steps GROUP BY game), full_asg AS (SELECT * FROM asg WHERE white_class IS NOT NULL AND black_class IS NOT NULL)"


def assignments(spark, d):
    rows = a.steps(spark, d)
    sides = [F.max(F.when(F.col("side") == x, F.col("truth"))).alias(f"{x}_class") for x in ("white", "black")]
    return rows.groupBy("game").agg(*sides)


def complete(spark, d):
    return assignments(spark, d).where("white_class is not null and black_class is not null")


def vocabulary(spark, names=None):
    return spark.createDataFrame([(n,) for n in names or CLASSES], "class_id string")


VOCAB = "vocab(class_id) AS (VALUES " + ", ".join(f"('{n}')" for n in CLASSES) + ")"


@query("a_game_prior", f"{ASSIGNED}, {VOCAB}, e AS (SELECT white_class AS class_id FROM full_asg UNION ALL SELECT black_class FROM full_asg), n AS (SELECT class_id, count(*) AS n FROM e GROUP BY class_id) SELECT class_id, coalesce(n, 0) AS n, round(coalesce(n / (SELECT sum(n) FROM n), 0), 6) AS p FROM vocab LEFT JOIN n USING (class_id)")
def a_game_prior(spark, d):
    return rounded(o.game_prior(complete(spark, d), vocabulary(spark)))


@query("a_training_frequency", a.with_sql() + ", u AS (SELECT DISTINCT game, side, truth FROM steps), n AS (SELECT side, truth, count(*) AS n FROM u GROUP BY side, truth) SELECT side, truth, n, round(n / sum(n) OVER (PARTITION BY side), 6) AS p FROM n")
def a_training_frequency(spark, d):
    return rounded(o.training_frequency(a.steps(spark, d), ["game"], "side", "truth"))


@query("a_symbolic_only", PRED + ", k AS (SELECT *, CASE WHEN (okey + length(class_id)) % 3 = 0 THEN 0 ELSE p END AS q FROM pred), t AS (SELECT *, sum(q) OVER (PARTITION BY game, side, step) AS t FROM k) SELECT game, side, step, class_id, round(CASE WHEN t > 0 THEN q / t ELSE 0 END, 6) AS p, t = 0 AS lost FROM t")
def a_symbolic_only(spark, d):
    rows = predictions(spark, d).withColumn("eliminated", (F.col("okey") + F.length("class_id")) % 3 == 0)
    return rounded(o.masked(rows, ROW).select(*ROW, "class_id", "p", "lost"))


VIEW = CLASSES[:4]
IN_VIEW = "(" + ", ".join(f"'{c}'" for c in VIEW) + ")"


@query("prj_class_view", PRED + f", v AS (SELECT *, sum(p) OVER (PARTITION BY game, side, step) AS t FROM pred WHERE class_id IN {IN_VIEW}) SELECT game, side, step, class_id, round(CASE WHEN t > 0 THEN p / t ELSE 0 END, 6) AS p FROM v")
def prj_class_view(spark, d):
    return rounded(o.class_view(predictions(spark, d), ROW, VIEW).select(*ROW, "class_id", "p"))


@query("a_class_posterior", f"{P} SELECT game, step, class_id, round(p + {OFF}, 6) AS p, eliminated, live, variants FROM cls")
def a_class_posterior(spark, d):
    return moved(o.class_posterior(post(spark, d), EV), "p")


@query("a_posterior_vector", f"{P}, voc(class_id, n) AS (VALUES ('click', 0), ('error', 1), ('other', 2), ('purchase', 3), ('signup', 4), ('view', 5)), r AS (SELECT DISTINCT game, step FROM cls), x AS (SELECT r.game, r.step, n, round(coalesce(p, 0) + {OFF}, 6) AS p, coalesce(eliminated, true) AS e FROM r CROSS JOIN voc LEFT JOIN cls ON cls.game = r.game AND cls.step = r.step AND cls.class_id = voc.class_id) SELECT game, step, sum(p * (n + 1)) AS weighted, CAST(sum(CASE WHEN e THEN 1 << n ELSE 0 END) AS BIGINT) AS mask FROM x GROUP BY game, step")
def a_posterior_vector(spark, d):
    rows = o.posterior_vector(classes(spark, d), EV, sorted([*EVENT_TYPES, "other"]))
    weighted = sum((F.round(F.get("p", F.lit(k)) + OFF, 6) * (k + 1) for k in range(6)), F.lit(0.0))
    mask = sum((F.when(F.get("eliminated", F.lit(k)), 1 << k).otherwise(0) for k in range(6)), F.lit(0)).cast("long")
    return rounded(rows.select(*EV, weighted.alias("weighted"), mask.alias("mask")))


ORACLES["a_posterior_vector"] = ORACLES["a_posterior_vector"].replace("sum(p * (n + 1)) AS weighted", "round(sum(p * (n + 1)), 6) AS weighted")


@query("a_param_posterior", f"{P}, x AS (SELECT game, step, class_id, variant AS value, sum(p) AS mass FROM post GROUP BY ALL), y AS (SELECT *, sum(mass) OVER (PARTITION BY game, step, class_id) AS covered FROM x) SELECT game, step, class_id, value, round(mass + {OFF}, 6) AS mass, round(covered + {OFF}, 6) AS covered, CASE WHEN covered > 0 THEN round(mass / covered + {OFF}, 6) END AS share FROM y")
def a_param_posterior(spark, d):
    return moved(o.parameter_posterior(post(spark, d), EV, "variant"), "mass", "covered", "share")


@query("a_opportunity", f"{P}, x AS (SELECT game, step, class_id, sum(prior) AS t, sum(CASE WHEN known THEN prior ELSE 0 END) AS k, sum(CASE WHEN known THEN prior * allowed / 5 ELSE 0 END) AS al, sum(CASE WHEN known AND allowed < 5 THEN prior ELSE 0 END) AS tr, sum(CASE WHEN known AND allowed = 1 THEN prior ELSE 0 END) AS fo FROM evidence GROUP BY ALL) SELECT game, step, class_id, round(k / t, 6) AS known_mass, round(al / t, 6) AS allowed_mass, round(tr / t, 6) AS triggered_mass, round(fo / t, 6) AS forced_mass FROM x")
def a_opportunity(spark, d):
    return rounded(o.opportunity(a.evidence(spark, d), EV, "prior", 5))


@query("a_rule_coverage", a.with_sql() + ", f AS (SELECT side, truth, count(*) AS observed FROM steps GROUP BY ALL), e AS (SELECT side, truth, observed - (length(truth) % 3) AS expected FROM f) SELECT side, truth, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed FROM e FULL JOIN f USING (side, truth) WHERE coalesce(expected, 0) <> coalesce(observed, 0)")
def a_rule_coverage(spark, d):
    rows = a.steps(spark, d)
    expected = rows.groupBy("side", "truth").agg((F.count("*") - F.first(F.length("truth")) % 3).alias("expected"))
    return o.rule_coverage(rows, expected, ["side", "truth"])


LEDGER = a.with_sql() + ", led AS (SELECT c_custkey AS game, count(step) AS n, count(DISTINCT side) AS sides FROM customer LEFT JOIN steps ON game = c_custkey GROUP BY c_custkey)"


@query("a_attrition", f"{LEDGER} SELECT count(*) AS games, count(*) FILTER (n > 0) AS row_bearing, count(*) FILTER (n = 0) AS zero_row, count(*) FILTER (sides = 1) AS one_sided, CAST(sum(n) AS BIGINT) AS rows FROM led")
def a_attrition(spark, d):
    found = a.steps(spark, d).groupBy("game").agg(F.count("*").alias("rows"), F.count_distinct("side").alias("sides"))
    ledger = read(spark, d, "customer").select(F.col("c_custkey").alias("game")).join(found, "game", "left").fillna(0)
    return o.attrition(ledger)


@query("a_balance", f"{ASSIGNED}, {VOCAB}, n AS (SELECT white_class, black_class, count(*) AS games FROM full_asg GROUP BY ALL) SELECT x.class_id AS white_class, y.class_id AS black_class, coalesce(games, 0) AS games FROM vocab x CROSS JOIN vocab y LEFT JOIN n ON n.white_class = x.class_id AND n.black_class = y.class_id")
def a_balance(spark, d):
    return o.balance(complete(spark, d), vocabulary(spark), "white_class", "black_class")


@query("a_trace_summary", "WITH c AS (SELECT conv_id, count(*) AS n, max_by(role, turn) AS last FROM conversations GROUP BY conv_id) SELECT last, count(*) AS games, CAST(sum(n) AS BIGINT) AS steps FROM c GROUP BY last")
def a_trace_summary(spark, d):
    games = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("role", "turn").alias("last"))
    return games.groupBy("last").agg(F.count("*").alias("games"), F.sum("n").alias("steps"))


@query("a_vocab_scan", "WITH t AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+')) AS token FROM conversations) SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM t WHERE token <> ''")
def a_vocab_scan(spark, d):
    words = read(spark, d, "conversations").select(F.explode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("w")).where("w <> ''")
    return o.vocabulary(words, F.col("w")).withColumn("id", F.col("id").cast("long"))


@query("a_track_weights", a.with_sql() + ", x AS (SELECT *, CASE WHEN okey % 4 = 0 THEN 3.0 ELSE 1.0 END AS w FROM steps) SELECT game, side, step, round(w / sum(w) OVER (PARTITION BY game, side), 6) AS weight FROM x")
def a_track_weights(spark, d):
    rows = a.steps(spark, d).withColumn("hit", F.col("okey") % 4 == 0)
    return rounded(o.track_weights(rows, TRACK, "hit", 3).select(*ROW, "weight"))


@query("a_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def a_weighted_mean(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").cast("double").alias("v"), F.col("l_quantity").cast("double").alias("w"))
    return rounded(o.weighted_mean(rows, "v", "w", ("l_returnflag",)))


@query("a_seed_digest", tree_sql("(SELECT DISTINCT o_custkey FROM orders)", "o_custkey", "CAST(o_custkey AS VARCHAR)", 64, 16))
def a_seed_digest(spark, d):
    seeds = read(spark, d, "orders").select("o_custkey").distinct()
    return trees.root(seeds, ["o_custkey"], F.col("o_custkey").cast("string"), 64, 16).select("digest", "rows", F.col("first.o_custkey").alias("first"), F.col("last.o_custkey").alias("last"))


def transcript_line():
    return F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))


@query("a_transcript_digest", tree_sql("events", "event_id", "event_id || '|' || event_type || '|' || user_id"))
def a_transcript_digest(spark, d):
    return trees.root(read(spark, d, "events"), ["event_id"], transcript_line()).select("digest", "rows", F.col("first.event_id").alias("first"), F.col("last.event_id").alias("last"))


@query("a_transcript_changes", "SELECT event_id, in_a, 1 - in_a AS in_b FROM events, (VALUES (1), (0)) AS v(in_a) WHERE event_id % 701 = 5 AND event_type <> 'view'")
def a_transcript_changes(spark, d):
    """What differs between two transcripts, found by descent from their roots."""
    rows = read(spark, d, "events")
    other = rows.withColumn("event_type", F.when(F.col("event_id") % 701 == 5, "view").otherwise(F.col("event_type")))
    return trees.changed(rows, other, ["event_id"], transcript_line(), 64, 16)


@query("a_corpus_set", "WITH c AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, 1 AS version FROM documents GROUP BY lang) SELECT 'version' AS field, count(DISTINCT version) AS \"values\", count(DISTINCT version) = 1 AS ok FROM c UNION ALL SELECT 'sources', count(DISTINCT sources), count(DISTINCT sources) = 1 FROM c UNION ALL SELECT 'n', count(DISTINCT n), count(DISTINCT n) = count(*) FROM c")
def a_corpus_set(spark, d):
    corpora = read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.lit(1).alias("version"))
    return o.corpus_set(corpora, ["version", "sources"], ["n"])


@query("a_label_coverage", "SELECT count(*) AS labels, count(*) FILTER (event_type IN ('click', 'view')) AS supported, count(*) FILTER (event_type NOT IN ('click', 'view')) AS unsupported, round(avg(CAST(event_type IN ('click', 'view') AS INT)), 6) AS share FROM events")
def a_label_coverage(spark, d):
    return rounded(o.label_coverage(read(spark, d, "events"), "event_type", ["click", "view"]))


@query("a_class_opportunity", a.with_sql() + f", {VOCAB}, f AS (SELECT side, truth, count(*) AS n, count(DISTINCT game) AS tracks, count(*) FILTER (okey % 4 = 0) AS triggered FROM steps GROUP BY ALL) SELECT v.side, vocab.class_id, coalesce(n, 0) AS rows, coalesce(tracks, 0) AS tracks, coalesce(triggered, 0) AS triggered FROM vocab CROSS JOIN (SELECT DISTINCT side FROM steps) v LEFT JOIN f ON f.side = v.side AND f.truth = vocab.class_id")
def a_class_opportunity(spark, d):
    rows = a.steps(spark, d).withColumn("hit", F.col("okey") % 4 == 0)
    return o.class_opportunity(rows, vocabulary(spark), "side", ["game"], "hit")


@query("a_param_coverage", "WITH x AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'white' ELSE 'black' END AS side, CASE WHEN event_id % 5 = 0 THEN 'unobserved' WHEN event_id % 7 = 0 THEN 'out-of-vocabulary' END AS reason, event_id % 3 = 0 AS ok FROM events) SELECT side, count(*) AS eligible, count(*) FILTER (reason IS NULL) AS scorable, count(*) FILTER (reason = 'unobserved') AS unobserved, count(*) FILTER (reason = 'out-of-vocabulary') AS out_of_vocabulary, round(avg(CAST(reason IS NULL AS INT)), 6) AS coverage, round(avg(CASE WHEN reason IS NULL THEN CAST(ok AS INT) END), 6) AS accuracy FROM x GROUP BY side")
def a_param_coverage(spark, d):
    reason = F.when(F.col("event_id") % 5 == 0, "unobserved").when(F.col("event_id") % 7 == 0, "out-of-vocabulary")
    rows = read(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "white").otherwise("black").alias("side"), reason.alias("reason"), (F.col("event_id") % 3 == 0).alias("ok"))
    return rounded(o.parameter_coverage(rows, "side", "reason", "ok"))
