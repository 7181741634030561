"""Queries of files, comparators, paired selection, board features and live streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from sequent.functions import columns as c
from sequent.operators import batches
from sequent.operators import comparators as k
from sequent.operators import fusion as f
from sequent.operators import gates as g
from sequent.operators import metrics as m
from sequent.operators import posteriors as o
from sequent.operators import selection as sel
from sequent.operators import sequences as s
from sequent.plans import adapters as a
from sequent.plans import q_features, q_models, q_sources
from sequent.plans.adapters import CLASSES, EVENT_TYPES, ROW, TRACK, pred_sql, predictions, read, score_sql, with_sql
from sequent.plans.q_metrics import BINARY, CELLS, MEAN, S, cells, labelled, report_sql, rounded, scores
from sequent.plans.q_models import BLENDED, FIXED, FIXED_SQL, LOGITS, METRICS, PLACE, boot_sql, logits, metric_table, track_deltas
from sequent.plans.q_sequences import VIEW
from sequent.sources import ndjson as src
from sequent.sources.committing import write_lines
from sequent.sources.folders import fresh_path
from sequent.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("src_ndjson_lenient", "SELECT event_id, user_id FROM events WHERE event_id % 17 <> 0")
def src_ndjson_lenient(spark, d):
    path = fresh_path(spark, "lines")
    text = F.when(F.col("event_id") % 17 == 0, "").otherwise(F.to_json(F.struct("event_id", "event_type", "user_id")))
    read(spark, d, "events").select(text.alias("value")).write.text(path)
    found = src.lenient(spark, path, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType())]))
    return found.where("event_id is not null")


@query("src_sidecar", f"WITH {LOGITS} SELECT side, count(DISTINCT vec_id) AS rows, CAST(sum(CASE WHEN c = truth THEN c END) AS BIGINT) AS labels, count(*) FILTER (eliminated) AS masked FROM lg GROUP BY side")
def src_sidecar(spark, d):
    path = fresh_path(spark, "sidecar")
    mask = F.transform("embedding", lambda x, c: ((F.col("vec_id") + c) % 7 == 0) & (c != F.col("label")))
    rows = read(spark, d, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "white").otherwise("black").alias("side"), F.col("embedding").alias("logits"), F.col("label").alias("truth"), mask.alias("mask"))
    src.write_sidecar(rows, path)
    found = src.read_sidecar(spark, path)
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x.cast("int"))
    return found.groupBy("side").agg(F.count("*").alias("rows"), F.sum("truth").alias("labels"), F.sum(masked).alias("masked"))


@query("src_prediction_bundle", with_sql(pred_sql()) + " SELECT round(avg(p), 6) AS p, count(*) AS n FROM pred WHERE class_id = truth")
def src_prediction_bundle(spark, d):
    path = fresh_path(spark, "bundle")
    predictions(spark, d).drop("truth").write.mode("errorifexists").parquet(path)  # blind to labels
    labels = a.steps(spark, d).select(*ROW, "truth")
    joined = spark.read.parquet(path).join(labels, ROW).where("class_id = truth")
    return rounded(joined.agg(F.avg("p").alias("p"), F.count("*").alias("n")))


@query("snk_dataset", f"SELECT count(*) AS rows, CAST(sum(length({q_sources.EVENT_LINE}) + 1) AS BIGINT) AS bytes, sha256(string_agg({q_sources.EVENT_LINE}, chr(10) ORDER BY event_id) || chr(10)) AS sha256 FROM events GROUP BY user_id % 5")
def snk_dataset(spark, d):
    """Committed files of events, five by user, and their manifest."""
    rows = read(spark, d, "events").select("event_id", "event_type", "user_id")
    dealt = rows.repartitionById(5, (F.col("user_id") % 5).cast("int")).sortWithinPartitions("event_id")
    return write_lines(dealt, fresh_path(spark, "dataset")).select("rows", "bytes", "sha256")


@query("snk_report", "SELECT '{\"n\":' || count(*) || ',\"source\":\"' || source || '\"}' AS value FROM documents GROUP BY source")
def snk_report(spark, d):
    path = fresh_path(spark, "report")
    src.write_report(read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), path)
    return spark.read.text(path)


LINES = "l AS (SELECT event_id, user_id, 'part=' || user_id % 3 AS folder, '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' AS line FROM events)"


@query("aud_inventory", f"WITH {LINES} SELECT folder, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, count(*) AS lines, count(DISTINCT user_id) AS games, sha256(string_agg(line, chr(10) ORDER BY event_id) || chr(10)) AS sha256 FROM l GROUP BY folder UNION ALL SELECT NULL, CAST(sum(length(line) + 1) AS BIGINT), count(*), count(DISTINCT user_id), NULL FROM l")
def aud_inventory(spark, d):
    path = fresh_path(spark, "inventory")
    rows = read(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "user_id")).alias("value"), (F.col("user_id") % 3).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    return src.inventory(spark, path, F.get_json_object("value", "$.user_id"))


@query("m_heldout", f"{CELLS}, {BINARY}, {score_sql()} SELECT 'class' AS head, 'top_1' AS metric, round(avg(credit_1), 6) AS value FROM s UNION ALL SELECT 'trigger', 'accuracy', round(avg(CAST((q >= 0.5) = y AS INT)), 6) FROM r UNION ALL SELECT 'mask', 'precision', round(count(*) FILTER (yes AND y) / count(*) FILTER (yes), 6) FROM e")
def m_heldout(spark, d):
    parts = [("class", "top_1", m.top_k(scores(spark, d))), ("trigger", "accuracy", m.binary(labelled(spark, d), "y", "q")), ("mask", "precision", m.mask_metrics(cells(spark, d), ROW, "y", "q"))]
    return rounded(reduce(DataFrame.unionByName, [x.select(F.lit(head).alias("head"), F.lit(name).alias("metric"), F.col(name).alias("value")) for head, name, x in parts]))


MEMBERS, ALPHA, TEMPERATURES = ["member-1", "member-2", "member-3"], 0.8, {"white": 1.5, "black": 0.8}
VIEWS = {"all": CLASSES, "four": VIEW}


def system_tracks(spark, d, views=None, digits=None):
    """Track sums of all comparators; frequencies are of four fifths of the games, a residual is the members' own."""
    trained = o.training_frequency(a.steps(spark, d).where("game % 5 <> 0"), ["game"], "side", "truth")
    shares = trained.groupBy("side").agg(F.map_from_entries(F.collect_list(F.struct("truth", "p"))).alias("shares"))  # an entry a class
    share = lambda name: F.coalesce(F.element_at("shares", F.lit(name)), F.lit(0.0))
    frequencies = shares.select("side", F.array(*map(share, CLASSES)).alias("frequencies"))
    rows = a.distributions(spark, d).join(F.broadcast(frequencies), "side", "left")
    options = []
    for n, name in enumerate(CLASSES):
        x = F.get("o", F.lit(n))
        residuals = F.array(*((F.col("okey") * 3 + F.col("step") * (r + 1) + len(name)) % 7 / 2.0 for r in range(len(MEMBERS))))
        options.append(F.struct(x["class_id"].alias("class_id"), x["eliminated"].alias("eliminated"), x["p"].alias("prior"), F.coalesce(F.get("frequencies", F.lit(n)), F.lit(0.0)).alias("frequency"), residuals.alias("residuals")))
    temperature = F.when(F.col("side") == "white", TEMPERATURES["white"]).otherwise(TEMPERATURES["black"])
    return k.system_tracks(rows.select(*ROW, "truth", F.array(*options).alias("options")), "options", MEMBERS, ALPHA, temperature, TRACK, views, digits)


def systems_sql() -> str:
    """CTE `sys` (system, row, truth, class_id, p) of all comparators, and what it needs."""
    row = "game, side, step"
    shared = lambda value: f"CASE WHEN sum({value}) OVER (PARTITION BY {row}) > 0 THEN {value} / sum({value}) OVER (PARTITION BY {row}) ELSE 0 END"
    parts = [
        "ft AS (SELECT side, truth, count(*) AS n FROM (SELECT DISTINCT game, side, truth FROM steps WHERE game % 5 <> 0) GROUP BY side, truth), fq AS (SELECT side, truth AS class_id, n / sum(n) OVER (PARTITION BY side) AS f FROM ft)",
        "zz AS (SELECT p0.*, CASE WHEN eliminated THEN 0 ELSE coalesce(f, 0) END AS f, CASE WHEN eliminated THEN 0.0 ELSE 1.0 END AS one, " + ", ".join(f"(okey * 3 + step * {n + 1} + length(class_id)) % 7 / 2.0 AS r{n}" for n in range(3)) + f", count(*) FILTER (NOT eliminated) OVER (PARTITION BY {row}) AS n, CASE WHEN NOT eliminated AND p > 0 THEN ln(p) END AS tier FROM pred p0 LEFT JOIN fq USING (side, class_id))",
        f"hd AS (SELECT {row}, tier, least(1.0, coalesce((tier - lag(tier) OVER w) / 4, 1.0), coalesce((lead(tier) OVER w - tier) / 4, 1.0)) AS room FROM (SELECT DISTINCT {row}, tier FROM zz WHERE tier IS NOT NULL) WINDOW w AS (PARTITION BY {row} ORDER BY tier))",
        f"z1 AS (SELECT zz.*, coalesce(zz.tier, coalesce(min(zz.tier) OVER (PARTITION BY zz.game, zz.side, zz.step), 0) - 1e6) AS base, coalesce(room, 1.0) AS room FROM zz LEFT JOIN hd ON zz.game = hd.game AND zz.side = hd.side AND zz.step = hd.step AND zz.tier = hd.tier)",
    ]
    union = [f"SELECT 'uniform' AS system, {row}, truth, class_id, {shared('one')} AS p FROM z1", f"SELECT 'training-frequency', {row}, truth, class_id, {shared('f')} FROM z1", f"SELECT 'symbolic-only', {row}, truth, class_id, p FROM z1"]
    for n, (name, residual, t) in enumerate([*((x, f"r{i}", "1") for i, x in enumerate(MEMBERS)), ("uncalibrated-ensemble", "(r0 + r1 + r2) / 3", "1"), ("calibrated-ensemble", "(r0 + r1 + r2) / 3", f"CASE WHEN side = 'white' THEN {TEMPERATURES['white']!r}::DOUBLE ELSE {TEMPERATURES['black']!r}::DOUBLE END")]):
        parts.append(q_models.softmax_sql(residual, "NOT eliminated", "z1", row, f"sg{n}"))
        parts.append(f"lo{n} AS (SELECT * EXCLUDE (q), base + {ALPHA!r} * room * (q - 1.0 / n) AS lo FROM sg{n})")
        parts.append(q_models.softmax_sql(f"lo / {t}", "NOT eliminated", f"lo{n}", row, f"fu{n}"))
        union.append(f"SELECT '{name}', {row}, truth, class_id, q FROM fu{n}")
    return with_sql(pred_sql()) + ", " + ", ".join(parts) + f", sys AS ({' UNION ALL '.join(union)})"


def grouped_scores(name: str, pred: str, keys: str) -> str:
    """Row scores where a row is known by more keys."""
    found = score_sql(name, pred).replace("PARTITION BY game, side, step", f"PARTITION BY {keys}, game, side, step")
    return found.replace("SELECT game, side, step, truth", f"SELECT {keys}, game, side, step, truth").replace("GROUP BY game, side, step, truth", f"GROUP BY {keys}, game, side, step, truth")


@query("a_comparators", f"{systems_sql()}, {grouped_scores('ss', 'sys', 'system')} SELECT system, count(*) AS support, {MEAN} FROM ss GROUP BY system")
def a_comparators(spark, d):
    """Eight systems of the same rows; twelve decimals first, so that a mean that ends in a 5 is rounded up whatever the order of its sum."""
    return rounded(rounded(m.summed(system_tracks(spark, d), ("system",)), 12))


def views_sql() -> str:
    parts = []
    for name, classes in VIEWS.items():
        inside = ", ".join(f"'{c}'" for c in classes)
        total = "sum(p) OVER (PARTITION BY system, game, side, step)"
        parts.append(f"SELECT '{name}' AS view, system, game, side, step, truth, class_id, round(CASE WHEN {total} > 0 THEN p / {total} ELSE 0 END, 12) AS p FROM sys WHERE class_id IN ({inside})")
    by = "view, system, side"
    return f"{systems_sql()}, vw AS ({' UNION ALL '.join(parts)}), {grouped_scores('vs', 'vw', 'view, system')}, vk AS (SELECT * FROM vs WHERE p_truth IS NOT NULL) {report_sql(by, 'vk')} UNION ALL SELECT {by}, 'unscorable', count(*) FROM vs WHERE p_truth IS NULL GROUP BY {by}"


@query("a_view_systems", views_sql())
def a_view_systems(spark, d):
    """The whole report of each class view, system and side; twelve decimals, so that equal shares fall into one confidence bin."""
    return rounded(k.tracks_report(system_tracks(spark, d, VIEWS, 12)))


def marked_scores(spark, d):
    return m.array_scores(a.distributions(spark, d), "o", ROW, ("okey",))


OK = S.replace("SELECT game, side, step, truth, any_value(pt)", "SELECT game, side, step, truth, any_value(okey) AS okey, any_value(pt)")


STRENGTH = "okey % 3 * 100 + CAST(okey % 3 = 2 AND okey % 50 = 0 AS INT)"


@query("a_agent_profile", f"{OK}, sa AS (SELECT *, okey % 3 AS agent, {STRENGTH} AS strength FROM s), ct AS (SELECT agent, count(DISTINCT strength) AS contracts FROM sa GROUP BY agent) SELECT x.*, contracts = 1 AS steady FROM ({report_sql('agent, side', 'sa')}) x JOIN ct USING (agent)")
def a_agent_profile(spark, d):
    """The whole report of each agent and side, and whether the agent keeps one style and strength (the last one does not)."""
    rows = marked_scores(spark, d).withColumns({"agent": F.col("okey") % 3, "style": F.lit("calm"), "strength": F.expr(STRENGTH)})
    changed = k.agents_that_change(rows, "agent", ["style", "strength"])
    return rounded(m.report(rows, ("agent", "side"))).join(changed, "agent", "left").select("agent", "side", "metric", "value", F.col("contracts").isNull().alias("steady"))


@query("a_mode_slice", f"{OK} SELECT CASE WHEN okey % 2 = 0 THEN 'evidence' ELSE 'synchronous' END AS mode, side, count(*) AS support, {MEAN} FROM s GROUP BY 1, side")
def a_mode_slice(spark, d):
    return rounded(m.summary(marked_scores(spark, d).withColumn("mode", F.when(F.col("okey") % 2 == 0, "evidence").otherwise("synchronous")), ("mode", "side")))


R3 = "game, side, step"
#: Every alpha with every smoothing (fixed values).
GRID2 = [(al, sm) for al in (0.0, 0.25, 0.5, 1.0, 2.0) for sm in (0.0, 0.01, 0.05, 0.1, 0.2)]


def smoothed(spark, d):
    """Means of every pair of the grid: a batch makes and sums them all, so that nothing is written for a pair but its sums."""
    o = F.col("o")
    residual = F.array(*((F.col("okey") * 3 + F.col("step") + len(name)) % 7 / 2.0 for name in CLASSES))

    def each(values, codes, names):
        for al, sm in GRID2:
            yield (al, sm), f.hard_masked(values["prior"], values["residual"], (codes >= 0) & ~values["eliminated"], al, sm), None

    fields = {"prior": o["p"], "residual": residual, "eliminated": o["eliminated"]}
    found = m.summed(batches.track_parts(a.distributions(spark, d), "o", fields, [], "alpha double, smoothing double", each), ("alpha", "smoothing"))
    return found.select("alpha", "smoothing", *(F.round(x, 4).alias(x) for x in ("top_1", "top_3", "nll")))


def smoothed_sql() -> str:
    parts = [q_models.BOTH]
    for k, (al, sm) in enumerate(GRID2):
        parts.append(f"n{k} AS (SELECT *, {1 - sm!r} * p + {sm!r} / count(*) FILTER (NOT eliminated) OVER (PARTITION BY {R3}) AS mix FROM z)")
        parts.append(q_models.softmax_sql(f"ln(mix) + {al!r} * residual", "NOT eliminated AND mix > 0", f"n{k}", R3, f"sm{k}"))
        parts.append(f"d{k} AS (SELECT game, side, step, truth, class_id, q AS p FROM sm{k})")
        parts.append(score_sql(f"g{k}", f"d{k}").replace("pt AS (SELECT", f"pt{k} AS (SELECT").replace("FROM pt GROUP", f"FROM pt{k} GROUP"))
    union = " UNION ALL ".join(f"SELECT {al!r} AS alpha, {sm!r} AS smoothing, round(avg(credit_1), 4) AS top_1, round(avg(credit_3), 4) AS top_3, round(avg(nll), 4) AS nll FROM g{k}" for k, (al, sm) in enumerate(GRID2))
    return ", ".join(parts) + f" SELECT * FROM ({union}) ORDER BY top_1 DESC, top_3 DESC, nll, alpha, smoothing LIMIT 1"


@query("s_alpha_smoothing", smoothed_sql())
def s_alpha_smoothing(spark, d):
    return f.ordered_choice(smoothed(spark, d), [F.desc("top_1"), F.desc("top_3"), "nll", "alpha", "smoothing"])


ABLATION = f"{q_models.RUNS}, ru AS (SELECT name, CASE WHEN seed < 10 THEN 'control' ELSE 'treatment' END AS mode, seed % 10 AS pair, seed = 13 AS config, seed = 5 AS validation, track_top_1, track_nll FROM runs)"


@query("s_ablation_pair", f"WITH {ABLATION} SELECT x.name AS control, y.name AS treatment, y.track_top_1 - x.track_top_1 AS track_top_1, y.track_nll - x.track_nll AS track_nll, CASE WHEN x.name IS NULL THEN 'no control' WHEN y.name IS NULL THEN 'no treatment' END AS fault FROM (SELECT * FROM ru WHERE mode = 'control') x FULL JOIN (SELECT * FROM ru WHERE mode = 'treatment') y ON x.pair = y.pair AND x.config = y.config AND x.validation = y.validation".join(["SELECT control, treatment, round(track_top_1, 6) + 0.0::DOUBLE AS track_top_1, round(track_nll, 6) + 0.0::DOUBLE AS track_nll, fault FROM (", ")"]))
def s_ablation_pair(spark, d):
    """Ten pairs of runs by seed; one's configuration and another's input are changed, so that they have no partner."""
    n = F.col("seed")
    rows = q_models.runs(spark, d).drop("validation").withColumns({"mode": F.when(n < 10, "control").otherwise("treatment"), "pair": n % 10, "config": n == 13, "validation": n == 5})
    return rounded(sel.ablation_pairs(rows, ["pair", "config", "train", "validation"], "control", "treatment", ["track_top_1", "track_nll"]))


BLEND_BEST = "SELECT * FROM (SELECT system, round(max(value) FILTER (metric = 'track_top_1'), 9) AS a, round(max(value) FILTER (metric = 'track_top_3'), 9) AS b, round(max(value) FILTER (metric = 'track_nll'), 9) AS n FROM gm GROUP BY system) WHERE {where} ORDER BY a DESC, b DESC, n, {then} LIMIT 1"
BLEND_METRICS = q_models.gate_metrics_sql(f"{BLENDED}, ab AS (SELECT 'w' || CAST(CAST(weight AS DOUBLE) AS VARCHAR) AS system, bs.* EXCLUDE (weight) FROM bs)")
VERDICT = "SELECT (SELECT system FROM bt1) AS name, (SELECT ok FROM ck WHERE \"check\" = 'primary') AS \"primary\", coalesce((SELECT string_agg(\"check\", ',' ORDER BY \"check\") FROM ck WHERE NOT ok), '') AS failed, CASE WHEN (SELECT bool_and(ok) FROM ck) THEN 'promote' ELSE 'retain' END AS decision"


def blend_runs(table):
    """One row for each weight, with the metrics that decide between them."""
    value = lambda name: F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name)
    return table.groupBy(F.col("system").alias("name")).agg(*map(value, sel.PERFORMANCE))


@query("s_treatment", f"""{BLEND_METRICS}, bt1 AS ({BLEND_BEST.format(where="system <> 'w0.0'", then="CASE WHEN system = 'w1.0' THEN 'w0.0' ELSE system END")}), {q_models.checks_sql("'w0.0'", "(SELECT system FROM bt1)")} SELECT *, 0 AS incomparable FROM ({VERDICT})""")
def s_treatment(spark, d):
    """Blends as treatments of one control; the whole of the other system is an ablation, so that it must share seed, multiplier and training input."""
    table = q_models.gate_metrics(spark, d, q_models.BLENDS)
    exact = F.col("name") == "w1.0"
    weight = F.substring("name", 2, 9).cast("double")
    runs = blend_runs(table).withColumns({"mode": F.when(exact, "exact").otherwise("zero"), "seed": F.lit(1), "multiplier": weight % 1, "config": F.lit("c"), "validation": F.lit("v"), "train": F.lit("t")})
    return sel.treatment_comparison(runs, table, "w0.0", ["config"], "validation", "train", ("zero", "exact"))


HELD_METRICS = q_models.gate_metrics_sql(f"{BLENDED}, ab AS (SELECT 'w' || CAST(CAST(weight AS DOUBLE) AS VARCHAR) || CASE WHEN game % 3 = 0 THEN '/test' ELSE '/choice' END AS system, bs.* EXCLUDE (weight) FROM bs)")


@query("s_paired_test", f"""{HELD_METRICS}, bt0 AS ({BLEND_BEST.format(where="system LIKE '%/choice' AND system <> 'w0.0/choice'", then="system")}), bt1 AS (SELECT replace(system, '/choice', '/test') AS system FROM bt0), {q_models.checks_sql("'w0.0/test'", "(SELECT system FROM bt1)")} SELECT replace(name, '/test', '') AS name, * EXCLUDE (name) FROM ({VERDICT})""")
def s_paired_test(spark, d):
    """The treatment chosen on two thirds of the games, compared with the control once on the third that is held out."""
    table = q_models.gate_metrics(spark, d, q_models.BLENDS, F.when(F.col("game") % 3 == 0, "/test").otherwise("/choice"))
    part = lambda end: table.where(F.col("system").endswith(end)).withColumn("system", F.regexp_replace("system", "/.*", ""))
    best = f.ordered_choice(blend_runs(part("/choice")).where("name <> 'w0.0'"), sel.preference(("name",)))
    return sel.compared(part("/test"), best, "w0.0")


@query("s_blend_run", f"""{BLEND_METRICS}, bt1 AS ({BLEND_BEST.format(where="system <> 'w0.0'", then="system")}), {q_models.checks_sql("'w0.0'", "(SELECT system FROM bt1)", g.BLEND)} {VERDICT}""")
def s_blend_run(spark, d):
    """The whole grid of weights; the best one is promoted only if it passes every check of a blend against weight 0."""
    table = q_models.gate_metrics(spark, d, q_models.BLENDS)
    best = f.ordered_choice(blend_runs(table).where("name <> 'w0.0'"), sel.preference(("name",)))
    return sel.compared(table, best, "w0.0", g.BLEND)


def calibration_sql() -> str:
    """Reports of the logits' distributions at temperature 1 and at each side's fitted one, compared."""
    parts = [q_models.CALIBRATED.removeprefix("WITH "), "lt AS (SELECT lg.*, ft.t FROM lg JOIN ft USING (side))"]
    for k, logit in (("x", "logit"), ("y", "logit / t")):
        parts.append(q_models.softmax_sql(logit, "NOT eliminated", "lt", "vec_id", f"sm{k}"))
        parts.append(f"d{k} AS (SELECT vec_id // 10 AS game, side, vec_id AS step, truth, c AS class_id, q AS p FROM sm{k})")
        parts.append(score_sql(f"s{k}", f"d{k}").replace("pt AS (SELECT", f"pt{k} AS (SELECT").replace("FROM pt GROUP", f"FROM pt{k} GROUP"))
        tracks = f"(SELECT side, avg(credit_1) AS a, avg(credit_3) AS b, avg(credit_5) AS c FROM s{k} GROUP BY side, game)"
        values = [*((f"row_top_{n}", f"avg(credit_{n})", f"s{k}") for n in (1, 3, 5)), *((f"track_top_{n}", f"avg({c})", tracks) for n, c in ((1, "a"), (3, "b"), (5, "c"))), ("row_nll", "avg(nll)", f"s{k}")]
        rows = " UNION ALL ".join(f"SELECT side, '{name}' AS metric, {value} AS value FROM {source} GROUP BY side" for name, value, source in values)
        parts.append(f"m{k} AS ({rows} UNION ALL SELECT side, 'ece', sum(abs(gap)) / sum(n) FROM (SELECT side, least(floor(confidence * 15), 14) AS bin, count(*) AS n, sum(credit_1) - sum(confidence) AS gap FROM s{k} GROUP BY side, bin) GROUP BY side)")
    value = "CASE WHEN metric LIKE '%top%' THEN abs(my.value - mx.value) ELSE my.value - mx.value END"
    return "WITH " + ", ".join(parts) + f", z AS (SELECT side, metric AS gate, {value} AS value FROM mx JOIN my USING (side, metric)) SELECT side, gate, round(value, 6) + 0.0::DOUBLE AS value, CASE WHEN gate LIKE '%top%' THEN value <= 1e-12 WHEN gate = 'ece' THEN value <= 0 ELSE value < 0 END AS passed FROM z"


@query("g_calibration", calibration_sql())
def g_calibration(spark, d):
    """Embeddings as logits, ten to a game, at temperature 1 and at each side's fitted one."""
    rows = logits(spark, d)
    fitted = {side: round(t, 4) for side, (t, _) in f.fit_temperatures(rows, "vec_id", "side").items()}
    own = F.element_at(F.create_map(*(x for side, t in fitted.items() for x in (F.lit(side), F.lit(t)))), F.col("side"))
    rows = rows.withColumn("game", F.floor(F.col("vec_id") / 10)).withColumn("class_id", F.col("c").cast("int"))
    reports = []
    for t in (F.lit(1.0), own):
        pred = f.softmax(rows, ["vec_id"], F.col("logit") / t, ~F.col("eliminated"))
        reports.append(m.report(m.row_scores(pred, ["game", "side", "vec_id"]), ("side",)))
    return rounded(g.calibration_gates(*reports))


@query("g_blend", f"""{q_models.AB_METRICS}, {q_models.checks_sql("'A'", "'B'", g.BLEND)} SELECT * FROM ck""")
def g_blend(spark, d):
    """The reliability checks and those of a blend, of system B against system A."""
    return g.reliability(q_models.gate_metrics(spark, d, q_models.AB_SYSTEMS), "A", "B", g.BLEND)


PAIRED_CHECKS = "SELECT 'agreement', abs((SELECT avg(delta) FROM dl) - (SELECT y - x FROM bo WHERE metric = 'track_top_1')) <= 1e-12 UNION ALL SELECT 'gain', (SELECT avg(delta) FROM dl) >= 0.001 UNION ALL SELECT 'bound', (SELECT value FROM lo) > 0"


@query("g_release", f"""{FIXED_SQL}, {q_models.gate_metrics_sql("ab AS (SELECT 'A' AS system, * FROM s UNION ALL SELECT 'B', * FROM s_b)")}, {q_models.checks_sql("'B'", "'A'", g.BLEND, PAIRED_CHECKS)} SELECT * FROM ck""")
def g_release(spark, d):
    """Every check of a release of system A in place of system B."""
    deltas = track_deltas(spark, d)
    values = g.bootstrap(deltas.withColumn("w", F.lit(1.0)), "game", "delta", "w", FIXED)
    return g.release_checks(q_models.gate_metrics(spark, d, q_models.AB_SYSTEMS), "B", "A", deltas, values, PLACE)


@query("x_statistic", boot_sql("gm", {"t": "t"}, 1_000).join(["WITH gm AS (SELECT o_custkey AS game, max(o_orderkey) AS t FROM orders GROUP BY 1), ", " SELECT r, max(t) AS value FROM dr JOIN cl USING (j) GROUP BY r"]))
def x_statistic(spark, d):
    games = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("game")).agg(F.max("o_orderkey").cast("double").alias("t"))
    return g.bootstrap_statistic(games, "game", F.max("t"), 1_000)


@query("x_gate_predicate", f"{METRICS} SELECT side, metric, CASE WHEN metric = 'top_1' AND value > 0.2 THEN 'passed' WHEN metric = 'support' AND value = -1 THEN 'passed' ELSE 'failed' END AS status FROM mt WHERE system = 'A' AND metric IN ('top_1', 'support')")
def x_gate_predicate(spark, d):
    bounds = spark.createDataFrame([("top_1", "t", ">", 0.2), ("support", "s", "=", -1.0)], "metric string, gate string, op string, bound double")
    own = metric_table(spark, d).where("system = 'A'").drop("system")
    sides = own.select("side").distinct().join(F.broadcast(bounds))
    return g.gates(own, sides, ["side", "metric"]).select("side", "metric", "status")


@query("x_random_outcomes", "WITH x AS (SELECT event_id, o, ln(CASE o WHEN 0 THEN 0.75 ELSE 0.25 END) AS lp, -ln(1 + (event_id + o) % 3) AS ll FROM events, (VALUES (0), (1)) AS u(o)) SELECT event_id, round(ln(sum(exp(lp + ll))), 6) AS log_likelihood FROM x GROUP BY event_id")
def x_random_outcomes(spark, d):
    outcomes = spark.createDataFrame([(0, 0.75), (1, 0.25)], "o int, q double")
    rows = read(spark, d, "events").select("event_id").join(F.broadcast(outcomes)).withColumn("lp", F.log("q")).withColumn("ll", -F.log((1 + (F.col("event_id") + F.col("o")) % 3).cast("double"))).withColumn("ok", F.lit(True))
    return rounded(s.marginal_outcomes(rows, ["event_id"], "lp", "ll", "ok").select("event_id", "log_likelihood"))


FEN = "CASE WHEN event_id % 8 > 0 THEN CAST(event_id % 8 AS VARCHAR) ELSE '' END || 'k' || CASE WHEN event_id % 8 < 7 THEN CAST(7 - event_id % 8 AS VARCHAR) ELSE '' END || '/8/8/8/8/8/PPPPPPPP/' || CASE WHEN user_id % 8 > 0 THEN CAST(user_id % 8 AS VARCHAR) ELSE '' END || 'K' || CASE WHEN user_id % 8 < 7 THEN CAST(7 - user_id % 8 AS VARCHAR) ELSE '' END"


def positions(spark, d):
    """A position for each event: kings on files that its ids give, and white pawns."""
    def rank(letter, file):
        n = lambda x: F.when(x > 0, x.cast("string")).otherwise("")
        return F.concat(n(file), F.lit(letter), n(7 - file))

    board = F.concat(rank("k", F.col("event_id") % 8), F.lit("/8/8/8/8/8/PPPPPPPP/"), rank("K", F.col("user_id") % 8))
    return read(spark, d, "events").select("event_id", "user_id", F.concat(board, F.when(F.col("event_id") % 2 == 0, " w KQ - 0 1").otherwise(" b - - 007 012")).alias("fen"))


BOARD = "p AS (SELECT event_id, 11 * 64 + 56 + event_id % 8 AS \"index\", 1.0 AS value FROM events UNION ALL SELECT event_id, 5 * 64 + user_id % 8, 1.0 FROM events UNION ALL SELECT event_id, 8 + f, 1.0 FROM events, range(8) AS r(f) UNION ALL SELECT event_id, 768 + event_id % 2, 1.0 FROM events UNION ALL SELECT event_id, 770 + f, 1.0 FROM events, range(2) AS r(f) WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 782, 1.0 FROM events UNION ALL SELECT event_id, 783, 0.07 FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 784, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 12 END / 300.0 FROM events)"


@query("f_board_vector", f'WITH {BOARD} SELECT event_id, "index", round(value, 6) AS value FROM p')
def f_board_vector(spark, d):
    return rounded(c.board_features(positions(spark, d), ["event_id"], "fen").select("event_id", F.col("index").cast("long").alias("index"), "value"))


FEATURES = [(785, "CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END / 1.0"), (786, "event_id % 70 / 600.0"), (787, "(event_id % 70 // 2 + 1) / 300.0"), (788, "event_id % 70 / 600.0"), (789, "(20 + user_id % 5) / 218.0"), (790, "(event_id % 8 + 8 * (user_id % 8)) / 63.0"), (791, "((event_id * 3) % 8 + 8 * (event_id % 7)) / 63.0")]


@query("f_feature_vector", f'WITH {BOARD}, s AS ({" UNION ALL ".join(f"SELECT event_id, {n} AS i, {x} AS value FROM events" for n, x in FEATURES)}) SELECT event_id, "index", round(value, 6) AS value FROM p UNION ALL SELECT event_id, i, round(value, 6) FROM s WHERE value <> 0')
def f_feature_vector(spark, d):
    rows = positions(spark, d).join(q_features.moves(spark, d), "event_id")
    e, ply = F.col("event_id"), F.col("event_id") % 70
    found = c.position_features(rows, ["event_id"], "fen", "uci", e % 2 == 0, ply, F.floor(ply / 2) + 1, ply, 20 + F.col("user_id") % 5)
    return rounded(found.select("event_id", F.col("index").cast("long").alias("index"), "value"))


@query("f_normalize_fen", f"SELECT event_id, {FEN} || CASE WHEN event_id % 2 = 0 THEN ' w KQ - 0 1' ELSE ' b - - 7 12' END AS fen FROM events")
def f_normalize_fen(spark, d):
    return positions(spark, d).select("event_id", c.normalized_fen(F.col("fen")).alias("fen"))


@query("f_san_facts", "SELECT event_id, substr('NBRQKP', CAST(event_id % 6 + 1 AS INT), 1) AS piece, user_id % 2 = 0 AS capture, event_id % 5 = 0 AS \"check\", false AS castle FROM events")
def f_san_facts(spark, d):
    piece = F.substring(F.lit("NBRQK"), (F.col("event_id") % 6 + 1).cast("int"), F.lit(1))
    san = F.concat(piece, F.when(F.col("user_id") % 2 == 0, "x").otherwise(""), F.lit("e4"), F.when(F.col("event_id") % 5 == 0, "+").otherwise(""))
    rows = read(spark, d, "events").select("event_id", san.alias("san"))
    facts = c.san_facts(F.col("san"))
    return rows.select("event_id", *(facts[k].alias(k) for k in ("piece", "capture", "check", "castle")))


@query("f_pgn_headers", "SELECT c_custkey, '{\"Site\":\"a \\\"b\\\"\",\"White\":\"' || c_name || '\"}' AS headers FROM customer")
def f_pgn_headers(spark, d):
    text = F.concat(F.lit('[White "'), "c_name", F.lit('"]\n[Site "a \\"b\\""]\n\n1. e4 e5'))
    return read(spark, d, "customer").select("c_custkey", F.to_json(c.headers(text)).alias("headers"))


MIX = "WITH a AS (SELECT event_id, CAST((CAST(event_id AS UHUGEINT) + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM events), b AS (SELECT event_id, CAST((CAST(xor(z, z >> 30) AS UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM a), c AS (SELECT event_id, CAST((CAST(xor(z, z >> 27) AS UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM b) SELECT event_id, CAST(xor(z, z >> 31) AS VARCHAR) AS mixed FROM c"


@query("f_splitmix64", MIX)
def f_splitmix64(spark, d):
    return read(spark, d, "events").select("event_id", g.splitmix64(F.col("event_id")).alias("mixed"))


def streamed(spark, rows, operator, batches=True):
    """Rows written out of order and read as a stream of several batches (or one) through a stateful operator."""
    path = fresh_path(spark, "live")
    (rows.repartitionByRange(3, F.desc("revision")) if batches else rows.sortWithinPartitions(F.desc("revision"))).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 if batches else 1_000).parquet(path)
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return live.run_to_files(operator(stream, EVENT_TYPES), fresh_path(spark, "live-out"))
    finally:
        spark.conf.unset(name)


def score_array(kind):
    return F.array(*(F.when(kind == k, 0.5).otherwise(-0.25) for k in EVENT_TYPES))


def live_rows(spark, d):
    rows = a.event_steps(spark, d).select(F.col("game").alias("session"), F.col("step").alias("revision"), score_array(F.col("kind")).alias("scores"))
    return streamed(spark, rows, live.live_posterior)


@query("st_live_posterior", q_sources.ORACLES["st_live_posterior_batch"])
def st_live_posterior(spark, d):
    return rounded(live_rows(spark, d).select("session", "revision", "class_id", "p"))


@query("st_live_restart", f"WITH live AS ({q_sources.ORACLES['st_live_posterior_batch']}), cut AS (SELECT session, max(revision) // 2 AS half FROM live GROUP BY session) SELECT live.* FROM live JOIN cut USING (session) WHERE revision > half")
def st_live_restart(spark, d):
    """The later half of each session, as a stream that starts from a snapshot of the first half's list; a file a batch."""
    rows = a.event_steps(spark, d).select(F.col("game").alias("session"), F.col("step").alias("revision"), score_array(F.col("kind")).alias("scores"))
    half = F.floor(F.max("revision").over(W.Window.partitionBy("session")) / 2)
    rows = rows.withColumn("early", F.col("revision") <= half)
    start = live.snapshot(rows.where("early"), EVENT_TYPES)
    found = streamed(spark, rows.where("not early").drop("early"), lambda stream, classes: live.live_posterior(stream, classes, start=start))
    return rounded(found.select("session", "revision", "class_id", "p"))


@query("st_reorder", f"WITH {a.EVENTS_SQL} SELECT game AS session, step AS revision, 'delivered' AS status, step = max(step) OVER (PARTITION BY game) AS latest FROM ev")
def st_reorder(spark, d):
    """Revisions that arrive last first, delivered in order, the latest one marked."""
    rows = live_rows(spark, d).select("session", "revision", "status").distinct()
    return rows.withColumn("latest", F.col("revision") == F.max("revision").over(W.Window.partitionBy("session")))


SWITCH = f"WITH {a.EVENTS_SQL}, kk(class_id) AS (VALUES {', '.join(f'({chr(39)}{e}{chr(39)})' for e in EVENT_TYPES)}), sw AS (SELECT game AS client, (step - 1) // 5 AS session, (step - 1) % 5 + 1 AS revision, kind, step FROM ev), w AS (SELECT client, session, revision, class_id, sum(CASE WHEN kind = class_id THEN 0.5 ELSE -0.25 END) OVER (PARTITION BY client, session, class_id ORDER BY revision) AS w FROM sw CROSS JOIN kk), e AS (SELECT *, exp(w - max(w) OVER (PARTITION BY client, session, revision)) AS e FROM w)"


@query("st_session_switch", f"{SWITCH} SELECT client, session, revision, class_id, round(e / sum(e) OVER (PARTITION BY client, session, revision), 6) AS p, 'delivered' AS status FROM e UNION ALL SELECT client, session - 1, 5, NULL, NULL, 'late' FROM sw WHERE step % 5 = 2 AND step > 5")
def st_session_switch(spark, d):
    """A client's session lasts five events; during the next one an answer to the old one comes too late."""
    steps = a.event_steps(spark, d).select(F.col("game").alias("client"), "step", score_array(F.col("kind")).alias("scores"))
    own = steps.select("client", (F.col("step") * 2).alias("arrival"), F.floor((F.col("step") - 1) / 5).alias("session"), ((F.col("step") - 1) % 5 + 1).alias("revision"), "scores")
    late = steps.where("step % 5 = 2 and step > 5").select("client", (F.col("step") * 2 + 1).alias("arrival"), (F.floor((F.col("step") - 1) / 5) - 1).alias("session"), F.lit(5).cast("long").alias("revision"), "scores")
    found = streamed(spark, own.unionByName(late), live.switching_posterior, batches=False)
    return rounded(found.select("client", "session", "revision", "class_id", "p", "status"))


@query("f_behavior_vector", "SELECT event_id, i AS \"index\", v AS value FROM events, (VALUES (5, 1.0), (23, 1.0), (24, 1.0), (31, 0.5), (26, 0.5)) AS x(i, v)")
def f_behavior_vector(spark, d):
    letter = lambda x: F.char((97 + x % 8).cast("int"))
    move = F.concat(letter(F.col("user_id")), F.lit("1"), letter(F.col("event_id")), F.lit("8"))
    rows = positions(spark, d).withColumn("uci", move).withColumn("legal", F.array("uci", F.lit("a2a3")))
    return c.behavior_features(rows, ["event_id"], "fen", "uci", "legal").select("event_id", "index", "value")
