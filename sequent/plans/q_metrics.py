"""Metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequent.operators import batches
from sequent.operators import metrics as m
from sequent.plans.adapters import CLASSES, ROW, distributions, pred_sql, predictions, read, score_sql, with_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on the order of rows; a negative zero becomes zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def scores(spark: SparkSession, d: str, system: str = "A") -> DataFrame:
    return m.array_scores(distributions(spark, d, system), "o", ROW)


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, k % 2) for k, name in enumerate(CLASSES)], "class_id string, family int")


S = with_sql(pred_sql(), score_sql())
MEAN = "round(avg(credit_1), 6) AS top_1, round(avg(credit_3), 6) AS top_3, round(avg(credit_5), 6) AS top_5, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier"


@query("m_row_score", f"{S} SELECT game, side, step, truth, round(p_truth, 6) AS p_truth, above, tied, round(confidence, 6) AS confidence, round(brier, 6) AS brier, round(sum_error, 6) AS sum_error, round(nll, 6) AS nll, round(credit_1, 6) AS credit_1, round(credit_3, 6) AS credit_3, round(credit_5, 6) AS credit_5 FROM s")
def m_row_score(spark, d):
    return rounded(scores(spark, d))


@query("m_topk", f"{S} SELECT round(avg(credit_1), 6) AS top_1, round(avg(credit_3), 6) AS top_3, round(avg(credit_5), 6) AS top_5, count(*) AS n FROM s")
def m_topk(spark, d):
    return rounded(m.top_k(scores(spark, d)))


@query("m_nll", f"{S} SELECT CASE WHEN count(*) = count(nll) THEN round(avg(nll), 6) END AS nll, count(*) > count(nll) AS infinite FROM s")
def m_nll(spark, d):
    return rounded(m.mean_nll(scores(spark, d)))


@query("m_brier", f"{S} SELECT round(avg(brier), 6) AS brier FROM s")
def m_brier(spark, d):
    return rounded(m.mean_brier(scores(spark, d)))


BINS = "b AS (SELECT least(CAST(floor(confidence * 15) AS BIGINT), 14) AS bin, count(*) AS n, sum(credit_1) AS a, sum(confidence) AS c FROM s GROUP BY 1)"


@query("m_reliability", f"{S}, {BINS} SELECT bin, n, round(a, 6) AS accuracy_sum, round(c, 6) AS confidence_sum FROM b")
def m_reliability(spark, d):
    return rounded(m.reliability(scores(spark, d)))


@query("m_ece", f"{S}, {BINS} SELECT round(sum(abs(a - c)) / sum(n), 6) AS ece FROM b")
def m_ece(spark, d):
    return rounded(m.ece(scores(spark, d)))


TRACKS = "t AS (SELECT game, side, avg(credit_1) AS credit_1, avg(credit_3) AS credit_3, avg(credit_5) AS credit_5, avg(nll) AS nll, avg(brier) AS brier FROM s GROUP BY game, side)"


@query("m_game_normalized", f"{S}, {TRACKS} SELECT {MEAN}, count(*) AS tracks FROM t")
def m_game_normalized(spark, d):
    return rounded(m.game_normalized(scores(spark, d)))


LATEST = "hz(horizon) AS (VALUES (5), (10), (15), (20)), l AS (SELECT horizon, s.* FROM s JOIN hz ON step <= horizon QUALIFY row_number() OVER (PARTITION BY horizon, game, side ORDER BY step DESC) = 1)"


@query("m_horizon", f"{S}, {LATEST} SELECT horizon, round(avg(credit_1), 6) AS top_1, round(avg(credit_3), 6) AS top_3, count(game) AS tracks FROM hz LEFT JOIN l USING (horizon) GROUP BY horizon")
def m_horizon(spark, d):
    return rounded(m.horizon(scores(spark, d)))


@query("m_first_rank1", f"{S}, f AS (SELECT game, side, min(CASE WHEN above = 0 AND tied = 1 THEN step END) AS first FROM s GROUP BY game, side) SELECT round(avg(first), 6) AS mean_first, median(first) AS median_first, count(first) AS reached, count(*) - count(first) AS never FROM f")
def m_first_rank1(spark, d):
    return rounded(m.first_rank_one(scores(spark, d)))


FAMILY = f"fam AS (SELECT class_id, c % 2 AS family FROM (VALUES {', '.join(f'({k}, {chr(39)}{n}{chr(39)})' for k, n in enumerate(CLASSES))}) AS k(c, class_id))"


@query("m_by_class", f"{S}, {FAMILY} SELECT 'class' AS level, truth AS name, round(avg(credit_1), 6) AS top_1, count(*) AS n FROM s GROUP BY truth UNION ALL SELECT 'family', CAST(family AS VARCHAR), round(avg(credit_1), 6), count(*) FROM s JOIN fam ON truth = class_id GROUP BY family")
def m_by_class(spark, d):
    return rounded(m.by_class(scores(spark, d), families(spark)))


@query("m_slice", f"{S}, {FAMILY} SELECT truth, family, count(*) AS support, {MEAN} FROM s JOIN fam ON truth = class_id GROUP BY truth, family")
def m_slice(spark, d):
    named = scores(spark, d).join(F.broadcast(families(spark)), F.col("truth") == F.col("class_id"))
    return rounded(m.summary(named, ("truth", "family")))


@query("m_confusion_fractional", with_sql(pred_sql()) + ", x AS (SELECT *, max(p) OVER (PARTITION BY game, side, step) AS best FROM pred), y AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY game, side, step) AS share FROM x WHERE p = best) SELECT truth, class_id AS predicted, round(sum(share), 4) AS weight FROM y GROUP BY truth, class_id")
def m_confusion_fractional(spark, d):
    return rounded(m.confusion_fractional(predictions(spark, d), ROW), 4)


@query("m_confusion_counts", with_sql(pred_sql()) + ", x AS (SELECT truth, class_id, row_number() OVER (PARTITION BY game, side, step ORDER BY p DESC, class_id) AS r FROM pred) SELECT truth, class_id AS predicted, count(*) AS n FROM x WHERE r = 1 GROUP BY truth, class_id")
def m_confusion_counts(spark, d):
    return m.confusion_counts(predictions(spark, d), ROW)


@query("m_diagnostics", with_sql(pred_sql()) + ", x AS (SELECT abs(sum(p) - 1) AS e, bool_or(eliminated) AS m, count(*) FILTER (eliminated AND p <> 0) AS v, max(CASE WHEN eliminated THEN p END) AS q FROM pred GROUP BY game, side, step) SELECT round(max(e), 6) AS max_sum_error, count(*) FILTER (m) AS masked_rows, count(*) FILTER (NOT m) AS unmasked_rows, CAST(sum(v) AS BIGINT) AS violations, coalesce(max(q), 0.0) AS max_eliminated_p FROM x")
def m_diagnostics(spark, d):
    return rounded(m.diagnostics(predictions(spark, d), ROW))


def report_sql(by: str = "", scores_name: str = "s") -> str:
    """Long report of a score table; by: a column, or nothing."""
    b, g, t = (f"{by}, ", f" GROUP BY {by}", f"GROUP BY {by}, game" + ("" if by == "side" else ", side")) if by else ("", "", "GROUP BY game, side")
    using = f" USING ({by})" if by else ""
    join = "JOIN" if by else "CROSS JOIN"
    return f"""
SELECT {b}metric, round(value, 6) AS value FROM (
  UNPIVOT (SELECT * FROM (SELECT {b}CAST(count(*) AS DOUBLE) AS row_support, avg(credit_1) AS row_top_1, avg(credit_3) AS row_top_3, avg(credit_5) AS row_top_5, avg(nll) AS row_nll, avg(brier) AS row_brier FROM {scores_name}{g}) {join}
    (SELECT {b}CAST(count(*) AS DOUBLE) AS track_tracks, avg(a) AS track_top_1, avg(b3) AS track_top_3, avg(b5) AS track_top_5, avg(n) AS track_nll, avg(br) AS track_brier FROM (SELECT {b}avg(credit_1) AS a, avg(credit_3) AS b3, avg(credit_5) AS b5, avg(nll) AS n, avg(brier) AS br FROM {scores_name} {t}){g}){using} {join}
    (SELECT {b}sum(abs(a - c)) / sum(n) AS ece FROM (SELECT {b}least(floor(confidence * 15), 14) AS bin, count(*) AS n, sum(credit_1) AS a, sum(confidence) AS c FROM {scores_name} GROUP BY {b}bin){g}){using})
  ON COLUMNS(* EXCLUDE ({by or 'game'})) INTO NAME metric VALUE value)""".replace(" EXCLUDE (game)", "" if not by else " EXCLUDE (game)")


@query("m_report", S + report_sql())
def m_report(spark, d):
    return rounded(m.report(scores(spark, d)))


@query("m_report_by_side", S + report_sql("side"))
def m_report_by_side(spark, d):
    return rounded(m.report(scores(spark, d), ("side",)))


BINARY = "r AS (SELECT quality = 1 AS y, (n_chars % 997) / 996.0 AS q, lang FROM documents JOIN labels USING (doc_id))"


def labelled(spark, d):
    joined = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return joined.select("doc_id", "lang", (F.col("quality") == 1).alias("y"), ((F.col("n_chars") % 997) / 996).alias("q"))


@query("m_binary", f"WITH {BINARY} SELECT lang, count(*) AS n, round(avg(CAST((q >= 0.5) = y AS INT)), 6) AS accuracy, CASE WHEN count(*) FILTER (CASE WHEN y THEN q ELSE 1 - q END <= 0) = 0 THEN round(avg(CASE WHEN CASE WHEN y THEN q ELSE 1 - q END > 0 THEN -ln(CASE WHEN y THEN q ELSE 1 - q END) END), 6) END AS nll, round(avg((q - CAST(y AS INT)) * (q - CAST(y AS INT))), 6) AS brier FROM r GROUP BY lang")
def m_binary(spark, d):
    return rounded(m.binary(labelled(spark, d), "y", "q", by=("lang",)))


CELLS = with_sql(pred_sql()) + ", c AS (SELECT game, side, step, NOT eliminated AS y, (okey * 3 + step * 7 + length(class_id)) % 19 / 19.0 * 0.9 + 0.05 AS q FROM pred), e AS (SELECT *, q >= 0.5 AS yes, -ln(CASE WHEN y THEN q ELSE 1 - q END) AS loss FROM c)"


def cell_q(class_id):
    return (F.col("okey") * 3 + F.col("step") * 7 + F.length(class_id)) % 19 / 19.0 * 0.9 + 0.05


def cells(spark, d):
    return predictions(spark, d).select(*ROW, (~F.col("eliminated")).alias("y"), cell_q("class_id").alias("q"))


@query("m_mask", CELLS + ", x AS (SELECT min(CAST(yes = y AS INT)) AS exact, count(*) FILTER (yes AND y) AS tp, count(*) FILTER (yes AND NOT y) AS fp, count(*) FILTER (NOT yes AND y) AS fn, sum(loss) AS bce, count(*) AS n FROM e GROUP BY game, side, step) SELECT round(avg(exact), 6) AS exact_match, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, round(sum(bce) / sum(n), 6) AS bce FROM x")
def m_mask(spark, d):
    return rounded(m.mask_metrics(cells(spark, d), ROW, "y", "q"))


@query("m_mask_balanced_loss", CELLS + " SELECT round(0.5 * (avg(CASE WHEN y THEN loss END) + avg(CASE WHEN NOT y THEN loss END)), 6) AS loss FROM e")
def m_mask_balanced_loss(spark, d):
    return rounded(m.mask_balanced_loss(cells(spark, d), "y", "q"))


@query("m_mover_only", f"{S} SELECT coalesce(side, 'all') AS side, count(*) AS support, {MEAN} FROM s GROUP BY ROLLUP (side)")
def m_mover_only(spark, d):
    return rounded(m.by_side(scores(spark, d)))


AB = with_sql(pred_sql(), score_sql("s"), pred_sql("B", "pred_b"), score_sql("s_b", "pred_b").replace("pt AS", "pt_b AS").replace("FROM pt GROUP", "FROM pt_b GROUP"))


def both_systems(spark, d):
    """Row scores of both systems, from one scan."""
    def each(values, codes, names):
        yield ("A",), values["p"], None
        yield ("B",), values["other"], None

    o = F.col("o")
    return batches.row_scores(distributions(spark, d, "AB"), "o", {"p": o["p"], "other": o["other"]}, ROW, "system string", each)


@query("m_side_report", f"{AB} SELECT system, side, count(*) AS support, {MEAN} FROM (SELECT 'A' AS system, * FROM s UNION ALL SELECT 'B', * FROM s_b) GROUP BY system, side")
def m_side_report(spark, d):
    return rounded(m.summary(both_systems(spark, d), ("system", "side")))


@query("m_zero_truth", f"{S}, t AS (SELECT count(*) FILTER (p_truth = 0) AS z, avg(nll) AS nll FROM s GROUP BY game, side) SELECT count(*) AS tracks, count(*) FILTER (z > 0) AS zero_tracks, CASE WHEN max(z) = 0 THEN round(avg(nll), 6) END AS nll, max(z) > 0 AS infinite FROM t")
def m_zero_truth(spark, d):
    return rounded(m.zero_truth(scores(spark, d)))


@query("m_horizon_full", f"{S}, {LATEST}, f AS (SELECT -1 AS horizon, s.* FROM s QUALIFY row_number() OVER (PARTITION BY game, side ORDER BY step DESC) = 1), u AS (SELECT * FROM l UNION ALL SELECT * FROM f), g AS (SELECT *, side AS grp FROM u UNION ALL SELECT *, 'both' FROM u), e AS (SELECT horizon, grp, sum(abs(a - c)) / sum(n) AS ece FROM (SELECT horizon, grp, least(floor(confidence * 15), 14) AS bin, count(*) AS n, sum(credit_1) AS a, sum(confidence) AS c FROM g GROUP BY horizon, grp, bin) GROUP BY horizon, grp) SELECT horizon, grp AS \"group\", count(*) AS support, {MEAN}, round(any_value(ece), 6) AS ece FROM g JOIN e USING (horizon, grp) GROUP BY horizon, grp")
def m_horizon_full(spark, d):
    return rounded(m.horizon_full(scores(spark, d)))


PARAMS = "x AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), t AS (SELECT event_id, 'k' AS name, k AS value FROM x UNION ALL SELECT event_id, 'm', k % 4 FROM x), g AS (SELECT event_id, 'k' AS name, (event_id * 7) % 10 AS guess FROM events UNION ALL SELECT event_id, 'm', (event_id * 5) % 4 FROM events WHERE event_id % 3 <> 0)"


@query("m_parameters", f"WITH {PARAMS} SELECT coalesce(name, 'all') AS name, round(avg(CASE WHEN value = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM t LEFT JOIN g USING (event_id, name) GROUP BY ROLLUP (name)")
def m_parameters(spark, d):
    events = read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    pair = lambda *v: F.explode(F.array(*(F.struct(F.lit(n).alias("name"), x.cast("long").alias("value")) for n, x in v))).alias("t")
    truth = events.select("event_id", pair(("k", F.col("k")), ("m", F.col("k") % 4))).select("event_id", "t.*")
    guess = events.select("event_id", pair(("k", F.col("event_id") * 7 % 10), ("m", F.col("event_id") * 5 % 4))).select("event_id", "t.*")
    return rounded(m.parameters(truth, guess.where((F.col("name") == "k") | (F.col("event_id") % 3 != 0)), ["event_id"]))


ENTROPY = with_sql(pred_sql()) + ", h AS (SELECT game, side, step, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS e FROM pred GROUP BY game, side, step), q AS (SELECT *, lag(e) OVER (PARTITION BY game, side ORDER BY step) AS b FROM h)"


@query("m_entropy", ENTROPY + " SELECT round(avg(b - e), 6) AS entropy_reduction, round(avg(CASE WHEN step % 2 = 0 THEN b - e END), 6) AS information_gain FROM q")
def m_entropy(spark, d):
    from sequent.operators import sequences

    rows = sequences.entropy_delta(predictions(spark, d), ROW, ["game", "side"], "step")
    return rounded(m.entropy_means(rows.withColumn("information_gain", F.when(F.col("step") % 2 == 0, F.col("entropy_before") - F.col("entropy_after")))))
