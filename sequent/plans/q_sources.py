"""Source, sink and streaming queries over data that Spark derives from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequent.operators import metrics as m
from sequent.operators import posteriors as o
from sequent.operators import sequences as s
from sequent.plans import adapters as a
from sequent.plans import q_metrics
from sequent.plans.adapters import EVENT_TYPES, read
from sequent.sources import ndjson as src
from sequent.sources.folders import fresh_path
from sequent.sources.lines import file_order, numbered_lines, read_lines
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


EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("user_id", T.LongType())])


#: Bytes that a line of the strict source may have, and bytes of its ranges.
LINE_BYTES, RANGE_BYTES = 200, 1 << 16
KINDS = [(29, "over-long"), (23, "not UTF-8"), (19, "carriage return"), (11, "keys differ"), (13, "repeated key or bad number"), (17, "blank line")]
KIND_SQL = "CASE " + " ".join(f"WHEN event_id % {n} = 0 THEN '{kind}'" for n, kind in KINDS) + " END"


def written_lines(spark, d):
    """Events as files of JSON lines, by user; some lines are broken in one way or another."""
    good = F.to_json(F.struct("event_id", "event_type", "user_id"))
    bad = {
        "over-long": F.concat(good, F.lit(" " * LINE_BYTES)), "not UTF-8": F.concat(good.cast("binary"), F.lit(b"\xc3\x28")).cast("string"), "carriage return": F.concat(good, F.lit("\r")), "keys differ": F.to_json(F.struct("event_id", "event_type")),
        "repeated key or bad number": F.concat(F.lit('{"event_id":1,"event_id":2,"event_type":"x","user_id":'), F.col("user_id"), F.lit("}")), "blank line": F.lit(""),
    }
    value = reduce(lambda rest, x: F.when(F.col("event_id") % x[0] == 0, bad[x[1]]).otherwise(rest), reversed(KINDS), good)
    path = fresh_path(spark, "lines")
    rows = read(spark, d, "events").select("event_id", value.alias("value"), (F.col("user_id") % 3).alias("bucket"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "event_id").drop("event_id").write.partitionBy("bucket").text(path)
    return path


def bucket():
    return F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket")


@query("src_ndjson_strict", f"SELECT event_id, event_type, user_id FROM events WHERE {KIND_SQL} IS NULL")
def src_ndjson_strict(spark, d):
    return src.strict_files(spark, written_lines(spark, d), EVENT, LINE_BYTES, RANGE_BYTES)[0]


@query("src_ndjson_rejects", f"SELECT * FROM (SELECT user_id % 3 AS bucket, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS line, {KIND_SQL} AS reason FROM events) WHERE reason IS NOT NULL")
def src_ndjson_rejects(spark, d):
    """Every rejected line with its number in its file."""
    return src.strict_files(spark, written_lines(spark, d), EVENT, LINE_BYTES, RANGE_BYTES)[1].select(bucket(), "line", "reason")


@query("src_trace_bounded", "WITH x AS (SELECT doc_id % 4 AS bucket, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS line, strlen(doc_id || ':' || translate(text, chr(10) || chr(13), '  ')) AS n FROM documents) SELECT bucket, count(*) FILTER (n <= 2000) AS kept, CAST(sum(n) FILTER (n <= 2000) AS BIGINT) AS bytes, count(*) FILTER (n > 2000) AS long_lines, min(line) FILTER (n > 2000) AS first_long FROM x GROUP BY bucket")
def src_trace_bounded(spark, d):
    """Documents as lines of files, read with a bound on a line's bytes; over-long ones are told by their line numbers."""
    path = fresh_path(spark, "traces")
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.translate("text", "\n\r", "  ")).alias("value"), (F.col("doc_id") % 4).alias("bucket"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").drop("doc_id").write.partitionBy("bucket").text(path)
    lines = read_lines(spark, path, 2000, 1 << 18)
    long = numbered_lines(lines, lines.where("fault = 'over-long'")).groupBy(bucket()).agg(F.count("*").alias("long_lines"), F.min("line").alias("first_long"))
    kept = lines.where("fault is null").groupBy(bucket()).agg(F.count("*").alias("kept"), F.sum("bytes").alias("bytes"))
    return kept.join(long, "bucket", "full_outer").select("bucket", F.coalesce("kept", F.lit(0)).alias("kept"), "bytes", F.coalesce("long_lines", F.lit(0)).alias("long_lines"), "first_long")


ORDER_KEY = "event_id % 97 = 0, CASE WHEN user_id % 10 = 7 THEN user_id - 15 ELSE user_id END, user_id, event_id"


@query("w_contiguity", f"WITH x AS (SELECT user_id % 3 AS bucket, user_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY {ORDER_KEY}) AS n FROM events), y AS (SELECT *, lag(user_id) OVER (PARTITION BY bucket ORDER BY n) AS was FROM x) SELECT bucket, user_id, count(*) FILTER (was IS NULL OR was <> user_id) AS runs, count(*) AS rows, count(*) FILTER (was > user_id) AS breaks FROM y GROUP BY bucket, user_id")
def w_contiguity(spark, d):
    """Files of events where some users' rows lie in several places and some users stand behind later ones: order by byte offset."""
    path = fresh_path(spark, "order")
    place = [F.col("event_id") % 97 == 0, F.when(F.col("user_id") % 10 == 7, F.col("user_id") - 15).otherwise(F.col("user_id")), "user_id", "event_id"]
    rows = read(spark, d, "events").withColumn("bucket", F.col("user_id") % 3).repartition("bucket").sortWithinPartitions("bucket", *place)
    rows.select(F.to_json(F.struct("event_id", "user_id")).alias("value"), "bucket").write.partitionBy("bucket").text(path)
    lines = read_lines(spark, path, part_bytes=RANGE_BYTES).withColumn("user_id", F.get_json_object("value", "$.user_id").cast("long"))
    games, breaks = file_order(lines, "user_id", "user_id")
    broken = breaks.groupBy("file", "user_id").agg(F.count("*").alias("breaks"))
    return games.join(broken, ["file", "user_id"], "left").select(bucket(), "user_id", "runs", "rows", F.coalesce("breaks", F.lit(0)).alias("breaks"))


@query("src_trace_explode", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ply, role FROM conversations")
def src_trace_explode(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    traces = read(spark, d, "conversations").groupBy("conv_id").agg(steps.alias("steps"))
    return src.exploded(traces, ["conv_id"], "steps", ["role"])


@query("src_catalog", "WITH e AS (SELECT source AS id, lang AS family FROM documents UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation) SELECT id, CASE WHEN count(DISTINCT family) = 1 THEN any_value(family) END AS family, count(DISTINCT family) AS families FROM e GROUP BY id")
def src_catalog(spark, d):
    """All documents' sources and all nations: the former conflict, the latter do not."""
    entries = read(spark, d, "documents").select(F.col("source").alias("id"), F.col("lang").alias("family"))
    entries = entries.unionByName(read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("family")))
    good, bad = src.catalog(entries, "id", "family")
    return good.withColumn("families", F.lit(1).cast("long")).unionByName(bad.withColumn("family", F.lit(None).cast("string")))


@query("src_game_corpus", "SELECT doc_id, doc_id % 9 <> 0 AND count(*) OVER (PARTITION BY text) = 1 AS ok FROM documents")
def src_game_corpus(spark, d):
    docs = read(spark, d, "documents").withColumn("declared", F.when(F.col("doc_id") % 9 == 0, "none").otherwise(F.sha2("text", 256)))
    return src.corpus(docs, "text", "declared", "doc_id").select("doc_id", "ok")


LABELS = "lb AS (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 40 = 1 UNION ALL SELECT doc_id + 100000000, quality FROM labels WHERE doc_id % 50 = 4)"


@query("src_labels", f"WITH {LABELS}, a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS m, min(quality) AS quality FROM lb GROUP BY doc_id), x AS (SELECT doc_id, quality, CASE WHEN n IS NULL THEN 'unknown' WHEN m IS NULL THEN 'missing' WHEN n > 1 OR m > 1 THEN 'repeated' ELSE 'ok' END AS status FROM a FULL JOIN b USING (doc_id)) SELECT doc_id, CASE WHEN status = 'ok' THEN quality END AS quality, status FROM x")
def src_labels(spark, d):
    """All labels, some of them twice and some of documents that are not there."""
    own = read(spark, d, "labels").select("doc_id", "quality")
    labels = own.union(own.where("doc_id % 40 = 1")).union(own.where("doc_id % 50 = 4").withColumn("doc_id", F.col("doc_id") + 100_000_000))
    return src.one_label_each(read(spark, d, "documents"), labels, "doc_id", "quality")


@query("src_multi_namespaced", "SELECT 'n:' || n_nationkey AS id, 'n' AS namespace FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'r' FROM region")
def src_multi_namespaced(spark, d):
    parts = {"n": read(spark, d, "nation").select(F.col("n_nationkey").alias("id")), "r": read(spark, d, "region").select(F.col("r_regionkey").alias("id"))}
    return src.namespaced(parts, "id")


def tree_sql(source, key, line, leaf=1024, fan=1024, levels=4):
    """digest, rows, first, last of a hash tree (trees.py) over a table, levels folded one by one until one node is left."""
    folds = "".join(f", l{k} AS (SELECT node // {fan} AS node, sha256('{k}:' || string_agg(d, '' ORDER BY p.node)) AS d FROM l{k - 1} p GROUP BY 1)" for k in range(1, levels))
    tops = " UNION ALL ".join(f"SELECT {k} AS level, any_value(d) AS d, count(*) AS n FROM l{k}" for k in range(levels))
    return (
        f"WITH e AS (SELECT {key} AS key, sha256({line}) AS d FROM {source}), n AS (SELECT key, d, row_number() OVER (ORDER BY key, d) - 1 AS n FROM e), l0 AS (SELECT n // {leaf} AS node, sha256('0:' || string_agg(d, '' ORDER BY n)) AS d FROM n GROUP BY 1){folds} "
        f"SELECT (SELECT d FROM ({tops}) WHERE n = 1 ORDER BY level LIMIT 1) AS digest, (SELECT count(*) FROM n) AS rows, (SELECT min(key) FROM n) AS first, (SELECT max(key) FROM n) AS last"
    )


EVENT_LINE = "'{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}'"


@query("snk_dataset_manifest", f"SELECT (SELECT count(DISTINCT user_id) FROM events) AS games, (SELECT CAST(sum(length({EVENT_LINE}) + 1) AS BIGINT) FROM events) AS bytes, (SELECT CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END FROM events) AS identity, t.rows, t.digest AS sha256 FROM ({tree_sql('events', 'event_id', EVENT_LINE)}) t")
def snk_dataset_manifest(spark, d):
    return src.manifest(read(spark, d, "events").select("event_id", "event_type", "user_id"), "user_id", ["event_id"], "event_type")


@query("snk_training_frequency", a.with_sql() + ", u AS (SELECT DISTINCT game, side, truth FROM steps) SELECT side, count(*) AS total, count(DISTINCT truth) AS classes FROM u GROUP BY side")
def snk_training_frequency(spark, d):
    found = o.training_frequency(a.steps(spark, d), ["game"], "side", "truth")
    return found.groupBy("side").agg(F.sum("n").alias("total"), F.count("*").alias("classes"))


def in_two_runs(spark, rows, first, use):
    """use(stream) over rows that come as several files: some of them, then, after a restart, the others; each in three batches.

    A batch has a third of the files, and there are as many files as a shuffle has partitions, so no task grows with the rows.
    """
    path = fresh_path(spark, "stream")
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for some in (first, ~first):
        rows.where(some).repartition(files).write.mode("append").parquet(path)
        found = use(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(path))
    return found


@query("st_metrics", q_metrics.ORACLES["m_report"])
def st_metrics(spark, d):
    """The whole report of a stream of row scores, tracks being split over batches and a restart in between."""
    path = fresh_path(spark, "st-metrics")
    tracks = in_two_runs(spark, q_metrics.scores(spark, d), F.col("step") % 2 == 0, lambda stream: live.accumulated(stream, path, m.track_sums, m.added_tracks))
    return q_metrics.rounded(m.reported(tracks))


@query("st_metrics_binary", q_metrics.ORACLES["m_binary"])
def st_metrics_binary(spark, d):
    path = fresh_path(spark, "st-binary")
    merge = lambda parts: parts.groupBy("lang").agg(*(F.sum(c).alias(c) for c in parts.columns if c != "lang"))
    sums = in_two_runs(spark, q_metrics.labelled(spark, d), F.col("doc_id") % 2 == 0, lambda stream: live.accumulated(stream, path, lambda rows: m.binary_sums(rows, "y", "q", by=("lang",)), merge))
    return q_metrics.rounded(m.binary_of(sums, ("lang",)))


@query("st_metrics_mask", q_metrics.ORACLES["m_mask"])
def st_metrics_mask(spark, d):
    """A row's cells come together, as one row of the stream."""
    path = fresh_path(spark, "st-mask")
    cell = lambda x: F.struct((~x["eliminated"]).alias("y"), q_metrics.cell_q(x["class_id"]).alias("q"))
    rows = a.distributions(spark, d).select(*a.ROW, F.transform("o", cell).alias("cells"))
    part = lambda batch: m.mask_array_sums(batch, "cells", "y", "q")
    merge = lambda parts: parts.agg(*(F.sum(c).alias(c) for c in parts.columns))
    return q_metrics.rounded(m.mask_of(in_two_runs(spark, rows, F.col("step") % 2 == 0, lambda stream: live.accumulated(stream, path, part, merge))))


@query("st_convert", "SELECT DISTINCT user_id, event_type FROM events")
def st_convert(spark, d):
    """Repeats go, however far apart they are."""
    path = fresh_path(spark, "st-convert")
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type")
    return in_two_runs(spark, rows, F.col("event_id") % 2 == 0, lambda stream: live.converted_to_files(stream, ["user_id", "event_type"], path)).select("user_id", "event_type")


LIVE = f"WITH {a.EVENTS_SQL}, kk(class_id) AS (VALUES {', '.join(f'({chr(39)}{e}{chr(39)})' for e in EVENT_TYPES)}), w AS (SELECT game, step, class_id, sum(CASE WHEN kind = class_id THEN 0.5 ELSE -0.25 END) OVER (PARTITION BY game, class_id ORDER BY step) AS w FROM ev CROSS JOIN kk), e AS (SELECT *, exp(w - max(w) OVER (PARTITION BY game, step)) AS e FROM w) SELECT game AS session, step AS revision, class_id, round(e / sum(e) OVER (PARTITION BY game, step), 6) AS p FROM e"


@query("st_live_posterior_batch", LIVE)
def st_live_posterior_batch(spark, d):
    """The live posterior of each event, as the batch window that the stateful operator must equal."""
    rows = a.event_steps(spark, d).withColumn("class_id", F.explode(F.array(*map(F.lit, EVENT_TYPES)))).withColumn("eliminated", F.lit(False))
    ll = F.when(F.col("kind") == F.col("class_id"), 0.5).otherwise(-0.25)
    found = s.posterior(rows, ["game", "class_id"], ["game", "step"], "step", ll, F.lit(0.0))
    return found.select(F.col("game").alias("session"), F.col("step").alias("revision"), "class_id", F.round("p", 6).alias("p"))
