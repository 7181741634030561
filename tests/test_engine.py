"""Hand-computed metrics, invariances and mutations of the engine's operators."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequent.functions import columns as c
from sequent.operators import contracts, fusion, gates, identify, joins, metrics, posteriors, sampling, sequences
from sequent.sources import ndjson
from sequent.streaming import live

ROW = ["game", "side", "step"]
FOUR = [("g1", "white", 5, "A", (0.7, 0.2, 0.1)), ("g1", "white", 10, "B", (0.6, 0.3, 0.1)), ("g2", "black", 5, "A", (0.4, 0.5, 0.1)), ("g2", "black", 10, "B", (0.1, 0.8, 0.1))]


def predictions(spark, rows, eliminated=()):
    flat = [(g, s, k, t, cls, p, (g, k, cls) in eliminated) for g, s, k, t, ps in rows for cls, p in zip("ABC", ps, strict=True)]
    return spark.createDataFrame(flat, "game string, side string, step int, truth string, class_id string, p double, eliminated boolean")


def test_four_row_fixture(spark):
    scores = metrics.row_scores(predictions(spark, FOUR), ROW)
    top = metrics.top_k(scores).first()
    assert (top.top_1, top.top_3, top.n) == (0.5, 1.0, 4)
    assert math.isclose(metrics.mean_nll(scores).first().nll, -math.log(0.7 * 0.3 * 0.4 * 0.8) / 4)
    assert math.isclose(metrics.ece(scores, 10).first().ece, 0.4)
    by = {r.horizon: r for r in metrics.horizon(scores).collect()}
    assert by[5].top_1 == 0.5 and by[20].tracks == 2
    first = metrics.first_rank_one(scores).first()
    assert (first.mean_first, first.reached, first.never) == (7.5, 2, 0)
    matrix = {(r.truth, r.predicted): r.n for r in metrics.confusion_counts(predictions(spark, FOUR), ROW).collect()}
    assert matrix == {("A", "A"): 1, ("A", "B"): 1, ("B", "A"): 1, ("B", "B"): 1}


def test_ties_share_credit_and_order_does_not_matter(spark):
    rows = [("g", "white", 1, "A", (0.4, 0.4, 0.2)), ("g", "white", 2, "C", (0.4, 0.4, 0.2))]
    pred = predictions(spark, rows)
    for df in (pred, pred.orderBy(F.desc("class_id")), pred.repartition(5)):
        got = {r.step: (r.credit_1, r.credit_3) for r in metrics.row_scores(df, ROW).collect()}
        assert got == {1: (0.5, 1.0), 2: (0.0, 1.0)}
    shares = {(r.truth, r.predicted): r.weight for r in metrics.confusion_fractional(pred, ROW).collect()}
    assert shares[("A", "A")] == 0.5 and shares[("C", "B")] == 0.5


def test_zero_truth_is_null_with_a_flag(spark):
    scores = metrics.row_scores(predictions(spark, [("g", "white", 1, "C", (0.5, 0.5, 0.0))]), ROW)
    assert metrics.mean_nll(scores).first().asDict() == {"nll": None, "infinite": True}
    assert metrics.zero_truth(scores).first().zero_tracks == 1


def test_posterior_eliminates_for_good(spark):
    rows = [("g", k, h, ok) for k in (1, 2, 3) for h, ok in (("open", True), ("shut", k != 1))]
    df = spark.createDataFrame(rows, "game string, step int, h string, legal boolean")
    df = sequences.eliminated(df, ["game", "h"], "step", ~F.col("legal"))
    got = sequences.posterior(df, ["game", "h"], ["game", "step"], "step", F.lit(-0.5), F.log(F.lit(0.5)))
    assert {(r.step, r.h): r.p for r in got.collect()} == {(k, h): float(h == "open") for k in (1, 2, 3) for h in ("open", "shut")}
    assert sequences.restored(got, ["game", "h"], "step").count() == 0


def test_unknown_evidence_is_neutral_and_all_eliminated_is_zero(spark):
    df = spark.createDataFrame([("g", 1, "a", None), ("g", 1, "b", -1.0)], "game string, step int, h string, ll double").withColumn("eliminated", F.lit(False))
    got = {r.h: r.p for r in sequences.posterior(df, ["game", "h"], ["game", "step"], "step", F.col("ll"), F.lit(0.0)).collect()}
    assert math.isclose(got["a"], 1 / (1 + math.exp(-1)))
    gone = sequences.posterior(df.withColumn("eliminated", F.lit(True)), ["game", "h"], ["game", "step"], "step", F.col("ll"), F.lit(0.0))
    assert [r.p for r in gone.collect()] == [0.0, 0.0]


def test_audits_find_each_break(spark):
    rows = spark.createDataFrame([("g", 0, "w", 0, 1), ("g", 1, "b", 1, 2), ("g", 3, "b", 9, 3)], "game string, ply int, side string, ahead int, after int")
    assert sequences.continuity(rows, ["game"], "ply").first().first_bad == 3
    assert sequences.repeats_of_side(rows, ["game"], "ply", "side").count() == 1
    assert sequences.chain_breaks(rows, ["game"], "ply", "after", "ahead").count() == 1
    assert {r.column for r in sequences.not_constant(rows, ["game"], ["side", "after"]).collect()} == {"side", "after"}
    assert contracts.bad_distributions(predictions(spark, [("g", "white", 1, "A", (0.5, 0.3, 0.1))]), ROW).count() == 1
    assert contracts.bad_masks(predictions(spark, [("g", "white", 1, "A", (0.5, 0.4, 0.1))], {("g", 1, "A")}), ROW, 3).count() == 1


def test_closed_keys_and_strict_lines(spark):
    lines = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":1}',), ('{"a":1,"a":2,"b":"x"}',), ("",), ("nonsense",), ('{"a":NaN,"b":"x"}',), ('{"a":"t","b":"x"}',), ('{"a":1,"b":"x","c":{"d":1,"d":2}}',)], "value string")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows, rejects = ndjson.strict(lines, schema)
    assert [tuple(r) for r in rows.collect()] == [(1, "x")]
    assert rejects.count() == 7
    assert contracts.closed_keys(lines.limit(2), "value", ["a", "b"]).first().missing == ["b"]


def test_rank_fusion_keeps_the_order(spark):
    import random

    random.seed(4)
    rows = []
    for g in range(40):
        w = [random.choice([0, 1, 2, 2, 3]) for _ in range(5)]
        total = sum(w) or 1
        rows += [(g, k, w[k] / total, random.uniform(-5, 5), random.random() < 0.2) for k in range(5)]
    df = spark.createDataFrame(rows, "game int, class_id int, prior double, residual double, eliminated boolean")
    got = fusion.rank_fusion(df, ["game"], "prior", "residual", 1.0).cache()
    assert fusion.order_inversions(got.where("not eliminated"), ["game"], "prior").count() == 0
    assert got.where("eliminated and p <> 0").count() == 0
    sums = got.groupBy("game").agg(F.sum("p").alias("s"), F.min("eliminated").alias("none")).where("not none").collect()
    assert all(math.isclose(r.s, 1.0) for r in sums)


def test_temperature_fit_finds_the_minimum(spark):
    rows = [(k, [2.0 * (j == k % 3) + 0.3 * ((k + j) % 2) for j in range(3)], (k + (k % 5 == 0)) % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, e array<double>, label int")
    logits = fusion.long_logits(df, "id", "e", "label")
    t, nll = fusion.fit_temperature(logits, "id")
    near = {r.t: r.nll for r in fusion.temperature_nll(logits, "id", [t * 0.9, t * 1.1]).collect()}
    assert all(v >= nll for v in near.values())


def test_bootstrap_is_deterministic_and_gates_fail_closed(spark):
    clusters = spark.createDataFrame([(k, float(k % 3), 1.0) for k in range(30)], "game long, t double, w double")
    one, two = (sorted(map(tuple, gates.bootstrap(x, "game", "t", "w", 40).collect())) for x in (clusters, clusters.repartition(7)))
    assert one == two
    box = gates.interval(gates.bootstrap(clusters, "game", "t", "w", 40)).first()
    assert box.low < 1.0 < box.high
    found = gates.gates(spark.createDataFrame([("a", 0.5), ("b", float("nan"))], "metric string, value double"), spark.createDataFrame([("g1", "a", ">=", 0.4), ("g2", "b", ">=", 0.0), ("g3", "c", "<", 1.0)], "gate string, metric string, op string, bound double"), ["metric"])
    decision = gates.decide(found).first()
    assert (decision.passed, decision.failed, decision.missing, decision.accepted) == (1, 0, 2, False)


def test_splitmix_reference_values(spark):
    got = spark.createDataFrame([(0,)], "x long").select(gates.splitmix64(F.col("x")).alias("y")).first().y
    assert got == "16294208416658607535"  # first output of the public generator for seed 0


def test_sampling_gives_exact_counts_in_any_order(spark):
    rows = spark.createDataFrame([("long", k) for k in range(20)] + [("short", k) for k in range(3)], "game string, row int")
    one, two = (sorted((r.game, r.row, r.draw) for r in sampling.game_balanced(x, "game", "row", 6, "s").collect()) for x in (rows, rows.orderBy(F.desc("row")).repartition(3)))
    assert one == two and len(one) == 12
    paired = sampling.opportunity_paired(rows.withColumn("hit", F.col("row") % 4 == 0), "game", "row", "hit", k=12)
    assert {r.game: r.n for r in paired.groupBy("game").agg(F.count("*").alias("n")).collect()} == {"long": 12, "short": 12}


def test_joins_check_what_they_join(spark):
    left, right = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ((1, 2, 2, 3), (2, 3, 4)))
    assert joins.cover(left, right, "k").first().asDict() == {"matched": 2, "missing": 1, "unknown": 1, "repeated": 1}
    titles = spark.createDataFrame([(1, "It’s  One"), (2, "Two"), (3, "two ")], "id int, title string")
    asked = spark.createDataFrame([("it's one",), ("TWO",)], "name string")
    assert [r.id for r in joins.by_title(asked, titles, "name", "title").collect()] == [1]


def test_position_codecs(spark):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    df = spark.createDataFrame([(1, start, "e2e4", "Nxf3+", "e7e8q")], "id int, fen string, uci string, san string, up string")
    facts = c.san_facts(F.col("san"))
    row = df.select(c.move_index(F.col("uci")).alias("m"), c.move_index(F.col("up")).alias("u"), c.normalized_fen(F.col("fen")).alias("f"), *(v.alias(k) for k, v in facts.items())).first()
    assert (row.m, row.u, row.f) == ((12 * 64 + 28) * 5, (52 * 64 + 60) * 5 + 4, start)
    assert (row.piece, row.capture, row.check, row.castle) == ("N", True, True, False)
    features = c.board_features(df, ["id"], "fen")
    assert features.count() == 32 + 7  # white to move, four castling rights, no en passant, move number
    assert df.select(c.normalized_fen(F.lit("8/8/8/8/8/8/8/8 w - - 0 1")).alias("f")).first().f is None
    text = '[White "A \\"b\\""]\n[Event "x"]\n1. e4'
    assert spark.createDataFrame([(text,)], "t string").select(c.headers(F.col("t")).alias("h")).first().h == {"Event": "x", "White": 'A "b"'}


def test_identifiability(spark):
    rows = spark.createDataFrame([("g", 1, "A", "A", False, "s"), ("g", 1, "B", "A", False, "s"), ("g", 1, "C", "A", True, "t")], "game string, step int, class_id string, truth string, eliminated boolean, sig string")
    got = identify.survivors(rows, ["game", "step"]).first()
    assert (got.hypotheses, got.classes, got.identifiable, got.credit_1) == (2, 2, False, 0.5)
    groups = identify.mask_classes(rows, ["game", "step"], "sig").first()
    assert (groups.groups, groups.own_size, groups.own_labels) == (1, 2, 2) and abs(groups.entropy) < 1e-12


def test_live_posterior_reorders_and_drops_stale_revisions(spark, tmp_path):
    batches = [[("s1", 2, [0.0, 1.0])], [("s1", 1, [0.5, 0.0]), ("s2", 1, [0.0, 0.0])], [("s1", 1, [9.0, 9.0]), ("s1", 3, [1.0, 0.0])]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(int(a[1:]), r, x) for a, r, x in rows], "session long, revision long, scores array<double>").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("session long, revision long, scores array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    rows = live.run_to_files(live.live_posterior(stream, ["a", "b"]), f"{tmp_path}/out").collect()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    done = sorted((r.session, r.revision) for r in rows if r.status == "delivered" and r.class_id == "a")
    assert done == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert [(r.session, r.revision) for r in rows if r.status == "stale"] == [(1, 1)]
    last = next(r.p for r in rows if (r.session, r.revision, r.class_id) == (1, 3, "a"))
    assert math.isclose(last, math.exp(1.5) / (math.exp(1.5) + math.exp(1.0)))


def test_opportunity_keeps_unknown_variants_in_the_denominator(spark):
    rows = spark.createDataFrame([("g", 1, "A", 0.5, True, 1), ("g", 1, "A", 0.5, False, None)], "game string, step int, class_id string, w double, known boolean, allowed int")
    got = posteriors.opportunity(rows, ["game", "step"], "w", 5).first()
    assert (got.known_mass, got.allowed_mass, got.forced_mass) == (0.5, 0.1, 0.5)


def plain_splitmix(seed, count, n):
    """Places that one SplitMix64 sequence draws from n by rejection."""
    state, mask, out = seed, 2**64 - 1, []
    while len(out) < count:
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        z ^= z >> 31
        if z < 2**64 - 2**64 % n:
            out.append(z % n)
    return out


def test_fixed_bootstrap_equals_the_plain_sequence(spark):
    rng = random.Random(5)
    deltas = [(f"g{k:04d}", rng.uniform(-1, 1)) for k in range(625)]
    rows = spark.createDataFrame(deltas, "game string, delta double").withColumn("w", F.lit(1.0)).repartition(7)
    got = {r.r: r.value for r in gates.bootstrap(rows, "game", "delta", "w", 60).collect()}
    places = plain_splitmix(gates.SEED, 60 * 625, 625)
    want = [sum(deltas[p][1] for p in places[r * 625 : r * 625 + 625]) / 625 for r in range(60)]
    assert len(got) == 60 and all(math.isclose(got[r], want[r], abs_tol=1e-12) for r in range(60))
    times = gates.resampled(rows.select("game", "delta"), "game", 3).groupBy("r").agg(F.sum("times").alias("n"), F.sum(F.col("delta") * F.col("times")).alias("s")).collect()
    assert {r.r: r.n for r in times} == {0: 625, 1: 625, 2: 625} and all(math.isclose(r.s / 625, want[r.r], abs_tol=1e-12) for r in times)


def test_resampling_is_uniform_over_many_clusters(spark):
    n, count = 100_000, 40
    found = gates.resampled(spark.range(n).withColumnRenamed("id", "k"), "k", count)
    per = found.groupBy("k").agg(F.sum("times").alias("times"))
    assert found.groupBy("r").agg(F.sum("times").alias("n")).where(F.col("n") != n).count() == 0
    runs = per.groupBy((F.col("k") * 16 / n).cast("int").alias("run")).agg(F.sum("times").alias("n")).collect()
    mean = n * count / 16
    assert len(runs) == 16 and all(abs(r.n - mean) < 5 * mean**0.5 for r in runs)
    drawn = per.count()
    assert abs(drawn - n * (1 - math.exp(-count))) < 5 and per.agg(F.max("times")).first()[0] < 90
    one = found.where("r = 0").count()
    assert abs(one - n * (1 - 1 / math.e)) < 1000
    assert gates.resampled_sums(spark.range(0).withColumn("t", F.lit(1.0)), "id", ["t"], 5).count() == 0


def test_scores_of_classes_in_columns_equal_those_of_rows(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", "c", "d", None]), *(rng.choice([0, 0, 1, 1, 2, None]) for _ in "abcxyz")) for k in range(400)]
    wide = spark.createDataFrame(rows, "step int, truth string, a long, b long, c long, x long, y long, z long")
    got = {r.step: r for r in metrics.column_scores(wide, list("abc"), {"A": list("abc"), "B": list("xyz")}, "truth", ["step"]).collect()}
    for step, truth, *both in rows:
        for s, weights in (("A", both[:3]), ("B", both[3:])):
            there = [w for w in weights if w is not None]
            own = dict(zip("abc", weights, strict=True)).get(truth)
            assert got[step][f"credit_1_{s}"] == (None if own is None else 0.0 if own < max(there) else 1 / there.count(own))
            assert (got[step][f"nll_{s}"] is None) == (not own) and (not own or math.isclose(got[step][f"nll_{s}"], -math.log(own / sum(there)), abs_tol=1e-12))


def test_paired_tracks_are_scored_without_python(spark):
    from sequent.plans import q_models

    for found in (q_models.track_deltas, q_models.pair_tracks):
        assert "MapInArrow" not in found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_nearest_control_without_reuse(spark):
    rng = random.Random(8)
    rows = [(g, k, rng.random() < 0.45, f"{rng.randrange(16**6):06x}") for g in range(12) for k in sorted(rng.choices(range(60), k=40))]
    df = spark.createDataFrame(rows, "g int, step int, hit boolean, t string").repartition(5)
    band = F.when(F.col("step") < 20, 0).otherwise(1)
    got = sorted(tuple(r) for r in joins.nearest_control(df, ["g"], band, "step", "hit", F.col("t")).collect())
    want = []
    for g in range(12):
        for b in (0, 1):
            own = [r for r in rows if r[0] == g and (r[1] >= 20) == b]
            free = [r for r in own if not r[2]]
            for h in sorted((r for r in own if r[2]), key=lambda h: (h[3], h[1])):
                if free:
                    c = min(free, key=lambda c: (abs(c[1] - h[1]), c[3], c[1]))
                    want.append((g, h[1], c[1], abs(c[1] - h[1])))
                    free.remove(c)
    assert got == sorted(want)


def test_ten_thousand_hits_of_one_group_are_one_pass(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("g"), F.when(F.col("id") < 10_000, F.col("id")).otherwise(F.col("id") + 5).alias("step"), (F.col("id") < 10_000).alias("hit"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = joins.nearest_control(rows, ["g"], F.lit(0), "step", "hit", F.col("t")).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) <= 3
    # All controls lie behind all hits: the hit that is served k-th gets the k-th control.
    order = {s: k for k, s in enumerate(sorted(range(10_000), key=lambda s: hashlib.sha256(str(s).encode()).hexdigest()))}
    assert {r.at: r.control for r in got} == {s: 10_005 + k for s, k in order.items()}


def test_controls_of_many_small_groups_need_no_exchange_and_no_batch_each(spark):
    rng = random.Random(9)
    rows = [(None if g == 7 else g, k, rng.random() < 0.4, f"{rng.randrange(99):02x}") for g in range(300) for k in rng.choices(range(60), k=rng.choice([1, 2, 9, 40]))]
    df = spark.createDataFrame(rows, "g int, step int, hit boolean, t string").groupBy("g").agg(F.collect_list(F.struct("step", "hit", "t")).alias("own")).select("g", F.inline("own"))
    found = joins.nearest_control(df, ["g"], F.when(F.col("step") < 20, 0).otherwise(1), "step", "hit", F.col("t"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of `df`: what lies by a part of the group stays
    want = []
    for key in {(r[0], r[1] >= 20) for r in rows}:
        own = [r for r in rows if (r[0], r[1] >= 20) == key]
        free = [r for r in own if not r[2]]
        for h in sorted((r for r in own if r[2]), key=lambda h: (h[3], h[1])):
            if free:
                c = min(free, key=lambda c: (abs(c[1] - h[1]), c[3], c[1]))
                want.append((h[0] is None, h[0] or 0, h[1], c[1], abs(c[1] - h[1])))
                free.remove(c)
    for size in ("10000", "7"):  # groups begin and end anywhere in a batch, and are longer than one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [(r.g is None, r.g or 0, r.at, r.control, r.distance) for r in found.collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(got) == sorted(want)


def plain_paired(rows, k, pairs, anchors):
    """(step, role, place) of one game's rows (game, step, hit), straight from the definition."""
    sha = lambda *x: hashlib.sha256(":".join(map(str, x)).encode()).hexdigest()
    own = sorted((sha("pairs", g, s), s, h) for g, s, h in rows)
    game, n = rows[0][0], len(rows)
    if n < k:
        steps = [s for _, s, _ in own]
        return [(s, "all", p) for p, s in enumerate(steps)] + [(steps[int(sha("again", game, p)[:12], 16) % n], "again", p) for p in range(n, k)]
    band = lambda s: sum(s >= b for b in sampling.BANDS[1:])
    rest, chosen, found = own[anchors:], [], {}
    most, start = min(pairs, (k - anchors) // 2), int(sha("bands", game)[:12], 16) % 5
    free = [x for x in rest if not x[2]]
    waiting = {t: [x for x in rest if x[2] and (band(x[1]) - start) % 5 == t] for t in range(5)}
    added = True
    while added and len(chosen) < most:
        added = False
        for t in range(5):
            while waiting[t] and len(chosen) < most:
                x = waiting[t].pop(0)
                controls = [c for c in free if band(c[1]) == band(x[1])]
                if controls:
                    found[x] = min(controls, key=lambda c: (abs(c[1] - x[1]), c[0], c[1]))
                    free.remove(found[x])
                    chosen.append(x)
                    added = True
                    break
    out = [(s, "anchor") for _, s, _ in own[:anchors]] + [y for x in chosen for y in ((x[1], "hit"), (found[x][1], "control"))]
    used = {s for s, _ in out}
    return [(s, r, p) for p, (s, r) in enumerate((out + [(s, "fill") for _, s, _ in own if s not in used])[:k])]


def test_opportunity_pairs_equal_plain_ones(spark):
    rng = random.Random(6)
    rows = [(g, s, rng.random() < 0.4) for g in range(9) for s in range((70, 40, 24, 23, 5, 1, 90, 30, 26)[g])]
    got = sampling.opportunity_paired(spark.createDataFrame(rows, "game int, step int, hit boolean").repartition(3), "game", "step", "hit").collect()
    for g in range(9):
        assert sorted((r.step, r.role, r.place) for r in got if r.game == g) == sorted(plain_paired([r for r in rows if r[0] == g], 24, 4, 8)), g


def test_board_features_of_the_start(spark):
    fen = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 50 600"
    rows = spark.createDataFrame([(1, fen, "e2e4")], "k int, fen string, uci string")
    got = {r["index"]: r["value"] for r in c.board_features(rows, ["k"], "fen").collect()}
    pieces = {0: [8, 9, 10, 11, 28, 13, 14, 15], 1: [1, 6], 2: [2, 5], 3: [0, 7], 4: [3], 5: [4], 6: range(48, 56), 7: [57, 62], 8: [58, 61], 9: [56, 63], 10: [59], 11: [60]}
    want = {p * 64 + s: 1.0 for p, squares in pieces.items() for s in squares}
    assert got == {**want, 769: 1.0, 770: 1.0, 771: 1.0, 772: 1.0, 773: 1.0, 778: 1.0, 783: 0.5, 784: 1.0}
    whole = c.position_features(rows, ["k"], "fen", "uci", F.lit(False), F.lit(1), F.lit(1), F.lit(1), F.lit(20))
    more = {r["index"]: r["value"] for r in whole.collect() if r["index"] >= 785}
    assert more == {786: 1 / 600, 787: 1 / 300, 788: 1 / 600, 789: 20 / 218, 790: 12 / 63, 791: 28 / 63}


def test_temperatures_equal_golden_section(spark):
    rng = random.Random(4)
    rows = [(k, "white" if k % 2 else "black", [rng.gauss(0, 3 + 5 * (k % 2)) for _ in range(6)], rng.randrange(6)) for k in range(200)]
    rows = [(k, s, [x + 6 * (c == t) * (rng.random() < 0.7) for c, x in enumerate(v)], t) for k, s, v, t in rows]
    logits = fusion.long_logits(spark.createDataFrame(rows, "k long, side string, v array<double>, t int"), "k", "v", "t")
    logits = logits.join(spark.createDataFrame([(k, s) for k, s, *_ in rows], "k long, side string"), "k")
    got = fusion.fit_temperatures(logits, "k", "side")
    for side in ("white", "black"):
        own = [(v, t) for _, s, v, t in rows if s == side]

        def nll(x, own=own):
            total = 0.0
            for v, t in own:
                scaled = [y / math.exp(x) for y in v]
                top = max(scaled)
                total += top + math.log(sum(math.exp(y - top) for y in scaled)) - scaled[t]
            return total / len(own)

        low, high, ratio = math.log(0.05), math.log(10), (5**0.5 - 1) / 2
        for _ in range(96):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if nll(a) <= nll(b) else (a, high)
        assert math.isclose(got[side][0], math.exp(low), rel_tol=1e-4) and math.isclose(got[side][1], nll(low), abs_tol=1e-8)


def test_json_lines_are_judged_alike_with_and_without_python(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    lines = ['{"a":1,"b":"x"}', '{"a":1,"a":2,"b":"x"}', '{"a":1,"b":"{x}"}', "{'a':1,'b':'x'}", '{"a":1}', "", '{"a":NaN,"b":"x"}', '{"a":1,"b":"it\'s"}', '{"a":1,"b":"x"} y', '{"a":1,"b":{"c":1,"c":2}}', "[1]"]
    rows, bad = ndjson.strict(spark.createDataFrame([(x,) for x in lines], "value string"), schema)
    assert sorted(r.b for r in rows.collect()) == ["it's", "x", "{x}"]
    assert {r.value: r.reason for r in bad.collect()}['{"a":1,"a":2,"b":"x"}'] == "repeated key or bad number" and bad.count() == 8


def test_sidecar_rejects_bad_rows(spark):
    good = ("white", [0.1, 2.0], 1, [False, False])
    bad = [("white", [0.1, float("nan")], 1, [False, False]), ("white", [0.1], 0, [False, False]), ("white", [0.1, 1.0], 2, [False, False]), ("white", [0.1, 1.0], 1, [False, True]), (None, [0.1], 0, [False])]
    rows = spark.createDataFrame([good, *bad], "side string, logits array<double>, truth int, mask array<boolean>")
    faults = [r[0] for r in rows.select(ndjson.sidecar_faults(rows)).collect()]
    assert faults == [None, "logit not finite", "lengths differ", "truth out of range", "truth is masked", "missing field"]
