"""Comparator systems in arrays against the long forms of fusion, views by hand, and agents that change."""

import math

from pyspark.sql import functions as F

from sequent.operators import comparators as k
from sequent.operators import fusion

CASES = {
    1: [("a", False, 0.5, 0.2, [1.0, 0.0]), ("b", False, 0.25, 0.8, [0.0, 3.0]), ("c", False, 0.25, 0.0, [2.0, 1.0])],
    2: [("a", True, 0.5, 0.2, [9.0, 9.0]), ("b", False, 0.0, 0.8, [0.0, 3.0]), ("c", False, 0.5, 0.0, [2.0, 1.0])],
    3: [("a", True, 0.0, 0.2, [0.0, 0.0]), ("b", True, 0.0, 0.8, [0.0, 0.0]), ("c", True, 1.0, 0.0, [0.0, 0.0])],
    4: [("a", False, 0.0, 0.0, [0.5, 0.0]), ("b", False, 0.0, 0.0, [0.0, 0.5]), ("c", True, 1.0, 1.0, [0.0, 0.0])],
}
SCHEMA = "row int, truth string, options array<struct<class_id: string, eliminated: boolean, prior: double, frequency: double, residuals: array<double>>>"


def found(spark, temperature=2.0):
    rows = spark.createDataFrame([(r, "a", o) for r, o in CASES.items()], SCHEMA)
    return k.systems(rows, "options", ["m1", "m2"], 0.8, F.lit(temperature))


def softmax(xs):
    top = max((x for x in xs if x is not None), default=0.0)
    e = [0.0 if x is None else math.exp(x - top) for x in xs]
    return [x / sum(e) if sum(e) else 0.0 for x in e]


def test_systems_agree_with_the_long_forms(spark):
    got = {(r.row, r.system): [x.p for x in r.o] for r in found(spark).collect()}
    assert len(got) == 4 * 7
    long = spark.createDataFrame([(r, n, c, gone, p, res[0], res[1], sum(res) / 2) for r, o in CASES.items() for n, (c, gone, p, _, res) in enumerate(o)], "row int, n int, class_id string, eliminated boolean, prior double, r0 double, r1 double, mean double")
    for system, residual in (("m1", "r0"), ("m2", "r1"), ("uncalibrated-ensemble", "mean")):
        want = fusion.rank_fusion(long, ["row"], "prior", residual, 0.8).orderBy("row", "n").collect()
        for r in CASES:
            assert all(math.isclose(x, w.p, abs_tol=1e-12) for x, w in zip(got[r, system], [w for w in want if w.row == r], strict=True)), (r, system)
    for r, options in CASES.items():
        live = [0.0 if gone else 1.0 for _, gone, *_ in options]
        for system, weights in (("uniform", live), ("training-frequency", [f * x for (*_, f, _), x in zip(options, live)]), ("symbolic-only", [p * x for (_, _, p, *_), x in zip(options, live)])):
            assert got[r, system] == [w / sum(weights) if sum(weights) else 0.0 for w in weights]
    warm = got[1, "uncalibrated-ensemble"]
    cooled = softmax([math.log(p) / 2 for p in warm])
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(got[1, "calibrated-ensemble"], cooled))


def test_views_renormalise_and_count_what_they_cannot_score(spark):
    rows = spark.createDataFrame([(1, "white", 1, "a", [("a", 0.5), ("b", 0.25), ("c", 0.25)]), (1, "white", 2, "c", [("a", 0.0), ("b", 0.0), ("c", 1.0)])], "game int, side string, step int, truth string, o array<struct<class_id: string, p: double>>")
    views = k.viewed(rows.withColumn("system", F.lit("s")), "o", {"all": ["a", "b", "c"], "two": ["a", "b"]})
    got = {(r.step, r["view"]): [tuple(x) for x in r.o] for r in views.collect()}
    assert got[1, "two"] == [("a", 0.5 / 0.75), ("b", 0.25 / 0.75)] and got[2, "two"] == [("a", 0.0), ("b", 0.0)] and len(got[1, "all"]) == 3
    report = {(r["view"], r.metric): r.value for r in k.view_report(views, "o", ["game", "side", "step"]).collect()}
    assert report["two", "unscorable"] == 1 and report["two", "row_support"] == 1 and report["all", "row_support"] == 2 and ("all", "unscorable") not in report
    assert k.view_report(views.limit(0), "o", ["game", "side", "step"]).count() == 0


def test_agents_keep_their_contract(spark):
    rows = spark.createDataFrame([("x", "calm", 1), ("x", "calm", 1), ("y", "calm", 1), ("y", "calm", 2), ("z", None, 1), ("z", "calm", 1), ("w", None, None)], "agent string, style string, strength int")
    assert {(r.agent, r.contracts) for r in k.agents_that_change(rows, "agent", ["style", "strength"]).collect()} == {("y", 2), ("z", 2)}
