"""Observations that break one rule each, and gates over classes, parameters and members."""

import math

from pyspark.sql import functions as F

from sequent.operators import gates, identify

SCHEMA = "k string, horizon int, indices array<int>, ordinary array<int>, truth string, truth_id string, hypotheses array<struct<id: string, class_id: string, eliminated: boolean, history: array<int>, posterior: double>>"
GOOD = {"horizon": 5, "indices": [1, 3], "ordinary": [9, 9], "truth": "a", "truth_id": "x", "hypotheses": [("x", "a", False, [7, 7], 0.75), ("y", "b", True, [7, 7], 0.0), ("z", "b", False, [7, 7], 0.25)]}


def hyps(**change):
    """The good hypotheses, the named ones changed."""
    names = ["id", "class_id", "eliminated", "history", "posterior"]
    return {"hypotheses": [tuple((dict(zip(names, h)) | change.get(h[0], {})).values()) for h in GOOD["hypotheses"]]}


CASES = {
    "good": ({}, ""), "without posteriors": (hyps(x={"posterior": None}, y={"posterior": None}, z={"posterior": None}), ""), "late": ({"horizon": 2}, "indices"), "at once": ({"horizon": 3}, ""), "no horizon": ({"horizon": None}, "horizon,indices"), "below": ({"horizon": 0}, "horizon,indices"),
    "zero": ({"indices": [0, 3]}, "indices"), "equal": ({"indices": [3, 3]}, "indices"), "falling": ({"indices": [3, 1]}, "indices"), "null step": ({"indices": [1, None]}, "indices"), "empty": ({"indices": [], "ordinary": []} | hyps(x={"history": []}, y={"history": []}, z={"history": []}), "indices"),
    "short": ({"ordinary": [9]}, "alignment"), "misaligned": (hyps(z={"history": [7]}), "alignment"), "none": ({"hypotheses": []}, "hypotheses,truth"), "no array": ({"hypotheses": None}, "alignment,hypotheses,truth,posterior"), "twice": (hyps(z={"id": "y"}), "hypotheses"), "absent": ({"truth_id": "q"}, "truth"), "other class": ({"truth": "b"}, "truth"),
    "eliminated": (hyps(x={"eliminated": True}), "truth,posterior"), "some": (hyps(y={"posterior": None}), "posterior"), "sum": (hyps(z={"posterior": 0.26}), "posterior"), "close": (hyps(z={"posterior": 0.2500005}), ""), "negative": (hyps(x={"posterior": 1.25}, z={"posterior": -0.25}), "posterior"), "infinite": (hyps(x={"posterior": math.inf}), "posterior"), "not a number": (hyps(x={"posterior": math.nan}), "posterior"),
}


def test_each_rule(spark):
    rows = spark.createDataFrame([(name, *(GOOD | change).values()) for name, (change, _) in CASES.items()], SCHEMA)
    found = identify.observation_faults(rows, "horizon", "indices", "ordinary", "truth", "truth_id", "hypotheses")
    got = {r.k: ",".join(r.violations) for r in found.collect()}
    assert got == {name: faults for name, (_, faults) in CASES.items() if faults}
    assert identify.observation_faults(rows.limit(0), "horizon", "indices", "ordinary", "truth", "truth_id", "hypotheses").count() == 0


def scores(spark, classes="ab", games=30, starve=None):
    rows = [("s", g, side, t, 0.5 if t == "a" else 0.3, 0.0 if t == starve else 1.0, 1.0, g % 4) for g in range(games) for side in ("white", "black") for t in [classes[g % len(classes)]]]
    return spark.createDataFrame(rows, "system string, game int, side string, truth string, credit_3 double, credit_5 double, nll double, step int")


def test_class_gates(spark):
    def status(own, right=F.lit(True), eligible=F.lit(True), members=("s",)):
        metrics = gates.class_metrics(own, ["a", "b"], ["game", "side"], right, eligible, 10).unionByName(gates.member_metrics(own, ["game", "side"]))
        return {r.gate: r.status for r in gates.class_gates(metrics, list(members)).collect() if r.status != "passed"}

    # Of two classes nobody is above a uniform top 5, which would be 5 / 2.
    never = {f"{s}.above_uniform": "failed" for s in ("white", "black")}
    assert status(scores(spark)) == never
    assert status(scores(spark), right=F.when(F.col("step") > 0, True)) == never | {f"{s}.parameter_coverage": "failed" for s in ("white", "black")}
    assert status(scores(spark), right=F.lit(False)) == never | {f"{s}.parameters": "failed" for s in ("white", "black")}
    assert status(scores(spark), eligible=F.lit(False)) == never | {f"{s}.{m}": "missing" for s in ("white", "black") for m in ("parameters", "parameter_coverage")}
    assert status(scores(spark, starve="b")) == never | {f"{s}.starved": "failed" for s in ("white", "black")}
    assert status(scores(spark, "a")) == {f"{s}.{m}": "missing" for s in ("white", "black") for m in ("above_uniform", "macro_top_3")}
    one = status(scores(spark).where("side = 'white'"))
    assert one["s.mean_top_3"] == one["s.mean_nll"] == one["black.starved"] == "missing"
    infinite = scores(spark).withColumn("nll", F.when(F.col("game") > 0, F.col("nll")))
    assert status(infinite, members=("s", "t")) == never | {"s.mean_nll": "missing", "t.mean_top_3": "missing", "t.mean_nll": "missing"}
