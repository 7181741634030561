"""Choice among candidates, pairs of an ablation, comparisons with a control, and the checks of blends and releases."""

import pytest
from pyspark.sql import functions as F

from sequent.operators import gates, selection
from tests.test_gates import BETTER, GOOD, table

RUN = "name string, track_top_1 double, track_top_3 double, track_nll double, multiplier double, seed int, mode string, config string, train string, validation string"


def runs(spark, *rows):
    return spark.createDataFrame([(name, t1, t3, nll, mult, seed, *(more or ("zero", "c", "t", "v"))) for name, t1, t3, nll, mult, seed, *more in [(*r[:6], *(r[6] if len(r) > 6 else ())) for r in rows]], RUN)


def test_best_candidate_and_what_makes_a_choice_void(spark):
    rows = [("a", 0.5, 0.6, 1.0, 2.0, 1), ("b", 0.5, 0.6, 1.0, 1.0, 9), ("c", 0.5, 0.6, 1.0, 1.0, 2), ("d", 0.5, 0.6, 1.1, 0.5, 0), ("e", 0.4, 0.9, 0.1, 0.0, 0)]
    choose = lambda *r: selection.selected(runs(spark, *r), ["seed", "multiplier", "mode"], ["train", "validation"]).first()
    got = choose(*rows)
    assert (got.name, got.candidates, got.repeated, got.inputs, got.valid) == ("c", 5, 0, 1, True)
    assert not choose(rows[0]).valid
    twice = choose(*rows, ("f", 0.1, 0.1, 9.0, 1.0, 2), ("g", 0.1, 0.1, 9.0, 1.0, 2))
    assert twice.repeated == 1 and not twice.valid
    mixed = choose(*rows, ("f", 0.1, 0.1, 9.0, 1.0, 3, ("zero", "c", "t", "w")))
    assert mixed.inputs == 2 and not mixed.valid
    assert choose(("n", None, None, None, 1.0, 1), *rows).name == "c"
    assert selection.selected(runs(spark, *rows).limit(0), ["seed"], ["train"]).count() == 0


def test_pairs_of_an_ablation(spark):
    c, t = ("zero", "c", "t", "v"), ("exact", "c", "t", "v")
    rows = runs(spark, ("a", 0.5, 0.6, 1.0, 1.0, 1, c), ("b", 0.75, 0.6, 0.5, 1.0, 1, t), ("x", 0.5, 0.6, 1.0, 1.0, 2, c), ("y", 0.5, 0.6, 1.0, 1.0, 3, t), ("p", 0.1, 0.1, 1.0, 1.0, 4, c), ("q", 0.2, 0.1, 1.0, 1.0, 4, c), ("r", 0.3, 0.1, 1.0, 1.0, 4, t), ("n", 0.5, 0.5, 1.0, 1.0, None, c), ("m", 0.75, 0.5, 1.0, 1.0, None, t))
    got = selection.ablation_pairs(rows, ["seed", "config", "train"], "zero", "exact", ["track_top_1"]).collect()
    assert {tuple(r) for r in got} == {("a", "b", 0.25, None), ("x", None, None, "no treatment"), (None, "y", None, "no control"), ("p", "r", None, "several"), ("q", None, None, "several"), ("n", "m", 0.25, None)}
    assert selection.ablation_pairs(rows.limit(0), ["seed"], "zero", "exact", ["track_nll"]).count() == 0


def test_runs_that_cannot_be_compared(spark):
    base = ("zero", "c", "t", "v")
    rows = runs(
        spark, ("k", 0.5, 0.6, 1.0, 1.0, 1, base), ("ok", 0.5, 0.6, 1.0, 3.0, 8, base), ("ab", 0.5, 0.6, 1.0, 1.0, 1, ("exact", "c", "t", "v")), ("cfg", 0.5, 0.6, 1.0, 1.0, 1, ("zero", "d", "t", "v")), ("val", 0.5, 0.6, 1.0, 1.0, 1, ("zero", "c", "t", "w")),
        ("sd", 0.5, 0.6, 1.0, 1.0, 2, ("exact", "c", "u", "v")), ("md", 0.5, 0.6, 1.0, 1.0, 1, ("other", "c", "t", "v")), ("no", 0.5, 0.6, 1.0, 2.0, 1, ("exact", "c", "t", "v")),
    )
    got = {r.name: list(r.faults) for r in selection.comparison_faults(rows, "k", ["config"], "validation", "train", ("zero", "exact")).collect()}
    assert got == {"ok": [], "ab": [], "cfg": ["configuration"], "val": ["validation"], "sd": ["seed", "train"], "md": ["modes"], "no": ["multiplier"]}


MORE = {"track_top_5": 0.8, **{f"{s}_track_{m}": 0.5 for s in ("white", "black") for m in ("top_1", "top_3", "nll")}, **{f"{h}_{m}": 0.5 for h in ("trigger", "forced") for m in ("nll", "brier")}, "parameters": 0.5}
WORSE = [("track_top_5", 0.7, "top_5"), ("white_track_top_3", 0.4, "sides"), ("black_track_nll", 0.6, "sides"), ("black_track_top_1", None, "sides"), ("trigger_brier", 0.6, "auxiliary"), ("forced_nll", float("nan"), "auxiliary"), ("parameters", 0.4, "parameters")]


def test_blend_checks_fail_one_by_one(spark):
    failed = lambda a, b: {r.check for r in gates.reliability(table(spark, a, b), "c", "t", gates.BLEND).collect() if not r.ok}
    assert failed(GOOD | MORE, BETTER | MORE) == set()
    for metric, value, check in WORSE:
        assert failed(GOOD | MORE, BETTER | MORE | {metric: value}) == {check}, metric
    assert failed(GOOD, BETTER) == {"top_5", "sides", "auxiliary", "parameters"}


@pytest.mark.parametrize("delta, bound, failures", [(0.01, 0.1, set()), (0.01, 0.0, {"bound"}), (0.011, 0.1, {"agreement"}), (0.0005, 0.1, {"agreement", "gain"}), (None, 0.1, {"agreement", "gain"})])
def test_release_checks(spark, delta, bound, failures):
    deltas = spark.createDataFrame([(1, delta), (2, delta)], "game int, delta double")
    values = spark.createDataFrame([(0, -1.0), (1, bound), (2, 5.0)], "r int, value double")
    got = gates.release_checks(table(spark, GOOD | MORE, BETTER | MORE), "c", "t", deltas, values, 2)
    rows = got.collect()
    assert {r.check for r in rows if not r.ok} == failures and len(rows) == 18
    none = gates.release_checks(table(spark, GOOD | MORE, BETTER | MORE), "c", "t", deltas.limit(0), values.limit(0), 2)
    assert {r.check for r in none.collect() if not r.ok} == {"agreement", "gain", "bound"}


def test_treatments_are_promoted_retained_or_refused(spark):
    base = ("zero", "c", "t", "v")
    rows = runs(spark, ("c", 0.5, 0.7, 1.0, 1.0, 1, base), ("t", 0.51, 0.7, 1.0, 1.0, 2, base), ("u", 0.4, 0.7, 1.0, 1.0, 3, base))
    long = table(spark, GOOD, BETTER)
    decide = lambda r, x: selection.treatment_comparison(r, x, "c", ["config"], "validation", "train", ("zero", "exact")).first()
    got = decide(rows, long)
    assert (got.name, got.primary, got.failed, got.decision, got.incomparable) == ("t", True, "", "promote", 0)
    assert decide(rows, table(spark, GOOD, BETTER | {"ece": 0.06})).decision == "retain"
    refused = decide(rows.withColumn("config", F.when(F.col("name") == "u", "d").otherwise("c")), long)
    assert (refused.decision, refused.incomparable) == ("refused", 1)
