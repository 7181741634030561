"""Each gate family with a fixture that passes and one for every check that fails."""

import pytest
from pyspark.sql import functions as F

from sequent.operators import fusion, gates

GOOD = {"track_top_1": 0.5, "track_top_3": 0.7, "track_nll": 1.0, "track_brier": 0.4, "ece": 0.05, "horizon_5": 0.3, "horizon_10": 0.4, "class_a": 0.5, "class_b": 0.6, "trigger": 0.8, "forced": 0.9, "checked": 10.0, "masked": 10.0, "violations": 0.0, "max_eliminated": 0.0}
BETTER = GOOD | {"track_top_1": 0.51, "class_a": 0.4901}
BROKEN = [
    ({"track_top_1": 0.5, "track_top_3": 0.7, "track_nll": 1.0}, {"primary"}), ({"track_top_1": 0.4}, {"primary", "top_1"}), ({"track_top_3": 0.69}, {"top_3"}), ({"track_nll": 1.1}, {"nll"}), ({"track_brier": 0.41}, {"brier"}), ({"ece": 0.06}, {"calibration"}),
    ({"horizon_10": 0.39}, {"horizons"}), ({"horizon_10": None}, {"horizons"}), ({"trigger": 0.7}, {"trigger"}), ({"forced": float("nan")}, {"forced"}), ({"class_b": 0.58}, {"classes"}), ({"class_b": float("inf")}, {"classes"}),
    ({"violations": 1.0}, {"authority"}), ({"masked": 9.0}, {"authority"}), ({"max_eliminated": 1e-9}, {"authority"}), ({"checked": 0.0, "masked": 0.0}, {"authority"}), ({"track_nll": None}, {"primary", "nll"}),
]


def table(spark, a, b):
    rows = [(system, k, v) for system, own in (("c", a), ("t", b)) for k, v in own.items()]
    return spark.createDataFrame(rows, "system string, metric string, value double")


def test_reliability_checks_fail_one_by_one(spark):
    failed = lambda a, b: {r.check for r in gates.reliability(table(spark, a, b), "c", "t").collect() if not r.ok}
    assert failed(GOOD, BETTER) == set()
    for change, names in BROKEN:
        assert failed(GOOD, BETTER | change) == names, change
    assert failed({k: v for k, v in GOOD.items() if k != "class_b"}, BETTER) == {"classes"}
    without = {k: v for k, v in BETTER.items() if not k.startswith("horizon")}
    assert failed({k: v for k, v in GOOD.items() if not k.startswith("horizon")}, without) == {"horizons"}
    assert len(failed({}, {})) == 11


def claim_rows(spark, games, low=False):
    return spark.createDataFrame([(g, s, "ab"[g % 2], 0.0 if low and g == 3 else 0.5) for g in range(games) for s in ("white", "black")], "game int, side string, truth string, p double")


@pytest.mark.parametrize("games, claimed, low, failures", [(20, ["a", "b"], False, ""), (8, ["a"], False, "games,tracks"), (20, ["a", "z"], False, "unknown,tracks"), (20, ["b"], True, "zero truth"), (20, [], False, "")])
def test_claims(spark, games, claimed, low, failures):
    got = gates.claim(claim_rows(spark, games, low), "game", ["game", "side"], "truth", "p", claimed, ["a", "b"], 10, 10).first()
    assert got.failures == failures and got.satisfied == (not failures and bool(claimed))


def test_slices_add_up_or_are_incomplete(spark):
    rows = spark.createDataFrame([(k % 3, "ab"[k % 2], "xyz"[k % 3]) for k in range(30)], "agent int, side string, truth string")
    read = lambda df: gates.slices_complete(df, ["agent", "side", "truth"], "truth", 3).first()
    got = read(rows)
    assert (got.rows, got.by_agent, got.by_side, got.by_truth, got.classes, got.complete) == (30, 30, 30, 30, 3, True)
    assert not read(rows.where("truth <> 'z'")).complete
    assert not read(rows.withColumn("side", F.when(F.col("agent") > 0, F.col("side")))).complete
    assert not read(rows.limit(0)).complete


def test_coverage(spark):
    diagnostics = lambda e, v, p: spark.createDataFrame([(e, v, p)], "max_sum_error double, violations long, max_eliminated_p double")
    rows = spark.createDataFrame([(k, 1.0 if k % 5 else None) for k in range(20)], "k int, nll double")
    passed = lambda unscorable, *d: gates.coverage(rows, diagnostics(*d), unscorable).first().passed
    none = F.col("k") % 5 == 0
    assert passed(none, 1e-7, 0, 0.0) and not passed(F.lit(False), 1e-7, 0, 0.0)
    assert not passed(none, 1e-5, 0, 0.0) and not passed(none, 1e-7, 1, 0.1) and not passed(none, 1e-7, 0, 1e-9)


def test_absolute_bounds_and_missing_horizons(spark):
    report = [(s, m, v) for s in ("white", "black") for m, v in (("track_top_1", 0.2), ("track_top_3", 0.3), ("track_top_5", 0.4), ("row_nll", 4.0), ("row_brier", 0.9), ("ece", 0.05))]
    horizons = spark.createDataFrame([("white", h, 0.5, 0.6) for h in (5, 10, 15, 20)] + [("black", h, 0.05, 0.6) for h in (10, 20)], "group string, horizon int, top_1 double, top_3 double")
    got = {r.gate: r.status for r in gates.absolute(spark.createDataFrame(report, "side string, metric string, value double"), horizons).collect()}
    assert len(got) == 20 and {k: v for k, v in got.items() if v != "passed"} == {"black.horizon_15_top_1": "missing", "black.horizon_20_top_1": "failed"}


def test_calibration_gates(spark):
    names = [f"{g}_top_{k}" for g in ("row", "track") for k in (1, 3, 5)]
    before = {**dict.fromkeys(names, 0.5), "ece": 0.1, "row_nll": 1.0}
    frame = lambda x: spark.createDataFrame([("white", k, v) for k, v in x.items()], "side string, metric string, value double")
    failed = lambda change: {r.gate for r in gates.calibration_gates(frame(before), frame({k: v for k, v in (before | {"row_nll": 0.9, "ece": 0.1} | change).items() if v is not None})).collect() if not r.passed}
    assert failed({}) == set() and failed({"row_top_3": 0.5 + 1e-11}) == {"row_top_3"} and failed({"ece": 0.11}) == {"ece"} and failed({"row_nll": 1.0}) == {"row_nll"} and failed({"track_top_5": None}) == {"track_top_5"}


def test_calibration_is_accepted_by_the_mean_of_sides(spark):
    rows = [(k, "white" if k % 2 else "black", c, (3.0 if c == k % 3 else 0.0) + c / 7, k % 3 if k % 4 else (k + 1) % 3, c == 3) for k in range(24) for c in range(4)]
    logits = spark.createDataFrame(rows, "k int, side string, c int, logit double, truth int, eliminated boolean")
    good = {r.side: r for r in fusion.calibration(logits, "k", "side", {"white": 2.0, "black": 2.0}).collect()}
    assert all(r.accepted and r.regained == 0 for r in good.values())
    bad = fusion.calibration(logits, "k", "side", {"white": 1.0, "black": 0.1}).collect()
    assert not any(r.accepted or r.each_side for r in bad)
