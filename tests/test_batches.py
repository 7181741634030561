"""Systems scored as matrices of a batch against their long forms, and results that larger tables showed to be wrong."""

import math
import os
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sequent.operators import batches, fusion, gates
from sequent.operators import comparators as k
from sequent.operators import metrics as m
from sequent.plans import q_more, q_sequences
from sequent.plans.adapters import distributions
from tests.test_comparators import CASES
from tests.test_oracles import LARGER


def test_track_sums_of_systems_are_those_of_their_scores(spark):
    schema = "game int, side string, step int, truth string, options array<struct<class_id: string, eliminated: boolean, prior: double, frequency: double, residuals: array<double>>>"
    rows = spark.createDataFrame([(r % 2, "white", r, t, o) for r, o in CASES.items() for t in "abz"], schema)
    views = {"all": ["a", "b", "c"], "two": ["a", "b"]}
    args = ("options", ["m1", "m2"], 0.8, F.lit(2.0))
    long = m.array_scores(k.viewed(k.systems(rows, *args), "o", views), "o", ["view", "system", "game", "side", "step"])
    by = ("view", "system", "side", "scorable")
    want = {tuple(r[x] for x in (*by, "game")): r for r in m.track_sums(long.withColumn("scorable", F.col("p_truth").isNotNull()), by).collect()}
    got = {tuple(r[x] for x in (*by, "game")): r for r in m.added_tracks(k.system_tracks(rows, *args, ["game", "side"], views), by).collect()}
    assert got.keys() == want.keys() and len(got) > 40
    for key, r in got.items():
        for c in ("n", "s_top_1", "n_top_1", "s_top_3", "s_top_5", "s_nll", "n_nll", "s_brier", *(f"gap_{b}" for b in range(15))):
            assert math.isclose(r[c] or 0.0, want[key][c] or 0.0, abs_tol=1e-12), (key, c)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
def test_a_mean_that_ends_in_a_5_is_rounded_up(spark):
    """On these tables the uniform system's top 3 is a tie of the rounding, which SQL decides by the order of its sum."""
    sizes = distributions(spark, LARGER).selectExpr("size(filter(o, x -> not x.eliminated)) AS n").groupBy("n").count().collect()
    exact = sum(min(Fraction(1), Fraction(3, r["n"])) * r["count"] for r in sizes) / sum(r["count"] for r in sizes)
    assert exact == Fraction("0.6003875")
    got = {r.system: r.top_3 for r in q_more.a_comparators(spark, LARGER).collect()}
    assert got["uniform"] == 0.600388


def test_ties_of_rounding_do_not_depend_on_last_bits(spark):
    rows = spark.createDataFrame([(x,) for x in (0.2984375, math.nextafter(0.2984375, 0), math.nextafter(0.2984375, 1), 0.2984374)], "p double")
    assert [r.p for r in q_sequences.settled(rows).collect()] == [0.298438] * 3 + [0.298437]


def test_what_is_close_to_a_tie_of_rounding_is_none(spark):
    """Probabilities of 60 times sf0.1 that are no ties: the first two are a step's 0.99999950000026 and 0.00000049999974."""
    rows = spark.createDataFrame([(x,) for x in (0.9999995000002623, 4.999997376504368e-07, 0.2984374999998, 0.2984375000002)], "p double")
    assert [r.p for r in q_sequences.settled(rows).collect()] == [1.0, 0.0, 0.298437, 0.298438]


def test_histories_are_whole(spark, tmp_path):
    rows = spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(1000 - id) AS ts", "id % 2 AS user_id", "concat('k', id % 3) AS event_type", "0.0D AS value", "'{\"k\":1}' AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.game, r.step): r.history for r in q_sequences.w_history_prefix(spark, str(tmp_path)).collect()}
    for game in (0, 1):
        kinds = [f"k{i % 3}" for i in range(39, -1, -1) if i % 2 == game]
        assert all(got[game, n + 1] == " ".join(kinds[:n]) for n in range(20))


def test_smoothing_and_row_scores_agree_with_the_long_forms(spark):
    rows = [(r, "a", [(c, gone, p, 1.5 * n) for n, (c, gone, p, *_) in enumerate(o)]) for r, o in CASES.items() if r != 3]  # all of row 3 are eliminated
    wide = spark.createDataFrame(rows, "step int, truth string, o array<struct<class_id: string, eliminated: boolean, p: double, residual: double>>")
    o = F.col("o")

    def each(values, codes, names):
        yield ("s",), fusion.hard_masked(values["p"], values["residual"], (codes >= 0) & ~values["eliminated"], 0.5, 0.1), None

    got = {r.step: r for r in batches.row_scores(wide, "o", {"p": o["p"], "residual": o["residual"], "eliminated": o["eliminated"]}, ["step"], "system string", each).collect()}
    long = wide.select("step", "truth", F.inline("o")).withColumnRenamed("p", "prior")
    for r in m.row_scores(fusion.hard_mask_fusion(long, ["step"], "prior", "residual", 0.5, 0.1), ["step"]).collect():
        for c in ("p_truth", "above", "tied", "confidence", "brier", "sum_error", "nll", "credit_1", "credit_3", "credit_5"):
            assert (got[r.step][c] is None) == (r[c] is None) and math.isclose(got[r.step][c] or 0, r[c] or 0, abs_tol=1e-12), (r.step, c)


def test_more_clusters_do_not_mean_more_copies_of_them(spark, monkeypatch):
    monkeypatch.setattr(gates, "BLOCK", 50)
    for n in (1_000, 6_400):
        pieces, sizes, step = gates._blocks(spark.range(n), "id", 10_000)
        assert len(sizes) * -(-10_000 // step) <= 2 * gates.PIECES


def test_members_in_columns_give_the_mean_of_members_in_rows(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, False, 0.25, False), (1, "b", 0.5, False, 0.75, True), (2, "a", 1.0, True, 0.0, True)], "step int, class_id string, p double, eliminated boolean, q double, gone boolean")
    long = rows.select("step", "class_id", "p", "eliminated").unionByName(rows.selectExpr("step", "class_id", "q AS p", "gone AS eliminated"))
    columns = ["step", "class_id", "p", "ok", "eliminated"]
    assert sorted(fusion.row_ensemble(rows, [("p", "eliminated"), ("q", "gone")]).select(columns).collect()) == sorted(fusion.ensemble_mean(long, ["step"]).select(columns).collect())
    assert "Exchange" not in fusion.row_ensemble(rows, [("p", "eliminated"), ("q", "gone")])._jdf.queryExecution().toString()
