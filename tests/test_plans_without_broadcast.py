"""Sides that grow with the input are never broadcast, however small Spark takes them for."""

import pytest
from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.operators import resample as rs
from trialweave.plans import QUERIES


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [n for n in ("BroadcastHashJoin", "BroadcastNestedLoopJoin") if n in plan]


@pytest.mark.parametrize("name", ["E5_speed_class", "G7_test_matrix", "D32_bootstrap_with_replacement"])
def test_queries_broadcast_no_groups(spark, name):
    assert not joins(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_one_row_without_keys_is_attached(spark):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    for how in ("left", "inner"):
        got = skew.attach(df, df.agg(F.max("v").alias("m")), [], how=how)
        assert sorted(map(tuple, got.collect())) == [(k, 2 * k, 8) for k in range(5)]
    none = df.where("id > 9").groupBy("v").agg(F.max("id").alias("m")).select("m")
    assert skew.attach(df, none, []).where("m is null").count() == 5 and skew.attach(df, none, [], how="inner").count() == 0


def test_drawn_sessions_are_joined_in_parts(spark):
    """Only the one-row count of subjects is broadcast; drawn subjects meet theirs in shuffled parts."""
    cells = spark.createDataFrame([(f"S{k % 7}", f"S{k % 7}_{k % 3}", 3 + k % 2, 5, k % 3, 4) for k in range(21)], "Name string, SessId string, o1 long, o long, c1 long, c long")
    d = rs._session_draws(spark, cells.dropDuplicates(["Name", "SessId"]), 40, "b")
    assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 40 * 7 * 3


def test_fit_shuffles_points_once_for_all_passes(spark):
    from trialweave.operators import compare as cm

    pts = spark.createDataFrame([(k, x / 4, 20, 0.1 + 0.8 / (1 + 2.718 ** (-x - k / 9))) for k in range(6) for x in range(-4, 5)], "key long, x double, n long, p double")
    fit = lambda passes: cm.grid_fit(pts, ["key"], "erf_psycho", (-1.0, 0.05, 0.0), (1.0, 3.0, 0.4), passes=passes)
    shuffles = [fit(k)._jdf.queryExecution().executedPlan().toString().count("Exchange") for k in (1, 10)]
    assert shuffles[0] == shuffles[1]
    x = [-6.0, -4.5, -0.46875, 0.0, 0.3, 1.0, 3.9, 4.1, 7.0]
    assert cm.erf_of(__import__("numpy").array(x)) == pytest.approx([__import__("math").erf(v) for v in x], abs=1e-15)
    rows = fit(10).withColumn("at", F.lit(0.25)).join(pts, "key")
    q = cm.psychometric("erf_psycho", F.col("x"), [F.col(c) for c in ("bias", "slope", "gamma")])
    again = rows.groupBy("key", "nll").agg((-F.sum(F.col("n") * (F.col("p") * F.ln(q) + (1 - F.col("p")) * F.ln(1 - q)))).alias("same")).collect()
    assert len(again) == 6 and all(r["nll"] == pytest.approx(r["same"]) for r in again)


def test_registered_bootstrap_draws_every_trial():
    """Its SQL draws a number for each resampled trial."""
    from trialweave.plans import ORACLES

    assert "unnest(range(0, n)) AS k" in ORACLES["G21_hierarchical_bootstrap"]
    assert "b1.k" not in ORACLES["G21_hierarchical_bootstrap"] and "b1.k" in ORACLES["G21_bootstrap_sign_p"]


def test_permuted_sessions_are_never_shuffled(spark):
    """Draws are added up where a subject's sessions lie; of an iteration only sums, and subjects of one region, are shuffled."""
    import re

    trials = spark.createDataFrame(
        [(f"S{s}", f"S{s}_{q}", ("MFC", "LFC")[q % 2 if s else 0], "Early", k % 2, (k + q + s) % 3 // 2) for s in range(6) for q in range(4) for k in range(9)],
        "Name string, SessId string, Region string, Phase string, OptoEnabled int, ChoiceCorrect int",
    )
    got = rs.max_statistic_permutation(spark, trials, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\([^)]*\biter#[^)]*\bName#", plan)
    rows = got.collect()
    assert {r["stat"] for r in rows} == {"MFC", "LFC", "crossregion"} and all(1 / 51 <= r["p_adjusted"] <= 1 for r in rows)


def test_trace_distribution_numbers_no_frames(spark):
    plan = QUERIES["F34_trace_distribution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "lineitem" in plan
