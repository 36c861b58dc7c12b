"""Sizes, ties and missing values that plain samples do not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import tails
from trialweave.operators import stats as st
from trialweave.operators import tracking as tk
from trialweave.operators import traces as tr
from trialweave.operators import tuning as tu
from trialweave.operators import windows as wn
from trialweave.operators.compare import erf


def test_exact_rank_tail_at_any_size():
    got = tails.mann_whitney_p([0.0, 0.0, 3.0], [2, 1, 3], [10001, 20001, 4], [0, 0, 0])
    assert got[0] == pytest.approx(2 / math.comb(10003, 2)) and got[1] == pytest.approx(2 / 20002)
    ways = [sum(1 for c in __import__("itertools").combinations(range(7), 3) if sum(c) - 3 <= u) for u in range(13)]
    assert got[2] == pytest.approx(min(1.0, 2 * ways[3] / 35))
    normal = tails.mann_whitney_p([0.0], [2], [10001], [0], method="normal")
    assert normal[0] > 0.01


@pytest.mark.parametrize("df", [1e4, 1e5, 1e6, 1e8, 1e9])
def test_tails_at_large_degrees_of_freedom(df):
    a = df / 2
    assert tails.gamma_tail([a], [a])[0] == pytest.approx(0.5 - 1 / (3 * math.sqrt(2 * math.pi * a)), abs=1e-4)
    x = a + 2 * math.sqrt(a)
    assert tails.gamma_tail([a], [x])[0] == pytest.approx(0.02275, abs=0.003)
    assert tails.beta_inc([a], [a], [0.5])[0] == pytest.approx(0.5, abs=1e-3)
    assert tails.beta_inc([5 * a], [a], [5 / 6])[0] == pytest.approx(0.5, abs=0.01)


def test_small_tails_still_hold():
    assert tails.gamma_tail([1.0, 0.5], [2.0, 1.920729])[0] == pytest.approx(math.exp(-2))
    assert tails.gamma_tail([0.5], [1.920729])[0] == pytest.approx(0.05, abs=1e-6)
    assert tails.beta_inc([5.0], [0.5], [10 / (10 + 2.228139**2)])[0] == pytest.approx(0.05, abs=1e-6)


def test_error_function_is_precise(spark):
    x = [-6.0, -4.5, -2.0, -0.46875, -0.1, 0.0, 0.3, 0.469, 1.0, 3.9, 4.1, 7.0]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", erf(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r["y"] == pytest.approx(math.erf(r["x"]), abs=4e-16, rel=1e-15)


def test_rank_statistics_of_millions_of_ties(spark):
    df = spark.range(6_000_000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 < 9, 1.0).otherwise(2.0).alias("v"))
    r = st.rank_test(df, ["k"], "v", F.col("g") == 0).first()
    assert r["n_left"] == 2_000_000 and abs(r["auc"] - 0.5) < 0.01 and r["ties"] > 1e20
    k = st.kruskal(st.rank_sums(df, ["k"], "g", "v"), ["k"]).first()
    assert 0 <= k["h_stat"] < 50 and k["df"] == 2
    assert st.dunn(st.rank_sums(df, ["k"], "g", "v"), ["k"], "g").count() == 3


def test_corrections_with_ties_and_missing(spark):
    rng = np.random.default_rng(1)
    p = [0.01] * 900 + list(rng.random(90)) + [None] * 10
    df = spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(p)], "f int, i int, p double")
    both = st.benjamini_hochberg(st.holm(df, ["f"], "p", ["i"]), ["f"], "p", ["i"]).collect()
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    m, holm, bh, top, low = len(known), {}, {}, 0.0, 1.0
    for rank, (v, i) in enumerate(known):
        top = max(top, (m - rank) * v)
        holm[i] = min(1.0, top)
    for rank, (v, i) in reversed(list(enumerate(known))):
        low = min(low, v * m / (rank + 1))
        bh[i] = min(1.0, low)
    assert len(both) == 1000
    for r in both:
        assert (r["p_holm"], r["p_bh"]) == (pytest.approx(holm[r["i"]]), pytest.approx(bh[r["i"]])) if r["p"] is not None else r["p_holm"] is None


def test_resize_beside_missing_samples(spark):
    rows = [(1, k, v) for k, v in enumerate([10.0, None, 10.0, 10.0])]
    got = {r["pos"]: r["v"] for r in tr.resize(spark.createDataFrame(rows, "k int, pos long, v double"), ["k"], F.lit(2)).collect()}
    assert got == {0: None, 1: 10.0}


def test_nearest_time_in_one_dense_block(spark):
    n = 200_000
    left = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * 10 + 3).alias("t"))
    right = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * 10).alias("t"))
    out = tk.nearest_time(left, right, ["k"], "t")
    assert out.count() == n and out.filter("left_id <> right_id or time_diff <> -3").count() == 0


def test_interpolation_in_one_block(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("p"), F.when(F.col("id") % 100 == 0, F.col("id") * 2.0).alias("v"))
    got = tk.interpolate(df, ["k"], "p", ["v"]).filter("p <= 3900").filter("abs(v - 2 * p) > 1e-9").count()
    assert got == 0


def test_first_component_of_whole_slices(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6))
    rows = [("s", 1, t, k, float(x[t, k])) for t in range(40) for k in range(6)]
    df = spark.createDataFrame(rows, "ShortName string, trace_id long, TrialNumber long, pos long, v double")
    got = {r["TrialNumber"]: (r["score"], r["explained"]) for r in tu.first_component(df).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    w = vt[0] * np.sign(vt[0][np.argmax(np.abs(vt[0]))])
    np.testing.assert_allclose([got[t][0] for t in range(40)], z @ w, atol=1e-8)
    assert got[0][1] == pytest.approx(s[0] ** 2 / (s**2).sum())


@pytest.mark.parametrize("rate", [0.5, 0.001])
def test_replay_keeps_all_of_the_past(spark, rate):
    rng = np.random.default_rng(4)
    n = 3000
    reward, applies = rng.random(n) < 0.3, rng.random(n) < 0.6
    df = spark.createDataFrame([("a", int(i), float(reward[i]), bool(applies[i])) for i in range(n)], "k string, p long, o double, a boolean")
    out = wn.replay_average(df, ["k"], "p", F.col("o"), F.col("a"), rate, 0.9, "x", size=16).orderBy("p").collect()
    x = 0.9
    for r in out:
        assert r["x"] == pytest.approx(x, rel=1e-9, abs=1e-12)
        x = x + rate * (r["o"] - x) if r["a"] else x


def test_maps_are_composed_over_levels(spark):
    rows = [("a", k, 0.5 + 0.4 * (k % 3) / 2, float(k % 5)) for k in range(60)] + [("b", 7, 0.25, 1.0)]
    df = spark.createDataFrame(rows, "k string, __blk long, __fa double, __fb double")
    got = {(r["k"], r["__blk"]): r["__c"] for r in wn.affine_starts(df, ["k"], 2.0, fan=3).collect()}
    x = 2.0
    for _, b, fa, fb in rows[:60]:
        assert got["a", b] == pytest.approx(x)
        x = fa * x + fb
    assert got["b", 7] == 2.0 and len(got) == 61


def test_result_sink_has_no_folder_per_subject(spark, tmp_path):
    from trialweave.sources import tables as tb

    df = spark.range(3000).selectExpr("concat('S', id % 1000) as Name", "id as n")
    tb.write_results(df, f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("folder=*/*.parquet"))) == tb.RESULT_FOLDERS
    back = tb.read_results(spark, f"file://{tmp_path}/out", "Name STRING, n BIGINT")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    one = tb.read_results(spark, f"file://{tmp_path}/out", "Name STRING, n BIGINT", only="S7")
    assert sorted(r["n"] for r in one.collect()) == [7, 1007, 2007] and len(one.inputFiles()) >= 1
    assert "folder" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
