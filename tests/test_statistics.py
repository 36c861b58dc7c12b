"""Tail probabilities, rank tests, curves and the component reduction against known or brute-force values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.functions import tails
from trialweave.operators import compare as cm
from trialweave.operators import stats as st
from trialweave.operators import tuning as tu

# The four published test data sets (stimulus, trials, share) and their fits.
DATA = {
    "weibull50": (10 ** np.linspace(-4, -1, 8), 80, [0.5125, 0.35, 0.5625, 0.5375, 0.8875, 0.8875, 0.9125, 0.8625]),
    "weibull": (10 ** np.linspace(-4, -1, 8), 80, [0.125, 0.1125, 0.1375, 0.4, 0.8125, 0.9, 0.925, 0.875]),
    "erf_psycho_2gammas": (np.arange(-50, 50, 10.0), 40, [0.175, 0.225, 0.35, 0.275, 0.725, 0.9, 0.925, 0.975, 1.0, 1.0]),
    "erf_psycho": (np.arange(-50, 50, 10.0), 40, [0.1, 0.125, 0.25, 0.15, 0.6, 0.65, 0.75, 0.9, 0.9, 0.85]),
}
CURVES = {
    "weibull50": ((10**-2.5, 2.0, 0.1), [0.5003998, 0.50286841, 0.5201905, 0.62446761, 0.87264857, 0.9, 0.9, 0.9]),
    "weibull": ((10**-2.5, 2.0, 0.1), [0.1007996, 0.10573682, 0.14038101, 0.34893523, 0.84529714, 0.9, 0.9, 0.9]),
    "erf_psycho": (
        (-10.0, 20.0, 0.1),
        [0.10187109, 0.11355794, 0.16291968, 0.29180005, 0.5, 0.70819995, 0.83708032, 0.88644206, 0.89812891, 0.89983722],
    ),
    "erf_psycho_2gammas": (
        (-10.0, 20.0, 0.2, 0.0),
        [0.20187109, 0.21355794, 0.26291968, 0.39180005, 0.6, 0.80819995, 0.93708032, 0.98644206, 0.99812891, 0.99983722],
    ),
}
LIKELIHOOD = {"weibull50": -334.1149693, "weibull": -261.2351786, "erf_psycho": -193.0509031, "erf_psycho_2gammas": -147.0238002}


@pytest.mark.parametrize("model", CURVES)
def test_curve_values(spark, model):
    pars, want = CURVES[model]
    x = DATA[model][0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = df.select("i", cm.psychometric(model, F.col("x"), [F.lit(p) for p in pars]).alias("y")).orderBy("i").toPandas().y
    np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-6)


def test_curve_arguments(spark):
    with pytest.raises(ValueError):
        cm.psychometric("straight line", F.lit(0.25), [F.lit(0.5)] * 3)
    with pytest.raises(ValueError):
        cm.psychometric("weibull", F.lit(1.0), [F.lit(1.0)] * 2)


def test_likelihood_outside_bounds(spark):
    x, n, p = DATA["erf_psycho"]
    df = spark.createDataFrame([(float(a), float(n), float(b)) for a, b in zip(x, p)], "x double, n double, p double")
    pars = [F.lit(0.4), F.lit(12.5), F.lit(0.1)]
    nll = cm.neg_log_likelihood("erf_psycho", F.col("x"), F.col("n"), F.col("p"), pars, ((-0.3, 1, 0), (0.3, 8, 0.2)))
    assert df.agg(nll.alias("l")).collect()[0].l > 10000


@pytest.mark.parametrize("model", ["weibull", "weibull50", "erf_psycho", "erf_psycho_2gammas"])
def test_fit_reaches_published_likelihood(spark, model):
    x, n, p = DATA[model]
    df = spark.createDataFrame([("k", float(a), float(n), float(b)) for a, b in zip(x, p)], "k string, x double, n double, p double")
    lapse = [0.4] * (len(cm.MODELS[model]) - 2)
    lo = [float(x.min()) if "erf" in model else 1e-4, 0.01, *[0.0] * len(lapse)]
    hi = [float(x.max()) if "erf" in model else 0.02, 10.0, *lapse]
    best = cm.grid_fit(df, ["k"], model, lo, hi, steps=7, passes=8, shrink=0.5).collect()[0]
    assert best.nll == pytest.approx(-LIKELIHOOD[model], abs=0.02)


def test_tails_known_values():
    assert tails.normal_two_sided(np.array([1.959963984540054]))[0] == pytest.approx(0.05, abs=1e-9)
    # Student t with 10 degrees: t = 2.228138852 is the two-sided 5 % point
    assert tails.beta_inc(5, 0.5, 10 / (10 + 2.228138852**2)) == pytest.approx(0.05, abs=1e-7)
    # F(2, 10) = 4.102821 and chi-square(3) = 7.814728 are the 5 % points
    assert tails.beta_inc(5, 1, 10 / (10 + 2 * 4.102821)) == pytest.approx(0.05, abs=1e-6)
    assert tails.gamma_tail(1.5, 7.814727903 / 2) == pytest.approx(0.05, abs=1e-8)
    assert tails.gamma_tail(1.5, 0.1 / 2) == pytest.approx(0.991837, abs=1e-5)


def test_exact_rank_p_equals_enumeration():
    n1, n2 = 4, 5
    ranks = np.arange(1, n1 + n2 + 1)
    us = np.array([sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(ranks, n1)])
    for u in range(n1 * n2 + 1):
        big = max(u, n1 * n2 - u)
        want = min(1.0, 2 * (us >= big).mean())
        assert tails.mann_whitney_p([u], [n1], [n2], [0])[0] == pytest.approx(want)


def test_rank_test_with_ties(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": ["hot"] * 150 + ["b"] * 12, "v": rng.integers(-5, 6, 162) / 4, "s": rng.random(162) < 0.4})
    got = st.rank_test(spark.createDataFrame(pdf), ["k"], "v", F.col("s")).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        a, b = g.v[g.s].to_numpy(), g.v[~g.s].to_numpy()
        u = (a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()
        assert got.loc[k, "u"] == pytest.approx(u)
        assert got.loc[k, "auc"] == pytest.approx(u / (len(a) * len(b)))
        c = g.v.value_counts()
        assert got.loc[k, "ties"] == pytest.approx((c**3 - c).sum())


def test_holm_and_fdr(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.005])], "f string, i int, p double")
    holm = {r.i: r.p_holm for r in st.holm(df, ["f"], "p", ["i"]).collect()}
    assert holm[3] is None
    for i, w in {4: 0.02, 0: 0.03, 2: 0.06, 1: 0.06}.items():
        assert holm[i] == pytest.approx(w)
    ps = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.001, 0.02, 0.03, 0.5])], "f string, i int, p double")
    bh = {r.i: r.p_bh for r in st.benjamini_hochberg(ps, ["f"], "p", ["i"]).collect()}
    for i, w in enumerate([0.004, 0.04, 0.04, 0.5]):
        assert bh[i] == pytest.approx(w)


def test_anova_kruskal_dunn(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame([("x", s, c, float(rng.normal(c, 1))) for s in range(6) for c in range(3)], columns=["f", "s", "c", "v"])
    df = spark.createDataFrame(pdf)
    m = pdf.pivot(index="s", columns="c", values="v").to_numpy()
    gm = m.mean()
    ssc = 6 * ((m.mean(0) - gm) ** 2).sum()
    sse = ((m - m.mean(0) - m.mean(1, keepdims=True) + gm) ** 2).sum()
    got = st.repeated_anova(df, ["f"], "s", "c", "v").collect()[0]
    assert got.f_stat == pytest.approx((ssc / 2) / (sse / 10)) and (got.df1, got.df2) == (2, 10)
    one = st.one_way_anova(df, ["f"], "c", "v").collect()[0]
    assert one.f_stat == pytest.approx((ssc / 2) / (((m - m.mean(0)) ** 2).sum() / 15))
    r = st.rank_sums(df, ["f"], "c", "v")
    rk = pdf.v.rank()
    h = 12 / (18 * 19) * sum(rk[pdf.c == c].sum() ** 2 / 6 for c in range(3)) - 3 * 19
    assert st.kruskal(r, ["f"]).collect()[0].h_stat == pytest.approx(h)
    z = {(q.a, q.b): q.z for q in st.dunn(r, ["f"], "c").collect()}
    se = math.sqrt(18 * 19 / 12 * (1 / 6 + 1 / 6))
    assert z[0, 2] == pytest.approx((rk[pdf.c == 0].mean() - rk[pdf.c == 2].mean()) / se)


def test_first_component_equals_svd(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 4)) @ rng.normal(size=(4, 4))
    rows = [("n", 1, t, p, float(x[t, p])) for t in range(30) for p in range(4)]
    df = spark.createDataFrame(rows, "ShortName string, trace_id long, TrialNumber long, pos long, v double")
    got = tu.first_component(df).orderBy("TrialNumber").toPandas()
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    w = vt[0] * np.sign(vt[0][np.argmax(np.abs(vt[0]))])
    np.testing.assert_allclose(got.score, z @ w, atol=1e-8)
    assert got.explained[0] == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_hypergeometric_ranges_of_large_sessions(spark):
    """The table grows with the root of the size, and draws are those of the whole law."""
    from trialweave.operators import resample

    def below(k, n, r, o):
        """Probability of at most ``k``."""
        ln = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        return math.fsum(math.exp(ln(r, j) + ln(n - r, o - j) - ln(n, o)) for j in range(max(0, o - (n - r), k - 20_000), min(r, o, k) + 1))

    sizes = [(4_000_000, 2_000_000, 1_200_000), (4_000_000, 3_999_990, 1_300_000), (60, 20, 30), (10, 10, 4), (7, 0, 3)]
    u = [0.0, 2.0**-32, 1e-4, 0.25, 0.5, 0.7654321, 0.999, 1 - 2.0**-32]
    u = [int(x * 2**32) / 2**32 for x in u]
    d = spark.createDataFrame([(*s, x) for s in sizes for x in u], "n long, r long, o long, u double")
    assert resample.hypergeometric_table(d).count() < 30_000
    got = {(r["n"], r["r"], r["u"]): r["k"] for r in resample.hypergeometric_draws(d).collect()}
    assert len(got) == len(sizes) * len(u)
    for n, r, o in sizes:
        for x in u[2:7]:
            k = got[n, r, x]
            assert below(k - 1, n, r, o) <= x + 1e-6 and x - 1e-6 < below(k, n, r, o), (n, r, o, x)


def test_resampling_runs_a_thousand_iterations(spark):
    import inspect

    from trialweave.operators import resample
    from trialweave.plans import QUERIES

    for f in (resample.hierarchical_bootstrap, resample.two_region_bootstrap, resample.auc_permutation):
        assert inspect.signature(f).parameters["n_iter"].default == 10_000
    assert QUERIES["G21_hierarchical_bootstrap"](spark, "/root/testdata/sf0.001").count() == 1000


def test_percentiles_equal_sql_to_the_last_bit(spark, tmp_path):
    """Values are compared with percentiles, so the last bit decides on which side of an edge a trial falls."""
    import duckdb

    from trialweave.functions import skew

    rng = np.random.default_rng(3)
    k, v = rng.integers(0, 300, 9000), np.round(rng.random(9000) * 5, 4)
    spark.createDataFrame([(int(a), float(b)) for a, b in zip(k, v, strict=True)], "k long, v double").write.parquet(f"{tmp_path}/t")
    probs = {"a": 0.1, "b": 0.3, "c": 0.45, "d": 0.5, "e": 0.9}
    got = {r["k"]: list(r)[1:] for r in skew.exact_percentiles(spark.read.parquet(f"{tmp_path}/t"), ["k"], "v", probs).collect()}
    parts = ", ".join(f"quantile_cont(v, {p})" for p in probs.values())
    want = duckdb.connect().execute(f"SELECT k, {parts} FROM read_parquet('{tmp_path}/t/*.parquet') GROUP BY k").fetchall()
    assert got == {r[0]: list(r[1:]) for r in want} and len(got) == 300
