"""Block-wise operators against plain loops, with blocks small enough to put seams everywhere."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.operators import tracking as tk
from trialweave.operators import traces as tr
from trialweave.operators import windows as wn


@pytest.fixture(scope="module")
def trials(spark):
    """One busy session holds most rows; trial numbers have holes."""
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("busy", 120), ("b", 17), ("c", 1)):
        number = np.cumsum(1 + (rng.random(n) < 0.08))
        for i in range(n):
            miss = rng.random() < 0.15
            rows.append(
                (name, int(number[i]), None if miss else int(rng.random() < 0.7), None if miss else int(rng.random() < 0.5),
                 bool(rng.random() < 0.5), float(rng.integers(-50, 50) / 50), float(rng.integers(1, 60) / 10))
            )
    cols = "Name string, TrialNumber long, ChoiceCorrect int, ChoiceLeft int, LeftRewarded boolean, DV double, calcStimulusTime double"
    return rows, spark.createDataFrame(rows, cols)


def loop_streaks(rows):
    def step(prev, v):
        if v is None:
            return 0
        if v:
            return prev + 1 if prev > 0 else 1
        return prev - 1 if prev < 0 else -1

    out, state, last = {}, None, None
    for name, number, correct, left, lr, *_ in rows:
        if last is None or last != (name, number - 1):
            state = [0, 0, 0]
        out[name, number] = tuple(state)
        state = [step(state[0], correct or 0), step(state[1], left), step(state[2], int(lr))]
        last = (name, number)
    return out


@pytest.mark.parametrize("size", [5, 8, 4096])
def test_streaks_equal_loop(trials, size):
    rows, df = trials
    got = wn.outcome_streaks(df, ["Name"], size=size).collect()
    want = loop_streaks(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.PrevOutcomeCount, r.PrevDirectionIsLeftCount, r.PrevLeftRewardedCount) == want[r.Name, r.TrialNumber]


def test_previous_times_stop_at_gaps(trials):
    rows, df = trials
    times = {(r[0], r[1]): r[6] for r in rows}
    numbers = {(r[0], r[1]) for r in rows}
    for r in wn.outcome_streaks(df, ["Name"], size=5).collect():
        for k in (1, 4):
            whole = all((r.Name, r.TrialNumber - j) in numbers for j in range(1, k + 1))
            got = r[f"PrevCalcStimulusTime{k}"]
            assert got == (times[r.Name, r.TrialNumber - k] if whole else None)


def test_number_rows_and_classes(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 500, p=[0.9, 0.06, 0.04]), "v": rng.integers(0, 40, 500) / 10, "i": range(500)})
    df = spark.createDataFrame(pdf)
    got = skew.number_rows(df, ["k"], [F.col("v"), F.col("i")], skew.value_block(F.col("v")), "rn", "n").toPandas()
    want = pdf.sort_values(["k", "v", "i"])
    want["rn"] = want.groupby("k").cumcount() + 1
    m = got.merge(want, on=["k", "v", "i"])
    assert len(m) == 500 and (m.rn_x == m.rn_y).all()
    assert (got.groupby("k").n.first() == pdf.groupby("k").size()).all()
    cls = wn.speed_class(df, ["k"], "v", "i").toPandas()
    sizes = cls.groupby(["k", "quantile_idx"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_exact_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 800, p=[0.97, 0.02, 0.01]), "v": np.round(rng.normal(0, 3, 800), 2)})
    probs = {"p1": 0.01, "med": 0.5, "p90": 0.9, "lo": 0.0, "hi": 1.0}
    got = skew.exact_percentiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for n, p in probs.items():
            assert got.loc[k, n] == pytest.approx(np.quantile(g.v, p))
    whole = skew.exact_percentiles(spark.createDataFrame(pdf), [], "v", {"m": 0.37}).collect()[0].m
    assert whole == pytest.approx(np.quantile(pdf.v, 0.37))


def test_value_block_never_decreases(spark):
    v = np.sort(np.concatenate([np.random.default_rng(2).normal(0, s, 300) for s in (1e-6, 1, 1e6)]))
    got = spark.createDataFrame(pd.DataFrame({"v": v})).select("v", skew.value_block(F.col("v")).alias("b")).toPandas().sort_values("v")
    assert (np.diff(got.b) >= 0).all()


def test_reward_rate_across_blocks(spark):
    out = [1, 0, None, 1, 1, 0, 1, 1, None, 0, 1, 1, 1, 0, 1, 1, 0, 1]
    df = spark.createDataFrame([("s", i + 1, o) for i, o in enumerate(out)], "k string, t long, c int")
    got = {r.t: r.rr for r in wn.reward_rate(df, ["k"], "t", {"rr": ("c", 3)}, size=4).collect()}
    filled = [o or 0 for o in out]
    for t in range(1, len(out) + 1):
        want = None if t <= 3 else sum(filled[t - 4 : t - 1]) / 3
        assert got[t] == (None if want is None else pytest.approx(want))


def test_replay_equals_recursion(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, float(rng.random() < 0.6), bool(rng.random() < (0.02 if k == "quiet" else 0.5))) for k, n in (("a", 200), ("quiet", 150)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "k string, t long, o double, use boolean")
    got = {(r.k, r.t): r.x for r in wn.replay_average(df, ["k"], "t", F.col("o"), F.col("use"), 0.3, 0.5, "x", size=8).collect()}
    state = {"a": 0.5, "quiet": 0.5}
    for k, t, o, use in rows:
        assert got[k, t] == pytest.approx(state[k], abs=1e-10)
        if use:
            state[k] += 0.3 * (o - state[k])


def np_gauss(x, sigma):
    w = np.array(tr.gaussian_kernel(sigma))
    r = len(w) // 2
    out = np.full(len(x), np.nan)
    for i in range(len(x)):
        if np.isnan(x[i]):
            continue
        j = np.arange(max(0, i - r), min(len(x), i + r + 1))
        ok = ~np.isnan(x[j])
        ww = w[j - i + r][ok]
        out[i] = (ww * x[j][ok]).sum() + (1 - ww.sum()) * x[i]
    return out


@pytest.mark.parametrize("size", [20, 4096])
def test_gaussian_keeps_missing_and_edges(spark, size):
    rng = np.random.default_rng(7)
    x = rng.normal(size=90)
    x[[3, 40, 41, 88]] = np.nan
    rows = [("n", 1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ShortName string, trace_id long, frame long, v double")
    got = tr.gaussian(df, tr.TRACE, "frame", 2.0, size=size).orderBy("frame").toPandas().smooth.to_numpy(dtype=float)
    np.testing.assert_allclose(got, np_gauss(x, 2.0), atol=1e-12)


def np_running(x, fn, back, ahead):
    return np.array([fn(x[max(0, i - back) : i + ahead + 1]) for i in range(len(x))])


@pytest.mark.parametrize("size", [150, 4096])
def test_baseline_and_transients(spark, size):
    rng = np.random.default_rng(11)
    n, fps = 400, 1.0
    x = np.round(20 + rng.normal(0, 1, n), 6)
    for s in (50, 180, 181, 300):
        x[s : s + 12] += 15
    df = spark.createDataFrame([("n", 1, i, float(v)) for i, v in enumerate(x)], "ShortName string, trace_id long, frame long, v double")
    st = tr.baseline(df, fps, sigma=3.0, window_sec=20.0, bins=50, size=size)
    floor = np_running(np_running(np_gauss(x, 3.0), np.min, 10, 9), np.max, 10, 9)
    cnt, edges = np.histogram(np.round(floor, 9), bins=50)
    k = cnt.argmax()
    base = (edges[k] + edges[k + 1]) / 2
    got = st.collect()[0]
    assert got.baseline == pytest.approx(base, abs=1e-6)
    low = x[x < base]
    noise = np.sqrt(2 / len(low) * ((low - base) ** 2).sum())
    assert got.zscore == pytest.approx(noise, abs=1e-6)
    rate = tr.transient_rate(df, st, fps, 4.0, size=max(size // 10, 7)).collect()[0]
    mv = np.convolve(x, np.ones(5), "valid") / 5
    idx = np.flatnonzero(mv >= base + 3 * noise)
    runs = [r for r in np.split(idx, np.flatnonzero(np.diff(idx) != 1) + 1) if len(r)]
    want = sum(len(r) + 1 >= 4 for r in runs)
    assert want > 0 and rate.n_transients == want
    assert rate.rate == pytest.approx(want / (n / 60))


def test_nearest_time_equals_brute_force(spark):
    rng = np.random.default_rng(13)
    left = [(k, i, int(t)) for k, n in (("hot", 80), ("b", 5)) for i, t in enumerate(rng.integers(0, 10000, n))]
    right = [(k, i, int(t)) for k, n in (("hot", 60), ("b", 1)) for i, t in enumerate(rng.choice(10000, n, replace=False))]
    schema = "k string, id long, t long"
    got = tk.nearest_time(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "t", offset=3, block=500).collect()
    assert len(got) == len(left)
    when = {(k, i): t for k, i, t in left}
    for r in got:
        t = when[r.k, r.left_id] + 3
        best = min(abs(x - t) for k, _, x in right if k == r.k)
        assert abs(r.time_diff) == best
        assert next(x for k, i, x in right if k == r.k and i == r.right_id) - t == r.time_diff


def test_interpolation_across_blocks(spark):
    x = [None, None, 2.0, None, None, None, None, None, 8.0, None, 1.0, None]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(x)], "File string, frame long, y double")
    got = [r.y for r in tk.interpolate(df, ["File"], "frame", ["y"], size=3).orderBy("frame").collect()]
    known = [i for i, v in enumerate(x) if v is not None]
    np.testing.assert_allclose(got, np.interp(range(len(x)), known, [x[i] for i in known]))


def test_array_round_trip(spark):
    df = spark.createDataFrame([("n", 1, i, None if i == 3 else float(i)) for i in range(10)], "ShortName string, trace_id long, frame long, v double")
    back = tr.to_frames(tr.to_arrays(df, 4), 4).orderBy("frame").collect()
    assert [(r.frame, r.v) for r in back] == [(i, None if i == 3 else float(i)) for i in range(10)]
