"""Preferred-side activity, area counts, mean and raw traces, and copied orders against plain loops."""

import numpy as np
import pandas as pd
import pytest

from trialweave.operators import composites as cp


def _cut(spark, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("A", "B"):
        for t in range(6):
            for trace in range(4):
                for pos in range(2 + (t + (s == "B")) % 3):
                    v = None if rng.random() < 0.05 else float(rng.normal())
                    rows.append(("g", s, t, trace, t % 2, pos, v))
    pdf = pd.DataFrame(rows, columns=["grp", "ShortName", "TrialNumber", "trace_id", "ChoiceLeft", "pos", "v"])
    df = spark.createDataFrame(rows, "grp string, ShortName string, TrialNumber long, trace_id long, ChoiceLeft long, pos long, v double")
    return pdf, df


def _brute(pdf, prefers, at):
    longest = pdf.pos.max() + 1
    sessions = []
    for s, ds in pdf.groupby("ShortName"):
        sides = []
        for left in (True, False):
            neurons = []
            for trace in sorted(t for (n, t), p in prefers.items() if n == s and p == left):
                rows = []
                for _, d in ds[(ds.trace_id == trace) & (ds.ChoiceLeft == left)].groupby("TrialNumber"):
                    x = d.sort_values("pos").v.astype(float).to_numpy()
                    pad = np.full(longest - len(x), np.nan)
                    rows.append(np.concatenate([x, pad] if at == "after" else [pad, x]))
                if rows:
                    neurons.append(pd.DataFrame(rows).mean().to_numpy())
            if neurons:
                sides.append(np.mean(neurons, axis=0))
        if sides:
            sessions.append(pd.DataFrame(sides).mean().to_numpy())
    m = np.array(sessions)
    return pd.DataFrame(m).mean().to_numpy(), m.std(axis=0, ddof=1) / np.sqrt(len(m))


@pytest.mark.parametrize("at", ["after", "before"])
def test_preferred_side_equals_a_loop(spark, at):
    pdf, df = _cut(spark)
    prefers = {("A", 0): True, ("A", 1): False, ("A", 3): True, ("B", 0): False, ("B", 2): False}
    pref = spark.createDataFrame([(s, t, p) for (s, t), p in prefers.items()], "ShortName string, trace_id long, prefers_left boolean")
    got = cp.preferred_side_activity(df, ["grp"], pref, at).orderBy("pos").toPandas()
    mean, sem = _brute(pdf, prefers, at)
    assert list(got.pos) == list(range(len(mean))) and set(got.n_sessions) == {2} and set(got.n_traces) == {5}
    assert np.allclose(got["mean"].astype(float), mean, equal_nan=True) and np.allclose(got["sem"].astype(float), sem, equal_nan=True)
    assert cp.preferred_side_activity(df, ["grp"], pref.limit(0), at).count() == 0
    with pytest.raises(ValueError):
        cp.preferred_side_activity(df, ["grp"], pref, "middle")


def test_area_counts_hold_empty_parts(spark):
    rows = [(s, t, trace, t % 2, q, 0, float(trace + t % 2)) for s in ("A", "B") for t in range(4) for trace in range(3) for q in (1, 2)]
    df = spark.createDataFrame(rows, "ShortName string, TrialNumber long, trace_id long, ChoiceLeft long, q long, pos long, v double")
    sig = spark.createDataFrame([("A", 0), ("A", 1), ("A", 1), ("C", 9)], "ShortName string, trace_id long")
    act = spark.createDataFrame([("A", 0, 1), ("A", 2, 1), ("B", 1, 2), ("C", 9, 1)], "ShortName string, trace_id long, q long")
    got = {(r.ShortName, r.q, r.trace_id): (r.area, r.is_active, r.n_all, r.n_significant, r.n_active, r.n_active_significant)
           for r in cp.side_area_counts(df, "q", sig, act).collect()}
    assert got == {
        ("A", 1, 0): (1.0, True, 3, 2, 2, 1), ("A", 1, 1): (1.0, False, 3, 2, 2, 1),
        ("A", 2, 0): (1.0, False, 3, 2, 0, 0), ("A", 2, 1): (1.0, False, 3, 2, 0, 0),
        ("B", 1, None): (None, None, 3, 0, 0, 0), ("B", 2, None): (None, None, 3, 0, 1, 0),
    }


def test_expanded_trials_keep_missing_frames(spark):
    rows = [("A", 1, 7, 0, 1.0, 1, 0.5), ("A", 1, 7, 1, None, 1, 0.5), ("A", 1, 7, 2, 4.0, 1, 0.5), ("A", 2, 7, 0, 3.0, 0, 0.5), ("A", 3, 7, 0, 9.0, None, 0.5), ("A", 4, 7, 0, 9.0, 1, None)]
    df = spark.createDataFrame(rows, "ShortName string, TrialNumber long, trace_id long, pos long, v double, ChoiceCorrect long, calcStimulusTime double")
    got = {r.TrialNumber: (r.mean_activity, r.performance, r.raw) for r in cp.expand_trials(df, raw=True).collect()}
    assert got == {1: (2.5, 50.0, [1.0, None, 4.0]), 2: (3.0, 50.0, [3.0])}
    assert "raw" not in cp.expand_trials(df).columns
    none = spark.createDataFrame([], "ShortName string, trace_id long")
    assert cp.expand_trials(df, only=none).count() == 0


def test_mean_traces_weigh_sessions_alike(spark):
    rows = [("A", "x", 0, 1.0), ("A", "x", 0, 3.0), ("A", "x", 0, 5.0), ("B", "x", 0, 7.0), ("B", "x", 1, None)]
    df = spark.createDataFrame(rows, "ShortName string, k string, pos long, v double")
    got = {r.pos: (r.mean, r.sem, r.n_sessions) for r in cp.session_mean_traces(df, ["k"]).collect()}
    assert got == {0: (5.0, 2.0, 2), 1: (None, None, 0)}


def test_order_comes_from_the_other_condition(spark):
    v = {("a", 1): [0, 1, 5], ("a", 2): [9, 0, 1], ("b", 1): [2, 0, 0], ("b", 2): [0, 0, 3], ("b", 3): [0, 1, 0]}
    rows = [(c, "A", t, pos, float(x)) for (c, t), xs in v.items() for pos, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "c string, ShortName string, trace_id long, pos long, v double")
    got = cp.heatmaps_in_order(df, "c", "a").collect()
    assert {(r.c, r.trace_id): r.sort_pos for r in got} == {("a", 1): 2, ("a", 2): 1, ("b", 1): 2, ("b", 2): 1}
    assert max(r.v for r in got if r.c == "b") == 1.0
    shared = cp.heatmaps_in_order(df, "c", "a", shared=True, only=spark.createDataFrame([(2,)], "trace_id long")).collect()
    assert {r.trace_id for r in shared} == {2} and max(r.v for r in shared if r.c == "b") == round(3 / 9, 4)
