"""Smoothing and running extremes on blocks of frames, count draws, and ordered prefix sums, against plain loops and NumPy."""

import time

import numpy as np
import pytest

from trialweave.functions import draws
from trialweave.operators import traces as tr
from trialweave.operators import windows


@pytest.mark.parametrize(("back", "ahead"), [(0, 0), (1, 0), (0, 2), (3, 2), (30, 29), (200, 199)])
def test_running_extremes(back, ahead):
    rng = np.random.default_rng(back)
    for n in (1, 2, 5, 6, 7, 100, 233):
        x = rng.normal(size=n)
        x[rng.random(n) < 0.3] = np.nan
        for of, plain in ((np.minimum, np.nanmin), (np.maximum, np.nanmax)):
            parts = [x[max(0, i - back) : i + ahead + 1] for i in range(n)]
            want = [np.nan if np.isnan(w).all() else plain(w) for w in parts]
            np.testing.assert_array_equal(tr.running_extreme(x, back, ahead, of), want)


def test_smoothing_keeps_missing_values_and_totals():
    w = np.array(tr.gaussian_kernel(2.0))
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    x[[0, 7, 8, 30]] = np.nan
    r = len(w) // 2
    for i, got in enumerate(tr.smoothed(x, w)):
        near = [(w[d + r], x[i + d]) for d in range(-r, r + 1) if 0 <= i + d < len(x) and not np.isnan(x[i + d])]
        want = np.nan if np.isnan(x[i]) else sum(a * b for a, b in near) + (1 - sum(a for a, _ in near)) * x[i]
        assert got == pytest.approx(want, nan_ok=True)


def test_blocks_of_any_size_give_the_same_trace(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, k, None if rng.random() < 0.1 else float(rng.normal())) for s in "ab" for t in (1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "ShortName string, trace_id long, frame long, v double").repartition(4)
    got = [sorted(tuple(r) for r in tr.gaussian(df, tr.TRACE, "frame", 2, size=size).select("ShortName", "trace_id", "frame", "smooth").collect()) for size in (40, 4096)]
    for a, b in zip(*got, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
    assert sum(r[3] is None for r in got[0]) == sum(r[3] is None for r in rows)


def test_baseline_of_a_long_trace_at_thirty_frames_a_second(spark):
    rng = np.random.default_rng(3)
    n = 200_000
    v = 5 + np.sin(np.arange(n) / 20_000) + rng.normal(size=n) * 0.2
    df = spark.createDataFrame([("s", 1, k, float(x)) for k, x in enumerate(v)], "ShortName string, trace_id long, frame long, v double")
    df.count()
    began = time.time()
    got = tr.baseline(df, fps=30.0).first()
    assert time.time() - began < 60
    back, ahead = 900, 899
    floor = np.round(tr.running_extreme(tr.running_extreme(tr.smoothed(v, np.array(tr.gaussian_kernel(10.0))), back, ahead, np.minimum), back, ahead, np.maximum), 9)
    width = (floor.max() - floor.min()) / 200
    bins = np.minimum(np.floor((floor - floor.min()) / width), 199).astype(int)
    want = floor.min() + (np.bincount(bins, minlength=200).argmax() + 0.5) * width
    assert got["baseline"] == pytest.approx(want, abs=1e-6) and got["n_frames"] == n


def test_binomial_law():
    u = (np.arange(200_000) + 0.5) / 200_000
    for n, a, b in ((1, 1, 2), (18, 7, 18), (400, 399, 400), (1000, 1, 900), (5_000_000, 3, 10)):
        k = draws.binomial_quantiles(*(np.full(len(u), x) for x in (n, a, b)), u)
        p = a / b
        assert k.min() >= 0 and k.max() <= n and (np.diff(k) >= 0).all()
        assert k.mean() == pytest.approx(n * p, rel=1e-3, abs=1e-3) and k.var() == pytest.approx(n * p * (1 - p), rel=0.01, abs=1e-3)
    assert len(draws.binomial_table(5_000_000, 3, 10)[1]) < 30_000
    edge = draws.binomial_quantiles(*(np.array(x) for x in ([0, 0, 5, 5, 3], [0, 2, 0, 5, 1], [0, 4, 5, 5, 2])), np.array([0.9, 0.5, 0.999, 0.0, 0.0]))
    assert edge.tolist() == [0, 0, 0, 5, 0]


def test_arm_counts_follow_the_trials(spark):
    """Mean and deviation of the counts of a session are those of its trials drawn again."""
    d = spark.range(40_000).selectExpr("id", "12L o", "9L o1", "20L c", "4L c1")
    got = d.select(draws.arm_counts("o", "o1", "c", "c1", *draws.units(3, d["id"])).alias("k")).select("k.*").toPandas()
    trials = np.array([(1, 1)] * 9 + [(1, 0)] * 3 + [(0, 1)] * 4 + [(0, 0)] * 16)
    pick = trials[np.random.default_rng(5).integers(0, 32, size=(40_000, 32))]
    want = {"o": pick[:, :, 0].sum(1), "o1": (pick[:, :, 0] * pick[:, :, 1]).sum(1), "c1": ((1 - pick[:, :, 0]) * pick[:, :, 1]).sum(1)}
    for name, x in want.items():
        assert got[name].mean() == pytest.approx(x.mean(), abs=0.08) and got[name].std() == pytest.approx(x.std(), rel=0.04)
    assert np.corrcoef(got["o"], got["o1"])[0, 1] == pytest.approx(np.corrcoef(want["o"], want["o1"])[0, 1], abs=0.03)


def test_prefix_sum_over_names_with_a_long_common_beginning(spark):
    rows = [(f"a_common_beginning_{k:05d}", k % 3, k % 7) for k in range(3000)] + [(None, 0, 5), ("ä", None, 2)]
    df = spark.createDataFrame(rows, "Name string, SessionNum long, n long").repartition(5)
    got = windows.ordered_prefix_sum(df, ["Name", "SessionNum"], "n", "before", ranges=16)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    total = 0
    found = {(r["Name"], r["SessionNum"]): r["before"] for r in got.collect()}
    for name, number, n in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0)):
        assert found[name, number] == total
        total += n


def test_classes_of_all_signatures(spark):
    from pyspark.sql import functions as F

    from trialweave.operators import tuning

    scopes = [("none", "none"), ("PrevChoiceLeft", "0"), ("PrevChoiceLeft", "1")]
    rows = [("s", k, "r", "c", p, v, bool(k >> i & 1)) for k in range(8) for i, (p, v) in enumerate(scopes)]
    rows += [("s", 8, "r", "c", "none", "none", True), ("s", 8, "r", "c", "PrevChoiceLeft", "null", True), ("s", 1, "r", "c", "PrevChoiceCorrect", "0", True)]
    df = spark.createDataFrame(rows, "ShortName string, trace_id long, BrainRegion string, data_col string, prior_col string, prior_val string, sig boolean")
    got = tuning.prior_signatures(df, F.col("sig"), "PrevChoiceLeft").withColumn("class", tuning.prior_class(F.col("signature"))).collect()
    want = ["not_significant", "only_no_prior", "one_prior_only", "one_prior_and_no_prior", "one_prior_only", "one_prior_and_no_prior", "both_priors_only", "both_priors_and_no_prior", None]
    assert {r["trace_id"]: r["class"] for r in got} == dict(enumerate(want))


def test_paired_tests_corrected_over_the_bins(spark):
    from trialweave.operators import stats

    rng = np.random.default_rng(11)
    rows = [(b, float(rng.normal() + b / 3), float(rng.normal())) for b in range(4) for _ in range(12)] + [(4, 1.0, 0.0), (5, 1.0, None), (6, 2.0, 1.0), (6, 3.0, 2.0)]
    got = {r["bin"]: r for r in stats.paired_tests(spark.createDataFrame(rows, "bin long, fast double, slow double"), [], "bin", "fast", "slow").collect()}
    assert set(got) == {0, 1, 2, 3, 4, 6} and got[4]["p"] is None and got[4]["p_holm"] is None and got[6]["p"] is None
    p = {}
    for b in range(4):
        d = np.array([x - y for k, x, y in rows if k == b])
        t = d.mean() / (d.std(ddof=1) / np.sqrt(len(d)))
        # two-sided Student tail with 11 degrees of freedom, by the trapezoidal rule
        x = np.linspace(0, abs(t), 200_001)
        p[b] = got[b]["p"]
        assert got[b]["n_pairs"] == 12 and got[b]["t_stat"] == pytest.approx(t) and 0 < p[b] <= 1
        c = 1 / (2 * np.trapezoid((1 + np.linspace(0, 400, 2_000_001) ** 2 / 11) ** -6, dx=400 / 2_000_000))
        assert p[b] == pytest.approx(1 - 2 * c * np.trapezoid((1 + x * x / 11) ** -6, x), abs=1e-6)
    run, want = 0.0, {}
    for k, b in enumerate(sorted(p, key=p.get)):
        run = max(run, min(1.0, (4 - k) * p[b]))
        want[b] = run
    assert {b: got[b]["p_holm"] for b in want} == pytest.approx(want)


def test_smoothing_leaves_holes_between_positions(spark):
    """A position without a row is a missing value: its neighbours do not move together."""
    w = np.array(tr.gaussian_kernel(1.0))
    held = {0: 1.0, 1: 4.0, 4: -2.0, 5: None, 9: 3.0, 23: 7.0}
    df = spark.createDataFrame([("a", k, v) for k, v in held.items()], "key string, pos long, v double")
    for size in (8, 4096):
        got = {r["pos"]: r["smooth"] for r in tr.gaussian(df, ["key"], "pos", 1.0, size=size).collect()}
        for p, v in held.items():
            near = [(w[q - p + 4], x) for q, x in held.items() if x is not None and abs(q - p) <= 4]
            want = None if v is None else sum(k * x for k, x in near) + (1 - sum(k for k, _ in near)) * v
            assert got[p] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_blocks_of_many_traces_are_not_sent_one_by_one(spark):
    """Transients of long, short, gapped and all-high traces equal a plain loop at any block size, and no group is a batch of its own."""
    import numpy as np

    rng = np.random.default_rng(5)
    data = {f"t{k}": rng.random(n).round(2) if k else np.ones(n) for k, n in enumerate((300, 3, 40, 211, 64, 5))}
    df = spark.createDataFrame([("S", t, f, float(x) if (f + len(v)) % 13 else None) for t, v in data.items() for f, x in enumerate(v)], "ShortName string, trace_id string, frame long, v double")
    stats = spark.createDataFrame([("S", t, 0.45, 0.02, len(v)) for t, v in data.items()], "ShortName string, trace_id string, baseline double, zscore double, n_frames long")

    def want(v):
        v = [x if (f + len(v)) % 13 else None for f, x in enumerate(v)]
        n, run = 0, 0
        for i in range(len(v) + 1):
            five = [x for x in v[i : i + 5] if x is not None] if i + 5 <= len(v) else []
            if five and sum(five) / len(five) >= 0.45 + 3 * 0.02:
                run += 1
            else:
                n, run = n + (run > 0 and run + 1 >= 4), 0
        return n

    for size in (7, 16, 4096):
        out = tr.transient_rate(df, stats, 1.0, 4.0, size=size)
        assert {r["trace_id"]: r["n_transients"] for r in out.collect()} == {t: want(v) for t, v in data.items()}
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (out, tr.baseline(df, fps=1.0))]
    assert all("FlatMapGroups" not in p and "MapInArrow" in p for p in plans)
