"""Rows that are drawn or dealt many times are hashed where they lie; only what a border needs is shuffled."""

import hashlib

import numpy as np
import pyarrow as pa

from trialweave.functions import draws
from trialweave.operators import resample as rs


def u32(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_hashes_of_many_texts_are_md5():
    rng = np.random.default_rng(2)
    x, y = (10 ** rng.uniform(0, 18, 3000)).astype(np.int64), rng.integers(0, 2000, 3000)
    x[:3] = 0, 9, 10
    for parts in ((b"r3", x, y, b"MFC", b"Early"), (b"b" * 47, y), (b"q" * 70, x, y), (x,)):
        got = draws.hashes(4, 3000, *parts)
        for k in range(0, 3000, 17):
            text = b"|".join(p if isinstance(p, bytes) else str(p[k]).encode() for p in parts)
            want = hashlib.md5(text).hexdigest()
            assert [int(g[k]) for g in got] == [int(want[8 * j : 8 * j + 8], 16) for j in range(4)]


def auc(values, side):
    """Mid-ranks by counting, rows without a value left out."""
    v, left = np.array([x for x in values if x is not None]), np.array([s for x, s in zip(values, side, strict=True) if x is not None])
    rank = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    n1, n2 = left.sum(), (~left).sum()
    return (rank[left].sum() - n1 * (n1 + 1) / 2) / (n1 * n2) if n1 and n2 else None


def test_dealt_sides_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(("A", "B")[k % 5 == 0], int(10 ** rng.uniform(0, 6)) * 1000 + k, None if k % 23 == 0 else float(rng.integers(0, 40)), bool(k % 3 == 0)) for k in range(700)]
    d = spark.createDataFrame(rows, "g string, id long, v double, l boolean").repartition(5)
    got = {r["g"]: (r["observed"], r["p"]) for r in rs.auc_permutation(d, ["g"], "v", d["l"], "id", 120).collect()}
    for g in "AB":
        ids, v, side = (np.array([r[k] for r in rows if r[0] == g], dtype=object) for k in (1, 2, 3))
        seen = np.array([x is not None for x in v])
        observed, n_left, hit, n = auc(v, side.astype(bool)), int(side[seen].sum()), 0, 0
        for it in range(120):
            order = sorted(range(len(ids)), key=lambda k: (u32("auc", it, ids[k]), ids[k]))  # noqa: B023
            dealt = np.zeros(len(ids), bool)
            dealt[order[:n_left]] = True
            a = auc(v, dealt)
            n += a is not None
            hit += a is not None and abs(a - 0.5) >= abs(observed - 0.5) - 1e-12
        assert got[g] == (observed, (1 + hit) / (1 + n))


def test_only_rows_near_the_border_leave_their_task():
    n, its = 40_000, 4
    cols = {"g": ["A"] * n, "n_left": [n // 4] * n, "id": list(range(n)), "__name": [f"|{k}".encode() for k in range(n)], "mid_rank": [k / 2 for k in range(n)]}
    share, reach = 0.25, rs.DEVIATIONS * (0.25 * 0.75 / n) ** 0.5
    cols |= {"__lo": [int((share - reach) * 2**32)] * n, "__hi": [int((share + reach) * 2**32)] * n}
    out = pa.Table.from_batches(rs._dealt_again(["g"], "id", its)(iter(pa.table(cols).to_batches(7000)))).to_pylist()
    assert len(out) < its * n / 25
    for it in range(its):
        u = {k: u32("auc", it, k) for k in range(n)}
        below = sum(x < cols["__lo"][0] for x in u.values())
        mine = [r for r in out if r["iter"] == it]
        assert sum(r["n"] for r in mine if r["id"] is None) == below < n // 4 < sum(r["n"] for r in mine)
        assert all(u[r["id"]] == r["u"] and r["s"] == r["id"] / 2 for r in mine if r["id"] is not None)


def test_tabled_binomials_equal_the_quantiles():
    rng = np.random.default_rng(4)
    n = rng.integers(0, 60, 4000)
    a, b = rng.integers(0, 60, 4000), rng.integers(0, 60, 4000)
    u = rng.integers(0, 1 << 32, 4000)
    u[:200] = np.repeat([0, (1 << 32) - 1], 100)
    rows = rng.integers(0, 4000, 4000)
    want = draws.binomial_quantiles(n[rows], a[rows], b[rows], u / float(1 << 32))
    assert (draws.Binomials(n, a, b).draw(rows, u) == want).all()


def test_drawn_trimmed_means_equal_a_plain_loop(spark):
    """Continuous values with a fifth of them missing, and few distinct ones; one group is too small for zones."""
    rng = np.random.default_rng(6)
    rows = [("Early", "MFC", f"S{k}", None if k % 5 == 0 else float(rng.normal())) for k in range(4000)]
    rows += [("Late", "MFC", f"S{k}", float(rng.integers(-2, 3))) for k in range(3000)] + [("Late", "LFC", f"S{k}", float(k)) for k in range(7)]
    d = spark.createDataFrame(rows, "Phase string, Region string, SessId string, effect double")
    t = rs._drawn_trimmed_means(spark, d, ["Phase", "Region"], "effect", "SessId", 150, "r4")
    got = {(r["iter"], r["Phase"], r["Region"]): r["trimmed_mean"] for r in t.collect()}
    assert len(got) == 450
    for p, r in (("Early", "MFC"), ("Late", "MFC"), ("Late", "LFC")):
        v = [x[3] for x in sorted((x for x in rows if x[:2] == (p, r)), key=lambda x: (u32(x[2]), x[2]))]
        for it in range(0, 150, 37):
            mine = sorted(x for x in (v[u32("r4", it, p, r, k) % len(v)] for k in range(len(v))) if x is not None)
            cut = len(mine) // 5
            assert abs(got[it, p, r] - np.mean(mine[cut : len(mine) - cut])) < 1e-12


def test_drawn_sessions_are_worked_on_where_they_lie(spark):
    import re

    trials = spark.createDataFrame(
        [(f"S{s}", f"S{s}_{q}", ("MFC", "LFC")[q % 2], ("Early", "Late")[k % 2], k % 3 % 2, (k + q + s) % 3 // 2) for s in range(9) for q in range(4) for k in range(12)],
        "Name string, SessId string, Region string, Phase string, OptoEnabled int, ChoiceCorrect int",
    )
    got = rs.two_region_bootstrap(spark, trials, 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and not re.findall(r"hashpartitioning\([^)]*\b(slot|sess_slot)#", plan)
    assert {r["stat"] for r in got.collect()} == {"MFC", "LFC", "Delta"}


def test_trials_drawn_again_equal_a_plain_loop(monkeypatch):
    """Sessions of no trial to more than a thousand, also where they are cut into parts."""
    rng = np.random.default_rng(8)
    n = np.r_[0, 1, 9, 10, 11, 100, 101, 1234, rng.integers(0, 40, 60)]
    o = rng.integers(0, n + 1)
    o1, c = rng.integers(0, o + 1), n - o
    c1 = rng.integers(0, c + 1)
    places = rng.integers(0, 1000, len(n)), rng.integers(0, 100_000, len(n)), rng.integers(0, 12, len(n))
    want = []
    for k in range(len(n)):
        u = [u32("b3", *(p[k] for p in places), j) % n[k] for j in range(n[k])]
        want.append((sum(x < o[k] for x in u), sum(x < o1[k] for x in u), sum(o[k] <= x < o[k] + c1[k] for x in u)))
    for size in (draws.AT_ONCE, 64):
        monkeypatch.setattr(draws, "AT_ONCE", size)
        assert list(zip(*(x.tolist() for x in draws.trial_counts(b"b3", places, o, o1, c, c1)), strict=True)) == want


def test_drawn_trials_are_no_rows(spark):
    """Trials are drawn and counted in the task of their subject, with each trial and with counts."""
    trials = spark.createDataFrame([(f"S{s}", f"S{s}_{q}", k % 3 % 2, (k + q + s) % 3 // 2) for s in range(9) for q in range(4) for k in range(12)], "Name string, SessId string, OptoEnabled int, ChoiceCorrect int")
    for each in (True, False):
        got = rs.hierarchical_bootstrap(spark, trials, 20, each_trial=each)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "sess_slot#" not in plan
        assert got.count() == 20
