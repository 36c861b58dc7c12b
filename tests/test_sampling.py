"""Sampling alignment against plain loops: warped time, classes, filters, and rows that lack something."""

import numpy as np
import pytest

from trialweave.operators import sampling as sm
from trialweave.operators import traces as tr

SCHEMA = """ShortName string, TrialNumber long, epoch string, state_id long, trace_start_idx long, trace_end_idx long, epoch_time double,
    acq_sampling_rate double, DVstr string, calcStimulusTime double, ChoiceCorrect long"""


def _trial(session, n, widths, time, choice=1, names=("Pre-Trial Start", "Sampling", "Movement to Lateral Port"), start=0):
    rows, at = [], start
    for i, (name, w) in enumerate(zip(names, widths)):
        rows.append((session, n, name, i + 1, at, at + w - 1, w / 4.0, 4.0, "Easy", time, choice))
        at += w
    return rows


def _frames(spark, n=60, traces=(1, 2), holes=()):
    rng = np.random.default_rng(3)
    v = {t: rng.normal(size=n) for t in traces}
    rows = [("A", t, f, None if (t, f) in holes else float(v[t][f])) for t in traces for f in range(n)]
    return v, spark.createDataFrame(rows, "ShortName string, trace_id long, frame long, v double")


def _resized(x, width):
    at = np.clip((np.arange(width) + 0.5) * len(x) / width - 0.5, 0, len(x) - 1)
    return np.interp(at, np.arange(len(x)), x)


def _epochs(spark, *trials):
    return spark.createDataFrame([r for t in trials for r in t], SCHEMA)


def test_warped_parts_equal_interpolation(spark):
    widths = {1: 3, 2: 8, 3: 4}
    trials, at = [], 0
    for n, w in widths.items():
        trials.append(_trial("A", n, (2, w, 2), w / 4, start=at))
        at += w + 4
    v, frames = _frames(spark)
    plan = sm.sampling_plan(_epochs(spark, *trials), 0.25, 0.5, warped=True)
    got = {(r.TrialNumber, r.trace_id, r.pos): r.v for r in sm.align(plan, frames).collect()}
    want, at = {}, 0
    for n, w in widths.items():
        for t in (1, 2):
            x = v[t][at : at + w + 4]
            parts = np.concatenate([x[1:2], _resized(x[2 : 2 + w], 4), x[2 + w : 4 + w]])
            want.update({(n, t, i): y for i, y in enumerate(parts)})
        at += w + 4
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_trials_that_lack_something_go(spark):
    moves = ("Pre-Trial Start", "Sampling", "Movement to Lateral Port")
    e = _epochs(
        spark,
        _trial("A", 1, (2, 3, 2), 0.5),
        _trial("A", 2, (2, 3, 2), None),
        _trial("A", 3, (2, 3, 2), 0.5, choice=None),
        _trial("A", 4, (2, 3, 2), 9.0),
        _trial("A", 5, (2, 3, 1, 2), 0.5, names=("Pre-Trial Start", "Sampling", "Decision Time", "Movement to Lateral Port")),
        _trial("A", 6, (1, 3, 2), 0.5),
        _trial("A", 7, (2, 3), 0.5, names=moves[:2]),
        _trial("A", 8, (3, 2), 0.5, names=moves[1:]),
    )
    seen = lambda **kw: {r.TrialNumber for r in sm.sampling_plan(e, 0.5, 0.25, **kw).collect()}
    assert seen(ceiling=5.0) == {1}
    assert seen() == {1, 4}
    assert seen(decision="keep") == {5}


def test_classes_and_their_own_widths(spark):
    e = _epochs(spark, *[_trial("A", n, (1, w, 1), t, start=10 * n) for n, (w, t) in enumerate([(2, 0.1), (4, 0.2), (6, 0.3), (9, 0.4), (5, 3.0)])])
    plan = sm.sampling_plan(e, 0.25, 0.25, warped=True, classes=2, sep_above=1.0)
    got = {r.TrialNumber: (r.class_label, r.width, r.range_start, r.range_end) for r in plan.filter("part = 2").collect()}
    # Widths 2 and 4 have the median 3; 6 and 9 have 7.5, which goes to the even 8.
    assert got == {0: ("1", 3, 1, 3), 1: ("1", 3, 1, 3), 2: ("2", 8, 1, 8), 3: ("2", 8, 1, 8), 4: ("above_1.0s", 5, 1, 5)}
    apart = sm.sampling_plan(e, 0.25, 0.25, concat=False).filter("part = 3").collect()
    assert {(r.range_start, r.range_end) for r in apart} == {(0, 0)}
    few = sm.sampling_plan(e.filter("TrialNumber = 0"), 0.25, 0.25, classes=2)
    assert few.count() == 0


def test_a_sample_next_to_a_missing_value_is_missing(spark):
    e = _epochs(spark, _trial("A", 1, (2, 4, 2), 0.5), _trial("A", 2, (2, 2, 2), 0.5, start=10), _trial("A", 3, (2, 2, 2), 0.5, start=20))
    _, frames = _frames(spark, traces=(1,), holes={(1, 3)})
    plan = sm.sampling_plan(e, 0.25, 0.25, warped=True)
    got = {r.pos: r.v for r in sm.align(plan, frames).filter("TrialNumber = 1").collect()}
    assert got[1] is None and got[2] is not None and len(got) == 4


def test_normalising_sees_whole_traces_or_parts(spark):
    e = _epochs(spark, _trial("A", 1, (2, 4, 2), 0.5))
    v, frames = _frames(spark, traces=(1,))
    plan = sm.sampling_plan(e, 0.5, 0.5)
    x = v[1][:8]
    for scope, base in (("trace", v[1]), ("parts", x)):
        got = [r.v for r in sm.align(plan, frames, tr.z_score, scope).orderBy("pos").collect()]
        assert np.allclose(got, (x - base.mean()) / base.std())


def test_options_that_contradict(spark):
    e = _epochs(spark, _trial("A", 1, (2, 4, 2), 0.5))
    for kw in ({"sep_above": 1.0}, {"classes": 2, "sep_above": 2.0, "ceiling": 1.0}, {"decision": "other"}):
        with pytest.raises(ValueError):
            sm.sampling_plan(e, 0.25, 0.25, **kw)
    with pytest.raises(ValueError):
        sm.align(sm.sampling_plan(e, 0.25, 0.25), e, scope="none")


def test_feedback_is_merged_cut_and_resized(spark):
    names = ("Sampling", "Feedback Wait", "Reward")
    e = _epochs(spark, _trial("A", 1, (2, 1, 4), 0.5, names=names), _trial("A", 2, (4, 1, 1), 0.5, names=names, start=10), _trial("B", 1, (3, 3), 0.5, names=("Sampling", "Reward")))
    rows = lambda limit: {(r.ShortName, r.TrialNumber, r.epoch): (r.trace_start_idx, r.trace_end_idx, r.width)
                          for r in sm.normalized_epochs(e, ["ShortName"], 0.75, limit).collect()}
    assert rows(True) == {
        ("A", 1, "Sampling"): (0, 1, 3), ("A", 1, "Feedback Start"): (2, 4, 2),
        ("A", 2, "Sampling"): (10, 13, 3), ("A", 2, "Feedback Start"): (14, 15, 2),
        ("B", 1, "Sampling"): (0, 2, 3), ("B", 1, "Feedback Start"): (3, 5, 3),
    }
    loose = rows(False)
    assert loose["A", 1, "Reward"] == (3, 6, 2) and loose["A", 2, "Feedback Start"] == (14, 16, None)


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    _, frames = _frames(spark)
    plan = sm.sampling_plan(e, 0.25, 0.25, warped=True, classes=2)
    assert sm.align(plan, frames).count() == 0
    assert sm.normalized_epochs(e, ["ShortName"], 0.5, True).count() == 0
