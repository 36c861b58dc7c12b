"""Trace queries put together from the single operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.operators import traces as tr
from trialweave.operators import windows as wn

TRIAL = ["ShortName", "TrialNumber"]
TRACE = ["ShortName", "trace_id"]


def sampling_parts(epochs: DataFrame, epoch: str, before: float, after: float) -> DataFrame:
    """Before / during / after parts of an epoch whose neighbours last long enough (a trial holds few epochs)."""
    w = Window.partitionBy(*TRIAL).orderBy("state_id")
    e = epochs.withColumns(
        {
            "__bt": F.lag("epoch_time").over(w),
            "__at": F.lead("epoch_time").over(w),
            "__ns": F.lead("trace_start_idx").over(w),
        }
    )
    e = e.filter((F.col("epoch") == epoch) & (F.col("__bt") >= before) & (F.col("__at") >= after))
    fps, s = F.col("acq_sampling_rate"), F.col("trace_start_idx")
    first = F.greatest(F.lit(0).cast("long"), s - F.floor(before * fps))
    last = F.col("__ns") + F.greatest(F.floor(after * fps) - 1, F.lit(0))
    parts = tr.rows_of(
        ("part", "a", "z"),
        (F.lit(1).cast("long"), first, s - 1),
        (F.lit(2).cast("long"), s, F.col("trace_end_idx")),
        (F.lit(3).cast("long"), F.col("__ns"), last),
    )
    e = e.withColumn("__p", F.explode(parts))
    e = e.withColumns({"part": F.col("__p.part"), "trace_start_idx": F.col("__p.a"), "trace_end_idx": F.col("__p.z")})
    return e.drop("__p", "__bt", "__at", "__ns")


def align_sampling(epochs: DataFrame, frames: DataFrame, before: float, after: float) -> DataFrame:
    """Mean normalised trace around the sampling epoch per trace and speed class."""
    z = tr.z_score(frames, TRACE)
    parts = sampling_parts(epochs, "Sampling", before, after).drop("label")
    j = tr.slice_join(parts, z).withColumn("pos", F.col("frame") - F.col("trace_start_idx"))
    return tr.average(j, ["trace_id", "ShortName", "quantile_idx", "part"])


def limit_by_group(cut: DataFrame, group: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Cut every row of a group to the group's median length (rounded down)."""
    n = cut.groupBy(*group, *row).agg((F.max("pos") + 1).alias("n"))
    m = skew.exact_percentiles(n, group, "n", {"__m": 0.5})
    return skew.attach(cut, m, group).filter(F.col("pos") < F.floor("__m")).drop("__m")


def align_by_group(cut: DataFrame, session: Sequence[str], group: Sequence[str], row: Sequence[str], at_start: bool = False) -> DataFrame:
    """Cut every row of a group to the group's median length, then pad all rows of a session with empty values to its longest."""
    keys = [*session, *group, *row]
    short = limit_by_group(cut, [*session, *group], row)
    lengths = short.groupBy(*keys).agg((F.max("pos") + 1).alias("__n"))
    longest = lengths.groupBy(*session).agg(F.max("__n").alias("__max"))
    pads = lengths.join(longest, list(session)).filter("__n < __max")
    place = F.sequence(F.lit(0).cast("long"), F.col("__max") - F.col("__n") - 1)
    pads = pads.withColumn("__i", F.explode(place))
    empty = pads.select(*keys, (F.col("__i") if at_start else F.col("__n") + F.col("__i")).alias("pos"))
    traces = short.select(*keys, *[c for c in TRACE if c not in keys]).distinct()
    moved = short.join(lengths, keys).join(longest, list(session))
    shift = F.col("__max") - F.col("__n") if at_start else F.lit(0)
    moved = moved.withColumn("pos", F.col("pos") + shift).select(*keys, *[c for c in TRACE if c not in keys], "pos", "v")
    return moved.unionByName(empty.join(traces, keys).withColumn("v", F.lit(None).cast("double")))


def _ordered(df: DataFrame) -> DataFrame:
    order = tr.order_by_peak(df, ["ShortName"], "pos").select(*TRACE, "sort_pos")
    return skew.attach(df, order, TRACE, how="inner", salts=1)


def difference_map(cut: DataFrame) -> DataFrame:
    """Left minus right average per trace, percentile-scaled and ordered by peak."""
    side = [F.avg(F.when(F.col("ChoiceLeft") == s, F.col("v"))) for s in (1, 0)]
    d = cut.groupBy(*TRACE, "pos").agg(F.round(side[0] - side[1], 9).alias("v")).filter("v is not null")
    return _ordered(tr.percentile_scale(d, TRACE, 1, 99))


def heatmap(cut: DataFrame) -> DataFrame:
    """Average trace scaled to its own range and ordered by peak."""
    m = cut.groupBy(*TRACE, "pos").agg(F.round(F.avg("v"), 9).alias("v"))
    return _ordered(tr.min_max_scale(m, TRACE))


def activity_by_history(cut: DataFrame, epochs: DataFrame) -> DataFrame:
    """Pooled mean, SEM, mean of maxima and trials per trace, current outcome and length of the outcome streak before it.

    Every streak length of either sign is kept; trials without a streak before them are left out.
    """
    t = epochs.select(*TRIAL, "ChoiceCorrect").distinct().withColumns(
        {
            "ChoiceLeft": F.lit(None).cast("int"),
            "LeftRewarded": F.lit(None).cast("boolean"),
            "DV": F.lit(None).cast("double"),
            "calcStimulusTime": F.lit(None).cast("double"),
        }
    )
    s = wn.outcome_streaks(t, ["ShortName"], lags=2)
    h = s.filter("PrevOutcomeCount <> 0").select(*TRIAL, F.col("PrevOutcomeCount").alias("streak"))
    top = cut.groupBy(*TRIAL, "trace_id").agg(F.max("v").alias("mx"))
    j = cut.join(h, TRIAL).join(top, [*TRIAL, "trace_id"])
    return j.groupBy(*TRACE, "ChoiceCorrect", "streak").agg(
        F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"), F.avg("mx").alias("mean_max"),
        F.count_distinct("TrialNumber").alias("n_trials"),
    )


def side_preference(cut: DataFrame) -> DataFrame:
    """Trials → neurons → sides → sessions, a mean at each level; SEM over sessions."""
    n = cut.groupBy("ShortName", "ChoiceLeft", "trace_id", "pos").agg(F.avg("v").alias("m"))
    s = n.groupBy("ShortName", "ChoiceLeft", "pos").agg(F.avg("m").alias("m"))
    b = s.groupBy("ShortName", "pos").agg(F.avg("m").alias("m"))
    return b.groupBy("pos").agg(
        F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"), F.count(F.lit(1)).alias("n_sessions")
    )


def side_area(cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area between the mean left and mean right trace."""
    side = {n: F.avg(F.when(F.col("ChoiceLeft") == s, F.col("v"))) for n, s in (("l", 1), ("r", 0))}
    m = cut.groupBy(*keys, "pos").agg(*[c.alias(n) for n, c in side.items()])
    return m.groupBy(*keys).agg(F.sum(F.abs(F.col("l") - F.col("r"))).alias("area"))


def preferred_side_activity(cut: DataFrame, group: Sequence[str], preferred: DataFrame, at: str = "after") -> DataFrame:
    """Mean activity of neurons in trials of their preferred side: trials → neurons → sides → sessions → group.

    Trials are padded with empty values to the longest of their group behind (``after``) or in front (``before``). ``preferred`` holds one
    ``prefers_left`` per trace; other traces are left out. A side has no value where one of its neurons has none, and there is no SEM where
    a session has no value. A position that no session reaches has an empty mean.
    """
    if at not in ("after", "before"):
        raise ValueError(f"at must be 'after' or 'before', not {at!r}")
    group = list(group)
    if at == "before":
        n = cut.groupBy(*group, *TRIAL).agg((F.max("pos") + 1).alias("__n"))
        longest = n.groupBy(*group).agg(F.max("__n").alias("__max"))
        shift = skew.attach(n, longest, group).select(*group, *TRIAL, (F.col("__max") - F.col("__n")).alias("__shift"))
        cut = skew.attach(cut, shift, [*group, *TRIAL]).withColumn("pos", F.col("pos") + F.col("__shift")).drop("__shift")
    own = skew.attach(cut, preferred.select(*TRACE, "prefers_left"), TRACE, how="inner", salts=1)
    own = own.filter((F.col("ChoiceLeft") == 1) == F.col("prefers_left"))
    side = [*group, "ShortName", "ChoiceLeft"]
    neurons = own.groupBy(*side, "trace_id", "pos").agg(F.avg("v").alias("m"))
    used = neurons.select(*side, "trace_id").distinct().groupBy(*side).agg(F.count(F.lit(1)).alias("__k"))
    sides = skew.attach(neurons.groupBy(*side, "pos").agg(F.avg("m").alias("m"), F.count("m").alias("__got")), used, side)
    sessions = sides.groupBy(*group, "ShortName", "pos").agg(F.avg(F.when(F.col("__got") == F.col("__k"), F.col("m"))).alias("m"))
    sizes = used.groupBy(*group).agg(F.count_distinct("ShortName").alias("n_sessions"), F.sum("__k").alias("n_traces"))
    out = sessions.groupBy(*group, "pos").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("__d"), F.count("m").alias("__c"))
    out = skew.attach(out, sizes, group)
    sem = F.when(F.col("__c") == F.col("n_sessions"), F.col("__d") / F.sqrt(F.col("__c")))
    return out.withColumn("sem", sem).drop("__d", "__c")


def side_area_counts(cut: DataFrame, part: str, significant: DataFrame, active: DataFrame) -> DataFrame:
    """Areas of significant traces per session and ``part``, with how many traces there are, are active, significant, and both.

    ``significant`` holds traces, ``active`` traces per ``part``. A part without a significant trace has one row without trace and area.
    """
    traces = cut.select(*TRACE).distinct()
    sig = significant.select(*TRACE).distinct().join(traces, TRACE, "left_semi")
    act = active.select(*TRACE, part).distinct().join(traces, TRACE, "left_semi")
    keys = ["ShortName", part]
    per = traces.groupBy("ShortName").agg(F.count(F.lit(1)).alias("n_all"))
    chosen = sig.groupBy("ShortName").agg(F.count(F.lit(1)).alias("n_significant"))
    flagged = act.join(sig.withColumn("__sig", F.lit(True)), TRACE, "left")
    counts = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_active"), F.count("__sig").alias("n_active_significant"))
    cells = cut.select(*keys).distinct().join(per, "ShortName").join(chosen, "ShortName", "left").join(counts, keys, "left")
    cells = cells.na.fill(0, ["n_significant", "n_active", "n_active_significant"])
    area = side_area(cut.join(sig, TRACE, "left_semi"), [*TRACE, part])
    area = area.join(act.withColumn("is_active", F.lit(True)), [*TRACE, part], "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))
    return cells.join(area, keys, "left")


def session_mean_traces(cut: DataFrame, keys: Sequence[str], session: str = "ShortName") -> DataFrame:
    """Mean trace per ``keys``: a mean per session first, then mean, SEM and number over sessions."""
    one = cut.groupBy(session, *keys, "pos").agg(F.avg("v").alias("m"))
    return one.groupBy(*keys, "pos").agg(
        F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"), F.count("m").alias("n_sessions")
    )


def expand_trials(cut: DataFrame, carried: Sequence[str] = (), raw: bool = False, only: DataFrame | None = None) -> DataFrame:
    """One row per trial and trace with a choice and a stimulus time: mean activity (missing values left out), the session's percentage of
    correct trials and, with ``raw``, its frames in order. ``only`` restricts the traces. Empty frames stay in ``raw`` as nulls."""
    known = cut.filter("ChoiceCorrect is not null and calcStimulusTime is not null")
    trials = known.select(*TRIAL, "ChoiceCorrect").distinct()
    perf = trials.groupBy("ShortName").agg((100 * F.avg("ChoiceCorrect")).alias("performance"))
    if only is not None:
        known = tr.keep_only(known, only, TRACE)
    frames = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])
    aggs = [F.avg("v").alias("mean_activity"), *([frames.alias("raw")] if raw else [])]
    rows = known.groupBy(*TRIAL, "trace_id", *carried).agg(*aggs)
    return skew.attach(rows, perf, ["ShortName"])


def copy_order(dst: DataFrame, order: DataFrame, match: Sequence[str] = ("ShortName",), only: DataFrame | None = None) -> DataFrame:
    """Give ``dst`` the ``sort_pos`` of the same trace in ``order``, in sessions alike in ``match``; traces without one, or not in ``only``, go."""
    keys = [*match, "trace_id"]
    if only is not None:
        dst = dst.join(only.select("trace_id").distinct(), "trace_id", "left_semi")
    return skew.attach(dst, order.select(*keys, "sort_pos"), keys, how="inner", salts=1)


def heatmaps_in_order(cut: DataFrame, by: str, source, shared: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Average trace per condition ``by``, scaled to its own or (``shared``) the trace's range over all conditions, in the peak order that
    the traces have in condition ``source``."""
    m = cut.groupBy(by, *TRACE, "pos").agg(F.round(F.avg("v"), 9).alias("v"))
    order = tr.order_by_peak(m.filter(F.col(by) == source), ["ShortName"], "pos")
    return copy_order(tr.min_max_scale(m, TRACE if shared else [by, *TRACE]), order, only=only)
