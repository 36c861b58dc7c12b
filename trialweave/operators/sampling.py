"""Trials aligned around one epoch: kept trials, speed classes, warped time, concatenated parts.

Everything about time is worked out on epoch rows (a few per trial). A warp is a table of frames and weights, joined to the frames once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.operators import behavior as bh
from trialweave.operators import composites as cp
from trialweave.operators import traces as tr
from trialweave.operators import windows as wn

TRIAL = ["ShortName", "TrialNumber"]
TRACE = ["ShortName", "trace_id"]
FEEDBACK = "Feedback Start"


def kept_trials(epochs: DataFrame, decision: str = "remove", ceiling: float | None = None) -> DataFrame:
    """Epochs of trials with a choice and a stimulus time (at most ``ceiling`` seconds).

    ``remove`` keeps trials that move to a lateral port without a decision time, ``keep`` those with a decision time.
    """
    if decision not in ("remove", "keep"):
        raise ValueError(f"decision must be 'remove' or 'keep', not {decision!r}")
    decides, moves = (F.bool_or(F.col("epoch") == e) for e in ("Decision Time", "Movement to Lateral Port"))
    out = epochs if ceiling is None else epochs.filter(F.col("calcStimulusTime") <= ceiling)
    out = bh.keep_groups(out, TRIAL, decides if decision == "keep" else ~decides & moves)
    return out.filter("calcStimulusTime is not null and ChoiceCorrect is not null")


def with_classes(epochs: DataFrame, epoch: str, parts: int, sep_above: float | None = None) -> DataFrame:
    """Give all epochs of a trial its speed class within session and difficulty as ``class_label``.

    Times over ``sep_above`` form a class of their own. Trials of groups with fewer than ``parts`` trials have no class and go.
    """
    one = epochs.filter(F.col("epoch") == epoch).select(*TRIAL, "DVstr", "calcStimulusTime")
    q = wn.speed_class(one, ["ShortName", "DVstr"], "calcStimulusTime", "TrialNumber", parts, cut_above=sep_above)
    label = F.col("quantile_idx").cast("string") if sep_above is None else F.col("quantile_label")
    q = q.select(*TRIAL, label.alias("class_label")).filter("class_label is not null")
    return skew.attach(epochs, q, TRIAL, how="inner", salts=1)


def with_widths(parts: DataFrame, group: Sequence[str], resized: DataFrame) -> DataFrame:
    """Median width (halves to even) of the ``resized`` rows of each group as ``width``; groups without such rows keep their own widths."""
    n = resized.withColumn("__w", F.col("trace_end_idx") - F.col("trace_start_idx") + 1)
    m = skew.exact_percentiles(n, group, "__w", {"__m": 0.5}).select(*group, F.bround("__m").cast("long").alias("width"))
    return skew.attach(parts, m, group, salt_on=TRIAL)


def concat_parts(parts: DataFrame) -> DataFrame:
    """Places of a trial's parts behind each other, at the widths they are resized to (a trial has few parts)."""
    w = Window.partitionBy(*TRIAL).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("trace_end_idx") - F.col("trace_start_idx") + 1
    n = F.coalesce(F.col("width"), own)
    start = F.coalesce(F.sum(n).over(w), F.lit(0).cast("long"))
    return parts.withColumn("range_start", start).withColumn("range_end", F.col("range_start") + n - 1)


def warp(parts: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames of ``parts`` resized to ``width`` samples (null: as they are), placed from ``range_start`` on as ``pos``.

    Each sample lies between two frames and takes them by distance; one that needs a missing value is missing.
    """
    n = F.col("trace_end_idx") - F.col("trace_start_idx") + 1
    w = F.coalesce(F.col("width"), n)
    t = parts.select(*keys, "range_start", "trace_start_idx", n.alias("__n"), w.alias("__w"), F.explode(F.sequence(F.lit(0).cast("long"), w - 1)).alias("__i"))
    x = F.greatest(F.lit(0.0), F.least((F.col("__i") + 0.5) * F.col("__n") / F.col("__w") - 0.5, F.col("__n") - F.lit(1.0)))
    t = t.withColumn("__x", x)
    lo = F.floor("__x").cast("long")
    share = F.col("__x") - lo
    points = F.filter(tr.rows_of(("d", "w"), (lo, 1 - share), (lo + 1, share)), lambda p: p["w"] > 0)
    t = t.withColumn("__p", points)
    t = t.select(
        *keys, (F.col("range_start") + F.col("__i")).alias("pos"), F.size("__p").alias("__k"), F.col("trace_start_idx").alias("__s"), F.explode("__p").alias("__q")
    )
    t = t.select(*keys, "pos", "__k", (F.col("__s") + F.col("__q.d")).alias("frame"), F.col("__q.w").alias("__share"))
    j = t.join(frames.select(*TRACE, "frame", "v"), ["ShortName", "frame"])
    by = [k for k in dict.fromkeys([*keys, "trace_id", "pos"])]
    full = F.count("v") == F.max("__k")
    return j.groupBy(*by).agg(F.when(full, F.sum(F.col("__share") * F.col("v"))).alias("v"))


def sampling_plan(
    epochs: DataFrame,
    before: float,
    after: float,
    *,
    epoch: str = "Sampling",
    warped: bool = False,
    classes: int | None = None,
    sep_above: float | None = None,
    ceiling: float | None = None,
    decision: str = "remove",
    concat: bool = True,
) -> DataFrame:
    """Parts before, during and after ``epoch`` per kept trial, with ``class_label``, ``width`` and their places.

    ``warped`` resizes the middle part to the median width of its class over all sessions. Without ``classes`` every trial is in class
    ``All``. Without ``concat`` each part starts at place 0.
    """
    if sep_above is not None and classes is None:
        raise ValueError("sep_above needs classes")
    if None not in (sep_above, ceiling) and ceiling <= sep_above:
        raise ValueError("trials over the ceiling go, so it must be above sep_above")
    kept = kept_trials(epochs, decision, ceiling)
    kept = kept.withColumn("class_label", F.lit("All")) if classes is None else with_classes(kept, epoch, classes, sep_above)
    parts = cp.sampling_parts(kept, epoch, before, after).filter("trace_start_idx <= trace_end_idx")
    if warped:
        parts = with_widths(parts, ["class_label", "part"], parts.filter("part = 2"))
    else:
        parts = parts.withColumn("width", F.lit(None).cast("long"))
    placed = concat_parts(parts)
    return placed if concat else placed.withColumns({"range_end": F.col("range_end") - F.col("range_start"), "range_start": F.lit(0).cast("long")})


def align(plan: DataFrame, frames: DataFrame, normalize: Callable | None = None, scope: str = "trace") -> DataFrame:
    """Aligned values per trial, part, trace and ``pos``.

    ``normalize(frames, keys)`` sees whole session traces (``scope='trace'``) or only the aligned values of a trace (``'parts'``).
    """
    if scope not in ("trace", "parts"):
        raise ValueError(f"scope must be 'trace' or 'parts', not {scope!r}")
    if normalize and scope == "trace":
        frames = normalize(frames, TRACE)
    out = warp(plan, frames, [*TRIAL, "class_label", "part"])
    return normalize(out, TRACE) if normalize and scope == "parts" else out


def normalized_epochs(epochs: DataFrame, split: Sequence[str], align_feedback: float | None = None, limit_end: bool = False) -> DataFrame:
    """Every epoch resized to its median width within ``split``, as parts for ``warp``.

    With ``align_feedback`` the first feedback epoch becomes ``Feedback Start`` and is cut to that many seconds from its start instead;
    ``limit_end`` first stretches it over reward or punishment in sessions that wait, keeps the cut inside it, and resizes it too.
    """
    own_end = F.col("trace_end_idx")
    feedback = F.col("epoch") == FEEDBACK
    if align_feedback:
        epochs = bh.rename_feedback(epochs, ["ShortName"], F.col("epoch") == "Feedback Wait")
        if limit_end:
            epochs = bh.merge_feedback(epochs, TRIAL, F.col("acq_sampling_rate"))
        cut = F.col("trace_start_idx") + F.greatest(F.floor(align_feedback * F.col("acq_sampling_rate")) - 1, F.lit(0))
        epochs = epochs.withColumn("trace_end_idx", F.when(feedback, F.least(cut, own_end) if limit_end else cut).otherwise(own_end))
    resized = epochs if limit_end or not align_feedback else epochs.filter(~feedback)
    return with_widths(epochs, [*split, "epoch"], resized).withColumn("range_start", F.lit(0).cast("long"))
