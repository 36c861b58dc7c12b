"""Sampling alignment with its options."""

from pyspark.sql import functions as F

from trialweave.operators import sampling as sm
from trialweave.operators import traces as tr
from trialweave.operators.behavior import r6
from trialweave.plans.registry import query
from trialweave.sources import fixtures as fx
from trialweave.sources.sql_views import q6

TRIAL = "ShortName, TrialNumber"
_Z = """(SELECT ShortName, trace_id, frame, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS v FROM frames
    WINDOW w AS (PARTITION BY ShortName, trace_id))"""


def _plan_sql(before, after, warped=False, classes=None, sep=None, ceiling=None, decision="remove"):
    """Parts ``r`` with their widths and places."""
    known = f"calcStimulusTime <= {ceiling}::DOUBLE" if ceiling else "true"
    decides = "bool_or(epoch = 'Decision Time')"
    rule = decides if decision == "keep" else f"NOT {decides} AND bool_or(epoch = 'Movement to Lateral Port')"
    over = f"calcStimulusTime > {sep}::DOUBLE" if sep else "false"
    label = "'All'"
    if classes:
        label = f"CASE WHEN over THEN 'above_{sep}s' WHEN size >= {classes} THEN CAST(nth AS VARCHAR) END"
    width = "width" if warped else "x.z - x.a + 1"
    return f"""k AS (SELECT * FROM sampling_epochs WHERE {known}),
    t AS (SELECT * FROM k JOIN (SELECT {TRIAL} FROM k GROUP BY ALL HAVING {rule}) ok USING ({TRIAL}) WHERE ChoiceCorrect IS NOT NULL AND calcStimulusTime IS NOT NULL),
    c AS (SELECT {TRIAL}, {label} AS class_label FROM (SELECT *, {over} AS over, count(*) OVER (PARTITION BY ShortName, DVstr, {over}) AS size,
        ntile({classes or 1}) OVER (PARTITION BY ShortName, DVstr, {over} ORDER BY calcStimulusTime, TrialNumber) AS nth FROM t WHERE epoch = 'Sampling') o),
    s AS (SELECT * FROM (SELECT *, lag(epoch_time) OVER w AS bt, lead(epoch_time) OVER w AS nt, lead(trace_start_idx) OVER w AS ns FROM t
        WINDOW w AS (PARTITION BY {TRIAL} ORDER BY state_id)) n JOIN c USING ({TRIAL})
      WHERE epoch = 'Sampling' AND bt >= {before} AND nt >= {after} AND class_label IS NOT NULL),
    m AS (SELECT class_label, CAST(round_even(median(trace_end_idx - trace_start_idx + 1), 0) AS BIGINT) AS width FROM s GROUP BY ALL),
    p AS (SELECT {TRIAL}, class_label, x.part::BIGINT AS part, x.a::BIGINT AS a, x.z::BIGINT AS z, CASE WHEN x.part = 2 THEN {width} ELSE x.z - x.a + 1 END AS w FROM
      (SELECT {TRIAL}, class_label, unnest([{{'part': 1, 'a': greatest(0, trace_start_idx - CAST(floor({before} * 4) AS BIGINT)), 'z': trace_start_idx - 1}},
        {{'part': 2, 'a': trace_start_idx, 'z': trace_end_idx}}, {{'part': 3, 'a': ns, 'z': ns + greatest(CAST(floor({after} * 4) AS BIGINT) - 1, 0)}}]) AS x
        FROM s) y JOIN m USING (class_label) WHERE x.a <= x.z),
    r AS (SELECT *, CAST(coalesce(sum(w) OVER (PARTITION BY {TRIAL} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS range_start FROM p)"""


def _warp_sql(src, keys, frames="frames"):
    """Samples of the parts ``src`` (a, z, w, range_start) from their two nearest frames."""
    return f"""SELECT t.{keys}, f.trace_id, range_start + i AS pos, f.v * (1 - (x - floor(x))) + g.v * (x - floor(x)) AS v
      FROM (SELECT *, greatest(0.0::DOUBLE, least((i + 0.5::DOUBLE) * (z - a + 1) / w - 0.5::DOUBLE, z - a)) AS x FROM (SELECT *, unnest(range(0, w)) AS i FROM {src}) u) t
      JOIN {frames} f ON f.ShortName = t.ShortName AND f.frame = a + floor(x)
      JOIN {frames} g ON g.ShortName = t.ShortName AND g.trace_id = f.trace_id AND g.frame = a + ceil(x)"""

_PARTS = f"{TRIAL}, class_label, part"


def _mean(df, keys):
    return df.groupBy(*keys).agg(r6(F.avg("v")).alias("mean"), F.count("*").alias("n_rows"))


_FULL = dict(warped=True, classes=2, sep_above=1.2, ceiling=1.6)


@query(
    "F27_sampling_concat",
    f"WITH {_plan_sql(0.25, 0.25, True, 2, 1.2, 1.6)} SELECT {_PARTS}, w AS width, range_start, range_start + w - 1 AS range_end FROM r",
)
def f27_concat(spark, sf):
    plan = sm.sampling_plan(fx.sampling_epochs(spark, sf), 0.25, 0.25, **_FULL)
    width = (F.col("range_end") - F.col("range_start") + 1).alias("width")
    return plan.select("ShortName", "TrialNumber", "class_label", "part", width, "range_start", "range_end")


@query(
    "F28_align_sampling_warped",
    f"""WITH {_plan_sql(0.25, 0.25, True, 2, 1.2, 1.6)} SELECT trace_id, ShortName, class_label, part, pos, {q6('avg(v)')} AS mean, count(*) AS n_rows
      FROM ({_warp_sql('r', _PARTS, _Z)}) w GROUP BY ALL""",
)
def f28_warped(spark, sf):
    plan = sm.sampling_plan(fx.sampling_epochs(spark, sf), 0.25, 0.25, **_FULL)
    out = sm.align(plan, fx.frames(spark, sf), tr.z_score, "trace")
    return _mean(out, ["trace_id", "ShortName", "class_label", "part", "pos"])


@query(
    "F28_align_sampling_decisions",
    f"""WITH {_plan_sql(0.25, 0.25, decision='keep')}, w AS ({_warp_sql('r', _PARTS)})
      SELECT ShortName, trace_id, TrialNumber, part, pos, {q6('(v - avg(v) OVER o) / nullif(stddev_pop(v) OVER o, 0)')} AS v FROM w
      WINDOW o AS (PARTITION BY ShortName, trace_id)""",
)
def f28_decisions(spark, sf):
    plan = sm.sampling_plan(fx.sampling_epochs(spark, sf), 0.25, 0.25, decision="keep")
    out = sm.align(plan, fx.frames(spark, sf), tr.z_score, "parts")
    return out.select("ShortName", "trace_id", "TrialNumber", "part", "pos", r6("v").alias("v"))


_WAITS = "bool_or(epoch = 'Feedback Wait') OVER (PARTITION BY ShortName)"
_RENAMED = f"""n AS (SELECT * EXCLUDE (epoch), CASE WHEN ({_WAITS} AND epoch = 'Feedback Wait') OR (NOT {_WAITS} AND epoch IN ('Reward', 'Punishment'))
      THEN 'Feedback Start' ELSE epoch END AS epoch, {_WAITS} AS waits FROM sampling_epochs),
    j AS (SELECT *, waits AND bool_or(epoch = 'Feedback Start') OVER t AND max(trace_end_idx) FILTER (WHERE epoch IN ('Reward', 'Punishment')) OVER t IS NOT NULL AS merges,
      max(trace_end_idx) FILTER (WHERE epoch IN ('Reward', 'Punishment')) OVER t AS late FROM n WINDOW t AS (PARTITION BY {TRIAL}))"""
_CUT = "trace_start_idx + greatest(CAST(floor(0.75 * 4) AS BIGINT) - 1, 0)"


def _epoch_sql(split, limited):
    if limited:
        end = f"CASE WHEN epoch = 'Feedback Start' THEN least({_CUT}, CASE WHEN merges THEN late ELSE trace_end_idx END) ELSE trace_end_idx END"
        rows = f"SELECT {TRIAL}, BrainRegion, epoch, trace_start_idx AS a, {end} AS z, true AS sized FROM j WHERE NOT (merges AND epoch IN ('Reward', 'Punishment'))"
    else:
        end = f"CASE WHEN epoch = 'Feedback Start' THEN {_CUT} ELSE trace_end_idx END"
        rows = f"SELECT {TRIAL}, BrainRegion, epoch, trace_start_idx AS a, {end} AS z, epoch <> 'Feedback Start' AS sized FROM j"
    return f"""{_RENAMED}, e AS ({rows}), m AS (SELECT {split}, epoch, CAST(round_even(median(z - a + 1), 0) AS BIGINT) AS mw FROM e WHERE sized GROUP BY ALL),
    r AS (SELECT e.*, 0::BIGINT AS range_start, coalesce(mw, z - a + 1) AS w FROM e LEFT JOIN m USING ({split}, epoch))"""


@query(
    "F26_normalise_feedback_merged",
    f"""WITH {_epoch_sql('BrainRegion', True)} SELECT BrainRegion, trace_id, ShortName, epoch, pos, {q6('avg(v)')} AS mean, count(*) AS n_rows
      FROM ({_warp_sql('r', TRIAL + ', BrainRegion, epoch', _Z)}) w GROUP BY ALL""",
)
def f26_merged(spark, sf):
    parts = sm.normalized_epochs(fx.sampling_epochs(spark, sf), ["BrainRegion"], 0.75, limit_end=True)
    z = tr.z_score(fx.frames(spark, sf), ["ShortName", "trace_id"])
    out = sm.warp(parts, z, ["ShortName", "TrialNumber", "BrainRegion", "epoch"])
    return _mean(out, ["BrainRegion", "trace_id", "ShortName", "epoch", "pos"])


@query(
    "F26_normalise_feedback_aligned",
    f"""WITH {_epoch_sql('ShortName', False)} SELECT trace_id, ShortName, epoch, pos, {q6('avg(v)')} AS mean, count(*) AS n_rows
      FROM ({_warp_sql('r', TRIAL + ', epoch')}) w GROUP BY ALL""",
)
def f26_aligned(spark, sf):
    parts = sm.normalized_epochs(fx.sampling_epochs(spark, sf), ["ShortName"], 0.75)
    out = sm.warp(parts, fx.frames(spark, sf), ["ShortName", "TrialNumber", "epoch"])
    return _mean(out, ["trace_id", "ShortName", "epoch", "pos"])
