"""Behaviour queries (A, B and D rows)."""

from pyspark.sql import functions as F

from trialweave.functions import draws, skew
from trialweave.operators import behavior as bh
from trialweave.operators import stats as st
from trialweave.operators import windows
from trialweave.operators.behavior import r6, rnd
from trialweave.plans.registry import query
from trialweave.sources import fixtures as fx
from trialweave.sources import tables as tb
from trialweave.sources.sql_views import DVSTR
from trialweave.sources.sql_views import q6
from trialweave.sources.sql_views import rnd as qr

SESS = ["Name", "SessionNum"]
TRIAL = [*SESS, "TrialNumber"]
E = F.expr


def mso_sql(src: str, keys: str, unit: str, value: str, min_rows: int = 0) -> str:
    """Unit means first, then mean, SEM, units and rows."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}{qr('avg(m)')} AS mean, {qr('stddev_samp(m) / sqrt(count(m))')} AS sem, count(m) AS n_units,
      CAST(sum(c) AS BIGINT) AS n_rows FROM (SELECT {k}{unit}, avg({value}) AS m, count(*) AS c FROM {src}
        GROUP BY {k}{unit} HAVING count(*) >= {min_rows}) u {g}"""


def mso(df, keys, unit, value, min_rows=0):
    out = bh.mean_sem_over(df, keys, unit, E(value), min_rows)
    return out.select(*keys, rnd("mean").alias("mean"), rnd("sem").alias("sem"), "n_units", "n_rows")


# ---- sources and sinks ----------------------------------------------------------------------------------------------


@query("A1_trial_scan", "SELECT event_id, user_id, event_type, value FROM events WHERE value > 1.5")
def a1(spark, sf):
    return tb.read_events(spark, f"{sf}/events.parquet").filter("value > 1.5D").select(
        "event_id", "user_id", "event_type", "value"
    )


@query(
    "A2_cohort_load",
    """SELECT event_id, CASE WHEN calcStimulusTime > 3 THEN NULL ELSE ChoiceCorrect END AS ChoiceCorrect,
      CASE WHEN calcStimulusTime > 3 THEN NULL ELSE calcStimulusTime END AS calcStimulusTime FROM trials
    WHERE Name IN (SELECT Name FROM trials GROUP BY Name HAVING count(*) FILTER (WHERE valid) >= 60)""",
)
def a2(spark, sf):
    return bh.cohort(fx.trials(spark, sf), 60).select("event_id", "ChoiceCorrect", "calcStimulusTime")


@query(
    "A3_early_withdrawal_fill",
    """SELECT event_id, CASE WHEN ChoiceLeft IS NULL AND MinSample > calcStimulusTime
      THEN CAST(('0x' || substr(md5('ew|' || event_id), 1, 8)) AS BIGINT) % 2 ELSE ChoiceLeft END AS ChoiceLeft FROM trials""",
)
def a3(spark, sf):
    early = E("ChoiceLeft is null and MinSample > calcStimulusTime")
    filled = F.when(early, draws.index(2, F.lit("ew"), F.col("event_id"))).otherwise(F.col("ChoiceLeft").cast("long"))
    return fx.trials(spark, sf).select("event_id", filled.alias("ChoiceLeft"))


@query(
    "A4_split_file_load",
    """SELECT ShortName, trace_id, n_frames, n_epochs FROM
      (SELECT ShortName, trace_id, count(*) AS n_frames FROM frames GROUP BY ALL) f
      JOIN (SELECT ShortName, count(*) AS n_epochs FROM epochs GROUP BY ALL) e USING (ShortName)""",
)
def a4(spark, sf):
    f = fx.frames(spark, sf).groupBy("ShortName", "trace_id").agg(F.count("*").alias("n_frames"))
    e = fx.epochs(spark, sf).groupBy("ShortName").agg(F.count("*").alias("n_epochs"))
    return skew.attach(f, e, ["ShortName"], how="inner")


@query("A5_cached_or_compute", mso_sql("trials", "DVstr", "Name", "calcStimulusTime"))
def a5(spark, sf):
    return tb.cached_or_compute(
        spark, f"time by difficulty|{sf}", lambda: mso(fx.trials(spark, sf), ["DVstr"], ["Name"], "calcStimulusTime"),
        tb.output_dir(spark),
    )


@query(
    "A6_slim_projection",
    "SELECT event_id, CAST(DV AS FLOAT) AS DV, CAST(calcStimulusTime AS FLOAT) AS t, CAST(ChoiceLeft AS TINYINT) AS cl FROM trials",
)
def a6(spark, sf):
    return fx.trials(spark, sf).selectExpr(
        "event_id", "cast(DV as float) DV", "cast(calcStimulusTime as float) t", "cast(ChoiceLeft as tinyint) cl"
    )


@query("A7_result_sink", "SELECT Name, DVstr, count(*) AS n FROM trials GROUP BY ALL")
def a7(spark, sf):
    path = f"{tb.output_dir(spark)}/results_{sf.strip('/').replace('/', '_').replace(':', '_')}"
    tb.write_results(fx.ev(spark, sf).selectExpr(
        "concat('S', user_id) Name",
        "case when abs((k - 50) / 50.0D) >= 0.66 then 'Easy' when abs((k - 50) / 50.0D) <= 0.33 then 'Hard' else 'Med' end DVstr",
    ).groupBy("Name", "DVstr").agg(F.count("*").alias("n")), path)
    return tb.read_results(spark, path, "DVstr STRING, n BIGINT, Name STRING")


# ---- projections and filters ----------------------------------------------------------------------------------------


@query("B1_difficulty_label", f"SELECT event_id, {DVSTR.format('DV')} AS label, PrevDVstr AS prev_label FROM trials_prev")
def b1(spark, sf):
    return fx.trials_prev(spark, sf).select(
        "event_id", bh.dv_label(F.col("DV")).alias("label"), bh.dv_label(F.col("PrevDV")).alias("prev_label")
    )


@query("B2_column_difference", "SELECT event_id, calcStimulusTime - MinSample AS d FROM trials")
def b2(spark, sf):
    return fx.trials(spark, sf).transform(bh.diff("calcStimulusTime", "MinSample", "d")).select("event_id", "d")


@query(
    "B3_complete_trials",
    """SELECT event_id FROM ev_epochs JOIN (SELECT Name, SessionNum, TrialNumber FROM ev_epochs GROUP BY ALL
      HAVING bool_or(epoch = 'Pre-Trial Start') AND bool_or(epoch IN ('Reward', 'Timeout Punishment')))
      USING (Name, SessionNum, TrialNumber)""",
)
def b3(spark, sf):
    return bh.complete_trials(fx.ev_epochs(spark, sf), TRIAL).select("event_id")


@query(
    "B4_modal_length_trials",
    """WITH t AS (SELECT Name, SessionNum, TrialNumber, bool_or(epoch = 'Reward') AS correct,
        CAST(sum(trace_end_idx - trace_start_idx) AS BIGINT) AS span FROM ev_epochs GROUP BY ALL)
      SELECT e.event_id FROM ev_epochs e JOIN (SELECT *, quantile_cont(span, 0.5) OVER (PARTITION BY Name, correct) AS med
        FROM t) m USING (Name, SessionNum, TrialNumber) WHERE m.span = m.med""",
)
def b4(spark, sf):
    e = fx.ev_epochs(spark, sf)
    ok = e.groupBy(*TRIAL).agg(F.bool_or(F.col("epoch") == "Reward").alias("correct"))
    return bh.modal_length_trials(skew.key_join(e, ok, TRIAL), ["Name"], TRIAL, "correct").select("event_id")


@query(
    "B5_width_quantile_filter",
    """SELECT event_id FROM ev_epochs WHERE trace_end_idx - trace_start_idx BETWEEN
      (SELECT quantile_cont(trace_end_idx - trace_start_idx, 0.25) FROM ev_epochs) AND
      (SELECT quantile_cont(trace_end_idx - trace_start_idx, 0.75) FROM ev_epochs)""",
)
def b5(spark, sf):
    e = fx.ev_epochs(spark, sf).withColumn("width", E("trace_end_idx - trace_start_idx"))
    return bh.between_quantiles(e, [], "width", 0.25, 0.75).select("event_id")


@query(
    "B6_decision_epoch_filter",
    """SELECT event_id FROM ev_epochs JOIN (SELECT Name, SessionNum, TrialNumber FROM ev_epochs GROUP BY ALL
      HAVING NOT bool_or(epoch = 'Decision Time') AND bool_or(epoch = 'Reward')) USING (Name, SessionNum, TrialNumber)""",
)
def b6(spark, sf):
    has = {e: F.bool_or(F.col("epoch") == e) for e in ("Decision Time", "Reward")}
    return bh.keep_groups(fx.ev_epochs(spark, sf), TRIAL, ~has["Decision Time"] & has["Reward"]).select("event_id")


@query("B7_time_ceiling", "SELECT event_id FROM trials WHERE calcStimulusTime <= 2")
def b7(spark, sf):
    return fx.trials(spark, sf).filter("calcStimulusTime <= 2").select("event_id")


@query("B8_overstay_filter", "SELECT event_id FROM trials WHERE calcStimulusTime < GUI_StimulusTime - 0.1::DOUBLE")
def b8(spark, sf):
    return fx.trials(spark, sf).filter("calcStimulusTime < GUI_StimulusTime - 0.1D").select("event_id")


@query(
    "B12_session_quality",
    """SELECT event_id FROM trials JOIN (SELECT Name, SessionNum FROM trials GROUP BY ALL HAVING count(ChoiceCorrect) >= 15
      AND coalesce(avg(ChoiceCorrect) FILTER (WHERE DVstr = 'Easy'), 0) >= 0.7) USING (Name, SessionNum)""",
)
def b12(spark, sf):
    return bh.session_quality(fx.trials(spark, sf), 15, 0.7).select("event_id")


@query(
    "B13_group_size_gate",
    """SELECT event_id FROM trials JOIN (SELECT Name, MinSample FROM trials GROUP BY ALL HAVING count(*) > 16)
      USING (Name, MinSample)""",
)
def b13(spark, sf):
    return bh.keep_groups(fx.trials(spark, sf), ["Name", "MinSample"], F.count("*") > 16).select("event_id")


@query(
    "B14_trial_deduplication",
    """SELECT Name, SessionNum, DV, arg_min(event_id, TrialNumber) AS event_id FROM trials WHERE calcStimulusTime <= 3
      GROUP BY ALL UNION ALL SELECT Name, SessionNum, DV, event_id FROM trials WHERE calcStimulusTime > 3""",
)
def b14(spark, sf):
    t = fx.trials(spark, sf).select(*TRIAL, "DV", "event_id", "calcStimulusTime")
    timed = bh.first_of_duplicates(t.filter("calcStimulusTime <= 3"), [*SESS, "DV"], ["TrialNumber"])
    return timed.unionByName(t.filter("calcStimulusTime > 3")).select(*SESS, "DV", "event_id")


_TIMED = "CASE WHEN event_id % 13 <> 0 THEN calcStimulusTime END"


@query(
    "B14_dedup_and_class",
    f"""WITH u AS (SELECT arg_min(event_id, TrialNumber) AS event_id FROM trials GROUP BY Name, SessionNum, DV),
      d AS (SELECT event_id, Name, SessionNum, DVstr, TrialNumber, {_TIMED} AS t FROM trials JOIN u USING (event_id))
      SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY Name, SessionNum, DVstr) >= 3 THEN ntile(3) OVER (PARTITION BY Name, SessionNum, DVstr ORDER BY t, TrialNumber) END AS quantile_idx
        FROM d WHERE t IS NOT NULL UNION ALL SELECT event_id, NULL FROM d WHERE t IS NULL""",
)
def b14c(spark, sf):
    """Duplicates go, rows without a time are set aside while the others get their speed class, and both are put together again."""
    t = fx.trials(spark, sf).withColumn("calcStimulusTime", E(_TIMED))
    one = bh.first_of_duplicates(t, [*SESS, "DV"], ["TrialNumber"])
    classed = windows.speed_class(one.filter("calcStimulusTime is not null"), [*SESS, "DVstr"], "calcStimulusTime", "TrialNumber")
    rest = one.filter("calcStimulusTime is null").select("event_id", F.lit(None).cast("long").alias("quantile_idx"))
    return classed.select("event_id", "quantile_idx").unionByName(rest)


_AUDIT = ["ChoiceCorrect", "ChoiceLeft", "calcStimulusTime", "MinSample", "Region"]


@query(
    "B15_duplicate_audit",
    " UNION ALL ".join(
        f"""SELECT Name, SessionNum, DV, '{c}' AS col, count(*) AS n FROM trials GROUP BY ALL
        HAVING count(*) > 1 AND (min({c}) <> max({c}) OR (count({c}) > 0 AND count({c}) < count(*)))"""
        for c in _AUDIT
    ),
)
def b15(spark, sf):
    return bh.duplicate_audit(fx.trials(spark, sf), [*SESS, "DV"], _AUDIT)


@query(
    "B16_bounds_audit",
    """SELECT ShortName, count(*) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_repeated,
      count(*) FILTER (WHERE a < 5 OR a > z OR z >= 60) AS n_outside FROM (SELECT ShortName, TrialNumber, epoch, count(*) AS n,
        min(trace_start_idx) AS a, max(trace_end_idx) AS z FROM epochs GROUP BY ALL) e GROUP BY ALL""",
)
def b16(spark, sf):
    return bh.epoch_audit(fx.epochs(spark, sf), ["ShortName", "TrialNumber", "epoch"], "ShortName", 5, 60)


@query(
    "B17_condition_predicate",
    "SELECT event_id FROM trials WHERE DVstr = 'Easy' AND ChoiceCorrect >= 1 AND Region IN ('MFC') AND calcStimulusTime < 1.5",
)
def b17(spark, sf):
    c = bh.Condition
    conds = [c("DVstr", "Easy"), c("ChoiceCorrect", 1, ">="), c("Region", ["MFC"], "in"), c("calcStimulusTime", 1.5, "<")]
    return bh.where_all(fx.trials(spark, sf), conds).select("event_id")


@query(
    "B18_region_layer_restriction",
    "SELECT ShortName, TrialNumber, epoch FROM epochs WHERE BrainRegion IN ('M2_Bi', 'ALM_Bi') AND Layer = 'L23' AND DV IS NOT NULL",
)
def b18(spark, sf):
    e = fx.epochs(spark, sf).filter("BrainRegion in ('M2_Bi', 'ALM_Bi') and Layer = 'L23' and DV is not null")
    return e.select("ShortName", "TrialNumber", "epoch")


_RENAMED = """SELECT e.*, w, CASE WHEN (w AND epoch = 'Feedback Wait') OR (NOT w AND epoch IN ('Reward', 'Punishment'))
      THEN 'Feedback Start' ELSE epoch END AS new_epoch
    FROM ev_epochs e JOIN (SELECT Name, SessionNum, bool_or(epoch = 'Feedback Wait' AND trace_start_idx > 80) AS w
      FROM ev_epochs GROUP BY ALL) s USING (Name, SessionNum)"""


def _renamed(spark, sf):
    e = fx.ev_epochs(spark, sf)
    return bh.rename_feedback(e, SESS, E("epoch = 'Feedback Wait' and trace_start_idx > 80"))


@query("B19_feedback_epoch_rename", f"SELECT event_id, new_epoch AS epoch FROM ({_RENAMED}) r")
def b19(spark, sf):
    return _renamed(spark, sf).select("event_id", "epoch")


@query(
    "B20_feedback_epoch_merge",
    f"""WITH r AS ({_RENAMED}), m AS (SELECT Name, SessionNum, TrialNumber, bool_or(new_epoch = 'Feedback Start') AS fs,
        max(trace_end_idx) FILTER (WHERE new_epoch IN ('Reward', 'Punishment')) AS z FROM r GROUP BY ALL)
      SELECT event_id, CASE WHEN mm THEN z ELSE trace_end_idx END AS trace_end_idx,
        {qr('CASE WHEN mm THEN (z - trace_start_idx + 1) / 4.0::DOUBLE ELSE epoch_time END')} AS epoch_time
      FROM (SELECT r.*, z, w AND fs AND z IS NOT NULL AND new_epoch = 'Feedback Start' AS mm, w AND fs AND z IS NOT NULL AS tm
        FROM r JOIN m USING (Name, SessionNum, TrialNumber)) q WHERE NOT (tm AND new_epoch IN ('Reward', 'Punishment'))""",
)
def b20(spark, sf):
    out = bh.merge_feedback(_renamed(spark, sf), TRIAL, fps=4.0)
    return out.select("event_id", "trace_end_idx", rnd("epoch_time").alias("epoch_time"))


@query(
    "B21_fixed_time_trials",
    """SELECT event_id FROM ev_epochs WHERE epoch_time <= 1.2 AND (Name, SessionNum, TrialNumber) IN
      (SELECT (Name, SessionNum, TrialNumber) FROM ev_epochs WHERE epoch_time <= 1.2 AND epoch IN ('Pre-Trial Start', 'Decision Time')
       GROUP BY Name, SessionNum, TrialNumber HAVING count(*) = 2)""".replace(
        "(Name, SessionNum, TrialNumber) IN\n      (SELECT (Name, SessionNum, TrialNumber)",
        "Name || '|' || SessionNum || '|' || TrialNumber IN (SELECT Name || '|' || SessionNum || '|' || TrialNumber",
    ),
)
def b21(spark, sf):
    e = fx.ev_epochs(spark, sf).filter("epoch_time <= 1.2")
    two = F.count_if(F.col("epoch").isin("Pre-Trial Start", "Decision Time")) == 2
    return bh.keep_groups(e, TRIAL, two).select("event_id")


@query(
    "B22_typical_trial_band",
    """WITH c AS (SELECT * FROM trials WHERE ChoiceCorrect IS NOT NULL),
      b AS (SELECT Name, SessionNum, quantile_cont(calcStimulusTime, 0.45) - 0.1::DOUBLE AS lo,
        quantile_cont(calcStimulusTime, 0.55) + 0.1::DOUBLE AS hi FROM c GROUP BY ALL),
      i AS (SELECT c.* FROM c JOIN b USING (Name, SessionNum) WHERE calcStimulusTime BETWEEN lo AND hi),
      g AS (SELECT median(calcStimulusTime) AS med FROM i)
      SELECT event_id FROM i, g WHERE calcStimulusTime BETWEEN med - 0.1::DOUBLE AND med + 0.1::DOUBLE""",
)
def b22(spark, sf):
    t = fx.trials(spark, sf).filter("ChoiceCorrect is not null")
    return bh.typical_band(t, SESS, "calcStimulusTime", 0.1).select("event_id")


@query(
    "B23_session_padding",
    """WITH l AS (SELECT Name, SessionNum, max(TrialNumber) AS last FROM trials GROUP BY ALL),
      m AS (SELECT *, max(last) OVER (PARTITION BY Name) AS longest FROM l)
      SELECT Name, SessionNum, TrialNumber, valid, DV, calcStimulusTime FROM trials
      UNION ALL SELECT m.Name, m.SessionNum, unnest(range(last + 1, longest + 1)), false, DV, calcStimulusTime
        FROM m JOIN trials t ON t.Name = m.Name AND t.SessionNum = m.SessionNum AND t.TrialNumber = m.last""",
)
def b23(spark, sf):
    cols = [*TRIAL, "valid", "DV", "calcStimulusTime"]
    return bh.pad_sessions(fx.trials(spark, sf).select(*cols)).select(*cols)


_REGION_VALUES = ", ".join(f"({c}, '{n}', '{tb.REGION_ALIASES.get(n, n)}')" for c, n in tb.BRAIN_REGIONS.items())


@query(
    "B25_enum_decode",
    f"""SELECT event_id, shown AS region FROM (SELECT event_id, CAST(k % 24 + 1 AS INT) AS code FROM ev) e
      JOIN (VALUES {_REGION_VALUES}) v(code, region, shown) USING (code)""",
)
def b25(spark, sf):
    e = fx.ev(spark, sf).selectExpr("event_id", "k % 24 + 1 as code")
    return e.join(F.broadcast(tb.region_names(spark)), "code").selectExpr("event_id", "shown as region")


@query(
    "B27_identity_keys",
    "SELECT event_id, Name || '_' || Date || '_' || SessionNum AS SessId, abs(DV) AS abs_dv, PrevDVstr FROM trials_prev",
)
def b27(spark, sf):
    return fx.trials_prev(spark, sf).select(
        "event_id", F.concat_ws("_", "Name", "Date", "SessionNum").alias("SessId"), F.abs("DV").alias("abs_dv"), "PrevDVstr"
    )


@query("B28_trace_length", "SELECT event_id, trace_end_idx - trace_start_idx + 1 AS trace_len FROM ev_epochs")
def b28(spark, sf):
    return fx.ev_epochs(spark, sf).selectExpr("event_id", "trace_end_idx - trace_start_idx + 1 as trace_len")


# ---- grouping machinery ---------------------------------------------------------------------------------------------


@query(
    "D1_group_split",
    """SELECT Name, ChoiceCorrect, bin, count(*) AS n FROM (SELECT *, CASE WHEN abs(DV) <= 0 THEN NULL
        WHEN abs(DV) <= 0.3 THEN 1 WHEN abs(DV) <= 0.6 THEN 2 WHEN abs(DV) <= 1 THEN 3 END::BIGINT AS bin FROM trials) t
      WHERE ChoiceCorrect IS NOT NULL AND bin IS NOT NULL GROUP BY ALL""",
)
def d1(spark, sf):
    t = fx.trials(spark, sf).withColumn("bin", bh.bucket(F.abs("DV"), [0.0, 0.3, 0.6, 1.0], lowest=False))
    return bh.split_by(t, ["Name", "ChoiceCorrect", "bin"]).agg(F.count("*").alias("n"))


@query(
    "D2_regroup",
    """SELECT event_id, 'fast' AS branch FROM trials WHERE calcStimulusTime < 0.5
      UNION ALL SELECT event_id, 'slow' AS branch FROM trials WHERE calcStimulusTime >= 0.5""",
)
def d2(spark, sf):
    t = fx.trials(spark, sf)
    fast, slow = t.filter("calcStimulusTime < 0.5"), t.filter("calcStimulusTime >= 0.5")
    return bh.regroup({"fast": fast.select("event_id"), "slow": slow.select("event_id")}, "branch")


@query(
    "D3_split_level",
    "SELECT Name, SessionNum, Region, quantile_idx, count(*) AS n FROM trials_q WHERE quantile_idx IS NOT NULL GROUP BY ALL",
)
def d3(spark, sf):
    level = bh.SplitLevel.SESSION | bh.SplitLevel.REGION | bh.SplitLevel.QUANTILE
    keys = bh.split_columns(level)
    return bh.split_by(fx.trials_q(spark, sf), keys).agg(F.count("*").alias("n"))


@query(
    "D4_named_condition_keys",
    """SELECT label, count(*) AS n, """ + qr("avg(calcStimulusTime)") + """ AS mean_time FROM (SELECT *,
      concat_ws(' / ', CASE WHEN ChoiceCorrect = 1 THEN 'Correct' ELSE 'Incorrect' END,
        CASE WHEN ChoiceLeft = 1 THEN 'Left' ELSE 'Right' END, DVstr) AS label FROM trials
      WHERE ChoiceCorrect IS NOT NULL) t GROUP BY label""",
)
def d4(spark, sf):
    t = bh.condition_label(fx.trials(spark, sf).filter("ChoiceCorrect is not null"), outcome=True, direction=True, evidence=True)
    return t.groupBy("label").agg(F.count("*").alias("n"), rnd(F.avg("calcStimulusTime")).alias("mean_time"))


_COMBOS_SQL = {
    "All": "",
    "Evidence": "DVstr",
    "Outcome": "ChoiceCorrect",
    "Direction": "ChoiceLeft",
    "EvidenceOutcome": "DVstr, ChoiceCorrect",
    "DirectionOutcome": "ChoiceLeft, ChoiceCorrect",
    "Quantile": "quantile_idx",
    "QuantileDirection": "quantile_idx, ChoiceLeft",
    "QuantileOutcome": "quantile_idx, ChoiceCorrect",
    "QuantileDirectionOutcome": "quantile_idx, ChoiceLeft, ChoiceCorrect",
}


@query(
    "D5_condition_combinations",
    f"""SELECT CASE {' '.join(f"WHEN g = {15 - sum(8 >> ['DVstr', 'ChoiceCorrect', 'ChoiceLeft', 'quantile_idx'].index(c) for c in cols.split(', ') if c)} THEN '{n}'" for n, cols in _COMBOS_SQL.items())} END AS combination,
      DVstr, ChoiceCorrect, ChoiceLeft, quantile_idx, n, mean_time FROM (SELECT DVstr, ChoiceCorrect, ChoiceLeft, quantile_idx,
      grouping(DVstr) * 8 + grouping(ChoiceCorrect) * 4 + grouping(ChoiceLeft) * 2 + grouping(quantile_idx) AS g,
      count(*) AS n, {qr('avg(calcStimulusTime)')} AS mean_time FROM trials_q WHERE ChoiceLeft IS NOT NULL AND quantile_idx IS NOT NULL
      GROUP BY GROUPING SETS ({', '.join(f'({c})' for c in _COMBOS_SQL.values())})) x""",
)
def d5(spark, sf):
    t = fx.trials_q(spark, sf).filter("ChoiceLeft is not null and quantile_idx is not null")
    combos = {n: [c for c in cols.split(", ") if c] for n, cols in _COMBOS_SQL.items()}
    aggs = [F.count("*").alias("n"), rnd(F.avg("calcStimulusTime")).alias("mean_time")]
    return bh.combinations(t, ["DVstr", "ChoiceCorrect", "ChoiceLeft", "quantile_idx"], combos, aggs)


_RIGHT, _EASY, _ANY = "ChoiceCorrect = 1", "DVstr <> 'Hard'", "true"
# The named groupings with their filters.
_PUBLISHED = {
    "All": ("", _ANY),
    "Evidence": ("DVstr", _RIGHT),
    "EvidenceDirection": ("DVstr, ChoiceLeft", _RIGHT),
    "Direction": ("ChoiceLeft", _RIGHT),
    "PrevDirCurDir": ("PrevChoiceLeft, ChoiceLeft", _RIGHT),
    "PrevDirCurDirAll": ("PrevChoiceLeft, ChoiceLeft", _ANY),
    "PrevDirection": ("PrevChoiceLeft", _RIGHT),
    "ChoiceCorrect": ("ChoiceCorrect", _EASY),
    "ChoiceCorrectCurDir": ("ChoiceCorrect, ChoiceLeft", _EASY),
    "PrevChoiceCorrect": ("PrevChoiceCorrect", _RIGHT),
    "PrevChoiceCurDir": ("PrevChoiceCorrect, ChoiceLeft", _RIGHT),
    "PrevChoicePrevDir": ("PrevChoiceLeft, PrevChoiceCorrect", _RIGHT),
    "PrevChoicePrevDirCurDirLeft": ("PrevChoiceLeft, PrevChoiceCorrect", _RIGHT + " AND ChoiceLeft = 0"),
    "SamplingTime": ("dur_bin", _ANY),
    "Quantile": ("quantile_idx", _ANY),
    "QuantileOutcome": ("quantile_idx, ChoiceCorrect", _ANY),
    "QuantileDirection": ("quantile_idx, ChoiceLeft", _ANY),
    "QuantilePrevDir": ("quantile_idx, PrevChoiceLeft", _ANY),
    "QuantileDirectionOutcome": ("quantile_idx, ChoiceLeft, ChoiceCorrect", _ANY),
}
_PARTS = ["DVstr", "ChoiceCorrect", "ChoiceLeft", "PrevChoiceCorrect", "PrevChoiceLeft", "dur_bin", "quantile_idx"]


def _named_sql(name, cols, cond):
    keep = cols.split(", ")
    picked = ", ".join(c if c in keep else f"NULL AS {c}" for c in _PARTS)
    known = " AND ".join(f"{c} IS NOT NULL" for c in keep if c) or "true"
    return f"SELECT '{name}' AS combination, {picked}, count(*) AS n, {qr('avg(calcStimulusTime)')} AS mean_time FROM d WHERE {cond} AND {known} GROUP BY {cols or 'true'}"


@query(
    "D5_published_combinations",
    "WITH d AS (SELECT *, CAST(floor(calcStimulusTime) AS BIGINT) AS dur_bin FROM trials_q) " + " UNION ALL ".join(_named_sql(n, c, f) for n, (c, f) in _PUBLISHED.items()),
)
def d5p(spark, sf):
    """The named groupings with their filters; rows without a value in a grouping's columns are left out, as in a plain group-by."""
    t = fx.trials_prev_q(spark, sf).withColumn("dur_bin", F.floor("calcStimulusTime").cast("long")).select("event_id", "calcStimulusTime", *_PARTS)
    combos = {}
    for name, (cols, cond) in _PUBLISHED.items():
        keep = [c for c in cols.split(", ") if c]
        known = E(" AND ".join([cond, *[f"{c} IS NOT NULL" for c in keep]]))
        combos[name] = (keep, known)
    aggs = [F.count("*").alias("n"), rnd(F.avg("calcStimulusTime")).alias("mean_time")]
    return bh.filtered_combinations(t, _PARTS, combos, aggs)


@query(
    "D6_subdata_apply",
    """SELECT event_id, CASE WHEN bool_and(coalesce(ChoiceCorrect, 0) = 1) OVER (PARTITION BY Name, SessionNum, MinSample)
      THEN calcStimulusTime * 2 ELSE calcStimulusTime END AS t FROM trials""",
)
def d6(spark, sf):
    t = fx.trials(spark, sf).selectExpr("event_id", *SESS, "MinSample", "ChoiceCorrect", "calcStimulusTime as t")
    out = bh.apply_where(t, E("ChoiceCorrect = 1"), lambda d: d.withColumn("t", E("t * 2")), [*SESS, "MinSample"])
    return out.select("event_id", "t")


def _bucket_sql(v: str, edges) -> str:
    whens = " ".join(f"WHEN {v} <= {e!r}::DOUBLE THEN {i}" for i, e in enumerate(edges) if i)
    return f"CASE WHEN {v} < {edges[0]!r}::DOUBLE THEN NULL {whens} END::BIGINT"


_EDGES = bh.evidence_edges(3, combine_sides=False, separate_zero=True)


@query(
    "D7_evidence_bins",
    f"SELECT bin, count(*) AS n, {qr('avg(DV)')} AS dv FROM (SELECT *, {_bucket_sql('DV', _EDGES)} AS bin FROM trials) t GROUP BY bin",
)
def d7(spark, sf):
    t = fx.trials(spark, sf).withColumn("bin", bh.bucket(F.col("DV"), _EDGES))
    return t.groupBy("bin").agg(F.count("*").alias("n"), rnd(F.avg("DV")).alias("dv"))


@query(
    "D8_evidence_quantile_bins",
    f"""SELECT bin, count(*) AS n, {qr('avg(abs(DV))')} AS dv FROM (SELECT DV, CASE WHEN abs(DV) <= e1 THEN 1
        WHEN abs(DV) <= e2 THEN 2 ELSE 3 END::BIGINT AS bin FROM trials,
        (SELECT quantile_cont(abs(DV), 1/3.0::DOUBLE) AS e1, quantile_cont(abs(DV), 2/3.0::DOUBLE) AS e2 FROM trials) q) t GROUP BY bin""",
)
def d8(spark, sf):
    t = bh.evidence_quantile_bin(fx.trials(spark, sf), 3)
    return t.groupBy("bin").agg(F.count("*").alias("n"), rnd(F.avg(F.abs("DV"))).alias("dv"))


@query(
    "D10_assigned_difficulty",
    """SELECT event_id, CASE WHEN p = 100 THEN 'Easy' WHEN p = 68 THEN 'Medium' WHEN p IN (36, 4) THEN 'Hard' END AS difficulty
      FROM (SELECT event_id, abs(round(DV * 100)) AS p FROM trials) t""",
)
def d10(spark, sf):
    t = fx.trials(spark, sf).withColumns(
        {f"Difficulty{i}": F.lit(float(v)) for i, v in ((1, 100), (2, 68), (3, 36), (4, 4))}
    )
    return bh.assigned_difficulty(t, rdk=F.lit(True), combine_sides=True).select("event_id", "difficulty")


# ---- summaries ------------------------------------------------------------------------------------------------------

_CURVE = """WITH s AS (SELECT {keys} GUI_TimeOutIncorrectChoice, bin, SessId, avg(calcStimulusTime) AS m, count(*) AS c
    FROM (SELECT *, CAST(floor((RewardRate5 + 1e-5) / 0.2::DOUBLE) AS BIGINT) AS bin FROM trials_rr
      WHERE valid AND RewardRate5 IS NOT NULL) x
    GROUP BY GROUPING SETS (({keys} GUI_TimeOutIncorrectChoice, bin, SessId), ({keys} bin, SessId)) HAVING count(*) > 2)
  SELECT {keys} GUI_TimeOutIncorrectChoice, bin, """ + qr("avg(m)") + " AS rt_mean, " + qr(
    "stddev_samp(m) / sqrt(count(m))"
) + """ AS rt_sem, count(m) AS n_sessions, CAST(sum(c) AS BIGINT) AS n_trials
  FROM s GROUP BY {keys} GUI_TimeOutIncorrectChoice, bin"""


@query("D11_reward_rate_time", _CURVE.format(keys="Name,"))
def d11(spark, sf):
    return bh.reward_rate_curve(fx.trials_rr(spark, sf), 5, "RewardRate5", "calcStimulusTime", 2, ["Name"])


_Z = "(SELECT * REPLACE ((calcStimulusTime - avg(calcStimulusTime) OVER (PARTITION BY Name)) / stddev_pop(calcStimulusTime) OVER (PARTITION BY Name) AS calcStimulusTime) FROM trials_rr WHERE valid)"


@query("D11_reward_rate_z_time", _CURVE.replace("FROM trials_rr", f"FROM {_Z} z").format(keys="Name,"))
def d11z(spark, sf):
    """The curve over each subject's z-scored times."""
    z = bh.z_by(fx.trials_rr(spark, sf).filter("valid"), ["Name"], {"z": "calcStimulusTime"})
    return bh.reward_rate_curve(z, 5, "RewardRate5", "z", 2, ["Name"])


@query(
    "D12_reward_rate_group_curve",
    f"""WITH c AS ({_CURVE.format(keys="Name,")}) SELECT bin, {qr('avg(rt_mean)')} AS rt_mean,
      {qr('stddev_samp(rt_mean) / sqrt(count(rt_mean))')} AS rt_sem, count(*) AS n_subjects FROM c
      WHERE GUI_TimeOutIncorrectChoice IS NULL AND n_trials >= 5 AND bin NOT IN (0) GROUP BY bin""",
)
def d12(spark, sf):
    c = bh.reward_rate_curve(fx.trials_rr(spark, sf), 5, "RewardRate5", "calcStimulusTime", 2, ["Name"])
    return bh.reward_rate_group_curve(c, min_trials=5, exclude_bins=[0])


_BIAS = """SELECT Name, SessionNum, quantile_idx, 100 * (avg(ChoiceLeft) - avg(CASE WHEN DV > 0 THEN 1 ELSE 0 END)) AS bias
    FROM trials_q WHERE quantile_idx IS NOT NULL GROUP BY ALL"""


def _bias(spark, sf):
    return bh.session_bias(fx.trials_q(spark, sf).filter("quantile_idx is not null"), [*SESS, "quantile_idx"])


@query("D13_choice_bias", f"SELECT Name, SessionNum, quantile_idx, {qr('bias')} AS bias FROM ({_BIAS}) b")
def d13(spark, sf):
    return _bias(spark, sf).withColumn("bias", rnd("bias"))


@query(
    "D14_bias_fast_slow",
    f"""WITH s AS (SELECT Name, quantile_idx AS q, avg(abs(bias)) AS m, stddev_samp(abs(bias)) / sqrt(count(bias)) AS e
        FROM ({_BIAS}) b GROUP BY ALL),
      p AS (SELECT Name, max(m) FILTER (WHERE q = 1) AS f, max(m) FILTER (WHERE q = 2) AS t, max(m) FILTER (WHERE q = 3) AS w
        FROM s GROUP BY Name)
      SELECT count(*) AS n_subjects, {qr('avg(f)')} AS fast, {qr('avg(t)')} AS typical, {qr('avg(w)')} AS slow,
        {qr('avg(f - w) / (stddev_samp(f - w) / sqrt(count(f - w)))')} AS t_stat FROM p""",
)
def d14(spark, sf):
    b = _bias(spark, sf).withColumn("bias", F.abs("bias"))
    wide = bh.by_speed(b, ["Name"], "bias")
    return wide.agg(
        F.count("*").alias("n_subjects"),
        *[rnd(F.avg(c)).alias(c) for c in ("fast", "typical", "slow")],
        rnd(bh.paired_t(F.col("fast"), F.col("slow"))).alias("t_stat"),
    )


_UPD = ", ".join(
    f"{qr(f'''coalesce(100.0::DOUBLE * (sum(Stay) FILTER (WHERE {c}) - sum(StayBaseline) FILTER (WHERE {c})) / nullif(count(*) FILTER (WHERE {c}), 0), 0)''')} AS {n}_update, count(*) FILTER (WHERE {c}) AS n_{n}"
    for n, c in (("win", "PrevOutcomeCount >= 1"), ("lose", "PrevOutcomeCount <= -1"))
)


@query("D15_stay_switch_update", f"SELECT Name, {_UPD} FROM trials_prev GROUP BY Name")
def d15(spark, sf):
    return bh.stay_updates(fx.trials_prev(spark, sf), ["Name"])


@query(
    "D16_stay_switch_matrix",
    f"""WITH s AS (SELECT Name, PrevChoiceCorrect, CASE WHEN grouping(DVstr) = 1 THEN 'Total' ELSE DVstr END AS difficulty,
        100 * avg(Stay) AS st, 100 * avg(StayBaseline) AS sb, 100 * avg(ChoiceCorrect) AS pf, count(*) AS n
        FROM trials_prev WHERE PrevChoiceCorrect IS NOT NULL
        GROUP BY GROUPING SETS ((Name, PrevChoiceCorrect, DVstr), (Name, PrevChoiceCorrect))),
      a AS (SELECT Name, count(*) AS total FROM trials_prev GROUP BY Name)
      SELECT PrevChoiceCorrect, difficulty, {qr('avg(st - sb)')} AS stay_update,
        {qr('stddev_samp(st - sb) / sqrt(count(st - sb))')} AS stay_update_sem, {qr('avg(st)')} AS stay, {qr('avg(sb)')} AS stay_ref,
        {qr('avg(pf)')} AS performance, {qr('avg(100.0::DOUBLE * n / total)')} AS trials_percent, CAST(sum(n) AS BIGINT) AS n_trials
      FROM s JOIN a USING (Name) GROUP BY ALL""",
)
def d16(spark, sf):
    return bh.stay_matrix(fx.trials_prev(spark, sf))


@query(
    "D17_previous_outcome_by_speed",
    f"""WITH s AS (SELECT Name, quantile_idx AS q, avg(PrevChoiceCorrect) AS m FROM trials_q WHERE quantile_idx IS NOT NULL GROUP BY ALL),
      p AS (SELECT Name, max(m) FILTER (WHERE q = 1) AS fast, max(m) FILTER (WHERE q = 2) AS typical,
        max(m) FILTER (WHERE q = 3) AS slow FROM s GROUP BY Name)
      SELECT count(*) AS n_subjects, {", ".join(f"{qr(f'avg({c})')} AS {c}, {qr(f'stddev_samp({c}) / sqrt(count({c}))')} AS {c}_sem" for c in ("fast", "typical", "slow"))},
        {qr('avg(fast - slow) / (stddev_samp(fast - slow) / sqrt(count(fast - slow)))')} AS t_stat FROM p""",
)
def d17(spark, sf):
    wide = bh.by_speed(fx.trials_prev_q(spark, sf).filter("quantile_idx is not null"), ["Name"], "PrevChoiceCorrect")
    cells = [c for n in ("fast", "typical", "slow") for c in (rnd(F.avg(n)).alias(n), rnd(bh.sem(n)).alias(f"{n}_sem"))]
    return wide.agg(F.count("*").alias("n_subjects"), *cells, rnd(bh.paired_t(F.col("fast"), F.col("slow"))).alias("t_stat"))


for _n, _v in (("time", "calcStimulusTime"), ("accuracy", "ChoiceCorrect")):

    @query(
        f"D18_{_n}_by_streak",
        mso_sql("(SELECT * FROM trials_prev WHERE abs(PrevOutcomeCount) BETWEEN 1 AND 2) x", "PrevOutcomeCount", "Name", _v),
    )
    def d18(spark, sf, _v=_v):
        t = fx.trials_prev(spark, sf).filter("abs(PrevOutcomeCount) between 1 and 2")
        return mso(t, ["PrevOutcomeCount"], ["Name"], _v)


_CELL = "(SELECT * FROM trials_prev WHERE PrevChoiceCorrect IS NOT NULL) x"


@query("D19_time_heatmap_mean", mso_sql(_CELL, "PrevChoiceCorrect, DVstr", "Name", "calcStimulusTime"))
def d19(spark, sf):
    t = fx.trials_prev(spark, sf).filter("PrevChoiceCorrect is not null")
    return mso(t, ["PrevChoiceCorrect", "DVstr"], ["Name"], "calcStimulusTime")


@query(
    "D19_time_heatmap_median",
    f"""SELECT PrevChoiceCorrect, DVstr, {qr('avg(m)')} AS median_time, count(*) AS n_units FROM (SELECT Name, PrevChoiceCorrect,
      DVstr, median(calcStimulusTime) AS m FROM {_CELL} GROUP BY ALL) s GROUP BY ALL""",
)
def d19m(spark, sf):
    t = fx.trials_prev(spark, sf).filter("PrevChoiceCorrect is not null")
    per = skew.exact_percentiles(t, ["PrevChoiceCorrect", "DVstr", "Name"], "calcStimulusTime", {"m": 0.5})
    return per.groupBy("PrevChoiceCorrect", "DVstr").agg(rnd(F.avg("m")).alias("median_time"), F.count("*").alias("n_units"))


@query(
    "D19_time_heatmap_mode",
    f"""WITH h AS (SELECT PrevChoiceCorrect, DVstr, CAST(floor(calcStimulusTime / 0.1::DOUBLE) AS BIGINT) AS bin, count(*) AS n
        FROM {_CELL} GROUP BY ALL)
      SELECT PrevChoiceCorrect, DVstr, {qr('(arg_max(bin, n * 100000 - bin) + 0.5) * 0.1')} AS mode_time, max(n) AS n
      FROM h GROUP BY ALL""",
)
def d19o(spark, sf):
    t = fx.trials_prev(spark, sf).filter("PrevChoiceCorrect is not null")
    keys = ["PrevChoiceCorrect", "DVstr"]
    m = bh.histogram_mode(bh.histogram(t, keys, "calcStimulusTime", 0.1), keys)
    return m.select(*keys, rnd((F.col("mode_bin") + 0.5) * 0.1).alias("mode_time"), "n")


@query(
    "D20_prior_current_cells",
    f"""WITH g AS (SELECT CASE WHEN min(calcStimulusTime) <= 0 THEN 1e-6 - min(calcStimulusTime) ELSE 0 END AS shift FROM trials_prev),
      s AS (SELECT PrevChoiceCorrect, DVstr, PrevDVstr, Name, avg(calcStimulusTime) AS t, avg(ln(calcStimulusTime + shift)) AS l,
        count(*) AS n FROM trials_prev, g WHERE PrevChoiceCorrect IS NOT NULL AND DVstr IN ('Easy', 'Hard')
        AND PrevDVstr IN ('Easy', 'Hard') GROUP BY ALL)
      SELECT PrevChoiceCorrect, DVstr, PrevDVstr, {qr('avg(t)')} AS time, {qr('avg(l)')} AS log_time, {qr('avg(n)')} AS trials,
        {qr('stddev_samp(n) / sqrt(count(n))')} AS trials_sem, count(*) AS n_subjects FROM s GROUP BY ALL""",
)
def d20(spark, sf):
    return bh.prior_current_cells(fx.trials_prev(spark, sf))


_D21 = mso_sql("(SELECT * FROM trials WHERE ChoiceCorrect IS NOT NULL) x", "ChoiceCorrect, DVstr", "Name", "calcStimulusTime")


@query("D21_time_vs_difficulty", _D21)
def d21(spark, sf):
    return mso(fx.trials(spark, sf).filter("ChoiceCorrect is not null"), ["ChoiceCorrect", "DVstr"], ["Name"], "calcStimulusTime")


@query(
    "D21_difficulty_slope",
    f"""SELECT ChoiceCorrect, {q6('-regr_slope(mean, x)')} AS slope, {q6('degrees(atan(-regr_slope(mean, x)))')} AS angle
      FROM (SELECT *, CASE DVstr WHEN 'Hard' THEN 1 WHEN 'Med' THEN 2 ELSE 3 END AS x FROM ({_D21}) d) e GROUP BY ChoiceCorrect""",
)
def d21s(spark, sf):
    d = d21(spark, sf).withColumn("x", E("case DVstr when 'Hard' then 1 when 'Med' then 2 else 3 end"))
    slope = -F.regr_slope("mean", "x")
    return d.groupBy("ChoiceCorrect").agg(r6(slope).alias("slope"), r6(F.degrees(F.atan(slope))).alias("angle"))


@query(
    "D22_time_histogram_ecdf",
    f"""WITH h AS (SELECT DVstr, CAST(floor(calcStimulusTime / 0.04::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM trials GROUP BY ALL)
      SELECT DVstr, bin, n, CAST(sum(n) OVER (PARTITION BY DVstr ORDER BY bin) AS BIGINT) AS cum,
        {qr('sum(n) OVER (PARTITION BY DVstr ORDER BY bin) / (sum(n) OVER (PARTITION BY DVstr))::DOUBLE')} AS fraction FROM h""",
)
def d22(spark, sf):
    h = bh.histogram(fx.trials(spark, sf), ["DVstr"], "calcStimulusTime", 0.04)
    return bh.cumulative(h, ["DVstr"]).withColumn("fraction", rnd("fraction"))


@query(
    "D22_subject_tertile_cuts",
    f"""SELECT DVstr, {qr('avg(a)')} AS cut1, {qr('avg(b)')} AS cut2, {qr('avg(m)')} AS median_time FROM (SELECT DVstr, Name,
      quantile_cont(calcStimulusTime, 1/3.0::DOUBLE) AS a, quantile_cont(calcStimulusTime, 2/3.0::DOUBLE) AS b, median(calcStimulusTime) AS m
      FROM trials GROUP BY ALL) s GROUP BY DVstr""",
)
def d22c(spark, sf):
    probs = {"cut1": 1 / 3, "cut2": 2 / 3, "median_time": 0.5}
    per = skew.exact_percentiles(fx.trials(spark, sf), ["DVstr", "Name"], "calcStimulusTime", probs)
    return per.groupBy("DVstr").agg(*[rnd(F.avg(c)).alias(c) for c in probs])


@query(
    "D23_density_on_grid",
    f"""WITH s AS (SELECT DVstr, count(*) AS n, 0.2 * stddev_samp(calcStimulusTime) AS h FROM trials GROUP BY DVstr)
      SELECT DVstr, CAST(g AS INT) AS grid, {qr('sum(exp(-0.5 * pow((0.05 * g - calcStimulusTime) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi()))')} AS density
      FROM trials JOIN s USING (DVstr), range(0, 101) r(g) GROUP BY DVstr, g""",
)
def d23(spark, sf):
    d = bh.density_on_grid(fx.trials(spark, sf), ["DVstr"], "calcStimulusTime", 0.0, 5.0, 0.05, 0.2)
    return d.withColumn("density", rnd("density"))


_CH_EDGES = bh.evidence_edges(3, combine_sides=True, separate_zero=False)


@query(
    "D24_chronometry",
    mso_sql(
        f"(SELECT *, {_bucket_sql('abs(DV)', _CH_EDGES)} AS bin FROM trials WHERE ChoiceCorrect IS NOT NULL) x WHERE bin IS NOT NULL",
        "bin, MinSample", "Name", "100.0 * ChoiceCorrect",
    ),
)
def d24(spark, sf):
    return mso(bh.chronometry_cells(fx.trials(spark, sf), [0.3, 0.6, 0.9, 1.2], _CH_EDGES), ["bin", "MinSample"], ["Name"], "100.0D * ChoiceCorrect")


# Evidence bin edges of the psychometric summaries.
_PSY = [-1.01, -0.66, -0.33, -0.01, 0.01, 0.33, 0.66, 1.01]


def _psy_sql(keys: str, extra: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}bin, {qr('avg(DV)')} AS dv, count(*) AS n, {qr('avg(ChoiceLeft)')} AS outcome,
      {qr('stddev_samp(ChoiceLeft) / sqrt(count(*))')} AS outcome_sem FROM (SELECT *, {_bucket_sql('DV', _PSY)} AS bin
        FROM trials_q WHERE ChoiceLeft IS NOT NULL) t WHERE bin IS NOT NULL {extra} GROUP BY {k}bin"""


@query("D25_psychometric_points", _psy_sql(""))
def d25(spark, sf):
    return bh.psychometric_points(fx.trials(spark, sf), [], _PSY, "ChoiceLeft")


@query(
    "D25_psychometric_subject_first",
    f"""SELECT bin, {qr('avg(d)')} AS dv, {qr('avg(m)')} AS outcome, {qr('stddev_samp(m) / sqrt(count(m))')} AS outcome_sem,
      count(m) AS n_units, CAST(sum(c) AS BIGINT) AS n FROM (SELECT bin, Name, avg(DV) AS d, avg(ChoiceLeft) AS m, count(*) AS c FROM
      (SELECT *, {_bucket_sql('DV', _PSY)} AS bin FROM trials WHERE ChoiceLeft IS NOT NULL) t WHERE bin IS NOT NULL GROUP BY ALL) u GROUP BY bin""",
)
def d25s(spark, sf):
    return bh.subject_psychometric(fx.trials(spark, sf), _PSY, "ChoiceLeft", ["Name"])


_FS = f"""WITH u AS (SELECT bin, Name, avg(ChoiceCorrect) FILTER (WHERE quantile_idx = 1) AS f,
      avg(ChoiceCorrect) FILTER (WHERE quantile_idx = 3) AS s FROM (SELECT *, {_bucket_sql('DV', _PSY)} AS bin FROM trials_q
      WHERE ChoiceCorrect IS NOT NULL) t WHERE bin IS NOT NULL GROUP BY ALL)"""


@query("C14_fast_slow_pairing", f"{_FS} SELECT bin, Name, {qr('f')} AS fast, {qr('s')} AS slow FROM u")
def c14(spark, sf):
    out = bh.fast_slow_pairs(fx.trials_q(spark, sf), _PSY)
    return out.select("bin", "Name", rnd("fast").alias("fast"), rnd("slow").alias("slow"))


@query(
    "D26_fast_slow_psychometric",
    f"""{_FS} SELECT bin, count(f - s) AS n_pairs, {qr('avg(f)')} AS fast, {qr('avg(s)')} AS slow,
      {qr('avg(f - s) / (stddev_samp(f - s) / sqrt(count(f - s)))')} AS t_stat FROM u GROUP BY bin""",
)
def d26(spark, sf):
    p = bh.fast_slow_pairs(fx.trials_q(spark, sf), _PSY)
    f, s = F.col("fast"), F.col("slow")
    return p.groupBy("bin").agg(
        F.count(f - s).alias("n_pairs"), rnd(F.avg(f)).alias("fast"), rnd(F.avg(s)).alias("slow"), rnd(bh.paired_t(f, s)).alias("t_stat")
    )


@query("D26_fast_slow_holm")
def d26h(spark, sf):
    """Paired tests of fast against slow accuracy per bin, subjects as pairs, corrected over the bins."""
    t = st.paired_tests(bh.fast_slow_pairs(fx.trials_q(spark, sf), _PSY), [], "bin", "fast", "slow")
    return t.select("bin", "n_pairs", *[rnd(c).alias(c) for c in ("t_stat", "p", "p_holm")], (F.col("p_holm") <= 0.05).alias("reject"))


@query("D27_session_curves", _psy_sql("Name, SessionNum"))
def d27(spark, sf):
    return bh.psychometric_points(fx.trials(spark, sf), SESS, _PSY, "ChoiceLeft")


@query(
    "D28_label_psychometric",
    f"""SELECT DVstr, side, count(*) AS n, {qr('avg(DV)')} AS dv, {qr('avg(ChoiceLeft)')} AS outcome FROM
      (SELECT *, CAST(sign(DV) AS BIGINT) AS side FROM trials WHERE ChoiceLeft IS NOT NULL) t GROUP BY ALL""",
)
def d28(spark, sf):
    t = fx.trials(spark, sf).filter("ChoiceLeft is not null").withColumn("side", E("cast(sign(DV) as bigint)"))
    return t.groupBy("DVstr", "side").agg(
        F.count("*").alias("n"), rnd(F.avg("DV")).alias("dv"), rnd(F.avg("ChoiceLeft")).alias("outcome")
    )


@query(
    "D57_all_and_per_subject",
    f"""SELECT Name, DVstr, {q6('avg(z)')} AS mean_z, count(*) AS n FROM (SELECT *, (calcStimulusTime - avg(calcStimulusTime) OVER w)
      / stddev_pop(calcStimulusTime) OVER w AS z FROM trials WINDOW w AS (PARTITION BY Name)) t
      GROUP BY GROUPING SETS ((DVstr), (Name, DVstr))""",
)
def d57(spark, sf):
    z = bh.z_by(fx.trials(spark, sf), ["Name"], {"z": "calcStimulusTime"})
    return z.groupingSets([["DVstr"], ["Name", "DVstr"]], "Name", "DVstr").agg(r6(F.avg("z")).alias("mean_z"), F.count("*").alias("n"))


# ---- set operations -------------------------------------------------------------------------------------------------


@query("U1_concat_results", "SELECT event_id, DV, NULL AS t FROM trials UNION ALL SELECT event_id, NULL, calcStimulusTime FROM trials")
def u1(spark, sf):
    t = fx.trials(spark, sf)
    a, b = t.select("event_id", "DV"), t.selectExpr("event_id", "calcStimulusTime as t")
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "U2_outcome_copies",
    """SELECT event_id, epoch, TrialNumber || ' Reward' AS trial, 1 AS ChoiceCorrect FROM ev_epochs WHERE epoch NOT LIKE '%Punish%'
      UNION ALL SELECT event_id, epoch, TrialNumber || ' Punish', 0 FROM ev_epochs WHERE epoch NOT LIKE '%Reward%'""",
)
def u2(spark, sf):
    return bh.outcome_copies(fx.ev_epochs(spark, sf)).select("event_id", "epoch", "trial", "ChoiceCorrect")


@query("U5_remaining_rows", "SELECT event_id FROM trials WHERE event_id NOT IN (SELECT event_id FROM trials WHERE calcStimulusTime > 1)")
def u5(spark, sf):
    t = fx.trials(spark, sf).select("event_id", "calcStimulusTime")
    return t.join(t.filter("calcStimulusTime > 1").select("event_id"), "event_id", "left_anti").select("event_id")


@query(
    "U6_distinct_counts",
    "SELECT DVstr, count(DISTINCT Name) AS n_subjects, count(DISTINCT SessId) AS n_sessions, count(*) AS n_trials FROM trials GROUP BY DVstr",
)
def u6(spark, sf):
    return bh.distinct_counts(fx.trials(spark, sf), ["DVstr"])


@query(
    "S3_sort_rows",
    "SELECT Name, SessionNum, TrialNumber, DV FROM trials ORDER BY Name, SessionNum, TrialNumber",
)
def s3(spark, sf):
    return fx.trials(spark, sf).select(*TRIAL, "DV").orderBy(*TRIAL)


@query(
    "S5_histogram_mode",
    """WITH h AS (SELECT Name, CAST(floor(calcStimulusTime / 0.1::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM trials GROUP BY ALL)
      SELECT Name, arg_max(bin, n * 100000 - bin) AS mode_bin, max(n) AS n FROM h GROUP BY Name""",
)
def s5(spark, sf):
    return bh.histogram_mode(bh.histogram(fx.trials(spark, sf), ["Name"], "calcStimulusTime", 0.1), ["Name"])


@query("G25_standard_error", mso_sql("trials", "Region", "SessId", "calcStimulusTime"))
def g25(spark, sf):
    return mso(fx.trials(spark, sf), ["Region"], ["SessId"], "calcStimulusTime")


@query(
    "G26_time_z_scores",
    f"""SELECT event_id, {q6('(calcStimulusTime - avg(calcStimulusTime) OVER s) / nullif(stddev_pop(calcStimulusTime) OVER s, 0)')} AS z_subject,
      {q6('(calcStimulusTime - avg(calcStimulusTime) OVER n) / nullif(stddev_samp(calcStimulusTime) OVER n, 0)')} AS z_session,
      {q6('(calcStimulusTime - avg(calcStimulusTime) FILTER (WHERE OptoEnabled = 0) OVER s) / stddev_samp(calcStimulusTime) FILTER (WHERE OptoEnabled = 0) OVER s')} AS z_control
      FROM trials WINDOW s AS (PARTITION BY Name), n AS (PARTITION BY Name, SessionNum)""",
)
def g26(spark, sf):
    t = fx.trials(spark, sf).select("event_id", *SESS, "calcStimulusTime", "OptoEnabled")
    t = t.withColumn("ctl", E("if(OptoEnabled = 0, calcStimulusTime, null)"))
    z = bh.z_by(t, ["Name"], {"z_subject": "calcStimulusTime"})
    z = bh.z_by(z, SESS, {"z_session": "calcStimulusTime"}, population=False)
    ref = t.groupBy("Name").agg(F.avg("ctl").alias("m"), F.stddev_samp("ctl").alias("d"))
    z = skew.attach(z, ref, ["Name"]).withColumn("z_control", E("(calcStimulusTime - m) / nullif(d, 0)"))
    return z.select("event_id", *[r6(c).alias(c) for c in ("z_subject", "z_session", "z_control")])


@query(
    "G27_linear_regression",
    f"""SELECT Name, {qr('regr_slope(calcStimulusTime, abs(DV))')} AS slope, {qr('regr_intercept(calcStimulusTime, abs(DV))')} AS intercept,
      {qr('corr(calcStimulusTime, abs(DV))')} AS r FROM trials GROUP BY Name""",
)
def g27(spark, sf):
    t = fx.trials(spark, sf).withColumn("x", F.abs("DV"))
    y = "calcStimulusTime"
    return t.groupBy("Name").agg(
        rnd(F.regr_slope(y, "x")).alias("slope"), rnd(F.regr_intercept(y, "x")).alias("intercept"), rnd(F.corr(y, "x")).alias("r")
    )
