"""Tracking, nearest-time and model-comparison queries."""

from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.operators import behavior as bh
from trialweave.operators import compare as cm
from trialweave.operators import tracking as tk
from trialweave.operators import windows as wn
from trialweave.operators.behavior import r6, rnd
from trialweave.plans.behavior_plans import _PSY, _bucket_sql, mso, mso_sql
from trialweave.plans.registry import query
from trialweave.sources import fixtures as fx
from trialweave.sources.sql_views import erf_sql
from trialweave.sources.sql_views import q6
from trialweave.sources.sql_views import rnd as qr
from trialweave.sources.sql_views import streak_sql

E = F.expr
SESS = ["Name", "SessionNum"]


_NEAR = """WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'error'),
    r AS (SELECT user_id, event_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'purchase')
    SELECT l.user_id, l.event_id AS left_id, arg_min(r.event_id, abs(r.us - l.us) * 2 + CASE WHEN r.us > l.us THEN 1 ELSE 0 END) AS right_id,
      arg_min(r.us - l.us, abs(r.us - l.us) * 2 + CASE WHEN r.us > l.us THEN 1 ELSE 0 END) AS time_diff FROM l JOIN r USING (user_id) GROUP BY l.user_id, l.event_id"""


def _near(spark, sf, **kw):
    e = fx.ev(spark, sf).select("user_id", F.col("event_id").alias("id"), "us", "event_type")
    left, right = e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'")
    return tk.nearest_time(left, right, ["user_id"], "us", **kw).select("user_id", "left_id", "right_id", "time_diff")


@query("C1_nearest_time_join", _NEAR)
def c1(spark, sf):
    return _near(spark, sf)


@query("C1_nearest_time_within", f"SELECT * FROM ({_NEAR}) n WHERE abs(time_diff) < 86400000000".replace("(WITH", "(WITH"))
def c1w(spark, sf):
    return _near(spark, sf, max_diff=86400 * 10**6)


# ---- geometry -------------------------------------------------------------------------------------------------------


@query(
    "T1_clip_time",
    "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS clip_time FROM events",
)
def t1(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.concat(F.lit("rig2/images_"), F.date_format("ts", "yyyy-MM-dd HH_mm_ss"), F.lit(".avi")).alias("f"))
    return e.select("event_id", tk.clip_time(F.col("f")).alias("clip_time"))


@query("T2_stimulus_end_time", f"SELECT event_id, {qr('MinSample + calcStimulusTime + GUI_OptoStartDelay')} AS stim_end FROM trials")
def t2(spark, sf):
    return fx.trials(spark, sf).select("event_id", rnd(E("MinSample + calcStimulusTime + GUI_OptoStartDelay")).alias("stim_end"))


def _refs(spark, sf):
    """Top reference of each file (one row per file)."""
    return fx.tracking(spark, sf).select("File").distinct().selectExpr("File", "405D as top_x", "55D as top_y")


@query("T8_reference_lookup", "SELECT File, TrialNumber, frame, 405.0::DOUBLE AS top_x, 55.0::DOUBLE AS top_y FROM tracking")
def t8(spark, sf):
    out = skew.attach(fx.tracking(spark, sf), _refs(spark, sf), ["File"])
    return out.select("File", "TrialNumber", "frame", "top_x", "top_y")


_ROT = """(SELECT File, TrialNumber, frame, T_x - bx AS vx, T_y - b_y AS vy, EL_x - bx AS wx, EL_y - b_y AS wy, 405 - bx AS ux, 55 - b_y AS uy, sqrt((405 - bx) * (405 - bx) + (55 - b_y) * (55 - b_y)) AS len
    FROM tracking JOIN (SELECT File, median(screw_x) AS bx, median(screw_y) AS b_y FROM tracking GROUP BY File) b USING (File))"""


@query(
    "T3_rotate_to_axis",
    f"""SELECT File, TrialNumber, frame, {qr('(ux * vy - uy * vx) / len')} AS xp, {qr('(ux * vx + uy * vy) / len')} AS yp, {qr('(ux * vy - uy * vx) / (len * len)')} AS xn,
      {qr('degrees(atan2(ux * vy - uy * vx, ux * vx + uy * vy))')} AS deg, {qr('sqrt(vx * vx + vy * vy) / len')} AS dn,
      {qr('degrees(atan2(ux * wy - uy * wx, ux * wx + uy * wy))')} AS el_deg FROM {_ROT} r""",
)
def t3(spark, sf):
    r = tk.rotate(fx.tracking(spark, sf), "File", _refs(spark, sf))
    cols = {"xp": "T_xp", "yp": "T_yp", "xn": "T_xn", "deg": "T_deg", "dn": "T_dn", "el_deg": "EL_deg"}
    return r.select("File", "TrialNumber", "frame", *[rnd(c).alias(n) for n, c in cols.items()])


def _interp_sql(c):
    w = "(PARTITION BY File, TrialNumber ORDER BY frame"
    p, n = f"{w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"{w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    fr = f"CASE WHEN {c} IS NOT NULL THEN frame END"
    return f"""coalesce({c}, last_value({c} IGNORE NULLS) OVER {p} + (first_value({c} IGNORE NULLS) OVER {n} - last_value({c} IGNORE NULLS) OVER {p})
      * (frame - max({fr}) OVER {p}) / nullif(min({fr}) OVER {n} - max({fr}) OVER {p}, 0), last_value({c} IGNORE NULLS) OVER {p}, first_value({c} IGNORE NULLS) OVER {n})"""


@query("T4_gap_interpolation", f"SELECT File, TrialNumber, frame, {', '.join(f'{qr(_interp_sql(c))} AS {c}' for c in ('EL_x', 'EL_y', 'LL_x', 'T_x'))} FROM tracking")
def t4(spark, sf):
    cols = ["EL_x", "EL_y", "LL_x", "T_x"]
    out = tk.interpolate(fx.tracking(spark, sf), ["File", "TrialNumber"], "frame", cols)
    return out.select("File", "TrialNumber", "frame", *[rnd(c).alias(c) for c in cols])


_BAD = "T_score < 0.25 OR coalesce(T_y < least(LL_y, LR_y), false)"
_TAIL = f"(SELECT * REPLACE (CASE WHEN NOT ({_BAD}) THEN T_x END AS T_x, CASE WHEN NOT ({_BAD}) THEN T_y END AS T_y) FROM tracking)"


@query("T5_bad_tail", f"SELECT File, TrialNumber, frame, T_x, T_y FROM {_TAIL} t")
def t5(spark, sf):
    return tk.reject_bad_tail(fx.tracking(spark, sf)).select("File", "TrialNumber", "frame", "T_x", "T_y")


def _est(p, d):
    """Filled coordinate by which points are seen, written out case by case."""
    n = "((EL_x IS NOT NULL)::INT + (ER_x IS NOT NULL)::INT + (LL_x IS NOT NULL)::INT + (LR_x IS NOT NULL)::INT)"
    side = {"EL": ("ER", "LL", "LR"), "ER": ("EL", "LR", "LL"), "LL": ("LR", "EL", "ER"), "LR": ("LL", "ER", "EL")}
    across, along, far = side[p]
    is_e = p[0] == "E"
    sideways = ("sh" if is_e else "li", "+" if p[1] == "R" else "-")
    updown = ("le" if p[1] == "L" else "ri", "+" if is_e else "-")
    pair_seen = f"{along}_x IS NOT NULL AND {far}_x IS NOT NULL"
    one = f"WHEN {n} = 1 AND {across}_x IS NOT NULL THEN {across}_{d} {sideways[1]} {sideways[0]}_{d}" if is_e else ""
    three = f"{along}_{d} {'-' if is_e else '+'} ({('LR' if p[1] == 'L' else 'LL')}_{d} - {('ER' if p[1] == 'L' else 'EL')}_{d})"
    return f"""CASE WHEN {p}_x IS NOT NULL THEN {p}_{d} WHEN {n} = 3 THEN {three} WHEN {n} = 2 AND {pair_seen} THEN {along}_{d} {updown[1]} {updown[0]}_{d}
      WHEN {n} = 2 AND {across}_x IS NOT NULL THEN {across}_{d} {sideways[1]} {sideways[0]}_{d} {one} END"""


_OFF = "(SELECT File, " + ", ".join(
    f"avg({a}_{d} - {b}_{d}) AS {n}_{d}" for n, a, b in (("sh", "ER", "EL"), ("li", "LR", "LL"), ("le", "EL", "LL"), ("ri", "ER", "LR")) for d in "xy"
) + " FROM tracking GROUP BY File)"
_FILL = "(SELECT File, TrialNumber, frame, T_x, T_y, " + ", ".join(f"{_est(p, d)} AS {p}_{d}" for p in ("EL", "ER", "LL", "LR") for d in "xy") + f" FROM {_TAIL} t JOIN {_OFF} o USING (File))"


@query("T6_missing_point_estimate", f"SELECT File, TrialNumber, frame, {', '.join(f'{qr(f'{p}_{d}')} AS {p}_{d}' for p in ('EL', 'ER', 'LL', 'LR') for d in 'xy')} FROM {_FILL} f")
def t6(spark, sf):
    out = tk.estimate_points(tk.reject_bad_tail(fx.tracking(spark, sf)), "File")
    return out.select("File", "TrialNumber", "frame", *[rnd(f"{p}_{d}").alias(f"{p}_{d}") for p in ("EL", "ER", "LL", "LR") for d in "xy"])


def _cen(d):
    t = {p: f"CAST(trunc({p}_{d}) AS INT)" for p in ("EL", "ER", "LL", "LR", "T")}
    four = f"{t['EL']} + {t['ER']} + {t['LL']} + {t['LR']}"
    n4 = "EL_x IS NOT NULL AND ER_x IS NOT NULL AND LL_x IS NOT NULL AND LR_x IS NOT NULL"
    return f"""CASE WHEN {n4} AND T_x IS NOT NULL THEN ({four} + {t['T']}) / 5.0::DOUBLE WHEN {n4} THEN ({four}) / 4.0::DOUBLE
      WHEN T_x IS NOT NULL AND ER_x IS NOT NULL AND EL_x IS NOT NULL THEN ({t['T']} + {t['ER']} + {t['EL']}) / 3.0::DOUBLE END"""


@query(
    "T7_centroid_angle",
    f"SELECT File, TrialNumber, frame, {qr('c_x')} AS c_x, {qr('c_y')} AS c_y, {qr('-(degrees(atan2(c_y, c_x)) - 90)')} AS angle FROM (SELECT *, {_cen('x')} AS c_x, {_cen('y')} AS c_y FROM {_FILL} f) g",
)
def t7(spark, sf):
    out = tk.centroid(tk.estimate_points(tk.reject_bad_tail(fx.tracking(spark, sf)), "File"))
    return out.select("File", "TrialNumber", "frame", *[rnd(c).alias(c) for c in ("c_x", "c_y", "angle")])


_ANG = "(SELECT File, TrialNumber, frame, T_x * 2 AS angle, TrialNumber % 2 AS ChoiceLeft, 1 + TrialNumber % 3 AS speed FROM tracking WHERE T_x IS NOT NULL)"


def _angles(spark, sf):
    return fx.tracking(spark, sf).filter("T_x is not null").selectExpr(
        "File", "TrialNumber", "frame", "T_x * 2 as angle", "TrialNumber % 2 as ChoiceLeft", "1 + TrialNumber % 3 as speed"
    )


@query(
    "B24_trial_percentile_trim",
    f"""SELECT File, TrialNumber, frame FROM {_ANG} a JOIN (SELECT File, TrialNumber, quantile_cont(angle, 0.1) AS lo, quantile_cont(angle, 0.9) AS hi FROM {_ANG} a GROUP BY ALL) q
      USING (File, TrialNumber) WHERE angle BETWEEN lo AND hi""",
)
def b24(spark, sf):
    return tk.trim_trial(_angles(spark, sf), ["File", "TrialNumber"], "angle", 0.1).select("File", "TrialNumber", "frame")


def _hist_sql(src, keys, lo, hi):
    bins = int((hi - lo) / 5)
    k = f"{keys}, " if keys else ""
    j = " AND ".join(f"g.{c} = h.{c}" for c in [*(keys.split(", ") if keys else []), "File", "bin"])
    return f"""WITH s AS {src}, t AS (SELECT {k}File, count(*) AS t FROM s GROUP BY ALL),
      h AS (SELECT {k}File, CASE WHEN val = {hi} THEN {bins - 1} ELSE CAST(floor((val - ({lo})) / 5) AS BIGINT) END AS bin, count(*) AS n FROM s GROUP BY ALL),
      g AS (SELECT *, unnest(range(0, {bins})) AS bin FROM t)
      SELECT {', '.join(f'g.{c}' for c in keys.split(', ')) + ', ' if keys else ''}g.bin, {qr('avg(coalesce(n, 0) / t::DOUBLE)')} AS mean, {qr('stddev_samp(coalesce(n, 0) / t::DOUBLE) / sqrt(count(*))')} AS sem, count(*) AS n_sessions
      FROM g LEFT JOIN h ON {j} GROUP BY ALL"""


@query("D52_distance_histogram", _hist_sql(f"(SELECT File, TrialNumber, abs(max(angle) - min(angle)) AS val FROM {_ANG} a GROUP BY ALL)", "", 0, 70))
def d52(spark, sf):
    t = _angles(spark, sf).groupBy("File", "TrialNumber").agg(F.abs(F.max("angle") - F.min("angle")).alias("val"))
    h = tk.fraction_histogram(t, [], "File", "val", 0.0, 70.0, 5.0)
    return h.select("bin", "n_sessions", rnd("mean").alias("mean"), rnd("sem").alias("sem"))


@query("D53_mean_angle_histogram", _hist_sql(f"(SELECT File, TrialNumber, speed, round(avg(angle), 9) AS val FROM {_ANG} a GROUP BY ALL)", "speed", -70, 70))
def d53(spark, sf):
    t = _angles(spark, sf).groupBy("File", "TrialNumber", "speed").agg(rnd(F.avg("angle")).alias("val"))
    h = tk.fraction_histogram(t, ["speed"], "File", "val", -70.0, 70.0, 5.0)
    return h.select("speed", "bin", "n_sessions", rnd("mean").alias("mean"), rnd("sem").alias("sem"))


@query(
    "D54_side_normalisation",
    f"""SELECT File, TrialNumber, frame, signed, CASE WHEN count(*) FILTER (WHERE signed < 0) OVER w > count(*) FILTER (WHERE signed > 0) OVER w THEN -signed ELSE signed END AS preferred
      FROM (SELECT *, CASE WHEN ChoiceLeft = 1 THEN angle ELSE -angle END AS signed FROM {_ANG} a) b WINDOW w AS (PARTITION BY File)""",
)
def d54(spark, sf):
    return tk.side_signs(_angles(spark, sf), "File", "angle").select("File", "TrialNumber", "frame", "signed", "preferred")


@query(
    "D55_distance_from_base",
    f"""WITH t AS (SELECT File, TrialNumber, speed, round(avg(angle), 9) AS val FROM {_ANG} a GROUP BY ALL),
      h AS (SELECT File, round_even(val / 5, 0) * 5 AS b, count(*) AS n FROM t GROUP BY ALL),
      m AS (SELECT DISTINCT File, first_value(b) OVER (PARTITION BY File ORDER BY n DESC, b) AS base FROM h),
      g AS (SELECT File, speed, avg(abs(val - base)) AS d, count(*) AS n FROM t JOIN m USING (File) GROUP BY ALL HAVING count(*) >= 2)
      SELECT File, speed, {qr('d')} AS distance, n FROM g WHERE File IN (SELECT File FROM g GROUP BY File HAVING count(*) = 3)""",
)
def d55(spark, sf):
    t = _angles(spark, sf).groupBy("File", "TrialNumber", "speed").agg(rnd(F.avg("angle")).alias("val"))
    return tk.distance_from_base(t, "File", ["speed"], "val", 2, 3).withColumn("distance", rnd("distance"))


# ---- model comparison -----------------------------------------------------------------------------------------------

_LONG = """(SELECT ChoiceCorrect AS cc, 'real' AS source, calcStimulusTime AS t FROM trials WHERE valid AND ChoiceCorrect IS NOT NULL
    UNION ALL SELECT SimChoiceCorrect, 'sim', SimRT FROM trials WHERE valid AND SimChoiceCorrect IS NOT NULL)"""


@query(
    "D44_quantile_loss",
    f"""WITH x AS {_LONG}, q AS (SELECT cc, min(t) + 1e-6 AS e1, quantile_cont(t, 0.1) AS e2, quantile_cont(t, 0.3) AS e3, quantile_cont(t, 0.5) AS e4, quantile_cont(t, 0.7) AS e5,
        quantile_cont(t, 0.9) AS e6 FROM x WHERE source = 'real' GROUP BY cc),
      h AS (SELECT cc, CASE WHEN t IS NULL THEN -1 WHEN t < e1 THEN 0 WHEN t < e2 THEN 1 WHEN t < e3 THEN 2 WHEN t < e4 THEN 3 WHEN t < e5 THEN 4 WHEN t < e6 THEN 5 ELSE 6 END AS bin,
        count(*) FILTER (WHERE source = 'real') AS r, count(*) FILTER (WHERE source = 'sim') AS s FROM x JOIN q USING (cc) WHERE t IS NULL OR t BETWEEN 0 AND 12 GROUP BY ALL)
      SELECT cc, {qr('sum((s - r) * (s - r) / r::DOUBLE)')} AS loss FROM h WHERE r > 0 GROUP BY cc""",
)
def d44(spark, sf):
    t = fx.trials(spark, sf).filter("valid")
    both = t.selectExpr("stack(2, ChoiceCorrect, 'real', calcStimulusTime, SimChoiceCorrect, 'sim', SimRT) as (cc, source, t)").filter("cc is not null")
    return cm.quantile_loss(both, ["cc"], 12.0).withColumn("loss", rnd("loss"))


@query(
    "D45_thirds_by_label",
    """SELECT event_id, CASE WHEN r <= n // 3 THEN 1 WHEN r <= 2 * n // 3 THEN 2 ELSE 3 END::BIGINT AS third FROM (SELECT event_id,
      row_number() OVER (PARTITION BY DVstr ORDER BY calcStimulusTime, event_id) AS r, count(*) OVER (PARTITION BY DVstr) AS n FROM trials) t""",
)
def d45(spark, sf):
    return cm.thirds_by_label(fx.trials(spark, sf), "DVstr", "calcStimulusTime", "event_id").select("event_id", "third")


@query(
    "D46_real_model_histograms",
    f"""WITH x AS {_LONG}, h AS (SELECT cc, source, CAST(floor(t / 0.02::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM x WHERE t BETWEEN 0 AND 3 GROUP BY ALL),
      g AS (SELECT DISTINCT cc, source, unnest(range(0, 150)) AS bin FROM x)
      SELECT g.cc, g.source, g.bin, coalesce(n, 0) AS n, {qr('sum(coalesce(n, 0)) OVER (PARTITION BY g.cc, g.source ORDER BY g.bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE')} AS smooth
      FROM g LEFT JOIN h ON h.cc = g.cc AND h.source = g.source AND h.bin = g.bin""",
)
def d46(spark, sf):
    t = fx.trials(spark, sf).filter("valid")
    both = t.selectExpr("stack(2, ChoiceCorrect, 'real', calcStimulusTime, SimChoiceCorrect, 'sim', SimRT) as (cc, source, t)").filter("cc is not null")
    h = cm.smoothed_histogram(both, ["cc", "source"], "t", 0.02, 3.0, 5)
    return h.withColumn("smooth", rnd("smooth"))


_SIM = "(SELECT * REPLACE (SimChoiceCorrect AS ChoiceCorrect, CASE WHEN SimChoiceCorrect = 1 THEN CASE WHEN LeftRewarded THEN 1 ELSE 0 END WHEN SimChoiceCorrect = 0 THEN CASE WHEN LeftRewarded THEN 0 ELSE 1 END END AS ChoiceLeft) FROM trials)"


def _sim_prev(spark, sf):
    t = fx.trials(spark, sf).withColumn("ChoiceCorrect", F.col("SimChoiceCorrect"))
    t = t.withColumn("ChoiceLeft", E("case SimChoiceCorrect when 1 then cast(LeftRewarded as int) when 0 then cast(not LeftRewarded as int) end"))
    return wn.previous_trial(t, SESS)


@query(
    "D47_model_streak_views",
    mso_sql(f"(SELECT * FROM ({streak_sql(_SIM)}) s WHERE abs(PrevOutcomeCount) BETWEEN 1 AND 3) x", "PrevOutcomeCount", "Name", "SimRT"),
)
def d47(spark, sf):
    return mso(_sim_prev(spark, sf).filter("abs(PrevOutcomeCount) between 1 and 3"), ["PrevOutcomeCount"], ["Name"], "SimRT")


@query(
    "D47_model_choice_bias",
    f"""SELECT Name, SessionNum, {qr('100 * (avg(ChoiceLeft) - avg(CASE WHEN DV > 0 THEN 1 ELSE 0 END))')} AS bias FROM {_SIM} t GROUP BY ALL""",
)
def d47b(spark, sf):
    return bh.session_bias(_sim_prev(spark, sf), SESS).withColumn("bias", rnd("bias"))


_STATE = f"""(SELECT event_id, {qr('l.val')} AS q_left, {qr('r.val')} AS q_right, {qr('ln(greatest(l.val, 0.01) / greatest(r.val, 0.01)) / ln(100)')} AS q_val, {qr('x.val')} AS learned_rate
    FROM learn_left l JOIN learn_right r USING (event_id) JOIN learn_rate x USING (event_id))"""


def _states(spark, sf):
    t = wn.learned_values(fx.trials(spark, sf), SESS, "TrialNumber", rate=0.37)
    t = wn.replay_average(t, SESS, "TrialNumber", F.col("ChoiceCorrect").cast("double"), F.lit(True), 0.2, 0.5, "learned_rate")
    return t.withColumns({c: rnd(c) for c in ("q_left", "q_right", "q_val", "learned_rate")})


@query(
    "D48_state_distributions",
    f"""SELECT state, CAST(floor(v / 0.1::DOUBLE + 1e-7) AS BIGINT) AS bin, count(*) AS n FROM (UNPIVOT (SELECT q_left, q_right, q_val, learned_rate,
      CASE WHEN DV < 0 THEN -q_val ELSE q_val END AS start_side FROM {_STATE} s JOIN trials USING (event_id)) ON q_left, q_right, q_val, learned_rate, start_side INTO NAME state VALUE v) u GROUP BY ALL""",
)
def d48(spark, sf):
    s = _states(spark, sf).withColumn("start_side", E("if(DV < 0, -q_val, q_val)"))
    names = ("q_left", "q_right", "q_val", "learned_rate", "start_side")
    long = s.selectExpr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) as (state, v)")
    return long.groupBy("state", F.floor(F.col("v") / F.lit(0.1) + 1e-7).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def _kernel1():
    from trialweave.plans.opto_plans import _kernel

    return _kernel(1)


@query(
    "D49_value_reward_surface",
    f"""WITH s AS (SELECT t.*, q_val, learned_rate FROM trials t JOIN {_STATE} x USING (event_id) WHERE SimChoiceCorrect = 1),
      z AS (SELECT *, (SimRT - avg(SimRT) OVER w) / nullif(stddev_pop(SimRT) OVER w, 0) AS z, CASE WHEN DV = 0 THEN q_val ELSE abs(q_val) * sign(DV) * sign(q_val) END AS qr FROM s WINDOW w AS (PARTITION BY Name)),
      c AS (SELECT CAST(ceil(learned_rate / 0.1::DOUBLE - 1e-9) AS BIGINT) AS rr, CAST(ceil(abs(DV) / (1/3.0::DOUBLE) - 1e-9) AS BIGINT) AS dv, CAST(ceil((qr + 1) / 0.1::DOUBLE - 1e-9) AS BIGINT) AS q,
        CASE WHEN count(*) > 1 THEN avg(z) END AS v FROM z GROUP BY 1, 2, 3)
      SELECT a.rr, a.dv, a.q, {q6('CASE WHEN a.v IS NOT NULL THEN sum(w * b.v) + (1 - sum(w)) * a.v END')} AS smooth FROM c a JOIN {_kernel1()} ON true
      JOIN c b ON b.rr = a.rr AND b.dv = a.dv AND b.q = a.q + d AND (b.v IS NOT NULL OR a.v IS NULL) GROUP BY a.rr, a.dv, a.q, a.v""",
)
def d49(spark, sf):
    s = cm.value_surface(_states(spark, sf).filter("SimChoiceCorrect = 1"), "SimRT")
    return s.withColumn("smooth", r6("smooth"))


_AGR = f"(SELECT Name, bin, avg(ChoiceCorrect) AS real, avg(SimChoiceCorrect) AS model FROM (SELECT *, {_bucket_sql('DV', _PSY)} AS bin FROM trials WHERE ChoiceCorrect IS NOT NULL) t WHERE bin IS NOT NULL GROUP BY ALL)"


@query(
    "D51_fit_agreement",
    f"""SELECT Name, {qr('1 - sum((real - model) * (real - model)) / nullif(sum((real - m) * (real - m)), 0)')} AS r2, {qr('corr(real, model)')} AS pearson, count(*) AS n FROM
      (SELECT *, avg(real) OVER (PARTITION BY Name) AS m FROM {_AGR} a) b GROUP BY Name""",
)
def d51(spark, sf):
    t = fx.trials(spark, sf).filter("ChoiceCorrect is not null").withColumn("bin", bh.bucket(F.col("DV"), _PSY)).filter("bin is not null")
    p = t.groupBy("Name", "bin").agg(F.avg("ChoiceCorrect").alias("real"), F.avg("SimChoiceCorrect").alias("model"))
    a = cm.agreement(p, ["Name"], "real", "model")
    return a.select("Name", "n", rnd("r2").alias("r2"), rnd("pearson").alias("pearson"))


# Sides of modelled choices follow from their outcome; a few observed and modelled times are missing.
_SIDED = """(SELECT Name, ChoiceCorrect AS cc, ChoiceLeft AS cl, 'real' AS source, CASE WHEN event_id % 7 <> 0 THEN calcStimulusTime END AS t FROM trials WHERE valid AND ChoiceCorrect IS NOT NULL
    UNION ALL SELECT Name, SimChoiceCorrect, CASE WHEN SimChoiceCorrect = ChoiceCorrect THEN ChoiceLeft ELSE 1 - ChoiceLeft END, 'sim', CASE WHEN event_id % 11 <> 0 THEN SimRT END
      FROM trials WHERE valid AND SimChoiceCorrect IS NOT NULL)"""


@query(
    "D44_loss_by_subject",
    f"""WITH x AS (SELECT * FROM {_SIDED} s), q AS (SELECT Name, cc, cl, min(t) + 1e-6 AS e1, quantile_cont(t, 0.1) AS e2, quantile_cont(t, 0.3) AS e3, quantile_cont(t, 0.5) AS e4, quantile_cont(t, 0.7) AS e5,
        quantile_cont(t, 0.9) AS e6 FROM x WHERE source = 'real' GROUP BY ALL HAVING count(t) > 0),
      h AS (SELECT Name, cc, cl, CASE WHEN t IS NULL THEN -1 WHEN t < e1 THEN 0 WHEN t < e2 THEN 1 WHEN t < e3 THEN 2 WHEN t < e4 THEN 3 WHEN t < e5 THEN 4 WHEN t < e6 THEN 5 ELSE 6 END AS bin,
        count(*) FILTER (WHERE source = 'real') AS r, count(*) FILTER (WHERE source = 'sim') AS s FROM x JOIN q USING (Name, cc, cl) WHERE t IS NULL OR t BETWEEN 0 AND 12 GROUP BY ALL)
      SELECT Name, {qr('sum((s - r) * (s - r) / r::DOUBLE)')} AS loss FROM h WHERE r > 0 GROUP BY Name""",
)
def d44s(spark, sf):
    """Loss of every subject over outcome and side, with the term of missing times."""
    t = fx.trials(spark, sf).filter("valid")
    side = "if(SimChoiceCorrect = ChoiceCorrect, ChoiceLeft, 1 - ChoiceLeft)"
    both = t.selectExpr(
        "Name", f"stack(2, ChoiceCorrect, ChoiceLeft, 'real', if(event_id % 7 <> 0, calcStimulusTime, null), SimChoiceCorrect, {side}, 'sim', if(event_id % 11 <> 0, SimRT, null)) as (cc, cl, source, t)"
    ).filter("cc is not null")
    cells = cm.quantile_loss(both, ["Name", "cc", "cl"], 12.0)
    return cells.groupBy("Name").agg(rnd(F.sum("loss")).alias("loss"))


# ---- psychometric curves --------------------------------------------------------------------------------------------


def _points(spark, sf, keys):
    p = bh.psychometric_points(fx.trials(spark, sf), keys, _PSY, "ChoiceLeft")
    return p.select(*keys, F.col("dv").alias("x"), "n", F.col("outcome").alias("p"))


_D29 = ((0.3, 2.0, 0.1), (-0.1, 0.4, 0.1), (-0.1, 0.4, 0.2, 0.05))


@query(
    "D29_psychometric_functions",
    f"""SELECT event_id, {qr('(1 - 0.1::DOUBLE) - (1 - 0.1::DOUBLE - 0.1::DOUBLE) * exp(-pow(abs(DV) / 0.3::DOUBLE, 2.0::DOUBLE))')} AS weibull,
      {qr('(1 - 0.1::DOUBLE) - (1 - 0.1::DOUBLE - 0.5::DOUBLE) * exp(-pow(abs(DV) / 0.3::DOUBLE, 2.0::DOUBLE))')} AS weibull50,
      {qr(f"0.1::DOUBLE + (1 - 0.1::DOUBLE - 0.1::DOUBLE) * ({erf_sql('(DV + 0.1::DOUBLE) / 0.4::DOUBLE')} + 1) / 2")} AS erf_psycho,
      {qr(f"0.2::DOUBLE + (1 - 0.2::DOUBLE - 0.05::DOUBLE) * ({erf_sql('(DV + 0.1::DOUBLE) / 0.4::DOUBLE')} + 1) / 2")} AS erf_psycho_2gammas FROM trials""",
)
def d29(spark, sf):
    """Model probabilities at every trial's evidence."""
    t = fx.trials(spark, sf).select("event_id", "DV")
    x = F.col("DV")
    lit = [[F.lit(v) for v in p] for p in _D29]
    return t.select(
        "event_id",
        rnd(cm.psychometric("weibull", F.abs(x), lit[0])).alias("weibull"),
        rnd(cm.psychometric("weibull50", F.abs(x), lit[0])).alias("weibull50"),
        rnd(cm.psychometric("erf_psycho", x, lit[1])).alias("erf_psycho"),
        rnd(cm.psychometric("erf_psycho_2gammas", x, lit[2])).alias("erf_psycho_2gammas"),
    )


@query(
    "D30_neg_log_likelihood",
    f"""WITH p AS (SELECT Name, bin, {qr('avg(abs(DV))')} AS x, count(*) AS n, {qr('avg(ChoiceCorrect)')} AS p FROM (SELECT *, {_bucket_sql('abs(DV)', [0.0, 0.33, 0.66, 1.01])} AS bin FROM trials
        WHERE ChoiceCorrect IS NOT NULL) t WHERE bin IS NOT NULL GROUP BY ALL),
      g AS (SELECT *, (1 - 0.05::DOUBLE) - (0.5 - 0.05::DOUBLE) * exp(-pow(x / a, 2.0::DOUBLE)) AS q FROM p, (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.6::DOUBLE)) v(a))
      SELECT Name, a, {qr('-sum(n * (p * ln(q) + (1 - p) * ln(1 - q)))')} AS nll FROM g GROUP BY Name, a""",
)
def d30(spark, sf):
    t = fx.trials(spark, sf).withColumn("DV", F.abs("DV"))
    p = bh.psychometric_points(t, ["Name"], [0.0, 0.33, 0.66, 1.01], "ChoiceCorrect").withColumn("a", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.6)))))
    pars = [F.col("a"), F.lit(2.0), F.lit(0.05)]
    bounds = ((0.005, 0.0, 0.0), (10.0, 10.0, 0.4))
    nll = cm.neg_log_likelihood("weibull50", F.col("dv"), F.col("n"), F.col("outcome"), pars, bounds)
    return p.groupBy("Name", "a").agg(rnd(nll).alias("nll"))


@query("D31_psychometric_fit")
def d31(spark, sf):
    """Curves of every subject in one job."""
    return cm.grid_fit(_points(spark, sf, ["Name"]), ["Name"], "erf_psycho", (-1.0, 0.05, 0.0), (1.0, 3.0, 0.4))


@query("D9_performance_bins")
def d9(spark, sf):
    """Evidence edges of equal performance steps per region."""
    fits = cm.grid_fit(_points(spark, sf, ["Region"]), ["Region"], "erf_psycho", (-1.0, 0.05, 0.0), (1.0, 3.0, 0.4))
    return cm.performance_edges(fits, ["Region"], "erf_psycho", 3)
