"""Stimulation, resampling and statistics queries."""

from pyspark.sql import functions as F

from trialweave.functions import tails
from trialweave.operators import behavior as bh
from trialweave.operators import opto as op
from trialweave.operators import resample as rs
from trialweave.operators import stats as st
from trialweave.operators.behavior import r6, rnd
from trialweave.plans.behavior_plans import _BIAS, _PSY, _bucket_sql, mso, mso_sql
from trialweave.plans.registry import query
from trialweave.sources import fixtures as fx
from trialweave.sources.sql_views import erf_sql, q6
from trialweave.sources.sql_views import rnd as qr
from trialweave.sources.sql_views import rnd as rnd_sql
from trialweave.sources.tables import stored

E = F.expr
ITER = 1000


def _opto(spark, sf):
    t = fx.trials(spark, sf).filter("ChoiceCorrect is not null")
    return t.withColumn("Phase", E("if(GUI_OptoStartDelay <= 0.5, 'Early', 'Late')"))


_T = "(SELECT *, CASE WHEN GUI_OptoStartDelay <= 0.5 THEN 'Early' ELSE 'Late' END AS Phase FROM trials WHERE ChoiceCorrect IS NOT NULL)"
_C = "avg(ChoiceCorrect) FILTER (WHERE OptoEnabled = 0)"
_O = "avg(ChoiceCorrect) FILTER (WHERE OptoEnabled = 1)"


def _gain(c, o):
    return f"(-100 * ({o} / nullif({c}, 0) - 1))"


_CFG_SQL = """(SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 16 ELSE 8 END AS INT) AS start_state,
    CASE WHEN event_id % 3 = 0 THEN 0.3::DOUBLE ELSE GUI_OptoStartDelay END AS start_delay,
    CASE WHEN Region = 'MFC' AND event_id % 2 = 0 THEN 0.35::DOUBLE WHEN event_id % 7 = 0 THEN 0.6::DOUBLE ELSE -1.0::DOUBLE END AS max_dur,
    CASE WHEN event_id % 3 = 0 THEN 5.0::DOUBLE WHEN event_id % 11 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS stim_time,
    CAST(11 AS INT) AS end_state FROM trials)"""


def _cfg(spark, sf):
    return fx.trials(spark, sf).selectExpr(
        "event_id",
        "if(event_id % 5 = 0, 16, 8) as start_state",
        "if(event_id % 3 = 0, 0.3D, GUI_OptoStartDelay) as start_delay",
        "case when Region = 'MFC' and event_id % 2 = 0 then 0.35D when event_id % 7 = 0 then 0.6D else -1.0D end as max_dur",
        "case when event_id % 3 = 0 then 5.0D when event_id % 11 = 0 then 2.0D else 1.0D end as stim_time",
        "11 as end_state",
    )


@query(
    "B9_stimulation_config_label",
    f"""SELECT label, count(*) AS n FROM (SELECT CASE
        WHEN start_state = 8 AND k = 'RT' AND abs(start_delay - 0.3) < 0.01 AND abs(max_dur - 0.3) < 0.01 THEN 'Short RT'
        WHEN start_state = 8 AND k = 'RT' AND abs(start_delay - 0.3) < 0.01 AND abs(max_dur - 0.6) < 0.01 THEN 'Med RT'
        WHEN start_state = 8 AND k = 'FT' AND stim_time = 1 AND start_delay = 0 AND max_dur = -1 THEN 'FT Full Sampling '
        WHEN start_state = 8 AND k = 'FT' AND stim_time = 1 AND start_delay = 0 AND abs(max_dur - 0.35) < 0.01 THEN 'FT Early Sampling'
        WHEN start_state = 8 AND k = 'FT' AND stim_time = 1 AND abs(start_delay - 0.65) < 0.01 AND abs(max_dur - 0.35) < 0.01 THEN 'FT Late Sampling'
        ELSE k || ' - ' || CASE WHEN start_state = 8 THEN CASE WHEN stim_time IN (1, 5) THEN 'Sampling' ELSE 'Sampling (2.0s)' END ELSE 'State 16' END
          || printf(' - s: %.2fs → e: %.2fs', start_delay, start_delay + max_dur) END
        || ' - End: ' || CASE WHEN k = 'FT' THEN 'Decision-Time' ELSE 'Center-Reward' END AS label
      FROM (SELECT *, CASE WHEN stim_time >= 5 THEN 'RT' ELSE 'FT' END AS k FROM {_CFG_SQL} c) c) d GROUP BY label""",
)
def b9(spark, sf):
    kind = E("if(stim_time >= 5, 'RT', 'FT')")
    label = op.config_label(*[F.col(c) for c in ("start_state", "start_delay", "max_dur", "stim_time", "end_state")], kind)
    return _cfg(spark, sf).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(
    "B10_config_loop",
    f"""SELECT stim_kind, coverage, start_delay, max_dur, count(*) AS n FROM (SELECT *, CASE WHEN start_state = 16 THEN 'feedback' WHEN stim_time >= 5 THEN 'RT' ELSE 'FT' END AS stim_kind,
        CASE WHEN start_state = 8 AND start_delay = 0 AND max_dur = stim_time THEN 'full' ELSE 'partial' END AS coverage,
        count(*) OVER (PARTITION BY start_state, start_delay, max_dur, end_state, stim_time) AS g FROM {_CFG_SQL} c) d WHERE g >= 10 GROUP BY ALL""",
)
def b10(spark, sf):
    g = op.config_groups(_cfg(spark, sf), ["start_state", "start_delay", "max_dur", "end_state", "stim_time"], 10)
    return g.groupBy("stim_kind", "coverage", "start_delay", "max_dur").agg(F.count("*").alias("n"))


@query(
    "B11_minimum_trials_gate",
    """SELECT event_id FROM trials JOIN (SELECT Name, SessionNum FROM trials GROUP BY ALL HAVING count(ChoiceCorrect) FILTER (WHERE OptoEnabled = 0) >= 5
      AND count(ChoiceCorrect) FILTER (WHERE OptoEnabled = 1) >= 5) USING (Name, SessionNum)""",
)
def b11(spark, sf):
    return op.enough_trials(fx.trials(spark, sf), ["Name", "SessionNum"], 5).select("event_id")


@query(
    "D33_arm_summary",
    f"""SELECT Name, Region, Phase, count(*) FILTER (WHERE OptoEnabled = 0) AS n_control, count(*) FILTER (WHERE OptoEnabled = 1) AS n_opto,
      {qr(_C)} AS control, {qr(_O)} AS opto, {qr(_gain(_C, _O))} AS effect,
      count(*) FILTER (WHERE OptoEnabled = 0) >= 3 AND count(*) FILTER (WHERE OptoEnabled = 1) >= 3 AS accepted FROM {_T} t GROUP BY ALL""",
)
def d33(spark, sf):
    s = op.arm_summary(_opto(spark, sf), ["Name", "Region", "Phase"], 3)
    keep = ["Name", "Region", "Phase", "n_control", "n_opto", "accepted"]
    return s.select(*keep, *[rnd(c).alias(c) for c in ("control", "opto", "effect")])


@query(
    "D34_effect_size",
    f"""SELECT Name, {qr(_gain(_C, _O))} AS gain, {qr(f'100 - 100 * abs({_O} - 0.5) / nullif({_C} - 0.5, 0)')} AS distance FROM {_T} t GROUP BY Name""",
)
def d34(spark, sf):
    c, o = op.arm_mean("ChoiceCorrect", 0), op.arm_mean("ChoiceCorrect", 1)
    return _opto(spark, sf).groupBy("Name").agg(
        rnd(op.effect_size(c, o)).alias("gain"), rnd(op.effect_size(c, o, "DistanceFromRandom")).alias("distance")
    )


@query(
    "D35_effect_by_region",
    f"""WITH s AS (SELECT Region, Name, {_gain(_C, _O)} AS e, count(*) AS n, count(DISTINCT SessId) AS k FROM {_T} t GROUP BY ALL)
      SELECT Region, {qr('avg(e)')} AS effect, {qr('stddev_samp(e) / sqrt(count(e))')} AS sem, count(e) AS n_subjects,
        CAST(sum(k) AS BIGINT) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_trials FROM s WHERE e IS NOT NULL GROUP BY Region""",
)
def d35(spark, sf):
    t = _opto(spark, sf)
    sess = t.groupBy("Region", "Name", "SessId").agg(
        *[F.count_if(F.col("OptoEnabled") == a).alias(f"n{a}") for a in (0, 1)],
        *[F.sum(E(f"if(OptoEnabled = {a}, ChoiceCorrect, 0)")).alias(f"c{a}") for a in (0, 1)],
    )
    u = sess.groupBy("Region", "Name").agg(
        op.effect_size(F.sum("c0") / F.nullif(F.sum("n0"), F.lit(0)), F.sum("c1") / F.nullif(F.sum("n1"), F.lit(0))).alias("e"),
        F.count("*").alias("k"),
        F.sum(F.col("n0") + F.col("n1")).alias("n"),
    )
    return u.filter("e is not null").groupBy("Region").agg(
        rnd(F.avg("e")).alias("effect"), rnd(bh.sem("e")).alias("sem"), F.count("e").alias("n_subjects"),
        F.sum("k").alias("n_sessions"), F.sum("n").alias("n_trials"),
    )


_LEVELS = {"all": ["Region"], "animal": ["Region", "Name"], "session": ["Region", "Name", "SessId"]}


def _level_sql(level, keys):
    return f"""SELECT '{level}' AS split_level, Region, {qr('avg(e)')} AS effect, {qr('stddev_samp(e) / sqrt(count(e))')} AS sem, count(e) AS n_groups, CAST(sum(n) AS BIGINT) AS n_trials
      FROM (SELECT {', '.join(keys)}, {_gain(_C, _O)} AS e, count(*) AS n FROM {_T} t GROUP BY ALL
        HAVING count(*) FILTER (WHERE OptoEnabled = 0) >= 2 AND count(*) FILTER (WHERE OptoEnabled = 1) >= 2) g WHERE e IS NOT NULL GROUP BY Region"""


@query("D35_effect_by_level", " UNION ALL ".join(_level_sql(k, v) for k, v in _LEVELS.items()))
def d35l(spark, sf):
    """Mean effect of each region over everything, over animals and over sessions with two trials in either arm."""
    t, out = _opto(spark, sf), None
    for level, keys in _LEVELS.items():
        g = op.arm_summary(t, keys, 2).filter("accepted and effect is not null")
        g = g.groupBy("Region").agg(rnd(F.avg("effect")).alias("effect"), rnd(bh.sem("effect")).alias("sem"), F.count("effect").alias("n_groups"), F.sum(E("n_control + n_opto")).alias("n_trials"))
        g = g.withColumn("split_level", F.lit(level))
        out = g if out is None else out.unionByName(g)
    return out


@query(
    "D36_region_phase_table",
    mso_sql(f"(SELECT Region, Phase, Name, {_gain(_C, _O)} AS e FROM {_T} t GROUP BY ALL) x WHERE e IS NOT NULL", "Region, Phase", "Name", "e"),
)
def d36(spark, sf):
    c, o = op.arm_mean("ChoiceCorrect", 0), op.arm_mean("ChoiceCorrect", 1)
    s = _opto(spark, sf).groupBy("Region", "Phase", "Name").agg(op.effect_size(c, o).alias("e")).filter("e is not null")
    return mso(s, ["Region", "Phase"], ["Name"], "e")


@query(
    "D37_early_probability",
    f"""WITH u AS (SELECT Region, Name, OptoEnabled, 100.0 * count(*) FILTER (WHERE calcStimulusTime <= 0.7) / count(*) AS p,
        100 * avg(ChoiceCorrect) FILTER (WHERE calcStimulusTime <= 0.7) AS a FROM {_T} t GROUP BY ALL)
      SELECT Region, OptoEnabled, {qr('avg(p)')} AS early, {qr('stddev_samp(p) / sqrt(count(p))')} AS early_sem, {qr('avg(a)')} AS early_accuracy, count(*) AS n_units FROM u GROUP BY ALL""",
)
def d37(spark, sf):
    u = op.early_probability(_opto(spark, sf), ["Region", "Name"], 0.7)
    return u.groupBy("Region", "OptoEnabled").agg(
        rnd(F.avg("early")).alias("early"), rnd(bh.sem("early")).alias("early_sem"), rnd(F.avg("early_accuracy")).alias("early_accuracy"), F.count("*").alias("n_units")
    )


_Z = f"""(SELECT *, (calcStimulusTime - avg(calcStimulusTime) FILTER (WHERE OptoEnabled = 0) OVER w)
    / nullif(stddev_samp(calcStimulusTime) FILTER (WHERE OptoEnabled = 0) OVER w, 0) AS z FROM {_T} t WINDOW w AS (PARTITION BY Name))"""


@query(
    "D38_decision_cdf",
    f"""WITH h AS (SELECT Name, OptoEnabled, least(greatest(CAST(floor((z + 1.5::DOUBLE) / 0.1::DOUBLE) AS BIGINT), -1), 40) AS bin, count(*) AS n FROM {_Z} z WHERE z IS NOT NULL GROUP BY ALL),
      t AS (SELECT Name, OptoEnabled, sum(n) AS t FROM h GROUP BY ALL),
      g AS (SELECT *, unnest(range(-1, 40)) AS bin FROM t),
      c AS (SELECT g.*, 100.0 * sum(coalesce(n, 0)) OVER (PARTITION BY g.Name, g.OptoEnabled ORDER BY g.bin) / t AS p FROM g LEFT JOIN h ON h.Name = g.Name AND h.OptoEnabled = g.OptoEnabled AND h.bin = g.bin)
      SELECT OptoEnabled, bin, {qr('avg(p)')} AS mean, {qr('stddev_samp(p) / sqrt(count(p))')} AS sem, count(*) AS n_units FROM c WHERE bin >= 0 GROUP BY ALL""",
)
def d38(spark, sf):
    z = op.control_z(_opto(spark, sf), ["Name"])
    c = op.decision_cdf(z, ["Name"], "z", -1.5, 2.5, 0.1)
    return c.select("OptoEnabled", "bin", "n_units", rnd("mean").alias("mean"), rnd("sem").alias("sem"))


def _kernel(sigma):
    from trialweave.operators.traces import gaussian_kernel

    w = gaussian_kernel(sigma)
    return "(VALUES " + ", ".join(f"({k - len(w) // 2}, {x!r}::DOUBLE)" for k, x in enumerate(w)) + ") k(d, w)"


@query(
    "D39_accuracy_by_time",
    f"""WITH a AS (SELECT Name, OptoEnabled, CAST(floor(calcStimulusTime / 0.1::DOUBLE) AS BIGINT) AS bin, avg(ChoiceCorrect) AS v FROM {_T} t WHERE calcStimulusTime < 2 GROUP BY ALL),
      s AS (SELECT a.Name, a.OptoEnabled, a.bin, sum(w * b.v) + (1 - sum(w)) * a.v AS s FROM a JOIN {_kernel(1)} ON true JOIN a b ON b.Name = a.Name AND b.OptoEnabled = a.OptoEnabled AND b.bin = a.bin + d GROUP BY a.Name, a.OptoEnabled, a.bin, a.v),
      g AS (SELECT DISTINCT OptoEnabled, unnest(range(0, 20)) AS bin FROM a)
      SELECT g.OptoEnabled, g.bin, {qr('avg(s.s)')} AS mean, {qr('stddev_samp(s.s) / sqrt(count(s.s))')} AS sem, count(s.s) AS n_units FROM g LEFT JOIN s ON s.OptoEnabled = g.OptoEnabled AND s.bin = g.bin GROUP BY ALL""",
)
def d39(spark, sf):
    a = op.accuracy_by_time(_opto(spark, sf), ["Name"], 0.0, 2.0, 0.1, 1.0)
    return a.select("OptoEnabled", "bin", "n_units", rnd("mean").alias("mean"), rnd("sem").alias("sem"))


@query(
    "D40_time_accuracy_slope",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY Region, OptoEnabled ORDER BY calcStimulusTime, event_id) AS rn, count(*) OVER (PARTITION BY Region, OptoEnabled) AS n FROM {_T} t),
      b AS (SELECT Region, OptoEnabled, (rn - 1) // 50 AS b, avg(calcStimulusTime) + 1.5 AS x, 100 * avg(ChoiceCorrect) - 50 AS y FROM r WHERE (rn - 1) // 50 < n // 50 GROUP BY ALL)
      SELECT Region, OptoEnabled, {qr('sum(x * y) / sum(x * x)')} AS slope, count(*) AS n_blocks FROM b GROUP BY ALL""",
)
def d40(spark, sf):
    s = op.time_accuracy_slope(_opto(spark, sf), ["Region"], 50, -1.5, 50.0)
    return s.withColumn("slope", rnd("slope"))


_KDE = f"""WITH s AS (SELECT Region, OptoEnabled, count(*) AS n, 0.2 * stddev_samp(calcStimulusTime) AS h FROM {_T} t GROUP BY ALL),
    d AS (SELECT Region, OptoEnabled, CAST(g AS INT) AS grid, round(sum(exp(-0.5 * pow((0.05 * g - calcStimulusTime) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 9) AS density
      FROM {_T} t JOIN s USING (Region, OptoEnabled), range(0, 101) r(g) GROUP BY Region, OptoEnabled, g),
    p AS (SELECT DISTINCT Region, OptoEnabled, first_value(grid) OVER (PARTITION BY Region, OptoEnabled ORDER BY density DESC, grid) AS mode, max(density) OVER (PARTITION BY Region, OptoEnabled) AS top FROM d)"""


@query(
    "D41_density_mode_width",
    f"""{_KDE} SELECT Region, OptoEnabled, mode, max(grid) FILTER (WHERE density < top / 2 AND grid < mode) AS left_edge,
      min(grid) FILTER (WHERE density < top / 2 AND grid > mode) AS right_edge FROM d JOIN p USING (Region, OptoEnabled) GROUP BY ALL""",
)
def d41(spark, sf):
    d = bh.density_on_grid(_opto(spark, sf), ["Region", "OptoEnabled"], "calcStimulusTime", 0.0, 5.0, 0.05, 0.2)
    return op.density_mode_width(d.withColumn("density", rnd("density")), ["Region", "OptoEnabled"])


@query(
    "D41_mode_shift",
    f"""{_KDE} SELECT Region, {qr('max(mode) FILTER (WHERE OptoEnabled = 1) - max(mode) FILTER (WHERE OptoEnabled = 0)')} AS shift FROM p GROUP BY Region""",
)
def d41s(spark, sf):
    """How far stimulation moves the density's mode from that of the control arm."""
    d = bh.density_on_grid(_opto(spark, sf), ["Region", "OptoEnabled"], "calcStimulusTime", 0.0, 5.0, 0.05, 0.2)
    m = op.density_mode_width(d.withColumn("density", rnd("density")), ["Region", "OptoEnabled"])
    mode = {a: F.max(F.when(F.col("OptoEnabled") == a, F.col("mode"))) for a in (0, 1)}
    return m.groupBy("Region").agg(rnd(mode[1] - mode[0]).alias("shift"))


@query(
    "D42_time_accuracy_bars",
    f"""SELECT Name, CASE WHEN OptoEnabled = 0 THEN 'Control' ELSE Region END AS arm, {q6('median(z)')} AS median_z, {q6('100 * avg(ChoiceCorrect)')} AS accuracy FROM {_Z} z GROUP BY ALL""",
)
def d42(spark, sf):
    from trialweave.functions import skew

    z = op.control_z(_opto(spark, sf), ["Name"]).withColumn("arm", E("if(OptoEnabled = 0, 'Control', Region)"))
    med = skew.exact_percentiles(z, ["Name", "arm"], "z", {"median_z": 0.5})
    acc = z.groupBy("Name", "arm").agg(r6(100 * F.avg("ChoiceCorrect")).alias("accuracy"))
    return acc.join(med, ["Name", "arm"], "left").withColumn("median_z", r6("median_z"))


@query(
    "D43_feedback_table",
    f"""WITH z AS (SELECT *, (calcStimulusTime - avg(calcStimulusTime) OVER w) / nullif(stddev_samp(calcStimulusTime) OVER w, 0) AS z,
        CASE WHEN PrevCalcStimulusTime1 IS NOT NULL THEN lag(OptoEnabled) OVER (PARTITION BY Name, SessionNum ORDER BY TrialNumber) END AS po FROM trials_prev WINDOW w AS (PARTITION BY Name)),
      s AS (SELECT Name, SessId, po, Region, PrevChoiceCorrect AS pc, avg(z) AS m FROM z WHERE po IS NOT NULL AND PrevChoiceCorrect IS NOT NULL GROUP BY ALL),
      u AS (SELECT Name, po, Region, pc, avg(m) AS m FROM s GROUP BY ALL),
      w AS (SELECT Name, po, Region, avg(m) FILTER (WHERE pc = 0) AS i, avg(m) FILTER (WHERE pc = 1) AS c FROM u GROUP BY ALL)
      SELECT po AS PrevOptoEnabled, Region, {q6('avg(i)')} AS incorrect, {q6('avg(c)')} AS correct, {q6('avg(i - c)')} AS difference,
        {q6('stddev_samp(i - c) / sqrt(count(i - c))')} AS difference_sem, count(i - c) AS n_subjects FROM w GROUP BY ALL""",
)
def d43(spark, sf):
    from trialweave.operators import windows as wn

    t = wn.previous_trial(fx.trials(spark, sf), ["Name", "SessionNum"], extra={"PrevOptoEnabled": F.col("OptoEnabled")})
    f = op.feedback_table(t, ["Name"], "calcStimulusTime")
    return f.select("PrevOptoEnabled", "Region", "n_subjects", *[r6(c).alias(c) for c in ("incorrect", "correct", "difference", "difference_sem")])


@query(
    "D56_arm_psychometric",
    f"""SELECT Region, OptoEnabled, bin, {qr('avg(DV)')} AS dv, count(*) AS n, {qr('avg(ChoiceLeft)')} AS outcome, {qr('stddev_samp(ChoiceLeft) / sqrt(count(*))')} AS outcome_sem
      FROM (SELECT *, {_bucket_sql('DV', _PSY)} AS bin FROM {_T} t WHERE ChoiceLeft IS NOT NULL) x WHERE bin IS NOT NULL GROUP BY ALL""",
)
def d56(spark, sf):
    return bh.psychometric_points(_opto(spark, sf), ["Region", "OptoEnabled"], _PSY, "ChoiceLeft")


# ---- statistics -----------------------------------------------------------------------------------------------------

_SPEED = "(SELECT Name, quantile_idx AS q, avg(calcStimulusTime) AS m FROM trials_q WHERE quantile_idx IS NOT NULL GROUP BY ALL)"


def _speed(spark, sf):
    return fx.trials_q(spark, sf).filter("quantile_idx is not null").groupBy("Name", F.col("quantile_idx").alias("q")).agg(F.avg("calcStimulusTime").alias("m"))


@query(
    "G15_paired_t",
    f"""SELECT count(a - b) AS n, {qr('avg(a - b) / (stddev_samp(a - b) / sqrt(count(a - b)))')} AS t_stat FROM
      (SELECT Name, max(m) FILTER (WHERE q = 1) AS a, max(m) FILTER (WHERE q = 3) AS b FROM {_SPEED} s GROUP BY Name) p""",
)
def g15(spark, sf):
    w = bh.by_speed(fx.trials_q(spark, sf).filter("quantile_idx is not null"), ["Name"], "calcStimulusTime")
    a, b = F.col("fast"), F.col("slow")
    return w.agg(F.count(a - b).alias("n"), rnd(bh.paired_t(a, b)).alias("t_stat"))


@query("G15_paired_t_p")
def g15p(spark, sf):
    b = bh.by_speed(fx.trials_prev_q(spark, sf).filter("quantile_idx is not null"), ["Name"], "PrevChoiceCorrect")
    t = b.agg(F.count(E("fast - slow")).alias("n"), bh.paired_t(F.col("fast"), F.col("slow")).alias("t_stat"))
    return t.withColumn("p", tails.p_student("t_stat", F.col("n") - 1))


_ANOVA = f"""WITH d AS (SELECT * FROM {_SPEED} s), c AS (SELECT sum(m) * sum(m) / count(*) AS cf, sum(m * m) AS q, count(DISTINCT Name) AS ns, count(DISTINCT q) AS nc FROM d),
    a AS (SELECT sum(s * s / n) AS a FROM (SELECT Name, sum(m) AS s, count(*) AS n FROM d GROUP BY Name) x),
    b AS (SELECT sum(s * s / n) AS b FROM (SELECT q, sum(m) AS s, count(*) AS n FROM d GROUP BY q) x)"""


@query(
    "G16_repeated_anova",
    f"""{_ANOVA} SELECT {rnd_sql('((b - cf) / (nc - 1)) / ((q - a - b + cf) / ((nc - 1) * (ns - 1)))', 4)} AS f_stat, nc - 1 AS df1, (nc - 1) * (ns - 1) AS df2 FROM a, b, c""",
)
def g16(spark, sf):
    d = _speed(spark, sf).withColumn("fam", F.lit(1))
    return st.repeated_anova(d, ["fam"], "Name", "q", "m").select(rnd("f_stat", 4).alias("f_stat"), "df1", "df2")


@query(
    "G17_one_way_anova",
    f"""WITH d AS (SELECT * FROM {_SPEED} s), g AS (SELECT q, sum(m) AS s, count(*) AS n, sum(m * m) AS qq FROM d GROUP BY q)
      SELECT {qr('((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(qq) - sum(s * s / n)) / (sum(n) - count(*)))')} AS f_stat,
        count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM g""",
)
def g17(spark, sf):
    d = _speed(spark, sf).withColumn("fam", F.lit(1))
    return st.one_way_anova(d, ["fam"], "q", "m").select(rnd("f_stat").alias("f_stat"), "df1", "df2")


# Three speed classes give two degrees of freedom above, for which the tail of F is a power.
_F_TAIL = "pow(df2 / (df2 + 2 * f), df2 / 2.0::DOUBLE)"


@query(
    "G16_repeated_anova_p",
    f"""{_ANOVA}, f AS (SELECT ((b - cf) / (nc - 1)) / ((q - a - b + cf) / ((nc - 1) * (ns - 1))) AS f, nc - 1 AS df1, (nc - 1) * (ns - 1) AS df2 FROM a, b, c)
      SELECT df1, df2, {rnd_sql(_F_TAIL, 6)} AS p FROM f WHERE df1 = 2""",
)
def g16p(spark, sf):
    d = _speed(spark, sf).withColumn("fam", F.lit(1))
    a = st.repeated_anova(d, ["fam"], "Name", "q", "m")
    return a.select("df1", "df2", rnd(tails.p_f("f_stat", "df1", "df2"), 6).alias("p"))


@query(
    "G17_one_way_anova_p",
    f"""WITH d AS (SELECT * FROM {_SPEED} s), g AS (SELECT q, sum(m) AS s, count(*) AS n, sum(m * m) AS qq FROM d GROUP BY q),
      f AS (SELECT ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(qq) - sum(s * s / n)) / (sum(n) - count(*))) AS f, count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM g)
      SELECT df1, df2, {qr(_F_TAIL)} AS p FROM f WHERE df1 = 2""",
)
def g17f(spark, sf):
    d = _speed(spark, sf).withColumn("fam", F.lit(1))
    a = st.one_way_anova(d, ["fam"], "q", "m")
    return a.select("df1", "df2", rnd(tails.p_f("f_stat", "df1", "df2")).alias("p"))


_RANKS = """WITH d AS (SELECT Region, DVstr, calcStimulusTime AS v, rank() OVER (PARTITION BY Region ORDER BY calcStimulusTime)
      + (count(*) OVER (PARTITION BY Region, calcStimulusTime) - 1) / 2.0::DOUBLE AS r FROM trials),
    g AS (SELECT Region, DVstr, count(*) AS ng, sum(r) AS rs FROM d GROUP BY ALL),
    t AS (SELECT Region, sum(c) AS n, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT Region, v, count(*) AS c FROM d GROUP BY ALL) x GROUP BY Region)"""


@query(
    "G17_kruskal_wallis",
    f"""{_RANKS} SELECT Region, {qr('(12.0::DOUBLE / (max(n) * (max(n) + 1)) * sum(rs * rs / ng) - 3 * (max(n) + 1)) / (1 - max(ties) / (max(n)::DOUBLE * max(n) * max(n) - max(n)))')} AS h_stat,
      count(*) - 1 AS df FROM g JOIN t USING (Region) GROUP BY Region""",
)
def g17k(spark, sf):
    r = st.rank_sums(fx.trials(spark, sf), ["Region"], "DVstr", "calcStimulusTime")
    return st.kruskal(r, ["Region"]).withColumn("h_stat", rnd("h_stat"))


_KRUSKAL = "(12.0::DOUBLE / (max(n) * (max(n) + 1)) * sum(rs * rs / ng) - 3 * (max(n) + 1)) / (1 - max(ties) / (max(n)::DOUBLE * max(n) * max(n) - max(n)))"


@query(
    "G17_kruskal_p",  # three groups: the tail of two degrees of freedom is an exponential
    f"""{_RANKS} SELECT Region, {qr('h')} AS h_stat, df, {qr('exp(-h / 2)')} AS p FROM (SELECT Region, {_KRUSKAL} AS h, count(*) - 1 AS df FROM g JOIN t USING (Region) GROUP BY Region) x WHERE df = 2""",
)
def g17p(spark, sf):
    r = st.rank_sums(fx.trials(spark, sf), ["Region"], "DVstr", "calcStimulusTime")
    k = st.kruskal(r, ["Region"]).withColumn("p", tails.p_chi2("h_stat", "df"))
    return k.withColumns({"h_stat": rnd("h_stat"), "p": rnd("p")})


@query(
    "G18_dunn_post_hoc",
    f"""{_RANKS} SELECT a.Region, a.DVstr AS a, b.DVstr AS b, {qr('(a.rs / a.ng - b.rs / b.ng) / sqrt((n::DOUBLE * (n + 1) / 12 - ties / (12 * (n - 1))) * (1.0::DOUBLE / a.ng + 1.0::DOUBLE / b.ng))')} AS z
      FROM g a JOIN g b ON a.Region = b.Region AND a.DVstr < b.DVstr JOIN t ON t.Region = a.Region""",
)
def g18(spark, sf):
    r = st.rank_sums(fx.trials(spark, sf), ["Region"], "DVstr", "calcStimulusTime")
    return st.dunn(r, ["Region"], "DVstr").withColumn("z", rnd("z"))


_DUNN = "(a.rs / a.ng - b.rs / b.ng) / sqrt((n::DOUBLE * (n + 1) / 12 - ties / (12 * (n - 1))) * (1.0::DOUBLE / a.ng + 1.0::DOUBLE / b.ng))"


@query(
    "G18_dunn_holm_p",
    f"""{_RANKS}, z AS (SELECT a.Region, a.DVstr AS a, b.DVstr AS b, {_DUNN} AS z FROM g a JOIN g b ON a.Region = b.Region AND a.DVstr < b.DVstr JOIN t ON t.Region = a.Region),
      p AS (SELECT *, 1 - {erf_sql('abs(z) / sqrt(2.0::DOUBLE)')} AS p FROM z),
      r AS (SELECT *, (count(*) OVER (PARTITION BY Region) - row_number() OVER (PARTITION BY Region ORDER BY p, a, b) + 1) * p AS raw FROM p)
      SELECT Region, a, b, {qr('z')} AS z, {qr('p')} AS p, {qr('least(1.0::DOUBLE, max(raw) OVER (PARTITION BY Region ORDER BY p, a, b))')} AS p_holm FROM r""",
)
def g18p(spark, sf):
    r = st.rank_sums(fx.trials(spark, sf), ["Region"], "DVstr", "calcStimulusTime")
    h = st.holm(st.dunn(r, ["Region"], "DVstr").withColumn("p", tails.p_normal("z")), ["Region"], "p", ["a", "b"])
    return h.select("Region", "a", "b", *[rnd(c).alias(c) for c in ("z", "p", "p_holm")])


# A p-like value per subject and difficulty, with some missing, for the corrections.
_P = """(SELECT Name, DVstr, CASE WHEN count(*) > 12 THEN round(avg(calcStimulusTime) * avg(calcStimulusTime) / 19.37, 9) END AS p FROM trials GROUP BY ALL)"""


def _ps(spark, sf):
    t = fx.trials(spark, sf).groupBy("Name", "DVstr").agg(F.count("*").alias("n"), F.avg("calcStimulusTime").alias("m"))
    return t.select("Name", "DVstr", E("if(n > 12, round(m * m / 19.37D, 9), null)").alias("p"))


@query(
    "G19_holm",
    f"""SELECT Name, DVstr, p, CASE WHEN p IS NOT NULL THEN {qr('least(1.0::DOUBLE, max(raw) OVER (PARTITION BY DVstr, p IS NULL ORDER BY p, Name))')} END AS p_holm FROM
      (SELECT *, (count(p) OVER (PARTITION BY DVstr) - row_number() OVER (PARTITION BY DVstr, p IS NULL ORDER BY p, Name) + 1) * p AS raw FROM {_P} x) y""",
)
def g19(spark, sf):
    return st.holm(_ps(spark, sf), ["DVstr"], "p", ["Name"]).withColumn("p_holm", rnd("p_holm"))


@query(
    "G20_benjamini_hochberg",
    f"""SELECT Name, DVstr, p, {qr('least(1.0::DOUBLE, min(raw) OVER (PARTITION BY DVstr ORDER BY p DESC, Name DESC))')} AS p_bh FROM
      (SELECT *, p * count(*) OVER (PARTITION BY DVstr) / row_number() OVER (PARTITION BY DVstr ORDER BY p, Name) AS raw FROM {_P} x WHERE p IS NOT NULL) y""",
)
def g20(spark, sf):
    p = _ps(spark, sf).filter("p is not null")
    return st.benjamini_hochberg(p, ["DVstr"], "p", ["Name"]).withColumn("p_bh", rnd("p_bh"))


@query(
    "G24_trimmed_mean",
    f"""SELECT DVstr, {qr('avg(calcStimulusTime)')} AS trimmed_mean, count(*) AS n_kept FROM (SELECT *, row_number() OVER (PARTITION BY DVstr ORDER BY calcStimulusTime, event_id) AS r,
      count(*) OVER (PARTITION BY DVstr) AS n FROM trials) t WHERE r > n // 5 AND r <= n - n // 5 GROUP BY DVstr""",
)
def g24(spark, sf):
    t = st.trimmed_mean(fx.trials(spark, sf), ["DVstr"], "calcStimulusTime", 0.2, ["event_id"])
    return t.withColumn("trimmed_mean", rnd("trimmed_mean"))


@query(
    "G24_hodges_lehmann",
    f"""SELECT a.DVstr, count(DISTINCT a.event_id) AS n_left, count(DISTINCT b.event_id) AS n_right, {qr('quantile_cont(a.calcStimulusTime - b.calcStimulusTime, 0.5)')} AS shift
      FROM trials a JOIN trials b ON a.DVstr = b.DVstr AND a.OptoEnabled = 1 AND b.OptoEnabled = 0
      WHERE a.calcStimulusTime IS NOT NULL AND b.calcStimulusTime IS NOT NULL GROUP BY a.DVstr""",
)
def g24h(spark, sf):
    t = fx.trials(spark, sf).filter("DVstr is not null")
    keep = lambda df, name: stored(spark, f"hodges-lehmann {sf} {name}", lambda: df)
    d = st.hodges_lehmann(t, ["DVstr"], "calcStimulusTime", E("OptoEnabled = 1"), keep=keep)
    return d.withColumn("shift", rnd("shift"))


# ---- resampling -----------------------------------------------------------------------------------------------------


def _u(*parts):
    key = " || '|' || ".join(parts)
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


def _draw_sql(tag):
    return f"""ss AS (SELECT Name, SessId, row_number() OVER (PARTITION BY Name ORDER BY {_u('SessId')}, SessId) - 1 AS sess, count(*) OVER (PARTITION BY Name) AS n_sess FROM (SELECT DISTINCT Name, SessId FROM tt) x),
    sb AS (SELECT Name, n_sess, row_number() OVER (ORDER BY {_u('Name')}, Name) - 1 AS subj, count(*) OVER () AS n_subj FROM (SELECT DISTINCT Name, n_sess FROM ss) x),
    it AS (SELECT iter, slot, {_u(f"'{tag}1'", 'iter', 'slot')} % n_subj AS subj FROM (SELECT iter, n_subj, unnest(range(0, n_subj)) AS slot FROM range(0, {ITER}) r(iter), (SELECT max(n_subj) AS n_subj FROM sb) m) y),
    i2 AS (SELECT iter, slot, Name, n_sess, unnest(range(0, n_sess)) AS sess_slot FROM it JOIN sb USING (subj)),
    dr AS (SELECT iter, slot, sess_slot, i2.Name, SessId FROM i2 JOIN ss ON ss.Name = i2.Name AND ss.sess = {_u(f"'{tag}2'", 'iter', 'slot', 'sess_slot')} % i2.n_sess)"""


def _unit(place, *parts):
    """A number in [0, 1) from the ``place``-th 32 bits of a hash."""
    key = " || '|' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({key}), {8 * place + 1}, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _binomial_sql(name, sizes):
    """CTEs up to ``name`` (n, a, b, k, lo, hi): the ranges of a uniform draw for which k of n draws with chance a / b hit."""
    return f"""{name}k AS (SELECT n, a, b, unnest(range(CASE WHEN a >= b THEN n ELSE 0 END, CASE WHEN a = 0 THEN 1 ELSE n + 1 END)) AS k FROM (SELECT DISTINCT n, a, b FROM {sizes}) x),
    {name}l AS (SELECT *, sum(CASE WHEN k = 0 OR a >= b THEN 0.0::DOUBLE ELSE ln((n - k + 1)::DOUBLE * a / (k::DOUBLE * (b - a))) END) OVER (PARTITION BY n, a, b ORDER BY k) AS l FROM {name}k),
    {name}m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY n, a, b)) AS p FROM {name}l),
    {name}c AS (SELECT *, sum(p) OVER (PARTITION BY n, a, b ORDER BY k) / sum(p) OVER (PARTITION BY n, a, b) AS h FROM {name}m),
    {name} AS (SELECT n, a, b, k, coalesce(lag(h) OVER w, 0.0::DOUBLE) AS lo, CASE WHEN lead(k) OVER w IS NULL THEN 2.0::DOUBLE ELSE h END AS hi FROM {name}c WINDOW w AS (PARTITION BY n, a, b ORDER BY k))"""


def _hit(b, n, a, c, u):
    return f"{b}.n = {n} AND {b}.a = {a} AND {b}.b = {c} AND {u} >= {b}.lo AND {u} < {b}.hi"


_G21 = f"""WITH tt AS (SELECT * FROM {_T} t), {_draw_sql('b')},
      ce AS (SELECT Name, SessId, count(*) FILTER (WHERE OptoEnabled = 1 AND ChoiceCorrect = 1) AS o1, count(*) FILTER (WHERE OptoEnabled = 1) AS o,
        count(*) FILTER (WHERE OptoEnabled = 0 AND ChoiceCorrect = 1) AS c1, count(*) FILTER (WHERE OptoEnabled = 0) AS c FROM tt GROUP BY ALL),
      d0 AS (SELECT iter, o, o1, c, c1, o + c AS n, {', '.join(_unit(k, "'b3'", 'iter', 'slot', 'sess_slot') + f' AS u{k}' for k in range(3))} FROM dr JOIN ce USING (Name, SessId)),
      s1 AS (SELECT n, o AS a, n AS b FROM d0), {_binomial_sql('b1', 's1')},
      d1 AS (SELECT d0.*, b1.k AS ko FROM d0 JOIN b1 ON {_hit('b1', 'd0.n', 'o', 'd0.n', 'u0')}),
      s2 AS (SELECT ko AS n, o1 AS a, o AS b FROM d1), {_binomial_sql('b2', 's2')},
      s3 AS (SELECT n - ko AS n, c1 AS a, c AS b FROM d1), {_binomial_sql('b3', 's3')},
      s AS (SELECT iter, sum(b2.k) / nullif(sum(ko), 0)::DOUBLE AS om, sum(b3.k) / nullif(sum(d1.n - ko), 0)::DOUBLE AS cm
        FROM d1 JOIN b2 ON {_hit('b2', 'ko', 'o1', 'o', 'u1')} JOIN b3 ON {_hit('b3', 'd1.n - ko', 'c1', 'c', 'u2')} GROUP BY iter)"""


@query(
    "G21_hierarchical_bootstrap",
    f"""WITH tt AS (SELECT * FROM {_T} t), {_draw_sql('b')},
      ce AS (SELECT Name, SessId, count(*) FILTER (WHERE OptoEnabled = 1 AND ChoiceCorrect = 1) AS o1, count(*) FILTER (WHERE OptoEnabled = 1) AS o,
        count(*) FILTER (WHERE OptoEnabled = 0 AND ChoiceCorrect = 1) AS c1, count(*) AS n FROM tt GROUP BY ALL),
      tr AS (SELECT iter, o, o1, c1, {_u("'b3'", 'iter', 'slot', 'sess_slot', 'k')} % n AS u FROM (SELECT dr.*, o, o1, c1, n, unnest(range(0, n)) AS k FROM dr JOIN ce USING (Name, SessId)) x),
      s AS (SELECT iter, avg(CASE WHEN u < o1 THEN 1 ELSE 0 END) FILTER (WHERE u < o) AS om, avg(CASE WHEN u - o < c1 THEN 1 ELSE 0 END) FILTER (WHERE u >= o) AS cm FROM tr GROUP BY iter)
      SELECT iter, {qr(_gain('cm', 'om'))} AS effect FROM s""",
)
def g21(spark, sf):
    b = rs.hierarchical_bootstrap(spark, _opto(spark, sf), ITER, each_trial=True)
    return b.withColumn("effect", rnd("effect"))


@query(
    "G21_bootstrap_sign_p",
    f"""{_G21}, b AS (SELECT {_gain('cm', 'om')} AS e FROM s), m AS (SELECT {_C} AS cm, {_O} AS om FROM tt), o AS (SELECT {_gain('cm', 'om')} AS observed FROM m)
      SELECT {qr('observed')} AS observed, {qr('CASE WHEN observed = 0 THEN 1.0 ELSE least(1.0::DOUBLE, 2 * count(*) FILTER (WHERE (observed > 0 AND e < 0) OR (observed < 0 AND e > 0)) / count(e)::DOUBLE) END')} AS p
      FROM b, o GROUP BY observed""",
)
def g21p(spark, sf):
    t = _opto(spark, sf)
    c, o = op.arm_mean("ChoiceCorrect", 0), op.arm_mean("ChoiceCorrect", 1)
    obs = t.agg(op.effect_size(c, o).alias("observed")).withColumn("j", F.lit(1))
    b = rs.hierarchical_bootstrap(spark, t, ITER).withColumn("j", F.lit(1)).join(obs, "j")
    p = b.groupBy("observed").agg(rs.sign_p(F.col("observed"), F.col("effect")).alias("p"))
    return p.select(rnd("observed").alias("observed"), rnd("p").alias("p"))


_E9 = "round(-100 * (om / nullif(cm, 0) - 1), 9)"
_G22 = f"""WITH tt AS (SELECT * FROM {_T} t), {_draw_sql('r')},
    ce AS (SELECT Name, SessId, Region, Phase, count(*) FILTER (WHERE OptoEnabled = 1 AND ChoiceCorrect = 1) AS o1, count(*) FILTER (WHERE OptoEnabled = 1) AS o,
      count(*) FILTER (WHERE OptoEnabled = 0 AND ChoiceCorrect = 1) AS c1, count(*) FILTER (WHERE OptoEnabled = 0) AS c FROM tt GROUP BY ALL),
    se AS (SELECT SessId, Region, Phase, {_E9} AS effect FROM (SELECT *, c1 / nullif(c, 0)::DOUBLE AS cm, o1 / nullif(o, 0)::DOUBLE AS om FROM ce) x),
    ob AS (SELECT Phase, Region AS stat, avg(e) AS value FROM (SELECT Name, Region, Phase, {_E9} AS e FROM (SELECT Name, Region, Phase, sum(c1) / nullif(sum(c), 0)::DOUBLE AS cm, sum(o1) / nullif(sum(o), 0)::DOUBLE AS om FROM ce GROUP BY ALL) x) y WHERE e IS NOT NULL GROUP BY ALL),
    tm AS (SELECT Phase, Region, avg(effect) AS t FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY Phase, Region) AS n FROM se WHERE effect IS NOT NULL WINDOW w AS (PARTITION BY Phase, Region ORDER BY effect, SessId)) x WHERE r > n // 5 AND r <= n - n // 5 GROUP BY ALL),
    oo AS (SELECT * FROM ob UNION ALL SELECT Phase, 'Delta', max(t) FILTER (WHERE Region = 'MFC') - max(t) FILTER (WHERE Region = 'LFC') FROM tm GROUP BY Phase),
    ar AS (SELECT iter, slot, Region, Phase, o, o1, c, c1, {_unit(0, "'r3'", 'iter', 'slot', 'sess_slot', 'Region', 'Phase')} AS u0, {_unit(1, "'r3'", 'iter', 'slot', 'sess_slot', 'Region', 'Phase')} AS u1
      FROM dr JOIN ce USING (Name, SessId)),
    s1 AS (SELECT o AS n, o1 AS a, o AS b FROM ce UNION SELECT c, c1, c FROM ce), {_binomial_sql('b1', 's1')},
    be AS (SELECT iter, Phase, Region, {_E9} AS e FROM (SELECT iter, slot, Region, Phase, sum(y.k) / nullif(sum(c), 0)::DOUBLE AS cm, sum(x.k) / nullif(sum(o), 0)::DOUBLE AS om
      FROM ar JOIN b1 x ON {_hit('x', 'o', 'o1', 'o', 'u0')} JOIN b1 y ON {_hit('y', 'c', 'c1', 'c', 'u1')} GROUP BY ALL) x),
    sx AS (SELECT *, row_number() OVER (PARTITION BY Phase, Region ORDER BY {_u('SessId')}, SessId) - 1 AS i, count(*) OVER (PARTITION BY Phase, Region) AS n FROM se),
    sl AS (SELECT *, unnest(range(0, n)) AS slot FROM (SELECT DISTINCT Phase, Region, n FROM sx) x, range(0, {ITER}) r(iter)),
    pk AS (SELECT iter, slot, sl.Phase, sl.Region, effect FROM sl JOIN sx ON sx.Phase = sl.Phase AND sx.Region = sl.Region AND sx.i = {_u("'r4'", 'iter', 'sl.Phase', 'sl.Region', 'slot')} % sl.n),
    tb AS (SELECT iter, Phase, Region, avg(effect) AS t FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY iter, Phase, Region) AS n FROM pk WHERE effect IS NOT NULL WINDOW w AS (PARTITION BY iter, Phase, Region ORDER BY effect, slot)) x WHERE r > n // 5 AND r <= n - n // 5 GROUP BY ALL),
    bb AS (SELECT iter, Phase, Region AS stat, avg(e) AS value FROM be WHERE e IS NOT NULL GROUP BY ALL
      UNION ALL SELECT iter, Phase, 'Delta', max(t) FILTER (WHERE Region = 'MFC') - max(t) FILTER (WHERE Region = 'LFC') FROM tb GROUP BY iter, Phase),
    rr AS (SELECT Phase, stat, oo.value AS observed, stddev_samp(bb.value) AS sd, quantile_cont(bb.value, 0.025) AS ci_low, quantile_cont(bb.value, 0.975) AS ci_high,
      least(1.0::DOUBLE, 2 * count(*) FILTER (WHERE (oo.value > 0 AND bb.value < 0) OR (oo.value < 0 AND bb.value > 0)) / count(*)::DOUBLE) AS p FROM bb JOIN oo USING (Phase, stat) GROUP BY ALL)
    SELECT Phase, stat, {qr('observed')} AS observed, {qr('sd')} AS sd, {qr('ci_low')} AS ci_low, {qr('ci_high')} AS ci_high, {qr('p')} AS p,
      {qr('least(1.0::DOUBLE, max(raw) OVER (PARTITION BY Phase ORDER BY p, stat))')} AS p_holm FROM (SELECT *, (count(*) OVER (PARTITION BY Phase) - row_number() OVER (PARTITION BY Phase ORDER BY p, stat) + 1) * p AS raw FROM rr) z"""


@query("G22_two_region_bootstrap", _G22)
def g22(spark, sf):
    keep = lambda name, df: stored(spark, f"two regions {name}|{sf}", lambda: df)
    r = rs.two_region_bootstrap(spark, _opto(spark, sf), ITER, keep)
    return r.select("Phase", "stat", *[rnd(c).alias(c) for c in ("observed", "sd", "ci_low", "ci_high", "p", "p_holm")])


ITER_MAX = 1000
_EFF = "round(sum(r - k) / nullif(sum(n - o), 0)::DOUBLE - sum(k) / nullif(sum(o), 0)::DOUBLE, 9)"
_STATS = """avg(effect) FILTER (WHERE Region = 'MFC') AS m, avg(effect) FILTER (WHERE Region = 'LFC') AS l,
        CASE WHEN count(*) FILTER (WHERE Region = 'MFC') >= 2 AND count(*) FILTER (WHERE Region = 'LFC') >= 2
          THEN avg(effect) FILTER (WHERE Region = 'MFC') - avg(effect) FILTER (WHERE Region = 'LFC') END AS x"""


@query(
    "G23_max_statistic_permutation",
    f"""WITH tt AS (SELECT * FROM {_T} t),
      ce AS (SELECT Name, SessId, Region, Phase, count(*) AS n, count(*) FILTER (WHERE ChoiceCorrect = 1) AS r, count(*) FILTER (WHERE OptoEnabled = 1) AS o,
        count(*) FILTER (WHERE OptoEnabled = 1 AND ChoiceCorrect = 1) AS k FROM tt GROUP BY ALL),
      en AS (SELECT Name, Region, Phase, {_EFF} AS effect FROM ce GROUP BY ALL HAVING effect IS NOT NULL),
      om AS (SELECT Phase, {_STATS} FROM en GROUP BY Phase),
      ob AS (SELECT * FROM (SELECT Phase, 'MFC' AS stat, m AS value FROM om UNION ALL SELECT Phase, 'LFC', l FROM om UNION ALL SELECT Phase, 'crossregion', x FROM om) y WHERE value IS NOT NULL),
      de AS (SELECT Name, SessId, Region, Phase, n, r, o FROM ce WHERE o > 0 AND o < n),
      ks AS (SELECT n, r, o, unnest(range(greatest(0, o - (n - r)), least(o, r) + 1)) AS k FROM (SELECT DISTINCT n, r, o FROM de) d),
      ra AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY n, r, o ORDER BY k) = 1 THEN 0.0::DOUBLE ELSE ln((r - k + 1)::DOUBLE * (o - k + 1) / (k::DOUBLE * (n - r - o + k))) END AS l FROM ks),
      cu AS (SELECT *, sum(l) OVER (PARTITION BY n, r, o ORDER BY k) AS s FROM ra),
      pm AS (SELECT *, exp(s - max(s) OVER (PARTITION BY n, r, o)) AS p FROM cu),
      hi AS (SELECT *, sum(p) OVER (PARTITION BY n, r, o ORDER BY k) / sum(p) OVER (PARTITION BY n, r, o) AS h FROM pm),
      tb AS (SELECT n, r, o, k, coalesce(lag(h) OVER w, 0.0::DOUBLE) AS lo, CASE WHEN lead(k) OVER w IS NULL THEN 2.0::DOUBLE ELSE h END AS hi FROM hi WINDOW w AS (PARTITION BY n, r, o ORDER BY k)),
      it AS (SELECT *, {_u("'p1'", 'iter', 'SessId', 'Region', 'Phase')} / 4294967296.0::DOUBLE AS u FROM de, range(0, {ITER_MAX}) q(iter)),
      ne AS (SELECT iter, Name, Region, Phase, {_EFF} AS effect FROM (SELECT it.*, tb.k FROM it JOIN tb ON it.n = tb.n AND it.r = tb.r AND it.o = tb.o AND u >= lo AND u < hi) z GROUP BY iter, Name, Region, Phase HAVING effect IS NOT NULL),
      pr AS (SELECT *, count(*) OVER (PARTITION BY iter, Name, Phase) = 2 AS paired, {_u("'p2'", 'iter', 'Phase', 'Name')} AS u FROM ne),
      lb AS (SELECT iter, Phase, effect, CASE WHEN u < 2147483648 THEN CASE WHEN Region = 'MFC' THEN 'LFC' ELSE 'MFC' END ELSE Region END AS Region FROM pr WHERE paired
        UNION ALL SELECT iter, Phase, effect, CASE WHEN row_number() OVER (PARTITION BY iter, Phase ORDER BY u, Name) <= count(*) FILTER (WHERE Region = 'MFC') OVER (PARTITION BY iter, Phase) THEN 'MFC' ELSE 'LFC' END FROM pr WHERE NOT paired),
      nm AS (SELECT iter, Phase, {_STATS} FROM lb GROUP BY ALL),
      nv AS (SELECT iter, Phase, greatest(abs(m), abs(l), abs(x)) AS t FROM nm),
      tp AS (SELECT iter, Phase AS scope, round(t, 9) AS top FROM nv WHERE t IS NOT NULL UNION ALL SELECT iter, 'both', round(max(t), 9) FROM nv WHERE t IS NOT NULL GROUP BY iter),
      pv AS (SELECT o.Phase, stat, value, (1 + count(*) FILTER (WHERE top >= round(abs(value), 9) AND scope <> 'both')) / (1 + count(*) FILTER (WHERE scope <> 'both'))::DOUBLE AS pp,
        (1 + count(*) FILTER (WHERE top >= round(abs(value), 9) AND scope = 'both')) / (1 + count(*) FILTER (WHERE scope = 'both'))::DOUBLE AS pg
        FROM ob o JOIN tp ON scope = o.Phase OR scope = 'both' GROUP BY o.Phase, stat, value)
      SELECT Phase, stat, {qr('value')} AS observed, {qr('pp')} AS p_adjusted, {qr('pg')} AS p_global FROM pv""",
)
def g23(spark, sf):
    r = rs.max_statistic_permutation(spark, _opto(spark, sf), ITER_MAX)
    return r.select("Phase", "stat", *[rnd(c).alias(c) for c in ("observed", "p_adjusted", "p_global")])


@query(
    "G6_auc_permutation",
    f"""WITH d AS (SELECT Region, calcStimulusTime AS v, event_id, OptoEnabled AS o, count(*) FILTER (WHERE OptoEnabled = 1) OVER (PARTITION BY Region) AS nl FROM {_T} t),
      s AS (SELECT -1 AS iter, Region, v, o = 1 AS l FROM d UNION ALL SELECT iter, Region, v, row_number() OVER (PARTITION BY iter, Region ORDER BY {_u("'auc'", 'iter', 'event_id')}, event_id) <= nl FROM d, range(0, {ITER}) r(iter)),
      r AS (SELECT *, rank() OVER (PARTITION BY iter, Region ORDER BY v) + (count(*) OVER (PARTITION BY iter, Region, v) - 1) / 2.0::DOUBLE AS rk FROM s),
      a AS (SELECT iter, Region, (sum(rk) FILTER (WHERE l) - count(*) FILTER (WHERE l) * (count(*) FILTER (WHERE l) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE l) * count(*) FILTER (WHERE NOT l)) AS auc FROM r GROUP BY ALL),
      o AS (SELECT Region, auc AS observed FROM a WHERE iter = -1)
      SELECT Region, {qr('observed')} AS observed, {qr('(1 + count(*) FILTER (WHERE abs(auc - 0.5) >= abs(observed - 0.5) - 1e-12)) / (1 + count(*))::DOUBLE')} AS p FROM a JOIN o USING (Region) WHERE iter >= 0 GROUP BY Region, observed""",
)
def g6(spark, sf):
    r = rs.auc_permutation(_opto(spark, sf), ["Region"], "calcStimulusTime", F.col("OptoEnabled") == 1, "event_id", ITER)
    return r.select("Region", rnd("observed").alias("observed"), rnd("p").alias("p"))


@query(
    "D32_bootstrap_with_replacement",
    f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY Region ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY Region) AS n FROM trials),
      s AS (SELECT Region, n, sample, unnest(range(0, n)) AS slot FROM (SELECT DISTINCT Region, n FROM x) y, range(0, 3) r(sample))
      SELECT s.Region, sample, {qr('avg(calcStimulusTime)')} AS mean, count(*) AS n FROM s JOIN x ON x.Region = s.Region AND x.i = {_u("'boot'", 'sample', 's.Region', 'slot')} % s.n GROUP BY ALL""",
)
def d32(spark, sf):
    b = rs.bootstrap_rows(fx.trials(spark, sf), ["Region"], "event_id", 3, True)
    return b.groupBy("Region", "sample").agg(rnd(F.avg("calcStimulusTime")).alias("mean"), F.count("*").alias("n"))


@query(
    "D32_bootstrap_without_replacement",
    f"""SELECT Region, sample, {qr('avg(calcStimulusTime)')} AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample, Region ORDER BY {_u("'boot'", 'sample', 'event_id')}, event_id) AS rn,
      count(*) OVER (PARTITION BY sample, Region) AS n FROM trials, range(0, 3) r(sample)) x WHERE rn <= floor(n * 0.5) GROUP BY ALL""",
)
def d32n(spark, sf):
    b = rs.bootstrap_rows(fx.trials(spark, sf), ["Region"], "event_id", 3, False, 0.5)
    return b.groupBy("Region", "sample").agg(rnd(F.avg("calcStimulusTime")).alias("mean"), F.count("*").alias("n"))


@query(
    "D50_session_resampling",
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY SessId ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY SessId) AS n FROM trials WHERE valid),
      s AS (SELECT Name, SessId, n, row_number() OVER (PARTITION BY Name ORDER BY {_u('SessId')}, SessId) - 1 AS sess, count(*) OVER (PARTITION BY Name) AS ns FROM (SELECT DISTINCT Name, SessId, n FROM v) x),
      w AS (SELECT Name, ns, unnest(range(0, ns * 2)) AS new_sess FROM (SELECT DISTINCT Name, ns FROM s) x),
      p AS (SELECT w.Name, new_sess, SessId, n, unnest(range(0, n)) AS k FROM w JOIN s ON s.Name = w.Name AND s.sess = {_u("'rs1'", 'w.Name', 'new_sess')} % w.ns)
      SELECT p.Name, new_sess, o.TrialNumber, {qr(f"2 * ({_u(chr(39) + 'rs3' + chr(39), 'p.Name', 'new_sess', 'k')} / 4294967296.0::DOUBLE) - 1")} AS DV, d.calcStimulusTime, d.ChoiceCorrect
      FROM p JOIN v o ON o.SessId = p.SessId AND o.i = k JOIN v d ON d.SessId = p.SessId AND d.i = {_u("'rs2'", 'p.Name', 'new_sess', 'k')} % p.n""",
)
def d50(spark, sf):
    return rs.resample_sessions(spark, fx.trials(spark, sf), 2, random_dv=True).withColumn("DV", rnd("DV"))
