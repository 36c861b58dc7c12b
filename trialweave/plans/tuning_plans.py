"""Single-neuron tuning queries (G1–G14, G28, and the joins and sets that serve them)."""

from pyspark.sql import functions as F

from trialweave.functions import draws, skew
from trialweave.operators import behavior as bh
from trialweave.operators import tuning as tu
from trialweave.operators.behavior import r6, rnd
from trialweave.operators.tuning import TEST, TRACE
from trialweave.plans.registry import query
from trialweave.plans.trace_plans import _POS, _pos
from trialweave.sources import fixtures as fx
from trialweave.sources.sql_views import q6
from trialweave.sources.sql_views import rnd as qr

E = F.expr
PRIORS = ("PrevChoiceLeft", "PrevChoiceCorrect")
_TEST = ", ".join(TEST)
# Eight trials per trace: an area this far from one half stands in for a significant test.
_SIG = "abs(auc - 0.5) >= 0.4"


def _sig():
    return E(_SIG)


def _tests(spark, sf, conditions=tu.CONDITIONS, priors=PRIORS, speed=True, **kw):
    return tu.condition_tests(tu.tag_conditions(fx.reduc(spark, sf), conditions, priors, speed), **kw)


_LEFT = "(SELECT * FROM tests WHERE data_col = 'ChoiceLeft' AND prior_col = 'none' AND quantile = 'All')"


def _left(spark, sf):
    return _tests(spark, sf, ("ChoiceLeft",), (), False)


@query("B26_split_conditions", "SELECT data_col, side, prior_col, prior_val, quantile, count(*) AS n FROM conds GROUP BY ALL")
def b26(spark, sf):
    t = tu.tag_conditions(fx.reduc(spark, sf), tu.CONDITIONS, PRIORS, True)
    return t.groupBy("data_col", "side", "prior_col", "prior_val", "quantile").agg(F.count("*").alias("n"))


@query(
    "B29_side_split",
    "SELECT ShortName, trace_id, TrialNumber, x, side FROM conds WHERE data_col = 'ChoiceLeft' AND prior_col = 'PrevChoiceCorrect' AND prior_val = '1' AND quantile = 'All'",
)
def b29(spark, sf):
    t = tu.tag_conditions(fx.reduc(spark, sf), ("ChoiceLeft",), ("PrevChoiceCorrect",))
    return t.filter("prior_col = 'PrevChoiceCorrect' and prior_val = '1'").select(*TRACE, "TrialNumber", "x", "side")


@query("G1_trial_reduction", f"SELECT ShortName, trace_id, TrialNumber, {qr('avg(v)')} AS mean, max(v) AS max FROM {_POS} p GROUP BY ALL")
def g1(spark, sf):
    return _pos(spark, sf).groupBy(*TRACE, "TrialNumber").agg(rnd(F.avg("v")).alias("mean"), F.max("v").alias("max"))


@query("G2_first_component")
def g2(spark, sf):
    """Scores over the whole slice of each trial."""
    return tu.first_component(_pos(spark, sf))


@query(
    "G3_condition_test",
    f"SELECT {_TEST}, left_mean, right_mean, left_median, right_median, n_left, n_right FROM tests WHERE quantile = 'All'",
)
def g3(spark, sf):
    t = _tests(spark, sf, speed=False, medians=True)
    return t.select(*TEST, "left_mean", "right_mean", "left_median", "right_median", "n_left", "n_right")


@query("G4_mann_whitney_u", f"SELECT {_TEST}, n_left, n_right, u FROM tests WHERE prior_col = 'none'")
def g4(spark, sf):
    return _tests(spark, sf, priors=()).select(*TEST, "n_left", "n_right", "u")


@query("G4_mann_whitney_p")
def g4p(spark, sf):
    return tu.with_p(_tests(spark, sf, priors=())).select(*TEST, "u", "pval")


@query("G5_roc_area", f"SELECT {_TEST}, {qr('auc')} AS auc FROM tests WHERE prior_col = 'none' AND quantile = 'All'")
def g5(spark, sf):
    return _tests(spark, sf, priors=(), speed=False).select(*TEST, rnd("auc").alias("auc"))


@query("G5_roc_area_big", """WITH r AS (SELECT Region, ChoiceCorrect AS c, rank() OVER (PARTITION BY Region ORDER BY calcStimulusTime)
      + (count(*) OVER (PARTITION BY Region, calcStimulusTime) - 1) / 2.0::DOUBLE AS rk FROM trials WHERE ChoiceCorrect IS NOT NULL),
    g AS (SELECT Region, sum(rk) FILTER (WHERE c = 1) AS rs, count(*) FILTER (WHERE c = 1) AS a, count(*) FILTER (WHERE c = 0) AS b FROM r GROUP BY Region)
    SELECT Region, """ + qr("(rs - a * (a + 1) / 2.0::DOUBLE) / (a * b)") + " AS auc FROM g")
def g5b(spark, sf):
    from trialweave.operators import stats as st

    r = st.rank_test(fx.trials(spark, sf), ["Region"], "calcStimulusTime", F.col("ChoiceCorrect") == 1)
    return r.select("Region", rnd("auc").alias("auc"))


@query("G7_test_matrix", f"SELECT {_TEST}, n_left, n_right, {qr('auc')} AS auc FROM tests")
def g7(spark, sf):
    return _tests(spark, sf).select(*TEST, "n_left", "n_right", rnd("auc").alias("auc"))


@query("G8_run_bundle")
def g8(spark, sf):
    """Tests, p-values and areas, once with the given and once with shuffled speed classes."""
    r = fx.reduc(spark, sf)
    lab = r.select("ShortName", "TrialNumber", "quantile_idx").distinct()
    u = draws.u32(F.lit("shuffle"), F.col("ShortName"), F.col("TrialNumber"))
    a = skew.number_rows(lab, ["ShortName"], [F.col("TrialNumber")], skew.position_block(F.col("TrialNumber")), "n")
    b = skew.number_rows(lab.withColumn("u", u), ["ShortName"], [F.col("u"), F.col("TrialNumber")], F.shiftright("u", 20), "n")
    deal = a.select("ShortName", "TrialNumber", "n").join(b.select("ShortName", "n", F.col("quantile_idx").alias("q")), ["ShortName", "n"])
    mixed = r.join(deal.select("ShortName", "TrialNumber", "q"), ["ShortName", "TrialNumber"]).withColumn("quantile_idx", F.col("q")).drop("q")
    both = r.withColumn("shuffled", F.lit(False)).unionByName(mixed.withColumn("shuffled", F.lit(True)))
    # The shuffled copy is tested apart by carrying its flag in the trace key.
    both = both.withColumn("ShortName", E("if(shuffled, concat(ShortName, '#s'), ShortName)")).drop("shuffled")
    t = tu.with_p(tu.condition_tests(tu.tag_conditions(both, ("ChoiceLeft",), (), True)))
    t = t.withColumn("shuffled", E("ShortName like '%#s'"))
    return t.withColumn("ShortName", E("replace(ShortName, '#s', '')")).select(*TEST, "shuffled", "u", "pval", "auc")


@query(
    "G9_result_labels",
    f"""SELECT {_TEST}, left_mean > right_mean AS left_by_mean, left_median > right_median AS left_by_median, u > n_left * n_right - u AS left_by_u,
      auc >= 0.5 AS left_by_auc, replace(regexp_replace(data_col, '^Prev', 'Previous '), 'Choice', 'Choice ') AS name FROM tests WHERE prior_col = 'none' AND quantile = 'All'""",
)
def g9(spark, sf):
    t = tu.label_tests(_tests(spark, sf, priors=(), speed=False, medians=True))
    return t.select(*TEST, "left_by_mean", "left_by_median", "left_by_u", "left_by_auc", "name")


_SHARE = f"count(*) FILTER (WHERE {_SIG}) AS n_significant, count(*) FILTER (WHERE {_SIG} AND auc > 0.5) AS n_left_pref, count(*) FILTER (WHERE {_SIG} AND NOT auc > 0.5) AS n_right_pref, count(*) AS n_total, {qr(f'100.0 * count(*) FILTER (WHERE {_SIG}) / count(*)')} AS percent"


@query("G10_significance_percent", f"SELECT ShortName, BrainRegion, data_col, {_SHARE} FROM tests WHERE prior_col = 'none' AND quantile = 'All' GROUP BY ALL")
def g10(spark, sf):
    t = _tests(spark, sf, priors=(), speed=False)
    return tu.significant_share(t, _sig(), ["ShortName", "BrainRegion", "data_col"]).withColumn("percent", rnd("percent"))


@query(
    "G11_quantile_curve",
    f"""WITH s AS (SELECT ShortName, BrainRegion, quantile, data_col, {_SHARE} FROM tests WHERE prior_col = 'none' AND quantile <> 'All' GROUP BY ALL)
      SELECT BrainRegion, quantile, data_col, {qr('avg(percent)')} AS mean, {qr('stddev_samp(percent) / sqrt(count(*))')} AS sem, count(*) AS n_sessions,
        {qr('100.0 * sum(n_significant) / sum(n_total)')} AS pooled FROM s WHERE n_total >= 5 GROUP BY ALL""",
)
def g11(spark, sf):
    t = _tests(spark, sf, priors=()).filter("quantile != 'All'")
    s = tu.significant_share(t, _sig(), ["ShortName", "BrainRegion", "quantile", "data_col"]).withColumn("percent", rnd("percent"))
    out = tu.share_over_sessions(s, ["BrainRegion", "quantile", "data_col"], 5)
    return out.select("BrainRegion", "quantile", "data_col", "n_sessions", *[rnd(c).alias(c) for c in ("mean", "sem", "pooled")])


@query(
    "G12_region_distribution",
    f"""WITH s AS (SELECT ShortName, BrainRegion, Layer, CASE WHEN data_col LIKE 'Prev%' THEN 'previous' ELSE 'current' END AS period, {_SHARE} FROM tests
        WHERE prior_col = 'none' AND quantile = 'All' GROUP BY ALL)
      SELECT BrainRegion, Layer, period, {qr('avg(percent)')} AS mean, {qr('avg(n_left_pref / nullif(n_significant, 0)::DOUBLE)')} AS left_share,
        {qr('avg(n_significant::DOUBLE / mx)')} AS of_max, count(*) AS n_sessions FROM (SELECT *, nullif(max(n_significant) OVER (PARTITION BY ShortName), 0) AS mx FROM s) q GROUP BY ALL""",
)
def g12(spark, sf):
    t = _tests(spark, sf, priors=(), speed=False).withColumn("period", E("if(data_col like 'Prev%', 'previous', 'current')"))
    s = tu.significant_share(t, _sig(), ["ShortName", "BrainRegion", "Layer", "period"]).withColumn("percent", rnd("percent"))
    mx = s.groupBy("ShortName").agg(F.max("n_significant").alias("mx"))
    j = s.join(mx, "ShortName")
    return j.groupBy("BrainRegion", "Layer", "period").agg(
        rnd(F.avg("percent")).alias("mean"), rnd(F.avg(E("n_left_pref / nullif(n_significant, 0)"))).alias("left_share"),
        rnd(F.avg(E("n_significant / nullif(mx, 0)"))).alias("of_max"), F.count("*").alias("n_sessions"),
    )


_FLAGS = f"""(SELECT ShortName, trace_id, BrainRegion, coalesce(bool_or({_SIG} AND prior_col = 'none' AND data_col NOT LIKE 'Prev%'), false) AS current_sig,
      coalesce(bool_or({_SIG} AND prior_col = 'none' AND data_col LIKE 'Prev%'), false) AS previous_sig,
      coalesce(bool_or({_SIG} AND prior_col = 'PrevChoiceLeft'), false) AS prior_sig,
      coalesce(bool_or({_SIG} AND prior_col = 'none' AND data_col = 'ChoiceLeft'), false) AS choice_sig, coalesce(bool_or(greatest(left_mean, right_mean) > 0.05), false) AS active
    FROM tests WHERE quantile = 'All' GROUP BY ALL)"""


def _flags(spark, sf):
    none, prev = F.col("prior_col") == "none", F.col("data_col").startswith("Prev")
    flags = {
        "current_sig": _sig() & none & ~prev,
        "previous_sig": _sig() & none & prev,
        "prior_sig": _sig() & (F.col("prior_col") == "PrevChoiceLeft"),
        "choice_sig": _sig() & none & (F.col("data_col") == "ChoiceLeft"),
        "active": F.greatest("left_mean", "right_mean") > 0.05,
    }
    return tu.trace_flags(_tests(spark, sf, speed=False), flags, [*TRACE, "BrainRegion"])


@query(
    "G13_selectivity_classes",
    f"""SELECT BrainRegion, CASE WHEN current_sig AND previous_sig THEN 'multiplexed' WHEN current_sig THEN 'current' WHEN previous_sig THEN 'previous' ELSE 'ns' END AS class,
      count(*) AS n FROM {_FLAGS} f GROUP BY ALL""",
)
def g13(spark, sf):
    cls = E("case when current_sig and previous_sig then 'multiplexed' when current_sig then 'current' when previous_sig then 'previous' else 'ns' end")
    return _flags(spark, sf).groupBy("BrainRegion", cls.alias("class")).agg(F.count("*").alias("n"))


_SCOPE = "(CASE WHEN prior_col = 'none' THEN 0 WHEN prior_val = '0' THEN 1 WHEN prior_val = '1' THEN 2 END)"
_PRIOR_CLASS = f"""(SELECT ShortName, trace_id, BrainRegion, data_col, prior, CASE WHEN b AND z THEN 'both_priors_and_no_prior' WHEN b THEN 'both_priors_only' WHEN o AND z THEN 'one_prior_and_no_prior'
      WHEN o THEN 'one_prior_only' WHEN z THEN 'only_no_prior' ELSE 'not_significant' END AS class
    FROM (SELECT *, x AND y AS b, x OR y AS o FROM (SELECT ShortName, trace_id, BrainRegion, data_col, prior, bool_or({_SIG}) FILTER (WHERE scope = 0) AS z, bool_or({_SIG}) FILTER (WHERE scope = 1) AS x,
        bool_or({_SIG}) FILTER (WHERE scope = 2) AS y FROM (SELECT *, {_SCOPE} AS scope FROM tests, (VALUES ('PrevChoiceLeft'), ('PrevChoiceCorrect')) p(prior)
          WHERE quantile = 'All' AND prior_col IN ('none', prior)) q WHERE scope IS NOT NULL GROUP BY ALL) w WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL) v)"""


@query("G13_prior_classes", f"SELECT prior, BrainRegion, data_col, class, count(*) AS n FROM {_PRIOR_CLASS} c GROUP BY ALL")
def g13p(spark, sf):
    t = _tests(spark, sf, speed=False)
    rows = [tu.prior_signatures(t, _sig(), p).select("*", F.lit(p).alias("prior"), tu.prior_class(F.col("signature")).alias("class")) for p in PRIORS]
    return rows[0].unionByName(rows[1]).filter("class is not null").groupBy("prior", "BrainRegion", "data_col", "class").agg(F.count("*").alias("n"))


@query("G14_selection_matrix", f"SELECT prior_sig, choice_sig, active, current_sig, count(*) AS n FROM {_FLAGS} f GROUP BY CUBE (prior_sig, choice_sig, active, current_sig)")
def g14(spark, sf):
    return _flags(spark, sf).cube("prior_sig", "choice_sig", "active", "current_sig").agg(F.count("*").alias("n"))


@query(
    "U3_prior_current_overlap",
    f"""SELECT ShortName, {qr('100.0 * count(*) FILTER (WHERE current_sig AND previous_sig) / count(*)')} AS overlap, count(*) AS n FROM {_FLAGS} f WHERE active GROUP BY ShortName""",
)
def u3(spark, sf):
    f = _flags(spark, sf).filter("active")
    both = F.count_if(F.col("current_sig") & F.col("previous_sig"))
    return f.groupBy("ShortName").agg(rnd(100.0 * both / F.count("*")).alias("overlap"), F.count("*").alias("n"))


@query(
    "U4_in_overall_intersection",
    f"""SELECT ShortName, trace_id, data_col, quantile FROM tests t WHERE quantile <> 'All' AND prior_col = 'none' AND {_SIG} AND EXISTS (SELECT 1 FROM tests o
      WHERE o.quantile = 'All' AND o.prior_col = 'none' AND abs(o.auc - 0.5) >= 0.3 AND o.ShortName = t.ShortName AND o.trace_id = t.trace_id AND o.data_col = t.data_col)""",
)
def u4(spark, sf):
    t = _tests(spark, sf, priors=())
    keys = [*TRACE, "data_col"]
    overall = t.filter(F.col("quantile") == "All").filter(F.abs(F.col("auc") - 0.5) >= 0.3).select(*keys)
    return t.filter("quantile != 'All'").filter(_sig()).join(overall, keys, "left_semi").select(*keys, "quantile")


@query("C4_stats_roc_merge", f"SELECT {_TEST}, u, {qr('auc')} AS statistic_roc, n_left AS n_left_roc, auc > 0.5 AS IsROCLeftTuned FROM tests WHERE quantile = 'All'")
def c4(spark, sf):
    t = _tests(spark, sf, speed=False)
    m = tu.merge_roc(t.select(*TEST, "u"), t.select(*TEST, "auc", "n_left", "n_right"))
    return m.select(*TEST, "u", rnd("statistic_roc").alias("statistic_roc"), "n_left_roc", "IsROCLeftTuned")


@query("C5_region_assignment", "SELECT DISTINCT f.ShortName, f.trace_id, e.BrainRegion FROM frames f JOIN (SELECT DISTINCT ShortName, BrainRegion FROM epochs) e USING (ShortName)")
def c5(spark, sf):
    f = fx.frames(spark, sf).select(*TRACE).distinct().withColumn("BrainRegion", E("if(trace_id % 3 = 0, null, if(ShortName in ('N0', 'N2', 'N4', 'N6', 'N8'), 'M2_Bi', 'ALM_Bi'))"))
    return tu.fill_region(f, fx.epochs(spark, sf)).select(*TRACE, "BrainRegion")


@query(
    "C11_three_way_merge",
    f"""SELECT a.ShortName, a.trace_id, a.BrainRegion, a.Layer, {qr('a.auc')} AS auc_left, {qr('b.auc')} AS auc_right, {qr('n.auc')} AS auc_none FROM tests a
      JOIN tests b ON b.ShortName = a.ShortName AND b.trace_id = a.trace_id AND b.data_col = a.data_col AND b.prior_col = a.prior_col AND b.prior_val = '0' AND b.quantile = 'All'
      JOIN tests n ON n.ShortName = a.ShortName AND n.trace_id = a.trace_id AND n.data_col = a.data_col AND n.prior_col = 'none' AND n.quantile = 'All'
      WHERE a.data_col = 'Difficulty' AND a.prior_col = 'PrevChoiceLeft' AND a.prior_val = '1' AND a.quantile = 'All'""",
)
def c11(spark, sf):
    t = _tests(spark, sf, ("Difficulty",), ("PrevChoiceLeft",), False)
    keys = [*TRACE, "BrainRegion", "Layer"]

    def part(col, val, out):
        return t.filter(f"prior_col = '{col}' and prior_val = '{val}'").select(*keys, rnd("auc").alias(out))

    return (
        part("PrevChoiceLeft", 1, "auc_left")
        .join(part("PrevChoiceLeft", 0, "auc_right"), keys)
        .join(part("none", "none", "auc_none"), keys)
    )


@query("C12_membership_filter", f"SELECT ShortName, trace_id, TrialNumber, x FROM reduc r WHERE EXISTS (SELECT 1 FROM {_LEFT} t WHERE {_SIG} AND t.ShortName = r.ShortName AND t.trace_id = r.trace_id)")
def c12(spark, sf):
    sig = _left(spark, sf).filter(_sig()).select(*TRACE)
    return fx.reduc(spark, sf).join(sig, TRACE, "left_semi").select(*TRACE, "TrialNumber", "x")


_LAB = f"(SELECT ShortName, trace_id, CASE WHEN auc > 0.5 THEN 1 ELSE 0 END AS tuned_left FROM {_LEFT} t WHERE abs(auc - 0.5) >= 0.25)"


def _labels(spark, sf):
    return tu.tuning_labels(_left(spark, sf), F.abs(F.col("auc") - 0.5) >= 0.25)


@query("C13_tuning_label_join", f"SELECT r.ShortName, r.trace_id, TrialNumber, tuned_left FROM reduc r LEFT JOIN {_LAB} l ON l.ShortName = r.ShortName AND l.trace_id = r.trace_id")
def c13(spark, sf):
    out = skew.attach(fx.reduc(spark, sf), _labels(spark, sf).select(*TRACE, "tuned_left"), TRACE)
    return out.select(*TRACE, "TrialNumber", "tuned_left")


@query(
    "G28_preference_activity",
    f"""WITH d AS (SELECT r.*, CASE WHEN tuned_left IS NULL THEN 'untuned' WHEN tuned_left = ChoiceLeft THEN 'preferred' ELSE 'anti' END AS g FROM reduc r LEFT JOIN {_LAB} l
        ON l.ShortName = r.ShortName AND l.trace_id = r.trace_id),
      n AS (SELECT quantile_idx, g, ShortName, trace_id, avg(x) AS m, sum(x) AS s, count(*) AS n FROM d GROUP BY ALL)
      SELECT quantile_idx, g AS "group", {q6('avg(m)')} AS mean, {q6('stddev_samp(m) / sqrt(count(m))')} AS sem, {q6('sum(s) / sum(n)')} AS pooled, count(*) AS n_neurons FROM n GROUP BY ALL""",
)
def g28(spark, sf):
    p = tu.preference_activity(fx.reduc(spark, sf), _labels(spark, sf))
    return p.select("quantile_idx", "group", "n_neurons", *[r6(c).alias(c) for c in ("mean", "sem", "pooled")])


@query(
    "G28_preference_t",
    f"""SELECT quantile_idx, count(p - a) AS n_pairs, {qr('avg(p - a) / (stddev_samp(p - a) / sqrt(count(p - a)))')} AS t_stat FROM (SELECT quantile_idx, r.ShortName, r.trace_id,
      avg(x) FILTER (WHERE tuned_left = ChoiceLeft) AS p, avg(x) FILTER (WHERE tuned_left <> ChoiceLeft) AS a FROM reduc r JOIN {_LAB} l ON l.ShortName = r.ShortName AND l.trace_id = r.trace_id GROUP BY ALL) q GROUP BY quantile_idx""",
)
def g28t(spark, sf):
    t = tu.preference_t(fx.reduc(spark, sf), _labels(spark, sf))
    return t.withColumn("t_stat", rnd("t_stat"))


_TRAJ = f"""n AS (SELECT CAST(least(floor((r.trace_id % 101) * 5 / 100.0::DOUBLE), 4) AS BIGINT) AS bin, r.ShortName, r.trace_id, avg(x) FILTER (WHERE tuned_left = ChoiceLeft) AS p,
      avg(x) FILTER (WHERE tuned_left <> ChoiceLeft) AS a FROM reduc r JOIN {_LAB} l ON l.ShortName = r.ShortName AND l.trace_id = r.trace_id GROUP BY ALL),
    g AS (SELECT bin, count(*) AS n, avg(p) AS p, avg(a) AS a, stddev_samp(p) / sqrt(count(p)) AS ps, stddev_samp(a) / sqrt(count(a)) AS sa FROM n GROUP BY bin)"""


def _traj(spark, sf):
    pos = fx.frames(spark, sf).select(*TRACE).distinct().withColumn("position", E("cast(trace_id % 101 as double)"))
    return tu.trajectories(fx.reduc(spark, sf), _labels(spark, sf), pos, 5)


@query(
    "F44_tuning_trajectories",
    f"""WITH {_TRAJ} SELECT bin, n, {q6('p')} AS preferred, {q6('a')} AS anti, {q6('100 * (p - a) / nullif(p, 0)')} AS weight,
      {q6('100 * abs(a / nullif(p, 0)) * sqrt(pow(sa / nullif(a, 0), 2) + pow(ps / nullif(p, 0), 2))')} AS weight_sem FROM g""",
)
def f44(spark, sf):
    return _traj(spark, sf).select("bin", "n", *[r6(c).alias(c) for c in ("preferred", "anti", "weight", "weight_sem")])


@query(
    "F44_trajectory_fit",
    f"WITH {_TRAJ} SELECT {q6('regr_slope(100 * (p - a) / nullif(p, 0), bin)')} AS slope, {q6('regr_intercept(100 * (p - a) / nullif(p, 0), bin)')} AS intercept FROM g",
)
def f44f(spark, sf):
    return _traj(spark, sf).agg(r6(F.regr_slope("weight", "bin")).alias("slope"), r6(F.regr_intercept("weight", "bin")).alias("intercept"))


@query(
    "D58_epoch_part_dispatch",
    f"""SELECT ShortName, label, {qr('avg(v)')} AS mean, count(*) AS n FROM (SELECT e.*, epoch || ' - ' || CASE WHEN 3 * (frame - trace_start_idx) < (trace_end_idx - trace_start_idx + 1) THEN 'Early'
      WHEN 3 * (frame - trace_start_idx) < 2 * (trace_end_idx - trace_start_idx + 1) THEN 'Mid' ELSE 'Late' END AS label FROM ep_frames e) q GROUP BY ALL""",
)
def d58(spark, sf):
    part = E("""case when 3 * (frame - trace_start_idx) < (trace_end_idx - trace_start_idx + 1) then 'Early'
                when 3 * (frame - trace_start_idx) < 2 * (trace_end_idx - trace_start_idx + 1) then 'Mid' else 'Late' end""")
    e = fx.ep_frames(spark, sf).withColumn("label", F.concat_ws(" - ", "epoch", part))
    return e.groupBy("ShortName", "label").agg(rnd(F.avg("v")).alias("mean"), F.count("*").alias("n"))
