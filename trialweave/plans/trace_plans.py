"""Trace queries (F and S rows, and the joins that serve them)."""

from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.operators import behavior as bh
from trialweave.operators import traces as tr
from trialweave.operators.behavior import r6, rnd
from trialweave.plans.behavior_plans import _PARTS, _PUBLISHED
from trialweave.plans.registry import query
from trialweave.sources import fixtures as fx
from trialweave.sources.sql_views import DVSTR, q6
from trialweave.sources.sql_views import rnd as qr

E = F.expr
T = ["ShortName", "trace_id"]
TR = "ShortName, trace_id"


def _r(df, keys, *values, fn=rnd):
    return df.select(*keys, *[fn(v).alias(v) for v in values])


def _r6(df, keys, *values):
    return _r(df, keys, *values, fn=r6)


@query("F1_array_round_trip", "SELECT ShortName, trace_id, frame, v FROM frames")
def f1(spark, sf):
    return tr.to_frames(tr.to_arrays(fx.frames(spark, sf), 16), 16).withColumn("frame", F.col("frame").cast("long"))


_Z = """SELECT ShortName, trace_id, frame, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS v FROM {0}
    WINDOW w AS (PARTITION BY ShortName, trace_id)"""


@query(
    "F2_full_trace_then_epochs",
    f"""SELECT e.ShortName, TrialNumber, epoch, trace_id, {q6('avg(v)')} AS v FROM epochs e JOIN ({_Z.format('frames')}) f
      ON e.ShortName = f.ShortName AND frame BETWEEN trace_start_idx AND trace_end_idx GROUP BY ALL""",
)
def f2(spark, sf):
    z = tr.z_score(fx.frames(spark, sf).drop("label"), T)
    j = tr.slice_join(fx.epochs(spark, sf), z)
    return j.groupBy("ShortName", "TrialNumber", "epoch", "trace_id").agg(r6(F.avg("v")).alias("v"))


@query("C2_epoch_slice_join", "SELECT ShortName, TrialNumber, epoch, trace_id, frame, v FROM ep_frames")
def c2(spark, sf):
    return fx.ep_frames(spark, sf).select("ShortName", "TrialNumber", "epoch", "trace_id", "frame", "v")


@query(
    "C3_epoch_lookup",
    """SELECT a.ShortName, a.TrialNumber, a.trace_start_idx AS sampling_start, b.trace_start_idx AS move_start FROM epochs a JOIN epochs b
      ON a.ShortName = b.ShortName AND a.TrialNumber = b.TrialNumber WHERE a.epoch = 'Sampling' AND b.epoch LIKE 'Movement%'""",
)
def c3(spark, sf):
    e = fx.epochs(spark, sf)
    a = e.filter("epoch = 'Sampling'").selectExpr("ShortName", "TrialNumber", "trace_start_idx sampling_start")
    b = e.filter("epoch like 'Movement%'").selectExpr("ShortName", "TrialNumber", "trace_start_idx move_start")
    return a.join(b, ["ShortName", "TrialNumber"])


@query(
    "F3_combine_traces",
    """SELECT ShortName, TrialNumber, epoch || '_' || trace_id AS trace_id, count(*) AS n, count(*) - count(DISTINCT frame) AS repeated
      FROM ep_frames GROUP BY ALL""",
)
def f3(spark, sf):
    c = tr.combine_traces(fx.ep_frames(spark, sf), "epoch")
    return c.groupBy("ShortName", "TrialNumber", "trace_id").agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("frame")).alias("repeated")
    )


@query(
    "F4_loop_traces",
    f"SELECT ShortName, trace_id % 5 AS trace_group, {qr('avg(v)')} AS mean, {qr('stddev_pop(v)')} AS std FROM frames GROUP BY ALL",
)
def f4(spark, sf):
    f = fx.frames(spark, sf).withColumn("trace_group", E("trace_id % 5"))
    return f.groupBy("ShortName", "trace_group").agg(rnd(F.avg("v")).alias("mean"), rnd(F.stddev_pop("v")).alias("std"))


@query("F5_z_score", f"SELECT ShortName, trace_id, frame, {q6('v')} AS v FROM ({_Z.format('frames_big')}) z")
def f5(spark, sf):
    return _r6(tr.z_score(fx.frames_big(spark, sf), T), [*T, "frame"], "v")


@query(
    "F5_z_score_restricted",
    f"""SELECT ShortName, trace_id, frame, epoch, {q6('''(v - avg(v) FILTER (WHERE epoch = 'Sampling') OVER w)
      / nullif(stddev_pop(v) FILTER (WHERE epoch = 'Sampling') OVER w, 0)''')} AS v FROM ep_frames
      WINDOW w AS (PARTITION BY ShortName, trace_id)""",
)
def f5r(spark, sf):
    z = tr.z_score(fx.ep_frames(spark, sf), T, only=F.col("epoch") == "Sampling")
    return _r6(z, [*T, "frame", "epoch"], "v")


@query(
    "F6_percentile_scale",
    """SELECT ShortName, trace_id, frame, round_even((CASE WHEN v IS NOT NULL THEN greatest(least(v, hi), lo) END - lo) / nullif(hi - lo, 0), 4) AS v
      FROM frames_null JOIN (SELECT ShortName, trace_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi
        FROM frames_null GROUP BY ALL) q USING (ShortName, trace_id)""",
)
def f6(spark, sf):
    return tr.percentile_scale(fx.frames_null(spark, sf), T, 5, 95).select(*T, "frame", "v")


@query("F7_no_normalisation", "SELECT ShortName, trace_id, frame, v FROM frames")
def f7(spark, sf):
    return fx.frames(spark, sf).transform(lambda d: d).select(*T, "frame", "v")


@query(
    "F8_min_max_rows",
    """SELECT ShortName, TrialNumber, trace_id, frame, round_even((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 4) * 2.0::DOUBLE - 1.0::DOUBLE AS v
      FROM ep_frames WINDOW w AS (PARTITION BY ShortName, quantile_idx, trace_id)""",
)
def f8(spark, sf):
    out = tr.min_max_scale(fx.ep_frames(spark, sf), ["ShortName", "quantile_idx", "trace_id"], -1.0, 1.0)
    return out.select("ShortName", "TrialNumber", "trace_id", "frame", "v")


def _kernel_values(sigma):
    w = tr.gaussian_kernel(sigma)
    r = len(w) // 2
    return "(VALUES " + ", ".join(f"({k - r}, {x!r}::DOUBLE)" for k, x in enumerate(w)) + ") k(d, w)"


def _gauss_sql(src, sigma):
    return f"""SELECT a.ShortName, a.trace_id, a.frame, a.v, CASE WHEN a.v IS NOT NULL THEN sum(w * b.v) + (1 - sum(w)) * a.v END AS s
      FROM {src} a JOIN {_kernel_values(sigma)} ON true JOIN {src} b ON b.ShortName = a.ShortName AND b.trace_id = a.trace_id
        AND b.frame = a.frame + d AND (b.v IS NOT NULL OR a.v IS NULL) GROUP BY a.ShortName, a.trace_id, a.frame, a.v"""


@query("F14_gaussian", f"SELECT ShortName, trace_id, frame, {qr('s')} AS smooth FROM ({_gauss_sql('frames_null', 2)}) g")
def f14(spark, sf):
    return _r(tr.gaussian(fx.frames_null(spark, sf), T, "frame", 2), [*T, "frame"], "smooth")


_BASE = f"""g AS ({_gauss_sql('frames_big', 10)}),
    lo AS (SELECT *, min(s) OVER (PARTITION BY {TR} ORDER BY frame ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING) AS m FROM g),
    fl AS (SELECT *, round(max(m) OVER (PARTITION BY {TR} ORDER BY frame ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING), 9) AS floor_ FROM lo),
    sp AS (SELECT {TR}, min(floor_) AS a, max(floor_) AS z FROM fl GROUP BY ALL),
    hi AS (SELECT {TR}, a, z, coalesce(least(CAST(floor((floor_ - a) / nullif((z - a) / 200, 0)) AS BIGINT), 199), 0) AS bin, count(*) AS n
      FROM fl JOIN sp USING ({TR}) GROUP BY ALL),
    md AS (SELECT {TR}, round(a + (arg_max(bin, n * 1000 - bin) + 0.5::DOUBLE) * (z - a) / 200, 9) AS baseline FROM hi GROUP BY {TR}, a, z),
    st AS (SELECT {TR}, baseline, round(sqrt(2 * sum((v - baseline) * (v - baseline)) FILTER (WHERE v < baseline)
        / nullif(count(*) FILTER (WHERE v < baseline), 0)), 9) AS zscore, count(*) AS n_frames FROM frames_big JOIN md USING ({TR}) GROUP BY ALL)"""


@query("F9_baseline", f"WITH {_BASE} SELECT {TR}, {q6('baseline')} AS baseline, {q6('zscore')} AS zscore, n_frames FROM st")
def f9(spark, sf):
    return _r6(tr.baseline(fx.frames_big(spark, sf), fps=1.0), [*T, "n_frames"], "baseline", "zscore")


@query(
    "F9_delta_over_baseline",
    f"WITH {_BASE} SELECT {TR}, frame, {qr('(v - baseline) / baseline')} AS v FROM frames_big JOIN st USING ({TR})",
)
def f9d(spark, sf):
    f = fx.frames_big(spark, sf)
    out = skew.attach(f, tr.baseline(f, fps=1.0), T)
    return out.select(*T, "frame", rnd((F.col("v") - F.col("baseline")) / F.col("baseline")).alias("v"))


_RATE = f"""{_BASE},
    mv AS (SELECT {TR}, frame, avg(v) OVER w >= baseline + 1.0::DOUBLE * zscore AND count(*) OVER w = 5 AS high FROM frames_big JOIN st USING ({TR})
      WINDOW w AS (PARTITION BY {TR} ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    ru AS (SELECT {TR}, run, count(*) AS len FROM (SELECT *, frame - row_number() OVER (PARTITION BY {TR}, high ORDER BY frame) AS run FROM mv) q
      WHERE high GROUP BY ALL),
    rt AS (SELECT {TR}, count(*) FILTER (WHERE len + 1 >= 2) AS n_transients FROM ru GROUP BY ALL),
    ra AS (SELECT {TR}, coalesce(n_transients, 0) AS n_transients, coalesce(n_transients, 0) / (n_frames / 60.0::DOUBLE) AS rate FROM st LEFT JOIN rt USING ({TR}))"""


def _rate(spark, sf):
    f = fx.frames_big(spark, sf)
    stats = tr.baseline(f, fps=1.0)
    # A third of the usual three deviations, so that the noise of the fixture crosses it.
    scaled = stats.withColumn("zscore", F.col("zscore") / 3)
    return f, tr.transient_rate(f, scaled, fps=1.0, min_sec=2.0)


@query("F11_transient_rate", f"WITH {_RATE} SELECT {TR}, n_transients, {qr('rate')} AS rate FROM ra")
def f11(spark, sf):
    return _rate(spark, sf)[1].select(*T, "n_transients", rnd("rate").alias("rate"))


@query(
    "F10_active_counts",
    f"WITH {_RATE} SELECT ShortName, count(*) AS n_traces, count(*) FILTER (WHERE rate >= 0.5) AS n_active FROM ra GROUP BY ALL",
)
def f10(spark, sf):
    r = _rate(spark, sf)[1]
    return r.groupBy("ShortName").agg(F.count("*").alias("n_traces"), F.count_if(F.col("rate") >= 0.5).alias("n_active"))


@query(
    "F12_low_rate_filter",
    f"WITH {_RATE} SELECT {TR}, count(*) AS n FROM frames_big JOIN ra USING ({TR}) WHERE rate >= 0.5 GROUP BY ALL",
)
def f12(spark, sf):
    f, r = _rate(spark, sf)
    return tr.keep_only(f, r.filter("rate >= 0.5"), T).groupBy(*T).agg(F.count("*").alias("n"))


@query(
    "F13_trace_filters",
    f"""SELECT {TR}, count(*) AS n FROM frames JOIN (SELECT {TR} FROM frames GROUP BY ALL HAVING (min(v) <= -0.25 OR max(v) >= 0.3)
      AND max(v) - min(v) >= 0.5) q USING ({TR}) GROUP BY ALL""",
)
def f13(spark, sf):
    f = fx.frames(spark, sf)
    s = tr.trace_summary(f, T).filter("(v_min <= -0.25 or v_max >= 0.3) and v_range >= 0.5")
    return tr.keep_only(f, s, T).groupBy(*T).agg(F.count("*").alias("n"))


_POS = "(SELECT *, frame - trace_start_idx AS pos FROM ep_frames WHERE epoch = 'Sampling')"


def _pos(spark, sf):
    ep = fx.ep_frames(spark, sf).filter("epoch = 'Sampling'")
    return ep.withColumn("pos", E("frame - trace_start_idx"))


_OUT = f"""c AS (SELECT ShortName, TrialNumber, trace_id, pos, round(v - avg(v) OVER (PARTITION BY ShortName, TrialNumber, trace_id), 9) AS c FROM {_POS} p),
    q AS (SELECT ShortName, trace_id, pos, quantile_cont(c, 0.05) AS lo, quantile_cont(c, 0.95) AS hi FROM c GROUP BY ALL),
    m AS (SELECT ShortName, trace_id, pos, avg(c) FILTER (WHERE c BETWEEN lo AND hi) AS m, stddev_pop(c) FILTER (WHERE c BETWEEN lo AND hi) AS d
      FROM c JOIN q USING (ShortName, trace_id, pos) GROUP BY ALL),
    o AS (SELECT ShortName, TrialNumber, trace_id, coalesce(bool_or(abs(c - m) > 2.0::DOUBLE * d + 1e-12), false) AS is_outlier
      FROM c JOIN m USING (ShortName, trace_id, pos) GROUP BY ALL)"""


@query("F15_outlier_rows", f"WITH {_OUT} SELECT ShortName, TrialNumber, trace_id, is_outlier FROM o")
def f15(spark, sf):
    return tr.outlier_rows(_pos(spark, sf), ["TrialNumber"], T, 2.0, (5, 95))


_AL = ["ShortName", "TrialNumber", "epoch", "trace_start_idx", "trace_end_idx", "org_start_idx", "org_end_idx"]
_ALIGN = """a AS (SELECT e.*, trace_start_idx AS org_start_idx, trace_end_idx AS org_end_idx, trace_start_idx AS s,
      greatest(greatest(0, trace_start_idx - CAST(floor(1.0 * 4) AS BIGINT)), lo) AS f,
      least(trace_start_idx + greatest(CAST(floor(0.5 * 4) AS BIGINT) - 1, 0), hi) AS l
    FROM (SELECT ShortName, TrialNumber, trace_start_idx, trace_end_idx FROM epochs WHERE epoch LIKE 'Movement%') e
    JOIN (SELECT ShortName, TrialNumber, trace_start_idx AS lo FROM epochs WHERE epoch = 'Sampling') x USING (ShortName, TrialNumber)
    JOIN (SELECT ShortName, TrialNumber, trace_end_idx AS hi FROM epochs WHERE epoch LIKE 'Movement%') y USING (ShortName, TrialNumber)),
  b AS (SELECT ShortName, TrialNumber, '-1s Movement to Lateral Port' AS epoch, f AS trace_start_idx, s - 1 AS trace_end_idx, org_start_idx, org_end_idx FROM a
    UNION ALL SELECT ShortName, TrialNumber, 'Movement to Lateral Port', s, l, org_start_idx, org_end_idx FROM a)"""


def _aligned(spark, sf):
    mv = "Movement to Lateral Port"
    return tr.align_epochs(fx.epochs(spark, sf), ["ShortName", "TrialNumber"], mv, 1.0, 0.5, "Sampling", mv)


@query("F16_align_around_epoch", f"WITH {_ALIGN} SELECT * FROM b WHERE trace_start_idx <= trace_end_idx")
def f16(spark, sf):
    return _aligned(spark, sf).select(*_AL)


_RANGES = """(SELECT *, CAST(coalesce(sum(trace_end_idx - trace_start_idx + 1) OVER (PARTITION BY ShortName, TrialNumber ORDER BY state_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS range_start FROM epochs WHERE state_id IN (1, 2, 4))"""


def _ranges(spark, sf):
    return tr.concat_epochs(fx.epochs(spark, sf).filter("state_id in (1, 2, 4)").drop("label"), ["ShortName", "TrialNumber"])


def _concat(spark, sf):
    return tr.concat_frames(_ranges(spark, sf), fx.frames(spark, sf).drop("label"))


_CONCAT = f"""(SELECT r.ShortName, TrialNumber, epoch, state_id, trace_id, range_start + frame - trace_start_idx AS pos, v FROM {_RANGES} r
      JOIN frames f ON f.ShortName = r.ShortName AND frame BETWEEN trace_start_idx AND trace_end_idx)"""


@query("F17_concat_epochs", f"SELECT ShortName, TrialNumber, epoch, trace_id, pos, v FROM {_CONCAT} c")
def f17(spark, sf):
    return _concat(spark, sf).select("ShortName", "TrialNumber", "epoch", "trace_id", "pos", "v")


@query(
    "F17_concat_ranges",
    f"""SELECT ShortName, TrialNumber, epoch, range_start, range_start + trace_end_idx - trace_start_idx AS range_end FROM {_RANGES} r""",
)
def f17r(spark, sf):
    return _ranges(spark, sf).select("ShortName", "TrialNumber", "epoch", "range_start", "range_end")


@query("F18_cut_long_traces", f"SELECT ShortName, TrialNumber, trace_id, epoch, pos, v FROM {_CONCAT} c WHERE pos < 5 + 1")
def f18(spark, sf):
    cut = tr.cut_ranges(_ranges(spark, sf), ["ShortName", "TrialNumber"], F.lit(5))
    j = tr.concat_frames(cut, fx.frames(spark, sf).drop("label"))
    return j.select("ShortName", "TrialNumber", "trace_id", "epoch", "pos", "v")


@query(
    "F19_extend_short_traces",
    f"""WITH c AS (SELECT ShortName, TrialNumber, trace_id, pos, v FROM {_POS} p),
      n AS (SELECT ShortName, TrialNumber, trace_id, max(pos) + 1 AS n FROM c GROUP BY ALL)
      SELECT ShortName, TrialNumber, trace_id, pos + greatest(6 - n, 0) AS pos, v FROM c JOIN n USING (ShortName, TrialNumber, trace_id)
      UNION ALL SELECT ShortName, TrialNumber, trace_id, unnest(range(0, greatest(6 - n, 0))), NULL FROM n""",
)
def f19(spark, sf):
    return tr.extend_positions(_pos(spark, sf), ["ShortName", "TrialNumber", "trace_id"], F.lit(6), at_start=True)


_RESIZE = f"""WITH c AS (SELECT ShortName, TrialNumber, trace_id, pos, v FROM {_POS} p),
    n AS (SELECT ShortName, TrialNumber, trace_id, max(pos) + 1 AS n FROM c GROUP BY ALL),
    t AS (SELECT *, greatest(0.0::DOUBLE, least((p + 0.5::DOUBLE) * n / 3.0::DOUBLE - 0.5::DOUBLE, n - 1.0::DOUBLE)) AS x FROM (SELECT *, unnest(range(0, 3)) AS p FROM n) u)
  SELECT t.ShortName, t.TrialNumber, t.trace_id, t.p AS pos, {qr('a.v * (1 - (x - floor(x))) + b.v * (x - floor(x))')} AS v FROM t
    JOIN c a ON a.ShortName = t.ShortName AND a.TrialNumber = t.TrialNumber AND a.trace_id = t.trace_id AND a.pos = floor(x)
    JOIN c b ON b.ShortName = t.ShortName AND b.TrialNumber = t.TrialNumber AND b.trace_id = t.trace_id AND b.pos = least(floor(x) + 1, n - 1)"""


@query("F20_normalise_time", _RESIZE)
def f20(spark, sf):
    key = ["ShortName", "TrialNumber", "trace_id"]
    return _r(tr.resize(_pos(spark, sf), key, F.lit(3)), [*key, "pos"], "v")


@query(
    "F21_keep_epochs",
    f"""SELECT ShortName, TrialNumber, trace_id, epoch, pos - 1 AS pos, v FROM {_CONCAT} c WHERE epoch <> 'Pre-Trial Start'""",
)
def f21(spark, sf):
    kept = _ranges(spark, sf).filter("epoch != 'Pre-Trial Start'")
    again = tr.concat_epochs(kept.drop("range_start", "range_end"), ["ShortName", "TrialNumber"])
    j = tr.concat_frames(again, fx.frames(spark, sf).drop("label"))
    return j.select("ShortName", "TrialNumber", "trace_id", "epoch", "pos", "v")


def _avg_sql(src, keys):
    return f"""SELECT {keys}, pos, {qr('avg(v)')} AS mean, {qr('stddev_samp(v) / sqrt(count(v))')} AS sem, count(*) AS n_rows FROM {src} p GROUP BY {keys}, pos"""


def _avg(df, keys):
    return _r(tr.average(df, keys), [*keys, "pos", "n_rows"], "mean", "sem")


@query("F22_average_rows", _avg_sql(_POS, TR))
def f22(spark, sf):
    return _avg(_pos(spark, sf), T)


@query("F22_average_traces", _avg_sql(_POS, "ShortName, TrialNumber"))
def f22t(spark, sf):
    return _avg(_pos(spark, sf), ["ShortName", "TrialNumber"])


@query("F22_average_big_traces", _avg_sql("(SELECT *, frame AS pos FROM frames_big)", "ShortName"))
def f22b(spark, sf):
    return _avg(fx.frames_big(spark, sf).withColumnRenamed("frame", "pos"), ["ShortName"])


@query(
    "F22_average_of_averages",
    f"""SELECT 'ShortName_' || ShortName || '_quantile_idx_' || quantile_idx AS row_name, ShortName || ' Avg. Trace' AS own_name, ShortName, quantile_idx, pos,
      {qr('avg(v)')} AS mean, {qr('stddev_samp(v) / sqrt(count(v))')} AS sem, count(*) AS n_rows FROM {_POS} p GROUP BY ShortName, quantile_idx, pos""",
)
def f22a(spark, sf):
    """The SQL averages all rows at once; the query averages the averages of each trace."""
    by_trace = tr.average(_pos(spark, sf), [*T, "quantile_idx"])
    d = tr.average_again(by_trace, ["ShortName", "quantile_idx"])
    names = [tr.averaged_name("ShortName", "quantile_idx").alias("row_name"), tr.averaged_name("ShortName", own=True).alias("own_name")]
    return d.select(*names, "ShortName", "quantile_idx", "pos", rnd("mean").alias("mean"), rnd("sem").alias("sem"), F.col("n_rows").cast("long").alias("n_rows"))


@query(
    "F23_average_by_combination",
    f"""WITH {_OUT} {_avg_sql(f"(SELECT p.*, CASE WHEN ChoiceCorrect = 1 THEN 'Correct' ELSE 'Incorrect' END || ' / ' || CASE WHEN ChoiceLeft = 1 THEN 'Left' ELSE 'Right' END AS label FROM {_POS} p JOIN o USING (ShortName, TrialNumber, trace_id) WHERE NOT is_outlier)", "label, trace_id, ShortName")}""",
)
def f23(spark, sf):
    p = _pos(spark, sf)
    bad = tr.outlier_rows(p, ["TrialNumber"], T, 2.0, (5, 95)).filter("is_outlier")
    good = p.join(bad.select("ShortName", "TrialNumber", "trace_id"), ["ShortName", "TrialNumber", "trace_id"], "left_anti")
    return _avg(bh.condition_label(good, outcome=True, direction=True), ["label", "trace_id", "ShortName"])


@query("F24_rename_traces", "SELECT trace_id || '_' || quantile_idx AS trace_id, count(*) AS n FROM ep_frames GROUP BY ALL")
def f24(spark, sf):
    e = fx.ep_frames(spark, sf)
    return e.groupBy(F.concat_ws("_", "trace_id", "quantile_idx").alias("trace_id")).agg(F.count("*").alias("n"))


@query(
    "F25_store_min_max",
    "SELECT ShortName, min(v) AS v_min, max(v) AS v_max, count(DISTINCT trace_id) AS n_traces FROM frames GROUP BY ALL",
)
def f25(spark, sf):
    s = fx.frames(spark, sf).groupBy(*T).agg(F.min("v").alias("a"), F.max("v").alias("z"))
    return s.groupBy("ShortName").agg(F.min("a").alias("v_min"), F.max("z").alias("v_max"), F.count("*").alias("n_traces"))


@query(
    "F26_normalise_align",
    f"""WITH {_ALIGN} SELECT b.ShortName, TrialNumber, epoch, trace_id, frame - trace_start_idx AS pos, {q6('v')} AS v FROM b
      JOIN ({_Z.format('frames')}) z ON z.ShortName = b.ShortName AND frame BETWEEN trace_start_idx AND trace_end_idx""",
)
def f26(spark, sf):
    z = tr.z_score(fx.frames(spark, sf).drop("label"), T)
    j = tr.slice_join(_aligned(spark, sf), z).withColumn("pos", E("frame - trace_start_idx"))
    return _r6(j, ["ShortName", "TrialNumber", "epoch", "trace_id", "pos"], "v")


_SAMP = """s AS (SELECT * FROM (SELECT *, lag(epoch_time) OVER w AS bt, lead(epoch_time) OVER w AS nt, lead(trace_start_idx) OVER w AS ns FROM epochs
      WINDOW w AS (PARTITION BY ShortName, TrialNumber ORDER BY state_id)) q
      WHERE epoch = 'Sampling' AND bt >= 0.25 AND nt >= 0.25),
    p AS (SELECT ShortName, TrialNumber, quantile_idx, ChoiceLeft, unnest([{'part': 1, 'a': greatest(0, trace_start_idx - 1), 'z': trace_start_idx - 1},
      {'part': 2, 'a': trace_start_idx, 'z': trace_end_idx}, {'part': 3, 'a': ns, 'z': ns}]) AS x FROM s)"""


@query(
    "F27_sampling_epoch",
    f"""WITH {_SAMP} SELECT ShortName, TrialNumber, x.part::BIGINT AS part, x.a::BIGINT AS trace_start_idx, x.z::BIGINT AS trace_end_idx FROM p""",
)
def f27(spark, sf):
    from trialweave.operators import composites as cp

    out = cp.sampling_parts(fx.epochs(spark, sf), "Sampling", 0.25, 0.25)
    return out.select("ShortName", "TrialNumber", "part", "trace_start_idx", "trace_end_idx")


@query(
    "F28_align_sampling",
    f"""WITH {_SAMP}, z AS ({_Z.format('frames')}) SELECT trace_id, z.ShortName, quantile_idx, x.part::BIGINT AS part, frame - x.a AS pos, {q6('avg(v)')} AS mean, count(*) AS n_rows
      FROM p JOIN z ON z.ShortName = p.ShortName AND frame BETWEEN x.a AND x.z GROUP BY ALL""",
)
def f28(spark, sf):
    from trialweave.operators import composites as cp

    out = cp.align_sampling(fx.epochs(spark, sf), fx.frames(spark, sf).drop("label"), 0.25, 0.25)
    return _r6(out, ["trace_id", "ShortName", "quantile_idx", "part", "pos", "n_rows"], "mean")


@query(
    "C6_quantile_give_back",
    """WITH q AS (SELECT ShortName, TrialNumber, ntile(3) OVER (PARTITION BY ShortName ORDER BY span, TrialNumber) AS q FROM
        (SELECT ShortName, TrialNumber, max(trace_end_idx) FILTER (WHERE epoch = 'Sampling') - max(trace_start_idx) FILTER (WHERE epoch = 'Sampling') AS span FROM epochs GROUP BY ALL) t)
      SELECT e.ShortName, e.TrialNumber, epoch, q FROM epochs e JOIN q USING (ShortName, TrialNumber)""",
)
def c6(spark, sf):
    from trialweave.operators import windows as wn

    e = fx.epochs(spark, sf)
    one = e.filter("epoch = 'Sampling'").selectExpr("ShortName", "TrialNumber", "trace_end_idx - trace_start_idx as span")
    q = wn.speed_class(one, ["ShortName"], "span", "TrialNumber").select("ShortName", "TrialNumber", F.col("quantile_idx").alias("q"))
    return e.join(q, ["ShortName", "TrialNumber"]).select("ShortName", "TrialNumber", "epoch", "q")


@query(
    "F29_cut_extend_by_group",
    f"""WITH c AS (SELECT ShortName, TrialNumber, quantile_idx, trace_id, pos, v FROM {_POS} p),
      n AS (SELECT ShortName, TrialNumber, quantile_idx, max(pos) + 1 AS n FROM c GROUP BY ALL),
      m AS (SELECT ShortName, quantile_idx, CAST(floor(median(n)) AS BIGINT) AS m, max(n) AS x FROM n GROUP BY ALL)
      SELECT ShortName, quantile_idx, trace_id, pos, {qr('avg(v)')} AS mean, count(*) AS n FROM c JOIN m USING (ShortName, quantile_idx)
      WHERE pos < m GROUP BY ALL""",
)
def f29(spark, sf):
    from trialweave.operators import composites as cp

    cut = cp.limit_by_group(_pos(spark, sf), ["ShortName", "quantile_idx"], ["TrialNumber"])
    return cut.groupBy("ShortName", "quantile_idx", "trace_id", "pos").agg(rnd(F.avg("v")).alias("mean"), F.count("*").alias("n"))


_ALIGNED = f"""WITH c AS (SELECT ShortName, TrialNumber, quantile_idx, trace_id, pos, v FROM {_POS} p),
    n AS (SELECT ShortName, TrialNumber, quantile_idx, max(pos) + 1 AS n FROM c GROUP BY ALL),
    m AS (SELECT ShortName, quantile_idx, CAST(floor(median(n)) AS BIGINT) AS m FROM n GROUP BY ALL),
    l AS (SELECT ShortName, TrialNumber, quantile_idx, least(n, m) AS n FROM n JOIN m USING (ShortName, quantile_idx)),
    x AS (SELECT ShortName, max(n) AS x FROM l GROUP BY ShortName),
    k AS (SELECT DISTINCT ShortName, TrialNumber, quantile_idx, trace_id FROM c)
    SELECT k.ShortName, k.TrialNumber, k.quantile_idx, k.trace_id, p AS pos, c.v FROM
      (SELECT k.*, n, x, unnest(range(0, x)) AS p FROM k JOIN l USING (ShortName, TrialNumber, quantile_idx) JOIN x USING (ShortName)) k
      LEFT JOIN c ON c.ShortName = k.ShortName AND c.TrialNumber = k.TrialNumber AND c.trace_id = k.trace_id AND c.pos = {{0}} AND {{1}}"""


def _cut_extended(spark, sf, at_start):
    from trialweave.operators import composites as cp

    out = cp.align_by_group(_pos(spark, sf), ["ShortName"], ["quantile_idx"], ["TrialNumber"], at_start)
    return out.select("ShortName", "TrialNumber", "quantile_idx", "trace_id", "pos", "v")


@query("F29_extend_at_end", _ALIGNED.format("p", "p < n"))
def f29e(spark, sf):
    return _cut_extended(spark, sf, False)


@query("F29_extend_at_start", _ALIGNED.format("p - (x - n)", "p >= x - n"))
def f29s(spark, sf):
    return _cut_extended(spark, sf, True)


_PAIRS = f"""WITH n AS (SELECT ShortName, TrialNumber, ChoiceLeft, row_number() OVER (PARTITION BY ShortName, ChoiceLeft ORDER BY TrialNumber) AS n
      FROM (SELECT DISTINCT ShortName, TrialNumber, ChoiceLeft FROM epochs) e),
    p AS (SELECT * FROM {_POS} p JOIN n USING (ShortName, TrialNumber, ChoiceLeft))
    SELECT a.ShortName, a.n, a.trace_id, a.pos, {{0}} FROM p a JOIN p b ON a.ShortName = b.ShortName AND a.n = b.n AND a.trace_id = b.trace_id
      AND a.pos = b.pos WHERE a.ChoiceLeft = 1 AND b.ChoiceLeft = 0"""


def _pairs(spark, sf):
    left = F.col("ChoiceLeft") == 1
    return tr.nth_pairs(_pos(spark, sf), left, ~left, ["ShortName"], ["TrialNumber"], "pos")


@query("C9_trace_difference", _PAIRS.format(f"{qr('abs(a.v - b.v)')} AS d"))
def c9(spark, sf):
    return _pairs(spark, sf).select("ShortName", "n", "trace_id", "pos", rnd(F.abs(E("l - r"))).alias("d"))


@query("C10_trace_ratio", _PAIRS.format(f"{qr('a.v / nullif(b.v, 0)')} AS ratio"))
def c10(spark, sf):
    return _pairs(spark, sf).select("ShortName", "n", "trace_id", "pos", rnd(E("l / nullif(r, 0)")).alias("ratio"))


_SIDE = f"""SELECT ShortName, trace_id, pos, round(avg(v) FILTER (WHERE ChoiceLeft = 1) - avg(v) FILTER (WHERE ChoiceLeft = 0), 9) AS d FROM {_POS} p GROUP BY ALL"""


@query(
    "F30_difference_map",
    f"""WITH d AS (SELECT * FROM ({_SIDE}) q WHERE d IS NOT NULL),
      s AS (SELECT ShortName, trace_id, quantile_cont(d, 0.01) AS lo, quantile_cont(d, 0.99) AS hi FROM d GROUP BY ALL),
      n AS (SELECT ShortName, trace_id, pos, round_even((greatest(least(d, hi), lo) - lo) / nullif(hi - lo, 0), 4) AS v FROM d JOIN s USING ({TR})),
      k AS (SELECT ShortName, trace_id, arg_max(pos, v * 1000 - pos / 1e6) AS peak FROM n GROUP BY ALL)
      SELECT ShortName, trace_id, pos, v, row_number() OVER (PARTITION BY ShortName, pos ORDER BY peak, trace_id) AS sort_pos FROM n JOIN k USING ({TR})
      QUALIFY true""".replace("row_number() OVER (PARTITION BY ShortName, pos ORDER BY peak, trace_id)", "dense_rank() OVER (PARTITION BY ShortName ORDER BY peak, trace_id)").replace("QUALIFY true", ""),
)
def f30(spark, sf):
    from trialweave.operators import composites as cp

    return cp.difference_map(_pos(spark, sf)).select(*T, "pos", "v", "sort_pos")


@query(
    "S1_order_by_range",
    """SELECT ShortName, trace_id, row_number() OVER (PARTITION BY ShortName ORDER BY round(max(v) - min(v), 9), trace_id) AS sort_pos
      FROM frames GROUP BY ShortName, trace_id""",
)
def s1(spark, sf):
    return tr.order_by_range(fx.frames(spark, sf), ["ShortName"]).select(*T, "sort_pos")


_PEAK = """SELECT ShortName, trace_id, row_number() OVER (PARTITION BY ShortName ORDER BY peak, trace_id) AS sort_pos, peak FROM
    (SELECT DISTINCT ShortName, trace_id, first_value(frame) OVER (PARTITION BY ShortName, trace_id ORDER BY v DESC, frame) AS peak
     FROM frames_null WHERE v IS NOT NULL) q"""


@query("S2_order_by_peak", _PEAK)
def s2(spark, sf):
    return tr.order_by_peak(fx.frames_null(spark, sf), ["ShortName"], "frame").select(*T, "sort_pos", "peak")


@query(
    "C8_copy_sort_order",
    f"SELECT f.ShortName, f.trace_id, frame, v, sort_pos FROM frames f JOIN ({_PEAK}) p ON f.ShortName = p.ShortName AND f.trace_id = p.trace_id",
)
def c8(spark, sf):
    order = tr.order_by_peak(fx.frames_null(spark, sf), ["ShortName"], "frame").select(*T, "sort_pos")
    return skew.attach(fx.frames(spark, sf), order, T, how="inner").select(*T, "frame", "v", "sort_pos")


@query(
    "S4_condition_sorted_trials",
    "SELECT ShortName, trace_id, TrialNumber, ChoiceCorrect, ChoiceLeft, DV, x FROM reduc ORDER BY ShortName, trace_id, ChoiceCorrect, ChoiceLeft, DV, TrialNumber",
)
def s4(spark, sf):
    cols = ["ShortName", "trace_id", "TrialNumber", "ChoiceCorrect", "ChoiceLeft", "DV", "x"]
    r = fx.reduc(spark, sf).select(*cols)
    return r.orderBy("ShortName", "trace_id", "ChoiceCorrect", "ChoiceLeft", "DV", "TrialNumber")


@query(
    "F31_heatmap_table",
    f"""WITH m AS (SELECT ShortName, trace_id, pos, round(avg(v), 9) AS m FROM {_POS} p GROUP BY ALL),
      n AS (SELECT *, round_even((m - min(m) OVER w) / nullif(max(m) OVER w - min(m) OVER w, 0), 4) AS v FROM m WINDOW w AS (PARTITION BY {TR})),
      k AS (SELECT DISTINCT ShortName, trace_id, first_value(pos) OVER (PARTITION BY {TR} ORDER BY v DESC, pos) AS peak FROM n WHERE v IS NOT NULL)
      SELECT ShortName, trace_id, pos, v, dense_rank() OVER (PARTITION BY ShortName ORDER BY peak, trace_id) AS sort_pos FROM n JOIN k USING ({TR})""",
)
def f31(spark, sf):
    from trialweave.operators import composites as cp

    return cp.heatmap(_pos(spark, sf)).select(*T, "pos", "v", "sort_pos")


@query(
    "F32_population_activity",
    f"""SELECT ShortName, frame, {qr('total')} AS total, {qr('100 * total / max(total) OVER (PARTITION BY ShortName)')} AS percent FROM
      (SELECT ShortName, frame, sum((v + 1) / 2) AS total FROM frames GROUP BY ALL) s""",
)
def f32(spark, sf):
    f = fx.frames(spark, sf).withColumn("v", E("(v + 1) / 2"))
    return _r(tr.population_activity(f, ["ShortName"], "frame"), ["ShortName", "frame"], "total", "percent")


@query(
    "F33_activity_by_history",
    f"""WITH d AS (SELECT DISTINCT ShortName, TrialNumber, ChoiceCorrect FROM epochs),
      c AS (SELECT *, CASE WHEN ChoiceCorrect = lag(ChoiceCorrect) OVER w AND TrialNumber = lag(TrialNumber) OVER w + 1 THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY ShortName ORDER BY TrialNumber)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY ShortName ORDER BY TrialNumber) AS run FROM c),
      k AS (SELECT *, row_number() OVER (PARTITION BY ShortName, run ORDER BY TrialNumber) * CASE WHEN ChoiceCorrect = 1 THEN 1 ELSE -1 END AS len FROM g),
      h AS (SELECT ShortName, TrialNumber, ChoiceCorrect, lag(len) OVER (PARTITION BY ShortName ORDER BY TrialNumber) AS streak FROM k),
      x AS (SELECT ShortName, TrialNumber, trace_id, max(v) AS mx FROM {_POS} p GROUP BY ALL)
      SELECT p.ShortName, p.trace_id, h.ChoiceCorrect, CAST(streak AS BIGINT) AS streak, {qr('avg(v)')} AS mean, {qr('stddev_samp(v) / sqrt(count(v))')} AS sem, {qr('avg(mx)')} AS mean_max,
        count(DISTINCT TrialNumber) AS n_trials
      FROM {_POS} p JOIN h USING (ShortName, TrialNumber) JOIN x USING (ShortName, TrialNumber, trace_id) WHERE streak IS NOT NULL GROUP BY p.ShortName, p.trace_id, h.ChoiceCorrect, streak""",
)
def f33(spark, sf):
    from trialweave.operators import composites as cp

    return _r(cp.activity_by_history(_pos(spark, sf), fx.epochs(spark, sf)), [*T, "ChoiceCorrect", "streak", "n_trials"], "mean", "sem", "mean_max")


@query(
    "F34_trace_distribution",
    f"SELECT {TR}, min(v) AS v_min, max(v) AS v_max, {qr('stddev_pop(v)')} AS v_std, {qr('max(v) - min(v)')} AS v_range FROM frames_big GROUP BY ALL",
)
def f34(spark, sf):
    return _r(tr.trace_summary(fx.trace_values(spark, sf), T), [*T, "v_min", "v_max"], "v_std", "v_range")


_W = "region_frames f JOIN regions r ON r.area_name = f.region || '_' || f.side"


@query("F35_bilateral_merge", f"SELECT region, frame, {q6('sum(v * weight) / sum(weight)')} AS v FROM {_W} GROUP BY ALL")
def f35(spark, sf):
    return _r6(tr.unify_sides(fx.region_frames(spark, sf), fx.regions(spark, sf)), ["region", "frame"], "v")


@query(
    "C16_bilateral_pairing",
    """SELECT region, frame, max(v) FILTER (WHERE side = 'left') AS left_v, max(v) FILTER (WHERE side = 'right') AS right_v FROM region_frames GROUP BY ALL""",
)
def c16(spark, sf):
    f = fx.region_frames(spark, sf)
    cell = [F.max(F.when(F.col("side") == s, F.col("v"))).alias(f"{s}_v") for s in ("left", "right")]
    return f.groupBy("region", "frame").agg(*cell)


@query(
    "F36_whole_cortex",
    f"""SELECT region, side, frame, {q6('v')} AS v FROM region_frames UNION ALL
      SELECT 'Crtx', side, frame, {q6('sum(v * weight) / sum(weight)')} FROM {_W} GROUP BY side, frame""",
)
def f36(spark, sf):
    return _r6(tr.whole_side(fx.region_frames(spark, sf), fx.regions(spark, sf)), ["region", "side", "frame"], "v")


@query(
    "F37_expand_trials",
    f"""SELECT ShortName, TrialNumber, trace_id, {qr('x')} AS mean_activity, {qr('p')} AS performance FROM reduc JOIN (SELECT ShortName, 100 * avg(ChoiceCorrect) AS p
      FROM (SELECT DISTINCT ShortName, TrialNumber, ChoiceCorrect FROM epochs) d GROUP BY ShortName) s USING (ShortName)""",
)
def f37(spark, sf):
    trials = fx.epochs(spark, sf).select("ShortName", "TrialNumber", "ChoiceCorrect").distinct()
    perf = trials.groupBy("ShortName").agg((100 * F.avg("ChoiceCorrect")).alias("performance"))
    out = skew.attach(fx.reduc(spark, sf), perf, ["ShortName"])
    return out.select("ShortName", "TrialNumber", "trace_id", rnd("x").alias("mean_activity"), rnd("performance").alias("performance"))


@query(
    "F38_trial_mean_activity",
    f"""SELECT ShortName, TrialNumber, ChoiceLeft, CASE WHEN trace_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, {q6('avg(x)')} AS mean, count(*) AS n FROM reduc GROUP BY ALL""",
)
def f38(spark, sf):
    r = fx.reduc(spark, sf).withColumn("side", E("if(trace_id % 2 = 0, 'left', 'right')"))
    return r.groupBy("ShortName", "TrialNumber", "ChoiceLeft", "side").agg(r6(F.avg("x")).alias("mean"), F.count("*").alias("n"))


_DIST = f"""SELECT ShortName, quantile_idx, {q6("avg(m) FILTER (WHERE r = 0) - avg(m) FILTER (WHERE r = 1)")} AS distance FROM
    (SELECT ShortName, quantile_idx, TrialNumber, trace_id % 2 AS r, avg(x) AS m FROM reduc GROUP BY ALL) t GROUP BY ALL"""


def _distance(spark, sf):
    r = fx.reduc(spark, sf).withColumn("r", E("trace_id % 2"))
    t = r.groupBy("ShortName", "quantile_idx", "TrialNumber", "r").agg(F.avg("x").alias("m"))
    d = F.avg(F.when(F.col("r") == 0, F.col("m"))) - F.avg(F.when(F.col("r") == 1, F.col("m")))
    return t.groupBy("ShortName", "quantile_idx").agg(r6(d).alias("distance"))


@query("F39_region_distance", _DIST)
def f39(spark, sf):
    return _distance(spark, sf)


@query(
    "C15_three_table_merge",
    f"""WITH d AS ({_DIST}), m AS (SELECT ShortName, quantile_idx, avg(v) FILTER (WHERE trace_id % 2 = 0) AS a, avg(v) FILTER (WHERE trace_id % 2 = 1) AS b FROM {_POS} p GROUP BY ALL)
      SELECT ShortName, quantile_idx, distance, {qr('a')} AS lfc, {qr('b')} AS mfc FROM d LEFT JOIN m USING (ShortName, quantile_idx)""",
)
def c15(spark, sf):
    keys = ["ShortName", "quantile_idx"]
    p = _pos(spark, sf)
    out = _distance(spark, sf)
    for side, name in ((0, "lfc"), (1, "mfc")):
        m = p.filter(f"trace_id % 2 = {side}").groupBy(*keys).agg(rnd(F.avg("v")).alias(name))
        out = out.join(m, keys, "left")
    return out


@query(
    "F40_track_activity",
    f"""SELECT ShortName, quantile_idx, count(*) AS n_traces, count(*) FILTER (WHERE m > 0.02) AS n_above, {q6('100.0 * count(*) FILTER (WHERE m > 0.02) / count(*)')} AS percent
      FROM (SELECT ShortName, quantile_idx, trace_id, avg(x) AS m FROM reduc GROUP BY ALL) t GROUP BY ALL""",
)
def f40(spark, sf):
    t = fx.reduc(spark, sf).groupBy("ShortName", "quantile_idx", "trace_id").agg(F.avg("x").alias("m"))
    above = F.count_if(F.col("m") > 0.02)
    return t.groupBy("ShortName", "quantile_idx").agg(
        F.count("*").alias("n_traces"), above.alias("n_above"), r6(100.0 * above / F.count("*")).alias("percent")
    )


@query(
    "F41_response_likelihood",
    f"""WITH e AS (SELECT ShortName, TrialNumber, trace_start_idx - 1 AS b, trace_start_idx + 2 AS a, trace_start_idx - 3 AS q FROM epochs
        WHERE epoch LIKE 'Movement%' AND trace_start_idx - 3 > 0),
      t AS (SELECT f.ShortName, trace_id, TrialNumber, bool_or(frame >= b AND v >= 0.2) AS hit, bool_or(frame < b AND v >= 0.2) AS was
        FROM e JOIN frames f ON f.ShortName = e.ShortName AND frame BETWEEN q AND a GROUP BY ALL),
      c AS (SELECT {TR}, count(*) FILTER (WHERE hit AND NOT was) AS s, count(*) FILTER (WHERE hit AND was) AS w, count(*) AS trials_count FROM t GROUP BY ALL)
      SELECT {TR}, CASE WHEN s > w THEN s + w ELSE 0 END AS start_count, CASE WHEN s > w THEN 0 ELSE s + w END AS already_started_count, trials_count FROM c""",
)
def f41(spark, sf):
    mv = "Movement to Lateral Port"
    return tr.crossings(fx.epochs(spark, sf), fx.frames(spark, sf).drop("label"), mv, 0.2, 0.25, 0.5, 0.75)


@query(
    "F42_side_preference_sum",
    f"""WITH n AS (SELECT ShortName, ChoiceLeft, trace_id, pos, avg(v) AS m FROM {_POS} p GROUP BY ALL),
      s AS (SELECT ShortName, ChoiceLeft, pos, avg(m) AS m FROM n GROUP BY ALL),
      b AS (SELECT ShortName, pos, avg(m) AS m FROM s GROUP BY ALL)
      SELECT pos, {qr('avg(m)')} AS mean, {qr('stddev_samp(m) / sqrt(count(m))')} AS sem, count(*) AS n_sessions FROM b GROUP BY pos""",
)
def f42(spark, sf):
    from trialweave.operators import composites as cp

    return _r(cp.side_preference(_pos(spark, sf)), ["pos", "n_sessions"], "mean", "sem")


@query(
    "F43_side_area",
    f"""SELECT {TR}, quantile_idx, {qr('sum(abs(l - r))')} AS area FROM (SELECT {TR}, quantile_idx, pos, avg(v) FILTER (WHERE ChoiceLeft = 1) AS l,
      avg(v) FILTER (WHERE ChoiceLeft = 0) AS r FROM {_POS} p GROUP BY ALL) q GROUP BY ALL""",
)
def f43(spark, sf):
    from trialweave.operators import composites as cp

    return _r(cp.side_area(_pos(spark, sf), [*T, "quantile_idx"]), [*T, "quantile_idx"], "area")


@query(
    "D59_condition_averages",
    f"""SELECT CASE WHEN grouping(quantile_idx) = 1 THEN 'Outcome' ELSE 'OutcomeQuantile' END AS combination, ChoiceCorrect, quantile_idx, ShortName, pos,
      {qr('avg(v)')} AS mean, count(*) AS n FROM {_POS} p GROUP BY GROUPING SETS ((ChoiceCorrect, ShortName, pos), (ChoiceCorrect, quantile_idx, ShortName, pos))""",
)
def d59(spark, sf):
    cols = ["ChoiceCorrect", "quantile_idx", "ShortName", "pos"]
    combos = {"Outcome": ["ChoiceCorrect", "ShortName", "pos"], "OutcomeQuantile": cols}
    return bh.combinations(_pos(spark, sf), cols, combos, [rnd(F.avg("v")).alias("mean"), F.count("*").alias("n")])


def _published_sql(name, cols, cond):
    keep = [c for c in cols.split(", ") if c]
    picked = ", ".join(c if c in keep else f"NULL AS {c}" for c in _PARTS)
    known = " AND ".join([cond, *[f"{c} IS NOT NULL" for c in keep]])
    keys = ", ".join([*keep, "ShortName", "pos"])
    return f"SELECT '{name}' AS combination, {picked}, ShortName, pos, {qr('avg(v)')} AS mean, count(*) AS n FROM d WHERE {known} GROUP BY {keys}"


@query(
    "D59_published_combinations",
    f"WITH d AS (SELECT *, {DVSTR.format('DV')} AS DVstr, CAST(floor(epoch_time) AS BIGINT) AS dur_bin FROM {_POS} p) "
    + " UNION ALL ".join(_published_sql(n, c, f) for n, (c, f) in _PUBLISHED.items()),
)
def d59p(spark, sf):
    """All named groupings over traces. Frames are summed once per cell of all their columns; the groupings add up cells."""
    d = _pos(spark, sf).withColumn("DVstr", bh.dv_label(F.col("DV"))).withColumn("dur_bin", F.floor("epoch_time").cast("long"))
    cells = d.groupBy(*_PARTS, "ShortName", "pos").agg(F.sum("v").alias("s"), F.count("v").alias("k"), F.count("*").alias("m"))
    combos = {}
    for name, (cols, cond) in _PUBLISHED.items():
        keep = [c for c in cols.split(", ") if c]
        combos[name] = ([*keep, "ShortName", "pos"], E(" AND ".join([cond, *[f"{c} IS NOT NULL" for c in keep]])))
    aggs = [rnd(F.sum("s") / F.sum("k")).alias("mean"), F.sum("m").alias("n")]
    return bh.filtered_combinations(cells, [*_PARTS, "ShortName", "pos"], combos, aggs)


@query(
    "C7_keep_only_traces",
    f"SELECT {TR}, count(*) AS n FROM frames WHERE trace_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding[1] > 0.1) GROUP BY ALL",
)
def c7(spark, sf):
    f = fx.frames(spark, sf)
    src = f.filter("frame = 0 and v > 0.1")
    return tr.keep_only(f, src, T, remove=True).groupBy(*T).agg(F.count("*").alias("n"))


@query(
    "C17_significance_list_join",
    f"""SELECT {TR}, count(*) AS n FROM frames JOIN (SELECT DISTINCT regexp_extract(k, '^(.*)_([^_]*)$', 2) AS s, CAST(regexp_extract(k, '^(.*)_([^_]*)$', 1) AS BIGINT) AS i
      FROM (SELECT trace_id || '_' || ShortName AS k FROM frames GROUP BY ALL HAVING max(v) > 0.3) q) l ON s = ShortName AND i = trace_id GROUP BY ALL""",
)
def c17(spark, sf):
    f = fx.frames(spark, sf)
    listed = f.groupBy(*T).agg(F.max("v").alias("m")).filter("m > 0.3").select(F.concat_ws("_", "trace_id", "ShortName").alias("k"))
    keys = listed.select(
        F.regexp_extract("k", "^(.*)_([^_]*)$", 2).alias("ShortName"), F.regexp_extract("k", "^(.*)_([^_]*)$", 1).cast("long").alias("trace_id")
    )
    return tr.keep_only(f, keys, T).groupBy(*T).agg(F.count("*").alias("n"))
