"""Activity by preferred side, counts beside areas, mean and raw traces, orders taken from another condition."""

from pyspark.sql import functions as F

from trialweave.operators import composites as cp
from trialweave.operators.behavior import rnd
from trialweave.plans.registry import query
from trialweave.plans.trace_plans import _POS, TR, T, _pos
from trialweave.plans.tuning_plans import _tests
from trialweave.sources import fixtures as fx
from trialweave.sources.sql_views import rnd as qr

_PREF = f"(SELECT {TR}, auc > 0.5 AS prefers_left FROM tests WHERE data_col = 'ChoiceLeft' AND prior_col = 'none' AND quantile = 'All' AND abs(auc - 0.5) >= 0.2)"


def _preferred(spark, sf):
    t = _tests(spark, sf, ("ChoiceLeft",), priors=(), speed=False).filter("abs(auc - 0.5) >= 0.2")
    return t.select(*T, (F.col("auc") > 0.5).alias("prefers_left"))


def _preferred_sql(shift):
    return f"""WITH c AS (SELECT p.*, max(pos) OVER (PARTITION BY BrainRegion, ShortName, TrialNumber) AS last, max(pos) OVER (PARTITION BY BrainRegion) AS longest FROM {_POS} p),
      n AS (SELECT BrainRegion, ShortName, ChoiceLeft, trace_id, pos + {shift} AS pos, avg(v) AS m FROM c JOIN {_PREF} f USING ({TR})
        WHERE (ChoiceLeft = 1) = prefers_left GROUP BY ALL),
      k AS (SELECT BrainRegion, ShortName, ChoiceLeft, count(DISTINCT trace_id) AS k FROM n GROUP BY ALL),
      s AS (SELECT BrainRegion, ShortName, ChoiceLeft, pos, CASE WHEN count(m) = max(k) THEN avg(m) END AS m FROM n JOIN k USING (BrainRegion, ShortName, ChoiceLeft) GROUP BY ALL),
      b AS (SELECT BrainRegion, ShortName, pos, avg(m) AS m FROM s GROUP BY ALL),
      z AS (SELECT BrainRegion, count(DISTINCT ShortName) AS n_sessions, CAST(sum(k) AS BIGINT) AS n_traces FROM k GROUP BY ALL)
      SELECT BrainRegion, pos, {qr('avg(m)')} AS mean, {qr('CASE WHEN count(m) = n_sessions THEN stddev_samp(m) / sqrt(count(m)) END')} AS sem, n_sessions, n_traces
      FROM b JOIN z USING (BrainRegion) GROUP BY BrainRegion, pos, n_sessions, n_traces"""


def _preferred_activity(spark, sf, at):
    d = cp.preferred_side_activity(_pos(spark, sf), ["BrainRegion"], _preferred(spark, sf), at)
    return d.select("BrainRegion", "pos", rnd("mean").alias("mean"), rnd("sem").alias("sem"), "n_sessions", "n_traces")


@query("F42_preferred_side_after", _preferred_sql("0"))
def f42_after(spark, sf):
    return _preferred_activity(spark, sf, "after")


@query("F42_preferred_side_before", _preferred_sql("longest - last"))
def f42_before(spark, sf):
    return _preferred_activity(spark, sf, "before")


_ACTIVE = "(SELECT ShortName, trace_id, quantile_idx FROM reduc GROUP BY ALL HAVING round(avg(x), 9) > 0.03)"


@query(
    "F43_side_area_counts",
    f"""WITH p AS (SELECT * FROM {_POS} p), f AS (SELECT DISTINCT {TR} FROM {_PREF} f), a AS (SELECT * FROM {_ACTIVE} a),
      t AS (SELECT ShortName, count(DISTINCT trace_id) AS n_all FROM p GROUP BY ALL), s AS (SELECT ShortName, count(*) AS k FROM f GROUP BY ALL),
      c AS (SELECT ShortName, quantile_idx, count(*) AS ka, count(f.trace_id) AS kb FROM a LEFT JOIN f USING ({TR}) GROUP BY ALL),
      g AS (SELECT {TR}, quantile_idx, sum(abs(l - r)) AS area FROM (SELECT {TR}, quantile_idx, pos, avg(v) FILTER (WHERE ChoiceLeft = 1) AS l,
        avg(v) FILTER (WHERE ChoiceLeft = 0) AS r FROM p SEMI JOIN f USING ({TR}) GROUP BY ALL) q GROUP BY ALL)
      SELECT d.ShortName, d.quantile_idx, g.trace_id, {qr('area')} AS area, CASE WHEN g.trace_id IS NOT NULL THEN a.trace_id IS NOT NULL END AS is_active,
        n_all, coalesce(k, 0) AS n_significant, coalesce(ka, 0) AS n_active, coalesce(kb, 0) AS n_active_significant
      FROM (SELECT DISTINCT ShortName, quantile_idx FROM p) d JOIN t USING (ShortName) LEFT JOIN s USING (ShortName) LEFT JOIN c USING (ShortName, quantile_idx)
        LEFT JOIN g ON g.ShortName = d.ShortName AND g.quantile_idx = d.quantile_idx
        LEFT JOIN a ON a.ShortName = g.ShortName AND a.trace_id = g.trace_id AND a.quantile_idx = g.quantile_idx""",
)
def f43_counts(spark, sf):
    r = fx.reduc(spark, sf).groupBy(*T, "quantile_idx").agg(F.round(F.avg("x"), 9).alias("m"))
    d = cp.side_area_counts(_pos(spark, sf), "quantile_idx", _preferred(spark, sf), r.filter("m > 0.03"))
    return d.withColumn("area", rnd("area"))


@query(
    "F39_mean_traces",
    f"""SELECT region, quantile_idx, pos, {qr('avg(m)')} AS mean, {qr('stddev_samp(m) / sqrt(count(m))')} AS sem, count(m) AS n_sessions FROM
      (SELECT ShortName, CASE WHEN trace_id % 2 = 0 THEN 'LFC' ELSE 'MFC' END AS region, quantile_idx, pos, avg(v) AS m FROM {_POS} p GROUP BY ALL) s GROUP BY ALL""",
)
def f39_traces(spark, sf):
    cut = _pos(spark, sf).withColumn("region", F.expr("if(trace_id % 2 = 0, 'LFC', 'MFC')"))
    d = cp.session_mean_traces(cut, ["region", "quantile_idx"])
    return d.select("region", "quantile_idx", "pos", rnd("mean").alias("mean"), rnd("sem").alias("sem"), "n_sessions")


@query(
    "F37_expand_raw",
    f"""WITH e AS (SELECT * FROM sampling_epochs WHERE epoch = 'Sampling' AND ChoiceCorrect IS NOT NULL AND calcStimulusTime IS NOT NULL),
      s AS (SELECT ShortName, 100 * avg(ChoiceCorrect) AS p FROM e GROUP BY ALL)
      SELECT e.ShortName, TrialNumber, trace_id, DVstr, CAST(frame - trace_start_idx AS INT) AS pos, v AS raw, {qr('avg(v) OVER (PARTITION BY e.ShortName, TrialNumber, trace_id)')} AS mean_activity,
        {qr('p')} AS performance FROM e JOIN s USING (ShortName) JOIN frames f ON f.ShortName = e.ShortName AND frame BETWEEN trace_start_idx AND trace_end_idx""",
)
def f37_raw(spark, sf):
    from trialweave.operators import traces as tr

    e = fx.sampling_epochs(spark, sf).filter("epoch = 'Sampling'").drop("label")
    cut = tr.slice_join(e, fx.frames(spark, sf).drop("label")).withColumn("pos", F.expr("frame - trace_start_idx"))
    d = cp.expand_trials(cut, ["DVstr"], raw=True)
    values = [rnd(c).alias(c) for c in ("mean_activity", "performance")]
    return d.select("ShortName", "TrialNumber", "trace_id", "DVstr", *values, F.posexplode("raw").alias("pos", "raw"))


def _ordered_sql(scale, only="true"):
    return f"""WITH m AS (SELECT ChoiceCorrect, {TR}, pos, round(avg(v), 9) AS v FROM {_POS} p GROUP BY ALL),
      k AS (SELECT {TR}, row_number() OVER (PARTITION BY ShortName ORDER BY peak, trace_id) AS sort_pos FROM
        (SELECT {TR}, min(pos) AS peak FROM (SELECT *, max(v) OVER (PARTITION BY {TR}) AS mx FROM m WHERE ChoiceCorrect = 1) x WHERE v = mx GROUP BY ALL) y)
      SELECT ChoiceCorrect, {TR}, pos, round_even((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 4) AS v, sort_pos FROM m JOIN k USING ({TR}) WHERE {only}
      WINDOW w AS (PARTITION BY {scale})"""


@query("F31_heatmap_copied_order", _ordered_sql(f"ChoiceCorrect, {TR}"))
def f31_copied(spark, sf):
    d = cp.heatmaps_in_order(_pos(spark, sf), "ChoiceCorrect", 1)
    return d.select("ChoiceCorrect", *T, "pos", "v", "sort_pos")


@query("C8_copy_order_only_traces", _ordered_sql(TR, "trace_id IN (SELECT vec_id FROM embeddings WHERE embedding[1] > 0)"))
def c8_only(spark, sf):
    only = fx.frames(spark, sf).filter("frame = 0 and v > 0")
    d = cp.heatmaps_in_order(_pos(spark, sf), "ChoiceCorrect", 1, shared=True, only=only)
    return d.select("ChoiceCorrect", *T, "pos", "v", "sort_pos")
