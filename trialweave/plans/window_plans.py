"""Trial-order queries (E rows)."""

from pyspark.sql import functions as F

from trialweave.functions.skew import number_rows, position_block
from trialweave.operators import windows
from trialweave.operators.behavior import rnd
from trialweave.plans.registry import query
from trialweave.sources import fixtures as fx
from trialweave.sources.sql_views import rnd as qr
from trialweave.sources.sql_views import streak_sql

SESS = ["Name", "SessionNum"]
STREAKS = ["PrevOutcomeCount", "PrevDirectionIsLeftCount", "PrevLeftRewardedCount"]

# Trial numbers that skip one after every tenth trial, so that streaks meet gaps on the whole table.
_GAPPED = "(SELECT * REPLACE (TrialNumber + TrialNumber // 10 AS TrialNumber) FROM trials)"


def _gapped(spark, sf):
    n = F.col("TrialNumber")
    return fx.trials(spark, sf).withColumn("TrialNumber", (n + F.floor(n / 10)).cast("long"))


@query("E1_outcome_streaks", f"SELECT event_id, TrialNumber, {', '.join(STREAKS)} FROM ({streak_sql(_GAPPED)}) z")
def e1(spark, sf):
    return windows.outcome_streaks(_gapped(spark, sf), SESS).select("event_id", "TrialNumber", *STREAKS)


_PREV = ["PrevDV", *[f"PrevCalcStimulusTime{i}" for i in (1, 2, 3, 4)]]


@query("E2_previous_trial_columns", f"SELECT event_id, TrialNumber, {', '.join(_PREV)} FROM ({streak_sql(_GAPPED)}) z")
def e2(spark, sf):
    return windows.outcome_streaks(_gapped(spark, sf), SESS).select("event_id", "TrialNumber", *_PREV)


@query("E3_stay_baseline", "SELECT event_id, PrevChoiceCorrect, PrevChoiceLeft, Stay, StayBaseline FROM trials_prev")
def e3(spark, sf):
    return fx.trials_prev(spark, sf).select("event_id", "PrevChoiceCorrect", "PrevChoiceLeft", "Stay", "StayBaseline")


@query(
    "E4_reward_rate",
    f"""SELECT event_id, {", ".join(f'''CASE WHEN TrialNumber > {n} THEN {qr(f"""avg(coalesce({c}, 0)) OVER
      (PARTITION BY Name, SessionNum ORDER BY TrialNumber ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)""")} END AS {o}'''
      for o, c, n in (("RewardRate5", "ChoiceCorrect", 5), ("RewardRate10", "ChoiceCorrect", 10),
                      ("RewardRateSim5", "SimChoiceCorrect", 5)))} FROM trials""",
)
def e4(spark, sf):
    rates = {
        "RewardRate5": ("ChoiceCorrect", 5),
        "RewardRate10": ("ChoiceCorrect", 10),
        "RewardRateSim5": ("SimChoiceCorrect", 5),
    }
    out = windows.reward_rate(fx.trials(spark, sf), SESS, "TrialNumber", rates)
    return out.select("event_id", *[rnd(c).alias(c) for c in rates])


@query(
    "E5_speed_class",
    """WITH x AS (SELECT *, CASE WHEN NOT over AND count(*) OVER (PARTITION BY Name, SessionNum, DVstr, over) >= 3
        THEN ntile(3) OVER (PARTITION BY Name, SessionNum, DVstr, over ORDER BY calcStimulusTime, TrialNumber) END AS q
      FROM (SELECT *, calcStimulusTime > 2.0 AS over FROM trials) t),
    e AS (SELECT Name, SessionNum, DVstr, over, q, min(calcStimulusTime) AS lo, max(calcStimulusTime) AS hi
      FROM x GROUP BY ALL),
    b AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY Name, SessionNum, DVstr, over ORDER BY q), lo) AS left_ FROM e)
    SELECT event_id, x.q AS quantile_idx, coalesce(CAST(x.q AS VARCHAR), CASE WHEN x.over THEN 'above_2.0s' END)
      AS quantile_label, left_ AS bin_left, hi AS bin_right
    FROM x JOIN b ON x.Name = b.Name AND x.SessionNum = b.SessionNum AND x.DVstr = b.DVstr AND x.over = b.over
      AND x.q IS NOT DISTINCT FROM b.q""",
)
def e5(spark, sf):
    out = windows.speed_class(
        fx.trials(spark, sf), [*SESS, "DVstr"], "calcStimulusTime", "TrialNumber", cut_above=2.0, bounds=True
    )
    return out.select("event_id", "quantile_idx", "quantile_label", "bin_left", "bin_right")


@query(
    "E6_remainder_cursor",
    """SELECT event_id, CASE WHEN n >= 3 THEN
        1 + (CASE WHEN rn > k + CASE WHEN (0 - cur + 3) % 3 < m THEN 1 ELSE 0 END THEN 1 ELSE 0 END)
          + (CASE WHEN rn > 2 * k + CASE WHEN (0 - cur + 3) % 3 < m THEN 1 ELSE 0 END
              + CASE WHEN (1 - cur + 3) % 3 < m THEN 1 ELSE 0 END THEN 1 ELSE 0 END) END AS quantile_idx
    FROM (SELECT event_id, n, n // 3 AS k, n % 3 AS m, cur,
        row_number() OVER (PARTITION BY Name, SessionNum, DVstr ORDER BY calcStimulusTime, TrialNumber) AS rn
      FROM trials JOIN (SELECT Name, SessionNum, DVstr, n, CAST(coalesce(sum(CASE WHEN n >= 3 THEN n % 3 ELSE 0 END) OVER
          (ORDER BY Name, SessionNum, DVstr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) % 3 AS cur
        FROM (SELECT Name, SessionNum, DVstr, count(*) AS n FROM trials GROUP BY ALL) g) c
      USING (Name, SessionNum, DVstr)) z""",
)
def e6(spark, sf):
    out = windows.speed_class(
        fx.trials(spark, sf), [*SESS, "DVstr"], "calcStimulusTime", "TrialNumber", cursor=True, session_keys=SESS
    )
    return out.select("event_id", "quantile_idx")


@query(
    "E7_time_groups",
    """SELECT event_id, time_group,
      median(calcStimulusTime) OVER (PARTITION BY Name, SessionNum, time_group) AS group_median
    FROM (SELECT *, CASE WHEN calcStimulusTime <= quantile_cont(calcStimulusTime, 1/3.0::DOUBLE) OVER s THEN 'Early'
        WHEN calcStimulusTime <= quantile_cont(calcStimulusTime, 2/3.0::DOUBLE) OVER s THEN 'Mid' ELSE 'Late' END AS time_group
      FROM trials WINDOW s AS (PARTITION BY Name, SessionNum)) x""".replace(
        "median(calcStimulusTime) OVER (PARTITION BY Name, SessionNum, time_group)",
        qr("median(calcStimulusTime) OVER (PARTITION BY Name, SessionNum, time_group)"),
    ),
)
def e7(spark, sf):
    out = windows.time_groups(fx.trials(spark, sf), SESS, "calcStimulusTime", 3)
    return out.select("event_id", "time_group", rnd("group_median").alias("group_median"))


@query(
    "E8_learned_value",
    f"""SELECT l.event_id, {qr('l.val')} AS q_left, {qr('r.val')} AS q_right,
      {qr('ln(greatest(l.val, 0.01) / greatest(r.val, 0.01)) / ln(100)')} AS q_val
    FROM learn_left l JOIN learn_right r USING (event_id)""",
)
def e8(spark, sf):
    out = windows.learned_values(fx.trials(spark, sf), SESS, "TrialNumber", rate=0.37)
    return out.select("event_id", *[rnd(c).alias(c) for c in ("q_left", "q_right", "q_val")])


@query("E9_reward_rate_learner", f"SELECT event_id, {qr('val')} AS learned_rate FROM learn_rate")
def e9(spark, sf):
    out = windows.replay_average(
        fx.trials(spark, sf),
        SESS,
        "TrialNumber",
        F.col("ChoiceCorrect").cast("double"),
        F.lit(True),
        0.2,
        0.5,
        "learned_rate",
    )
    return out.select("event_id", rnd("learned_rate").alias("learned_rate"))


@query(
    "E10_trial_numbering",
    "SELECT event_id, row_number() OVER (PARTITION BY Name, SessionNum ORDER BY event_id) AS n FROM trials",
)
def e10(spark, sf):
    eid = F.col("event_id")
    out = number_rows(fx.trials(spark, sf), SESS, [eid], position_block(eid), "n")
    return out.select("event_id", "n")
