"""SQL text of the fixture views, used only to check results against a second engine."""

from __future__ import annotations

import re


def rnd(expr: str, digits: int = 9) -> str:
    """Rounding without a negative zero, shifted off exact decimal halves like ``operators.behavior.rnd``."""
    return f"(round(CAST({expr} AS DOUBLE) + {1.37 * 10.0 ** -(digits + 1)!r}::DOUBLE, {digits}) + 0.0::DOUBLE)"


def erf_sql(x: str) -> str:
    """The error function by the same rational approximations as ``operators.compare.erf``."""
    from trialweave.operators.compare import CODY

    def horner(c, v):
        out = f"{c[0]!r}::DOUBLE"
        for k in c[1:]:
            out = f"({out} * {v} + {k!r}::DOUBLE)"
        return out

    x, z = f"({x})", f"abs({x})"
    low, mid, far = (lambda v, r=r: f"({horner(r[0], v)} / {horner(r[1], v)})" for r in CODY)
    near = f"{x} * {low(f'({x} * {x})')}"
    square = f"(1 / ({z} * {z}))"
    tail = f"(CASE WHEN {z} <= 4 THEN exp(-({z} * {z})) * {mid(z)} ELSE exp(-({z} * {z})) / {z} * (1 / sqrt(pi()) - {square} * {far(square)}) END)"
    return f"(CASE WHEN {z} <= 0.46875 THEN {near} WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} - 1 END)"


def q6(expr: str) -> str:
    return rnd(expr, 6)


def streak_sql(src: str, pos: str = "TrialNumber", keep: str = "*") -> str:
    """Outcome, choice-side and rewarded-side streaks before each trial (islands over contiguous numbers)."""
    names = {"o": "PrevOutcomeCount", "d": "PrevDirectionIsLeftCount", "l": "PrevLeftRewardedCount"}
    w = f"(PARTITION BY Name, SessionNum ORDER BY {pos})"
    flags = ", ".join(f"CASE WHEN cont AND lag(s_{k}) OVER {w} = s_{k} THEN 0 ELSE 1 END AS f_{k}" for k in names)
    isl = ", ".join(f"sum(f_{k}) OVER {w} AS i_{k}" for k in names)
    runs = ", ".join(
        f"s_{k} * row_number() OVER (PARTITION BY Name, SessionNum, i_{k} ORDER BY {pos}) AS r_{k}" for k in names
    )
    prev = ", ".join(f"CASE WHEN cont THEN lag(r_{k}) OVER {w} ELSE 0 END AS {n}" for k, n in names.items())
    lags = ", ".join(
        [f"CASE WHEN cont THEN lag(DV) OVER {w} END AS PrevDV"]
        + [
            f"CASE WHEN lag({pos}, {i}) OVER {w} = {pos} - {i} THEN lag(calcStimulusTime, {i}) OVER {w} END "
            f"AS PrevCalcStimulusTime{i}"
            for i in (1, 2, 3, 4)
        ]
    )
    return f"""SELECT {keep}, {prev}, {lags} FROM (
      SELECT *, {runs} FROM (
        SELECT *, {isl} FROM (
          SELECT *, {flags} FROM (
            SELECT *, coalesce({pos} - lag({pos}) OVER {w} = 1, false) AS cont,
              CASE WHEN ChoiceCorrect = 1 THEN 1 ELSE -1 END AS s_o,
              CASE WHEN ChoiceLeft IS NULL THEN 0 WHEN ChoiceLeft = 1 THEN 1 ELSE -1 END AS s_d,
              CASE WHEN LeftRewarded THEN 1 ELSE -1 END AS s_l
            FROM {src}) a) b) c) d"""


DVSTR = "CASE WHEN abs({0}) >= 0.66 THEN 'Easy' WHEN abs({0}) <= 0.33 THEN 'Hard' ELSE 'Med' END"



def learn_sql(applies: str, rate: float) -> str:
    """Learned value before each trial as a sum over earlier updates weighted by their age."""
    return f"""SELECT y.event_id, 0.5 * pow({1 - rate}::DOUBLE, max(y.r - y.a)) + coalesce(sum(z.o * {rate}::DOUBLE
        * pow({1 - rate}::DOUBLE, y.r - y.a - z.r)), 0) AS val
      FROM (SELECT *, sum(a) OVER (PARTITION BY Name, SessionNum ORDER BY TrialNumber) AS r FROM
        (SELECT *, {applies} AS a FROM trials) t) y
      LEFT JOIN (SELECT *, sum(a) OVER (PARTITION BY Name, SessionNum ORDER BY TrialNumber) AS r,
          coalesce(ChoiceCorrect, 0)::DOUBLE AS o FROM (SELECT *, {applies} AS a FROM trials) t) z
        ON z.Name = y.Name AND z.SessionNum = y.SessionNum AND z.a = 1 AND z.TrialNumber < y.TrialNumber
      GROUP BY y.event_id"""


VIEWS: dict[str, str] = {
    "ev": """SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
        CAST(floor((least(day(ts), 30) - 1) / 10.0) AS INT) + 1 AS sess FROM events""",
    "ev_epochs": """SELECT event_id, 'S' || user_id AS Name, sess AS SessionNum, CAST(day(ts) AS INT) AS TrialNumber,
        CASE event_type WHEN 'signup' THEN 'Pre-Trial Start' WHEN 'purchase' THEN 'Reward' WHEN 'view' THEN 'Punishment'
          WHEN 'click' THEN 'Decision Time' ELSE 'Feedback Wait' END AS epoch,
        CAST(k AS BIGINT) AS trace_start_idx, CAST(k + floor(value) AS BIGINT) AS trace_end_idx,
        value / 50.0::DOUBLE AS epoch_time FROM ev""",
    "trials": f"""SELECT event_id, 'S' || user_id AS Name,
        CASE sess WHEN 1 THEN '2024-01-01' WHEN 2 THEN '2024-01-11' ELSE '2024-01-21' END AS Date,
        sess AS SessionNum, 'S' || user_id || '_' || sess AS SessId,
        row_number() OVER (PARTITION BY user_id, sess ORDER BY ts, event_id) AS TrialNumber,
        (k - 50) / 50.0::DOUBLE AS DV, {DVSTR.format('((k - 50) / 50.0::DOUBLE)')} AS DVstr,
        value / 50.0::DOUBLE AS calcStimulusTime, k > 50 AS LeftRewarded,
        CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 0 ELSE 1 END AS ChoiceCorrect,
        CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN CASE WHEN k > 50 THEN 0 ELSE 1 END
          ELSE CASE WHEN k > 50 THEN 1 ELSE 0 END END AS ChoiceLeft,
        event_id % 97 <> 0 AS valid, round(0.3 * (1 + event_id % 4), 1)::DOUBLE AS MinSample,
        CASE WHEN user_id % 2 = 0 THEN 2.0::DOUBLE ELSE 5.0::DOUBLE END AS GUI_TimeOutIncorrectChoice,
        CASE WHEN (user_id + sess) % 2 = 0 THEN 'MFC' ELSE 'LFC' END AS Region,
        CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS OptoEnabled,
        CASE WHEN event_id % 8 < 4 THEN 0.0::DOUBLE ELSE 0.65::DOUBLE END AS GUI_OptoStartDelay,
        5.0::DOUBLE AS GUI_StimulusTime,
        round(0.8 * value / 50.0 + 0.002 * k, 6)::DOUBLE AS SimRT,
        CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 5 = 0 THEN CASE event_type WHEN 'view' THEN 1 ELSE 0 END
          WHEN event_type = 'view' THEN 0 ELSE 1 END AS SimChoiceCorrect
      FROM ev""",
    "trials_prev": f"""SELECT *, CASE WHEN PrevDV IS NOT NULL THEN {DVSTR.format('PrevDV')} END AS PrevDVstr,
        CASE WHEN PrevOutcomeCount <> 0 THEN CASE WHEN PrevOutcomeCount >= 1 THEN 1 ELSE 0 END END AS PrevChoiceCorrect,
        PrevChoiceLeft_ AS PrevChoiceLeft,
        CASE WHEN ChoiceLeft IS NOT NULL AND PrevOutcomeCount <> 0
          THEN CASE WHEN ChoiceLeft = PrevChoiceLeft_ THEN 1 ELSE 0 END END AS Stay,
        CASE WHEN PrevChoiceLeft_ IS NOT NULL
          THEN CASE WHEN (CASE WHEN LeftRewarded THEN 1 ELSE 0 END) = PrevChoiceLeft_ THEN 1 ELSE 0 END END AS StayBaseline
      FROM (SELECT *, CASE WHEN PrevOutcomeCount <> 0
          THEN CASE WHEN PrevDirectionIsLeftCount >= 1 THEN 1 ELSE 0 END END AS PrevChoiceLeft_
        FROM ({streak_sql('trials')}) s) t""",
    "trials_rr": """SELECT *, CASE WHEN row_number() OVER w > 5 THEN avg(coalesce(ChoiceCorrect, 0)) OVER
          (PARTITION BY Name, SessionNum ORDER BY TrialNumber ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS RewardRate5
      FROM trials_prev WINDOW w AS (PARTITION BY Name, SessionNum ORDER BY TrialNumber)""",
    "trials_q": """SELECT *, CASE WHEN count(*) OVER (PARTITION BY Name, SessionNum, DVstr) >= 3
          THEN ntile(3) OVER (PARTITION BY Name, SessionNum, DVstr ORDER BY calcStimulusTime, TrialNumber) END AS quantile_idx
      FROM trials_rr""",
    "learn_left": learn_sql("CASE WHEN ChoiceLeft = 1 THEN 1 ELSE 0 END", 0.37),
    "learn_right": learn_sql("CASE WHEN ChoiceLeft = 0 THEN 1 ELSE 0 END", 0.37),
    "learn_rate": learn_sql("1", 0.2),
    "frames": """SELECT 'N' || label AS ShortName, vec_id AS trace_id, label,
        CAST(i - 1 AS BIGINT) AS frame, round(CAST(embedding[i] AS DOUBLE), 6) AS v
      FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e""",
    "frames_null": """SELECT ShortName, trace_id, label, frame,
        CASE WHEN (trace_id + frame) % 17 = 0 THEN NULL ELSE v END AS v FROM frames""",
    "frames_big": """SELECT 'SUP' || (l_suppkey % 10) AS ShortName, l_suppkey AS trace_id,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
          l_quantity, l_extendedprice) - 1 AS frame, round(l_extendedprice / 1000, 6) AS v FROM lineitem""",
    "epochs": """SELECT ShortName, label, t AS TrialNumber, epoch, state_id, trace_start_idx, trace_end_idx,
        4.0::DOUBLE AS acq_sampling_rate, (trace_end_idx - trace_start_idx + 1) / 4.0::DOUBLE AS epoch_time, 8::BIGINT AS MaxTrial,
        cl AS ChoiceLeft, cc AS ChoiceCorrect, 1 + t % 3 AS quantile_idx,
        (CASE WHEN cl = cc THEN 1 ELSE -1 END) * (1 + (t * 5 + label) % 3) / 3.0::DOUBLE AS DV,
        CASE WHEN t > 1 THEN (CASE WHEN (t - 1) % 2 = CASE WHEN (t - 1) % 4 <> 3 THEN 1 ELSE 0 END THEN 1 ELSE -1 END)
          * (1 + ((t - 1) * 5 + label) % 3) / 3.0::DOUBLE END AS PrevDV,
        CASE WHEN t > 1 THEN (t - 1) % 2 END AS PrevChoiceLeft,
        CASE WHEN t > 1 THEN CASE WHEN (t - 1) % 4 <> 3 THEN 1 ELSE 0 END END AS PrevChoiceCorrect,
        CASE WHEN label % 2 = 0 THEN 'M2_Bi' ELSE 'ALM_Bi' END AS BrainRegion,
        CASE WHEN label % 3 = 2 THEN 'L5' ELSE 'L23' END AS Layer
      FROM (SELECT *, CAST(t % 2 AS BIGINT) AS cl, CAST(CASE WHEN t % 4 <> 3 THEN 1 ELSE 0 END AS BIGINT) AS cc,
          CASE e WHEN 1 THEN 'Pre-Trial Start' WHEN 2 THEN 'Sampling' WHEN 3 THEN 'Movement to Lateral Port'
            ELSE CASE WHEN t % 4 <> 3 THEN 'Reward' ELSE 'Timeout Punishment' END END AS epoch, e AS state_id,
          CASE e WHEN 1 THEN b WHEN 2 THEN b + 1 WHEN 3 THEN b + L + 1 ELSE b + L + 2 END AS trace_start_idx,
          CASE e WHEN 1 THEN b WHEN 2 THEN b + L WHEN 3 THEN b + L + 1 ELSE b + 7 END AS trace_end_idx
        FROM (SELECT ShortName, label, t, 8 * (t - 1) AS b, 2 + t % 3 AS L, unnest(range(1, 5)) AS e FROM (
          SELECT DISTINCT 'N' || label AS ShortName, label, unnest(range(1, 9)) AS t FROM embeddings) x) y) z""",
    "sampling_epochs": """SELECT * EXCLUDE (name, x), CASE WHEN x.s = 4 AND label % 2 = 0 THEN 'Feedback Wait' ELSE name END AS epoch,
        x.s AS state_id, x.a AS trace_start_idx, x.z AS trace_end_idx, (x.z - x.a + 1) / 4.0::DOUBLE AS epoch_time
      FROM (SELECT * EXCLUDE (epoch, ChoiceCorrect, epoch_time, state_id, trace_start_idx, trace_end_idx, MaxTrial, PrevDV, PrevChoiceLeft, PrevChoiceCorrect),
          CASE WHEN (TrialNumber * 3 + label) % 7 <> 0 THEN ChoiceCorrect END AS ChoiceCorrect,
          CASE WHEN (TrialNumber + label) % 11 <> 0 THEN (2 + TrialNumber % 3) / 4.0::DOUBLE + ((TrialNumber * 7 + label * 3) % 10) / 10.0::DOUBLE END AS calcStimulusTime,
          CASE WHEN abs(DV) >= 0.66 THEN 'Easy' WHEN abs(DV) <= 0.33 THEN 'Hard' ELSE 'Med' END AS DVstr,
          CASE WHEN state_id = 3 AND (TrialNumber + label) % 5 = 0 THEN 'Decision Time' ELSE replace(epoch, 'Timeout ', '') END AS name,
          unnest(CASE WHEN state_id = 4 AND label % 2 = 0
            THEN [{'s': 4::BIGINT, 'a': trace_start_idx, 'z': trace_start_idx}, {'s': 5::BIGINT, 'a': trace_start_idx + 1, 'z': trace_end_idx}]
            ELSE [{'s': state_id::BIGINT, 'a': trace_start_idx, 'z': trace_end_idx}] END) AS x FROM epochs) q""",
    "ep_frames": """SELECT e.* EXCLUDE (label), f.trace_id, f.frame, f.v FROM epochs e JOIN frames f
        ON e.ShortName = f.ShortName AND f.frame BETWEEN e.trace_start_idx AND e.trace_end_idx""",
    "reduc": """SELECT ShortName, trace_id, TrialNumber, ChoiceLeft, ChoiceCorrect, quantile_idx, DV, PrevDV, PrevChoiceLeft,
        PrevChoiceCorrect, BrainRegion, Layer, round(avg(v), 9) AS x FROM ep_frames WHERE epoch = 'Sampling' GROUP BY ALL""",
    "conds": """SELECT ShortName, trace_id, BrainRegion, Layer, TrialNumber, x, q AS quantile, c.n AS data_col, c.s AS side, p.n AS prior_col, p.v AS prior_val
      FROM (SELECT *, unnest([{'n': 'none', 'v': 'none'}, {'n': 'PrevChoiceLeft', 'v': coalesce(CAST(PrevChoiceLeft AS VARCHAR), 'null')},
          {'n': 'PrevChoiceCorrect', 'v': coalesce(CAST(PrevChoiceCorrect AS VARCHAR), 'null')}]) AS p FROM (
        SELECT *, unnest(['All', CAST(quantile_idx AS VARCHAR)]) AS q FROM (
          SELECT *, unnest([{'n': 'ChoiceCorrect', 's': ChoiceCorrect = 1}, {'n': 'PrevChoiceCorrect', 's': PrevChoiceCorrect = 1},
            {'n': 'Difficulty', 's': CASE WHEN abs(abs(DV) - 1) < 1e-6 THEN true WHEN abs(abs(DV) - 1/3.0::DOUBLE) < 1e-6 THEN false END},
            {'n': 'PrevDifficulty', 's': CASE WHEN abs(abs(PrevDV) - 1) < 1e-6 THEN true WHEN abs(abs(PrevDV) - 1/3.0::DOUBLE) < 1e-6 THEN false END},
            {'n': 'ChoiceLeft', 's': ChoiceLeft = 1}, {'n': 'PrevChoiceLeft', 's': PrevChoiceLeft = 1}]) AS c FROM reduc) a) b) d
      WHERE c.s IS NOT NULL AND x IS NOT NULL""",
    "tests": """SELECT ShortName, trace_id, BrainRegion, Layer, quantile, data_col, prior_col, prior_val, left_mean, right_mean, left_median, right_median,
        n_left, n_right, rs - n_left * (n_left + 1) / 2.0::DOUBLE AS u, (rs - n_left * (n_left + 1) / 2.0::DOUBLE) / (n_left * n_right) AS auc
      FROM (SELECT ShortName, trace_id, BrainRegion, Layer, quantile, data_col, prior_col, prior_val, round(avg(x) FILTER (WHERE side), 12) AS left_mean,
          round(avg(x) FILTER (WHERE NOT side), 12) AS right_mean, round(median(x) FILTER (WHERE side), 12) AS left_median, round(median(x) FILTER (WHERE NOT side), 12) AS right_median,
          count(*) FILTER (WHERE side) AS n_left, count(*) FILTER (WHERE NOT side) AS n_right, sum(rk) FILTER (WHERE side) AS rs
        FROM (SELECT *, rank() OVER (PARTITION BY ShortName, trace_id, quantile, data_col, prior_col, prior_val ORDER BY x)
            + (count(*) OVER (PARTITION BY ShortName, trace_id, quantile, data_col, prior_col, prior_val, x) - 1) / 2.0::DOUBLE AS rk FROM conds) c
        GROUP BY ALL) g WHERE n_left > 0 AND n_right > 0""",
    "regions": """SELECT 'R' || label || (CASE WHEN vec_id % 2 = 0 THEN '_left' ELSE '_right' END) AS area_name,
        CAST(10 + label % 7 + 3 * (vec_id % 2) AS BIGINT) AS weight FROM embeddings GROUP BY ALL""",
    "region_frames": """SELECT 'R' || label AS region, CASE WHEN trace_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, frame,
        round(avg(v), 9) AS v FROM frames GROUP BY ALL""",
    "tracking": "SELECT 'N' || label AS File, CAST(floor((rn - 1) / 6) AS BIGINT) + 1 AS TrialNumber, (rn - 1) % 6 AS frame, "
    + ", ".join(
        f"CASE WHEN abs(e{2 * j}) >= 0.02 THEN round(100 * e{2 * j}, 6) END AS {p}_x, "
        f"CASE WHEN abs(e{2 * j}) >= 0.02 THEN round(100 * e{2 * j + 1}, 6) END AS {p}_y"
        for j, p in enumerate(["EL", "LL", "ER", "LR", "T"])
    )
    + """, round(4 * abs(e10), 6) AS T_score, round(100 * e11, 6) AS screw_x, round(100 * e12, 6) AS screw_y
      FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, """
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(13))
    + " FROM embeddings) q",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it (transitively) names."""
    needed: list[str] = []

    def visit(text: str, self_name: str = ""):
        for name in VIEWS:
            if name != self_name and name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name], name)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    sql = sql.strip()
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if sql[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
