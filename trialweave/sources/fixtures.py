"""Trial, trace and tracking views derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.functions.skew import number_rows
from trialweave.operators import windows
from trialweave.sources.tables import stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    # Microseconds since 1970 of the zone-free timestamp, whatever the session time zone is.
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        "cast(get_json_object(props, '$.k') as int) as k",
        "cast(floor((least(dayofmonth(ts), 30) - 1) / 10) + 1 as int) as sess",
        """(cast(unix_date(to_date(ts)) as bigint) * 86400 + hour(ts) * 3600 + minute(ts) * 60) * 1000000L
           + cast(extract(SECOND from ts) * 1000000 as bigint) as us""",
    )


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """The stored trial table."""
    return stored(spark, f"trials|{sf}", lambda: derive_trials(spark, sf))


def derive_trials(spark: SparkSession, sf: str) -> DataFrame:
    """One row per trial; numbering is blocked by hour so that a busy subject never fills one task."""
    rows = number_rows(
        ev(spark, sf).drop("ts"),
        ["user_id", "sess"],
        [F.col("us"), F.col("event_id")],
        F.expr("floor(us / 3600000000L)"),
        "TrialNumber",
    )
    correct = "case event_type when 'error' then null when 'view' then 0 else 1 end"
    return rows.selectExpr(
        "event_id",
        "concat('S', user_id) as Name",
        "case sess when 1 then '2024-01-01' when 2 then '2024-01-11' else '2024-01-21' end as Date",
        "sess as SessionNum",
        "concat('S', user_id, '_', sess) as SessId",
        "TrialNumber",
        "(k - 50) / 50.0D as DV",
        "case when abs((k - 50) / 50.0D) >= 0.66 then 'Easy' when abs((k - 50) / 50.0D) <= 0.33 then 'Hard' else 'Med' end as DVstr",
        "value / 50.0D as calcStimulusTime",
        "k > 50 as LeftRewarded",
        f"{correct} as ChoiceCorrect",
        f"case {correct} when 1 then cast(k > 50 as int) when 0 then cast(k <= 50 as int) end as ChoiceLeft",
        "event_id % 97 != 0 as valid",
        "round(0.3D * (1 + event_id % 4), 1) as MinSample",
        "if(user_id % 2 = 0, 2.0D, 5.0D) as GUI_TimeOutIncorrectChoice",
        "if((user_id + sess) % 2 = 0, 'MFC', 'LFC') as Region",
        "if(event_id % 4 = 0, 1, 0) as OptoEnabled",
        "if(event_id % 8 < 4, 0.0D, 0.65D) as GUI_OptoStartDelay",
        "5.0D as GUI_StimulusTime",
        "round(0.8D * value / 50.0D + 0.002D * k, 6) as SimRT",
        f"if(event_id % 5 = 0, 1 - {correct}, {correct}) as SimChoiceCorrect",
    )


SESS = ["Name", "SessionNum"]


def ev_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch rows of one-day trials, one epoch per event."""
    return ev(spark, sf).selectExpr(
        "event_id",
        "concat('S', user_id) as Name",
        "sess as SessionNum",
        "dayofmonth(ts) as TrialNumber",
        """case event_type when 'signup' then 'Pre-Trial Start' when 'purchase' then 'Reward' when 'view' then 'Punishment'
           when 'click' then 'Decision Time' else 'Feedback Wait' end as epoch""",
        "cast(k as bigint) as trace_start_idx",
        "cast(k + floor(value) as bigint) as trace_end_idx",
        "value / 50.0D as epoch_time",
    )


def trials_prev(spark: SparkSession, sf: str) -> DataFrame:
    return windows.previous_trial(trials(spark, sf), SESS)


def trials_rr(spark: SparkSession, sf: str) -> DataFrame:
    return windows.reward_rate(trials(spark, sf), SESS, "TrialNumber", {"RewardRate5": ("ChoiceCorrect", 5)})


def trials_q(spark: SparkSession, sf: str) -> DataFrame:
    """Trials with their speed class."""
    return windows.speed_class(trials(spark, sf), [*SESS, "DVstr"], "calcStimulusTime", "TrialNumber")


def trials_prev_q(spark: SparkSession, sf: str) -> DataFrame:
    """Trials with previous-trial columns and their speed class."""
    return windows.speed_class(trials_prev(spark, sf), [*SESS, "DVstr"], "calcStimulusTime", "TrialNumber")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        F.concat(F.lit("N"), "label").alias("ShortName"),
        F.col("vec_id").alias("trace_id"),
        "label",
        F.posexplode("embedding").alias("frame", "v"),
    ).select(
        "ShortName",
        "trace_id",
        "label",
        F.col("frame").cast("long").alias("frame"),
        F.round(F.col("v").cast("double"), 6).alias("v"),
    )


def frames_null(spark: SparkSession, sf: str) -> DataFrame:
    gap = (F.col("trace_id") + F.col("frame")) % 17 == 0
    return frames(spark, sf).withColumn("v", F.when(~gap, F.col("v")))


def frames_big(spark: SparkSession, sf: str) -> DataFrame:
    """The stored long traces."""
    return stored(spark, f"frames_big|{sf}", lambda: derive_frames_big(spark, sf))


def trace_values(spark: SparkSession, sf: str) -> DataFrame:
    """The values of the long traces without their frames, for measures that need no order: nothing is shuffled for them."""
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("SUP"), F.col("l_suppkey") % 10).alias("ShortName"), F.col("l_suppkey").alias("trace_id"), F.round(F.col("l_extendedprice") / 1000, 6).alias("v"))


def derive_frames_big(spark: SparkSession, sf: str) -> DataFrame:
    """Frames are numbered in blocks of days, as many days as hold about 65,536 rows of the longest trace."""
    cols = "l_shipdate l_orderkey l_linenumber l_partkey l_quantity l_extendedprice".split()
    li = table(spark, sf, "lineitem").select("l_suppkey", *cols)
    day = F.unix_date(F.to_date("l_shipdate"))
    longest = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("a"), F.max(day).alias("z"))
    days = (F.max("z") - F.min("a") + 1) * F.lit(65_536) / F.max("n")
    sized = skew.attach(li, longest.agg(F.greatest(F.lit(1), F.floor(days)).alias("days"), F.min("a").alias("first")), [])
    rows = number_rows(sized, ["l_suppkey"], [F.col(c) for c in cols], F.floor((day - F.col("first")) / F.col("days")), "rn")
    return rows.select(
        F.concat(F.lit("SUP"), F.col("l_suppkey") % 10).alias("ShortName"),
        F.col("l_suppkey").alias("trace_id"),
        (F.col("rn") - 1).alias("frame"),
        F.round(F.col("l_extendedprice") / 1000, 6).alias("v"),
    )


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "embeddings")
        .selectExpr("concat('N', label) as ShortName", "label")
        .distinct()
        .selectExpr("*", "explode(sequence(1L, 8L)) as t")
        .selectExpr("*", "8 * (t - 1) as b", "2 + t % 3 as L", "t % 2 as cl", "cast(if(t % 4 != 3, 1, 0) as bigint) as cc")
        .selectExpr(
            "*",
            """stack(4, 'Pre-Trial Start', 1L, b, b, 'Sampling', 2L, b + 1, b + L,
                'Movement to Lateral Port', 3L, b + L + 1, b + L + 1,
                if(cc = 1, 'Reward', 'Timeout Punishment'), 4L, b + L + 2, b + 7)
               as (epoch, state_id, trace_start_idx, trace_end_idx)""",
        )
        .selectExpr(
            "ShortName",
            "label",
            "t as TrialNumber",
            "epoch",
            "state_id",
            "trace_start_idx",
            "trace_end_idx",
            "4.0D as acq_sampling_rate",
            "(trace_end_idx - trace_start_idx + 1) / 4.0D as epoch_time",
            "8L as MaxTrial",
            "cl as ChoiceLeft",
            "cc as ChoiceCorrect",
            "1 + t % 3 as quantile_idx",
            "if(cl = cc, 1, -1) * (1 + (t * 5 + label) % 3) / 3.0D as DV",
            """if(t > 1, if((t - 1) % 2 = if((t - 1) % 4 != 3, 1, 0), 1, -1) * (1 + ((t - 1) * 5 + label) % 3) / 3.0D, null)
               as PrevDV""",
            "if(t > 1, (t - 1) % 2, null) as PrevChoiceLeft",
            "if(t > 1, cast(if((t - 1) % 4 != 3, 1, 0) as bigint), null) as PrevChoiceCorrect",
            "if(label % 2 = 0, 'M2_Bi', 'ALM_Bi') as BrainRegion",
            "if(label % 3 = 2, 'L5', 'L23') as Layer",
        )
    )


def sampling_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs with decision times, unknown choices and times, and a feedback wait in every other session."""
    e = epochs(spark, sf).drop("MaxTrial", "PrevDV", "PrevChoiceLeft", "PrevChoiceCorrect")
    e = e.selectExpr(
        "* except (epoch, ChoiceCorrect, epoch_time, state_id, trace_start_idx, trace_end_idx)",
        "if((TrialNumber * 3 + label) % 7 = 0, null, ChoiceCorrect) as ChoiceCorrect",
        """if((TrialNumber + label) % 11 = 0, null,
             (2 + TrialNumber % 3) / 4.0D + ((TrialNumber * 7 + label * 3) % 10) / 10.0D) as calcStimulusTime""",
        "if(abs(DV) >= 0.66, 'Easy', if(abs(DV) <= 0.33, 'Hard', 'Med')) as DVstr",
        "if(state_id = 3 and (TrialNumber + label) % 5 = 0, 'Decision Time', replace(epoch, 'Timeout ', '')) as name",
        """explode(if(state_id = 4 and label % 2 = 0,
             array(named_struct('s', 4L, 'a', trace_start_idx, 'z', trace_start_idx), named_struct('s', 5L, 'a', trace_start_idx + 1, 'z', trace_end_idx)),
             array(named_struct('s', state_id, 'a', trace_start_idx, 'z', trace_end_idx)))) as x""",
    )
    return e.selectExpr(
        "* except (name, x)",
        "if(x.s = 4 and label % 2 = 0, 'Feedback Wait', name) as epoch",
        "x.s as state_id", "x.a as trace_start_idx", "x.z as trace_end_idx", "(x.z - x.a + 1) / 4.0D as epoch_time",
    )


def ep_frames(spark: SparkSession, sf: str) -> DataFrame:
    from trialweave.operators import traces

    return traces.slice_join(epochs(spark, sf).drop("label"), frames(spark, sf).drop("label"))


def reduc(spark: SparkSession, sf: str) -> DataFrame:
    """The stored trial reduction."""
    return stored(spark, f"reduc|{sf}", lambda: derive_reduc(spark, sf))


def derive_reduc(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each trace over the Sampling epoch of each trial."""
    keys = (
        "ShortName trace_id TrialNumber ChoiceLeft ChoiceCorrect quantile_idx DV PrevDV PrevChoiceLeft PrevChoiceCorrect "
        "BrainRegion Layer"
    ).split()
    ep = ep_frames(spark, sf).filter(F.col("epoch") == "Sampling")
    return ep.groupBy(*keys).agg(F.round(F.avg("v"), 9).alias("x"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    side = F.when(F.col("vec_id") % 2 == 0, "_left").otherwise("_right")
    return e.select(
        F.concat(F.lit("R"), "label", side).alias("area_name"),
        (10 + F.col("label") % 7 + 3 * (F.col("vec_id") % 2)).cast("long").alias("weight"),
    ).distinct()


def region_frames(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    side = F.when(F.col("trace_id") % 2 == 0, "left").otherwise("right")
    return f.groupBy(F.concat(F.lit("R"), "label").alias("region"), side.alias("side"), "frame").agg(
        F.round(F.avg("v"), 9).alias("v")
    )


def tracking(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    rows = number_rows(e, ["label"], [F.col("vec_id")], F.floor(F.col("vec_id") / 4096), "rn")

    pts = []
    for j, p in enumerate(["EL", "LL", "ER", "LR", "T"]):
        x, y = (f"cast(embedding[{2 * j + i}] as double)" for i in (0, 1))
        pts += [f"if(abs({x}) >= 0.02, round(100 * {c}, 6), null) as {p}_{n}" for n, c in (("x", x), ("y", y))]
    return rows.selectExpr(
        "concat('N', label) as File",
        "cast(floor((rn - 1) / 6) as bigint) + 1 as TrialNumber",
        "(rn - 1) % 6 as frame",
        *pts,
        "round(4 * abs(cast(embedding[10] as double)), 6) as T_score",
        "round(100 * cast(embedding[11] as double), 6) as screw_x",
        "round(100 * cast(embedding[12] as double), 6) as screw_y",
    )
