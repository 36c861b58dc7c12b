"""Stimulation-effect summaries: control against stimulated trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.operators import behavior as bh
from trialweave.operators import traces as tr

# State codes used by the configuration labels.
STIMULUS_DELIVERY, CENTER_REWARD, TRIGGER_WAIT, WAIT_REWARD = 8, 11, 4, 16


def arm_mean(value: str, opto: int) -> Column:
    return F.avg(F.when(F.col("OptoEnabled") == opto, F.col(value)))


def effect_size(control: Column, opto: Column, metric: str = "Gain") -> Column:
    """Drop in percent of control (``Gain``) or percent of the way to chance (``DistanceFromRandom``)."""
    if metric == "Gain":
        return -100 * (opto / F.nullif(control, F.lit(0.0)) - 1)
    if metric == "DistanceFromRandom":
        return 100 - 100 * F.abs(opto - 0.5) / F.nullif(control - 0.5, F.lit(0.0))
    raise ValueError(f"unknown effect metric {metric}")


def config_label(
    start: Column, delay: Column, duration: Column, stimulus: Column, end: Column, kind: Column
) -> Column:
    """Readable name of a stimulation setting; known settings have their own names."""

    def state(c: Column) -> Column:
        timed = F.when(stimulus.isin(1.0, 5.0), F.lit("Sampling")).otherwise(F.format_string("Sampling (%.1fs)", stimulus))
        center = F.when(kind == "FT", "Decision-Time").otherwise("Center-Reward")
        return (
            F.when(c == STIMULUS_DELIVERY, timed)
            .when(c == CENTER_REWARD, center)
            .when(c == TRIGGER_WAIT, "Pre-Stimulus Delay")
            .otherwise(F.concat(F.lit("State "), c.cast("string")))
        )

    sampling = start == STIMULUS_DELIVERY

    def near(c: Column, x: float) -> Column:
        return F.abs(c - x) < 0.01

    rt = sampling & (kind == "RT") & (stimulus >= 5) & near(delay, 0.3)
    ft = sampling & ~((kind == "RT") & (stimulus >= 5)) & (stimulus == 1)
    name = (
        F.when(rt & near(duration, 0.3), "Short RT")
        .when(rt & near(duration, 0.6), "Med RT")
        .when(ft & (delay == 0) & (duration == -1), "FT Full Sampling ")
        .when(ft & (delay == 0) & near(duration, 0.35), "FT Early Sampling")
        .when(ft & near(delay, 0.65) & near(duration, 0.35), "FT Late Sampling")
        .otherwise(
            F.concat(
                kind, F.lit(" - "), state(start), F.format_string(" - s: %.2fs → e: %.2fs", delay, delay + duration)
            )
        )
    )
    return F.concat(name, F.lit(" - End: "), state(end))


def config_groups(df: DataFrame, columns: Sequence[str], min_rows: int) -> DataFrame:
    """Rows of settings used often enough, with stimulus kind and coverage columns."""
    out = bh.keep_groups(df, columns, F.count(F.lit(1)) >= min_rows)
    feedback = F.col("start_state") == WAIT_REWARD
    full = (F.col("start_state") == STIMULUS_DELIVERY) & (F.col("start_delay") == 0) & (F.col("max_dur") == F.col("stim_time"))
    return out.withColumns(
        {
            "stim_kind": F.when(feedback, "feedback").when(F.col("stim_time") >= 5, "RT").otherwise("FT"),
            "coverage": F.when(full, "full").otherwise("partial"),
        }
    )


def enough_trials(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    arms = [F.count_if((F.col("OptoEnabled") == a) & F.col("ChoiceCorrect").isNotNull()) >= n for a in (0, 1)]
    return bh.keep_groups(df, keys, arms[0] & arms[1])


def arm_summary(df: DataFrame, keys: Sequence[str], min_trials: int = 0) -> DataFrame:
    """Trials and accuracy per arm, the effect, and whether both arms have enough trials."""
    n = [F.count_if((F.col("OptoEnabled") == a) & F.col("ChoiceCorrect").isNotNull()) for a in (0, 1)]
    c, o = arm_mean("ChoiceCorrect", 0), arm_mean("ChoiceCorrect", 1)
    return df.groupBy(*keys).agg(
        n[0].alias("n_control"),
        n[1].alias("n_opto"),
        c.alias("control"),
        o.alias("opto"),
        effect_size(c, o).alias("effect"),
        ((n[0] >= min_trials) & (n[1] >= min_trials)).alias("accepted"),
    )


def early_probability(df: DataFrame, keys: Sequence[str], cutoff: float) -> DataFrame:
    """Percent of trials up to the cutoff and their accuracy, per unit and arm."""
    early = F.col("calcStimulusTime") <= cutoff
    return df.groupBy(*keys, "OptoEnabled").agg(
        (100.0 * F.count_if(early) / F.count(F.lit(1))).alias("early"),
        (100 * F.avg(F.when(early, F.col("ChoiceCorrect")))).alias("early_accuracy"),
    )


def control_z(df: DataFrame, keys: Sequence[str], time: str = "calcStimulusTime", out: str = "z") -> DataFrame:
    """Time in deviations of the unit's control trials."""
    ctl = F.when(F.col("OptoEnabled") == 0, F.col(time))
    s = df.groupBy(*keys).agg(F.avg(ctl).alias("__m"), F.stddev_samp(ctl).alias("__d"))
    z = (F.col(time) - F.col("__m")) / F.nullif("__d", F.lit(0.0))
    return skew.attach(df, s, keys).withColumn(out, z).drop("__m", "__d")


def decision_cdf(df: DataFrame, unit: Sequence[str], value: str, lo: float, hi: float, width: float) -> DataFrame:
    """Cumulative percent per bin and unit, starting from the share below the range; mean and SEM over units per arm."""
    bins = int(round((hi - lo) / width))
    keys = [*unit, "OptoEnabled"]
    b = F.least(F.greatest(F.floor((F.col(value) - lo) / F.lit(width)), F.lit(-1)), F.lit(bins))
    h = df.filter(F.col(value).isNotNull()).withColumn("bin", b).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    tot = h.groupBy(*keys).agg(F.sum("n").alias("__t"))
    # Every unit gets every bin, so a bin without trials repeats the running share.
    grid = tot.withColumn("bin", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(bins - 1).cast("long"))))
    full = grid.join(h, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    run = skew.running_sum(full, keys, ["bin"], F.lit(0), {"__cum": "n"})  # bins + 1 rows per unit and arm
    per = run.filter("bin >= 0").withColumn("percent", 100.0 * F.col("__cum") / F.col("__t"))
    return per.groupBy("OptoEnabled", "bin").agg(
        F.avg("percent").alias("mean"), bh.sem("percent").alias("sem"), F.count(F.lit(1)).alias("n_units")
    )


def accuracy_by_time(df: DataFrame, unit: Sequence[str], lo: float, hi: float, width: float, sigma: float) -> DataFrame:
    """Accuracy per time bin, smoothed over bins where there are trials; mean and SEM over units per arm."""
    bins = int(round((hi - lo) / width))
    keys = [*unit, "OptoEnabled"]
    d = df.filter("ChoiceCorrect is not null").withColumn("bin", F.floor((F.col("calcStimulusTime") - lo) / F.lit(width)))
    d = d.filter(F.col("bin").between(0, bins - 1)).groupBy(*keys, "bin").agg(F.avg("ChoiceCorrect").alias("v"))
    grid = d.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = grid.join(d, [*keys, "bin"], "left")
    s = tr.gaussian(full, keys, "bin", sigma)
    return s.groupBy("OptoEnabled", "bin").agg(F.avg("smooth").alias("mean"), bh.sem("smooth").alias("sem"), F.count("smooth").alias("n_units"))


def time_accuracy_slope(df: DataFrame, unit: Sequence[str], block: int, x0: float, y0: float) -> DataFrame:
    """Slope through a fixed point of block means: trials sorted by time, full blocks of ``block`` trials only."""
    keys = [*unit, "OptoEnabled"]
    d = df.filter("ChoiceCorrect is not null")
    t = "calcStimulusTime"
    r = skew.number_rows(d, keys, [F.col(t), F.col("event_id")], skew.value_block(F.col(t)), "__r", "__n")
    r = r.withColumn("__b", F.floor((F.col("__r") - 1) / block)).filter(F.col("__b") < F.floor(F.col("__n") / block))
    m = r.groupBy(*keys, "__b").agg((F.avg(t) - x0).alias("x"), (100 * F.avg("ChoiceCorrect") - y0).alias("y"))
    return m.groupBy(*keys).agg(
        (F.sum(F.col("x") * F.col("y")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("slope"), F.count(F.lit(1)).alias("n_blocks")
    )


def density_mode_width(density: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid point of the density's peak and the nearest grid points on each side below half of it."""
    peak = density.groupBy(*keys).agg(
        F.max("density").alias("__top"), F.max_by("grid", F.struct(F.col("density"), (-F.col("grid")).alias("g"))).alias("mode")
    )
    d = skew.attach(density, peak, keys)
    low = F.col("density") < F.col("__top") / 2
    return d.groupBy(*keys, "mode").agg(
        F.max(F.when(low & (F.col("grid") < F.col("mode")), F.col("grid"))).alias("left_edge"),
        F.min(F.when(low & (F.col("grid") > F.col("mode")), F.col("grid"))).alias("right_edge"),
    )


def feedback_table(df: DataFrame, z_keys: Sequence[str], value: str) -> DataFrame:
    """After stimulated or control trials: session means, then subject means, of the z-scored time by previous outcome."""
    z = bh.z_by(df, z_keys, {"__z": value}, population=False)
    keys = ["PrevOptoEnabled", "Region", "PrevChoiceCorrect"]
    s = z.filter("PrevChoiceCorrect is not null and PrevOptoEnabled is not null").groupBy("Name", "SessId", *keys).agg(F.avg("__z").alias("m"))
    u = s.groupBy("Name", *keys).agg(F.avg("m").alias("m"))
    w = u.groupBy("Name", "PrevOptoEnabled", "Region").agg(
        F.avg(F.when(F.col("PrevChoiceCorrect") == 0, F.col("m"))).alias("incorrect"),
        F.avg(F.when(F.col("PrevChoiceCorrect") == 1, F.col("m"))).alias("correct"),
    )
    gap = F.col("incorrect") - F.col("correct")
    return w.groupBy("PrevOptoEnabled", "Region").agg(
        F.avg("incorrect").alias("incorrect"),
        F.avg("correct").alias("correct"),
        F.avg(gap).alias("difference"),
        bh.sem(gap).alias("difference_sem"),
        F.count(gap).alias("n_subjects"),
    )
