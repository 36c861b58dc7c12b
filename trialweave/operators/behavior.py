"""Trial filters, labels and two-level behaviour summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import skew

SESS = ["Name", "SessionNum"]
TRIAL = [*SESS, "TrialNumber"]

# Difficulty thresholds on the absolute evidence.
EASY_FROM, HARD_TO = 0.66, 0.33


def dv_label(dv: Column, null_is_med: bool = False) -> Column:
    """Easy / Med / Hard from the absolute evidence; NULL evidence stays NULL unless ``null_is_med``."""
    a = F.abs(dv)
    label = F.when(a >= EASY_FROM, "Easy").when(a <= HARD_TO, "Hard")
    return label.otherwise("Med") if null_is_med else label.when(a.isNotNull(), "Med")


def sem(c: Column | str) -> Column:
    """Standard error of the mean (sample deviation); NULL for a single value."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def rnd(c: Column | str, digits: int = 9) -> Column:
    """Rounding for compared results.

    A fixed small shift keeps exact decimal halves, common in means of round numbers, away from the rounding border, where
    two engines may differ in the last bit of a sum.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1.37 * 10.0 ** -(digits + 1)), digits)


def r6(c: Column | str) -> Column:
    return rnd(c, 6)


def diff(start: str, end: str, out: str):
    return lambda df: df.withColumn(out, F.col(start) - F.col(end))


def mean_sem_over(
    df: DataFrame, keys: Sequence[str], unit: Sequence[str], value: Column, min_rows: int = 0, prefix: str = ""
) -> DataFrame:
    """Mean within each unit (subject or session), then mean, SEM and unit count over units; rows counted too.

    Both levels combine map-side; only one row per (keys, unit) is shuffled the second time.
    """
    per = df.groupBy(*keys, *unit).agg(F.avg(value).alias("__m"), F.count(F.lit(1)).alias("__n"))
    if min_rows:
        per = per.filter(F.col("__n") >= min_rows)
    return per.groupBy(*keys).agg(
        F.avg("__m").alias(f"{prefix}mean"),
        sem("__m").alias(f"{prefix}sem"),
        F.count("__m").alias(f"{prefix}n_units"),
        F.sum("__n").alias(f"{prefix}n_rows"),
    )


def keep_groups(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Keep the rows of groups whose aggregate ``condition`` holds."""
    good = df.groupBy(*keys).agg(condition.alias("__ok")).filter("__ok").drop("__ok")
    return skew.attach(df, good, keys, how="left_semi")


def cohort(df: DataFrame, min_valid: int, max_time: float = 3.0, subjects: Sequence[str] | None = None) -> DataFrame:
    """Load rules: too-slow trials lose choice and time; subjects under the valid-trial minimum go."""
    late = F.col("calcStimulusTime") > max_time
    df = df.withColumns(
        {c: F.when(~late, F.col(c)) for c in ("ChoiceCorrect", "ChoiceLeft", "calcStimulusTime")}
    )
    if subjects is not None:
        df = df.filter(F.col("Name").isin(list(subjects)))
    return keep_groups(df, ["Name"], F.count_if(F.col("valid")) >= min_valid)


def complete_trials(df: DataFrame, trial: Sequence[str]) -> DataFrame:
    """Trials with a start epoch and a final outcome epoch."""
    has = [F.bool_or(F.col("epoch") == e) for e in ("Pre-Trial Start", "Reward", "Timeout Punishment")]
    return keep_groups(df, trial, has[0] & (has[1] | has[2]))


def complete_concatenated(df: DataFrame, names: str = "epochs_names") -> DataFrame:
    """The same rule on rows that hold the list of their epochs."""
    has = [F.array_contains(names, e) for e in ("Pre-Trial Start", "Reward", "Timeout Punishment")]
    return df.filter(has[0] & (has[1] | has[2]))


def modal_length_trials(df: DataFrame, session: Sequence[str], trial: Sequence[str], correct: str) -> DataFrame:
    """Trials whose summed epoch span equals the median of their session and correctness."""
    per = df.groupBy(*trial, correct).agg(F.sum(F.col("trace_end_idx") - F.col("trace_start_idx")).alias("span"))
    med = skew.exact_percentiles(per, [*session, correct], "span", {"med": 0.5})
    good = skew.attach(per, med, [*session, correct]).filter(F.col("span") == F.col("med"))
    return df.join(good.select(*trial), list(trial), "left_semi")


def between_quantiles(df: DataFrame, keys: Sequence[str], value: str, bottom: float, top: float) -> DataFrame:
    """Rows whose ``value`` lies between two quantiles of its group (ends included)."""
    q = skew.exact_percentiles(df, keys, value, {"__lo": bottom, "__hi": top})
    out = skew.attach(df, q, keys, how="inner")
    return out.filter(F.col(value).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def session_quality(df: DataFrame, exp_min_choices: int = 50, min_easy: float = 0.7) -> DataFrame:
    """Sessions with enough choices and enough accuracy at the easiest difficulty."""
    easy = F.col("DVstr") == "Easy"
    return keep_groups(
        df,
        SESS,
        (F.count("ChoiceCorrect") >= exp_min_choices)
        & (F.coalesce(F.avg(F.when(easy, F.col("ChoiceCorrect"))), F.lit(0.0)) >= min_easy),
    )


def first_of_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; an aggregate, so duplicates of one key never sit in one task together."""
    rest = [c for c in df.columns if c not in keys]
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__f"))
    return firsts.select(*keys, *[F.col(f"__f.{c}").alias(c) for c in rest])


def pad_sessions(df: DataFrame) -> DataFrame:
    """Repeat each session's last trial, marked invalid, up to the subject's longest session."""
    last = df.groupBy(*SESS).agg(
        F.max("TrialNumber").alias("__last"),
        F.max_by(F.struct(*[c for c in df.columns if c not in SESS]), "TrialNumber").alias("__row"),
    )
    longest = last.groupBy("Name").agg(F.max("__last").alias("__longest"))
    short = last.join(longest, "Name").filter(F.col("__last") < F.col("__longest"))
    extra = short.withColumn("__t", F.explode(F.sequence(F.col("__last") + 1, F.col("__longest"))))
    rest = [c for c in df.columns if c not in SESS]
    val = {"TrialNumber": F.col("__t"), "valid": F.lit(False)}
    extra = extra.select(*SESS, *[val.get(c, F.col(f"__row.{c}")).alias(c) for c in rest])
    return df.unionByName(extra)


class Condition:
    """``column operator value`` with a display name; several are AND-ed by :func:`where_all`."""

    OPS = {
        "==": lambda c, v: c == v,
        "!=": lambda c, v: c != v,
        ">": lambda c, v: c > v,
        ">=": lambda c, v: c >= v,
        "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v,
        "in": lambda c, v: c.isin(list(v)),
    }

    def __init__(self, col: str, value, operator: str = "==", name: str | None = None):
        self.col, self.value, self.operator = col, value, operator
        self.name = name or f"{col} {operator} {value}"

    def column(self) -> Column:
        return self.OPS[self.operator](F.col(self.col), self.value)


def where_all(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    for c in conditions:
        df = df.filter(c.column())
    return df


def apply_where(df: DataFrame, where: Column, fn, whole_groups: Sequence[str] | None = None) -> DataFrame:
    """Transform the rows that match and pass the others through.

    With ``whole_groups`` a group is transformed only when all of its rows match.
    """
    hit = F.coalesce(where, F.lit(False))
    df = df.withColumn("__hit", hit)
    if whole_groups:
        flags = df.groupBy(*whole_groups).agg(F.bool_and("__hit").alias("__all"))
        df = skew.attach(df.drop("__hit"), flags, whole_groups).withColumnRenamed("__all", "__hit")
    done = fn(df.filter("__hit").drop("__hit"))
    return done.unionByName(df.filter(~F.col("__hit")).drop("__hit"), allowMissingColumns=True)


def evidence_edges(periods: int, combine_sides: bool, separate_zero: bool) -> list[float]:
    """Equal steps of evidence plus .01, mirrored for two sides."""
    up = [i / periods + 0.01 for i in range(periods + 1)]
    if combine_sides:
        return [0.0, *(up if separate_zero else up[1:])]
    down = [-x for x in reversed(up)]
    if separate_zero:
        return down + up
    return down[:-1] + [0.0] + up[1:]


def bucket(v: Column, edges: Sequence[float], lowest: bool = True) -> Column:
    """1-based bin of right-closed intervals; the lowest edge belongs to the first bin when ``lowest``."""
    first = v >= edges[0] if lowest else v > edges[0]
    idx = F.lit(None).cast("long")
    for i in range(len(edges) - 1, 0, -1):
        idx = F.when(v <= edges[i], F.lit(i).cast("long")).otherwise(idx)
    return F.when(first, idx)


def left_bucket(v: Column, width: float, start: float = 0.0) -> Column:
    """0-based bin of left-closed equal-width intervals."""
    return F.floor((v - F.lit(start)) / F.lit(width)).cast("long")


def psychometric_points(df: DataFrame, keys: Sequence[str], edges: Sequence[float], outcome: str) -> DataFrame:
    """Per evidence bin: mean evidence, trials, mean outcome and its standard error."""
    b = df.filter(F.col(outcome).isNotNull()).withColumn("bin", bucket(F.col("DV"), edges)).filter("bin IS NOT NULL")
    return b.groupBy(*keys, "bin").agg(
        rnd(F.avg("DV")).alias("dv"),
        F.count(F.lit(1)).alias("n"),
        rnd(F.avg(outcome)).alias("outcome"),
        rnd(sem(outcome)).alias("outcome_sem"),
    )


def subject_psychometric(df: DataFrame, edges: Sequence[float], outcome: str, unit: Sequence[str]) -> DataFrame:
    b = df.filter(F.col(outcome).isNotNull()).withColumn("bin", bucket(F.col("DV"), edges)).filter("bin IS NOT NULL")
    per = b.groupBy("bin", *unit).agg(F.avg("DV").alias("d"), F.avg(outcome).alias("m"), F.count(F.lit(1)).alias("c"))
    return per.groupBy("bin").agg(
        rnd(F.avg("d")).alias("dv"),
        rnd(F.avg("m")).alias("outcome"),
        rnd(sem("m")).alias("outcome_sem"),
        F.count("m").alias("n_units"),
        F.sum("c").alias("n"),
    )


def reward_rate_curve(df: DataFrame, past: int, rate: str, time: str, min_trials: int, keys: Sequence[str]) -> DataFrame:
    """Time against the previous-n reward rate, sessions first, per timeout and for all timeouts (NULL timeout)."""
    d = df.filter(F.col("valid") & F.col(rate).isNotNull())
    d = d.withColumn("bin", left_bucket(F.col(rate) + 1e-5, 1.0 / past))
    to = "GUI_TimeOutIncorrectChoice"
    sess = (
        d.groupingSets([[*keys, to, "bin", "SessId"], [*keys, "bin", "SessId"]], *keys, to, "bin", "SessId")
        .agg(F.avg(time).alias("m"), F.count(F.lit(1)).alias("c"))
        .filter(F.col("c") > min_trials)
    )
    return sess.groupBy(*keys, to, "bin").agg(
        rnd(F.avg("m")).alias("rt_mean"),
        rnd(sem("m")).alias("rt_sem"),
        F.count("m").alias("n_sessions"),
        F.sum("c").alias("n_trials"),
    )


def z_by(df: DataFrame, keys: Sequence[str], values: dict[str, str], population: bool = True) -> DataFrame:
    """Z-scores of {output: input} within ``keys``; population deviation, or sample deviation on request."""
    dev = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for o, i in values.items():
        aggs += [F.avg(i).alias(f"__m_{o}"), dev(i).alias(f"__d_{o}")]
    b = skew.attach(df, df.groupBy(*keys).agg(*aggs), keys)
    b = b.withColumns(
        {o: (F.col(i) - F.col(f"__m_{o}")) / F.nullif(F.col(f"__d_{o}"), F.lit(0.0)) for o, i in values.items()}
    )
    return b.drop(*[f"__{p}_{o}" for o in values for p in "md"])


def session_bias(df: DataFrame, keys: Sequence[str], choice: str = "ChoiceLeft") -> DataFrame:
    """100·(share of left choices − share of left-evidence trials)."""
    left_evidence = F.coalesce((F.col("DV") > 0).cast("int"), F.lit(0))
    return df.groupBy(*keys).agg((100 * (F.avg(choice) - F.avg(left_evidence))).alias("bias"))


def stay_updates(df: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Win-stay and lose-switch updates in percent: stay minus the stay baseline over all trials of the kind."""
    p = F.col(f"{prefix}PrevOutcomeCount")
    out = []
    for n, cond in (("win", p >= 1), ("lose", p <= -1)):
        gain = F.sum(F.when(cond, F.coalesce(F.col(f"{prefix}Stay"), F.lit(0)))) - F.sum(
            F.when(cond, F.coalesce(F.col(f"{prefix}StayBaseline"), F.lit(0)))
        )
        cnt = F.count_if(cond)
        out += [rnd(F.when(cnt > 0, 100 * gain / cnt).otherwise(0.0)).alias(f"{n}_update"), cnt.alias(f"n_{n}")]
    return df.groupBy(*keys).agg(*out)


def histogram(df: DataFrame, keys: Sequence[str], value: str, width: float, start: float = 0.0) -> DataFrame:
    """(keys, bin, n) for equal-width left-closed bins; empty bins are absent."""
    b = df.filter(F.col(value).isNotNull()).withColumn("bin", left_bucket(F.col(value), width, start))
    return b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_mode(hist: DataFrame, keys: Sequence[str], out: str = "mode_bin") -> DataFrame:
    """The fullest bin of each group, the first on ties."""
    return hist.groupBy(*keys).agg(
        F.max_by("bin", F.struct(F.col("n"), (-F.col("bin")).alias("b"))).alias(out), F.max("n").alias("n")
    )


def cumulative(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running count and fraction over the bins of a histogram."""
    c = skew.running_sum(hist, keys, ["bin"], F.floor(F.col("bin") / 1024), {"cum": "n"})
    tot = hist.groupBy(*keys).agg(F.sum("n").alias("__t"))
    return skew.attach(c, tot, keys).withColumn("fraction", F.col("cum") / F.col("__t")).drop("__t")


def density_on_grid(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, step: float, bw: float):
    """Gaussian kernel density at fixed grid points, bandwidth = bw · sample deviation.

    Values are first counted, so each distinct value meets the fixed grid once and the sum combines map-side.
    """
    counts = skew.value_counts(df, keys, value)
    spread = df.groupBy(*keys).agg(F.count(value).alias("__n"), (bw * F.stddev_samp(value)).alias("__h"))
    points = int(round((hi - lo) / step)) + 1
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    g = skew.attach(counts, spread.filter("__h > 0"), keys, how="inner").withColumn("grid", grid)
    at = F.lit(lo) + F.col("grid") * F.lit(step)
    u = (at - F.col("v")) / F.col("__h")
    return g.groupBy(*keys, "grid").agg(
        (F.sum(F.col("c") * F.exp(-u * u / 2)) / (F.max("__n") * F.max("__h") * F.sqrt(2 * F.pi()))).alias("density")
    )


def duplicate_audit(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys held by several rows and the columns in which those rows differ (a NULL beside a value differs too)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        differs = (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))
        aggs.append(F.coalesce(differs, F.lit(False)).alias(f"__d_{c}"))
    found = df.groupBy(*keys).agg(*aggs).filter("n > 1")
    names = F.array_compact(F.array(*[F.when(F.col(f"__d_{c}"), F.lit(c)) for c in columns]))
    return found.select(*keys, "n", F.explode(names).alias("col"))


def epoch_audit(df: DataFrame, keys: Sequence[str], group: str, first: int, length: int) -> DataFrame:
    """Per group: keys, repeated keys and keys whose frame range leaves ``[first, length)``."""
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("trace_start_idx").alias("a"), F.max("trace_end_idx").alias("z")
    )
    outside = (F.col("a") < first) | (F.col("a") > F.col("z")) | (F.col("z") >= length)
    return per.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.count_if(outside).alias("n_outside"),
    )


def rename_feedback(df: DataFrame, session: Sequence[str], waits: Column) -> DataFrame:
    """Name the first feedback epoch ``Feedback Start``: the wait where a session has one, else reward or punishment."""
    flag = df.groupBy(*session).agg(F.bool_or(waits).alias("HasFeedbackWait"))
    out = skew.attach(df, flag, session)
    has = F.col("HasFeedbackWait")
    starts = (has & (F.col("epoch") == "Feedback Wait")) | (~has & F.col("epoch").isin("Reward", "Punishment"))
    return out.withColumn("epoch", F.when(starts, "Feedback Start").otherwise(F.col("epoch")))


def merge_feedback(df: DataFrame, trial: Sequence[str], fps: float) -> DataFrame:
    """Stretch ``Feedback Start`` to the end of the trial's reward or punishment and drop the latter."""
    late = F.col("epoch").isin("Reward", "Punishment")
    per = df.groupBy(*trial).agg(
        F.bool_or(F.col("epoch") == "Feedback Start").alias("__fs"),
        F.max(F.when(late, F.col("trace_end_idx"))).alias("__z"),
    )
    out = skew.attach(df, per, trial, salts=1)
    merges = F.col("HasFeedbackWait") & F.col("__fs") & F.col("__z").isNotNull()
    start = merges & (F.col("epoch") == "Feedback Start")
    out = out.filter(~(merges & late))
    return out.withColumns(
        {
            "epoch_time": F.when(start, (F.col("__z") - F.col("trace_start_idx") + 1) / F.lit(fps)).otherwise(
                F.col("epoch_time")
            ),
            "trace_end_idx": F.when(start, F.col("__z")).otherwise(F.col("trace_end_idx")),
        }
    ).drop("__fs", "__z")


def typical_band(df: DataFrame, session: Sequence[str], time: str, tolerance: float) -> DataFrame:
    """Trials near their session's 45–55 % times and near the overall median of those."""
    q = skew.exact_percentiles(df, session, time, {"__lo": 0.45, "__hi": 0.55})
    mid = skew.attach(df, q, session, how="inner")
    mid = mid.filter(F.col(time).between(F.col("__lo") - tolerance, F.col("__hi") + tolerance)).drop("__lo", "__hi")
    med = skew.exact_percentiles(mid, [], time, {"__m": 0.5})
    out = skew.attach(mid, med, [], how="inner")
    return out.filter(F.col(time).between(F.col("__m") - tolerance, F.col("__m") + tolerance)).drop("__m")


def split_by(df: DataFrame, keys: Sequence[str]):
    """Grouping that drops rows with a NULL key."""
    return df.dropna(subset=list(keys)).groupBy(*keys)


def regroup(branches: dict[str, DataFrame], tag: str) -> DataFrame:
    """Put branch results together under a tag column."""
    parts = [d.withColumn(tag, F.lit(n)) for n, d in branches.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


class SplitLevel:
    """Flags that name the grouping columns of an average; session and subject exclude each other."""

    SESSION, ANIMAL, REGION, LAYER, SAMPLING, STIMULUS, QUANTILE, DIRECTION, DURATION = (1 << i for i in range(9))


_SPLIT_COLUMNS = {
    SplitLevel.SESSION: ["Name", "SessionNum"],
    SplitLevel.ANIMAL: ["Name"],
    SplitLevel.REGION: ["Region"],
    SplitLevel.LAYER: ["Layer"],
    SplitLevel.SAMPLING: ["SamplingType"],
    SplitLevel.STIMULUS: ["Stimulus"],
    SplitLevel.QUANTILE: ["quantile_idx"],
    SplitLevel.DIRECTION: ["ChoiceLeft"],
    SplitLevel.DURATION: ["DurationBin"],
}


def split_columns(level: int) -> list[str]:
    if level & SplitLevel.SESSION and level & SplitLevel.ANIMAL:
        raise ValueError("split by session or by subject, not both")
    return [c for flag, cols in _SPLIT_COLUMNS.items() if level & flag for c in cols]


def condition_label(df: DataFrame, outcome=False, direction=False, evidence=False, speed=False) -> DataFrame:
    """A readable group label from the chosen condition columns."""
    parts = []
    if outcome:
        parts.append(F.when(F.col("ChoiceCorrect") == 1, "Correct").otherwise("Incorrect"))
    if direction:
        parts.append(F.when(F.col("ChoiceLeft") == 1, "Left").otherwise("Right"))
    if evidence:
        parts.append(F.col("DVstr"))
    if speed:
        parts.append(F.element_at(F.array(*map(F.lit, ("Fast", "Typical", "Slow"))), F.col("quantile_idx").cast("int")))
    return df.withColumn("label", F.concat_ws(" / ", *parts))


def combinations(df: DataFrame, columns: Sequence[str], combos: dict[str, Sequence[str]], aggs) -> DataFrame:
    """All named groupings in one pass with grouping sets, tagged by ``combination``."""
    level = {n: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols) for n, cols in combos.items()}
    g = df.groupingSets([list(c) for c in combos.values()], *columns).agg(F.grouping_id().alias("__g"), *aggs)
    tag = F.lit(None).cast("string")
    for n, code in level.items():
        tag = F.when(F.col("__g") == code, n).otherwise(tag)
    return g.withColumn("combination", tag).drop("__g")


def filtered_combinations(df: DataFrame, columns: Sequence[str], combos: dict[str, tuple[Sequence[str], Column]], aggs) -> DataFrame:
    """Named groupings that each have a filter, in one pass: a row is added up under every combination whose filter it passes."""
    kinds = {f.name: f.dataType for f in df.schema}
    key = lambda n, cols: F.struct(F.lit(n).alias("combination"), *[(F.col(c) if c in cols else F.lit(None).cast(kinds[c])).alias(c) for c in columns])
    tags = F.array_compact(F.array(*[F.when(cond, key(n, cols)) for n, (cols, cond) in combos.items()]))
    rest = [c for c in df.columns if c not in columns]
    return df.withColumn("__t", F.explode(tags)).select(*rest, "__t.*").groupBy("combination", *columns).agg(*aggs)


def evidence_quantile_bin(df: DataFrame, parts: int) -> DataFrame:
    """Bins of absolute evidence with equal counts; equal edges fall together."""
    d = df.withColumn("__a", F.abs("DV"))
    edges = skew.exact_percentiles(d, [], "__a", {f"__e{i}": i / parts for i in range(1, parts)})
    out = skew.attach(d, edges, [])
    idx = F.lit(parts).cast("long")
    for i in range(parts - 1, 0, -1):
        idx = F.when(F.col("__a") <= F.col(f"__e{i}"), F.lit(i).cast("long")).otherwise(idx)
    return out.withColumn("bin", idx).drop("__a", *[f"__e{i}" for i in range(1, parts)])


def assigned_difficulty(df: DataFrame, rdk: Column, combine_sides: bool) -> DataFrame:
    """Easy, Medium or Hard by matching the evidence percent with the session's difficulty settings."""
    p = F.round(F.col("DV") * 100)
    p = F.when(rdk, p).otherwise(p / 2)
    p = F.abs(p) if combine_sides else p
    hard = (p == F.col("Difficulty3")) | (p == F.col("Difficulty4"))
    label = F.when(p == F.col("Difficulty1"), "Easy").when(p == F.col("Difficulty2"), "Medium").when(hard, "Hard")
    return df.withColumn("difficulty", label)


def reward_rate_group_curve(curve: DataFrame, min_trials: int, exclude_bins: Sequence[int], timeout: float | None = None):
    to = F.col("GUI_TimeOutIncorrectChoice")
    c = curve.filter(to.isNull() if timeout is None else to == timeout)
    c = c.filter((F.col("n_trials") >= min_trials) & ~F.col("bin").isin(list(exclude_bins)))
    return c.groupBy("bin").agg(
        rnd(F.avg("rt_mean")).alias("rt_mean"), rnd(sem("rt_mean")).alias("rt_sem"), F.count(F.lit(1)).alias("n_subjects")
    )


def by_speed(df: DataFrame, unit: Sequence[str], value: str) -> DataFrame:
    """One row per unit with the mean of ``value`` in each speed class."""
    cells = {n: F.avg(F.when(F.col("quantile_idx") == q, F.col(value))) for q, n in enumerate(("fast", "typical", "slow"), 1)}
    return df.groupBy(*unit).agg(*[c.alias(n) for n, c in cells.items()])


def paired_t(a: Column, b: Column) -> Column:
    """Paired t statistic as an aggregate over rows."""
    return F.avg(a - b) / F.nullif(F.stddev_samp(a - b) / F.sqrt(F.count(a - b)), F.lit(0.0))


def stay_matrix(df: DataFrame) -> DataFrame:
    """Previous outcome × current difficulty (and their total): subjects first, then means over subjects."""
    d = df.filter(F.col("PrevChoiceCorrect").isNotNull())
    s = d.groupingSets(
        [["Name", "PrevChoiceCorrect", "DVstr"], ["Name", "PrevChoiceCorrect"]], "Name", "PrevChoiceCorrect", "DVstr"
    ).agg(
        (100 * F.avg("Stay")).alias("st"),
        (100 * F.avg("StayBaseline")).alias("sb"),
        (100 * F.avg("ChoiceCorrect")).alias("pf"),
        F.count(F.lit(1)).alias("n"),
    )
    totals = df.groupBy("Name").agg(F.count(F.lit(1)).alias("total"))
    u = F.col("st") - F.col("sb")
    return (
        s.join(totals, "Name")
        .withColumn("difficulty", F.coalesce("DVstr", F.lit("Total")))
        .groupBy("PrevChoiceCorrect", "difficulty")
        .agg(
            rnd(F.avg(u)).alias("stay_update"),
            rnd(sem(u)).alias("stay_update_sem"),
            rnd(F.avg("st")).alias("stay"),
            rnd(F.avg("sb")).alias("stay_ref"),
            rnd(F.avg("pf")).alias("performance"),
            rnd(F.avg(100 * F.col("n") / F.col("total"))).alias("trials_percent"),
            F.sum("n").alias("n_trials"),
        )
    )


def prior_current_cells(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Eight cells of previous outcome, current and previous difficulty: subject means of time and shifted log time."""
    lowest = df.agg(F.min("calcStimulusTime").alias("__min"))
    shift = F.when(F.col("__min") <= 0, F.lit(eps) - F.col("__min")).otherwise(0.0)
    keys = ["PrevChoiceCorrect", "DVstr", "PrevDVstr"]
    d = df.filter("PrevChoiceCorrect is not null and DVstr in ('Easy', 'Hard') and PrevDVstr in ('Easy', 'Hard')")
    d = skew.attach(d, lowest, [])
    s = d.groupBy(*keys, "Name").agg(
        F.avg("calcStimulusTime").alias("t"), F.avg(F.ln(F.col("calcStimulusTime") + shift)).alias("l"), F.count(F.lit(1)).alias("n")
    )
    return s.groupBy(*keys).agg(
        rnd(F.avg("t")).alias("time"),
        rnd(F.avg("l")).alias("log_time"),
        rnd(F.avg("n")).alias("trials"),
        rnd(sem("n")).alias("trials_sem"),
        F.count(F.lit(1)).alias("n_subjects"),
    )


def chronometry_cells(df: DataFrame, points: Sequence[float], edges: Sequence[float], tolerance: float = 0.001):
    """Trials at the minimum-sampling points (± tolerance) with their evidence bin."""
    at = F.lit(None).cast("double")
    for p in points:
        at = F.when(F.col("MinSample").between(p - tolerance, p + tolerance), F.lit(p)).otherwise(at)
    d = df.filter(F.col("ChoiceCorrect").isNotNull()).withColumn("MinSample", at)
    return d.withColumn("bin", bucket(F.abs("DV"), edges)).filter("bin is not null and MinSample is not null")


def fast_slow_pairs(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Accuracy of fast and slow trials side by side per evidence bin and subject."""
    d = df.filter(F.col("ChoiceCorrect").isNotNull()).withColumn("bin", bucket(F.col("DV"), edges)).filter("bin is not null")
    cell = {n: F.avg(F.when(F.col("quantile_idx") == q, F.col("ChoiceCorrect"))) for n, q in (("fast", 1), ("slow", 3))}
    return d.groupBy("bin", "Name").agg(*[c.alias(n) for n, c in cell.items()])


def outcome_copies(df: DataFrame) -> DataFrame:
    """Each trial twice, once without punishment epochs (correct) and once without reward epochs (incorrect)."""
    twice = df.withColumn("ChoiceCorrect", F.explode(F.array(F.lit(1), F.lit(0))))
    keep = F.when(F.col("ChoiceCorrect") == 1, ~F.col("epoch").contains("Punish")).otherwise(~F.col("epoch").contains("Reward"))
    word = F.when(F.col("ChoiceCorrect") == 1, " Reward").otherwise(" Punish")
    return twice.filter(keep).withColumn("trial", F.concat(F.col("TrialNumber").cast("string"), word))


def distinct_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Subjects, sessions and trials per key; sessions are collapsed first so each shuffle stays small."""
    sess = df.groupBy(*keys, "Name", "SessId").agg(F.count(F.lit(1)).alias("n"))
    subj = sess.groupBy(*keys, "Name").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("n"))
    return subj.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_subjects"), F.sum("s").alias("n_sessions"), F.sum("n").alias("n_trials")
    )
