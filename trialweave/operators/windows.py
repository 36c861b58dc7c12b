"""Trial-order operators: numbering, streaks, previous-trial columns, rolling rates, speed classes, learned values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.operators.behavior import dv_label


def outcome_streaks(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "TrialNumber",
    no_choice_as_incorrect: bool = True,
    extra: dict[str, Column] | None = None,
    size: int = skew.BLOCK,
    lags: int = 4,
) -> DataFrame:
    """Signed run length before each trial of outcome, chosen side and rewarded side, plus lagged trial columns.

    A run ends where the sign changes or the trial number skips.  A missing choice counts as an error for the outcome run
    (optional) and stops the side runs.  ``extra`` maps an output name to a column taken from the trial before.
    """
    missing = -1 if no_choice_as_incorrect else 0
    sign = {
        "PrevOutcomeCount": F.when(F.col("ChoiceCorrect") == 1, 1)
        .when(F.col("ChoiceCorrect") == 0, -1)
        .otherwise(missing),
        "PrevDirectionIsLeftCount": F.when(F.col("ChoiceLeft").isNull(), 0)
        .when(F.col("ChoiceLeft") == 1, 1)
        .otherwise(-1),
        "PrevLeftRewardedCount": F.when(F.col("LeftRewarded"), 1).otherwise(-1),
    }
    b = skew.with_halo(df, keys, pos, before=lags, size=size)
    w = skew.block_window(keys, pos)
    own = ~F.col("__ghost")
    contiguous = F.coalesce(F.lag(pos).over(w) == F.col(pos) - 1, F.lit(False))
    b = b.withColumns({f"__s_{n}": s for n, s in sign.items()})
    b = b.withColumns(
        {
            f"__f_{n}": F.when(own & ~(contiguous & (F.lag(f"__s_{n}").over(w) == F.col(f"__s_{n}"))), F.col(pos))
            for n in sign
        }
    )
    b = skew.carry_in(b, keys, {f"__c_{n}": (F.max, F.max(f"__f_{n}")) for n in sign})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns(
        {
            f"__r_{n}": F.col(f"__s_{n}")
            * (F.col(pos) - F.coalesce(F.max(f"__f_{n}").over(upto), F.col(f"__c_{n}")) + 1)
            for n in sign
        }
    )
    out = {n: F.when(contiguous, F.lag(f"__r_{n}").over(w)).otherwise(0).cast("long") for n in sign}
    out["PrevDV"] = F.when(contiguous, F.lag("DV").over(w))
    for i in range(1, lags + 1):
        near = F.lag(pos, i).over(w) == F.col(pos) - i
        out[f"PrevCalcStimulusTime{i}"] = F.when(near, F.lag("calcStimulusTime", i).over(w))
    for n, c in (extra or {}).items():
        out[n] = F.when(contiguous, F.lag(c).over(w))
    return skew.drop_ghosts(b.withColumns(out)).drop(*[f"__{p}_{n}" for n in sign for p in "sfcr"])


def stay_columns(df: DataFrame) -> DataFrame:
    """Previous choice, stay and stay-baseline flags from the streak columns."""
    known = F.col("PrevOutcomeCount") != 0
    prev_left = F.when(known, (F.col("PrevDirectionIsLeftCount") >= 1).cast("int"))
    return df.withColumns(
        {
            "PrevDVstr": F.when(F.col("PrevDV").isNotNull(), dv_label(F.col("PrevDV"))),
            "PrevChoiceCorrect": F.when(known, (F.col("PrevOutcomeCount") >= 1).cast("int")),
            "PrevChoiceLeft": prev_left,
            "Stay": F.when(
                known & F.col("ChoiceLeft").isNotNull(), (F.col("ChoiceLeft") == prev_left).cast("int")
            ),
            "StayBaseline": F.when(known, (F.col("LeftRewarded").cast("int") == prev_left).cast("int")),
        }
    )


def previous_trial(df: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    return stay_columns(outcome_streaks(df, keys, **kw))


def reward_rate(
    df: DataFrame, keys: Sequence[str], pos: str, rates: dict[str, tuple[str, int]], size: int = skew.BLOCK
) -> DataFrame:
    """Mean of the previous n outcomes; a missing outcome is 0 and the rate is NULL until n trials exist.

    ``pos`` must be dense (1, 2, …); number gapped trials first.
    """
    b = skew.with_halo(df, keys, pos, before=max(n for _, n in rates.values()), size=size)
    w = skew.block_window(keys, pos)
    out = {}
    for name, (col, n) in rates.items():
        past = w.rowsBetween(-n, -1)
        enough = F.count(F.lit(1)).over(past) == n
        out[name] = F.when(enough, F.avg(F.coalesce(F.col(col), F.lit(0))).over(past))
    return skew.drop_ghosts(b.withColumns(out))


def speed_class(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str,
    parts: int = 3,
    cut_above: float | None = None,
    bounds: bool = False,
    cursor: bool = False,
    session_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Equal-count classes of ``time`` within ``keys``: ``quantile_idx`` 1..parts, NULL for groups smaller than ``parts``.

    Times over ``cut_above`` keep no class and are labelled ``above_{x}s`` in ``quantile_label``.  With ``cursor`` spare
    rows continue round-robin over the ordered groups instead of restarting in each.
    """
    keys = list(keys)
    if cut_above is not None:
        df = df.withColumn("__over", F.col(time) > cut_above)
        keys = [*keys, "__over"]
    ranked = skew.number_rows(
        df, keys, [F.col(time), F.col(tie)], skew.value_block(F.col(time)), "__rn", "__n"
    )
    start: Column | int = 0
    if cursor:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        lead = list(session_keys or [])
        # One small row per group: spare rows so far, first within a session, then over the ordered sessions.
        spare = F.when(F.col("__n") >= parts, F.col("__n") % parts).otherwise(0)
        sizes = sizes.withColumn("__spare", spare)
        inner = Window.partitionBy(*lead).orderBy(*[k for k in keys if k not in lead])
        sizes = sizes.withColumn("__cur", F.sum("__spare").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
        totals = sizes.groupBy(*lead).agg(F.sum("__spare").alias("__st"))
        before = ordered_prefix_sum(totals, lead, "__st", "__sb")
        sizes = skew.key_join(sizes, before.select(*lead, "__sb"), lead)
        cur = (F.coalesce("__cur", F.lit(0)) + F.col("__sb")) % parts
        sizes = sizes.select(*keys, cur.alias("__start"))
        ranked = skew.attach(ranked, sizes, keys)
        start = F.col("__start")
    idx = skew.equal_parts(F.col("__rn"), F.col("__n"), parts, start)
    if cut_above is not None:
        idx = F.when(~F.col("__over"), idx)
    out = ranked.withColumn("quantile_idx", idx)
    if cut_above is not None:
        label = F.when(F.col("__over"), F.lit(f"above_{cut_above}s")).otherwise(F.col("quantile_idx").cast("string"))
        out = out.withColumn("quantile_label", label)
    if bounds:
        # Classes are half open on the left; the first one starts just below its smallest time.
        edges = out.groupBy(*keys, "quantile_idx").agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
        w = Window.partitionBy(*keys).orderBy("quantile_idx")  # at most parts + 1 rows per group
        edges = edges.select(
            *keys,
            "quantile_idx",
            F.coalesce(F.lag("__hi").over(w), F.col("__lo")).alias("bin_left"),
            F.col("__hi").alias("bin_right"),
        )
        out = skew.attach(out, edges, [*keys, "quantile_idx"], null_safe=True)
    return out.drop("__rn", "__n", "__start", "__over")


def ordered_prefix_sum(df: DataFrame, keys: Sequence[str], value: str, out: str, ranges: int = 256) -> DataFrame:
    """Sum of ``value`` over all rows with smaller ``keys`` (a global order; keys do not repeat), nulls first.

    Rows are cut into ``ranges`` ranges of the whole keys at borders drawn by a hash, whatever the keys look like. Rows are ordered within
    their range only; one sum per range goes to the driver and comes back as an offset.
    """
    drawn = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(8 * ranges).orderBy(*keys).collect()
    kind = {f.name: f.dataType for f in df.schema}
    key = lambda values: F.struct(*[v.cast(kind[k]).alias(k) for k, v in zip(keys, values, strict=True)])
    borders = [key([F.lit(v) for v in row]) for row in drawn[8::8]]
    own = key([F.col(k) for k in keys])
    block = F.size(F.filter(F.array(*borders), lambda b: b <= own)) if borders else F.lit(0)
    b = df.withColumn("__blk", block)
    sums = {r["__blk"]: r["s"] for r in b.groupBy("__blk").agg(F.sum(value).alias("s")).collect()}
    offsets = [0]
    for k in range(len(borders)):
        offsets.append(offsets[-1] + (sums.get(k) or 0))
    inner = Window.partitionBy("__blk").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.get(F.array(*[F.lit(o) for o in offsets]), F.col("__blk"))
    return b.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)) + offset).drop("__blk")


def time_groups(df: DataFrame, keys: Sequence[str], time: str, parts: int) -> DataFrame:
    """Early/(Mid)/Late by quantile edges of ``time`` per ``keys``; ``group_median`` is the class median."""
    probs = {f"__e{i}": i / parts for i in range(1, parts)}
    edges = skew.exact_percentiles(df, keys, time, probs)
    b = skew.attach(df, edges, keys)
    names = ["Early", "Late"] if parts == 2 else ["Early", "Mid", "Late"]
    label = F.lit(names[-1])
    for i in range(parts - 1, 0, -1):
        label = F.when(F.col(time) <= F.col(f"__e{i}"), names[i - 1]).otherwise(label)
    b = b.withColumn("time_group", F.when(F.col(time).isNotNull(), label)).drop(*probs)
    med = skew.exact_percentiles(b, [*keys, "time_group"], time, {"group_median": 0.5})
    return skew.attach(b, med, [*keys, "time_group"])


def affine_starts(maps: DataFrame, keys: Sequence[str], start: float, fan: int = 1024, levels: int = 2) -> DataFrame:
    """``__c``, the value before each block, when the maps ``x → __fa·x + __fb`` are applied to ``start`` in the order of ``__blk``.

    ``fan`` neighbouring maps are composed into one, ``levels`` times over; the few maps left of a key are followed from the
    start, and the values are handed down again. No task sees more than ``fan`` maps of a lower level.
    """
    group = lambda d: d.groupBy(*keys, "__g").agg(F.sort_array(F.collect_list(F.struct("__blk", "__fa", "__fb"))).alias("__l"))
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    whole = F.aggregate("__l", one, lambda m, f: F.struct((m["a"] * f["__fa"]).alias("a"), (m["b"] * f["__fa"] + f["__fb"]).alias("b")))

    def followed(first: Column) -> Column:
        """The maps of a list with the value before each of them."""
        steps = F.aggregate("__l", F.array(first), lambda xs, f: F.array_append(xs, F.element_at(xs, -1) * f["__fa"] + f["__fb"]))
        return F.explode(F.zip_with("__l", F.slice(steps, F.lit(1), F.size("__l")), lambda f, x: F.struct(f["__blk"].alias("b"), x.alias("x"))))

    lists, level = [], maps
    for _ in range(levels):
        lists.append(group(level.withColumn("__g", F.floor(F.col("__blk") / fan).cast("long"))))
        level = lists[-1].select(*keys, F.col("__g").alias("__blk"), whole.alias("__m")).select(*keys, "__blk", F.col("__m.a").alias("__fa"), F.col("__m.b").alias("__fb"))
    top = group(level.withColumn("__g", F.lit(0)))
    known = top.select(*keys, followed(F.lit(float(start))).alias("s")).select(*keys, F.col("s.b").alias("__blk"), F.col("s.x").alias("__c"))
    for own in reversed(lists):
        j = skew.key_join(own, known.withColumnRenamed("__blk", "__g"), [*keys, "__g"])
        known = j.select(*keys, followed(F.col("__c")).alias("s")).select(*keys, F.col("s.b").alias("__blk"), F.col("s.x").alias("__c"))
    return known


def replay_average(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    outcome: Column,
    applies: Column,
    rate: float,
    start: float,
    name: str,
    size: int = skew.BLOCK,
) -> DataFrame:
    """Replay ``x ← x + rate·(outcome − x)`` over past trials where ``applies``; gives the value before each trial.

    The update is affine, so a stretch of trials folds to a map ``x → a·x + b``. Inside a block the fold is a running sum of
    ``outcome·rate·(1−rate)^(−m)`` over the m updates so far, re-based per block; the blocks' maps are composed in order.
    """
    keep = 1.0 - rate
    # Powers stay finite because a block never applies more than ``width`` updates.
    width = max(8, min(size, int(200 / -math.log(keep))))
    b = df.withColumn("__blk", skew.position_block(F.col(pos), width))
    w = Window.partitionBy(*keys, "__blk").orderBy(pos)
    one = applies.cast("double")
    b = b.withColumn("__a", one).withColumn("__o", F.coalesce(outcome, F.lit(0.0)) * one)
    b = b.withColumn("__m", F.sum("__a").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("__t", F.col("__o") * F.lit(rate) * F.pow(F.lit(keep), -F.col("__m")))
    per = b.groupBy(*keys, "__blk").agg(F.sum("__a").alias("__bm"), F.sum("__t").alias("__bt"))
    factor = F.pow(F.lit(keep), F.col("__bm"))
    maps = per.select(*keys, "__blk", factor.alias("__fa"), (F.col("__bt") * factor).alias("__fb"))
    b = skew.key_join(b, affine_starts(maps, keys, start), [*keys, "__blk"])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mb = F.coalesce(F.sum("__a").over(before), F.lit(0.0))
    tb = F.coalesce(F.sum("__t").over(before), F.lit(0.0))
    value = (F.col("__c") + tb) * F.pow(F.lit(keep), mb)
    return b.withColumn(name, value).drop("__blk", "__a", "__o", "__m", "__t", "__c")


def learned_values(df: DataFrame, keys: Sequence[str], pos: str, rate: float, start: float = 0.5) -> DataFrame:
    """Learned left and right values before each trial and their log ratio, clipped at .01 and scaled by log 100."""
    reward = F.col("ChoiceCorrect").cast("double")
    for name, side in (("q_left", 1), ("q_right", 0)):
        chosen = F.coalesce(F.col("ChoiceLeft") == side, F.lit(False))
        df = replay_average(df, keys, pos, reward, chosen, rate, start, name)
    ratio = F.greatest("q_left", F.lit(0.01)) / F.greatest("q_right", F.lit(0.01))
    return df.withColumn("q_val", F.ln(ratio) / F.ln(F.lit(100.0)))
