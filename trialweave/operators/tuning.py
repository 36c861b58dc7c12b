"""Single-neuron tuning: tagged conditions, rank tests, significance summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import skew, tails
from trialweave.operators import behavior as bh
from trialweave.operators import stats as st
from trialweave.operators.traces import rows_of

TRACE = ["ShortName", "trace_id"]
TEST = [*TRACE, "BrainRegion", "Layer", "quantile", "data_col", "prior_col", "prior_val"]
CONDITIONS = ("ChoiceCorrect", "PrevChoiceCorrect", "Difficulty", "PrevDifficulty", "ChoiceLeft", "PrevChoiceLeft")


def _level(dv: str) -> Column:
    """True for the easiest evidence, false for the hardest, else NULL."""
    a = F.abs(dv)
    return F.when(F.abs(a - 1) < 1e-6, True).when(F.abs(a - 1 / 3) < 1e-6, False)


def tag_conditions(df: DataFrame, conditions: Sequence[str] = CONDITIONS, priors: Sequence[str] = (), speed: bool = False):
    """Each trial × trace once per tested column (with its side), prior condition and speed class."""
    side = {"Difficulty": _level("DV"), "PrevDifficulty": _level("PrevDV")}
    sides = [(F.lit(c), side.get(c, F.col(c) == 1)) for c in conditions]
    prior = [(F.lit("none"), F.lit("none"))]
    prior += [(F.lit(p), F.coalesce(F.col(p).cast("string"), F.lit("null"))) for p in priors]
    speeds = [F.lit("All"), F.col("quantile_idx").cast("string")] if speed else [F.lit("All")]
    tagged = df.select(
        *TRACE,
        "BrainRegion",
        "Layer",
        "TrialNumber",
        "x",
        F.array(*speeds).alias("__q"),
        F.filter(rows_of(("n", "s"), *sides), lambda c: c["s"].isNotNull()).alias("__c"),
        rows_of(("n", "v"), *prior).alias("__p"),
    ).filter("x is not null")
    tagged = tagged.withColumn("quantile", F.explode("__q")).withColumn("__c", F.explode("__c")).withColumn("__p", F.explode("__p"))
    return tagged.select(
        *TRACE, "BrainRegion", "Layer", "quantile", F.col("__c.n").alias("data_col"), F.col("__p.n").alias("prior_col"),
        F.col("__p.v").alias("prior_val"), F.col("__c.s").alias("side"), "TrialNumber", "x",
    )


def condition_tests(tagged: DataFrame, medians: bool = False) -> DataFrame:
    """Means, sizes, U and ROC area of every tested condition; conditions with one side only are left out."""
    ranks = st.rank_test(tagged, TEST, "x", F.col("side"))
    mean = {s: F.round(F.avg(F.when(F.col("side") == b, F.col("x"))), 12) for s, b in (("left", True), ("right", False))}
    means = tagged.groupBy(*TEST).agg(*[c.alias(f"{s}_mean") for s, c in mean.items()])
    out = skew.key_join(ranks, means, TEST)
    if medians:
        med = skew.exact_percentiles(tagged, [*TEST, "side"], "x", {"m": 0.5})
        cell = [F.round(F.max(F.when(F.col("side") == b, F.col("m"))), 12).alias(f"{s}_median") for s, b in (("left", True), ("right", False))]
        out = skew.key_join(out, med.groupBy(*TEST).agg(*cell), TEST)
    return out


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("pval", tails.p_mann_whitney("u", F.col("n_left").cast("double"), F.col("n_right").cast("double"), "ties"))


def merge_roc(stats: DataFrame, roc: DataFrame) -> DataFrame:
    """Put the ROC columns beside the test columns; one row per tested condition on both sides."""
    r = roc.select(*TEST, F.col("auc").alias("statistic_roc"), F.col("n_left").alias("n_left_roc"), F.col("n_right").alias("n_right_roc"))
    return skew.null_safe_join(stats, r, TEST).withColumn("IsROCLeftTuned", F.col("statistic_roc") > 0.5)


def fill_region(df: DataFrame, src: DataFrame) -> DataFrame:
    """Region from the session's source where the row has none."""
    s = src.groupBy("ShortName").agg(F.first("BrainRegion", ignorenulls=True).alias("__b"))
    return skew.attach(df, s, ["ShortName"]).withColumn("BrainRegion", F.coalesce("BrainRegion", "__b")).drop("__b")


def tuning_labels(tests: DataFrame, significant: Column) -> DataFrame:
    """(trace, quantile) → 1 for significant left preference, 0 for right."""
    sig = tests.filter(significant)
    return sig.select(*TRACE, "quantile", (F.col("auc") > 0.5).cast("int").alias("tuned_left"))


def label_tests(tests: DataFrame) -> DataFrame:
    """Preference by mean, median, rank statistic and ROC area, and readable names."""
    u2 = F.col("n_left").cast("double") * F.col("n_right") - F.col("u")
    name = F.regexp_replace(F.regexp_replace("data_col", "^Prev", "Previous "), "Choice", "Choice ")
    return tests.withColumns(
        {
            "left_by_mean": F.col("left_mean") > F.col("right_mean"),
            "left_by_median": F.col("left_median") > F.col("right_median"),
            "left_by_u": F.col("u") > u2,
            "left_by_auc": F.col("auc") >= 0.5,
            "name": name,
        }
    )


def significant_share(tests: DataFrame, significant: Column, keys: Sequence[str]) -> DataFrame:
    """Significant, left- and right-preferring tests against all tests per key."""
    left = F.col("auc") > 0.5
    return tests.groupBy(*keys).agg(
        F.count_if(significant).alias("n_significant"),
        F.count_if(significant & left).alias("n_left_pref"),
        F.count_if(significant & ~left).alias("n_right_pref"),
        F.count(F.lit(1)).alias("n_total"),
        (100.0 * F.count_if(significant) / F.count(F.lit(1))).alias("percent"),
    )


def share_over_sessions(share: DataFrame, keys: Sequence[str], min_traces: int) -> DataFrame:
    kept = share.filter(F.col("n_total") >= min_traces)
    return kept.groupBy(*keys).agg(
        F.avg("percent").alias("mean"), bh.sem("percent").alias("sem"), F.count(F.lit(1)).alias("n_sessions"),
        (100.0 * F.sum("n_significant") / F.sum("n_total")).alias("pooled"),
    )


def trace_flags(tests: DataFrame, flags: dict[str, Column], keys: Sequence[str] = TRACE) -> DataFrame:
    """One row per trace with a flag per condition: does any of its tests meet it?"""
    return tests.groupBy(*keys).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()])


#: Bits of a signature: significant without a prior, with its value 0, with its value 1; and tested, in the same order.
SIGNIFICANT, TESTED = (1, 2, 4), (8, 16, 32)


def prior_signatures(tests: DataFrame, significant: Column, prior: str, keys: Sequence[str] = (*TRACE, "BrainRegion", "data_col")) -> DataFrame:
    """One ``signature`` per ``keys``: a bit for each scope (no prior, ``prior`` is 0, ``prior`` is 1) that is significant and for each
    that was tested. Every test is read once; what is asked of a neuron afterwards is a mask. Missing prior values take no part."""
    scope = F.when(F.col("prior_col") == "none", 0).when((F.col("prior_col") == prior) & (F.col("prior_val") == "0"), 1).when((F.col("prior_col") == prior) & (F.col("prior_val") == "1"), 2)
    bits = lambda of: F.element_at(F.array(*map(F.lit, of)), scope + 1)
    sig = F.when(F.coalesce(significant, F.lit(False)), bits(SIGNIFICANT)).otherwise(0)
    return tests.filter(scope.isNotNull()).groupBy(*keys).agg(F.bit_or(sig.bitwiseOR(bits(TESTED))).alias("signature"))


def prior_class(signature: Column) -> Column:
    """The class of a neuron by what is significant: with both, one or no value of the prior, and without the prior. NULL unless all
    three scopes were tested."""
    none, both = signature.bitwiseAND(F.lit(1)) > 0, F.bit_count(signature.bitwiseAND(F.lit(6)))
    found = (
        F.when((both == 2) & none, "both_priors_and_no_prior").when(both == 2, "both_priors_only").when((both == 1) & none, "one_prior_and_no_prior")
        .when(both == 1, "one_prior_only").when(none, "only_no_prior").otherwise("not_significant")
    )
    return F.when(signature.bitwiseAND(F.lit(56)) == 56, found)


def preference_activity(activity: DataFrame, labels: DataFrame) -> DataFrame:
    """Trial activity of preferring, anti-preferring and untuned neurons per speed class."""
    d = skew.attach(activity, labels.select(*TRACE, "tuned_left"), TRACE, salts=1)
    group = F.when(F.col("tuned_left").isNull(), "untuned").when(F.col("tuned_left") == F.col("ChoiceLeft"), "preferred").otherwise("anti")
    d = d.withColumn("group", group)
    per = d.groupBy("quantile_idx", "group", *TRACE).agg(F.avg("x").alias("m"), F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("quantile_idx", "group").agg(
        F.avg("m").alias("mean"), bh.sem("m").alias("sem"), (F.sum("s") / F.sum("n")).alias("pooled"), F.count(F.lit(1)).alias("n_neurons")
    )


def preference_t(activity: DataFrame, labels: DataFrame) -> DataFrame:
    """Paired t of preferred against anti-preferred activity per speed class, neurons as pairs."""
    d = skew.attach(activity, labels.select(*TRACE, "tuned_left"), TRACE, how="inner", salts=1)
    cell = {n: F.avg(F.when(F.col("tuned_left") == k, F.col("x"))) for n, k in (("p", F.col("ChoiceLeft")), ("a", 1 - F.col("ChoiceLeft")))}
    w = d.groupBy("quantile_idx", *TRACE).agg(*[c.alias(n) for n, c in cell.items()])
    p, a = F.col("p"), F.col("a")
    return w.groupBy("quantile_idx").agg(F.count(p - a).alias("n_pairs"), bh.paired_t(p, a).alias("t_stat"))


def trajectories(activity: DataFrame, labels: DataFrame, positions: DataFrame, bins: int) -> DataFrame:
    """Neurons binned by position: preferred and anti-preferred means per bin and the weight 100·(p − a)/p."""
    d = skew.attach(activity, labels.select(*TRACE, "tuned_left"), TRACE, how="inner", salts=1).join(positions, TRACE)
    pref = F.col("tuned_left") == F.col("ChoiceLeft")
    d = d.withColumn("bin", F.least(F.floor(F.col("position") * bins / 100), F.lit(bins - 1)))
    per = d.groupBy("bin", *TRACE).agg(F.avg(F.when(pref, F.col("x"))).alias("p"), F.avg(F.when(~pref, F.col("x"))).alias("a"))
    g = per.groupBy("bin").agg(F.avg("p").alias("p"), F.avg("a").alias("a"), bh.sem("p").alias("ps"), bh.sem("a").alias("as_"), F.count(F.lit(1)).alias("n"))
    w = 100 * (F.col("p") - F.col("a")) / F.nullif("p", F.lit(0.0))
    # error of 100·(1 − a/p)
    e = 100 * F.abs(F.col("a") / F.nullif("p", F.lit(0.0))) * F.sqrt(
        F.pow(F.col("as_") / F.nullif("a", F.lit(0.0)), F.lit(2)) + F.pow(F.col("ps") / F.nullif("p", F.lit(0.0)), F.lit(2))
    )
    return g.select("bin", "n", F.col("p").alias("preferred"), F.col("a").alias("anti"), w.alias("weight"), e.alias("weight_sem"))


def first_component(cut: DataFrame, row: str = "TrialNumber") -> DataFrame:
    """First principal component score of each trial per trace, and the share of variance it explains.

    A trial's slice is one array, whose position × position products are added up where they are made: only a square matrix of
    sums per trace leaves a task. Positions that a trial lacks count as average. The heaviest position has a positive weight.
    """
    s = cut.groupBy(*TRACE, "pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    z = cut.select(*TRACE, row, "pos", "v").join(s, [*TRACE, "pos"])
    scale = F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)
    z = z.select(*TRACE, row, "pos", ((F.col("v") - F.col("m")) / scale).alias("z"))
    whole = z.groupBy(*TRACE, row).agg(F.sort_array(F.collect_list(F.struct("pos", "z"))).alias("zs"))
    pairs = F.flatten(
        F.transform("zs", lambda a: F.transform("zs", lambda b: F.struct(a["pos"].alias("pos"), b["pos"].alias("pos2"), (a["z"] * b["z"]).alias("s"))))
    )
    prod = whole.select(*TRACE, F.explode(pairs).alias("x")).groupBy(*TRACE, "x.pos", "x.pos2").agg(F.sum("x.s").alias("s"))

    def leading(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="pos", columns="pos2", values="s").fillna(0.0)
        val, vec = np.linalg.eigh(m.to_numpy())
        w = vec[:, -1]
        w = w * np.sign(w[np.argmax(np.abs(w))])
        total = val.sum()
        return pd.DataFrame(
            {
                "ShortName": pdf["ShortName"].iloc[0],
                "trace_id": pdf["trace_id"].iloc[0],
                "pos": m.index.to_numpy(),
                "w": w,
                "explained": val[-1] / total if total > 0 else np.nan,
            }
        )

    w = prod.groupBy(*TRACE).applyInPandas(leading, "ShortName string, trace_id long, pos long, w double, explained double")
    j = z.join(w, [*TRACE, "pos"])
    return j.groupBy(*TRACE, row).agg(F.sum(F.col("z") * F.col("w")).alias("score"), F.max("explained").alias("explained"))
