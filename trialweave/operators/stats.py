"""Rank, variance and correction statistics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import skew, tails


def rank_test(df: DataFrame, keys: Sequence[str], value: str, left: Column) -> DataFrame:
    """Two-sample rank statistics per ``keys``: sizes, U of the left side, ROC area and the tie term Σ(t³ − t).

    ``left`` is true, false or NULL (row unused).  Only distinct values with their counts are ordered.
    """
    used = df.withColumn("__l", left).filter("__l is not null").filter(F.col(value).isNotNull())
    counts = used.groupBy(*keys, F.col(value).alias("v")).agg(
        F.count_if("__l").alias("cl"), F.count(F.lit(1)).alias("c")
    )
    r = skew.mid_ranks(counts, keys)
    n1, n = F.sum("cl").cast("double"), F.sum("c").cast("double")  # products of counts pass the range of longs
    u = F.sum(F.col("cl") * F.col("mid_rank")) - n1 * (n1 + 1) / 2
    out = r.groupBy(*keys).agg(
        n1.cast("long").alias("n_left"),
        (n - n1).cast("long").alias("n_right"),
        u.alias("u"),
        F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties"),
    )
    out = out.filter("n_left > 0 and n_right > 0")
    return out.withColumn("auc", F.col("u") / (F.col("n_left").cast("double") * F.col("n_right")))


def _ordered_p(df: DataFrame, family: Sequence[str], p: str, tie: Sequence[str]) -> DataFrame:
    """Rows with a p-value, with their rank ``__r`` by it and the family's size ``__m``; a family may hold any share of all rows."""
    known = df.filter(F.col(p).isNotNull())
    return skew.number_rows(known, family, [F.col(p), *map(F.col, tie)], skew.value_block(F.col(p)), "__r", "__m")


def _running(df: DataFrame, family: Sequence[str], value: str, fold, reverse: bool) -> DataFrame:
    """``__run``: ``fold`` of ``value`` over the rows up to (or from) each one, along ``__r`` in blocks."""
    b = skew.carry_in(df.withColumn("__blk", skew.position_block(F.col("__r"))), family, {"__in": (fold, fold(value))}, reverse)
    order = F.col("__r").desc() if reverse else F.col("__r")
    w = Window.partitionBy(*family, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = F.greatest if fold is F.max else F.least  # skip missing values
    return b.withColumn("__run", both(fold(value).over(w), F.col("__in"))).drop("__blk", "__in")


def holm(df: DataFrame, family: Sequence[str], p: str, tie: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Holm step-down per family; missing p-values stay missing and do not count."""
    raw = _ordered_p(df, family, p, tie).withColumn("__raw", (F.col("__m") - F.col("__r") + 1) * F.col(p))
    stepped = _running(raw, family, "__raw", F.max, False).withColumn(out, F.least("__run", F.lit(1.0)))
    rest = df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return stepped.drop("__raw", "__run", "__r", "__m").unionByName(rest)


def paired_tests(df: DataFrame, family: Sequence[str], test: str, a: str, b: str, min_pairs: int = 2) -> DataFrame:
    """``n_pairs, t_stat, p, p_holm`` of ``a`` against ``b`` for each value of ``test``, corrected over the tests of a family.

    Pairs that lack a side do not count. Tests with fewer than ``min_pairs`` pairs, or whose differences are all equal, have no p and
    take no part in the correction.
    """
    gap = F.col(a) - F.col(b)
    error = F.stddev_samp(gap) / F.sqrt(F.count(gap))
    t = df.filter(gap.isNotNull()).groupBy(*family, test).agg(F.count(gap).alias("n_pairs"), (F.avg(gap) / F.nullif(error, F.lit(0.0))).alias("t_stat"))
    t = t.withColumn("p", F.when((F.col("n_pairs") >= min_pairs) & F.col("t_stat").isNotNull(), tails.p_student("t_stat", F.col("n_pairs") - 1)))
    t = t.withColumn("p", F.nanvl("p", F.lit(None).cast("double"))).withColumn("__one", F.lit(1))
    return holm(t, [*family, "__one"], "p", [test]).drop("__one")


def benjamini_hochberg(df: DataFrame, family: Sequence[str], p: str, tie: Sequence[str], out: str = "p_bh") -> DataFrame:
    """False-discovery adjustment: running minimum of p·m/i from the largest p down; missing p-values stay missing."""
    raw = _ordered_p(df, family, p, tie).withColumn("__raw", F.col(p) * F.col("__m") / F.col("__r"))
    stepped = _running(raw, family, "__raw", F.min, True).withColumn(out, F.least("__run", F.lit(1.0)))
    rest = df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return stepped.drop("__raw", "__run", "__r", "__m").unionByName(rest)


def repeated_anova(df: DataFrame, family: Sequence[str], subject: str, condition: str, value: str) -> DataFrame:
    """F of a balanced subject × condition design from sums of squares at four grouping levels."""
    sets = [[*family, subject], [*family, condition], [*family, subject, condition], [*family]]
    g = df.groupingSets(sets, *family, subject, condition).agg(
        F.grouping(subject).alias("gs"), F.grouping(condition).alias("gc"), F.sum(value).alias("__s_"), F.sum(F.col(value) * F.col(value)).alias("__q"), F.count(value).alias("__n_")
    )
    part = F.col("__s_") * F.col("__s_") / F.col("__n_")

    def level(gs, gc, what):
        return F.sum(F.when((F.col("gs") == gs) & (F.col("gc") == gc), what))

    a = g.groupBy(*family).agg(
        level(0, 1, part).alias("ss_s"), level(1, 0, part).alias("ss_c"), level(1, 1, part).alias("cf"), level(1, 1, F.col("__q")).alias("__q"),
        level(0, 1, F.lit(1)).alias("ns"), level(1, 0, F.lit(1)).alias("nc"),
    )
    between = F.col("ss_c") - F.col("cf")
    error = F.col("__q") - F.col("ss_s") - F.col("ss_c") + F.col("cf")
    d1 = F.col("nc") - 1
    d2 = d1 * (F.col("ns") - 1)
    return a.select(*family, (between / d1 / (error / d2)).alias("f_stat"), d1.alias("df1"), d2.alias("df2"))


def one_way_anova(df: DataFrame, family: Sequence[str], group: str, value: str) -> DataFrame:
    g = df.groupBy(*family, group).agg(F.sum(value).alias("__s_"), F.sum(F.col(value) * F.col(value)).alias("__q"), F.count(value).alias("__n_"))
    a = g.groupBy(*family).agg(
        F.sum(F.col("__s_") * F.col("__s_") / F.col("__n_")).alias("__a_"), F.sum("__s_").alias("__s_"), F.sum("__q").alias("__q"), F.sum("__n_").alias("__n_"), F.count(F.lit(1)).alias("__k_")
    )
    d1, d2 = F.col("__k_") - 1, F.col("__n_") - F.col("__k_")
    f = (F.col("__a_") - F.col("__s_") * F.col("__s_") / F.col("__n_")) / d1 / ((F.col("__q") - F.col("__a_")) / d2)
    return a.select(*family, f.alias("f_stat"), d1.alias("df1"), d2.alias("df2"))


def rank_sums(df: DataFrame, family: Sequence[str], group: str, value: str) -> DataFrame:
    """Per group: size and sum of mid-ranks within the family, with the family's tie term."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*family, group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("cg"))
    tot = counts.groupBy(*family, "v").agg(F.sum("cg").alias("c"))
    r = skew.mid_ranks(tot, family)
    t = r.groupBy(*family).agg(F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties"), F.sum("c").alias("n"))
    j = counts.join(r.select(*family, "v", "mid_rank"), [*family, "v"])
    s = j.groupBy(*family, group).agg(F.sum("cg").alias("ng"), F.sum(F.col("cg") * F.col("mid_rank")).alias("rs"))
    return skew.attach(s, t, family)


def kruskal(ranks: DataFrame, family: Sequence[str]) -> DataFrame:
    """H with tie correction from :func:`rank_sums`."""
    n = F.max("n").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("rs").cast("double") * F.col("rs") / F.col("ng")) - 3 * (n + 1)
    return ranks.groupBy(*family).agg((h / (1 - F.max("ties") / (n * n * n - n))).alias("h_stat"), (F.count(F.lit(1)) - 1).alias("df"))


def dunn(ranks: DataFrame, family: Sequence[str], group: str) -> DataFrame:
    """Pairwise z of mean ranks over the few groups of a family."""
    a = ranks.select(*family, F.col(group).alias("a"), F.col("rs").alias("ra"), F.col("ng").alias("na"), "n", "ties")
    b = ranks.select(*family, F.col(group).alias("b"), F.col("rs").alias("rb"), F.col("ng").alias("nb"))
    j = a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), [*family, "__one"]).filter("a < b")
    n = F.col("n").cast("double")
    var = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("na") + 1 / F.col("nb"))
    return j.select(*family, "a", "b", ((F.col("ra") / F.col("na") - F.col("rb") / F.col("nb")) / F.sqrt(var)).alias("z"))


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, share: float, tie: Sequence[str]) -> DataFrame:
    """Mean after cutting floor(share·n) values from each end."""
    d = df.filter(F.col(value).isNotNull())
    r = skew.number_rows(d, keys, [F.col(value), *map(F.col, tie)], skew.value_block(F.col(value)), "__r", "__n")
    cut = F.floor(F.lit(share) * F.col("__n"))
    kept = r.filter((F.col("__r") > cut) & (F.col("__r") <= F.col("__n") - cut))
    return kept.groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"), F.count(F.lit(1)).alias("n_kept"))


def _beside(xs: DataFrame, ys: DataFrame, keys: Sequence[str], state: DataFrame, shifts: Column) -> DataFrame:
    """The values of ``xs`` moved down by each shift, merged in falling order with those of ``ys``: ``cum`` and ``rank`` are how many
    rows and distinct values of ``ys`` are not below a moved value.
    """

    def side(df: DataFrame, is_x: bool) -> DataFrame:
        d = skew.attach(df, state, keys, ["v"], how="inner").select(*keys, "v", "c", F.posexplode(shifts).alias("i", "d"))
        place = F.col("v") - F.col("d") if is_x else F.col("v")
        own = lambda c: F.lit(0).cast("long") if is_x else c.cast("long")
        return d.select(*keys, "v", "c", "i", "d", (F.lit(0.0) - place).alias("w"), F.lit(is_x).alias("is_x"), own(F.col("c")).alias("cy"), own(F.lit(1)).alias("one"))

    both = side(xs, True).unionByName(side(ys, False))
    # equal places: false before true, so a value of ys counts for the moved value that it equals
    return skew.running_sum(both, [*keys, "i"], ["w", "is_x"], skew.value_block(F.col("w")), {"cum": "cy", "rank": "one"})


def hodges_lehmann(
    df: DataFrame, keys: Sequence[str], value: str, left: Column, cuts: int = 32, spare: int = 100_000, keep=lambda df, name: df
) -> DataFrame:
    """Median of all differences between a value of the left side and one of the right side per ``keys``: ``n_left, n_right, shift``.

    No pair is formed on the way to the median. Each round counts, for ``cuts`` shifts of every group at once, the pairs below them by
    merging the two cumulative count tables, and narrows the interval that holds the median; once it holds no more pairs of distinct
    values than there are values (four times, plus ``spare``), those alone are listed and ranked. Any one difference has at most one
    partner per value, so narrowing always ends. ``left`` is true, false or NULL (row unused); null and NaN values are ignored, and
    groups without values on a side are absent. ``keep(df, name)`` may store the state of a round.
    """
    keys = list(keys)
    used = df.withColumn("__l", left).where("__l is not null").withColumn("v", F.col(value).cast("double")).where("v is not null and not isnan(v)")
    counts = keep(used.groupBy(*keys, "__l", (F.col("v") + F.lit(0.0)).alias("v")).agg(F.count(F.lit(1)).alias("c")), "counts")
    xs, ys = (counts.where(c).select(*keys, "v", "c") for c in ("__l", "not __l"))
    ends = lambda d, n: d.groupBy(*keys).agg(F.sum("c").alias(f"n_{n}"), F.count(F.lit(1)).alias(f"d_{n}"), F.min("v").alias(f"min_{n}"), F.max("v").alias(f"max_{n}"))
    big = "decimal(38,0)"
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = ends(xs, "left").join(ends(ys, "right"), keys)
    pairs, low, high = wide("n_left") * wide("n_right"), F.col("min_left") - F.col("max_right"), F.col("max_left") - F.col("min_right")
    state = both.select(
        *keys, "n_left", "n_right", (4 * (F.col("d_left") + F.col("d_right")) + spare).cast(big).alias("bound"),
        F.floor((pairs + 1) / 2).cast(big).alias("k1"), (F.floor(pairs / 2) + 1).cast(big).alias("k2"),
        (low - 1 - F.abs(low) * 1e-9).alias("lo"), (high + 1 + F.abs(high) * 1e-9).alias("hi"),
        F.lit(0).cast(big).alias("c_lo"), (wide("d_left") * wide("d_right")).cast(big).alias("open"), F.lit(0).cast(big).alias("r_lo"),
        (wide("d_left") * wide("d_right")).cast(big).alias("r_hi"),
    )
    state = keep(state, "interval 0")
    for turn in range(1, 17):  # 5 bits a round and more
        wider = state.where("open > bound")
        if wider.isEmpty():
            break
        grid = F.transform(F.sequence(F.lit(1), F.lit(cuts - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / cuts)
        merged = _beside(xs, ys, keys, wider.select(*keys, "lo", "hi"), grid).where("is_x")
        below = merged.groupBy(*keys, "i", "d").agg(
            F.sum(wide("c") * wide("cum")).cast(big).alias("n"), F.sum(wide("rank")).cast(big).alias("r")
        )
        seen = skew.attach(below, state.select(*keys, "k1", "k2"), keys, ["i"], how="inner")
        under, over = F.col("n") < F.col("k1"), F.col("n") >= F.col("k2")
        new = seen.groupBy(*keys).agg(
            *[F.max(F.when(under, F.col(c))).alias(f"{c}_under") for c in ("d", "n", "r")], *[F.min(F.when(over, F.col(c))).alias(f"{c}_over") for c in ("d", "r")]
        )
        either = lambda a, b: F.coalesce(F.col(a), F.col(b)).alias(b)
        state = state.join(new, keys, "left").select(
            *keys, "n_left", "n_right", "bound", "k1", "k2", either("d_under", "lo"), either("d_over", "hi"), either("n_under", "c_lo"),
            either("r_under", "r_lo"), either("r_over", "r_hi"),
        ).withColumn("open", F.col("r_hi") - F.col("r_lo"))
        state = keep(state, f"interval {turn}")
    merged = keep(_beside(xs, ys, keys, state.select(*keys, "lo", "hi"), F.array("lo", "hi")), "merged")
    spans = merged.where("is_x").groupBy(*keys, F.col("v").alias("x"), F.col("c").alias("cx")).agg(F.min("rank").alias("a"), F.max("rank").alias("b"))
    asked = spans.where("b > a").select(*keys, "x", "cx", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("rank"))
    ranked = merged.where("not is_x and i = 0").select(*keys, "rank", F.col("v").alias("y"), F.col("c").alias("cy"))
    found = asked.join(ranked, [*keys, "rank"]).groupBy(*keys, (F.col("x") - F.col("y")).alias("d")).agg(F.sum(wide("cx") * wide("cy")).cast(big).alias("n"))
    summed = skew.running_sum(found, keys, ["d"], skew.value_block(F.col("d")), {"cum": "n"})
    placed = skew.attach(summed, state.select(*keys, "n_left", "n_right", "k1", "k2", "c_lo"), keys, ["d"], how="inner")
    at = lambda k: F.min(F.when(F.col("cum") + F.col("c_lo") >= F.col(k), F.col("d")))
    return placed.groupBy(*keys, "n_left", "n_right").agg(((at("k1") + at("k2")) / 2).alias("shift"))
