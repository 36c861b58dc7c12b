"""Nearest-time join and movement geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import skew
from trialweave.operators import behavior as bh

POINTS = ("EL", "LL", "ER", "LR", "T")


def nearest_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    offset: int = 0,
    block: int = 3600 * 10**6,
    max_diff: int | None = None,
) -> DataFrame:
    """For each left row the right row of the same key with the nearest time after adding ``offset`` to the left time.

    Both sides are laid along one time line cut into blocks.  Inside a block the neighbours come from a window; the last and
    first right row of every block travel to the blocks around it, so a key of any size is spread and no pair is formed.  The
    earlier row wins a draw.  ``left`` and ``right`` bring ``id`` beside the keys and the time.
    """
    keys = list(keys)
    a = left.select(*keys, F.col("id").alias("left_id"), F.col(time).alias("left_time"), (F.col(time) + offset).alias("__t"))
    b = right.select(*keys, F.struct(F.col(time).alias("t"), (-F.col("id")).alias("i")).alias("__r"), F.col(time).alias("__t"))
    u = a.unionByName(b, allowMissingColumns=True)
    u = u.withColumn("__blk", F.floor(F.col("__t") / F.lit(block)))
    u = skew.carry_in(u, keys, {"__before": (F.max, F.max("__r"))})
    u = skew.carry_in(u, keys, {"__after": (F.min, F.min("__r"))}, reverse=True)
    # Range frames see rows of the same instant on both sides; both frames grow row by row, so a block costs its length.
    block_of = Window.partitionBy(*keys, "__blk")
    past = block_of.orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    future = block_of.orderBy(F.col("__t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumns(
        {
            "__p": F.coalesce(F.max("__r").over(past), F.col("__before")),
            "__f": F.coalesce(F.min("__r").over(future), F.col("__after")),
        }
    ).filter("left_id is not null")
    dp, df = F.col("__t") - F.col("__p.t"), F.col("__f.t") - F.col("__t")
    pick = F.when(F.col("__p").isNotNull() & (F.col("__f").isNull() | (dp <= df)), F.col("__p")).otherwise(F.col("__f"))
    out = u.select(*keys, "left_id", "left_time", (-pick["i"]).alias("right_id"), (pick["t"] - F.col("__t")).alias("time_diff"))
    out = out.filter("right_id is not null")
    return out if max_diff is None else out.filter(F.abs("time_diff") < max_diff)


def clip_time(name: Column) -> Column:
    """Seconds since 1970 from the time stamp in a clip's file name (clock time, zone-free)."""
    stamp = F.regexp_extract(name, r"images_(\d{4}-\d{2}-\d{2} \d{2}_\d{2}_\d{2})", 1)
    ts = F.to_timestamp_ntz(stamp, F.lit("yyyy-MM-dd HH_mm_ss"))
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def rotate(df: DataFrame, session: str, refs: DataFrame, points: Sequence[str] = POINTS) -> DataFrame:
    """Coordinates along and across the axis from the session's median screw to its top reference.

    Adds per point ``_xp``, ``_yp`` (across, along), ``_xn``, ``_yn`` (in axis lengths), ``_deg`` and ``_dn``.
    """
    sx = skew.exact_percentiles(df, [session], "screw_x", {"__bx": 0.5})
    sy = skew.exact_percentiles(df, [session], "screw_y", {"__by": 0.5})
    base = sx.join(sy, session).join(refs, session)
    d = skew.attach(df, base, [session], salt_on=["TrialNumber", "frame"])
    ux, uy = F.col("top_x") - F.col("__bx"), F.col("top_y") - F.col("__by")
    d = d.withColumns({"__ux": ux, "__uy": uy}).withColumn("__len", F.hypot("__ux", "__uy"))
    out = {}
    for p in points:
        vx, vy = F.col(f"{p}_x") - F.col("__bx"), F.col(f"{p}_y") - F.col("__by")
        cross = F.col("__ux") * vy - F.col("__uy") * vx
        dot = F.col("__ux") * vx + F.col("__uy") * vy
        out[f"{p}_xp"] = cross / F.col("__len")
        out[f"{p}_yp"] = dot / F.col("__len")
        out[f"{p}_xn"] = cross / (F.col("__len") * F.col("__len"))
        out[f"{p}_yn"] = dot / (F.col("__len") * F.col("__len"))
        out[f"{p}_deg"] = F.degrees(F.atan2(cross, dot))
        out[f"{p}_dn"] = F.hypot(vx, vy) / F.col("__len")
    return d.withColumns(out).drop("__bx", "__by", "__ux", "__uy", "__len", "top_x", "top_y")


def interpolate(df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], size: int = skew.BLOCK) -> DataFrame:
    """Linear interpolation of missing values along ``pos``; constant beyond the first and last known value."""
    b = df.withColumn("__blk", skew.position_block(F.col(pos), size))
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(v).alias("v"))) for v in values}
    b = b.withColumns({f"__k_{v}": c for v, c in known.items()})
    b = skew.carry_in(b, keys, {f"__b_{v}": (F.max, F.max(f"__k_{v}")) for v in values})
    b = skew.carry_in(b, keys, {f"__a_{v}": (F.min, F.min(f"__k_{v}")) for v in values}, reverse=True)
    block_of = Window.partitionBy(*keys, "__blk")
    past = block_of.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    future = block_of.orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns(
        {
            **{f"__p_{v}": F.coalesce(F.max(f"__k_{v}").over(past), F.col(f"__b_{v}")) for v in values},
            **{f"__n_{v}": F.coalesce(F.min(f"__k_{v}").over(future), F.col(f"__a_{v}")) for v in values},
        }
    )
    out = {}
    for v in values:
        p, n = F.col(f"__p_{v}"), F.col(f"__n_{v}")
        gap = F.nullif(n["p"] - p["p"], F.lit(0))
        line = p["v"] + (n["v"] - p["v"]) * (F.col(pos) - p["p"]) / gap
        out[v] = F.coalesce(F.col(v), line, p["v"], n["v"])
    return b.withColumns(out).drop("__blk", *[f"__{s}_{v}" for v in values for s in "kbapn"])


def reject_bad_tail(df: DataFrame, min_score: float = 0.25) -> DataFrame:
    """Drop a tail seen with a low score or below both limbs."""
    bad = (F.col("T_score") < min_score) | F.coalesce(F.col("T_y") < F.least("LL_y", "LR_y"), F.lit(False))
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in ("T_x", "T_y")})


def _offsets(df: DataFrame, session: str) -> DataFrame:
    """Mean session offsets between point pairs (rows where both points are seen)."""
    pairs = {"sh": ("ER", "EL"), "li": ("LR", "LL"), "le": ("EL", "LL"), "ri": ("ER", "LR")}
    aggs = [F.avg(F.col(f"{a}_{d}") - F.col(f"{b}_{d}")).alias(f"__{n}_{d}") for n, (a, b) in pairs.items() for d in "xy"]
    return df.groupBy(session).agg(*aggs)


def estimate_points(df: DataFrame, session: str) -> DataFrame:
    """Fill missing shoulder and limb points from the seen ones.

    One seen shoulder gives the other shoulder; two points give the other two by the session's mean offsets; three points
    give the fourth by the offset of the complete side.  ``n_points`` counts the points afterwards; an ``_est`` flag marks
    the filled ones.
    """
    d = skew.attach(df, _offsets(df, session), [session], salt_on=["TrialNumber", "frame"])
    has = {p: F.col(f"{p}_x").isNotNull() for p in ("EL", "ER", "LL", "LR")}
    n = sum((h.cast("int") for h in has.values()), F.lit(0))
    out: dict[str, Column] = {}
    # point ← (other point, offset, sign) tried in order for two seen points; the other point must be seen
    two = {
        "EL": [("LL", "le", 1, "LR"), ("ER", "sh", -1, None)],
        "ER": [("LR", "ri", 1, "LL"), ("EL", "sh", 1, None)],
        "LL": [("EL", "le", -1, "ER"), ("LR", "li", -1, None)],
        "LR": [("ER", "ri", -1, "EL"), ("LL", "li", 1, None)],
    }
    mate = {"EL": "ER", "ER": "EL"}
    other = {"EL": ("LL", "LR", "ER", -1), "ER": ("LR", "LL", "EL", -1), "LL": ("EL", "LR", "ER", 1), "LR": ("ER", "LL", "EL", 1)}
    for p in has:
        for dim in "xy":
            def at(q):
                return F.col(f"{q}_{dim}")

            fill = F.lit(None).cast("double")
            if p in mate:
                s = 1 if p == "ER" else -1
                fill = F.when((n == 1) & has[mate[p]], at(mate[p]) + s * F.col(f"__sh_{dim}"))
            (q1, o1, s1, need), (q2, o2, s2, _) = two[p]
            # both limbs (or both shoulders) seen: vertical offsets; otherwise sideways offsets
            fill = F.when((n == 2) & has[q1] & has[need], at(q1) + s1 * F.col(f"__{o1}_{dim}")).when(
                (n == 2) & has[q2], at(q2) + s2 * F.col(f"__{o2}_{dim}")
            ).otherwise(fill)
            own, limb, shoulder, sign = other[p]
            fill = F.when(n == 3, at(own) + sign * (at(limb) - at(shoulder))).otherwise(fill)
            out[f"{p}_{dim}"] = F.when(has[p], at(p)).otherwise(fill)
        out[f"{p}_est"] = ~has[p] & out[f"{p}_x"].isNotNull()
    d = d.withColumns(out)
    seen = sum((F.col(f"{p}_x").isNotNull().cast("int") for p in has), F.lit(0))
    return d.withColumn("n_points", seen).drop(*[f"__{k}_{x}" for k in ("sh", "li", "le", "ri") for x in "xy"])


def centroid(df: DataFrame) -> DataFrame:
    """Centre of the outline (four points and the tail, or tail and shoulders) from whole coordinates, and its angle."""
    def cut(p, d):
        return F.col(f"{p}_{d}").cast("int")

    tail = F.col("T_x").isNotNull()
    four = ["ER", "EL", "LL", "LR"]
    out = {}
    for d in "xy":
        quad = sum((cut(p, d) for p in four), F.lit(0))
        tri = cut("T", d) + cut("ER", d) + cut("EL", d)
        shoulders = F.col("ER_x").isNotNull() & F.col("EL_x").isNotNull()
        out[f"c_{d}"] = (
            F.when((F.col("n_points") == 4) & tail, (quad + cut("T", d)) / 5)
            .when(F.col("n_points") == 4, quad / 4)
            .when(tail & shoulders, tri / 3)
        )
    df = df.withColumns(out)
    return df.withColumn("angle", -(F.degrees(F.atan2("c_y", "c_x")) - 90.0))


def trim_trial(df: DataFrame, trial: Sequence[str], value: str, p: float) -> DataFrame:
    return bh.between_quantiles(df, trial, value, p, 1 - p)


def fraction_histogram(df: DataFrame, keys: Sequence[str], session: str, value: str, lo: float, hi: float, width: float):
    """Share of the session's trials per bin, then mean and SEM over sessions; sessions without a bin count as zero."""
    bins = int(round((hi - lo) / width))
    d = df.filter(F.col(value).isNotNull())
    total = d.groupBy(*keys, session).agg(F.count(F.lit(1)).alias("t"))
    idx = F.when(F.col(value) == hi, bins - 1).otherwise(F.floor((F.col(value) - lo) / F.lit(width)))
    h = d.withColumn("bin", idx.cast("long")).filter(F.col("bin").between(0, bins - 1))
    h = h.groupBy(*keys, session, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    f = grid.join(h, [*keys, session, "bin"], "left").withColumn("f", F.coalesce("n", F.lit(0)) / F.col("t"))
    return f.groupBy(*keys, "bin").agg(F.avg("f").alias("mean"), bh.sem("f").alias("sem"), F.count(F.lit(1)).alias("n_sessions"))


def side_signs(df: DataFrame, session: str, value: str) -> DataFrame:
    """Sign the value by agreement with the choice; flip sessions that lean to the negative side."""
    s = F.when(F.col("ChoiceLeft") == 1, F.col(value)).otherwise(-F.col(value))
    d = df.withColumn("signed", s)
    lean = d.groupBy(session).agg((F.count_if(F.col("signed") < 0) > F.count_if(F.col("signed") > 0)).alias("__flip"))
    d = skew.attach(d, lean, [session])
    return d.withColumn("preferred", F.when(F.col("__flip"), -F.col("signed")).otherwise(F.col("signed"))).drop("__flip")


def distance_from_base(df: DataFrame, subject: str, group: Sequence[str], value: str, min_rows: int, classes: int) -> DataFrame:
    """Distance of each trial's angle from the subject's most frequent 5° angle (the smallest on ties).

    Groups need ``min_rows`` trials and subjects all speed classes.
    """
    step = F.bround(F.col(value) / 5) * 5
    h = df.withColumn("__b", step).groupBy(subject, "__b").agg(F.count(F.lit(1)).alias("n"))
    base = h.groupBy(subject).agg(F.max_by("__b", F.struct(F.col("n"), (-F.col("__b")).alias("b"))).alias("base"))
    d = skew.attach(df, base, [subject]).withColumn("distance", F.abs(F.col(value) - F.col("base")))
    g = d.groupBy(subject, *group).agg(F.avg("distance").alias("distance"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    full = g.groupBy(subject).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == classes).select(subject)
    return g.join(full, subject, "left_semi")
