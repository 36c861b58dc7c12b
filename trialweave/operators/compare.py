"""Observed against modelled trials, and psychometric curves."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trialweave.functions import skew
from trialweave.operators import behavior as bh
from trialweave.operators import traces as tr

# Quantiles of the response-time loss.
LOSS_QUANTILES = (0.1, 0.3, 0.5, 0.7, 0.9)


def quantile_loss(df: DataFrame, keys: Sequence[str], t_max: float) -> DataFrame:
    """χ² distance of modelled from observed times per key over bins cut at observed quantiles, plus missing times.

    Rows: keys, ``source`` ('real' or 'sim') and ``t``.  Bins without observed times are left out.
    """
    real = df.filter("source = 'real'")
    probs = {f"e{i}": q for i, q in enumerate(LOSS_QUANTILES, 2)}
    edges = skew.exact_percentiles(real, keys, "t", probs)
    low = real.groupBy(*keys).agg((F.min("t") + 1e-6).alias("e1"))
    d = skew.attach(df, edges.join(low, list(keys)), keys, salt_on=["t", "source"], how="inner")
    t = F.col("t")
    bin_ = F.when(t.isNull(), -1).when(t < 0, None).when(t > t_max, None)
    for i in range(1, 7):
        bin_ = bin_.when(t < F.col(f"e{i}"), i - 1)
    d = d.withColumn("bin", bin_.otherwise(6)).filter("bin is not null")
    h = d.groupBy(*keys, "bin").agg(F.count_if(F.col("source") == "real").alias("r"), F.count_if(F.col("source") == "sim").alias("s"))
    gap = F.col("s") - F.col("r")
    return h.filter("r > 0").groupBy(*keys).agg(F.sum(gap * gap / F.col("r")).alias("loss"))


def thirds_by_label(df: DataFrame, label: str, time: str, tie: str) -> DataFrame:
    """Fast, typical and slow thirds per difficulty label over all sessions, cut at floor(n/3) and floor(2n/3)."""
    r = skew.number_rows(df.filter(F.col(time).isNotNull()), [label], [F.col(time), F.col(tie)], skew.value_block(F.col(time)), "__r", "__n")
    third = F.when(F.col("__r") <= F.floor(F.col("__n") / 3), 1).when(F.col("__r") <= F.floor(2 * F.col("__n") / 3), 2).otherwise(3)
    return r.withColumn("third", third.cast("long")).drop("__r", "__n")


def smoothed_histogram(df: DataFrame, keys: Sequence[str], value: str, width: float, t_max: float, window: int) -> DataFrame:
    """Counts per bin up to ``t_max`` with a centred moving average; empty bins count as zero."""
    bins = int(round(t_max / width))
    h = bh.histogram(df.filter(F.col(value).between(0, t_max)), keys, value, width).filter(F.col("bin") < bins)
    grid = h.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = grid.join(h, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    b = skew.with_halo(full, keys, "bin", before=window // 2, after=(window - 1) // 2)
    w = skew.block_window(keys, "bin").rowsBetween(-(window // 2), (window - 1) // 2)
    return skew.drop_ghosts(b.withColumn("smooth", F.sum("n").over(w) / F.lit(float(window))))


def value_surface(df: DataFrame, time: str) -> DataFrame:
    """Mean z-scored time by reward rate (0.1), relative value (0.1) and absolute evidence (1/3), smoothed along the value.

    Cells with one trial are empty.
    """
    z = bh.z_by(df, ["Name"], {"__z": time})
    q = F.when(F.col("DV") == 0, F.col("q_val")).otherwise(F.abs("q_val") * F.sign("DV") * F.sign("q_val"))

    def right_closed(c: Column, lo: float, width: float) -> Column:
        return F.ceil((c - lo) / F.lit(width) - 1e-9).cast("long")

    z = z.withColumns(
        {"rr": right_closed(F.col("learned_rate"), 0.0, 0.1), "q": right_closed(q, -1.0, 0.1), "dv": right_closed(F.abs("DV"), 0.0, 1 / 3)}
    )
    cells = z.groupBy("rr", "dv", "q").agg(F.avg("__z").alias("v"), F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("v", F.when(F.col("n") > 1, F.col("v")))
    return tr.gaussian(cells, ["rr", "dv"], "q", 1.0).select("rr", "dv", "q", "smooth")


def agreement(df: DataFrame, keys: Sequence[str], real: str, model: str) -> DataFrame:
    """R² of the model's values against the observed ones, and their correlation."""
    m = df.groupBy(*keys).agg(F.avg(real).alias("__m"))
    d = skew.attach(df, m, keys)
    err, dev = F.col(real) - F.col(model), F.col(real) - F.col("__m")
    return d.groupBy(*keys).agg(
        (1 - F.sum(err * err) / F.nullif(F.sum(dev * dev), F.lit(0.0))).alias("r2"), F.corr(real, model).alias("pearson"), F.count(F.lit(1)).alias("n")
    )


# W. J. Cody's rational approximations of erf (up to 0.46875) and erfc (up to 4, and beyond), highest power first.
CODY = (
    ((1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03),
     (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)),
    ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02,
      8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03),
     (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
      3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)),
    ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
     (1.0, 2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)),
)


def _horner(c: Sequence[float], x: Column) -> Column:
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + F.lit(k)
    return out


def erf(x: Column) -> Column:
    """Error function inside the JVM, to double precision."""
    z = F.abs(x)
    low, mid, far = (lambda v, r=r: _horner(r[0], v) / _horner(r[1], v) for r in CODY)
    square = 1 / (z * z)
    tail = F.when(z <= 4, F.exp(-z * z) * mid(z)).otherwise(
        F.exp(-z * z) / z * (F.lit(1 / math.sqrt(math.pi)) - square * far(square))
    )
    return F.when(z <= 0.46875, x * low(x * x)).when(x > 0, 1 - tail).otherwise(tail - 1)


MODELS = {
    "weibull": ("alpha", "beta", "gamma"),
    "weibull50": ("alpha", "beta", "gamma"),
    "erf_psycho": ("bias", "slope", "gamma"),
    "erf_psycho_2gammas": ("bias", "slope", "gamma1", "gamma2"),
}


def psychometric(model: str, x: Column, pars: Sequence[Column]) -> Column:
    """Response probability of a psychometric model at stimulus ``x``."""
    if model not in MODELS:
        raise ValueError(f"unknown psychometric model {model}; choose from {', '.join(MODELS)}")
    if len(pars) != len(MODELS[model]):
        raise ValueError(f"{model} takes {len(MODELS[model])} parameters")
    a, b, *lapse = pars
    if model.startswith("weibull"):
        floor = F.lit(0.5) if model == "weibull50" else lapse[0]
        top = 1 - lapse[0]
        return top - (top - floor) * F.exp(-F.pow(x / a, b))
    low, high = (lapse[0], lapse[0]) if len(lapse) == 1 else lapse
    return low + (1 - low - high) * (erf((x - a) / b) + 1) / 2


def neg_log_likelihood(model: str, x: Column, n: Column, p: Column, pars: Sequence[Column], bounds=None) -> Column:
    """Binomial negative log-likelihood as an aggregate over points; 1e7 outside the bounds."""
    eps = 2.220446049250313e-16
    q = psychometric(model, x, pars)
    q = F.when(q <= 0, eps).when(q >= 1, 1 - eps).otherwise(q)
    total = -F.sum(n * (p * F.ln(q) + (1 - p) * F.ln(1 - q)))
    if bounds is None:
        return total
    inside = F.lit(True)
    for par, lo, hi in zip(pars, *bounds):
        inside = inside & par.between(lo, hi)
    return F.when(F.max(~inside), F.lit(1e7)).otherwise(total)


def erf_of(x: np.ndarray) -> np.ndarray:
    """``erf`` of an array, by the same approximations."""
    z = np.abs(x)
    low, mid, far = (lambda v, r=r: np.polyval(r[0], v) / np.polyval(r[1], v) for r in CODY)
    big = np.maximum(z, 0.46875)
    square = 1 / (big * big)
    tail = np.where(z <= 4, np.exp(-z * z) * mid(np.minimum(big, 4)), np.exp(-z * z) / big * (1 / math.sqrt(math.pi) - square * far(square)))
    return np.where(z <= 0.46875, x * low(x * x), np.where(x > 0, 1 - tail, tail - 1))


def psychometric_of(model: str, x: np.ndarray, pars: Sequence[np.ndarray]) -> np.ndarray:
    """``psychometric`` of arrays."""
    a, b, *lapse = pars
    if model.startswith("weibull"):
        floor = 0.5 if model == "weibull50" else lapse[0]
        return 1 - lapse[0] - (1 - lapse[0] - floor) * np.exp(-np.power(x / a, b))
    low, high = (lapse[0], lapse[0]) if len(lapse) == 1 else lapse
    return low + (1 - low - high) * (erf_of((x - a) / b) + 1) / 2


def grid_fit(points: DataFrame, keys: Sequence[str], model: str, lo: Sequence[float], hi: Sequence[float], steps: int = 9, passes: int = 10, shrink: float = 0.45):
    """Best-fitting parameters of every key at once: a parameter grid around the best so far, shrunk at each pass.

    ``points`` holds keys, ``x``, ``n``, ``p``: a handful of evidence bins per key.  The points of a key are one row, and its grids
    are worked out where that row lies: the points are shuffled once, however many passes there are.  Of equal likelihoods the
    least parameters win.
    """
    names = MODELS[model]
    pts = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "n", "p"))).alias("pts"))
    eps = 2.220446049250313e-16

    def fitted(rows: Sequence[dict]) -> list[float]:
        x, n, p = (np.array([r[c] for r in rows], dtype=float) for c in ("x", "n", "p"))
        best, nll = [(a + b) / 2 for a, b in zip(lo, hi, strict=True)], 0.0
        for k in range(passes):
            half = [(b - a) / 2 * shrink**k for a, b in zip(lo, hi, strict=True)]
            # steps points from −half to +half around the best so far, kept inside the bounds
            axes = [np.clip(c + (np.arange(steps) * (2.0 / (steps - 1)) - 1) * h, a, b) for c, h, a, b in zip(best, half, lo, hi, strict=True)]
            grid = [g.reshape(-1, 1) for g in np.meshgrid(*axes, indexing="ij")]
            q = np.clip(psychometric_of(model, x[None, :], grid), eps, 1 - eps)
            cost = -(n * (p * np.log(q) + (1 - p) * np.log(1 - q))).sum(axis=1)
            at = int(cost.argmin())
            best, nll = [float(g[at, 0]) for g in grid], float(cost[at])
        return [*best, nll]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fitted(r) for r in batch.column("pts").to_pylist()], dtype=float).reshape(batch.num_rows, len(names) + 1)
            columns = [*(batch.column(k) for k in keys), *(pa.array(c) for c in made.T)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *names, "nll"])

    kinds = [StructField(f.name, f.dataType) for f in pts.schema if f.name in keys]
    schema = StructType(sorted(kinds, key=lambda f: list(keys).index(f.name)) + [StructField(c, DoubleType()) for c in (*names, "nll")])
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism  # few small rows with much to do: not put together by their size
    return pts.repartition(tasks, *keys).mapInArrow(run, schema)


def performance_edges(fits: DataFrame, keys: Sequence[str], model: str, periods: int) -> DataFrame:
    """Evidence where a fitted curve comes nearest to equal performance steps on each side (201 points)."""
    g = fits.withColumn("dv", F.explode(F.sequence(F.lit(-100), F.lit(100)))).withColumn("dv", F.col("dv") / F.lit(100.0))
    g = g.withColumn("f", psychometric(model, F.col("dv"), [F.col(n) for n in MODELS[model]]))
    ends = g.groupBy(*keys).agg(
        F.max(F.when(F.col("dv") == 0, F.col("f"))).alias("mid"), F.max(F.when(F.col("dv") == 1, F.col("f"))).alias("right"), F.max(F.when(F.col("dv") == -1, F.col("f"))).alias("left")
    )
    steps = F.explode(tr.rows_of(("side", "i"), *[(F.lit(s), F.lit(i)) for s in ("left", "right") for i in range(1, periods)]))
    j = g.join(ends, list(keys)).withColumn("s", steps)
    goal = F.col("mid") + (F.when(F.col("s.side") == "left", F.col("left")).otherwise(F.col("right")) - F.col("mid")) * F.col("s.i") / periods
    same = F.when(F.col("s.side") == "left", F.col("dv") <= 0).otherwise(F.col("dv") >= 0)
    j = j.filter(same).withColumn("d", F.abs(F.col("f") - goal))
    return j.groupBy(*keys, F.col("s.side").alias("side"), F.col("s.i").alias("step")).agg(F.min_by("dv", F.struct(F.col("d"), F.col("dv"))).alias("edge"))
