"""Trace operators on long rows (session, trace, frame, v).

A trace is stored one row per frame, so its length is unbounded and no operator needs a whole trace in one task.  Cut and
concatenated epochs use ``pos`` (0-based position in the cut) in place of ``frame``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from trialweave.functions import skew

TRACE = ["ShortName", "trace_id"]


def rows_of(names: Sequence[str], *rows: Sequence[Column]) -> Column:
    """An array of structs with the same field names, to be exploded."""
    return F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, r)]) for r in rows])


# ---- joining epochs and traces --------------------------------------------------------------------------------------


def slice_join(epochs: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of every epoch (inclusive ends).  The join key holds the frame, so a busy session spreads by frame."""
    spans = epochs.withColumn("frame", F.explode(F.sequence("trace_start_idx", "trace_end_idx")))
    return spans.join(frames, ["ShortName", "frame"])


def to_arrays(frames: DataFrame, chunk: int = 4096) -> DataFrame:
    """Arrays of at most ``chunk`` frames per row."""
    part = frames.withColumn("chunk", F.floor(F.col("frame") / chunk))
    rows = F.array_sort(F.collect_list(F.struct("frame", "v")))
    return part.groupBy(*TRACE, "chunk").agg(F.transform(rows, lambda x: x["v"]).alias("values"))


def to_frames(arrays: DataFrame, chunk: int = 4096) -> DataFrame:
    exploded = arrays.select(*TRACE, "chunk", F.posexplode("values").alias("i", "v"))
    return exploded.select(*TRACE, (F.col("chunk") * chunk + F.col("i")).alias("frame"), "v")


def combine_traces(df: DataFrame, by: str, prefix: str = "") -> DataFrame:
    """Rename each trace by the row's ``by`` value so that traces of several rows can share one row."""
    return df.withColumn("trace_id", F.concat_ws("_", F.concat(F.lit(prefix), F.col(by).cast("string")), "trace_id"))


def keep_only(df: DataFrame, src: DataFrame, keys: Sequence[str], remove: bool = False) -> DataFrame:
    """Rows whose session and trace appear (or, with ``remove``, do not appear) in ``src``."""
    return skew.attach(df, src.select(*keys).distinct(), keys, how="left_anti" if remove else "left_semi")


def nth_pairs(df: DataFrame, left: Column, right: Column, group: Sequence[str], row: Sequence[str], frame: str) -> DataFrame:
    """The n-th left row beside the n-th right row of each group, frame by frame: columns ``l`` and ``r``."""
    rows = df.withColumn("side", F.when(left, "l").when(right, "r")).filter("side is not null")
    index = rows.select(*group, *row, "side").distinct()
    index = skew.number_rows(index, [*group, "side"], [F.col(c) for c in row], skew.position_block(F.col(row[0])), "n")
    tagged = rows.join(index, [*group, *row, "side"])
    both = tagged.groupBy(*group, "n", "trace_id", frame).agg(
        F.max(F.when(F.col("side") == "l", F.col("v"))).alias("l"),
        F.max(F.when(F.col("side") == "r", F.col("v"))).alias("r"),
        F.count_distinct("side").alias("__k"),
    )
    return both.filter("__k = 2").drop("__k")


# ---- normalising ----------------------------------------------------------------------------------------------------


def z_score(df: DataFrame, keys: Sequence[str], value: str = "v", only: Column | None = None) -> DataFrame:
    """Population z-score per trace; ``only`` restricts the rows the mean and deviation come from."""
    src = F.col(value) if only is None else F.when(only, F.col(value))
    s = df.groupBy(*keys).agg(F.avg(src).alias("__m"), F.stddev_pop(src).alias("__d"))
    out = skew.attach(df, s, keys)
    return out.withColumn(value, (F.col(value) - F.col("__m")) / F.nullif("__d", F.lit(0.0))).drop("__m", "__d")


def percentile_scale(df: DataFrame, keys: Sequence[str], bottom: float, top: float, value: str = "v") -> DataFrame:
    """Clip to two percentiles and scale to 0..1, four decimals (half to even)."""
    q = skew.exact_percentiles(df, keys, value, {"__lo": bottom / 100, "__hi": top / 100})
    out = skew.attach(df, q, keys)
    lo, hi = F.col("__lo"), F.col("__hi")
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), hi), lo))
    scaled = (clipped - lo) / F.nullif(hi - lo, F.lit(0.0))
    return out.withColumn(value, F.bround(scaled, 4)).drop("__lo", "__hi")


def min_max_scale(df: DataFrame, keys: Sequence[str], lo: float = 0.0, hi: float = 1.0, value: str = "v") -> DataFrame:
    """Rescale the values of matching rows to ``lo``..``hi`` after rounding to four decimals."""
    s = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    out = skew.attach(df, s, keys)
    unit = (F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    return out.withColumn(value, F.bround(unit, 4) * (hi - lo) + lo).drop("__lo", "__hi")


# ---- smoothing and baseline -----------------------------------------------------------------------------------------


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights from −radius to radius, truncated at four sigma."""
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(w)
    return [x / total for x in w]


def smoothed(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Σ w·x + (1 − Σ w)·x over the neighbours that hold a value; missing values (NaN) stay missing."""
    held = ~np.isnan(x)
    r = len(weights) // 2
    around = lambda y: np.convolve(np.pad(y, r), weights, "valid")
    return np.where(held, around(np.where(held, x, 0.0)) + (1 - around(held.astype(float))) * x, np.nan)


def running_extreme(x: np.ndarray, back: int, ahead: int, of: np.ufunc) -> np.ndarray:
    """Least (``np.minimum``) or greatest (``np.maximum``) of the values from ``back`` before to ``ahead`` after each place.

    Chunks as wide as the window hold growing extremes from both ends; a window is the end of one chunk and the beginning of the next,
    so a place costs the same for any width. Missing values (NaN) do not count.
    """
    width, none = back + ahead + 1, np.inf if of is np.minimum else -np.inf
    filled = np.concatenate([np.full(back, none), np.where(np.isnan(x), none, x), np.full(ahead + width, none)])
    chunks = filled[: len(filled) // width * width].reshape(-1, width)
    upto, onward = of.accumulate(chunks, axis=1).ravel(), of.accumulate(chunks[:, ::-1], axis=1)[:, ::-1].ravel()
    out = of(onward[: len(x)], upto[width - 1 : width - 1 + len(x)])
    return np.where(np.isinf(out) & (out == none), np.nan, out)


def _changes(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places of the rows whose keys differ from those of the row before, the first one included."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        c = t[k].combine_chunks()
        x, y = c.slice(1), c.slice(0, max(0, len(c) - 1))
        other = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
        new[1:] |= other | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def _doubles(c: pa.ChunkedArray) -> np.ndarray:
    """Values as doubles, NaN for null."""
    return pc.fill_null(pc.cast(c, pa.float64()), np.nan).to_numpy()


def _each_group(df: DataFrame, group: Sequence[str], order: str, of: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """Rows made by ``of`` from whole groups in the order of ``order``: a table of several groups, and the places where they begin.

    Groups meet in sorted partitions and a batch holds many of them; a worker holds a batch and the group that goes on behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            starts = _changes(held, group)
            if len(starts) > 1:
                yield from of(held.slice(0, starts[-1]), starts[:-1]).to_batches()
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from of(held, np.zeros(1, dtype=int)).to_batches()

    return df.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(run, schema)


def _by_block(df: DataFrame, keys: Sequence[str], pos: str, value: str, before: int, after: int, size: int, of: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """``keys, pos, value`` and ``out``, made by ``of`` from the values of a block and its halo as one array, a place per position.

    Positions without a row are missing values; the array is no longer than the block and its halo.
    """
    held = skew.with_halo(df.select(*keys, pos, value), keys, pos, before=before, after=after, size=size)
    made = StructType([*(held.schema[c] for c in (*keys, pos, value)), StructField(out, DoubleType())])

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        at, v, own = t[pos].to_numpy(), _doubles(t[value]), ~t["__ghost"].to_numpy().astype(bool)
        y = np.full(len(at), np.nan)
        for a, z in zip(starts, [*starts[1:], len(at)], strict=True):
            place = at[a:z] - at[a]
            x = np.full(place[-1] + 1, np.nan)
            x[place] = v[a:z]
            if own[a:z].any():
                y[a:z] = of(x)[place]
        kept = t.select([*keys, pos, value]).append_column(out, pa.array(y, pa.float64(), mask=np.isnan(y)))
        return kept.filter(pa.array(own))

    return _each_group(held, [*keys, "__blk"], pos, run, made)


def gaussian(df: DataFrame, keys: Sequence[str], pos: str, sigma: float, value: str = "v", out: str = "smooth", size: int = skew.BLOCK):
    """Gaussian smoothing that keeps the total where neighbours are missing: null values and positions without a row alike.

    A block of frames and its halo is one array; each frame is shuffled once and nothing is fanned out.
    """
    w = np.array(gaussian_kernel(sigma))
    return _by_block(df, keys, pos, value, len(w) // 2, len(w) // 2, size, lambda x: smoothed(x, w), out)


def baseline(
    df: DataFrame, fps: float, sigma: float = 10.0, window_sec: float = 60.0, bins: int = 200, size: int = skew.BLOCK
) -> DataFrame:
    """Per trace: baseline (mid-point of the fullest bin of the smoothed running floor) and noise below it.

    One halo serves the smoothing, the running minimum and the running maximum, so each frame is shuffled once.
    """
    win = int(window_sec * fps)
    back, ahead = win // 2, win - win // 2 - 1
    r = len(gaussian_kernel(sigma)) // 2
    w = np.array(gaussian_kernel(sigma))

    def floor_of(x: np.ndarray) -> np.ndarray:
        return running_extreme(running_extreme(smoothed(x, w), back, ahead, np.minimum), back, ahead, np.maximum)

    found = _by_block(df, TRACE, "frame", "v", r + 2 * back, r + 2 * ahead, size, floor_of, "floor")
    floor = found.select(*TRACE, "frame", F.round("floor", 9).alias("floor"))
    # The floor keeps a value over many frames, so its distinct values with counts are few; they alone meet by trace.
    counts, whole = floor.groupBy(*TRACE, "floor").agg(F.count(F.lit(1)).alias("n")), Window.partitionBy(*TRACE)
    h = counts.withColumns({"__a": F.min("floor").over(whole), "__z": F.max("floor").over(whole)})
    width = (F.col("__z") - F.col("__a")) / bins
    bin_ = F.least(F.floor((F.col("floor") - F.col("__a")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    h = h.groupBy(*TRACE, "__a", "__z", F.coalesce(bin_, F.lit(0)).cast("long").alias("bin")).agg(F.sum("n").alias("n"))
    best = h.groupBy(*TRACE, "__a", "__z").agg(F.max_by("bin", F.struct(F.col("n"), (-F.col("bin")).alias("b"))).alias("bin"))
    base = best.select(*TRACE, F.round(F.col("__a") + (F.col("bin") + 0.5) * (F.col("__z") - F.col("__a")) / bins, 9).alias("baseline"))
    below = skew.attach(df, base, TRACE)
    gap = F.when(F.col("v") < F.col("baseline"), F.col("v") - F.col("baseline"))
    noise = below.groupBy(*TRACE, "baseline").agg(
        F.round(F.sqrt(2 * F.sum(gap * gap) / F.nullif(F.count(gap), F.lit(0))), 9).alias("zscore"),
        F.count(F.lit(1)).alias("n_frames"),
    )
    return noise


def transient_rate(df: DataFrame, stats: DataFrame, fps: float, min_sec: float, size: int = skew.BLOCK) -> DataFrame:
    """Transients per minute: runs of the 5-frame mean at or over baseline + 3·noise that last long enough.

    A block counts the runs inside it and gives the lengths of those at its ends, which are added up over the blocks of the trace.
    """
    need = int(round(min_sec * fps))
    edge = stats.select(*TRACE, (F.col("baseline") + 3 * F.col("zscore")).alias("__edge"))
    held = skew.with_halo(skew.attach(df.select(*TRACE, "frame", "v"), edge, TRACE), TRACE, "frame", after=4, size=size)
    made = StructType([*(held.schema[c] for c in (*TRACE, "__blk")), *(StructField(c, LongType()) for c in ("first", "last", "inside", "low"))])

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        given, v, edge = pc.is_valid(t["v"]).to_numpy(), _doubles(t["v"]), _doubles(t["__edge"])
        own, out = ~t["__ghost"].to_numpy().astype(bool), []
        for a, z in zip(starts, [*starts[1:], t.num_rows], strict=True):
            n = int(own[a:z].sum())  # own rows come first
            high = np.zeros(n, dtype=bool)
            if (m := min(n, z - a - 4)) > 0:
                ahead = lambda x: sum(x[a + d : a + d + m] for d in range(5))  # noqa: E731, B023
                c = ahead(given.astype(float))
                mean = ahead(np.where(given, v, 0.0)) / np.maximum(c, 1)
                high[:m] = (c > 0) & ~np.isnan(edge[a : a + m]) & ((mean >= edge[a : a + m]) | np.isnan(mean))
            quiet = np.flatnonzero(~high)
            runs = np.diff(np.concatenate([[-1], quiet, [n]])) - 1  # before, between and behind the quiet rows
            inside = int(((runs[1:-1] > 0) & (runs[1:-1] + 1 >= need)).sum())
            out.append((int(runs[0]), int(runs[-1]) if len(quiet) else 0, inside, len(quiet)) if n else None)
        keep = [k for k, x in enumerate(out) if x]
        cols = [pa.array([out[k][c] for k in keep], pa.int64()) for c in range(4)]
        t = t.select([*TRACE, "__blk"]).take(pa.array(np.asarray(starts, dtype=np.int64)[keep]))
        for name, col in zip(("first", "last", "inside", "low"), cols, strict=True):
            t = t.append_column(name, col)
        return t

    ends = _each_group(held, [*TRACE, "__blk"], "frame", run, made)
    # A run over block borders is named by the last block before it with a quiet frame.
    earlier = Window.partitionBy(*TRACE).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__in", F.max(F.when(F.col("low") > 0, F.col("__blk"))).over(earlier))
    parts = rows_of(("run", "len", "inside"), (F.col("__in"), F.col("first"), F.col("inside")), (F.col("__blk"), F.col("last"), F.lit(0).cast("long")))
    runs = ends.select(*TRACE, F.inline(parts)).groupBy(*TRACE, "run").agg(F.sum("len").alias("len"), F.sum("inside").alias("inside"))
    long = F.count_if((F.col("len") > 0) & (F.col("len") + 1 >= need))
    found = runs.groupBy(*TRACE).agg((F.sum("inside") + long).alias("n_transients"))
    out = skew.key_join(stats, found, TRACE, "left").withColumn("n_transients", F.coalesce("n_transients", F.lit(0)))
    return out.withColumn("rate", F.col("n_transients") / (F.col("n_frames") / (fps * 60)))


def outlier_rows(df: DataFrame, row: Sequence[str], group: Sequence[str], stds: float = 3.0, pct=(1, 99)) -> DataFrame:
    """Keys of rows (trial × trace) that leave mean ± ``stds``·deviation at any position.

    Rows are centred first; mean and deviation per position use the values between two percentiles.
    """
    centre = df.groupBy(*row, *group).agg(F.avg("v").alias("__c"))
    d = df.join(centre, [*row, *group]).withColumn("c", F.round(F.col("v") - F.col("__c"), 9)).drop("__c")
    keys = [*group, "pos"]
    q = skew.exact_percentiles(d, keys, "c", {"__lo": pct[0] / 100, "__hi": pct[1] / 100})
    d = skew.attach(d, q, keys, salt_on=list(row))
    inside = F.when(F.col("c").between(F.col("__lo"), F.col("__hi")), F.col("c"))
    s = d.groupBy(*keys).agg(F.avg(inside).alias("__m"), F.stddev_pop(inside).alias("__d"))
    d = skew.attach(d, s, keys, salt_on=list(row))
    far = F.abs(F.col("c") - F.col("__m")) > stds * F.col("__d") + 1e-12
    return d.groupBy(*row, *group).agg(F.coalesce(F.bool_or(far), F.lit(False)).alias("is_outlier"))


# ---- cutting and joining epochs -------------------------------------------------------------------------------------


def align_epochs(
    epochs: DataFrame,
    trial: Sequence[str],
    epoch: str,
    before: float,
    after: float,
    start_limit: str | None = None,
    end_limit: str | None = None,
) -> DataFrame:
    """Two rows per matching epoch: the stretch of ``before`` seconds up to it and the stretch from it on.

    ``start_limit``/``end_limit`` name epochs of the same trial the stretches may not leave.
    """
    fps = F.col("acq_sampling_rate")
    s, e = F.col("trace_start_idx"), F.col("trace_end_idx")
    first = F.greatest(F.lit(0).cast("long"), s - F.floor(before * fps))
    last = s + F.greatest(F.floor(after * fps) - 1, F.lit(0))
    cur = epochs.filter(F.col("epoch") == epoch)
    for name, col, out in ((start_limit, "trace_start_idx", "__lo"), (end_limit, "trace_end_idx", "__hi")):
        if name:
            lim = epochs.filter(F.col("epoch") == name).select(*trial, F.col(col).alias(out))
            cur = cur.join(lim, list(trial))
    if start_limit:
        first = F.greatest(first, F.col("__lo"))
    if end_limit:
        last = F.least(last, F.col("__hi"))
    label = F.lit(f"-{before:g}s {epoch}")
    parts = rows_of(("epoch", "a", "z"), (label, first, s - 1), (F.lit(epoch), s, last))
    out = cur.withColumns({"org_start_idx": s, "org_end_idx": e, "__p": F.explode(parts)})
    out = out.withColumns({"epoch": F.col("__p.epoch"), "trace_start_idx": F.col("__p.a"), "trace_end_idx": F.col("__p.z")})
    return out.drop("__p", "__lo", "__hi").filter("trace_start_idx <= trace_end_idx")


def concat_epochs(epochs: DataFrame, trial: Sequence[str]) -> DataFrame:
    """Offsets of each epoch inside the trial's concatenation, in ``state_id`` order (a trial holds few epochs)."""
    w = Window.partitionBy(*trial).orderBy("state_id", "trace_start_idx")
    n = F.col("trace_end_idx") - F.col("trace_start_idx") + 1
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    out = epochs.withColumn("range_start", before)
    return out.withColumn("range_end", F.col("range_start") + n - 1)


def concat_frames(ranges: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of concatenated epochs with ``pos``."""
    j = slice_join(ranges, frames)
    return j.withColumn("pos", F.col("range_start") + F.col("frame") - F.col("trace_start_idx"))


def cut_ranges(ranges: DataFrame, trial: Sequence[str], limit: Column, from_start: bool = True, inclusive: bool = True):
    """Trim concatenated ranges to ``limit`` positions (one more when ``inclusive``, as the inclusive end counts)."""
    keep = limit + (1 if inclusive else 0)
    total = ranges.groupBy(*trial).agg((F.max("range_end") + 1).alias("__len"))
    r = ranges.join(total, list(trial))
    lo = F.when(F.lit(from_start), F.lit(0)).otherwise(F.greatest(F.col("__len") - keep, F.lit(0)))
    hi = F.when(F.lit(from_start), F.least(F.col("__len"), keep) - 1).otherwise(F.col("__len") - 1)
    a, z = F.greatest("range_start", lo), F.least("range_end", hi)
    skip = a - F.col("range_start")
    r = r.withColumns(
        {
            "__a": a - lo,
            "__z": z - lo,
            "trace_start_idx": F.col("trace_start_idx") + skip,
            "trace_end_idx": F.col("trace_end_idx") - (F.col("range_end") - z),
        }
    )
    r = r.withColumns({"range_start": F.col("__a"), "range_end": F.col("__z")})
    return r.filter("range_start <= range_end").drop("__a", "__z", "__len")


def extend_positions(cut: DataFrame, key: Sequence[str], length: Column, at_start: bool = False) -> DataFrame:
    """Pad each row's positions with empty values up to ``length``; at the start the others move right."""
    n = cut.groupBy(*key).agg((F.max("pos") + 1).alias("__n"))
    n = n.withColumn("__pad", F.greatest(length - F.col("__n"), F.lit(0)))
    pads = n.filter("__pad > 0").withColumn("__i", F.explode(F.sequence(F.lit(0), (F.col("__pad") - 1).cast("int"))))
    where = F.col("__i") if at_start else F.col("__n") + F.col("__i")
    empty = pads.select(*key, where.cast("long").alias("pos"), F.lit(None).cast("double").alias("v"))
    moved = cut.select(*key, "pos", "v")
    if at_start:
        moved = moved.join(n.select(*key, "__pad"), list(key)).select(*key, (F.col("pos") + F.col("__pad")).alias("pos"), "v")
    return moved.unionByName(empty)


def resize(cut: DataFrame, key: Sequence[str], width: Column) -> DataFrame:
    """Resize each row's positions to ``width`` samples by linear interpolation between pixel centres.

    A sample that needs a missing neighbour is missing.
    """
    n = cut.groupBy(*key).agg((F.max("pos") + 1).alias("__n")).withColumn("__w", width.cast("int"))
    t = n.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("__w") - 1)))
    x = (F.col("pos") + 0.5) * F.col("__n") / F.col("__w") - 0.5
    t = t.withColumn("__x", F.greatest(F.lit(0.0), F.least(x, F.col("__n") - F.lit(1.0))))
    lo = F.floor("__x")
    share = F.col("__x") - lo
    hi = F.least(lo + 1, F.col("__n") - 1)
    two = rows_of(("p", "w"), (lo.cast("long"), 1 - share), (hi.cast("long"), share))
    need = t.withColumn("__t", F.explode(two)).select(*key, F.col("pos").cast("long").alias("to"), F.col("__t.p").alias("pos"), F.col("__t.w").alias("w"))
    got = need.join(cut.select(*key, "pos", "v"), [*key, "pos"])
    lacks = F.count_if((F.col("w") > 0) & F.col("v").isNull()) > 0
    return got.groupBy(*key, "to").agg(F.when(~lacks, F.sum(F.col("w") * F.col("v"))).alias("v")).withColumnRenamed("to", "pos")


# ---- averaging and ordering -----------------------------------------------------------------------------------------


def average(df: DataFrame, keys: Sequence[str], pos: str = "pos", value: str = "v") -> DataFrame:
    """Mean, SEM (missing values left out) and row count per key and position; combines map-side."""
    return df.groupBy(*keys, pos).agg(
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def average_again(df: DataFrame, keys: Sequence[str], pos: str = "pos", mean: str = "mean", sem: str = "sem", n: str = "n_rows") -> DataFrame:
    """Averages of already averaged rows, weighted by how many rows each stands for: ``mean``, ``sem`` and ``n_rows`` as ``average`` gives
    them over the rows underneath (where no value was missing there).

    The squared deviations inside an averaged row come back from its SEM, those between averaged rows from their means. Rows without
    a mean add their count only.
    """
    w = F.when(F.col(mean).isNotNull(), F.col(n))
    centre = df.groupBy(*keys, pos).agg((F.sum(F.col(mean) * w) / F.sum(w)).alias("__m"))
    d = skew.attach(df, centre, [*keys, pos], salts=1)
    inside = F.coalesce(F.pow(F.col(sem), 2) * w * (w - 1), F.lit(0.0))
    squares = F.sum(inside + w * F.pow(F.col(mean) - F.col("__m"), 2))
    return d.groupBy(*keys, pos).agg(
        F.first("__m").alias("mean"), F.when(F.sum(w) > 1, F.sqrt(squares / (F.sum(w) - 1) / F.sum(w))).alias("sem"), F.sum(n).alias("n_rows")
    )


def averaged_name(*columns: str, own: bool = False) -> Column:
    """Name of an averaged row: each column's name and value joined by ``_``, or (``own``) the value of the one column and "Avg. Trace"."""
    if own:
        return F.concat_ws(" ", F.col(columns[0]).cast("string"), F.lit("Avg. Trace"))
    return F.concat_ws("_", *[p for c in columns for p in (F.lit(c), F.col(c).cast("string"))])


def order_by_range(df: DataFrame, row: Sequence[str], ascending: bool = True, value: str = "v") -> DataFrame:
    """Rank traces by max − min; ties by trace id."""
    s = df.groupBy(*row, "trace_id").agg(F.round(F.max(value) - F.min(value), 9).alias("span"))
    key = F.col("span") if ascending else -F.col("span")
    return skew.number_rows(s, row, [key, F.col("trace_id")], skew.value_block(key), "sort_pos")


def order_by_peak(df: DataFrame, row: Sequence[str], pos: str, ascending: bool = True, value: str = "v") -> DataFrame:
    """Rank traces by the first position of their maximum; missing values never peak."""
    peak = F.max_by(F.col(pos), F.struct(F.col(value), (-F.col(pos)).alias("p")))
    s = df.filter(F.col(value).isNotNull()).groupBy(*row, "trace_id").agg(peak.alias("peak"))
    key = F.col("peak") if ascending else -F.col("peak")
    return skew.number_rows(s, row, [key, F.col("trace_id")], skew.position_block(key, 1), "sort_pos")


def trace_summary(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Smallest, largest, deviation and range per trace."""
    return df.groupBy(*keys).agg(
        F.min(value).alias("v_min"),
        F.max(value).alias("v_max"),
        F.stddev_pop(value).alias("v_std"),
        (F.max(value) - F.min(value)).alias("v_range"),
    )


def population_activity(df: DataFrame, row: Sequence[str], pos: str) -> DataFrame:
    """Sum over traces per position, as percent of the row's largest sum."""
    s = df.groupBy(*row, pos).agg(F.sum("v").alias("total"))
    top = s.groupBy(*row).agg(F.max("total").alias("__top"))
    return skew.attach(s, top, row).withColumn("percent", 100 * F.col("total") / F.nullif("__top", F.lit(0.0))).drop("__top")


# ---- regions --------------------------------------------------------------------------------------------------------


def unify_sides(df: DataFrame, weights: DataFrame, name: str = "region") -> DataFrame:
    """Weighted mean of a region's left and right trace; a region seen on one side keeps that side."""
    w = df.withColumn("area_name", F.concat_ws("_", name, "side")).join(weights, "area_name")
    return w.groupBy(name, "frame").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))


def whole_side(df: DataFrame, weights: DataFrame, name: str = "region", whole: str = "Crtx") -> DataFrame:
    """Weighted mean over all regions of a hemisphere, added as one more region."""
    w = df.withColumn("area_name", F.concat_ws("_", name, "side")).join(weights, "area_name")
    total = w.groupBy("side", "frame").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))
    return df.select(name, "side", "frame", "v").unionByName(total.withColumn(name, F.lit(whole)).select(name, "side", "frame", "v"))


# ---- activity -------------------------------------------------------------------------------------------------------


def crossings(epochs: DataFrame, frames: DataFrame, epoch: str, threshold: float, before: float, after: float, quiet: float):
    """Per trace: trials whose activity crosses ``threshold`` around the epoch start, started anew or going on before.

    The larger of the two counts absorbs the smaller.
    """
    fps, s = F.col("acq_sampling_rate"), F.col("trace_start_idx")
    e = epochs.filter(F.col("epoch") == epoch).withColumns(
        {"__b": s - F.ceil(before * fps), "__a": s + F.ceil(after * fps), "__q": s - F.ceil(quiet * fps)}
    )
    e = e.filter("__q > 0").select("ShortName", "TrialNumber", "__b", "__a", "__q")
    j = e.withColumn("frame", F.explode(F.sequence("__q", "__a"))).join(frames, ["ShortName", "frame"])
    near = F.col("frame") >= F.col("__b")
    over = F.col("v") >= threshold
    per = j.groupBy(*TRACE, "TrialNumber").agg(F.bool_or(near & over).alias("hit"), F.bool_or(~near & over).alias("was"))
    c = per.groupBy(*TRACE).agg(
        F.count_if(F.col("hit") & ~F.col("was")).alias("s"),
        F.count_if(F.col("hit") & F.col("was")).alias("w"),
        F.count(F.lit(1)).alias("trials_count"),
    )
    both = F.col("s") + F.col("w")
    started = F.col("s") > F.col("w")
    return c.select(
        *TRACE,
        F.when(started, both).otherwise(0).alias("start_count"),
        F.when(started, 0).otherwise(both).alias("already_started_count"),
        "trials_count",
    )
