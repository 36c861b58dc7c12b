"""Order-dependent building blocks that never put a whole group in one task.

A session, subject or trace may hold a large share of all rows, so no window here is partitioned by such a key alone.
Ordered rows are cut into *blocks* (a range of positions, of time, or of values); work inside a block is an ordinary
window over ``keys + block``, and only one small row per block crosses block borders.  Group statistics come from
``groupBy`` (which combines map-side) and go back to the rows over a salted join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
SALTS = 16


def _cols(names: Iterable[str]) -> list[Column]:
    return [F.col(n) for n in names]


def value_block(v: Column, per_e_fold: int = 1024) -> Column:
    """A block number that never decreases as ``v`` grows; blocks span about 0.1 % of the value."""
    size = F.floor(F.log1p(F.abs(v) * F.lit(float(1 << 20))) * F.lit(float(per_e_fold)))
    return F.when(v < 0, -size).otherwise(size).cast("long")


def position_block(pos: Column, size: int = BLOCK) -> Column:
    return F.floor(pos / F.lit(size)).cast("long")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """``row_number`` per ``keys`` (1-based, BIGINT) without a window over the whole group.

    ``block`` must never decrease along ``order``.  Rows are numbered inside their block and shifted by the row count of
    the earlier blocks.  ``total`` also adds the size of the whole group.
    """
    keys = list(keys)
    blocked = df.withColumn("__b", block)
    sizes = blocked.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    by_block = Window.partitionBy(*keys).orderBy("__b")
    offsets = sizes.select(
        *keys,
        "__b",
        F.coalesce(
            F.sum("__cnt").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
        F.sum("__cnt").over(Window.partitionBy(*keys)).alias("__tot"),
    )
    local = blocked.withColumn("__lrn", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    out = key_join(local, offsets, [*keys, "__b"])
    out = out.withColumn(name, (F.col("__lrn") + F.col("__off")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("__tot").cast("long"))
    return out.drop("__b", "__lrn", "__off", "__tot")


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``; plain equality, so a side already partitioned by the keys is not shuffled again.

    The sides are merged: ``right`` grows with the input, and neither the size that Spark guesses for exploded rows nor the one it
    measures packed tells what a broadcast would take of the driver's memory.
    """
    return left.join(right.hint("merge"), list(keys), how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets NULL keys match and keeps the left side's key columns once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = part if cond is None else cond & part
    return left.join(renamed.hint("merge"), cond, how).drop(*[f"__r_{k}" for k in keys])


# Columns that tell rows of one group apart, best first; two of them are enough to spread a hot group.
ROW_IDS = ("event_id", "frame", "TrialNumber", "trace_id", "v", "bin", "grid", "span", "Name", "SessId")


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str] | None = None,
    how: str = "left",
    null_safe: bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """Give each row the one-row-per-group columns of ``stats``.

    Rows of a hot group are spread over ``salts`` join partitions; the small side is repeated once per salt.  Where groups are
    small by nature (a trial's epochs), ``salts=1`` joins plainly.  Without keys ``stats`` is one row, which is broadcast; groups
    are never, as their number grows with the input.
    """
    keys = list(keys)
    if not keys:
        return df.join(F.broadcast(stats), how=how)
    join = null_safe_join if null_safe else key_join
    if salt_on is None:
        cols = df.columns
        salt_on = [c for c in ROW_IDS if c in cols and c not in keys][:2] or [c for c in cols if c not in keys]
    if salts <= 1 or not salt_on:
        return join(df, stats, keys, how)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    copies = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join(salted, copies, [*keys, "__salt"], how).drop("__salt")


def with_halo(
    df: DataFrame, keys: Sequence[str], pos: str, before: int = 0, after: int = 0, size: int = BLOCK
) -> DataFrame:
    """Cut rows into position blocks and lend each block the rows just outside it.

    Adds ``__blk`` and ``__ghost``; a block then holds every row within ``before`` positions before and ``after`` positions
    behind its own rows.  Run any bounded window over ``keys + __blk`` and drop the ghosts.
    """
    size = max(size, before + 1, after + 1)
    own = position_block(F.col(pos), size)
    inside = F.pmod(F.col(pos), F.lit(size))
    homes = [F.struct(own.alias("b"), F.lit(False).alias("g"))]
    if before:
        homes.append(F.when(inside >= size - before, F.struct((own + 1).alias("b"), F.lit(True).alias("g"))))
    if after:
        homes.append(F.when(inside < after, F.struct((own - 1).alias("b"), F.lit(True).alias("g"))))
    out = df.withColumn("__h", F.explode(F.array_compact(F.array(*homes))))
    return out.withColumn("__blk", F.col("__h.b")).withColumn("__ghost", F.col("__h.g")).drop("__h")


def drop_ghosts(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("__ghost")).drop("__ghost", "__blk")


def block_window(keys: Sequence[str], pos: str) -> Window:
    return Window.partitionBy(*keys, "__blk").orderBy(pos)


def carry_in(df: DataFrame, keys: Sequence[str], how: dict[str, Column], reverse: bool = False) -> DataFrame:
    """Per block, the fold of ``how`` over all earlier (or later) blocks of the same key.

    ``how`` maps an output name to an aggregate (``max``, ``min`` or ``sum`` column) over the block's own rows; the same
    fold is applied across blocks.
    """
    keys = list(keys)
    own = df.filter(~F.col("__ghost")) if "__ghost" in df.columns else df
    per_block = own.groupBy(*keys, "__blk").agg(*[a.alias(n) for n, (_, a) in how.items()])
    order = F.col("__blk").desc() if reverse else F.col("__blk")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    folded = per_block.select(*keys, "__blk", *[fold(F.col(n)).over(w).alias(n) for n, (fold, _) in how.items()])
    # A ghost-only block has no own rows and is dropped later, so a left join loses nothing.
    return key_join(df, folded, [*keys, "__blk"], "left")


def running_sum(df: DataFrame, keys: Sequence[str], pos: Sequence[str], block: Column, sums: dict[str, str]) -> DataFrame:
    """Running total (current row included) of ``sums`` = {output: input} along ``pos`` per ``keys``."""
    keys = list(keys)
    blocked = df.withColumn("__blk", block)
    carried = carry_in(blocked, keys, {f"__in_{o}": (F.sum, F.sum(i)) for o, i in sums.items()})
    w = Window.partitionBy(*keys, "__blk").orderBy(*pos).rowsBetween(Window.unboundedPreceding, 0)
    for out, src in sums.items():
        carried = carried.withColumn(out, F.sum(src).over(w) + F.coalesce(F.col(f"__in_{out}"), F.lit(0)))
    return carried.drop("__blk", *[f"__in_{o}" for o in sums])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, v, c): distinct values with multiplicities, spread by value rather than by group."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def between_ranks(lo: Column, hi: Column, share: Column) -> Column:
    """``lo·(1 − share) + hi·share`` with one rounding of the first product and the sum, as SQL's continuous quantiles have it.

    The last bit matters where values are compared with the result. The rounding error of the product comes from its factors' halves
    (Dekker), that of the sum from its parts (Knuth).
    """
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    a, b, c = lo.cast("double"), 1 - share, hi * share
    p, ah, bh = a * b, half(a), half(b)
    al, bl = a - ah, b - bh
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    shift = s - p
    fused = s + (((p - (s - shift)) + (c - shift)) + lost)
    return F.when(lo == hi, lo.cast("double")).when(F.abs(a) < 1e290, fused).otherwise(p + c)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles per ``keys`` for groups of any size.

    Values are counted, the counts are summed per value block, and only the blocks that hold a wanted rank are ordered.
    Null values are ignored; a group without values is absent.
    """
    keys = list(keys)
    counts = value_counts(df, keys, value).withColumn("__blk", value_block(F.col("v")))
    sizes = counts.groupBy(*keys, "__blk").agg(F.sum("c").alias("__cnt"))
    w = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(
        *keys,
        "__blk",
        "__cnt",
        F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__before"),
        F.sum("__cnt").over(Window.partitionBy(*keys)).alias("__tot"),
    )
    rank = {n: F.lit(p) * (F.col("__tot") - 1) for n, p in probs.items()}
    wanted = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(side).alias("side"), fn(rank[n]).cast("long").alias("r"))
            for n in probs
            for side, fn in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    here = F.filter(
        wanted, lambda x: (x["r"] >= F.col("__before")) & (x["r"] < F.col("__before") + F.col("__cnt"))
    )
    targets = placed.select(*keys, "__blk", "__before", "__tot", here.alias("__ws")).filter(F.size("__ws") > 0)
    hit = key_join(counts, targets, [*keys, "__blk"])
    inner = Window.partitionBy(*keys, "__blk").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        hit.withColumn("__end", F.sum("c").over(inner) + F.col("__before"))
        .withColumn("__w", F.explode("__ws"))
        .filter((F.col("__w.r") < F.col("__end")) & (F.col("__w.r") >= F.col("__end") - F.col("c")))
    )
    aggs = []
    for n, p in probs.items():
        lo = F.max(F.when((F.col("__w.name") == n) & (F.col("__w.side") == "lo"), F.col("v")))
        hi = F.max(F.when((F.col("__w.name") == n) & (F.col("__w.side") == "hi"), F.col("v")))
        h = F.lit(p) * (F.max("__tot") - 1)
        aggs += [lo.alias(f"__lo_{n}"), hi.alias(f"__hi_{n}"), (h - F.floor(h)).alias(f"__h_{n}")]
    group = [F.col(k) for k in keys] if keys else []
    found = picked.groupBy(*group).agg(*aggs)
    return found.select(*group, *[between_ranks(F.col(f"__lo_{n}"), F.col(f"__hi_{n}"), F.col(f"__h_{n}")).alias(n) for n in probs])


def mid_ranks(counts: DataFrame, keys: Sequence[str], value: str = "v", count: str = "c") -> DataFrame:
    """Add ``mid_rank`` (average rank of ties) to a table of distinct values with multiplicities."""
    ranked = running_sum(counts, keys, [value], value_block(F.col(value)), {"__cum": count})
    return ranked.withColumn("mid_rank", F.col("__cum") - (F.col(count) - 1) / F.lit(2.0)).drop("__cum")


def equal_parts(rn: Column, total: Column, parts: int, cursor: Column | int = 0) -> Column:
    """Part number 1..``parts`` of a 1-based row number; spare rows go to parts ``cursor, cursor+1, …`` (wrapping).

    NULL when the group is smaller than ``parts``.
    """
    base = F.floor(total / parts)
    spare = F.pmod(total, F.lit(parts))
    cursor = cursor if isinstance(cursor, Column) else F.lit(cursor)
    part = F.lit(1)
    end = F.lit(0)
    for p in range(parts - 1):
        gets_spare = F.pmod(F.lit(p) - cursor, F.lit(parts)) < spare
        end = end + base + F.when(gets_spare, 1).otherwise(0)
        part = part + F.when(rn > end, 1).otherwise(0)
    return F.when(total >= parts, part).cast("long")
