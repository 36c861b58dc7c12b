"""Uniform shuffle with exact shard sizes through a hypergeometric communication matrix.

Rows are numbered in blocks of bounded size. How many rows of each block go to each shard is drawn once, from the multivariate
hypergeometric law, so that the shard sizes are met exactly; a block permutes its rows and deals them out by these counts, the
rows are exchanged, and each shard permutes what it got. The result is a uniform random permutation cut into equal parts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import stored, without

#: Rows of a block, at most: 16 low bits of the row number.
BLOCK_BITS = 16
#: NumPy draws from populations under this size.
NUMPY_LIMIT = 900_000_000


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw for any population: inversion over the 12 standard deviations on either side of the mode."""
    if good == 0 or n == 0:
        return 0
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(max(1.0, n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)))
    a, b = max(low, mode - int(12 * sd) - 20), min(high, mode + int(12 * sd) + 20)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(p - p.max())
    return a + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))


def allot(sizes: np.ndarray, shards: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Matrix of counts with the given row sums (``sizes``) and column sums (``shards``), as a random permutation gives them."""
    sizes, left = np.asarray(sizes, dtype=np.int64), np.array(shards, dtype=np.int64)
    out = np.zeros((len(sizes), len(left)), dtype=np.int64)
    if sizes.sum() >= NUMPY_LIMIT and len(sizes) > 1:
        half = len(sizes) // 2
        n, rest, first = int(sizes[:half].sum()), int(left.sum()), np.zeros_like(left)
        for s, size in enumerate(left):
            rest -= int(size)
            first[s] = large_hypergeometric(rng, int(size), rest, n)
            n -= int(first[s])
        out[:half], out[half:] = allot(sizes[:half], first, rng), allot(sizes[half:], left - first, rng)
        return out
    for i, n in enumerate(sizes[:-1]):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    if len(sizes):
        out[-1] = left
    return out


def shard_sizes(n: int, n_shards: int) -> np.ndarray:
    return np.array([n // n_shards + (s < n % n_shards) for s in range(n_shards)], dtype=np.int64)


def communication_matrix(sizes: DataFrame, n_shards: int, seed: int) -> tuple[DataFrame, int]:
    """For each block (``block``, ``n``) the running counts ``cuts`` of rows for shards 0, 1, ...; and the number of all rows.

    Drawn in two levels, so that no task or driver sees all blocks: the driver draws for about the square root of their number
    of groups, and each group draws for its own blocks.
    """
    total, n_blocks = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    n_groups = max(1, math.isqrt(n_blocks))
    grouped = sizes.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n_groups)))
    sums = dict(grouped.groupBy("g").agg(F.sum("n")).collect())
    order = sorted(sums)
    top = allot(np.array([sums[g] for g in order], dtype=np.int64), shard_sizes(total, n_shards), np.random.default_rng([seed, 0]))
    share = dict(zip(order, top, strict=True))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, g = pdf.sort_values("block"), int(pdf["g"].iloc[0])
        counts = allot(pdf["n"].to_numpy(), share[g], np.random.default_rng([seed, 1, g]))
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "n": pdf["n"].to_numpy(), "cuts": list(counts.cumsum(axis=1))})

    return grouped.groupBy("g").applyInPandas(draw, "block long, n long, cuts array<long>"), total


def permuted(seed: int):
    """Place of row ``pos`` after the block's own permutation of ``n`` rows."""

    @F.pandas_udf("long")
    def place(block: pd.Series, pos: pd.Series, n: pd.Series) -> pd.Series:
        out = np.zeros(len(block), dtype=np.int64)
        ids, at, counts = block.to_numpy(), pos.to_numpy(), n.to_numpy()
        for b in np.unique(ids):
            mine = ids == b
            rng = np.random.default_rng([seed, 2, int(b)])
            out[mine] = rng.permutation(int(counts[mine][0]))[at[mine]]
        return pd.Series(out)

    return place


def shard_rows(df: DataFrame, n_shards: int, seed: int = 1, bucket_rows: int = 2048) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (0, 1, ... in each shard, in random order).

    Shard sizes differ by one at most. No column is looked at, so nulls, equal rows, hot keys and long texts play no part; an
    empty table gives an empty table. Columns of ``df`` named ``shard`` or ``slot`` are replaced. The draw is fixed by ``seed``
    and the order in which Spark reads ``df``, which is written down first: later tasks can be run again at any time.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = without(df, "shard", "slot", "__block", "__pos", "__n", "__cuts", "__key", "__bucket", "__nth", "__before")
    numbered = rows.withColumn("__pos", F.monotonically_increasing_id())
    numbered = numbered.withColumns(
        {"__block": F.shiftrightunsigned("__pos", BLOCK_BITS), "__pos": F.col("__pos").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))}
    )
    base = stored(numbered, "numbered")
    matrix, total = communication_matrix(base.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n")), n_shards, seed)
    matrix = stored(matrix, "matrix").select(F.col("block").alias("__block"), F.col("n").alias("__n"), F.col("cuts").alias("__cuts"))
    n_buckets = max(1, -(-total // (n_shards * bucket_rows)))
    key = F.xxhash64(F.lit(seed), "__block", "__pos")
    dealt = base.join(matrix, "__block").withColumn("__at", permuted(seed)("__block", "__pos", "__n"))
    dealt = dealt.withColumn("shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__at"))))
    dealt = dealt.withColumn("__key", key).withColumn(
        "__bucket", F.floor(F.shiftrightunsigned("__key", 11) * F.lit(2.0**-53) * F.lit(n_buckets)).cast("long")
    )
    buckets = dealt.groupBy("shard", "__bucket").agg(F.count("*").alias("__nth"))
    buckets = buckets.selectExpr(
        "shard", "__bucket", "sum(__nth) over (partition by shard order by __bucket) - __nth as __before"
    )
    ranked = dealt.selectExpr(
        *[f"`{c}`" for c in rows.columns], "shard", "__bucket",
        "row_number() over (partition by shard, __bucket order by __key, __block, __pos) - 1 as __nth",
    )
    out = ranked.join(buckets, ["shard", "__bucket"]).withColumn("slot", F.col("__before") + F.col("__nth"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", "slot")
