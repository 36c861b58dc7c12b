"""Periodic runs of words, by seed and extend along diagonals.

A run of period q and length L >= max(least, e * q) equals itself shifted by q words over at least max(least - q, (e - 1) * q) words.
Lags are put into classes lo..hi with hi = (e - 1) * lo; every run of a class holds an occurrence pair of a k-gram with k = (e - 1) * lo
words at its lag. As k is no less than the lag, the next occurrence of the k-gram in the text lies exactly one smallest period on, so
the index enumerates neighbouring occurrences only: as many as there are words, however often a word repeats. A table of the furthest
place covered at each lag suppresses seeds of a run that has been extended already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Grams:
    """Exact ranks of k-grams: those of 2, 4, 8 ... words by doubling, any other from two that overlap."""

    def __init__(self, ids: np.ndarray):
        self.n, self.levels = len(ids), [ids.astype(np.int64)]

    def codes(self, k: int) -> np.ndarray:
        """A number for the k-gram at each place, equal for equal k-grams."""
        m = k.bit_length() - 1
        while len(self.levels) <= m:
            h, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.unique(self.paired(last, h, self.n - 2 * h + 1), return_inverse=True)[1])
        rest = k - (1 << m)
        return self.paired(self.levels[m], rest, self.n - k + 1) if rest else self.levels[m]

    def paired(self, ranks: np.ndarray, shift: int, n: int) -> np.ndarray:
        return ranks[:n] * np.int64(self.n + 1) + ranks[shift : shift + n]


def lag_classes(n: int, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """``lo, hi, k`` of the classes of lags that a run of ``n`` words or fewer can have."""
    lo, hi, k = 1, 1, max(least - 1, exponent - 1)
    while max(least, exponent * lo) <= n:
        yield lo, hi, k
        lo = hi + 1
        hi = k = (exponent - 1) * lo


def same_until(a: np.ndarray, b: np.ndarray) -> int:
    """How many first items of both are equal, looked up in growing pieces."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        m = min(size, n - at)
        differ = a[at : at + m] != b[at : at + m]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + m, size * 2
    return n


def runs_of(ids: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence, by start, then period; ``exponent`` of 3 or more."""
    n, grams, found = len(ids), Grams(ids), []
    for lo, hi, k in lag_classes(n, least, exponent):
        codes = grams.codes(k)
        order = np.argsort(codes, kind="stable")
        ranked = codes[order]
        again = np.flatnonzero(ranked[1:] == ranked[:-1])
        if not len(again):
            break  # no longer k-gram occurs twice either
        at, lag = order[again], order[again + 1] - order[again]
        mine = (lag >= lo) & (lag <= hi)
        at, lag = at[mine], lag[mine]
        by_lag = np.lexsort((at, lag))
        at, lag = at[by_lag], lag[by_lag]
        borders = [*np.flatnonzero(np.diff(lag, prepend=-1)), len(lag)]
        for a, b in pairwise(borders):
            q, seeds, covered, next_seed = int(lag[a]), at[a:b], 0, 0
            while next_seed < len(seeds):
                i = int(seeds[next_seed])
                start = i - same_until(ids[covered:i][::-1], ids[covered + q : i + q][::-1])
                covered = i + k + same_until(ids[i + k : n - q], ids[i + k + q :])  # of this lag, furthest
                if covered - start + q >= max(least, exponent * q):
                    found.append((start, covered - start + q, q))
                next_seed = int(np.searchsorted(seeds, covered))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that some run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def find_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_words``, ``runs`` (array of ``start, length, period``, by start, then period) and
    ``collapsed``, the words outside of repeated periods joined by one space.

    A run is a stretch of consecutive words with smallest period q and at least max(``least``, ``exponent`` * q) words that no
    neighbouring word extends. Words are between ASCII white space. Null and empty texts have no words, no runs and an empty
    ``collapsed``; repeated rows and null ids each keep their row; an empty table gives an empty table. Each text is worked on where
    it is read, in memory proportional to its words; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for first in range(0, batch.num_rows, 256):
                sizes, runs, collapsed = [], [], []
                for t in texts.slice(first, 256).to_pylist():
                    found = (t or b"").split()
                    known: dict[bytes, int] = {}
                    codes = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
                    got = runs_of(codes, least, exponent)
                    sizes.append(len(found))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                    collapsed.append(b" ".join(collapsed_words(found, got)))
                cols = [ids.slice(first, 256), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, the first one of equals; null if there is none."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    """``start,length,period`` of every run, each with a line feed."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
