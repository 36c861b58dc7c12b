"""All pairs of texts whose word-shingle sets have a Jaccard similarity of at least a threshold, as links of components.

Shingles are put in one order, those that a sample of texts shows to be common last. Two sets of the wanted similarity share one of
the first ``n - ceil(threshold * n) + 1`` shingles of each (prefix filter), in any order, so no pair is lost. The places of the first
shared shingle and both sizes bound the overlap, and the XOR of two parity bitmaps, a bit per shingle, bounds the difference from below;
only pairs that both bounds leave open have their whole sets compared. Pairs proposed by fingerprints are compared first, then texts that
share a shingle with one text of their group only; then every pair that is not yet linked is compared: in small groups by a join, in
crowds inside units of bounded size, which hold whole sets and return a spanning forest. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import small, stored, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: Column) -> Column:
    """A-Z in lower case, one space between words; empty for null."""
    return F.array_join(words(F.translate(text, UPPER, LOWER)), " ")


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Distinct hashed shingles in ascending order; a text under ``k`` words is one shingle, one without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.int64)
    h = np.array([known[w] for w in found], dtype=np.uint64)
    width = min(k, len(h))
    n = len(h) - width + 1
    x = np.full(n, width, dtype=np.uint64)
    for d in range(width):
        x += h[d : d + n] + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unique(x.view(np.int64))


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows, which bounds what a worker holds."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def sets_of(nodes: DataFrame, k: int) -> DataFrame:
    """``node`` and its ``set`` of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in in_parts(batches):
            made = [shingles(t, k, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.list_(pa.int64()))], names=["node", "set"])

    return nodes.select("node", "text").mapInArrow(run, "node long, set array<long>")


def prefix(own: np.ndarray, threshold: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, one of which any set of the wanted similarity shares."""
    n = len(own)
    m = min(n, n - math.ceil(threshold * n - 1e-9) + 1)
    if m == n or not len(common):
        return own[:m]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    rank = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))[:m]]


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of so many bits as there are shingles, or the next power of two (64 at least)."""
    m = 64
    while m < len(own):
        m *= 2
    odd = np.bincount(own & (m - 1), minlength=m).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def folded(bits: np.ndarray, longs: int = 8) -> np.ndarray:
    """A bitmap of at most so many longs: halves laid over each other."""
    while len(bits) > longs:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def least_difference(a: Column, b: Column) -> Column:
    """The least size of the difference of two sets by their bitmaps; of the longer one the halves are laid over each other."""
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def half(x: Column) -> Column:
        n = F.shiftright(F.size(x), 1)
        return xor(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n))

    as_long = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    one_bits = lambda x: F.aggregate(x, F.lit(0), lambda s, p: s + F.bit_count(p).cast("int"))
    return one_bits(xor(as_long(a, b), as_long(b, a)))


def keyed(nodes: DataFrame, k: int, threshold: float, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``key, node, n, pos``: the prefix of every set, its size, and the place in the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in in_parts(batches):
            sets = [shingles(t, k, known) for t in batch.column("text").to_pylist()]
            if made := [prefix(s, threshold, common, counts) for s in sets]:
                size = [len(p) for p in made]
                at = np.concatenate([np.arange(n) for n in size])
                cols = [np.concatenate(made), np.repeat(batch.column("node").to_numpy(), size), np.repeat([len(s) for s in sets], size), at]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["key", "node", "n", "pos"])

    return nodes.select("node", "text").mapInArrow(run, "key long, node long, n int, pos int")


def bitmaps(nodes: DataFrame, k: int) -> DataFrame:
    """``node, n, bits, sketch``: size, bitmap and folded bitmap of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in in_parts(batches):
            sets = [shingles(t, k, known) for t in batch.column("text").to_pylist()]
            bits = [bitmap(s) for s in sets]
            cols = [pa.array([len(s) for s in sets], pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (bits, [folded(b) for b in bits]))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *cols], names=["node", "n", "bits", "sketch"])

    return nodes.select("node", "text").mapInArrow(run, "node long, n int, bits array<long>, sketch array<long>")


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every set of ``xs`` with every one of ``ys``, by products of 0/1 blocks of ``width`` shingles."""
    out = np.zeros((len(xs), len(ys)), dtype=np.float32)
    flat = [np.concatenate(s) if s else np.zeros(0, dtype=np.int64) for s in (xs, ys)]
    both = np.intersect1d(*flat)
    if not len(both):
        return out
    marks = []
    for sets, values in zip((xs, ys), flat, strict=True):
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        row, known = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), both[at] == values
        row, at = row[known], at[known]
        order = np.argsort(at, kind="stable")
        marks.append((len(sets), row[order], at[order]))
    for first in range(0, len(both), width):
        blocks = []
        for n, row, at in marks:
            a, b = np.searchsorted(at, (first, first + width))
            block = np.zeros((n, width), dtype=np.float32)
            block[row[a:b], at[a:b] - first] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of ``near`` that give the same components of rows and columns as all of its pairs, fewer than both together."""
    open_x, open_y, out = near.any(axis=1), near.any(axis=0), []
    for start in np.flatnonzero(open_x):
        if not open_x[start]:
            continue
        open_x[start], front = False, np.array([start])
        while len(front):
            reach = np.flatnonzero(near[front].any(axis=0) & open_y)
            open_y[reach] = False
            out += zip(front[near[np.ix_(front, reach)].argmax(axis=0)], reach, strict=True) if len(reach) else []
            front = np.flatnonzero(near[:, reach].any(axis=1) & open_x)
            open_x[front] = False
            out += zip(front, reach[near[np.ix_(front, reach)].argmax(axis=1)], strict=True) if len(front) else []
    return [(int(x), int(y)) for x, y in out]


def in_crowds(rows: DataFrame, sets: DataFrame, threshold: float, block: int = 512, weight: int = 200_000) -> DataFrame:
    """Links ``a``, ``b`` of the wanted similarity that join all rows of a key (``key, node, n, root, main``, the place ``pos`` of the key)
    whose sets (``node``, ``set``) reach ``threshold`` and whose roots differ.

    A key's rows meet by classes of sizes a tenth apart: rows outside of its main root come to every class that their size and place
    leave open, where both sides are dealt to units of about ``block`` rows and ``weight`` shingles a side. A unit compares whole sets and
    returns a spanning forest of its pairs, so rows grow with the texts and not with their pairs.
    """
    size_class = lambda n: F.floor(F.log(n.cast("double")) * 10).cast("int")
    n, pos = F.col("n"), F.col("pos")
    low = F.ceil(n * threshold - 1e-6)
    high = F.floor(F.least((n - pos) * ((1 + threshold) / threshold) - n, n / threshold) + 1e-6)
    ours = rows.where((F.col("root") != F.col("main")) & (high >= low)).withColumn("c", F.explode(F.sequence(size_class(low), size_class(high))))
    ours, theirs = ours.drop("main"), rows.withColumn("c", size_class(n)).drop("main")

    def units(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("key", "c").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / weight)).cast("int").alias(name))

    cells = stored(units(ours, "kx").join(units(theirs, "ky"), ["key", "c"]), "cells")
    place = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    ours = ours.join(small(cells), ["key", "c"]).select("*", F.lit(True).alias("ours"), place(F.col("kx")).alias("i"), every("ky").alias("j"))
    theirs = theirs.join(small(cells), ["key", "c"]).select("*", F.lit(False).alias("ours"), every("kx").alias("i"), place(F.col("ky")).alias("j"))

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["ours"]], pdf[~pdf["ours"]]
        nx, ny = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
        room = np.minimum(nx - x["pos"].to_numpy()[:, None], ny - y["pos"].to_numpy()[None, :])
        may = (x["root"].to_numpy()[:, None] != y["root"].to_numpy()[None, :]) & (room >= threshold / (1 + threshold) * (nx + ny) - 1e-9)
        px, py = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        common = shared_counts(list(x["set"].iloc[px]), list(y["set"].iloc[py])).astype(np.float64)
        near = may[np.ix_(px, py)] & (common >= threshold * (nx[px] + ny[:, py] - common) - 1e-9)
        a, b = x["node"].to_numpy()[px], y["node"].to_numpy()[py]
        return pd.DataFrame([(a[i], b[j]) for i, j in spanning(near)], columns=["a", "b"], dtype="int64")

    return ours.unionByName(theirs).join(sets, "node").groupBy("key", "c", "i", "j").applyInPandas(unit, "a long, b long")


def links(nodes: DataFrame, proposed: DataFrame, roots, shingle: int = 5, threshold: float = 0.8, sample_size: int = 10_000, stars: int = 2, dense: int = 64, block: int = 512) -> DataFrame:
    """Links ``a``, ``b`` between rows of ``nodes`` (``node``, ``text``; texts differ) that give the components of all pairs whose
    similarity reaches ``threshold``; every link is such a pair. ``roots`` finds the components of links.

    The pairs of ``proposed`` (``a``, ``b``) are verified first, and those that reach the threshold are links; the prefix filter then
    compares only texts that these leave in different components. Keys shared by ``dense`` texts or more are crowds, whose texts are
    compared in units of ``block`` by ``block`` (``in_crowds``).

    The order of shingles is fitted on about ``sample_size`` texts, or a quarter of them if that is more, so that the groups of a key do not
    grow with the input; any order finds every pair. Texts without words have no links; an empty table gives no links.
    """
    rate = min(1.0, max(sample_size / max(1, nodes.count()), 0.25))
    drawn = nodes.where(F.shiftrightunsigned(F.xxhash64(F.lit(1), "node"), 11) * F.lit(2.0**-53) < rate)
    often = sets_of(drawn, shingle).select(F.explode("set").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c >= 3")
    got = often.orderBy(F.desc("c"), "key").limit(2_000_000).toArrow().sort_by("key")
    common, counts = (got[c].to_numpy().astype(np.int64) for c in ("key", "c"))
    group = Window.partitionBy("key")
    shared = stored(keyed(nodes, shingle, threshold, common, counts).withColumn("k", F.count("*").over(group)).where("k > 1"), "shared")
    # The text that all of a crowd are edited from has most of its keys in crowds: edits are rare, and come first in a prefix.
    central = small(stored(shared.where(F.col("k") >= dense).groupBy("node").agg(F.sum("k").alias("w")), "central"))
    held = stored(bitmaps(nodes, shingle), "bitmaps")

    def most_apart(n: Column, n2: Column) -> Column:
        """The greatest difference of two sets of the wanted similarity."""
        return F.lit((1 - threshold) / (1 + threshold)) * (n + n2) + 1e-9

    def may(n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
        """Whether two sets whose first shared shingle has these places can have the wanted similarity."""
        need = F.lit(threshold / (1 + threshold)) * (n + n2) - 1e-9
        return (F.least(n, n2) >= F.greatest(n, n2) * threshold - 1e-9) & (F.least(n - pos, n2 - pos2) >= need)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
        of = lambda c: held.selectExpr(f"node as {c}", f"n as n{c}", f"bits as bits{c}")
        most = most_apart(F.col("na"), F.col("nb"))
        # A pair of one similarity has bitmaps of lengths that differ by a factor of two at most if the threshold is over a half.
        alike = F.greatest(F.size("bitsa"), F.size("bitsb")) > 2 * F.least(F.size("bitsa"), F.size("bitsb"))
        open_pairs = pairs.join(of("a"), "a").join(of("b"), "b").where(alike | (least_difference(F.col("bitsa"), F.col("bitsb")) <= most))
        open_pairs = stored(open_pairs.select("a", "b"), "open-pairs")
        asked = stored(open_pairs.select(F.col("a").alias("node")).unionByName(open_pairs.select(F.col("b").alias("node"))).distinct(), "asked")
        sets = stored(sets_of(nodes.join(small(asked), "node", "left_semi"), shingle), "sets")
        both = open_pairs.join(sets.selectExpr("node as a", "`set` as sa"), "a").join(sets.selectExpr("node as b", "`set` as sb"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(common >= threshold * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")

    def placed(edges: DataFrame) -> DataFrame:
        """``shared`` with ``root``, where a key has more than one."""
        found = stored(roots(edges), "roots")
        rows = shared.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rows.withColumns({"__a": F.min("root").over(group), "__b": F.max("root").over(group)}).where("__a < __b")
        return stored(mixed.drop("__a", "__b"), "mixed")

    edges = stored(verified(proposed), "proposed")
    for turn in range(stars):
        rows = placed(edges)
        rows = rows.join(central, "node", "left") if not turn else rows.withColumn("w", F.lit(None).cast("long"))
        first = F.min(F.struct((-F.coalesce("w", F.lit(0))).alias("w"), F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n", "pos", "root"))
        centre = rows.groupBy("key").agg(first.alias("c"))
        pairs = rows.join(centre, "key").where((F.col("root") != F.col("c.root")) & may(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos")))
        new = stored(verified(pairs.select(F.col("node").alias("a"), F.col("c.node").alias("b"))), "near")
        edges = edges.unionByName(new)
    rows = placed(edges)
    rows = stored(rows.join(rows.groupBy("key").agg(F.mode("root", True).alias("main")), "key"), "open")
    crowds = rows.where(F.col("k") >= dense)
    whole = sets_of(nodes.join(small(stored(crowds.select("node").distinct(), "crowded")), "node", "left_semi"), shingle)
    found = stored(in_crowds(crowds, stored(whole, "crowd-sets"), threshold, block), "crowd-links")
    y = rows.where(F.col("k") < dense).join(held.select("node", "sketch"), "node")
    x, y = y.where("root <> main").alias("x"), y.drop("main").alias("y")  # one of two roots is not the main one
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("x.main")) | (F.col("x.node") < F.col("y.node")))
    fits = may(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    # Sizes that may match have sketches whose lengths differ by a factor of two at most; texts that the sketches tell apart make no row.
    near = F.when(fits, least_difference(F.col("x.sketch"), F.col("y.sketch")) <= most_apart(F.col("x.n"), F.col("y.n")))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & near)
    last = verified(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return edges.unionByName(found).unionByName(last)
