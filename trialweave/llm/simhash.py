"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are put into a few partitions, correlated bits together. If thresholds t_i of the partitions add up so that
sum(t_i + 1) = limit + 1, two fingerprints within ``limit`` bits are within t_i bits in some partition i. For every fingerprint the
thresholds are allocated by dynamic programming on the estimated candidates and probes of each partition; its probes are joined to
the partition values of all fingerprints and each meeting is verified on all bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import jaccard
from trialweave.llm.common import small, stored, without

BITS = 64
SEED = 42


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit k is 1 if it is 1 in over half of the hashed shingles; A-Z in lower case, words between ASCII white space; 0 for no word."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n, ones = max(1, len(found) - shingle + 1), np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        hashed = [xxhash.xxh64_intdigest(b" ".join(found[i : i + shingle]), SEED) for i in range(a, min(n, a + (1 << 16)))]
        bits = np.unpackbits(np.array(hashed, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text, shingle: int = 4):
    """Fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return run(text)


def correlated_partitions(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0 to 63 in ``parts`` groups of (nearly) equal width: each starts with the most correlated free pair and takes the free
    bit with the highest mean correlation to it."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, BITS))
    norm = np.sqrt((centred**2).sum(axis=0))
    norm[norm == 0] = 1
    link = np.abs(centred.T @ centred / np.outer(norm, norm))
    np.fill_diagonal(link, -1)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        if k == parts - 1:
            out.append(sorted(free))
            break
        within = link[np.ix_(free, free)]
        i, j = np.unravel_index(int(within.argmax()), within.shape)
        group = [free[i], free[j]]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(rest[int(link[np.ix_(rest, group)].mean(axis=1).argmax())])
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out


def parts_of(prints: np.ndarray, partitions: list[list[int]]) -> np.ndarray:
    """Value of every partition (columns) of every fingerprint (rows)."""
    raw = prints.astype(np.int64).view(np.uint64)
    out = np.zeros((len(raw), len(partitions)), dtype=np.int64)
    for p, bits in enumerate(partitions):
        for k, b in enumerate(bits):
            out[:, p] |= (((raw >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).astype(np.int64)
    return out


def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` ones, by number of ones."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.int64)


def allocate(values: np.ndarray, known: np.ndarray, n: int, widths: list[int], limit: int, most: int, probe_cost: float) -> np.ndarray:
    """Thresholds (-1: not probed) of the partitions for each fingerprint, of least cost.

    Candidates of a partition at a threshold are estimated from the fingerprints of the sample that are as near (``known``, scaled
    to ``n``) plus what uniform bits would give; a probe costs ``probe_cost`` candidates.
    """
    rows, parts = values.shape
    best = np.full((rows, limit + 2), np.inf)
    best[:, 0] = 0
    picks = []
    for p in range(parts):
        near = np.bitwise_count(values[:, p, None] ^ known[None, :, p]) if len(known) else np.zeros((rows, 0))
        cost = [np.zeros(rows)]
        for t in range(most + 1):
            ball = sum(math.comb(widths[p], r) for r in range(t + 1))
            cost.append((near <= t).sum(axis=1) * (n / max(1, len(known))) + n * ball / 2.0 ** widths[p] + probe_cost * ball)
        table, pick = np.full((rows, limit + 2), np.inf), np.zeros((rows, limit + 2), dtype=np.int8)
        for total in range(limit + 2):
            for spent in range(min(total, most + 1) + 1):
                c = best[:, total - spent] + cost[spent]
                better = c < table[:, total]
                table[better, total], pick[better, total] = c[better], spent
        best = table
        picks.append(pick)
    out, left = np.zeros((rows, parts), dtype=np.int64), np.full(rows, limit + 1)
    for p in reversed(range(parts)):
        out[:, p] = picks[p][np.arange(rows), left]
        left = left - out[:, p]
    return out - 1


def signatures(prints: DataFrame, partitions: list[list[int]], known: np.ndarray, n: int, limit: int, most: int, probe_cost: float) -> DataFrame:
    """``key`` (partition and value), ``fp``, ``own`` (the fingerprint's own value) and ``probe`` for all index and probe rows."""
    widths = [len(p) for p in partitions]
    sample = parts_of(known, partitions)
    around = [[masks(w, t) for t in range(most + 1)] for w in widths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False)
            for a in range(0, len(whole), 2048):
                fp = whole[a : a + 2048]
                values = parts_of(fp, partitions)
                radius = allocate(values, sample, n, widths, limit, most, probe_cost)
                keys, prints_, own, probe = [], [], [], []
                for p in range(len(partitions)):
                    for t in range(-1, most + 1):
                        mine = radius[:, p] == t
                        if not mine.any():
                            continue
                        flips = around[p][max(t, 0)]
                        keys.append(((p << 40) | (values[mine, p, None] ^ flips[None, :])).ravel())
                        prints_.append(np.repeat(fp[mine], len(flips)))
                        own.append(np.tile(flips == 0, int(mine.sum())))
                        probe.append(np.full(len(keys[-1]), t >= 0))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, prints_, own, probe)], names=["key", "fp", "own", "probe"])

    return prints.select("fp").mapInArrow(run, "key long, fp long, own boolean, probe boolean")


def forest(probers: np.ndarray, members: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A link from each linked fingerprint to the first one of its component, over the pairs prober-member within ``limit``."""
    near = np.bitwise_count((probers[:, None] ^ members[None, :]).view(np.uint64)) <= limit  # of signed numbers the absolute value counts
    near &= probers[:, None] != members[None, :]
    open_p, open_m, out = near.any(axis=1), near.any(axis=0), []
    for start in np.flatnonzero(open_p):
        if not open_p[start]:
            continue
        open_p[start], front = False, np.array([start])
        while len(front):
            reach = np.flatnonzero(near[front].any(axis=0) & open_m)
            open_m[reach] = False
            out += [(probers[start], m) for m in members[reach]]
            front = np.flatnonzero(near[:, reach].any(axis=1) & open_p) if len(reach) else reach
            open_p[front] = False
            out += [(probers[start], q) for q in probers[front]]
    return [(int(a), int(b)) for a, b in out if a != b]


def links(prints: DataFrame, limit: int = 4, parts: int = 3, most: int = 2, dense: int = 16, block: int = 2048, sample_size: int = 1024, probe_cost: float = 2.0) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints (column ``fp``, distinct) that give the components of all pairs within
    ``limit`` bits.

    The partitions and the allocation are fitted on ``sample_size`` fingerprints; any fit finds every pair. Where ``dense`` or more
    fingerprints share a partition value, not all their pairs are returned: that value's members and probes are dealt to units of
    ``block`` by ``block``, and each unit returns a spanning forest.
    """
    n = prints.count()
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("fp")).limit(sample_size).collect()], dtype=np.int64)
    rows = stored(signatures(prints, correlated_partitions(sample, parts), sample, n, limit, most, probe_cost), "signatures")
    sizes = rows.groupBy("key").agg(F.sum(F.col("own").cast("int")).alias("n"), F.sum(F.col("probe").cast("int")).alias("p"))
    hot = stored(sizes.where(F.col("n") >= dense), "dense")
    light = rows.join(hot.select("key"), "key", "left_anti")
    q, m = light.where("probe").select("key", F.col("fp").alias("a")), light.where("own").select("key", F.col("fp").alias("b"))
    pairs = q.join(m, (q["key"] == m["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit)).select("a", "b")
    crowd = rows.join(hot, "key")
    n_m, n_p = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("p") / block).cast("int")
    place = lambda k: F.pmod(F.xxhash64("fp"), k).cast("int")
    every = lambda k: F.sequence(F.lit(0), k - 1)
    members = crowd.where("own").select("key", "fp", F.lit(True).alias("own"), place(n_m).alias("i"), F.explode(every(n_p)).alias("j"))
    probers = crowd.where("probe").select("key", "fp", F.lit(False).alias("own"), F.explode(every(n_m)).alias("i"), place(n_p).alias("j"))

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy()
        fp = pdf["fp"].to_numpy()
        return pd.DataFrame(forest(fp[~own], fp[own], limit), columns=["a", "b"], dtype="int64")

    units = members.unionByName(probers).where(F.col("j").isNotNull()).groupBy("key", "i", "j").applyInPandas(unit, "a long, b long")
    return pairs.unionByName(units)


def roots(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for all nodes of ``edges`` (``a``, ``b``), by alternating large and
    small stars until nothing changes. Every round is written to the shared folder."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = stored(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "links")
    before = None
    while True:
        near = both(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = near.where("v > u").join(least, "u").selectExpr("v as a", "m as b").distinct()
        down = large.where("a <> b")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").selectExpr("b as a", "m as b").unionByName(lowest.selectExpr("a", "m as b"))
        edges = stored(small.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def cluster(rows: DataFrame, limit: int = 4) -> DataFrame:
    """For every fingerprint of ``rows`` (``doc``, ``fp``, ``row``) its ``component`` (smallest doc reachable; nulls do not count) and
    the one row to keep of the component, ``keeper`` (smallest doc, then smallest row number)."""
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("keep")
    prints = stored(rows.groupBy("fp").agg(F.min("doc").alias("doc"), first), "prints")
    found = roots(links(prints, limit)).withColumnRenamed("node", "fp")
    placed = prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = placed.groupBy("root").agg(F.min("doc").alias("component"), F.min("keep").alias("keep"))
    return placed.select("fp", "root").join(whole, "root").select("fp", "component", F.col("keep.row").alias("keeper"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 4) -> DataFrame:
    """One row per row of ``df``: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links of
    ``limit`` bits or fewer.

    Null and empty texts have fingerprint zero and are linked like any other. Copies share a fingerprint, so a group of copies is
    one node however large. Components whose ids are all null have a null component. An empty table gives an empty table.
    """
    rows = df.select(F.col(doc_id).alias("doc"), fingerprint(F.col(text)).alias("fp")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "fingerprints")
    out = rows.join(cluster(rows, limit), "fp")
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def proposed(nodes: DataFrame, shingle: int, limit: int) -> DataFrame:
    """Pairs ``a``, ``b`` of rows of ``nodes`` (``node``, ``text``) that give the components of all fingerprints within ``limit`` bits: texts
    of one fingerprint beside the smallest node of them, and these nodes of linked fingerprints."""
    prints = stored(nodes.select("node", fingerprint(F.col("text"), shingle).alias("fp")), "node-fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min("node").alias("first")), "first-of-fingerprint")
    same = prints.join(first, "fp").where("node <> first").selectExpr("first as a", "node as b")
    found = stored(links(first.select("fp"), limit).distinct(), "fingerprint-links")
    of = lambda c: first.selectExpr(f"fp as f{c}", f"first as {c}")
    return same.unionByName(found.selectExpr("a as fa", "b as fb").join(of("a"), "fa").join(of("b"), "fb").select("a", "b"))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8, limit: int = 4) -> DataFrame:
    """``df`` with one row of each near-duplicate group: that of the smallest id, null ids last, then the first as read.

    Groups are the components of all pairs whose sets of ``shingle``-word shingles have a Jaccard similarity of ``threshold`` or more.
    Fingerprints of these shingles within ``limit`` bits propose pairs by the pigeonhole index; whole sets decide on them, and an exact
    prefix filter finds the pairs of the wanted similarity whose fingerprints are further apart. Any limit gives the same groups;
    texts of the same words are one, and so are all texts without words. Columns named ``__fp`` or ``__row`` are lost.
    """
    base = without(df, "__fp", "__row")
    rows = stored(base.withColumns({"__fp": F.md5(jaccard.plain(F.col(text)).cast("binary")), "__row": F.monotonically_increasing_id()}), "documents")
    ids = rows.select(F.col(doc_id).alias("doc"), "__fp", "__row")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", F.col("__row").alias("node")))
    texts = stored(ids.groupBy("__fp").agg(first.alias("keep")).select("keep.*"), "texts")
    copies = stored(ids.select("__row").join(texts.select(F.col("node").alias("__row")), "__row", "left_anti"), "copies")
    nodes = rows.join(small(copies), "__row", "left_anti").select(F.col("__row").alias("node"), F.col(text).alias("text"))
    found = jaccard.links(nodes, proposed(nodes, shingle, limit), roots, shingle, threshold)
    placed = texts.join(roots(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = placed.groupBy("root").agg(F.min(F.struct("none", "doc", "node")).alias("keep")).select(F.col("keep.node").alias("__row"))
    gone = stored(ids.select("__row").join(keep, "__row", "left_anti"), "gone")
    return rows.join(small(gone), "__row", "left_anti").select(*[F.col(f"`{c}`") for c in base.columns])
