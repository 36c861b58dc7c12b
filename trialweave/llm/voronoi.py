"""Exact top-k search by integer inner product, as a Voronoi join.

All vectors are put into the cells of fitted pivots. Summaries of the cells (rows, radii, best known scores) bound what a query of one
cell can score with a row of another; a row is replicated only to the query groups that may need it, each group solves its slices
of rows locally, and the best of the slices are merged. Bounds are loosened by far more than rounding, so that no row is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import stored

#: Bounds are loosened by this part of the lengths they are made of.
SLACK = 1e-6
#: What a whole number may be for sums of products to be exact in doubles.
EXACT = 2.0**53
LONGEST = 2**63 - 1


def padded(values: list | np.ndarray, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix of whole numbers, with zeros up to ``width``."""
    out = np.zeros((len(values), width), dtype=np.int64)
    for k, v in enumerate(values):
        out[k, : len(v)] = v
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return padded(column.to_pylist(), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both, exact; beyond the range of a long they stop at its ends."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LONGEST - 1, LONGEST).astype(np.int64)


def fitted_pivots(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Centres of a few rounds of k-means over a sample, one each for distinct vectors where these are fewer."""
    known = np.unique(sample, axis=0).astype(float)
    rng = np.random.default_rng(0)
    centres = known[np.sort(rng.permutation(len(known))[:pivots])]
    for _ in range(rounds):
        cell = nearest(known, centres)
        centres = np.array([known[cell == j].mean(axis=0) if (cell == j).any() else centres[j] for j in range(len(centres))])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] / 2 - x @ centres.T).argmin(axis=1)


def nearest_chain(centres: np.ndarray, of: list[int]) -> list[int]:
    """The cells ``of`` in an order where each is followed by the nearest one that is left."""
    left, out = list(of), []
    while left:
        j = left[0] if not out else left[int(((centres[left] - centres[out[-1]]) ** 2).sum(axis=1).argmin())]
        left.remove(j)
        out.append(j)
    return out


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: highest score, then smallest id (missing ids last), then smallest row."""
    pick = np.arange(len(scores))
    if len(scores) > k:
        pick = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    none = np.array([i is None or i != i for i in ids[pick]], dtype=bool)
    known = np.array([0 if n else int(i) for n, i in zip(none, ids[pick], strict=True)], dtype=np.int64)
    return pick[np.lexsort((rows[pick], known, none, ~scores[pick]))[:k]] if len(pick) else pick


def whole_vectors(df: DataFrame, vec_id: str, embedding: str, asks: Column, scale: int) -> DataFrame:
    """``row, id, asks, v`` of the rows whose vectors are whole: floor(``scale`` * component), computed in doubles."""
    x = F.col(embedding)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.when(sound, v).alias("v"))
    return rows.where("v IS NOT NULL")


def top_k(
    df: DataFrame, asks: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64,
    pivots: int = 256, sample: int = 4096, seeds: int = 1024, queries: int = 1024, slice_rows: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``asks`` holds, the ``k`` rows other than itself of the highest inner product.

    Components are floor(``scale`` * x) with x as a double; scores are exact (at the ends of the range of a long they stop). Ties go to
    the smaller id, missing ids last, then to the row read first. Rows whose vector is null or has a null, NaN or infinite component
    take no part; shorter vectors are filled up with zeros, so an empty one scores 0. Repeated ids are rows like any other and see each
    other. Fewer than ``k`` other rows are all returned; an empty table gives an empty table.

    Pivots (the root of the number of rows, ``pivots`` at most) are fitted on ``sample`` rows; any pivots give the same result.
    """
    spark = df.sparkSession
    made = "query_id long, rank int, vec_id long, score long"
    rows = stored(whole_vectors(df, vec_id, embedding, asks, scale), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], made)
    width = max(width, 1)
    drawn = rows.orderBy(F.xxhash64("row")).limit(sample).select("v").collect()
    centres = fitted_pivots(padded([r[0] for r in drawn], width), min(pivots, math.isqrt(n - 1) + 1))
    length = np.linalg.norm(centres, axis=1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width).astype(float)
            cell = nearest(x, centres) if len(x) else np.zeros(0, dtype=np.int64)
            far = np.linalg.norm(x - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = stored(rows.mapInArrow(place, "row long, id long, asks boolean, v array<long>, cell int, far double"), "cells")
    summary = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("far").alias("radius")).collect()}
    asked = sorted(c for c, r in summary.items() if r["q"])
    if not asked:
        return spark.createDataFrame([], made)

    # A first bound for every query: its k-th best score among some rows of its own cell, and of the nearest ones where that has too few.
    cells = np.array(sorted(summary))
    lists = []
    for c in asked:
        have, chunks = 0, math.ceil(summary[c]["q"] / queries)
        for j in cells[np.argsort(((centres[cells] - centres[c]) ** 2).sum(axis=1), kind="stable")]:
            lists.append((int(j), int(c), chunks, math.ceil(summary[j]["n"] / seeds)))
            have += min(summary[j]["n"], seeds // 2)
            if have >= 2 * k + 1:
                break
    near = F.broadcast(spark.createDataFrame(lists, "cell int, home int, chunks int, slots int"))  # a few rows per pivot
    own = F.broadcast(spark.createDataFrame([(int(c), math.ceil(summary[c]["q"] / queries)) for c in asked], "cell int, chunks int"))
    dealt = lambda parts: F.pmod(F.xxhash64("row"), parts)
    probes = placed.where("asks").join(own, "cell").select(F.col("cell").alias("home"), dealt(F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"), "row", "id", "v", "far")
    first = placed.join(near, "cell").where(F.pmod(F.xxhash64(F.lit(1), "row"), F.col("slots")) == 0)
    first = first.select("home", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asks"), "row", "id", "v", "far")

    def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
        out, known = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        bound = np.full(len(out), -LONGEST - 1, dtype=np.int64)
        if len(known) > k and len(out):
            scores = products(padded(out["v"].to_numpy(), width), padded(known["v"].to_numpy(), width))
            scores[out["row"].to_numpy()[:, None] == known["row"].to_numpy()[None, :]] = -LONGEST - 1
            bound = np.partition(scores, len(known) - k, axis=1)[:, len(known) - k]
        return out.assign(bound=bound)[["home", "row", "id", "v", "far", "bound"]]

    bounds = probes.unionByName(first).groupBy("home", "chunk").applyInPandas(bounded, "home int, row long, id long, v array<long>, far double, bound long")
    bounds = stored(bounds, "bounds")
    least = {r["home"]: r for r in bounds.groupBy("home").agg(F.min("bound").alias("bound"), F.max("far").alias("radius")).collect()}

    # What a query of a cell can score with any row of another cell, from both summaries.
    r_q, floor = np.array([least[c]["radius"] for c in asked]), np.array([float(least[c]["bound"]) for c in asked])
    radius = np.zeros(len(centres))
    radius[cells] = [summary[c]["radius"] for c in cells]
    reach = centres[asked] @ centres.T + length[asked][:, None] * radius[None, :] + r_q[:, None] * (length + radius)[None, :]
    size = (length[asked] + r_q)[:, None] * (length + radius)[None, :] + 1
    open_cells = reach + SLACK * size >= floor[:, None]

    # Near cells share a query group, a cell with many queries has several.
    groups_of: dict[int, tuple[int, int]] = {}
    last, room = -1, 0
    for c in nearest_chain(centres, asked):
        q = summary[c]["q"]
        if q > room:
            last, room = last + 1, max(queries, q)
            groups_of[c] = (last, math.ceil(q / queries))
            last, room = last + groups_of[c][1] - 1, 0 if q > queries else queries - q
        else:
            groups_of[c], room = (last, 1), room - q
    start, many = (np.array([groups_of[c][i] for c in asked]) for i in (0, 1))
    sharing = {int(s): [i for i in range(len(asked)) if start[i] == s] for s in start}
    n_in = np.zeros(len(centres))
    n_in[cells] = [summary[c]["n"] for c in cells]
    slices = {s: max(1, math.ceil(float(n_in[open_cells[own_].any(axis=0)].sum()) / slice_rows)) for s, own_ in sharing.items()}

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                v, cell, row = batch.column("v"), batch.column("cell").to_numpy(), batch.column("row").to_numpy()
                x = matrix(v, width).astype(float)
                norm = np.linalg.norm(x, axis=1)
                can = x @ centres[asked].T + r_q[None, :] * norm[:, None] + SLACK * ((length[asked] + r_q)[None, :] * norm[:, None] + 1) >= floor[None, :]
                can &= open_cells.T[cell]
                for s, own_ in sharing.items():
                    need = np.flatnonzero(can[:, own_].any(axis=1))
                    if not len(need):
                        continue
                    part = (row[need] * 0x9E3779B1 % 2**31) % slices[s]
                    for g in range(s, s + int(many[own_[0]])):
                        cols = [pa.array(np.full(len(need), g), pa.int32()), pa.array(part, pa.int32()), batch.column("row").take(need), batch.column("id").take(need), v.take(need)]
                        yield pa.RecordBatch.from_arrays(cols, names=["g", "s", "row", "id", "v"])

    copies = placed.select("row", "id", "v", "cell").mapInArrow(replicate, "g int, s int, row long, id long, v array<long>")
    homes = F.broadcast(spark.createDataFrame([(int(c), int(s), int(m), slices[int(s)]) for c, s, m in zip(asked, start, many, strict=True)], "home int, start int, many int, slices int"))
    query = bounds.join(homes, "home").select((F.col("start") + dealt(F.col("many"))).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"), "row", "id", "v", "bound")
    units = copies.withColumn("bound", F.lit(None).cast("long")).withColumn("asks", F.lit(False)).unionByName(query.withColumn("asks", F.lit(True)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        ids, at, out = x["id"].to_numpy(dtype=object), x["row"].to_numpy(), []
        data, mine, bound = padded(x["v"].to_numpy(), width), q["row"].to_numpy(), q["bound"].to_numpy(dtype=object).astype(np.int64)
        asking, names = padded(q["v"].to_numpy(), width), q["id"].to_numpy(dtype=object)
        for a in range(0, len(q), 256):
            scores = products(asking[a : a + 256], data)
            keep = (scores >= bound[a : a + 256, None]) & (at[None, :] != mine[a : a + 256, None])
            for i in range(len(scores)):
                j = np.flatnonzero(keep[i])
                j = j[best(scores[i, j], ids[j], at[j], k)]
                out += [(int(mine[a + i]), names[a + i], int(at[m]), ids[m], int(scores[i, m])) for m in j]
        made_ = pd.DataFrame(out, columns=["q", "query_id", "row", "vec_id", "score"])
        return made_.astype({"query_id": "Int64", "vec_id": "Int64"})

    found = units.groupBy("g", "s").applyInPandas(solve, "q long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
