"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, pieces (documents) and attention cost (the sum of squared lengths). What a piece needs
depends on its length alone, so best fit in decreasing order is planned on the number of pieces of each length: a table as long
as a sequence, however large the corpus is. The plan is a list of runs ("the next n pieces of length L, k to a sequence, from
sequence b on, at offset o"); every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.llm.common import stored
from trialweave.llm.tokens import encoder


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    pieces: int = 1024
    cost: int = 1024 * 1024


def needs(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], dtype=np.int64)


def plan(counts: dict[int, int], capacity: Capacity, score: str = "norm", weights=(1.0, 0.02, 0.02)) -> dict[str, np.ndarray]:
    """Runs that place ``counts[length]`` pieces of each length, with columns length, rank, n, per_bin, first_bin, offset.

    Lengths go in decreasing order. Of the open sequences that hold the piece under every capacity, ``norm`` takes the one whose
    residual vector is nearest to the piece, and ``dot`` the one with the largest weighted dot product of the two (shares of the
    capacities). Sequences with the same residual are handled together.
    """
    if score not in ("norm", "dot"):
        raise ValueError("score must be 'norm' or 'dot'")
    cap, w = np.array([capacity.tokens, capacity.pieces, capacity.cost], dtype=np.int64), np.array(weights)
    left, first, many = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    runs, n_bins = [], 0
    for length in sorted(counts, reverse=True):
        item, n, rank = needs(length), counts[length], 0
        if n and (item > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        share = item / cap
        while n:
            fits = np.flatnonzero((left >= item).all(axis=1) & (many > 0))
            if len(fits):
                rest = left[fits] / cap
                value = -((rest - share) ** 2 @ w) if score == "norm" else rest @ (w * share)
                g = int(fits[np.argmax(value)])
            else:
                left, first, many = np.vstack([left, cap]), np.append(first, n_bins), np.append(many, n)
                g = len(many) - 1
            room = int((left[g] // item).min())
            k = room if score == "norm" else 1  # by norm, a sequence that took one piece fits the next one even better
            bins = min(int(many[g]), n // k) if n >= k else 1
            k = min(k, n)
            runs.append((length, rank, bins * k, k, int(first[g]), capacity.tokens - int(left[g, 0])))
            left, first, many = np.vstack([left, left[g] - k * item]), np.append(first, first[g]), np.append(many, bins)
            if len(fits):
                many[g] -= bins
                first[g] += bins
            else:  # only as many new sequences as were needed
                n_bins += bins
                many[g] = 0
            n -= bins * k
            rank += bins * k
        alive = (many > 0) & (left[:, 0] > 0)
        left, first, many = left[alive], first[alive], many[alive]
    columns = ["length", "rank", "n", "per_bin", "first_bin", "offset"]
    return dict(zip(columns, np.array(runs, dtype=np.int64).reshape(-1, 6).T, strict=True)) | {"n_bins": np.array(n_bins)}


def placed(runs: dict[str, np.ndarray]):
    """Sequence and offset of the piece with a length and a rank among its length."""
    order = np.lexsort((runs["rank"], runs["length"]))
    run = {k: v[order] for k, v in runs.items() if k != "n_bins"}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy(), rank.to_numpy()
        at = np.zeros(len(size), dtype=np.int64)
        for value in np.unique(size):
            a, b = np.searchsorted(run["length"], [value, value + 1])
            mine = size == value
            at[mine] = a + np.searchsorted(run["rank"][a:b], nth[mine], "right") - 1
        inside = nth - run["rank"][at]
        k = run["per_bin"][at]
        return pd.DataFrame({"sequence_id": run["first_bin"][at] + inside // k, "offset": run["offset"][at] + inside % k * size})

    return place


def pieces(df: DataFrame, path: str, doc_id: str, text: str, size: int, end_id: int) -> DataFrame:
    """Token pieces of every document: the ids as little-endian unsigned 32-bit numbers, and the piece's number ``nth`` among
    those of its length in its task (``part``)."""
    kind = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType())])
    for name in ("start", "length", "ids_crc32", "nth"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("part", T.IntegerType()).add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)

        def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            where, piece, start, length, crc, nth, data = zip(*rows, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, nth)]
            columns = [ids.take(pa.array(where)), pa.array(piece, pa.int32()), *longs]
            columns += [pa.array([part] * len(rows), pa.int32()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column("text")):
                ids = np.array([*enc.encode(t.as_py() or ""), end_id], dtype="<u4")
                cut = -(-len(ids) // size)
                start = 0
                for k in range(cut):
                    stop = len(ids) - size * (cut - 1 - k)
                    data = ids[start:stop].tobytes()
                    rows.append((i, k, start, stop - start, zlib.crc32(data), int(seen[stop - start]), data))
                    seen[stop - start] += 1
                    start = stop
                    if len(rows) >= 4096:
                        yield batch_of(batch.column("doc_id"), rows)
                        rows = []
            if rows:
                yield batch_of(batch.column("doc_id"), rows)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: Capacity = Capacity(), score: str = "norm", end_id: int = 2
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``.

    A document is its token ids and ``end_id``; null text is empty. Documents longer than a sequence are cut into full pieces,
    of which only the first may be shorter. Equal rows are packed as often as they stand there; an empty table gives no
    sequences. Columns of ``df`` other than the two are not carried. Pieces are stored once in the shared folder; then only
    counts by task and length are summed, so a length that most pieces have needs no task of its own.
    """
    made = stored(pieces(df, path, doc_id, text, capacity.tokens, end_id), "pieces")
    counts = stored(made.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {int(x): int(n) for x, n in counts.groupBy("length").agg(F.sum("n")).collect()}  # as many rows as tokens in a sequence
    before = counts.selectExpr("part", "length", "sum(n) over (partition by length order by part) - n as before")
    ranked = made.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    at = ranked.withColumn("at", placed(plan(histogram, capacity, score))("length", "rank"))
    return at.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id, ids`` (bytes as in the pieces), ``starts`` of the pieces in them and their documents."""
    row = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # one sequence's tokens at most
    made = packed.groupBy("sequence_id").agg(row.alias("rows"))
    joined = F.aggregate("rows", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return made.select("sequence_id", joined.alias("ids"), F.col("rows.offset").alias("starts"), F.col("rows.doc_id").alias("doc_ids"))
