"""Top-k by inner product against all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import same_as_sql
from trialweave.llm import voronoi

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asks, k, scale=64):
    kept = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((at, i, [math.floor(c * scale) for c in v]))
    out = []
    for at, i, v in kept:
        if asks(i):
            scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, other) for other, j, w in kept if other != at]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in voronoi.top_k(df, asks=F.col("vec_id") % 20 == 0, **kw).collect()), key=str)


def asks(i):
    return i is not None and i % 20 == 0


def test_clusters_and_copies_in_small_units(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 6)) * 3
    rows = [(int(i), [float(x) for x in centre[i % 12] + rng.normal(size=6) * 0.2]) for i in range(600)]
    rows += [(int(i), [1.0, 2.0, 0.5, 0.0, -1.0, 0.25]) for i in range(600, 900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, asks, 5)
    assert found(df, k=5) == want
    assert found(df, k=5, pivots=7, sample=50, seeds=20, queries=4, slice_rows=64) == want
    assert found(df, k=5, pivots=1) == want


def test_far_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.eye(8)[i % 8] * 20 + rng.normal(size=8) * 0.05]) for i in range(800)]
    assert found(spark.createDataFrame(rows, SCHEMA), k=10, queries=8) == brute(rows, asks, 10)


def test_edges(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf")]), (100, []), (120, [3.0]),
        (None, [5.0, 5.0]), (None, [5.0, 5.0]), (7, [1.0, 2.0]), (8, [-1.0, -2.0, 9.0]), (9, [0.3, 0.7]), (140, [1e9, -1e9]), (9, [0.3, 0.7]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as score", "'own' as `row`", "'own' as cell", "'own' as rank")
    assert found(df, k=4) == brute(rows, asks, 4)
    assert found(df, k=50) == brute(rows, asks, 50)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(20, [1.0])], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, [1.0]), (2, [1.0])], SCHEMA)) == []


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2**40 + 1, 3]]), np.array([[2**20 + 1, -5], [2**40, 2**40]])
    assert voronoi.products(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) - 15, 2**63 - 1]]


def test_query_equals_sql(spark):
    same_as_sql(spark, "op12_voronoi_top_k")
