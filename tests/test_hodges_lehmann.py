import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import stats as st


def shifts(spark, groups, **options):
    rows = [(g, True, float(v)) for g, (x, _) in groups.items() for v in x] + [(g, False, float(v)) for g, (_, y) in groups.items() for v in y]
    df = spark.createDataFrame(rows + [("a", True, None), ("a", None, 5.0), ("a", False, float("nan"))], "g string, side boolean, v double")
    keep = lambda df, name: df.checkpoint()
    return {r["g"]: r for r in st.hodges_lehmann(df, ["g"], "v", F.col("side"), keep=keep, **options).collect()}


def test_shift_equals_the_median_of_all_differences(spark):
    rng = np.random.default_rng(5)
    groups = {
        "a": (rng.normal(1, 2, 300), rng.normal(0, 1, 201)),  # odd and even numbers of pairs
        "b": (rng.standard_cauchy(150), rng.standard_cauchy(99)),
        "c": (rng.integers(0, 9, 400), rng.integers(-3, 5, 300)),  # ties
        "d": (np.full(200, 7.5), np.full(90, -0.25)),
        "e": ([3.0], [1.0]),
        "f": (rng.lognormal(0, 6, 120), -rng.lognormal(0, 6, 120)),
        "g": ([1.0, 2.0], []),
    }
    got = shifts(spark, groups, spare=50)
    assert set(got) == set("abcdef")
    for g, r in got.items():
        x, y = map(np.asarray, groups[g])
        assert (r["n_left"], r["n_right"]) == (len(x), len(y))
        assert r["shift"] == pytest.approx(np.median(x[:, None] - y[None, :]), rel=1e-12, abs=1e-12)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, side boolean, v double")
    assert st.hodges_lehmann(df, ["g"], "v", F.col("side")).count() == 0
