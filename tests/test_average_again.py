import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import traces as tr


def test_average_of_averages_is_the_flat_average(spark):
    rng = np.random.default_rng(2)
    rows = [("a", k % 4 if k % 4 < 3 else k, p, float(rng.normal(1e3, 1))) for k in range(30) for p in range(3)] + [("b", 0, 0, 5.0)]
    df = spark.createDataFrame(rows, "g string, part long, pos long, v double")
    flat = {(r["g"], r["pos"]): r for r in tr.average(df, ["g"]).collect()}
    again = {(r["g"], r["pos"]): r for r in tr.average_again(tr.average(df, ["g", "part"]), ["g"]).collect()}
    assert flat.keys() == again.keys()
    for k, r in again.items():
        assert (r["mean"], r["n_rows"]) == (pytest.approx(flat[k]["mean"], rel=1e-12), flat[k]["n_rows"])
        assert r["sem"] == (None if flat[k]["sem"] is None else pytest.approx(flat[k]["sem"], rel=1e-9))


def test_rows_without_a_mean_and_names(spark):
    df = spark.createDataFrame([("a", 0, None, None, 2), ("a", 0, 4.0, 1.0, 3), ("b", 0, None, None, 1)], "g string, pos long, mean double, sem double, n_rows long")
    got = {r["g"]: r for r in tr.average_again(df, ["g"]).collect()}
    assert (got["a"]["mean"], got["a"]["sem"], got["a"]["n_rows"]) == (4.0, pytest.approx(1.0), 5)
    assert (got["b"]["mean"], got["b"]["sem"], got["b"]["n_rows"]) == (None, None, 1)
    assert tr.average_again(df.limit(0), ["g"]).count() == 0
    r = df.select(tr.averaged_name("g", "pos").alias("x"), tr.averaged_name("g", own=True).alias("y")).where(F.col("x") == "g_b_pos_0").first()
    assert (r["x"], r["y"]) == ("g_b_pos_0", "b Avg. Trace")
