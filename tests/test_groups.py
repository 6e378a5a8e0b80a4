"""Skew-safe primitives against brute force, with one value or key holding a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitgrid.functions import groups


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 3000
    v = np.round(rng.standard_t(2, n), 2)
    v[: n // 3] = 0.0
    g = rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05])
    return pd.DataFrame({"g": g, "id": np.arange(n), "v": v})


def test_average_ranks(spark, skewed):
    out = groups.with_average_ranks(spark.createDataFrame(skewed), ["g"], ["id"], {"v": "r"}).toPandas().sort_values("id")
    want = skewed.groupby("g")["v"].rank(pct=True)
    assert np.allclose(out["r"].to_numpy(), want.to_numpy())


def test_quantiles(spark, skewed):
    out = groups.quantiles(spark.createDataFrame(skewed), ["g"], "v", {"a": 0.025, "b": 0.5, "c": 0.975}).toPandas().set_index("g")
    want = skewed.groupby("g")["v"].quantile([0.025, 0.5, 0.975]).unstack()
    assert np.allclose(out.loc[want.index, ["a", "b", "c"]].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("desc", [False, True])
def test_running_sum(spark, skewed, desc):
    df = spark.createDataFrame(skewed.assign(x=1.0 + skewed["id"] % 7))
    out = groups.running_sum(df, ["g"], "v", [F.col("id").asc()], "x", "before", descending=desc).toPandas().sort_values("id")
    p = skewed.assign(x=1.0 + skewed["id"] % 7).sort_values(["g", "v", "id"], ascending=[True, not desc, True])
    want = (p.groupby("g")["x"].cumsum() - p["x"]).sort_index()
    assert np.allclose(out["before"].to_numpy(), want.to_numpy())


def test_buckets_are_monotone(spark):
    vals = [-1e9, -3.0, -1.0, -1e-9, -0.0, 0.0, 1e-12, 0.5, 1.0, 1.5, 2.0, 1e12]
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double").orderBy("i").select(groups.value_bucket("v").alias("b")).collect()]
    assert got == sorted(got)


def test_latest_breaks_ties_and_keeps_nulls(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, None), ("k", 2, 5), ("z", 1, None)], "k string, o int, v int")
    assert {(r.k, r.o, r.v) for r in groups.latest(df, ["k"], ["o"]).collect()} == {("k", 2, 5), ("z", 1, None)}
