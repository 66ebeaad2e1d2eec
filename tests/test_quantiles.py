"""Distributed exact quantiles and average ranks against numpy / pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thetaflow.functions.quantiles import average_ranks, exact_quantiles

PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.3]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    # a normal sample, one value holding 30 % of the rows, and small integers
    x = np.concatenate([rng.normal(0, 1, 5000), np.full(3000, 0.5), rng.integers(0, 5, 2000).astype(float)])
    g = np.array(["a"] * 6000 + ["b"] * 4000)
    df = spark.createDataFrame([(str(a), float(v)) for a, v in zip(g, x)], "g string, x double")
    return df, g, x


@pytest.mark.parametrize("accuracy", [5, 64, 10_000])
def test_grouped_quantiles_exact(data, accuracy):
    df, g, x = data
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, F.col("x"), PROBS, ["g"], accuracy=accuracy).collect()}
    for key in "ab":
        np.testing.assert_allclose(got[key], np.percentile(x[g == key], [p * 100 for p in PROBS]), atol=1e-12)


def test_ungrouped_quantiles_exact(data):
    df, _, x = data
    got = exact_quantiles(df, F.col("x"), PROBS, accuracy=64).collect()[0]["quantiles"]
    np.testing.assert_allclose(got, np.percentile(x, [p * 100 for p in PROBS]), atol=1e-12)


def test_single_value_and_empty_group(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None)], "g string, x double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, F.col("x"), [0.1, 0.9], ["g"], name="q").collect()}
    assert got == {"a": [3.0, 3.0]}


def test_average_ranks_with_ties(data):
    df, g, x = data
    got = {(r["g"], r["x"]): r["rank"] for r in average_ranks(df, "x", ["g"], buckets=64).collect()}
    pdf = pd.DataFrame({"g": g, "x": x})
    pdf["r"] = pdf.groupby("g")["x"].rank(method="average")
    assert all(abs(got[(a, b)] - c) < 1e-9 for a, b, c in pdf[["g", "x", "r"]].itertuples(index=False))


def test_ties_leave_most_values_out_of_the_bands(spark):
    """Few distinct values make the targets breaks of the sketch; what lies between two targets isn't shuffled with them."""
    from thetaflow.functions import quantiles
    rows = [(g, float(i % 39)) for g in range(3) for i in range(3900)] + [(3, float("nan")), (3, 1.0), (3, -0.0), (3, None), (4, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = [0.25, 0.75]
    edges = sorted(p + side * 2 / quantiles.ACCURACY for p in probs for side in (-1, 1))
    b = quantiles._bucketed(df.where("g < 3"), F.col("x"), ["g"], edges, quantiles.ACCURACY, False)
    sizes = {r["x"]: r["n"] for r in b.groupBy(F.col(quantiles.B).alias("b"), F.col(quantiles.V).alias("x")).count().groupBy("b").agg(
        F.sum("count").alias("n"), F.max("x").alias("x")).collect()}
    assert sizes[9.0] == sizes[29.0] == 300  # 100 rows of each group equal the target
    got = {r["g"]: r["q"] for r in exact_quantiles(df, F.col("x"), probs, ["g"], name="q").collect()}
    assert set(got) == {0, 1, 2, 3} and got[3][0] == 0.5 and np.isnan(got[3][1])
    assert all(got[g] == [9.0, 29.0] for g in range(3))
