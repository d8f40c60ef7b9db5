"""Mutual information against a plain estimator that compares all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.operators.information import digamma, mutual_information


def psi(m):
    return -0.57721566490153286 + sum(1 / j for j in range(1, int(m)))


def plain(x, y, k=3):
    x, y = (v / (v.std() or 1.0) for v in (x, y))
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1]
    near = lambda e: np.where(r == 0, (e == 0).sum(1), (e < r[:, None]).sum(1)) - 1
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(a + 1) for a in near(dx)]) - np.mean([psi(b + 1) for b in near(dy)]))


def table(n, seed=6):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n)
    cols = {"linear": y + rng.normal(size=n) * 0.3, "noise": rng.normal(size=n), "same": y.copy(), "flag": (y > 0.5) * 1.0, "steps": np.round(y * 2), "flat": np.ones(n), "heavy": np.exp(3 * rng.normal(size=n))}
    cols["heavy"][: n // 3] = 1.0
    return cols, y


@pytest.mark.parametrize(("n", "cell", "value_range"), [(150, 512, 50_000), (420, 32, 60)])
def test_equal_to_all_pairs(spark, n, cell, value_range):
    """In one cell, and in many small ones with ranges of counts; ties, flags and a value in a third of the rows."""
    cols, y = table(n)
    y = np.where(np.arange(n) % 7 == 0, np.round(y, 1), y)
    rows = [tuple(map(float, r)) for r in zip(*cols.values(), y, strict=True)]
    extra = [(None, *[1.0] * len(cols)), (float("nan"), *[1.0] * len(cols)), (float("inf"), *[1.0] * len(cols))]
    df = spark.createDataFrame(rows + extra, ", ".join(f"{c} double" for c in cols) + ", label double")
    got = {r["feature"]: r["mi"] for r in mutual_information(df, list(cols), cell=cell, value_range=value_range).collect()}
    for c, x in cols.items():
        assert abs(got[c] - plain(x, y)) < 1e-9, (c, got[c], plain(x, y))
    assert got["same"] > got["linear"] > got["noise"]


def test_few_rows_and_digamma(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 3, "a double, label double")
    assert [tuple(r) for r in mutual_information(df, ["a"]).collect()] == [("a", 0.0)] == [tuple(r) for r in mutual_information(df.limit(0), ["a"]).collect()]
    for r in spark.range(1, 60).select("id", digamma(F.col("id").cast("double")).alias("d")).collect():
        assert math.isclose(r["d"], psi(r["id"]), abs_tol=1e-10)
