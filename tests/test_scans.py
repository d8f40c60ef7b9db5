"""Recursions over chunks of a ticker against the same over its whole history."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewick.functions.scans import Average, averages
from tidewick.operators import features


def history(n=400, seed=2):
    """One long ticker, a short one, one with gaps that outlast chunks, one without values."""
    rng = np.random.default_rng(seed)
    rows = []
    for t, m, missing in (("long", n, 0.1), ("short", 3, 0.0), ("gaps", n, 0.9), ("late", 60, 0.0), ("none", 30, 1.0)):
        x = np.where(rng.random(m) < missing, np.nan, 100 + rng.normal(size=m).cumsum())
        if t == "late":
            x[:45] = np.nan
        days = np.sort(rng.choice(900, m, replace=False))
        rows += [(t, pd.Timestamp("2015-01-01").date() + pd.Timedelta(days=int(d)), None if np.isnan(v) else float(v)) for d, v in zip(days, x, strict=True)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("days", [7, 120, 5000])
def test_averages_equal_whole_histories(spark, days):
    df = spark.createDataFrame(history(), "ticker string, date date, x double").withColumn("__q", F.lit("clash"))
    wanted = {"a": Average("x", 0.3), "b": Average.span("x", 26, 26), "c": Average("x", 0.06, 10)}
    got = averages(df.withColumn("n", F.lit(1)), wanted, chunk_days=days).toPandas().sort_values(["ticker", "date"])
    want = df.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    for name, a in wanted.items():
        expected = want.groupby("ticker")["x"].transform(lambda s, a=a: s.ewm(alpha=a.alpha, adjust=False, min_periods=a.least).mean())
        assert np.allclose(got[name].to_numpy(float), expected.to_numpy(float), rtol=1e-10, equal_nan=True), name
    assert averages(df.limit(0), wanted).count() == 0


def test_one_long_ticker_is_many_groups(spark):
    """The only groups are chunks of a ticker, and a row for each of them."""
    df = spark.createDataFrame([r for r in history() if r[0] == "long"], "ticker string, date date, x double")
    assert df.select(F.floor(F.unix_date("date") / 100)).distinct().count() >= 8
    plan = averages(df, {"a": Average("x", 0.3)}, chunk_days=100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 3 and "Window" not in plan


def test_features_equal_whole_histories(spark):
    rows = [(t, d, 50.0 if x is None else x, None if x is None else x / 1000) for t, d, x in history(300)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, ret double")
    got = features.recursive(df, chunk_days=40).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    want = df.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)

    def plain(p):
        e = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
        macd = e(p["close"], 12) - e(p["close"], 26)
        return pd.DataFrame({"ema9": e(p["close"], 9), "macd": macd, "macd_signal": e(macd, 9), "macd21": e(macd, 21), "ewma94": (p["ret"] ** 2).ewm(alpha=0.06, adjust=False, min_periods=10).mean() ** 0.5})

    expected = pd.concat([plain(p) for _, p in want.groupby("ticker")])
    for c in expected:
        assert np.allclose(got[c].to_numpy(float), expected[c].to_numpy(float), rtol=1e-9, atol=1e-12, equal_nan=True), c
