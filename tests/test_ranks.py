"""Ranks and quantiles in ranges that the data size, with one value in half of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewick.functions import ranks
from tidewick.operators import metrics


def table(spark, n=2000):
    rng = np.random.default_rng(8)
    a = np.where(np.arange(n) % 2 == 0, 7.0, np.round(rng.normal(size=n) * 50) / 5 + 7)
    b = [None if i % 9 == 0 else float(x) for i, x in enumerate(rng.normal(size=n))]
    return spark.createDataFrame([(i, float(x), y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "k long, a double, b double")


@pytest.mark.parametrize("each", [50, 100_000])
def test_equal_to_pandas(spark, each):
    df = table(spark)
    got = ranks.average_ranks(df, ["a", "b"], "k", each=each).toPandas()
    whole = df.toPandas()
    for c in ("a", "b"):
        mine = got[got["feature"] == c].set_index("k")["r"].sort_index()
        assert np.allclose(mine, whole[c].rank().dropna())
    probs = [0.0, 0.005, 0.33, 0.5, 0.995, 1.0]
    found = {r["feature"]: r["q"] for r in ranks.quantiles(df, ["a", "b"], probs, each).collect()}
    for c in ("a", "b"):
        assert np.allclose(found[c], whole[c].quantile(probs))
    assert ranks.quantiles(df.where("false"), ["a"], [0.5]).count() == 0


def test_no_task_gets_the_frequent_value(spark):
    """Half of the rows hold one value; neither a range, nor a task of the join, has more than a small multiple of its share."""
    df, each = table(spark), 50
    d = ranks.placed(df, ["a"], each)
    assert d.count() == df.select("a").distinct().count() and d.agg(F.max("c")).first()[0] >= 1000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = ranks.average_ranks(df, ["a"], "k", each=each)
        most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert rows.count() == 2000 and most < 2000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ordinal_is_a_total_order(spark):
    df = table(spark).withColumn("rank_of", F.lit(1))
    got = metrics.ordinal(df, "a", "k").toPandas().sort_values("rank")
    want = df.toPandas().sort_values(["a", "k"], kind="stable")
    assert list(got["rank"]) == list(range(1, 2001)) and list(got["k"]) == list(want["k"]) and set(got["total"]) == {2000}
    assert isinstance(got, pd.DataFrame) and metrics.ordinal(df.limit(0), "a", "k").count() == 0
