"""An exploration's tables and summary against the operators that they come from."""

import numpy as np
from pyspark.sql import functions as F

from tidewick.operators import eda
from tidewick.sources.paths import read_json


def test_summary(spark, tmp_path):
    rng = np.random.default_rng(12)
    y = rng.normal(size=150)
    cols = {"a": y + rng.normal(size=150) * 0.2, "b": y * 3, "c": rng.normal(size=150)}
    rows = [(i, f"t{i % 3}", "train" if i < 120 else "test", *(float(v[i]) for v in cols.values()), float(y[i])) for i in range(150)]
    rows += [(200, "t0", "train", None, 1.0, 1.0, 1.0), (201, "t0", "train", float("nan"), 1.0, 1.0, 1.0), (202, "t0", "train", float("inf"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "day int, ticker string, split string, a double, b double, c double, label double").withColumn("date", F.date_add(F.lit("2024-01-01"), F.col("day"))).drop("day")
    paths = eda.explore(df, str(tmp_path), columns=list(cols), top=2, raw=df)
    assert {"spearman", "top", "pairs", "mutual_information", "hist_label", "hist_b", "per_ticker_counts", "missing", "summary"} <= set(paths)
    s = read_json(spark, paths["summary"])
    assert s["n_train_rows"] == 120 and s["n_features"] == 3 and s["k_label"] == 10
    assert list(s["top_features_by_abs_spearman"]) == ["b", "a"] and s["top_features_by_abs_spearman"]["b"] == 1.0
    assert [(p["f1"], p["f2"]) for p in s["redundant_pairs_abs_r_ge_0.90"]] in ([("a", "b")], [("b", "a")])
    assert list(s["mutual_info_topN"]) == ["b", "a"] and s["mutual_info_topN"]["b"] > s["mutual_info_topN"]["a"] > 0
    counts = spark.read.option("header", True).csv(paths["per_ticker_counts"]).select("ticker", F.col("total").cast("long")).collect()
    assert sorted(map(tuple, counts)) == [("t0", 53), ("t1", 50), ("t2", 50)]
    what = {r[0] for r in eda.as_rows(s)}
    assert what == {"rows", "features", "spearman", "pair", "information"}
    empty = eda.explore(df.where("false"), str(tmp_path / "none"), columns=list(cols))
    assert read_json(spark, empty["summary"])["n_train_rows"] == 0
