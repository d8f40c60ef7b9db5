"""Reports of single fits: how many jobs they take, and against the fits and plain errors they are made of."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.operators import boosting, dataset, ml, tuning


@pytest.fixture(scope="module")
def split_set(spark):
    rng, names = np.random.default_rng(8), dataset.feature_columns()
    x = rng.normal(size=(400, len(names)))
    y = np.abs(0.5 + 0.2 * x[:, 0] + 0.1 * (x[:, 3] > 0) + rng.normal(size=400) * 0.02)
    rows = [(dt.date(2021, 1, 1) + dt.timedelta(i // 2), f"t{i % 2}", "train" if i < 200 else "val" if i < 300 else "test", *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "date date, ticker string, split string, " + ", ".join(f"{c} double" for c in names) + ", label double").cache()


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_boosted_report_takes_no_jobs_per_tree(spark, split_set):
    found, many = jobs(spark, "report", lambda: ml.fit_report(split_set, "gbt").collect())
    assert many < ml.BOOSTED["maxIter"] / 2
    names = dataset.feature_columns()
    d = dataset.scale(dataset.winsorize(split_set, dataset.winsor_columns(names)), names).cache()
    p = boosting.predict(*ml.fit_boosted(d.where("split <> 'test'")), d, names, ["split", "label"]).toPandas()
    p["prediction"] = p["prediction"].clip(lower=ml.FLOOR)
    known = p[p["split"] != "test"]
    p["prediction"] *= (known["label"] / known["prediction"]).median()
    assert [(r["model"], r["split"], r["in_sample"]) for r in found] == [("gbt", s, s != "test") for s in ml.SPLITS]
    for r in found:
        q = p[p["split"] == r["split"]]
        assert r["n"] == len(q) and r["mae"] == pytest.approx((q["label"] - q["prediction"]).abs().mean()) and r["r2"] > 0.5


def test_published_trees_are_those_of_the_final_fits(spark, split_set):
    model, _ = ml.fit_boosted(split_set.where("split <> 'test'"))
    assert model.spec == tuning.GBM and len(model.trees) == 300
    assert model.base == pytest.approx(split_set.where("split <> 'test'").agg(F.avg("label")).first()[0])


def test_importance_takes_no_jobs_per_tree(spark, split_set):
    found, many = jobs(spark, "importance", lambda: ml.importance(split_set).collect())
    by = {r["feature"]: r for r in found}
    assert many < ml.BOOSTED["maxIter"] / 2 and [r["feature"] for r in found] == dataset.feature_columns()
    assert sum(r["gbt"] for r in found) == pytest.approx(1.0) and max(found, key=lambda r: r["gbt"])["feature"] == dataset.feature_columns()[0]
    assert by[dataset.feature_columns()[3]]["gbt"] > 0.05
