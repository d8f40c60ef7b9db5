"""Grids, final fits and saved models against exhaustive and plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.operators import dataset, elastic, ml, tuning
from tidewick.operators.boosting import Boosting
from tidewick.sources.forecasts import pick_model
from tidewick.sources.paths import read_json

COLUMNS = ["a", "b", "c"]


def split_table(spark, n=240, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.1] + [0.0, 50.0, 0.0]
    x[:, 2] = (x[:, 2] > 0) * 1.0
    y = np.abs(0.1 + 0.05 * x[:, 0] - 0.001 * x[:, 1] + 0.03 * x[:, 2] + rng.normal(size=n) * 0.01)
    rows = [(i // 2, f"t{i % 2}", "train" if i < 150 else "val" if i < 200 else "test", *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "day int, ticker string, split string, a double, b double, c double, label double")
    return df.withColumn("date", F.date_add(F.lit("2024-01-01"), F.col("day"))).drop("day"), x, y


def plain_net(x, y, alpha, ratio, sweeps=20000):
    """Coordinate descent over the rows themselves."""
    mx, my = x.mean(0), y.mean()
    xc, r = x - mx, y - my
    w = np.zeros(x.shape[1])
    for _ in range(sweeps):
        old = w.copy()
        for j in range(len(w)):
            r = r + xc[:, j] * w[j]
            z, s = xc[:, j] @ r / len(y), xc[:, j] @ xc[:, j] / len(y)
            w[j] = np.sign(z) * max(abs(z) - alpha * ratio, 0) / (s + alpha * (1 - ratio))
            r = r - xc[:, j] * w[j]
        if np.abs(w - old).max() < 1e-13:
            break
    return my - mx @ w, w


def folds_of(df):
    """(train, validation) rows of each fold, by the general fold operator."""
    got = [{role: [(tuple(r[c] for c in COLUMNS), r["label"]) for r in f if r["fold"] == k and r["role"] == role] for role in ("train", "val")} for f in [dataset.folds(df).collect()] for k in (1, 2, 3)]
    return [tuple((np.array([a for a, _ in g[r]]), np.array([b for _, b in g[r]])) for r in ("train", "val")) for g in got]


def mape(y, p):
    return np.mean(np.abs(y - np.maximum(p, 1e-12)) / np.maximum(np.abs(y), 1e-12))


def test_elastic_net_grid_equals_exhaustive_fits(spark):
    df, _, _ = split_table(spark)
    train = df.where("split = 'train'")
    grid = tuning.candidates("en", {"alpha": [1e-4, 1e-2, 1.0], "l1_ratio": [0.05, 0.95]})
    got = tuning.search(train, "en", grid, columns=COLUMNS)
    want = []
    for alpha, ratio in grid:
        scores = []
        for (x, y), (u, v) in folds_of(train):
            b, w = plain_net(x, y, alpha, ratio)
            scores.append((mape(v, b + u @ w), np.abs(v - np.maximum(b + u @ w, 1e-12)).mean()))
        want.append(np.mean(scores, axis=0))
    assert [g[0] for g in got] == grid and np.allclose([g[1:] for g in got], want, rtol=1e-6)
    assert tuning.best_of(got) == grid[int(np.argmin([m for m, _ in want]))]
    assert len(tuning.candidates("en")) == 60 and len(tuning.candidates("gbm")) == 72 and len(tuning.candidates("xgb")) == 256


def test_elastic_net_agrees_with_another_solver(spark):
    df, x, y = split_table(spark)
    m = elastic.moments(df, COLUMNS, "label", [F.lit(1)])[0]
    for alpha, ratio in ((1e-3, 0.2), (1e-5, 0.9), (10.0, 0.5)):
        b, w = elastic.solve(m, alpha, ratio)
        c, v = plain_net(x, y, alpha, ratio)
        assert np.allclose([b, *w], [c, *v], atol=1e-8)
    assert elastic.grid_search(df.limit(0), COLUMNS, "label", [F.lit(1)], [(1.0, 0.5)]) == []


@pytest.mark.parametrize("kind", ["gbm", "xgb"])
def test_boosted_grid_finds_the_winner_of_single_fits(spark, kind):
    df, _, _ = split_table(spark)
    train = df.where("split = 'train'")
    grid = tuning.candidates(kind, {"rounds": [3, 9], "rate": [0.1, 0.3], "rows": [0.7, 1.0]})
    got = tuning.search(train, kind, grid, columns=COLUMNS)
    single = [tuning.search(train, kind, [c], columns=COLUMNS)[0] for c in grid]
    assert np.allclose([g[1:] for g in got], [s[1:] for s in single]) and tuning.best_of(got) == tuning.best_of(single)


def test_training_saves_what_later_steps_read(spark, tmp_path):
    df, x, y = split_table(spark)
    at, small = str(tmp_path / "m"), {"gbm": Boosting(rounds=6, rate=0.3, depth=2, l2=0.0, least_gain=0.0), "xgb": Boosting(rounds=5, rate=0.3, l1=0.01)}
    reports = tuning.train_and_report(df, at, best=small, grids={"en": [(1e-4, 0.5), (5.0, 0.5)]}, columns=COLUMNS)
    assert {"en/deciles", "xgb/alpha", "gbm/overall", "importance"} <= set(reports)
    facts, manifest = read_json(spark, f"{at}/metrics_k10.json"), read_json(spark, f"{at}/model_manifest_k10.json")
    assert manifest["best_en"]["alpha"] == 1e-4 and manifest["best_xgb"]["l1"] == 0.01 and manifest["k_label"] == 10
    test = spark.read.parquet(f"{at}/preds_test_k10.parquet").toPandas()
    assert len(test) == 40 and sorted(test.columns) == ["date", "pred_en", "pred_gbm", "pred_xgb", "ticker", "y_true"]
    b, w = plain_net(x[:200], y[:200], 1e-4, 0.5)
    ratio = np.median(y[:200] / np.maximum(b + x[:200] @ w, 1e-12))
    want = np.sort(np.maximum(b + x[200:] @ w, 1e-12) * ratio)
    assert np.allclose(np.sort(test["pred_en"]), want, rtol=1e-6) and abs(manifest["alpha_en"] - ratio) < 1e-8
    assert abs(facts["en"]["mape_test"] - mape(test["y_true"], test["pred_en"])) < 1e-9
    assert abs(facts["xgb"]["rmse_test"] - np.sqrt(np.mean((test["y_true"] - test["pred_xgb"]) ** 2))) < 1e-9
    assert pick_model(spark, f"{at}/metrics_k10.json") == ("gbm" if facts["gbm"]["rmse_test"] <= facts["en"]["rmse_test"] else "en")
    model, cuts = tuning.load_boosted(spark, at, "xgb", columns=COLUMNS)
    again = tuning.boosting.predict(model, cuts, df.where("split = 'test'"), COLUMNS, ["date", "ticker"]).toPandas().sort_values(["date", "ticker"])
    assert np.allclose(np.maximum(again["prediction"], 1e-12) * manifest["alpha_xgb"], test.sort_values(["date", "ticker"])["pred_xgb"])
    found = {(r["model"], r["feature"]): r for r in tuning.importance_table(spark, at, columns=COLUMNS).collect()}
    assert abs(sum(found["gbm", c]["importance"] for c in COLUMNS) - 1) < 1e-9 and np.allclose([found["en", c]["importance"] for c in COLUMNS], np.abs(w), rtol=1e-5)
    assert found["xgb", "a"]["splits"] > 0 and found["xgb", "a"]["cover"] > 0 and ml.FLOOR == tuning.FLOOR
