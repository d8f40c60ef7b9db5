"""Grids over time folds, final fits and what is saved of them, for elastic nets and two kinds of boosted trees.

A grid is searched in a few passes whatever its size: elastic nets from one pass of moments, boosted trees level by level for
all candidates and folds at once.
"""

from __future__ import annotations

import itertools
from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import read_json, saved, write_json
from ..sources.sinks import save_reports
from . import boosting, dataset, elastic, metrics, ml
from .boosting import BinnedTable, Boosting

# The grids that are searched, the last name varying fastest, and the published best parameters.
ELASTIC_GRID = ml.ELASTIC_GRID
GBM_GRID = {"rounds": [300, 600, 900], "rate": [0.03, 0.06, 0.1], "depth": [2, 3], "rows": [0.7, 1.0], "child": [5, 20]}
XGB_GRID = {"rounds": [400, 700], "rate": [0.05, 0.1], "depth": [3, 4], "rows": [0.7, 1.0], "columns": [0.7, 1.0], "child": [1, 5], "l1": [0.0, 0.1], "l2": [1.0, 5.0]}
GBM = Boosting(rounds=300, rate=0.03, depth=2, rows=0.7, child=20, l2=0.0, least_gain=0.0)
XGB = Boosting(rounds=400, rate=0.05, depth=3, rows=0.7, columns=0.7, child=5)
FLOOR = 1e-12
#: Bins of a feature while a grid is searched; final fits have 256.
GRID_BINS = 64
KINDS = ("en", "gbm", "xgb")


def candidates(kind: str, values: dict[str, list] | None = None) -> list:
    """The grid of a kind: (alpha, l1_ratio) for en, else specifications."""
    grid = values or {"en": ELASTIC_GRID, "gbm": GBM_GRID, "xgb": XGB_GRID}[kind]
    rows = [dict(zip(grid, x, strict=True)) for x in itertools.product(*grid.values())]
    if kind == "en":
        return [(r["alpha"], r["l1_ratio"]) for r in rows]
    common = {"l2": 0.0, "least_gain": 0.0} if kind == "gbm" else {}
    return [Boosting(**(common | r)) for r in rows]


def search(df: DataFrame, kind: str, grid: list, n: int = 4, columns: list[str] | None = None) -> list[tuple[object, float, float]]:
    """(candidate, mape, mae) of a grid: means over the expanding folds of df (date, ticker, label, features) by date."""
    columns = columns or dataset.feature_columns()
    d, roles = saved(dataset.ranked(df), "ranked"), dataset.fold_roles(n)
    if kind == "en":
        return elastic.grid_search(d, columns, "label", roles, grid)
    table = BinnedTable(d, columns, "label", roles, ["date", "ticker"], bins=GRID_BINS)
    try:
        return boosting.grid_search(table, grid)
    finally:
        table.close()


def best_of(found: list[tuple[object, float, float]]):
    """The candidate of least mean MAPE, the first of equal ones."""
    return min(found, key=lambda x: x[1])[0] if found else None


def as_table(spark: SparkSession, kind: str, found: list[tuple[object, float, float]]) -> DataFrame:
    """A row a candidate: its parameters, mape, mae and whether it is the best."""
    names = ["alpha", "l1_ratio"] if kind == "en" else list(GBM_GRID if kind == "gbm" else XGB_GRID)
    best = best_of(found)
    rows = [(*(c if kind == "en" else (asdict(c)[x] for x in names)), m, a, c == best) for c, m, a in found]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c in ('rounds', 'depth', 'child') else 'double'}" for c in names) + ", mape double, mae double, best boolean")


def _forecasts(d: DataFrame, fitted: DataFrame, kind: str, params, columns: list[str], folder: str, k: int) -> DataFrame:
    """d's (date, ticker, split, y, pred) under a model of the fitted rows, which is saved under folder."""
    keep, spark = ["date", "ticker", "split", "label"], d.sparkSession
    if kind == "en":
        m = elastic.moments(fitted, columns, "label", [F.lit(1)])
        b, w = elastic.solve(m[0], *params) if m else (0.0, np.zeros(len(columns)))
        write_json(spark, f"{folder}/models/en_k{k}.json", {"alpha": params[0], "l1_ratio": params[1], "intercept": b, "coefficients": dict(zip(columns, map(float, w), strict=True))})
        line: Column = F.lit(b)
        for c, x in zip(columns, w, strict=True):
            line = line + F.col(c) * F.lit(float(x))
        out = d.select(*keep, line.alias("prediction"))
    else:
        table = BinnedTable(fitted, columns, "label", [F.lit(1)], ["date", "ticker"])
        try:
            (model,), _ = table.fit([(params, 0, ())])
        finally:
            table.close()
        boosting.node_table(model, table.cuts, columns, d).write.mode("overwrite").parquet(f"{folder}/models/{kind}_k{k}.parquet")
        write_json(spark, f"{folder}/models/{kind}_k{k}.json", asdict(params) | {"base": model.base})
        out = boosting.predict(model, table.cuts, d, columns, keep)
    return out.select("date", "ticker", "split", F.col("label").alias("y"), F.greatest("prediction", F.lit(FLOOR)).alias("pred"))


def by_split(forecasts: DataFrame) -> DataFrame:
    """(split, mae, rmse, mape, r2, n) of (split, y, pred), in one aggregation."""
    p = F.greatest("pred", F.lit(FLOOR))
    off = F.abs(F.col("y") - p)
    sse = F.sum(off * off)
    d = forecasts.where("y is not null and pred is not null").groupBy("split")
    return d.agg(F.avg(off).alias("mae"), F.sqrt(sse / F.count(F.lit(1))).alias("rmse"), F.avg(off / F.greatest(F.abs("y"), F.lit(FLOOR))).alias("mape"), (1 - F.try_divide(sse, F.var_pop("y") * F.count(F.lit(1)))).alias("r2"), F.count(F.lit(1)).alias("n"))


def train_all(split: DataFrame, folder: str, k: int = 10, *, best: dict[str, object] | None = None, grids: dict[str, list] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Fits the three models on train and val rows and saves what later steps read; returns (model, split, in_sample, alpha,
    mae, rmse, mape, r2, n).

    best: parameters by kind, else the published ones; grids: candidates by kind that are searched on train rows first.
    Forecasts are at least 1e-12 and scaled by the median ratio on the fitted rows. Under folder: models/{kind}_k{k} (a JSON
    file each, and a table of nodes for trees), preds_val_k{k}.parquet and preds_test_k{k}.parquet (ticker, date, y_true,
    pred_en, pred_gbm, pred_xgb), metrics_k{k}.json and model_manifest_k{k}.json.
    """
    spark, columns = split.sparkSession, columns or dataset.feature_columns()
    params = {"en": (ml.ELASTIC["alpha"], ml.ELASTIC["l1_ratio"]), "gbm": GBM, "xgb": XGB} | (best or {})
    d = saved(split.select("date", "ticker", "split", "label", *columns).na.drop(), "training")
    fitted, manifest, facts, rows, preds = d.where("split <> 'test'"), {"k_label": k, "feature_columns": columns}, {}, [], None
    for kind in KINDS:
        if grids and kind in grids:
            params[kind] = best_of(search(d.where("split = 'train'"), kind, grids[kind], columns=columns))
        p = saved(_forecasts(d, fitted, kind, params[kind], columns, folder, k), f"forecasts-{kind}")
        alpha = metrics.robust_alpha(p.where("split <> 'test'")).first()["alpha"]
        p = p.withColumn("pred", F.col("pred") * alpha)
        facts[kind] = {}
        for r in by_split(p).collect():  # a row a split
            facts[kind] |= {f"{what}_{r['split']}": r[what] for what in ("mae", "rmse", "mape", "r2")}
            rows.append((kind, r["split"], r["split"] != "test", alpha, *(r[c] for c in ("mae", "rmse", "mape", "r2", "n"))))
        manifest |= {f"best_{kind}": dict(zip(("alpha", "l1_ratio"), params[kind], strict=True)) if kind == "en" else asdict(params[kind]), f"alpha_{kind}": alpha}
        named = p.select("ticker", "date", "split", F.col("y").alias("y_true"), F.col("pred").alias(f"pred_{kind}"))
        preds = named if preds is None else preds.join(named.drop("y_true"), ["ticker", "date", "split"])
    preds = saved(preds.where("split <> 'train'"), "forecasts")
    for s in ("val", "test"):
        preds.where(F.col("split") == s).drop("split").write.mode("overwrite").parquet(f"{folder}/preds_{s}_k{k}.parquet")
    write_json(spark, f"{folder}/metrics_k{k}.json", facts)
    write_json(spark, f"{folder}/model_manifest_k{k}.json", manifest)
    return spark.createDataFrame(rows, "model string, split string, in_sample boolean, alpha double, mae double, rmse double, mape double, r2 double, n long")


def load_boosted(spark: SparkSession, folder: str, kind: str, k: int = 10, columns: list[str] | None = None) -> tuple[boosting.Model, list[np.ndarray]]:
    """A saved model of boosted trees, with the cuts that it uses."""
    facts = read_json(spark, f"{folder}/models/{kind}_k{k}.json")
    base = facts.pop("base")
    return boosting.from_nodes(spark.read.parquet(f"{folder}/models/{kind}_k{k}.parquet"), Boosting(**facts), base, columns or dataset.feature_columns())


def importance_table(spark: SparkSession, folder: str, k: int = 10, columns: list[str] | None = None) -> DataFrame:
    """(model, feature, importance, cover, splits) of the saved models: mean gain of xgb's splits, share of gbm's whole gain,
    absolute coefficients of en."""
    columns, rows = columns or dataset.feature_columns(), []
    for kind in ("gbm", "xgb"):
        model, _ = load_boosted(spark, folder, kind, k, columns)
        rows += [(kind, f, share if kind == "gbm" else gain, cover, n) for f, gain, cover, n, share in boosting.importances(model, columns)]
    rows += [("en", f, abs(x), None, None) for f, x in read_json(spark, f"{folder}/models/en_k{k}.json")["coefficients"].items()]
    return spark.createDataFrame(rows, "model string, feature string, importance double, cover double, splits int")


def train_and_report(split: DataFrame, folder: str, k: int = 10, **options) -> dict[str, str]:
    """train_all(), then the reports of each model's test forecasts and the importances as CSV under folder/reports."""
    train_all(split, folder, k, **options)
    spark = split.sparkSession
    preds = spark.read.parquet(f"{folder}/preds_test_k{k}.parquet")
    out = {f"{kind}/{name}": path for kind in KINDS for name, path in save_reports(f"{folder}/reports/{kind}", **ml.report(preds, f"pred_{kind}")).items()}
    return out | save_reports(f"{folder}/reports", importance=importance_table(spark, folder, k, options.get("columns")))
