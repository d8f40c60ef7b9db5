"""Model fits on split data sets. Keys stay on every table; validation and test rows are never fitted unless asked for."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.paths import saved, write_json
from . import boosting, dataset, metrics

FLOOR = 1e-12
SPLITS = ("train", "val", "test")
KINDS = {"elasticnet": "en", "gbt": "gbm"}
# Published best parameters.
ELASTIC = {"alpha": 8.111e-4, "l1_ratio": 0.2}
# The grids that are searched.
ELASTIC_GRID = {"alpha": [10 ** (-4 + 5 * i / 11) for i in range(12)], "l1_ratio": [0.05, 0.2, 0.5, 0.8, 0.95]}
BOOSTED_GRID = {"maxIter": [300, 600, 900], "stepSize": [0.03, 0.06, 0.1], "maxDepth": [2, 3], "subsamplingRate": [0.7, 1.0], "minInstancesPerNode": [5, 20]}
BOOSTED = {"maxIter": 300, "stepSize": 0.03, "maxDepth": 2, "subsamplingRate": 0.7, "minInstancesPerNode": 20, "seed": 17}


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=dataset.feature_columns(), outputCol="features")


def elastic_net(train: DataFrame, alpha: float, l1_ratio: float) -> LinearRegression:
    """Elastic net with the objective 1/2n |y - Xb|^2 + alpha (l1 |b| + (1 - l1)/2 |b|^2): the estimator scales the
    label itself, so its L2 part is taken by the label's deviation."""
    sd = train.agg(F.stddev_samp("label")).first()[0] or 1.0
    lam = alpha * l1_ratio + sd * alpha * (1 - l1_ratio)
    return LinearRegression(labelCol="label", regParam=lam, elasticNetParam=alpha * l1_ratio / lam if lam else 0.0, standardization=False, maxIter=200)


def grid(values: dict[str, list]) -> list[dict]:
    """All combinations of a grid's values, the last name varying fastest."""
    return [dict(zip(values, x, strict=True)) for x in itertools.product(*values.values())]


def fit(train: DataFrame, kind: str, **params):
    """A fitted pipeline; kind is elasticnet or gbt."""
    est = elastic_net(train, **(ELASTIC | params)) if kind == "elasticnet" else GBTRegressor(labelCol="label", **(BOOSTED | params))
    return Pipeline(stages=[_assembler(), est]).fit(train)


def tune(df: DataFrame, kind: str, candidates: list[dict], n: int = 4) -> dict:
    """The grid's parameters of least mean MAPE over expanding folds by date."""
    folds = dataset.folds(df, n).hint("rebalance").cache()
    try:
        ids = [r["fold"] for r in folds.select("fold").distinct().collect()]
        best = None
        for params in candidates:
            total = 0.0
            for k in ids:
                model = fit(folds.where((F.col("fold") == k) & (F.col("role") == "train")), kind, **params)
                total += metrics.regression_metrics(predict(model, folds.where((F.col("fold") == k) & (F.col("role") == "val")))).first()["mape"]
            if best is None or total < best[0]:
                best = (total, params)
        return best[1]
    finally:
        folds.unpersist()


def predict(model, df: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(date, ticker, y, pred) with forecasts of at least 1e-12."""
    return model.transform(df).select("date", "ticker", F.col("label").alias("y"), (F.greatest("prediction", F.lit(FLOOR)) * alpha).alias("pred"))


def fit_boosted(train: DataFrame) -> tuple[boosting.Model, list[np.ndarray]]:
    """The boosted trees of the published parameters and the cuts of their features. The mean label comes first and every tree
    is shrunk, as published; one job grows all trees of a table of small bins, where Spark's estimator takes jobs for each tree."""
    b = BOOSTED
    spec = boosting.Boosting(b["maxIter"], b["stepSize"], b["maxDepth"], l2=0.0, child=b["minInstancesPerNode"], rows=b["subsamplingRate"], least_gain=0.0, seed=b["seed"])
    table = boosting.BinnedTable(train, dataset.feature_columns(), "label", [F.lit(1)], ["date", "ticker"])
    try:
        (model,), _ = table.fit([(spec, 0, ())])
    finally:
        table.close()
    return model, table.cuts


def _forecasts(d: DataFrame, fitted: DataFrame, kind: str) -> DataFrame:
    """d's (date, ticker, split, y, pred) under a model of the fitted rows, forecasts of at least 1e-12."""
    keep, columns = ["date", "ticker", "split", "label"], dataset.feature_columns()
    out = boosting.predict(*fit_boosted(fitted), d, columns, keep) if kind == "gbt" else fit(fitted, kind).transform(d)
    return out.select("date", "ticker", "split", F.col("label").alias("y"), F.greatest("prediction", F.lit(FLOOR)).alias("pred"))


def fit_report(split: DataFrame, kind: str) -> DataFrame:
    """(model, split, in_sample, mae, rmse, mape, r2, n): fitted on train and val as published, so only test is out of sample."""
    d = saved(dataset.scale(dataset.winsorize(split, dataset.winsor_columns(dataset.feature_columns())), dataset.feature_columns()), "scaled")
    p = saved(_forecasts(d, d.where("split <> 'test'"), kind), "forecasts")
    alpha = metrics.robust_alpha(p.where("split <> 'test'")).first()["alpha"]
    out = None
    for s in SPLITS:
        m = metrics.regression_metrics(p.where(F.col("split") == s).withColumn("pred", F.col("pred") * alpha)).select(F.lit(kind).alias("model"), F.lit(s).alias("split"), F.lit(s != "test").alias("in_sample"), "*")
        out = m if out is None else out.unionByName(m)
    return split.sparkSession.createDataFrame(out.collect(), out.schema)  # a row a split


def train(split: DataFrame, folder: str, k: int = 10, tuned: dict[str, list[dict]] | None = None) -> DataFrame:
    """Tunes (kinds with candidates in `tuned`, on train rows), fits on train and val, and saves what later steps read.

    Under folder: models/{kind}_k{k}, preds_val_k{k}.parquet and preds_test_k{k}.parquet (ticker, date, y_true, pred_en,
    pred_gbm), metrics_k{k}.json and model_manifest_k{k}.json. Returns the metrics (model, split, in_sample, ...).
    """
    spark = split.sparkSession
    d = split.hint("rebalance").cache()  # partitions by size: each tree is several jobs over all of them
    rows, manifest, facts, preds = [], {"k_label": k, "feature_columns": dataset.feature_columns()}, {}, None
    for kind, name in KINDS.items():
        candidates = (tuned or {}).get(kind)
        best = tune(d.where("split = 'train'"), kind, candidates) if candidates else {}
        model = fit(d.where("split <> 'test'"), kind, **best)
        model.write().overwrite().save(f"{folder}/models/{kind}_k{k}")
        alpha = metrics.robust_alpha(predict(model, d.where("split <> 'test'"))).first()["alpha"]
        manifest |= {f"best_{name}": best or (ELASTIC if kind == "elasticnet" else BOOSTED), f"alpha_{name}": alpha}
        facts[name] = {}
        for s in SPLITS:
            m = metrics.regression_metrics(predict(model, d.where(F.col("split") == s))).first()
            facts[name] |= {f"{what}_{s}": m[what] for what in ("mae", "rmse", "mape", "r2")}
            rows.append((name, s, s != "test", *(m[c] for c in ("mae", "rmse", "mape", "r2", "n"))))
        p = model.transform(d.where("split <> 'train'")).select("ticker", "date", "split", F.col("label").alias("y_true"), F.greatest("prediction", F.lit(FLOOR)).alias(f"pred_{name}"))
        preds = p if preds is None else preds.join(p.drop("y_true"), ["ticker", "date", "split"])
    for s in ("val", "test"):
        preds.where(F.col("split") == s).drop("split").write.mode("overwrite").parquet(f"{folder}/preds_{s}_k{k}.parquet")
    write_json(spark, f"{folder}/metrics_k{k}.json", facts)
    write_json(spark, f"{folder}/model_manifest_k{k}.json", manifest)
    d.unpersist()
    return spark.createDataFrame(rows, "model string, split string, in_sample boolean, mae double, rmse double, mape double, r2 double, n long")


def load_model(folder: str, kind: str, k: int = 10) -> PipelineModel:
    return PipelineModel.load(f"{folder}/models/{kind}_k{k}")


def report(preds: DataFrame, model: str = "pred_gbm") -> dict[str, DataFrame]:
    """What is reported of saved forecasts (ticker, date, y_true, pred_...): deciles, errors by ticker and in all, lift,
    calibration slope and factor, residuals and rolling errors, each a table."""
    d = preds.select("ticker", "date", F.col("y_true").alias("y"), F.col(model).alias("pred"))
    deciles = metrics.deciles(d)
    return {
        "deciles": deciles,
        "by_ticker": metrics.by_ticker_metrics(d),
        "overall": metrics.regression_metrics(d),
        "lift": metrics.top_decile_lift(deciles),
        "slope": metrics.calibration_slope(d),
        "alpha": metrics.robust_alpha(d),
        "residuals": metrics.histogram(d.select((F.col("y") - F.col("pred")).alias("residual")), "residual", 40),
        "rolling": metrics.rolling_mape(d),
    }


def importance(split: DataFrame) -> DataFrame:
    """(feature, gbt, elasticnet): share of the trees' whole gain and absolute coefficient."""
    columns = dataset.feature_columns()
    d = saved(dataset.scale(split, columns).where("split <> 'test'"), "scaled")
    g, e = boosting.importances(fit_boosted(d)[0], columns), fit(d, "elasticnet").stages[-1].coefficients.toArray()
    rows = [(c, share, float(abs(b))) for (c, *_, share), b in zip(g, e, strict=True)]
    return split.sparkSession.createDataFrame(rows, "feature string, gbt double, elasticnet double")


def rank_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, rho): rank correlations of all feature pairs."""
    v = VectorAssembler(inputCols=features, outputCol="v").transform(df.na.drop(how="any", subset=features))
    m = Correlation.corr(v, "v", "spearman").first()[0].toArray()
    return df.sparkSession.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(features) for j, b in enumerate(features)], "a string, b string, rho double")
