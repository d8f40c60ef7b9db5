"""Queries over fitted models: grids, final fits, saved forecasts and importances. SQL can't express the fits; tests hold them to
plain versions. What is read back of saved forecasts has SQL where the forecasts are made by SQL as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, eda, features, information, tuning
from ..sources import bars as src
from ..sources.forecasts import pick_model
from ..sources.paths import read_json, saved, shared_folder
from . import files, oracle as q  # files: its queries are in the same catalog
from .catalog import ORACLES, QUERIES, _dataset, query, rounded


def _prepared(spark, sf_dir):
    """The data set, clipped and scaled by its training rows."""
    d, columns = saved(_dataset(spark, sf_dir), "dataset"), dataset.feature_columns()
    return saved(dataset.scale(dataset.winsorize(d, dataset.winsor_columns(columns)), columns), "prepared")


def _grid(spark, sf_dir, kind):
    d = _prepared(spark, sf_dir).where("split = 'train'")
    return tuning.as_table(spark, kind, tuning.search(d, kind, tuning.candidates(kind)))


@query()
def elasticnet_grid(spark, sf_dir):
    """All 60 candidates by mean errors over three time folds of the training rows."""
    return _grid(spark, sf_dir, "en")


@query()
def gbm_grid(spark, sf_dir):
    """All 72 candidates of the first kind of boosted trees."""
    return _grid(spark, sf_dir, "gbm")


@query()
def xgb_grid(spark, sf_dir):
    """All 256 candidates of the second kind, with L1 and L2 weights and sampled columns."""
    return _grid(spark, sf_dir, "xgb")


@query()
def trained_metrics(spark, sf_dir):
    """Errors of the three models with the published parameters, fitted on train and val, and the model that a later step picks."""
    at = shared_folder(spark, "trained")
    found = tuning.train_all(_prepared(spark, sf_dir), at)
    return found.withColumn("picked", F.col("model") == pick_model(spark, f"{at}/metrics_k10.json"))


@query()
def trained_importance(spark, sf_dir):
    """Mean gain and cover of the splits on each feature, gain shares, and absolute coefficients, of the saved models."""
    at = shared_folder(spark, "trained")
    tuning.train_all(_prepared(spark, sf_dir), at)
    return tuning.importance_table(spark, at)


_NUM = list(features.NUMERIC)
_PSI = "(ln({m} + 6) - 1 / (2 * ({m} + 6)) - 1 / (12 * ({m} + 6) ** 2) + 1 / (120 * ({m} + 6) ** 4) - 1 / (252 * ({m} + 6) ** 6)" + "".join(f" - 1 / ({{m}} + {j})" for j in range(6)) + ")"


@query(f"""{q.DATASET}, mi_t AS (SELECT row_number() OVER () AS i, * FROM s WHERE split = 'train'),
mi_s AS (SELECT i, label / (SELECT stddev_pop(label) FROM mi_t) AS y, {", ".join(f"{c} / (SELECT stddev_pop({c}) FROM mi_t) AS {c}" for c in _NUM)} FROM mi_t),
mi_p AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, i, {c} AS x, y FROM mi_s" for c in _NUM)}),
mi_d AS (SELECT a.feature, a.i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM mi_p a JOIN mi_p b ON a.feature = b.feature AND a.i <> b.i),
mi_r AS (SELECT feature, i, min(greatest(dx, dy), 3)[3] AS r FROM mi_d GROUP BY feature, i),
mi_n AS (SELECT feature, i, count(*) FILTER (dx < r OR dx = 0 AND r = 0) + 1.0 AS nx, count(*) FILTER (dy < r OR dy = 0 AND r = 0) + 1.0 AS ny FROM mi_d JOIN mi_r USING (feature, i) GROUP BY feature, i)
SELECT feature, round(greatest(0, (SELECT {_PSI.format(m="count(*)")} FROM mi_t) + {_PSI.format(m="3.0")} - avg({_PSI.format(m="nx")} + {_PSI.format(m="ny")})), 4) AS mi FROM mi_n GROUP BY feature""")
def mutual_info(spark, sf_dir):
    """Nearest-neighbour mutual information of each numeric feature with the label, on the training rows."""
    d = saved(_dataset(spark, sf_dir), "dataset").where("split = 'train'")
    return rounded(information.mutual_information(d, _NUM), 4, "mi")


@query()
def eda_summary(spark, sf_dir):
    """The numbers of a saved exploration: rows, top rank correlations, redundant pairs, mutual information."""
    at, b = shared_folder(spark, "eda"), src.daily(spark, sf_dir)
    eda.explore(saved(_dataset(spark, sf_dir), "dataset"), at, columns=_NUM, raw=features.build(b))
    return spark.createDataFrame(eda.as_rows(read_json(spark, f"{at}/eda_k10_summary.json")), "what string, name string, value double")


__all__ = ["ORACLES", "QUERIES", "files"]
