"""What is looked at before models are fitted: one run over a data set, saved as tables and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.paths import saved, write_json
from ..sources.sinks import save_reports
from . import dataset, metrics
from .information import mutual_information


def explore(split: DataFrame, folder: str, *, k: int = 10, columns: list[str] | None = None, top: int = 15, raw: DataFrame | None = None, redundant: float = 0.9) -> dict[str, str]:
    """Writes the tables of an exploration of the training rows, and eda_k{k}_summary.json; returns their paths.

    split has (date, ticker, split, label, features); raw, the features before imputation, adds their missing rates. Rows
    with a null, NaN or infinity in a feature or the label are left out, as for training. Tables under eda_k{k}: spearman
    (all features), top (the `top` of largest absolute rank correlation), pairs of those whose ranks correlate at
    `redundant` or more, mutual_information of those, hist_label, hist_{feature} with the central part marked,
    per_ticker_counts and missing. The summary has numbers of rows and features, the top correlations and pairs to four
    digits, the mutual information, and the tables' names.
    """
    columns, spark = columns or dataset.feature_columns(), split.sparkSession
    train = saved(dataset.clean(split.where("split = 'train'"), [*columns, "label"]), "eda-train")
    rho = saved(metrics.spearman(train, columns, "label"), "eda-rho")
    best = metrics.top_features(rho, top).orderBy("place").collect()  # `top` rows
    names = [r["feature"] for r in best if r["rho"] is not None]
    pairs = metrics.correlated_pairs(train, names, redundant).collect() if len(names) > 1 else []  # pairs of the top
    info = mutual_information(train, names).collect() if names else []
    tables = {
        "spearman": rho,
        "top": spark.createDataFrame([(r["place"], r["feature"], r["rho"]) for r in best], "place int, feature string, rho double"),
        "pairs": spark.createDataFrame([tuple(r) for r in pairs], "a string, b string, rho double"),
        "mutual_information": spark.createDataFrame([tuple(r) for r in info], "feature string, mi double"),
        "hist_label": metrics.histogram(train, "label"),
        "per_ticker_counts": dataset.split_counts(split),
    }
    tables |= {f"hist_{c}": metrics.central_histogram(train, c) for c in names}
    if raw is not None:
        tables["missing"] = dataset.missing_rates(raw, columns)
    paths = save_reports(f"{folder}/eda_k{k}", **tables)
    summary = {
        "k_label": k,
        "n_train_rows": train.count(),
        "n_features": len(columns),
        "top_features_by_abs_spearman": {r["feature"]: None if r["rho"] is None else round(r["rho"], 4) for r in best},
        f"redundant_pairs_abs_r_ge_{redundant:.2f}": [{"f1": r["a"], "f2": r["b"], "rho": round(r["rho"], 4)} for r in pairs],
        "mutual_info_topN": {r["feature"]: r["mi"] for r in sorted(info, key=lambda r: -r["mi"])},
        "files": {name: path.rsplit("/", 1)[-1] for name, path in paths.items()},
    }
    return paths | {"summary": write_json(spark, f"{folder}/eda_k{k}_summary.json", summary)}


def as_rows(summary: dict) -> list[tuple[str, str, float]]:
    """A summary's numbers as (what, name, value)."""
    pairs = next((v for key, v in summary.items() if key.startswith("redundant_pairs")), [])
    rows = [("rows", "train", float(summary["n_train_rows"])), ("features", "all", float(summary["n_features"]))]
    rows += [("spearman", f, v) for f, v in summary["top_features_by_abs_spearman"].items()]
    rows += [("pair", f"{p['f1']}|{p['f2']}", p["rho"]) for p in pairs]
    return rows + [("information", f, v) for f, v in summary["mutual_info_topN"].items()]


