"""Sinks: partitioned Parquet for tables, CSV for reports, JSON for small facts. Each returns the paths that it wrote."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import saved, write_json
from .readers import STATES


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> str:
    """Parquet, in a folder for each value of `by` (ticker, k, split, symbol). A hot value's rows stay spread over tasks."""
    w = (df.hint("rebalance", by) if by else df).write.mode(mode)
    (w.partitionBy(by) if by else w).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_facts(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A table of few rows as JSON lines in one file."""
    df.coalesce(1).write.mode(mode).json(path)
    return path


@dataclass(frozen=True)
class FeatureSpec:
    """Windows of the features and the rules of imputation, as saved beside a data set."""

    rv: tuple[int, ...] = (5, 10, 20)
    ema: int = 9
    macd: tuple[int, int] = (12, 26)
    macd_lens: int = 21
    slope: int = 20
    vov: int = 10
    shape: int = 20
    drawdown: int = 60
    ewma_decay: float = 0.94
    impute: dict = field(default_factory=lambda: {"window": 20, "least": 3, "least_all": 5})


def save_bars(bars: DataFrame, folder: str, tickers: list[str] | None = None, csv: bool = False) -> dict[str, str]:
    """Bars, closes, log and simple returns, long; with tickers, closes wide too; with csv, all again as CSV."""
    from ..operators.features import log_returns, simple_returns
    from .bars import to_wide

    bars = saved(bars, "bars")  # read again for every table and format
    tables = {
        "ohlc_long": bars,
        "close": bars.select("date", "ticker", "close"),
        "log_returns": log_returns(bars).select("date", "ticker", "ret"),
        "simple_returns": simple_returns(bars, pad=True).select("date", "ticker", "ret"),
    }
    out = {name: write_table(df, f"{folder}/{name}", "ticker") for name, df in tables.items()}
    if tickers:
        tables["close_wide"] = to_wide(bars, tickers)
        out["close_wide"] = write_table(tables["close_wide"], f"{folder}/close_wide")
    return out | ({f"{name}_csv": write_csv(df, f"{folder}/{name}_csv") for name, df in tables.items()} if csv else {})


def save_labels(labels: DataFrame, folder: str) -> str:
    """Labels (date, ticker, k, label) in a folder for each horizon."""
    return write_table(labels, f"{folder}/labels", "k")


def save_features(features: DataFrame, folder: str) -> dict[str, str]:
    """Features as Parquet, and from that as CSV."""
    path = write_table(features, f"{folder}/features_raw_long.parquet")
    return {"parquet": path, "csv": write_csv(features.sparkSession.read.schema(features.schema).parquet(path), f"{folder}/features_raw_long.csv")}


def save_splits(split: DataFrame, folder: str, spec: FeatureSpec = FeatureSpec()) -> dict[str, str]:
    """A data set in a folder for each split, with the splits' sizes and dates, and the features' specification."""
    from dataclasses import asdict

    split = saved(split, "splits")
    rows = split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), F.min("date").alias("start"), F.max("date").alias("end")).collect()  # a row a split
    facts = {r["split"]: {"rows": r["rows"], "tickers": r["tickers"], "start": str(r["start"]), "end": str(r["end"])} for r in rows}
    facts["features"] = [c for c in split.columns if c not in ("date", "ticker", "split", "label")]
    spark = split.sparkSession
    return {
        "splits": write_table(split, f"{folder}/splits", "split"),
        "split_meta": write_json(spark, f"{folder}/split_meta.json", facts),
        "feature_spec": write_json(spark, f"{folder}/feature_spec.json", asdict(spec)),
    }


def save_scaler(split: DataFrame, columns: list[str], folder: str) -> str:
    """Means and deviations of the training rows by feature."""
    from ..operators.dataset import scaler

    row = scaler(split, columns).first()  # two numbers a feature
    return write_json(split.sparkSession, f"{folder}/scaler_stats.json", {c: {"mean": row[f"{c}_mu"], "std": row[f"{c}_sd"]} for c in columns})


def save_regimes(folder: str, *, features: DataFrame | None = None, labels: DataFrame | None = None, state: DataFrame | None = None, transitions: DataFrame | None = None, hazards: DataFrame | None = None) -> dict[str, str]:
    """Regime tables; transitions wide and with six decimals, as text."""
    out = {}
    for name, df in (("regime_features", features), ("labels", labels), ("daily_state", state)):
        if df is not None:
            out[name] = write_table(df, f"{folder}/{name}")
    if transitions is not None:
        six = transitions.groupBy(F.col("from_state").alias("state")).pivot("to_state", list(STATES)).agg(F.format_string("%.6f", F.first("prob")))
        out["transitions"] = write_csv(six, f"{folder}/transitions")
    if hazards is not None:
        out["hazards"] = write_csv(hazards, f"{folder}/hazards")
    return out


def save_legacy_vectors(vectors: DataFrame, weights: DataFrame, folder: str, *, notional: float, leverage: float, risk: float, decays: list[float]) -> dict[str, str]:
    """Newest-first vectors in a folder for each ticker, and a summary row of each ticker's newest values and parameters.

    weights (ticker, portw, mult); sizes of `vectors` are for a weight of 1 and no multiplier.
    """
    size = F.col("position_size") * F.col("portw") / F.col("mult")
    now = vectors.where("idx = 0").join(weights, "ticker")
    summary = now.select(
        F.col("ticker").alias("symbol"), F.col("pred_vol").alias("pred_vol_scalar_t0"), size.alias("pos_size_scalar_t0"), F.lit("|".join(map(str, decays))).alias("weights32"),
        F.lit(notional).alias("notional"), F.lit(leverage).alias("leverage"), F.lit(risk).alias("risk_fraction"), "portw", F.col("mult").alias("multiplier"),
    )
    d = vectors.join(weights, "ticker").withColumn("position_size", size).drop("portw", "mult")
    return {"vectors": write_table(d, f"{folder}/vectors", "ticker"), "summary": write_csv(summary, f"{folder}/summary")}


def save_reports(folder: str, **reports: DataFrame) -> dict[str, str]:
    """Reports of few rows, each as CSV under its name."""
    return {name: write_csv(df.coalesce(1), f"{folder}/{name}") for name, df in reports.items()}


def per_ticker(df: DataFrame, path: str) -> str:
    """A folder for each ticker, rows by date within its files."""
    df.hint("rebalance", "ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("ticker").parquet(path)
    return path


