"""Readers of saved tables, and the choices between a saved table and its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import UNBOUNDED, by_ticker
from .bars import price
from .paths import read_if_there, read_json, read_table

# The regime states in their order.
STATES = ("risk_off", "neutral", "risk_on")


def adjusted_close(bars: DataFrame, *, fill: bool = True, start: str | None = None, end: str | None = None) -> DataFrame:
    """(ticker, date, price) by adj_close, else close; gaps carry the last price forward (fill). Tickers without any price have no rows."""
    d = price(bars, "adj_close")
    d = d.where(F.col("date") >= F.lit(start).cast("date")) if start else d
    d = d.where(F.col("date") <= F.lit(end).cast("date")) if end else d
    known = F.max(F.col("price").isNotNull()).over(Window.partitionBy("ticker"))
    d = d.withColumn("known", known).where("known").drop("known")
    return d.withColumn("price", F.last("price", ignorenulls=True).over(by_ticker().rowsBetween(UNBOUNDED, 0))) if fill else d


def newest_first(bars: DataFrame) -> DataFrame:
    """(ticker, idx, date, price): adjusted closes without gaps, idx 0 the newest."""
    d = adjusted_close(bars, fill=False).where("price is not null")
    return d.select("ticker", (F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))) - 1).alias("idx"), "date", "price")


def close_with_fallback(spark: SparkSession, cache: str, source: DataFrame, tickers: list[str]) -> DataFrame:
    """(ticker, date, price) of the wanted tickers: the cache's closes, and the source's adjusted ones of tickers that the cache lacks.

    cache is a long table (ticker, date, close) or missing. Of repeated (ticker, date) in the cache the largest close stays.
    """
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in tickers], "ticker string"))  # the portfolio's list
    rest = adjusted_close(source, fill=False).join(wanted, "ticker", "left_semi")
    held = read_if_there(spark, cache)
    if held is None:
        return rest
    held = held.join(wanted, "ticker", "left_semi").groupBy("ticker", F.to_date("date").alias("date")).agg(F.max("close").alias("price"))
    return held.unionByName(rest.join(held.select("ticker").distinct(), "ticker", "left_anti"))


def labels_of(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """(date, ticker, label) of one horizon, from the labels' partition of it."""
    return spark.read.parquet(f"{folder}/labels").where(F.col("k") == k).select("date", "ticker", "label")


def returns_or_close(spark: SparkSession, folder: str) -> DataFrame:
    """(date, ticker, ret): the saved log returns, else those of the saved closes; FileNotFoundError without either."""
    from ..operators.features import log_returns

    saved = read_if_there(spark, f"{folder}/log_returns")
    if saved is not None:
        return saved.select("date", "ticker", "ret")
    close = read_if_there(spark, f"{folder}/close")
    if close is None:
        raise FileNotFoundError(f"neither log_returns nor close under {folder}")
    return log_returns(close.where("close is not null")).select("date", "ticker", "ret")


def splits(spark: SparkSession, folder: str, part: str | None = None) -> DataFrame:
    """Rows of a saved data set, of one split or of all, with their keys and label."""
    d = spark.read.parquet(f"{folder}/splits")
    return d.where(F.col("split") == part) if part else d


def split_facts(spark: SparkSession, folder: str) -> dict:
    """The saved facts of a data set's splits; empty without any."""
    return read_json(spark, f"{folder}/split_meta.json") or {}


def raw_features(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/features_raw_long")


def transition_table(spark: SparkSession, folder: str) -> DataFrame:
    """(from_state, to_state, prob) of a saved table with a column for each state: all nine pairs, null where one is missing."""
    d = spark.read.option("header", True).csv(f"{folder}/transitions")
    d = d.select("state", *((F.col(s) if s in d.columns else F.lit(None)).cast("double").alias(s) for s in STATES))
    grid = spark.createDataFrame([(s,) for s in STATES], "state string").join(d, "state", "left")
    return grid.unpivot("state", list(STATES), "to_state", "prob").withColumnRenamed("state", "from_state")


def daily_states(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/daily_state").select("date", "state")
