"""Ordered per-ticker features: windows in one pass over a partitioning by ticker, recursions by ticker groups."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import UNBOUNDED, adjusted_kurtosis, adjusted_skewness, by_ticker, roll
from ..functions.scans import CHUNK_DAYS, Average, averages

NUMERIC = ("park_d", "ema9", "macd21", "slope20", "rv5", "rv10", "rv20", "ewma94", "d_rv10", "vov", "skew20", "kurt20", "dd60")
#: Fewest bars of a ticker before a feature counts.
HISTORY = {"park_d": 1, "ema9": 9, "macd21": 26, "slope20": 20, "rv5": 6, "rv10": 11, "rv20": 21, "ewma94": 11, "d_rv10": 12, "vov": 20, "skew20": 21, "kurt20": 21, "dd60": 60}
DAYS = tuple(f"dow_{i}" for i in range(7))
MONTHS = tuple(f"mon_{i}" for i in range(1, 13))


def log_returns(bars: DataFrame, price: str = "close") -> DataFrame:
    """bars with rn (1, 2, ... by date) and ret, the log return; null for a first bar and prices that aren't positive."""
    w = by_ticker()
    x = F.when(F.col(price) > 0, F.log(price))
    return bars.withColumn("rn", F.row_number().over(w)).withColumn("ret", x - F.lag(x).over(w))


def simple_returns(bars: DataFrame, pad: bool, price: str = "close") -> DataFrame:
    """bars with ret, the relative change; a gap is filled with the last price first (pad) or makes two nulls."""
    w = by_ticker()
    x = F.last(price, ignorenulls=True).over(w.rowsBetween(UNBOUNDED, 0)) if pad else F.col(price)
    d = bars.withColumn("__x", x)
    return d.withColumn("ret", F.try_divide(F.col("__x"), F.lag("__x").over(w)) - 1).drop("__x")


def _square(c: str = "ret") -> Column:
    return F.col(c) * F.col(c)


def realized_vol(returns: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    """rv{k}: root mean square of the last k returns."""
    return returns.select("*", *(F.sqrt(roll(F.sum, _square(), 1 - k, 0, k) / k).alias(f"rv{k}") for k in ks))


def realized_vol_sum(returns: DataFrame, k: int) -> DataFrame:
    """rvs{k}: root of the sum of the last k squared returns."""
    return returns.withColumn(f"rvs{k}", F.sqrt(roll(F.sum, _square(), 1 - k, 0, k)))


def forward_labels(returns: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    """(date, ticker, k, label): root mean square of the next k returns, null without all of them."""
    cols = returns.select("date", "ticker", *(F.sqrt(roll(F.sum, _square(), 1, k, k) / k).alias(f"k{k}") for k in ks))
    return cols.select("date", "ticker", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("label")) for k in ks))).alias("x")).select("date", "ticker", "x.*")


def parkinson() -> Column:
    """Daily sigma from the range; null unless high and low are positive."""
    r = F.when((F.col("high") > 0) & (F.col("low") > 0), F.log(F.col("high") / F.col("low")))
    return F.sqrt(r * r / (4 * math.log(2)))


def vol_of_vol(vols: DataFrame) -> DataFrame:
    """d_rv10 and vov, the change of rv10 and its sample deviation over 10 bars."""
    return vols.withColumn("d_rv10", F.col("rv10") - F.lag("rv10").over(by_ticker())).withColumn("vov", roll(F.stddev_samp, "rv10", -9, 0, 10))


def shape(returns: DataFrame, n: int = 20) -> DataFrame:
    """skew20 and kurt20, bias-corrected, of the last n returns."""
    frame = by_ticker().rowsBetween(1 - n, 0)
    full = F.count("ret").over(frame) == n
    return returns.withColumn("skew20", F.when(full, adjusted_skewness(F.col("ret"), frame))).withColumn("kurt20", F.when(full, adjusted_kurtosis(F.col("ret"), frame)))


def slope(bars: DataFrame, n: int = 20) -> DataFrame:
    """slope20: least-squares slope of the log price on the last n bars."""
    frame = by_ticker().rowsBetween(1 - n, 0)
    return bars.withColumn("__y", F.log("close")).withColumn("slope20", F.when(F.count("__y").over(frame) == n, F.regr_slope("__y", "rn").over(frame))).drop("__y")


def drawdown(bars: DataFrame, n: int = 60) -> DataFrame:
    """dd60: distance from the highest close of the last n bars, from one bar on."""
    return bars.withColumn("dd60", F.col("close") / F.max("close").over(by_ticker().rowsBetween(1 - n, 0)) - 1)


def calendar_columns() -> list[Column]:
    """One-hot weekday (Monday 0) and month, with a fixed vocabulary."""
    return [*(F.when(F.weekday("date") == i, 1.0).otherwise(0.0).alias(f"dow_{i}") for i in range(7)), *(F.when(F.month("date") == i, 1.0).otherwise(0.0).alias(f"mon_{i}") for i in range(1, 13))]


def by_groups(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], added: str, order: str = "date") -> DataFrame:
    """Adds columns that a function makes of each ticker's rows in order: for recursions that windows can't express, O(n)."""
    names = df.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        return pd.concat([part[names], fn(part)], axis=1)

    return df.groupBy("ticker").applyInPandas(run, schema)


def ema(x: pd.Series, span: int | None = None, alpha: float | None = None, least: int = 0) -> pd.Series:
    """e(1) = x(1), e(t) = a x(t) + (1 - a) e(t-1); a gap decays by elapsed rows; null before `least` values."""
    return x.ewm(span=span, alpha=alpha, adjust=False, min_periods=least).mean()


def recursive(returns: DataFrame, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """ema9, macd (12/26), macd_signal (9), macd21 (EMA of macd) and ewma94 (root EMA of squared returns)."""
    close = lambda n: Average.span("close", n, n)
    d = averages(returns.withColumn("__square", F.col("ret") * F.col("ret")), {"ema9": close(9), "__e12": close(12), "__e26": close(26), "__e94": Average("__square", 1 - 0.94, 10)}, chunk_days=chunk_days)
    d = d.withColumn("macd", F.col("__e12") - F.col("__e26"))
    d = averages(d, {"macd_signal": Average.span("macd", 9, 9), "macd21": Average.span("macd", 21, 21)}, chunk_days=chunk_days)
    return d.select(*returns.columns, "ema9", "macd", "macd_signal", "macd21", F.sqrt("__e94").alias("ewma94"))


def past_median(df: DataFrame, columns: list[str], n: int = 20, least: int = 3, least_all: int = 5) -> DataFrame:
    """Nulls become the median of the previous n rows (at least `least` values), else of all previous ones (`least_all`).

    By ticker groups: a running median keeps its sorted window, where a window expression sorts every frame anew.
    """
    names = df.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date", kind="stable").reset_index(drop=True)
        for c in columns:
            x = part[c].astype("float64")
            if x.isna().any():
                past = x.shift(1)
                y = x.fillna(past.rolling(n, min_periods=least).median())
                part[c] = y.fillna(past.expanding(least_all).median()) if y.isna().any() else y
        return part[names]

    return df.groupBy("ticker").applyInPandas(run, df.schema)


def build(bars: DataFrame, k: int = 10, impute: bool = False) -> DataFrame:
    """(date, ticker, 13 numeric features, 19 calendar columns, label): one exchange by ticker.

    Prices are the adjusted closes, closes where there is none. A feature is null before its history is complete. With impute, later nulls are filled from the past; rows that
    still lack a feature or the label go.
    """
    d = log_returns(bars.withColumn("close", F.coalesce("adj_close", "close")).where("close is not null"))
    d = recursive(d)
    d = realized_vol(d)
    d = drawdown(slope(shape(vol_of_vol(d)))).withColumn("park_d", parkinson())
    d = d.withColumn("label", F.sqrt(roll(F.sum, _square(), 1, k, k) / k))
    masked = [F.when(F.col("rn") >= HISTORY[c], F.col(c)).alias(c) for c in NUMERIC]
    out = d.select("date", "ticker", *masked, *calendar_columns(), "label")
    return past_median(out, list(NUMERIC)).na.drop(how="any", subset=[*NUMERIC, "label"]) if impute else out

