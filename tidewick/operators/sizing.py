"""Volatility-targeted position sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forecasters import ewma_blend, legacy_snapshot

# Notional, leverage, share of risk.
NOTIONAL, LEVERAGE, RISK = 100_000.0, 2.5, 0.2
WEIGHTS = {"A": 0.23, "N": 0.078, "R": 0.078}


def weights_table(spark, weights: dict[str, float] | None = None, multipliers: dict[str, float] | None = None) -> DataFrame:
    """(ticker, portw, mult); a multiplier that isn't given is 1. A portfolio's list, broadcast by joins."""
    rows = [(t, float(w), float((multipliers or {}).get(t, 1.0))) for t, w in (weights or WEIGHTS).items()]
    return F.broadcast(spark.createDataFrame(rows, "ticker string, portw double, mult double"))


def shares(price: Column, vol: Column, weight: Column, capital: float = NOTIONAL * LEVERAGE * RISK, mult: Column | None = None) -> Column:
    """capital x weight / (price x vol x multiplier); null if that isn't positive."""
    base = price * vol * (mult if mult is not None else F.lit(1.0))
    return F.when(base > 0, F.lit(capital) * weight / base)


def checked_shares(price: Column, vol: Column, weight: Column, capital: float = NOTIONAL * LEVERAGE * RISK) -> Column:
    """The same, but a price or forecast that isn't positive raises."""
    return F.when(price * vol > 0, F.lit(capital) * weight / (price * vol)).otherwise(F.raise_error(F.lit("price and forecast must be positive")).cast("double"))


def latest(bars: DataFrame, back: int = 0) -> DataFrame:
    """(ticker, price): the newest close, or with back=1 the one before; null if there is none."""
    priced = bars.where("close is not null")
    if back:
        # The two newest dates are all that leaves a task.
        d = priced.withColumn("__place", F.dense_rank().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("__place") <= 2)
        return d.groupBy("ticker").agg(F.max_by("close", F.when(F.col("__place") == 2, F.col("date"))).alias("price"))
    return priced.groupBy("ticker").agg(F.max_by("close", "date").alias("price"))


def basket_snapshot(bars: DataFrame, weights: DataFrame, back: int = 1) -> DataFrame:
    """(ticker, portw, price_used, predicted_vol, shares): newest V1 forecast on the previous close."""
    vol = ewma_blend(bars).where("pred_vol is not null").groupBy("ticker").agg(F.max_by("pred_vol", "date").alias("predicted_vol"))
    d = vol.join(latest(bars, back), "ticker").join(weights, "ticker")
    return d.select("ticker", "portw", F.col("price").alias("price_used"), "predicted_vol", shares(F.col("price"), F.col("predicted_vol"), F.col("portw")).alias("shares"))


def ewma_snapshot(bars: DataFrame, weights: DataFrame, notional: float = 50_000.0, back: int = 1) -> DataFrame:
    """(ticker, portw, mult, last_price, pred_vol, units, notional_alloc): V4 forecast, with contract multipliers."""
    d = legacy_snapshot(bars).join(latest(bars, back), "ticker").join(weights, "ticker")
    units = shares(F.col("price"), F.col("pred_vol"), F.col("portw"), notional * LEVERAGE * RISK, F.col("mult"))
    return d.select("ticker", "portw", "mult", F.col("price").alias("last_price"), "pred_vol", units.alias("units"), (units * F.col("price") * F.col("mult")).alias("notional_alloc"))


def ml_snapshot(forecasts: DataFrame, bars: DataFrame, weights: DataFrame, notional: float = 50_000.0, risk: float = 0.02 / 19) -> DataFrame:
    """The same columns from forecasts (ticker, date, pred): each ticker's newest one."""
    vol = forecasts.where("pred is not null").groupBy("ticker").agg(F.max_by("pred", "date").alias("pred_vol"))
    d = vol.join(latest(bars, 1), "ticker").join(weights, "ticker")
    units = shares(F.col("price"), F.col("pred_vol"), F.col("portw"), notional * LEVERAGE * risk, F.col("mult"))
    return d.select("ticker", "portw", "mult", F.col("price").alias("last_price"), "pred_vol", units.alias("units"), (units * F.col("price") * F.col("mult")).alias("notional_alloc"))


def portfolio_summary(ewma: DataFrame, ml: DataFrame, state: DataFrame) -> DataFrame:
    """Both snapshots side by side, each with the share of its total, and the newest regime of state (date, state)."""
    side = lambda d, s: d.select("ticker", F.col("units").alias(f"units_{s}"), F.col("pred_vol").alias(f"pred_vol_{s}"), F.col("notional_alloc").alias(f"alloc_{s}"))
    now = state.agg(F.max_by("state", "date").alias("state"))
    totals = ewma.agg(F.sum("notional_alloc").alias("te")).crossJoin(ml.agg(F.sum("notional_alloc").alias("tm"))).crossJoin(now)
    d = side(ewma, "ewma").join(side(ml, "ml"), "ticker", "full_outer").crossJoin(F.broadcast(totals))
    return d.select("ticker", "units_ewma", "units_ml", "alloc_ewma", "alloc_ml", F.try_divide("alloc_ewma", "te").alias("share_ewma"), F.try_divide("alloc_ml", "tm").alias("share_ml"), F.try_divide("units_ml", "units_ewma").alias("ratio"), "state")


def totals(snapshot: DataFrame) -> DataFrame:
    """(units, notional_alloc, pred_vol): sums, and the median forecast, of a snapshot of a portfolio's few rows."""
    return snapshot.agg(F.sum("units").alias("units"), F.sum("notional_alloc").alias("notional_alloc"), F.percentile("pred_vol", 0.5).alias("pred_vol"))
