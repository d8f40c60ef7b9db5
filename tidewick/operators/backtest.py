"""Daily and weekly backtests and their metrics. Per-ticker work is partitioned; portfolio series are sums by date, a row a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import UNBOUNDED, clip, week_of
from ..sources.bars import weekly
from ..sources.forecasts import provider_forecasts
from .forecasters import legacy_lookahead
from .sizing import LEVERAGE, NOTIONAL, RISK, shares

CAPITAL = NOTIONAL * LEVERAGE * RISK


def _dates():
    """The order of a portfolio series, of one row a date."""
    return Window.orderBy("date")


def _weeks():
    return Window.orderBy("week")


PAST = (UNBOUNDED, 0)


def weekly_positions(bars: DataFrame, forecasts: DataFrame, weights: DataFrame, capital: float = CAPITAL, least_vol: float = 1e-8) -> DataFrame:
    """(ticker, week, price, vol, shares, pnl): sized at a week's close, paid at the next week's; weights sum to 1.

    forecasts (ticker, date, pred_vol). Weeks are those in which any ticker has a close; in a week without one, a
    ticker has no price and no result. A missing forecast is the last one. The last week has no result.
    """
    prices = weekly(bars)
    w = weights.select("ticker", (F.col("portw") / F.sum("portw").over(Window.partitionBy())).alias("w"))
    vols = forecasts.where("pred_vol is not null").groupBy("ticker", week_of().alias("week")).agg(F.max_by("pred_vol", "date").alias("pred_vol"))
    weeks = prices.select("week").distinct()
    # A calendar of weeks by the portfolio's list of tickers.
    grid = weeks.crossJoin(F.broadcast(w))
    d = grid.join(prices, ["ticker", "week"], "left").join(vols, ["ticker", "week"], "left")
    t = Window.partitionBy("ticker").orderBy("week")
    d = d.withColumn("vol", clip(F.last("pred_vol", ignorenulls=True).over(t.rowsBetween(*PAST)), 1e-8 if least_vol is None else least_vol))
    d = d.withColumn("shares", shares(F.col("close"), F.col("vol"), F.col("w"), capital))
    d = d.withColumn("pnl", F.col("shares") * (F.lead("close").over(t) - F.col("close"))).withColumn("more", F.lead("week").over(t).isNotNull())
    return d.where("more").select("ticker", "week", F.col("close").alias("price"), "vol", "shares", "pnl")


def weekly_series(positions: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """(week, pnl, cum_pnl, cum_return) of the portfolio; a missing result counts 0."""
    d = positions.groupBy("week").agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"))
    d = d.withColumn("cum_pnl", F.sum("pnl").over(_weeks().rowsBetween(*PAST)))
    return d.withColumn("cum_return", F.col("cum_pnl") / capital)


def weekly_summary(series: DataFrame, capital: float = CAPITAL, cumulative: bool = False) -> DataFrame:
    """One row of weeks, last value, mean, deviation, ratio and drawdown; by definition of weekly results, or of their sums (cumulative)."""
    x = "cum_pnl" if cumulative else "pnl"
    d = series.withColumn("x", F.col(x)).withColumn("dd", F.max("x").over(_weeks().rowsBetween(*PAST)) - F.col("x"))
    sd = F.stddev_samp("pnl")
    return d.agg(F.count(F.lit(1)).alias("weeks"), F.max_by("x", "week").alias("cum_pnl"), (F.max_by("x", "week") / capital).alias("cum_return"), F.avg("pnl").alias("mean_weekly_pnl"), sd.alias("std_weekly_pnl"), F.when(sd > 0, F.avg("pnl") / sd).alias("sharpe_weekly"), F.max("dd").alias("max_drawdown"))


def daily_positions(bars: DataFrame, forecasts: DataFrame, weights: DataFrame, sign: float = -1.0, capital: float = CAPITAL) -> DataFrame:
    """(date, ticker, price, shares, pnl, portw): sign x change x shares of the same day; days with a forecast row, but a ticker's first."""
    d = forecasts.join(bars.select("ticker", "date", "close"), ["ticker", "date"]).join(weights, "ticker")
    base = F.col("close") * F.col("pred_vol")
    d = d.withColumn("shares", F.when(base != 0, F.lit(capital) * F.col("portw") / base))
    t = Window.partitionBy("ticker").orderBy("date")
    d = d.withColumn("before", F.lag("close").over(t)).where("before is not null")
    return d.select("date", "ticker", F.col("close").alias("price"), "shares", (F.lit(sign) * (F.col("close") - F.col("before")) * F.col("shares")).alias("pnl"), "portw")


def daily_series(positions: DataFrame, notional: float = NOTIONAL, start: str | None = None) -> DataFrame:
    """(date, pnl, cum, equity): sums over tickers, missing ones 0; cum starts at 0 and equity at the notional."""
    d = positions.where(F.col("date") >= F.lit(start)) if start else positions
    d = d.groupBy("date").agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"))
    d = d.withColumn("all", F.sum("pnl").over(_dates().rowsBetween(*PAST))).withColumn("cum", F.col("all") - F.first("pnl").over(_dates().rowsBetween(*PAST)))
    return d.select("date", "pnl", "cum", (F.lit(notional) + F.col("cum")).alias("equity"))


def equity_metrics(series: DataFrame, periods: int = 365) -> DataFrame:
    """One row of return, growth, volatility, ratio, drawdown, hit rate and mean win and loss of (date, pnl, equity)."""
    d = series.withColumn("ret", F.coalesce(F.try_divide("pnl", F.lag("equity").over(_dates())), F.lit(0.0)))
    d = d.withColumn("dd", F.col("equity") / F.max("equity").over(_dates().rowsBetween(*PAST)) - 1)
    n, sd = F.count(F.lit(1)), F.stddev_samp("ret")
    total = F.max_by("equity", "date") / F.min_by("equity", "date")
    cagr = F.when(total > 0, F.pow(total, F.lit(float(periods)) / n)) - 1
    root = F.sqrt(F.lit(float(periods)))
    return d.agg(
        (total - 1).alias("total_return"), cagr.alias("cagr"), F.when(sd > 0, sd * root).alias("vol_ann"), F.when(sd > 0, F.avg("ret") / sd * root).alias("sharpe"), F.min("dd").alias("max_drawdown"),
        F.when(F.min("dd") < 0, cagr / F.abs(F.min("dd"))).alias("calmar"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"), F.coalesce(F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(F.col("pnl") < 0, -F.col("pnl"))), F.lit(0.0)).alias("avg_loss"), n.alias("days"),
    )


def holdings(positions: DataFrame, provider: str) -> DataFrame:
    """(date, ticker, shares, price, dollar_value, weight, vol_provider); a missing position is 0 shares."""
    s = F.coalesce("shares", F.lit(0.0))
    return positions.select("date", "ticker", s.alias("shares"), "price", (s * F.col("price")).alias("dollar_value"), F.col("portw").alias("weight"), F.lit(provider).alias("vol_provider"))


def with_fallback(forecasts: DataFrame, fallback: DataFrame) -> DataFrame:
    """forecasts, and fallback's rows of tickers that have none."""
    return forecasts.unionByName(fallback.join(forecasts.select("ticker").distinct(), "ticker", "left_anti"))


def details(positions: DataFrame) -> DataFrame:
    """(date, ticker, pnl, shares): daily results by ticker, a missing one 0, and the shares that made them."""
    return positions.select("date", "ticker", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), "shares")


def provider(spark, name: str, bars: DataFrame, *, folder: str | None = None, tickers: list[str] | None = None, fill_tail: bool = False, **layout) -> DataFrame:
    """(ticker, date, pred_vol) of a provider by name: ewma_legacy (the look-ahead forecast without its tail, or with it carried
    on) or ml_manifest (forecast files under folder, see provider_forecasts); another name raises ValueError."""
    if name == "ewma_legacy":
        d = legacy_lookahead(bars, fill_tail=fill_tail).select("ticker", "date", "pred_vol")
        return d if fill_tail else d.where("pred_vol is not null")
    if name == "ml_manifest":
        found = provider_forecasts(spark, folder, tickers, bars, **layout)
        return found.where("pred is not null").select("ticker", "date", F.col("pred").alias("pred_vol"))
    raise ValueError(f"unknown provider {name}")
