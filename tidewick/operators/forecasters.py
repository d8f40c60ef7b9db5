"""Volatility forecasts, 19 x (0.7 recent + 0.3 mean of history): five variants that differ in returns, estimator and window.

legacy_* ones use information of the day or the future as their definition says; never feed them to features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_ticker, geometric_weights, roll, weighted_spread
from .features import simple_returns

# Scale, weight of the recent spread, bars of history.
SCALE, RECENT, HISTORY, LENGTH = 19.0, 0.7, 54, 32


def _blend(recent, history):
    return SCALE * (RECENT * recent + (1 - RECENT) * history)


def _known_last():
    """A ticker's rows by date, those without a return first, so that frames over returns have no gaps: one pass for both."""
    return Window.partitionBy("ticker").orderBy(F.col("ret").isNotNull(), "date")


def ewma_blend(bars: DataFrame) -> DataFrame:
    """V1: unnormalised weights, history the 54 spreads before; the oldest spread is left out, so the first value comes at return 87."""
    d = simple_returns(bars.where("close is not null"), pad=False).where("ret is not null")
    d = d.withColumn("n", F.row_number().over(by_ticker())).withColumn("sd", weighted_spread("ret", geometric_weights(LENGTH)))
    d = d.withColumn("sd", F.when(F.col("n") > LENGTH, F.col("sd")))
    return d.withColumn("pred_vol", _blend(F.col("sd"), roll(F.avg, "sd", -HISTORY, -1, HISTORY))).drop("n", "sd", "ret")


def lagged_blend(bars: DataFrame) -> DataFrame:
    """V2: normalised weights, history 54 spreads with today's, result of the day before."""
    d = simple_returns(bars.where("close is not null"), pad=False)
    w = _known_last()
    d = d.withColumn("sd", weighted_spread("ret", geometric_weights(LENGTH, normalized=True), w)).withColumn("now", _blend(F.col("sd"), roll(F.avg, "sd", 1 - HISTORY, 0, HISTORY, w)))
    return d.withColumn("pred_vol", F.lag("now").over(by_ticker())).drop("sd", "now", "ret")


def legacy_lookahead(bars: DataFrame, n: int = 55, horizon: int = 54, fill_tail: bool = False) -> DataFrame:
    """V3: sample deviation of n padded returns, mean of the next horizon - 1 deviations; the last horizon + 1 rows null or carried forward."""
    w = by_ticker()
    d = simple_returns(bars.where("close is not null"), pad=True).withColumn("sd", roll(F.stddev_samp, "ret", 1 - n, 0, n))
    d = d.withColumn("left", F.count(F.lit(1)).over(w.rowsBetween(1, Window.unboundedFollowing)))
    d = d.withColumn("pred_vol", F.when(F.col("left") > horizon, _blend(F.col("sd"), F.avg("sd").over(w.rowsBetween(1, horizon - 1)))))
    if fill_tail:
        d = d.withColumn("pred_vol", F.last("pred_vol", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.drop("sd", "left", "ret")


def legacy_snapshot(bars: DataFrame) -> DataFrame:
    """V4: (ticker, pred_vol) at the newest bar, with returns (older - newer) / newer; null below 86 returns."""
    w = by_ticker()
    d = bars.where("close is not null").withColumn("newer", F.lead("close").over(w)).where("newer is not null").withColumn("ret", (F.col("close") - F.col("newer")) / F.col("newer"))
    # In the descending frame the newest return comes first, so its spread is that of the last 32 rows.
    d = d.withColumn("sd", weighted_spread("ret", geometric_weights(LENGTH)))
    d = d.withColumn("pred_vol", _blend(F.col("sd"), roll(F.avg, "sd", 1 - HISTORY, -1, HISTORY - 1))).withColumn("n", F.row_number().over(w))
    return d.groupBy("ticker").agg(F.max_by(F.when(F.col("n") >= LENGTH + HISTORY, F.col("pred_vol")), "date").alias("pred_vol"))


def legacy_vectors(bars: DataFrame, capital: float = 100_000 * 2.5 * 0.2) -> DataFrame:
    """V5: newest-first vectors (ticker, idx, date, close, ret, ewma32, stdev32, pred_vol, position_size); idx 0 is the newest bar."""
    d = simple_returns(bars.where("close is not null"), pad=False)
    weights, known = geometric_weights(LENGTH), _known_last()
    values = F.reverse(F.collect_list("ret").over(known.rowsBetween(1 - LENGTH, 0)))
    mean = F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    both = d.withColumn("ewma32", F.when(F.size(values) == LENGTH, mean)).withColumn("stdev32", weighted_spread("ret", weights, known))
    both = both.withColumn("pred_vol", _blend(F.col("stdev32"), roll(F.avg, "stdev32", 1 - HISTORY, -1, HISTORY - 1, known)))
    # One more spread must exist than the mean takes.
    both = both.withColumn("pred_vol", F.when(F.count("stdev32").over(known.rowsBetween(Window.unboundedPreceding, 0)) > HISTORY, F.col("pred_vol")))
    size = F.try_divide(F.lit(capital), F.col("close") * F.when(F.col("pred_vol") != 0, F.col("pred_vol")))
    return both.select("ticker", (F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))) - 1).alias("idx"), "date", "close", "ret", "ewma32", "stdev32", "pred_vol", size.alias("position_size"))


def tracking_error(bars: DataFrame, k: int = 20) -> DataFrame:
    """(ticker, date, predicted, realized, error): V1 against the root of the sum of the last k squared returns, where both exist."""
    d = simple_returns(ewma_blend(bars), pad=False)
    d = d.withColumn("realized", F.sqrt(roll(F.sum, F.col("ret") * F.col("ret"), 1 - k, 0, k)))
    return d.where("pred_vol is not null and realized is not null").select("ticker", "date", F.col("pred_vol").alias("predicted"), "realized", (F.col("pred_vol") - F.col("realized")).alias("error"))
