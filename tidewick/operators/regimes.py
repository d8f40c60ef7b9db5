"""Market regimes: features, labels, daily state, transitions, run lengths, hazards, nowcast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import UNBOUNDED, by_ticker, clip, roll
from .features import by_groups, ema

# The states in the order that breaks ties.
STATES = ("risk_off", "neutral", "risk_on")


def _dates():
    """The order of a portfolio series, of one row a date."""
    return Window.orderBy("date")


def features(bars: DataFrame, sigma: DataFrame, lookback: int = 90, fast: int = 9, slow: int = 21, quantiles=(0.33, 0.66)) -> DataFrame:
    """(date, ticker, price, volume, sigma_hat, vol_tercile, ema_fast, ema_slow, ema_slope, vwap_roll, vwap_z).

    sigma (ticker, date, sigma_hat). The tercile compares with strictly earlier values; a missing one is the middle.
    """
    d = bars.where("close is not null").select("ticker", "date", F.col("close").alias("price"), F.coalesce("volume", F.lit(0.0)).alias("volume")).join(sigma.select("ticker", "date", "sigma_hat"), ["ticker", "date"], "left")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        past = p["sigma_hat"].astype("float64").shift(1).expanding(1)
        return pd.DataFrame({"ema_fast": ema(p["price"], fast), "ema_slow": ema(p["price"], slow), "ema_look": ema(p["price"], lookback), "q1": past.quantile(quantiles[0]), "q2": past.quantile(quantiles[1])})

    d = by_groups(d, fn, "ema_fast double, ema_slow double, ema_look double, q1 double, q2 double").withColumn("ema_slope", F.col("ema_fast") - F.col("ema_slow"))
    least = max(5, lookback // 3)
    vwap = F.try_divide(roll(F.sum, F.col("price") * F.col("volume"), 1 - lookback, 0, least), roll(F.sum, "volume", 1 - lookback, 0, least))
    d = d.withColumn("vwap_roll", F.coalesce(vwap, "ema_look")).withColumn("__s", F.col("price") - F.col("vwap_roll"))
    d = d.withColumn("vwap_z", F.try_divide(F.col("__s") - roll(F.avg, "__s", 1 - lookback, 0, 10), roll(F.stddev_samp, "__s", 1 - lookback, 0, 10)))
    w = by_ticker()
    tercile = F.when(F.row_number().over(w) == 1, F.lit(None)).when(F.col("sigma_hat").isNull() | F.col("q1").isNull(), 1).when(F.col("sigma_hat") <= F.col("q1"), 0).when(F.col("sigma_hat") >= F.col("q2"), 2).otherwise(1)
    return d.select("date", "ticker", "price", "volume", "sigma_hat", tercile.cast("int").alias("vol_tercile"), "ema_fast", "ema_slow", "ema_slope", "vwap_roll", "vwap_z")


def labels(feat: DataFrame, slope: float = 0.0, high: float = -0.5, low: float = -1.0) -> DataFrame:
    """(date, ticker, state): more signs for risk on, more for off, or neither; a missing slope counts for off."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    up = flag(F.col("ema_slope") > slope)
    on = flag(F.col("vol_tercile") == 0) + up + flag(F.col("vwap_z") > high)
    off = flag(F.col("vol_tercile") == 2) + (1 - up) + flag(F.col("vwap_z") < low)
    return feat.select("date", "ticker", F.when(off > on, STATES[0]).when(on > off, STATES[2]).otherwise(STATES[1]).alias("state"))


def votes(labelled: DataFrame) -> DataFrame:
    """(date, state): the commonest state, the first in order among equals."""
    d = labelled.groupBy("date").agg(*(F.sum((F.col("state") == s).cast("long")).alias(s) for s in STATES))
    most = F.greatest(*STATES)
    return d.select("date", F.when(F.col(STATES[0]) == most, STATES[0]).when(F.col(STATES[1]) == most, STATES[1]).otherwise(STATES[2]).alias("state"))


def hysteresis(states: DataFrame, k: int = 3) -> DataFrame:
    """(date, state): a switch needs k days in a row of one new state.

    So the state is that of the last run that had reached its k-th day, and before any the first day's.
    """
    w = _dates().rowsBetween(UNBOUNDED, 0)
    reached = F.when(F.col("age") >= k, F.col("state"))
    return ages(states).select("date", F.coalesce(F.last(reached, ignorenulls=True).over(w), F.first("state").over(w)).alias("state"))


def transitions(states: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """(from_state, to_state, prob): smoothed shares of what follows each state; all nine rows."""
    pairs = states.select(F.lag("state").over(_dates()).alias("from_state"), F.col("state").alias("to_state")).where("from_state is not null").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    spark = states.sparkSession
    grid = spark.createDataFrame([(a, b) for a in STATES for b in STATES], "from_state string, to_state string")
    d = grid.join(pairs, ["from_state", "to_state"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + smoothing)
    return d.select("from_state", "to_state", (F.col("c") / F.sum("c").over(Window.partitionBy("from_state"))).alias("prob"))


def expected_durations(probs: DataFrame) -> DataFrame:
    """(state, days): 1 / (1 - probability to stay)."""
    return probs.where("from_state = to_state").select(F.col("from_state").alias("state"), F.try_divide(F.lit(1.0), 1 - F.col("prob")).alias("days"))


def stationary(probs: DataFrame) -> DataFrame:
    """(state, prob): the distribution that the nine transition probabilities keep."""
    m = {(r["from_state"], r["to_state"]): r["prob"] for r in probs.collect()}
    p = np.array([[m[a, b] for b in STATES] for a in STATES])
    a = np.vstack([p.T - np.eye(3), np.ones(3)])
    x = np.linalg.lstsq(a, np.array([0, 0, 0, 1.0]), rcond=None)[0]
    return probs.sparkSession.createDataFrame([(s, float(v)) for s, v in zip(STATES, x, strict=True)], "state string, prob double")


def ages(states: DataFrame) -> DataFrame:
    """(date, state, run, age): maximal runs of a state, numbered, and the day within each."""
    d = states.withColumn("new", F.coalesce((F.col("state") != F.lag("state").over(_dates())).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(_dates().rowsBetween(UNBOUNDED, 0)))
    return d.select("date", "state", "run", F.row_number().over(Window.partitionBy("run").orderBy("date")).alias("age"))


def runs(states: DataFrame) -> DataFrame:
    """(run, state, start, end, length)."""
    return ages(states).groupBy("run", "state").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length"))


def hazards(states: DataFrame) -> DataFrame:
    """(state, age, hazard): runs that end at an age among those that reach it; the last, open run counts as ended."""
    r = runs(states).groupBy("state", "length").agg(F.count(F.lit(1)).alias("n"))
    longest = r.groupBy("state").agg(F.max("length").alias("top")).select("state", F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias("age"))
    d = longest.join(r.withColumnRenamed("state", "s"), (F.col("state") == F.col("s")) & (F.col("length") >= F.col("age")))
    return d.groupBy("state", "age").agg((F.sum(F.when(F.col("length") == F.col("age"), F.col("n")).otherwise(0)) / F.sum("n")).alias("hazard")).select("state", F.col("age").cast("int").alias("age"), "hazard")


def smooth(h: DataFrame, n: int = 3, cap: float = 0.99) -> DataFrame:
    """Mean hazard of the last n ages of a state, within 0 and cap."""
    return h.select("state", "age", clip(F.avg("hazard").over(Window.partitionBy("state").orderBy("age").rowsBetween(1 - n, 0)), 0.0, cap).alias("hazard"))


def nowcast(states: DataFrame, probs: DataFrame, h: DataFrame) -> DataFrame:
    """(date, state, age, to_state, prob) for tomorrow, every day: stay with 1 - hazard at the age (beyond the table its
    last; 0.05 for a state without any), else as the transitions of the other states, evenly if those have none."""
    last = h.groupBy("state").agg(F.max("age").alias("top"))
    d = ages(states).select("date", "state", "age").join(last, "state", "left").join(h.withColumnRenamed("age", "at"), ["state"], "left")
    d = d.where(F.col("at").isNull() | (F.col("at") == F.least("age", "top"))).withColumn("stay", 1 - F.coalesce("hazard", F.lit(0.05)))
    out = probs.where("from_state <> to_state").groupBy("from_state").agg(F.sum("prob").alias("mass"))
    m = probs.join(out, "from_state").select(F.col("from_state").alias("state"), "to_state", F.when(F.col("from_state") == F.col("to_state"), None).when(F.col("mass") > 0, F.col("prob") / F.col("mass")).otherwise(0.5).alias("share"))
    return d.join(F.broadcast(m), "state").select("date", "state", "age", "to_state", F.when(F.col("state") == F.col("to_state"), F.col("stay")).otherwise((1 - F.col("stay")) * F.col("share")).alias("prob"))
