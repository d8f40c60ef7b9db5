"""Averages, trend states and their ages of a stream of bars, a state store entry a ticker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rolling import UNBOUNDED
from ..functions.scans import Average, averages

OUT = "ticker string, ts timestamp, close double, ema_fast double, ema_slow double, raw string, state string, age long"
_STATE = "last long, fast double, slow double, raw string, raw_age long, state string, age long, wait_ts array<long>, wait_close array<double>"


def _raw(fast: float, slow: float) -> str:
    return "risk_on" if fast > slow else "risk_off" if fast < slow else "neutral"


def _stepper(fast: int, slow: int, k: int):
    a, b = 2.0 / (fast + 1), 2.0 / (slow + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        last, f, s, raw, raw_age, state, age, wait_ts, wait_close = group.get if group.exists else (None, None, None, None, 0, None, 0, [], [])
        waiting = list(zip(wait_ts, wait_close, strict=True))
        for p in frames if not group.hasTimedOut else ():
            known = p[p["ts"].notna() & p["close"].notna()]
            waiting += zip((known["ts"].astype("datetime64[us]").astype("int64")).tolist(), known["close"].tolist(), strict=True)
        # A time that is done with can't be taken back.
        waiting = sorted(w for w in waiting if last is None or w[0] > last)
        mark = group.getCurrentWatermarkMs() * 1000
        rows = []
        while waiting and waiting[0][0] <= mark:
            ts, close = waiting.pop(0)
            f, s = (close, close) if f is None else (a * close + (1 - a) * f, b * close + (1 - b) * s)
            now = _raw(f, s)
            raw_age = raw_age + 1 if now == raw else 1
            raw, last = now, ts
            before, state = state, now if state is None or raw_age >= k else state
            age = age + 1 if state == before else 1
            rows.append((key[0], pd.Timestamp(ts, unit="us"), close, f, s, raw, state, age))
        group.update((last, f, s, raw, raw_age, state, age, [w[0] for w in waiting], [w[1] for w in waiting]))
        if waiting:
            group.setTimeoutTimestamp(max(waiting[0][0] // 1000, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["ticker", "ts", "close", "ema_fast", "ema_slow", "raw", "state", "age"])

    return step


def live_states(bars: DataFrame, late: str = "2 hours", fast: int = 9, slow: int = 21, k: int = 3) -> DataFrame:
    """(ticker, ts, close, ema_fast, ema_slow, raw, state, age) of a stream of bars (ticker, ts, close), in append mode.

    raw tells whether the fast average is above or below the slow one; state follows it once it has lasted k bars, and age
    counts the bars of a state. A bar waits in the store until the watermark, the newest time less `late`, has reached it,
    so bars may come in any order within that; bars of one time go by close. A bar that comes after its time, or after a
    later one of its ticker has been handled, is dropped; so are bars without a time or close. The store holds a row a
    ticker with its waiting bars.
    """
    rows = bars.select(F.col("ticker").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close")).withWatermark("ts", late)
    return rows.groupBy("ticker").applyInPandasWithState(_stepper(fast, slow, k), OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def states_of(bars: DataFrame, fast: int = 9, slow: int = 21, k: int = 3) -> DataFrame:
    """The same of a table of bars, all of them; a ticker's times are distinct."""
    d = bars.where("ts is not null and close is not null").select(F.col("ticker").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close"))
    d = averages(d, {"ema_fast": Average.span("close", fast), "ema_slow": Average.span("close", slow)}, order="ts")
    d = d.withColumn("raw", F.when(F.col("ema_fast") > F.col("ema_slow"), "risk_on").when(F.col("ema_fast") < F.col("ema_slow"), "risk_off").otherwise("neutral"))
    w = Window.partitionBy("ticker").orderBy("ts")
    past = w.rowsBetween(UNBOUNDED, 0)

    def with_age(d: DataFrame, state: str, age: str) -> DataFrame:
        new = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(1))
        d = d.withColumn("__new", new).withColumn("__run", F.sum("__new").over(past))
        return d.withColumn(age, F.row_number().over(Window.partitionBy("ticker", "__run").orderBy("ts")).cast("long")).drop("__run", "__new")

    d = with_age(d, "raw", "__raw_age")
    settled = F.last(F.when(F.col("__raw_age") >= k, F.col("raw")), ignorenulls=True).over(past)
    d = with_age(d.withColumn("state", F.coalesce(settled, F.first("raw").over(past))), "state", "age")
    return d.select("ticker", "ts", "close", "ema_fast", "ema_slow", "raw", "state", "age")
