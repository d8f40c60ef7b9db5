"""Recursions along time over chunks of a ticker: no task holds a ticker's whole history.

An exponential average is an affine map of the value that it starts from. Within a chunk of days each row gets the map from
the chunk's first value to it; a row a chunk then carries the end of one chunk to the next; and each row applies its map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of a chunk: as many rows at most, with a row a day.
CHUNK_DAYS = 1024


@dataclass(frozen=True)
class Average:
    """e = a x + (1 - a) e of a column, from its first value on; null before `least` values. A row without a value keeps e,
    and lets the weight of the past decay by one more row."""

    column: str
    alpha: float
    least: int = 0

    @classmethod
    def span(cls, column: str, n: int, least: int = 0) -> Average:
        return cls(column, 2.0 / (n + 1.0), least)


def _maps(x: pd.Series, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, known, gap): after the first value e1 of the chunk, e = p e1 + q; values so far, and rows since the last one."""
    seen = x.notna().to_numpy()
    known = np.cumsum(seen)
    first = int(np.argmax(seen)) if seen.any() else len(x)
    pulse = pd.Series(np.where(seen, 0.0, np.nan))
    rest = x.reset_index(drop=True).copy()
    if first < len(x):
        pulse[first], rest[first] = 1.0, 0.0
    average = lambda s: s.ewm(alpha=alpha, adjust=False).mean().to_numpy()
    at = np.arange(len(x))
    last = np.maximum.accumulate(np.where(seen, at, -1))
    return average(pulse), average(rest), known, np.where(last >= 0, at - last, at + 1)


def averages(df: DataFrame, wanted: dict[str, Average], order: str = "date", chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """df (ticker, order, ...) with a column for each of the averages along the order.

    Rows of a ticker that share a day stay in one chunk, in the order of their days; an order of dates has a row a day.
    """
    names, keys = df.columns, list(wanted)
    chunked = df.withColumn("__chunk", F.floor(F.unix_date(F.col(order).cast("date")) / chunk_days))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.schema)
    made = [f"__{what}{i}" for i in range(len(keys)) for what in "pqkg"]

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        columns = [c for a in wanted.values() for c in _maps(part[a.column].astype("float64"), a.alpha)]
        return pd.concat([part, pd.DataFrame(dict(zip(made, columns, strict=True)))], axis=1)

    types = {"p": "double", "q": "double", "k": "long", "g": "long"}
    rows = chunked.groupBy("ticker", "__chunk").applyInPandas(within, fields + "".join(f", {c} {types[c[2]]}" for c in made))

    # A row a chunk: how its rows begin and end.
    ends = []
    for i, a in enumerate(wanted.values()):
        ends += [F.max_by(F.struct(f"__p{i}", f"__q{i}", f"__k{i}", f"__g{i}"), order).alias(f"end{i}"), F.count_if(F.col(f"__k{i}") == 0).alias(f"before{i}"), F.min_by(a.column, F.when(F.col(a.column).isNotNull(), F.col(order))).cast("double").alias(f"first{i}")]
    chunks = rows.groupBy("ticker", "__chunk").agg(F.count(F.lit(1)).alias("n"), *ends)

    def carried(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__chunk")
        out = {"ticker": part["ticker"], "__chunk": part["__chunk"]}
        for i, a in enumerate(wanted.values()):
            value, gap, count = np.nan, 0, 0
            starts, ones, counts = [], [], []
            for n, end, before, first in zip(part["n"], part[f"end{i}"], part[f"before{i}"], part[f"first{i}"], strict=True):
                starts.append(value)
                counts.append(count)
                known = end[f"__k{i}"]
                if not known:
                    ones.append(np.nan)
                    gap += n
                    continue
                if count:
                    old = (1 - a.alpha) ** (gap + before + 1)
                    first = (old * value + a.alpha * first) / (old + a.alpha)
                ones.append(first)
                value, gap, count = end[f"__p{i}"] * first + end[f"__q{i}"], end[f"__g{i}"], count + known
            out |= {f"__e{i}": starts, f"__f{i}": ones, f"__n{i}": counts}
        return pd.DataFrame(out)

    ticker = chunks.schema["ticker"].dataType.simpleString()
    carry = chunks.groupBy("ticker").applyInPandas(carried, f"ticker {ticker}, __chunk long" + "".join(f", __e{i} double, __f{i} double, __n{i} long" for i in range(len(keys))))
    done = rows.join(carry, ["ticker", "__chunk"])

    def value(i: int, a: Average):
        start, first = (F.when(~F.isnan(c), c) for c in (F.col(f"__e{i}"), F.col(f"__f{i}")))
        e = F.when(F.col(f"__k{i}") == 0, start).otherwise(F.col(f"__p{i}") * first + F.col(f"__q{i}"))
        return F.when(F.col(f"__n{i}") + F.col(f"__k{i}") >= a.least, e)

    return done.select(*(F.col(f"`{c}`") for c in names), *(value(i, a).alias(k) for i, (k, a) in enumerate(wanted.items())))
