"""Window frames with a minimum number of values, and the array forms of weighted windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding


def by_ticker(*order: str):
    return Window.partitionBy("ticker").orderBy(*(order or ("date",)))


def roll(fn: Callable[[Column], Column], x: Column | str, a: int, b: int, least: int, window=None) -> Column:
    """fn over rows a..b around the current one, null with fewer than `least` values."""
    c = F.col(x) if isinstance(x, str) else x
    frame = (window or by_ticker()).rowsBetween(a, b)
    return F.when(F.count(c).over(frame) >= least, fn(c).over(frame))


def adjusted_skewness(x: Column, frame) -> Column:
    """Bias-corrected skewness over a frame; null below 3 values or without spread."""
    n = F.count(x).over(frame).cast("double")
    return F.when((n > 2) & (F.stddev_pop(x).over(frame) > 0), F.skewness(x).over(frame) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column, frame) -> Column:
    """Bias-corrected excess kurtosis over a frame; null below 4 values or without spread."""
    n = F.count(x).over(frame).cast("double")
    return F.when((n > 3) & (F.stddev_pop(x).over(frame) > 0), ((n + 1) * F.kurtosis(x).over(frame) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def geometric_weights(length: int = 32, first: float = 0.6, decay: float = 0.4, normalized: bool = False) -> list[float]:
    w = [first * decay**i for i in range(length)]
    return [x / sum(w) for x in w] if normalized else w


def weighted_spread(x: str, weights: list[float], window=None) -> Column:
    """Square root of the weighted squared distance from the weighted mean of the last values, newest first; x has no nulls."""
    n = len(weights)
    frame = (window or by_ticker()).rowsBetween(1 - n, 0)
    values = F.reverse(F.collect_list(x).over(frame))
    w = F.array(*map(F.lit, weights))
    add = lambda a, v: a + v
    mean = F.aggregate(F.zip_with(values, w, lambda a, b: a * b), F.lit(0.0), add)
    return F.when(F.size(values) == n, F.sqrt(F.aggregate(F.zip_with(values, w, lambda a, b: b * (a - mean) * (a - mean)), F.lit(0.0), add)))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def week_of(date: str = "date") -> Column:
    """The Friday that ends a date's week."""
    return F.next_day(F.date_sub(F.col(date), 1), "FRI")


def symbol_key(symbol: Column) -> Column:
    """Normal form of a symbol: upper case, dashes, without -USD."""
    return F.regexp_replace(F.upper(F.translate(symbol, "_", "-")), "-USD$", "")
