"""Mutual information of features and a label by nearest neighbours, without comparing all pairs.

For each point of (feature, label) the distance r to its k-th neighbour (the greater of the two differences) is found in cells
that hold about as many points each; a point whose square of half-side r reaches other cells asks those as well. How many
values of either column are closer than r is then read from counts by value range. Work follows the number of points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import saved
from .dataset import clean

#: Distinct points of a cell, and values of a range, on average.
CELL, RANGE = 512, 50_000


def digamma(m: Column) -> Column:
    """The digamma function of whole numbers of 1 or more."""
    x = m + F.lit(6.0)
    tail = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    for j in range(6):
        tail = tail - 1 / (m + F.lit(float(j)))
    return tail


def _nearest(x: np.ndarray, y: np.ndarray, c: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The k least distances from each query to points with multiplicities; of a point to itself (own) one time less."""
    times = np.minimum(c, k + 1)  # more copies of a point can't matter
    px, py, first = np.repeat(x, times), np.repeat(y, times), np.cumsum(times) - times
    out = np.full((len(qx), k), np.inf)
    for a in range(0, len(qx), 512):
        b = min(a + 512, len(qx))
        d = np.maximum(np.abs(qx[a:b, None] - px), np.abs(qy[a:b, None] - py))
        if own:
            d[np.arange(b - a), first[a:b]] = np.inf
        n = min(k, d.shape[1])
        out[a:b, :n] = np.sort(np.partition(d, n - 1, axis=1)[:, :n], axis=1) if n else 0
    return out


def _strip(borders: Column, value: Column) -> Column:
    """The range that a value falls in: how many borders are below it."""
    return F.size(F.filter(borders, lambda b: b < value)).cast("long")


def _borders(d: DataFrame, columns: list[str], many: int) -> dict[str, list[float]]:
    if many < 2 or not columns:
        return {c: [] for c in columns}
    found = d.approxQuantile(columns, [i / many for i in range(1, many)], min(0.01, 0.2 / many))
    return {c: sorted(set(q)) for c, q in zip(columns, found, strict=True)}


def _dealt(points: DataFrame, borders: dict[str, list[float]], column: str, name: str) -> DataFrame:
    """points with the range of a column, by each feature's borders."""
    table = points.sparkSession.createDataFrame(list(borders.items()), "feature string, __b array<double>")
    return points.join(F.broadcast(table), "feature").withColumn(name, _strip(F.col("__b"), F.col(column))).drop("__b")  # a row a feature


def _radii(points: DataFrame, borders: dict[str, list[float]], k: int, cell: int, many: int) -> DataFrame:
    """(feature, x, y, c, r) of distinct points (feature, x, y, c): r is the distance to the k-th neighbour. many: ranges of x."""
    steps = max(64, many)
    d = _dealt(points, borders, "x", "ix")
    size = d.groupBy("feature", "ix").agg(F.count(F.lit(1)).alias("n"))
    # Within a range of x, borders of y so that all cells hold about as many points.
    cuts = d.join(size, ["feature", "ix"]).groupBy("feature", "ix").agg(F.percentile_approx("y", F.array(*(F.lit(i / steps) for i in range(1, steps))), 20 * steps).alias("q"), F.max(F.greatest(F.lit(1), F.ceil(F.col("n") / cell))).alias("m"))
    step = F.greatest(F.lit(1), F.floor(F.lit(steps) / F.col("m")))
    cuts = saved(cuts.select("feature", "ix", F.array_sort(F.array_distinct(F.filter("q", lambda v, i: (i + 1) % step == 0))).alias("yb")), "cells")
    d = saved(d.join(cuts, ["feature", "ix"]).withColumn("iy", _strip(F.col("yb"), F.col("y"))).drop("yb"), "points")

    def inside(p: pd.DataFrame) -> pd.DataFrame:
        x, y, c = (p[n].to_numpy() for n in ("x", "y", "c"))
        near = _nearest(x, y, c, x, y, k, True)
        return p[["feature", "x", "y", "c", "ix", "iy"]].assign(near=list(near))

    near = saved(d.groupBy("feature", "ix", "iy").applyInPandas(inside, "feature string, x double, y double, c long, ix long, iy long, near array<double>"), "near")
    r = F.element_at("near", k)
    table = points.sparkSession.createDataFrame(list(borders.items()), "feature string, xb array<double>")
    # Squares that reach beyond their cell ask the other cells: first the ranges of x, then in each those of y.
    reach = near.join(F.broadcast(table), "feature").select("feature", "x", "y", r.alias("r"), F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.explode(F.sequence(_strip(F.col("xb"), F.col("x") - r), _strip(F.col("xb"), F.col("x") + r))).alias("ix"))
    reach = reach.join(cuts, ["feature", "ix"]).select("feature", "x", "y", "r", "jx", "jy", "ix", F.explode(F.sequence(_strip(F.col("yb"), F.col("y") - F.col("r")), _strip(F.col("yb"), F.col("y") + F.col("r")))).alias("iy"))
    asks = reach.where("ix <> jx or iy <> jy").select("feature", "ix", "iy", "x", "y", F.lit(0).cast("long").alias("c"), "r")

    def across(p: pd.DataFrame) -> pd.DataFrame:
        asking = p["c"].to_numpy() == 0
        q, own = p[asking], p[~asking]
        found = _nearest(*(own[n].to_numpy() for n in ("x", "y", "c")), q["x"].to_numpy(), q["y"].to_numpy(), k, False)
        return q[["feature", "x", "y"]].assign(near=[v[v < r] for v, r in zip(found, q["r"], strict=True)])

    cells = d.select("feature", "ix", "iy", "x", "y", "c", F.lit(0.0).alias("r")).join(asks.select("feature", "ix", "iy").distinct(), ["feature", "ix", "iy"], "left_semi")
    more = cells.unionByName(asks).groupBy("feature", "ix", "iy").applyInPandas(across, "feature string, x double, y double, near array<double>")
    every = near.select("feature", "x", "y", "c", "near").unionByName(more.select("feature", "x", "y", F.lit(0).cast("long").alias("c"), "near"))
    every = every.groupBy("feature", "x", "y").agg(F.max("c").alias("c"), F.flatten(F.collect_list("near")).alias("near"))  # k numbers a cell that a square reaches
    return every.select("feature", "x", "y", "c", F.element_at(F.array_sort("near"), k).alias("r"))


def _closer(found: DataFrame, axis: str, borders: dict[str, list[float]]) -> DataFrame:
    """(feature, x, y, n): how many values of the axis are closer than r to a point's own, itself left out; as close if r is 0."""
    values = found.groupBy("feature", F.col(axis).alias("v")).agg(F.sum("c").alias("c"))
    values = _dealt(values, borders, "v", "s")
    sizes = values.groupBy("feature", "s").agg(F.sum("c").alias("t"))  # a row a range
    before = sizes.select("feature", "s", F.coalesce(F.sum("t").over(Window.partitionBy("feature").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    side = F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    asks = found.select("feature", "x", "y", "r", side).withColumn("at", F.col(axis) + F.col("side") * F.col("r"))
    asks = _dealt(asks, borders, "at", "s")
    none = F.lit(None).cast("double")
    rows = values.select("feature", "s", "v", "c", none.alias("x"), none.alias("y"), none.alias("r"), F.lit(0).alias("side"))
    rows = rows.unionByName(asks.select("feature", "s", F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("c"), "x", "y", "r", "side"))
    name = axis

    def count(p: pd.DataFrame) -> pd.DataFrame:
        held = p[p["side"] == 0].sort_values("v")
        v, total = held["v"].to_numpy(), np.concatenate(([0], held["c"].cumsum().to_numpy())).astype(np.int64)
        q = p[p["side"] != 0]
        own, r, side = q[name].to_numpy(), q["r"].to_numpy(), q["side"].to_numpy()
        # Values up to x + r that are closer than r; or values below x that aren't.
        inside = lambda u: (np.abs(u - own) < r) | ((r == 0) & (u == own))
        at = np.searchsorted(v, own + side * r, side="right")
        for _ in range(2):  # rounding can move a border by a value
            u = v[np.clip(at - 1, 0, max(0, len(v) - 1))] if len(v) else own
            drop = (at > 0) & np.where(side > 0, (u > own) & ~inside(u), inside(u))
            at = at - drop
        for _ in range(2):
            u = v[np.clip(at, 0, max(0, len(v) - 1))] if len(v) else own
            at = at + ((at < len(v)) & np.where(side > 0, inside(u), (u < own) & ~inside(u)))
        return q[["feature", "s", "x", "y"]].assign(n=side * total[at], side=side.astype(np.int64))

    counted = rows.groupBy("feature", "s").applyInPandas(count, "feature string, s long, x double, y double, n long, side long")
    # A range without values has the counts of all lower ranges before it.
    lower = sizes.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("s", "t"))).alias("all"))  # a number a range
    counted = counted.join(F.broadcast(before), ["feature", "s"], "left").join(F.broadcast(lower), "feature")
    base = F.coalesce("before", F.aggregate(F.filter("all", lambda e: e["s"] < F.col("s")), F.lit(0).cast("long"), lambda a, e: a + e["t"]))
    return counted.groupBy("feature", "x", "y").agg((F.sum(F.col("n") + F.col("side") * base) - 1).alias("n"))


def mutual_information(df: DataFrame, columns: list[str], label: str = "label", k: int = 3, cell: int = CELL, value_range: int = RANGE) -> DataFrame:
    """(feature, mi) of the columns with the label in nats, 0 at least.

    Rows with a null, NaN or infinity in any column are left out; columns are divided by their deviations. Ties are kept as
    they are, without noise: a point with k equal ones has r = 0, and the values equal to its own are counted. With k rows or
    fewer the result is 0. A value, or a point, that repeats counts once with its number.
    """
    d = clean(df.select(*columns, F.col(label).alias("__y")), [*columns, "__y"])
    n, *sd = d.agg(F.count(F.lit(1)), *(F.stddev_pop(c) for c in [*columns, "__y"])).first()
    if n <= k:
        return df.sparkSession.createDataFrame([(c, 0.0) for c in columns], "feature string, mi double")
    d = saved(d.select(*((F.col(c).cast("double") / F.lit(float(s or 1.0))).alias(c) for c, s in zip([*columns, "__y"], sd, strict=True))), "scaled")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns))).alias("p")
    points = saved(d.select(pairs, F.col("__y").alias("y")).groupBy("p.feature", "p.x", "y").agg(F.count(F.lit(1)).alias("c")), "points")
    many = int(np.ceil(np.sqrt(n / cell)))
    found = saved(_radii(points, _borders(d, columns, many), k, cell, many), "radii")
    ranges = _borders(d, [*columns, "__y"], int(np.ceil(n / value_range)))
    x = _closer(found, "x", {c: ranges[c] for c in columns}).withColumnRenamed("n", "nx")
    y = _closer(found, "y", dict.fromkeys(columns, ranges["__y"])).withColumnRenamed("n", "ny")
    both = found.join(x, ["feature", "x", "y"]).join(y, ["feature", "x", "y"])
    mean = F.sum((digamma(F.col("nx") + 1) + digamma(F.col("ny") + 1)) * F.col("c")) / F.lit(float(n))
    return both.groupBy("feature").agg(F.greatest(F.lit(0.0), digamma(F.lit(float(n))) + digamma(F.lit(float(k))) - mean).alias("mi"))
