"""Ranks and exact quantiles of large columns: equal values count once, and ranges of values, sized by the data, are sorted apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of a range, on average; a value with more rows is told to every task by itself.
EACH = 100_000


def as_rows(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep..., feature, x) of the columns' known values."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))
    return df.select(*keep, F.explode(pairs).alias("f")).select(*keep, "f.*").where("x is not null")


def placed(df: DataFrame, columns: list[str], each: int = EACH) -> DataFrame:
    """(feature, x, c, before, total): each distinct value with its rows, the rows with lower values, and all rows.

    A range is sorted in one task; it has about `each` distinct values however many there are, and however often one repeats.
    """
    values = as_rows(df, columns).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("c"))
    ranges = max(1, -(-df.count() // each))
    borders = df.approxQuantile(columns, [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else [[] for _ in columns]
    known = df.sparkSession.createDataFrame([(c, sorted(set(cuts))) for c, cuts in zip(columns, borders, strict=True)], "feature string, cuts array<double>")
    rows = values.join(F.broadcast(known), "feature")  # a number for `each` rows
    rows = rows.withColumn("range", F.size(F.filter("cuts", lambda v: v < F.col("x")))).drop("cuts")
    size = rows.groupBy("feature", "range").agg(F.sum("c").alias("n"))  # a row a range
    w = Window.partitionBy("feature")
    size = size.select("feature", "range", F.coalesce(F.sum("n").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lower"), F.sum("n").over(w).alias("total"))
    inside = Window.partitionBy("feature", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return rows.join(F.broadcast(size), ["feature", "range"]).select("feature", "x", "c", (F.col("lower") + F.col("inside")).alias("before"), "total")


def average_ranks(df: DataFrame, columns: list[str], *keep: str, each: int = EACH) -> DataFrame:
    """(keep..., feature, x, r): the mean rank among ties of each value within its feature."""
    ranks = placed(df, columns, each).select("feature", "x", "c", (F.col("before") + (F.col("c") + 1) / 2).alias("r"))
    hot = ranks.where(F.col("c") > each).select("feature", "x", F.col("r").alias("__hot"))  # one for `each` rows at most
    # Rows of a frequent value are spread over the tasks of the join, which they have no match in.
    rows = as_rows(df, columns, *keep).join(F.broadcast(hot), ["feature", "x"], "left")
    rows = rows.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.xxhash64(*keep)).otherwise(F.lit(0).cast("long")))
    cold = ranks.where(F.col("c") <= each).select("feature", "x", "r", F.least(F.col("c"), F.lit(0)).alias("__salt"))  # a literal would leave the join's keys
    return rows.join(cold, ["feature", "x", "__salt"], "left").select(*keep, "feature", "x", F.coalesce("__hot", "r").alias("r"))


def quantiles(df: DataFrame, columns: list[str], probs: list[float], each: int = EACH) -> DataFrame:
    """(feature, q): exact quantiles with linear interpolation, in the order of probs; features without values have no row."""
    d = placed(df, columns, each)
    here = lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("c"))
    out = []
    for p in probs:
        at = (F.col("total") - 1) * F.lit(p)
        low, high = F.floor(at), F.ceil(at)
        out.append(F.sum(F.when(here(low), F.col("x") * (1 - (at - low))).otherwise(0.0) + F.when(here(high) & (high > low), F.col("x") * (at - low)).otherwise(0.0)))
    return d.groupBy("feature").agg(F.array(*out).alias("q"))


def by_column(found: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """One row of quantiles() as columns {c}_{name}."""
    return found.agg(*(F.max(F.when(F.col("feature") == c, F.col("q")[i])).alias(f"{c}_{n}") for c in columns for i, n in enumerate(names)))
