"""Forecast quality over tables (ticker, date, y, pred), and tables about labels and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_ranks, by_column, quantiles
from ..functions.rolling import roll
from ..sources.paths import saved

FLOOR = 1e-12


def label_sanity(labels: DataFrame) -> DataFrame:
    """(k, ticker, n, start, end, mean, median, std, p10, p90) of labels (date, ticker, k, label); a single label has std 0."""
    d = labels.groupBy("k", "ticker").agg(
        F.count("label").alias("n"), F.min(F.when(F.col("label").isNotNull(), F.col("date"))).alias("start"), F.max(F.when(F.col("label").isNotNull(), F.col("date"))).alias("end"), F.avg("label").alias("mean"), F.percentile("label", 0.5).alias("median"),
        F.when(F.count("label") == 1, 0.0).otherwise(F.stddev_samp("label")).alias("std"), F.percentile("label", 0.1).alias("p10"), F.percentile("label", 0.9).alias("p90"),
    )
    return d


def label_sanity_by_k(labels: DataFrame) -> DataFrame:
    d = label_sanity(labels)
    return d.groupBy("k").agg(F.sum("n").alias("n"), *(F.avg(c).alias(c) for c in ("mean", "median", "std", "p10", "p90")))


def _errors(d: DataFrame) -> DataFrame:
    p = F.greatest("pred", F.lit(FLOOR))
    return d.where("y is not null and pred is not null").withColumn("p", p).withColumn("ae", F.abs(F.col("y") - p)).withColumn("ape", F.abs(F.col("y") - p) / F.greatest(F.abs("y"), F.lit(FLOOR)))


def regression_metrics(d: DataFrame) -> DataFrame:
    """One row MAE, RMSE, MAPE, R2, n; forecasts are at least 1e-12."""
    e = _errors(d)
    sse = F.sum((F.col("y") - F.col("p")) ** 2)
    return e.agg(F.avg("ae").alias("mae"), F.sqrt(sse / F.count(F.lit(1))).alias("rmse"), F.avg("ape").alias("mape"), (1 - F.try_divide(sse, F.var_pop("y") * F.count(F.lit(1)))).alias("r2"), F.count(F.lit(1)).alias("n"))


def by_ticker_metrics(d: DataFrame) -> DataFrame:
    """(ticker, n, mae, mape, rmse); rows without a ticker are a group."""
    return _errors(d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg("ae").alias("mae"), F.avg("ape").alias("mape"), F.sqrt(F.avg(F.col("ae") * F.col("ae"))).alias("rmse"))


def deciles(d: DataFrame, n: int = 10) -> DataFrame:
    """(decile, count, mean_y, mean_pred, mae, mape) of n equal-count bins of the forecast's rank; fewer rows make fewer bins.

    The rank is total (pred, ticker, date) and comes from a range-partitioned sort, not from one task: rows before a
    partition are counted first.
    """
    e = _errors(d)
    r = ordinal(e, "p", "ticker", "date")
    bins = F.least(F.lit(n), F.col("total"))
    i = F.when(F.col("total") == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("rank") - 1) * bins / (F.col("total") - 1)))).cast("int")
    return r.withColumn("decile", i).groupBy("decile").agg(F.count(F.lit(1)).alias("count"), F.avg("y").alias("mean_y"), F.avg("p").alias("mean_pred"), F.avg("ae").alias("mae"), F.avg("ape").alias("mape"))


def ordinal(d: DataFrame, *order: str) -> DataFrame:
    """d with rank (1, 2, ... in the order) and total.

    Rows are sorted by ranges of the whole order, so equal values of its first column don't meet in one task; the sorted table
    is written, its parts are counted, and only a number a part comes together.
    """
    part, at = F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")
    # Nulls are first, as in a window.
    rows = saved(d.repartitionByRange(*(F.asc(c) for c in order)).sortWithinPartitions(*order).select("*", part, at), "sorted")
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))  # a row a part
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("__part").alias("__p"), "first", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    d = rows.join(F.broadcast(sizes), F.col("__part") == F.col("__p"))
    return d.select(*(F.col(f"`{c}`") for c in rows.columns[:-2]), "total", (F.col("__id") - F.col("first") + F.col("before") + 1).alias("rank"))


def top_decile_lift(table: DataFrame) -> DataFrame:
    """(lift): mean of the top decile against the plain mean of decile means."""
    return table.agg((F.max_by("mean_y", "decile") / F.avg("mean_y")).alias("lift"))


def spearman(d: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, rho): rank correlation of each feature with the target over rows where all are known; null without spread.

    Features become rows, and ranks come from coarse value ranges, so that no task holds a whole feature.
    """
    known = d.na.drop(how="any", subset=[*features, target])
    rx = average_ranks(known, features, "ticker", "date").select("ticker", "date", "feature", F.col("r").alias("rx"))
    rt = average_ranks(known, [target], "ticker", "date").select("ticker", "date", F.col("r").alias("rt"))
    r = rx.join(rt, ["ticker", "date"])
    return r.groupBy("feature").agg(F.when((F.stddev_pop("rx") > FLOOR) & (F.stddev_pop("rt") > FLOOR), F.corr("rx", "rt")).alias("rho"))


def top_features(found: DataFrame, n: int = 20, by: str = "rho") -> DataFrame:
    """The n rows of largest absolute value, with place 1, 2, ...; equal ones by name. Unknown values come last."""
    d = found.orderBy(F.desc_nulls_last(F.abs(by)), "feature").limit(n)
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs(by)), "feature")))


def pearson(d: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, r): linear correlation of each feature with the target."""
    one = d.agg(*(F.corr(c, target).alias(c) for c in features))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in features))).alias("x")).select("x.*")


def correlated_pairs(d: DataFrame, features: list[str], least: float = 0.9) -> DataFrame:
    """(a, b, rho) of feature pairs whose ranks correlate at least so much, over rows where all are known."""
    ranked = average_ranks(d.na.drop(how="any", subset=features), features, "ticker", "date")
    wide = ranked.groupBy("ticker", "date").pivot("feature", features).agg(F.first("r"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = wide.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("rho")) for a, b in pairs))).alias("x")).select("x.*").where(F.abs("rho") >= least)


def robust_alpha(d: DataFrame) -> DataFrame:
    """(alpha): median of y / pred over finite ratios, 1 without any."""
    ratio = F.col("y") / F.greatest("pred", F.lit(FLOOR))
    known = d.where("y is not null and pred is not null").select(ratio.alias("ratio")).where(~F.isnan("ratio") & (F.abs("ratio") != float("inf")))
    return by_column(quantiles(known, ["ratio"], [0.5]), ["ratio"], ["median"]).select(F.coalesce("ratio_median", F.lit(1.0)).alias("alpha"))


def calibration_slope(d: DataFrame) -> DataFrame:
    """(slope): least squares through the origin; null without positive squares."""
    return d.agg(F.when(F.sum(F.col("pred") ** 2) > 0, F.sum(F.col("y") * F.col("pred")) / F.sum(F.col("pred") ** 2)).alias("slope"))


def rolling_mape(d: DataFrame, n: int = 60) -> DataFrame:
    """(ticker, date, mape): mean relative error of the last n rows of a ticker, from max(5, n // 3) on."""
    return _errors(d).select("ticker", "date", roll(F.avg, "ape", 1 - n, 0, max(5, n // 3)).alias("mape"))


def histogram(d: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, lo, n): equal-width counts between the least and the largest value."""
    d = d.where(F.col(column).isNotNull()).select(F.col(column).alias("__x"))
    s = d.agg(F.min("__x").alias("a"), F.max("__x").alias("b"))  # one row
    x = d.crossJoin(F.broadcast(s))
    k = F.least(F.lit(bins - 1), F.floor((F.col("__x") - F.col("a")) / ((F.col("b") - F.col("a")) / bins))).cast("int")
    return x.withColumn("bin", F.when(F.col("b") > F.col("a"), k).otherwise(0)).groupBy("bin").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count(F.lit(1)).alias("n")).select("bin", (F.col("a") + F.col("bin") * (F.col("b") - F.col("a")) / bins).alias("lo"), "n")


def central_histogram(d: DataFrame, column: str, bins: int = 50, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """histogram() with inside: whether a bin reaches into the central part between two quantiles."""
    edge = by_column(quantiles(d, [column], [low, high]), [column], ["lo", "hi"])  # one row
    h = histogram(d, column, bins)
    step = F.max("lo").over(Window.partitionBy()) - F.min("lo").over(Window.partitionBy())
    h = h.withColumn("step", F.try_divide(step, F.max("bin").over(Window.partitionBy()).cast("double"))).crossJoin(F.broadcast(edge))  # a row a bin
    return h.select("bin", "lo", "n", ((F.col("lo") <= F.col(f"{column}_hi")) & (F.col("lo") + F.coalesce("step", F.lit(0.0)) >= F.col(f"{column}_lo"))).alias("inside"))


def coverage(d: DataFrame, column: str) -> DataFrame:
    """(ticker, last, share): the last date of each ticker, and the share of its rows where the column is known."""
    return d.groupBy("ticker").agg(F.max("date").alias("last"), F.avg(F.col(column).isNotNull().cast("double")).alias("share"))


def value_counts(d: DataFrame, column: str) -> DataFrame:
    """(value, n) of the known values."""
    return d.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def head_tail(d: DataFrame, n: int = 2) -> DataFrame:
    """The first and the last n rows of each ticker by date, marked head or tail in `part`; a row may be in both."""
    w = Window.partitionBy("ticker")
    d = d.withColumn("__a", F.row_number().over(w.orderBy("date"))).withColumn("__b", F.row_number().over(w.orderBy(F.desc("date"))))
    ends = F.filter(F.array(F.when(F.col("__a") <= n, F.lit("head")), F.when(F.col("__b") <= n, F.lit("tail"))), lambda x: x.isNotNull())
    return d.withColumn("part", F.explode(ends)).drop("__a", "__b")
