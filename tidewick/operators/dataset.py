"""Training sets: splits, winsorising and scaling by training statistics, missing rates, counts, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import by_column, quantiles
from ..functions.rolling import clip
from ..sources.paths import saved
from .features import DAYS, MONTHS, NUMERIC


def split(df: DataFrame, train: float = 0.4, val: float = 0.35, purge: int = 0) -> DataFrame:
    """df with split: the first 40 % of a ticker's rows by date train, 35 % val, the rest test; `purge` rows before a border go."""
    w = Window.partitionBy("ticker")
    n, rn = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("date"))
    d = df.withColumn("__rn", rn).withColumn("__a", F.floor(F.lit(train) * n)).withColumn("__b", F.col("__a") + F.floor(F.lit(val) * n))
    d = d.withColumn("split", F.when(F.col("__rn") <= F.col("__a"), "train").when(F.col("__rn") <= F.col("__b"), "val").otherwise("test"))
    if purge:
        d = d.where(~(F.col("__rn").between(F.col("__a") - purge + 1, F.col("__a")) | F.col("__rn").between(F.col("__b") - purge + 1, F.col("__b"))))
    return d.drop("__rn", "__a", "__b")


def winsor_columns(columns: list[str]) -> list[str]:
    """Columns with heavy tails by name."""
    return [c for c in columns if c.startswith(("rv", "ewma", "d_rv", "skew", "kurt")) or c in ("vov", "park_d")]


def caps(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """One row of the training quantiles {c}_lo, {c}_hi."""
    return by_column(quantiles(df.where("split = 'train'"), columns, [low, high]), columns, ["lo", "hi"])


def winsorize(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Clips columns in all splits at the training quantiles, pooled over tickers."""
    d = df.crossJoin(F.broadcast(caps(df, columns, low, high)))  # one row
    return d.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"{c}_lo")), F.col(f"{c}_hi"))) for c in columns}).select(df.columns)


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of the training means {c}_mu and population deviations {c}_sd, 1 where there is no spread."""
    return df.where("split = 'train'").agg(*(F.avg(c).alias(f"{c}_mu") for c in columns), *(F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_sd") for c in columns))


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    d = df.crossJoin(F.broadcast(scaler(df, columns)))  # one row
    return d.withColumns({c: (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd") for c in columns}).select(df.columns)


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, rate): share of nulls by ticker, then its plain mean over tickers."""
    d = df.groupBy("ticker").agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return d.agg(*(F.avg(c).alias(c) for c in columns)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("rate")) for c in columns))).alias("x")).select("x.*")


def prepare(df: DataFrame, columns: list[str], *, winsor: bool = False, drop: tuple[str, ...] = (), purge: int = 0) -> DataFrame:
    """Splits, drops named columns, clips heavy tails (winsor) and scales by training statistics, in this order."""
    kept = [c for c in columns if c not in drop]
    d = saved(split(drop_columns(df, list(drop)), purge=purge), "split")
    return scale(winsorize(d, winsor_columns(kept)) if winsor else d, kept)


def split_counts(df: DataFrame) -> DataFrame:
    """(ticker, train, val, test, total)."""
    d = df.groupBy("ticker").agg(*(F.sum((F.col("split") == s).cast("long")).alias(s) for s in ("train", "val", "test")))
    return d.withColumn("total", F.col("train") + F.col("val") + F.col("test"))


def folds(df: DataFrame, n: int = 4, gap: int = 0) -> DataFrame:
    """(fold, role, rows...) of expanding folds over the rows by date, equal dates by ticker: train up to a border, val the next part.

    Borders are at n equal steps from half of the rows, the first left out (n = 4: .625, .75 and .875 of them, each
    validated on the next 9.375 %); `gap` rows before a border are in neither.
    """
    d = ranked(df)
    role = lambda r: F.when(r == 1, "train").when(r == 2, "val")
    d = d.withColumn("x", F.explode(F.array(*(F.struct(F.lit(k + 1).alias("fold"), role(r).alias("role")) for k, r in enumerate(fold_roles(n, gap))))))
    return d.select("x.fold", "x.role", *(F.col(c) for c in df.columns)).where("role is not null")


def ranked(df: DataFrame) -> DataFrame:
    """df with rank by date, equal dates by ticker, and total: what fold_roles() reads."""
    from .metrics import ordinal

    return ordinal(df.withColumn("__day", F.unix_date("date").cast("double")), "__day", "ticker").drop("__day")


def fold_roles(n: int = 4, gap: int = 0) -> list[Column]:
    """For each of the folds 1 on rows of ranked() to train on, 2 on rows to validate, else 0."""
    starts = [0.5 + 0.5 * (i + 1) / n for i in range(n - 1)]
    width = (1 - starts[0]) / n
    border = lambda a: F.floor(F.lit(a) * F.col("total"))
    return [F.when(F.col("rank") <= border(a) - gap, 1).when((F.col("rank") > border(a)) & (F.col("rank") <= border(a + width)), 2).otherwise(0) for a in starts]


def counts(df: DataFrame) -> DataFrame:
    """(rows, features, train, val, test) of a data set."""
    names = [c for c in df.columns if c.lower() not in ("date", "ticker", "split", "label")]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(names)).alias("features"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")))


def feature_columns() -> list[str]:
    return [*NUMERIC, *DAYS, *MONTHS]


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the named columns; an unknown name raises ValueError."""
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*names)


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null, NaN or infinity in the columns."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return df.withColumns({c: finite(c) for c in columns}).na.drop(how="any", subset=columns)


__all__ = ["caps", "clean", "clip", "counts", "drop_columns", "feature_columns", "folds", "missing_rates", "scale", "scaler", "split", "split_counts", "winsor_columns", "winsorize"]
