"""Price bars: long tables (date, ticker, open, high, low, close, adj_close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume"))])
REQUIRED = ("date", "ticker", "high", "low")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(trades: DataFrame, *keys: str) -> DataFrame:
    """One pass with map-side combining: open and close are the prices of the first and last trade in a total order."""
    return trades.groupBy(*keys).agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.max_by("price", "at").alias("adj_close"), F.sum("size").cast("double").alias("volume")
    )


def _lines(spark: SparkSession, sf_dir: str, ticker) -> DataFrame:
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(ticker.cast("string").alias("ticker"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), at.alias("at"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(_lines(spark, sf_dir, F.col("l_returnflag")), "ticker", "date")


def by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(_lines(spark, sf_dir, F.col("l_suppkey")), "ticker", "date")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.struct("ts", "event_id").alias("at"))
    return _bars(e, "ticker", "ts")


def by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with calendar gaps."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("size"), F.col("o_orderkey").alias("at"))
    return _bars(o, "ticker", "date")


def canonical(name: str) -> str:
    """The field that a column's name stands for: open, high, low, adj_close, close or volume if it holds that word, else itself in lower case."""
    low = name.strip().lower().replace(" ", "_")
    return next((f for f in ("open", "high", "low", "adj_close", "close", "volume") if f in low), low)


def load_long(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A long table from Parquet or CSV with column names in any case, spacing and with additions ("AAA Close"), the first of
    equal meaning; missing optional columns are null.

    Raises ValueError if date, ticker, high or low is missing. Dates and numbers that can't be read become null, and NaN
    too; times with a zone count by the session's. Rows without a date go.
    """
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    named = {canonical(c): c for c in reversed(raw.columns)}
    missing = [c for c in REQUIRED if c not in named]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    cols = [F.expr(f"CAST(try_cast(`{named['date']}` AS timestamp) AS date)").alias("date"), F.col(f"`{named['ticker']}`").cast("string").alias("ticker")]
    for f in BARS.fields[2:]:
        x = F.expr(f"try_cast(`{named[f.name]}` AS double)") if f.name in named else F.lit(None).cast("double")
        cols.append(F.nanvl(x, F.lit(None).cast("double")).alias(f.name))
    return raw.select(*cols).where("date is not null")


def require_tickers(bars: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the wanted tickers; raises ValueError for one without any price."""
    spark = bars.sparkSession
    asked = spark.createDataFrame([(t,) for t in wanted], "ticker string")
    priced = bars.where(F.coalesce("close", "adj_close").isNotNull())
    missing = [r["ticker"] for r in asked.join(priced.select("ticker").distinct(), "ticker", "left_anti").collect()]
    if missing:
        raise ValueError(f"no prices for {sorted(missing)}")
    return bars.join(asked, "ticker", "left_semi")


def price(bars: DataFrame, basis: str = "close") -> DataFrame:
    """(ticker, date, price): close with adj_close where it is null, or the other way round."""
    a, b = ("close", "adj_close") if basis == "close" else ("adj_close", "close")
    return bars.select("ticker", "date", F.coalesce(a, b).alias("price"))


def first_of_day(bars: DataFrame, *order: str) -> DataFrame:
    """One row for each (ticker, date), the first in the given order."""
    keep = [c for c in bars.columns if c not in ("ticker", "date")]
    return bars.groupBy("ticker", "date").agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("r")).select("ticker", "date", "r.*")


def last_of_day(bars: DataFrame, *order: str) -> DataFrame:
    keep = [c for c in bars.columns if c not in ("ticker", "date")]
    return bars.groupBy("ticker", "date").agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("r")).select("ticker", "date", "r.*")


def ends_of_day(bars: DataFrame, value: str, *order: str) -> DataFrame:
    """(ticker, date, first_value, last_value) in the given order, in one aggregation."""
    at = F.struct(*order)
    return bars.groupBy("ticker", "date").agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))


def to_wide(bars: DataFrame, tickers: list[str], field: str = "close") -> DataFrame:
    """A column for each ticker; a repeated (ticker, date) raises when the result is read."""
    one = F.when(F.count(field) <= 1, F.first(field)).otherwise(F.raise_error(F.lit("repeated ticker and date")).cast("double"))
    return bars.groupBy("date").pivot("ticker", tickers).agg(one)


def to_long(wide: DataFrame, field: str = "close") -> DataFrame:
    """Inverse of to_wide(); nulls are dropped."""
    return wide.unpivot("date", [c for c in wide.columns if c != "date"], "ticker", field).where(F.col(field).isNotNull())


def calendar(bars: DataFrame) -> DataFrame:
    """(ticker, date) for every day between a ticker's first and last bar."""
    return bars.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("ticker", F.explode(F.sequence("a", "b")).alias("date"))


def weekly(bars: DataFrame, value: str = "close") -> DataFrame:
    """(ticker, week, value): the last value of each week that ends on a Friday."""
    from ..functions.rolling import week_of

    return bars.where(F.col(value).isNotNull()).groupBy("ticker", week_of().alias("week")).agg(F.max_by(value, "date").alias(value))
