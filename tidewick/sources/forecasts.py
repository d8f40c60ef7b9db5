"""Model forecasts in the layouts that files come in, normalised to (ticker, date, pred).

Two readers, whose names and precedence differ: `daily_forecasts` reads a backtest's file of test forecasts, and
`provider_forecasts` one of five layouts and puts it on a calendar. Both scale by the manifest's calibration factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.rolling import UNBOUNDED, by_ticker, symbol_key
from .paths import read_if_there, read_json, read_table

# Names of the forecast column of a backtest's file, the first that is there wins, and names of models.
DAILY_VALUES = ("pred_gbm", "pred_en", "pred", "y_hat", "yhat", "prediction", "vol_pred", "sigma_pred", "vol_hat")
MODEL_NAMES = {"gbm": "gbm", "gradientboosting": "gbm", "gbr": "gbm", "en": "en", "elasticnet": "en"}
# Names of the date, ticker and forecast columns of a provider's table, as spelled, the first that is there wins.
DATES = ("date", "Date", "dt", "timestamp", "ts", "time", "datetime", "asof", "asof_date", "trade_date", "ds", "index")
TICKERS = ("ticker", "symbol", "asset", "name", "secid", "security", "code", "sid")
VALUES = ("sigma_hat", "pred_vol", "y_pred", "vol_pred", "sigma", "pred", "yhat", "target", "y")
# The same of a file for one ticker, and of a table of rows that forecasts belong to.
TICKER_FILE_DATES = ("date", "Date", "dt", "timestamp", "ts", "datetime")
TICKER_FILE_VALUES = ("pred_gbm", "pred_en", "sigma_hat", "pred", "y_pred", "vol_pred", "sigma")
ROW_DATES = ("date", "Date", "dt", "timestamp", "ts", "time", "datetime", "asof")
ROW_TICKERS = ("ticker", "Ticker", "symbol", "asset", "name", "code")
# Keys of the calibration factor, and of the objects that may hold it.
ALPHA_KEYS, ALPHA_PARENTS = ("alpha", "alpha_calibrator", "calibrator_alpha"), ("calibration", "report", "meta")
# Names of the file of test forecasts.
FORECAST_FILES = ("preds_test_k{k}.parquet", "preds_test_k{k}.pq", "preds_TEST_k{k}.parquet")

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _first(names: tuple[str, ...], columns) -> str | None:
    return next((n for n in names if n in columns), None)


def _numbers(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def guess_columns(df: DataFrame, *, date: str | None = None, ticker: str | None = None, pred: str | None = None) -> tuple[str, str, str] | None:
    """(date, ticker, forecast) columns of a provider's table; None for a wide one, with a column for each ticker.

    Three given names win. A table is wide if it has a date, no column that names a ticker and two other numeric columns
    or more. Without a known name of a forecast the last numeric column is it; what can't be told raises ValueError.
    """
    if date and ticker and pred:
        return date, ticker, pred
    found = _first(DATES, df.columns)
    if found is None:
        raise ValueError("no date column")
    if _first(TICKERS, df.columns) is None:
        if len([c for c in _numbers(df) if c != found]) >= 2:
            return None
        raise ValueError("no ticker column")
    value = _first(VALUES, df.columns) or next(iter(_numbers(df)[::-1]), None)
    if value is None:
        raise ValueError("no forecast column")
    return found, _first(TICKERS, df.columns), value


def find_forecasts(spark: SparkSession, folder: str, k: int) -> str:
    """The path of the test forecasts of horizon k; FileNotFoundError if no name is there."""
    for name in FORECAST_FILES:
        path = f"{folder}/{name.format(k=k)}"
        if read_if_there(spark, path) is not None:
            return path
    raise FileNotFoundError(f"no forecasts of horizon {k} under {folder}")


def manifest_alpha(spark: SparkSession, path: str) -> float:
    """The calibration factor of a manifest: a number under a known key, else under one in a known object; 1 without any, or without a file."""
    m = read_json(spark, path) or {}
    for level in (m, *(m[p] for p in ALPHA_PARENTS if isinstance(m.get(p), dict))):
        for key in ALPHA_KEYS:
            if isinstance(level.get(key), int | float):
                return float(level[key])
    return 1.0


def model_alpha(spark: SparkSession, path: str, model: str) -> float:
    """alpha_{model} of a manifest; 1 if it, or the file, is missing or null."""
    found = (read_json(spark, path) or {}).get(f"alpha_{model}")
    return 1.0 if found is None else float(found)


def pick_model(spark: SparkSession, path: str) -> str:
    """gbm or en, whichever has the lower test RMSE, else MAE, in a metrics file; gbm if equal, unknown or missing."""
    m = read_json(spark, path) or {}

    def get(model: str, what: str):
        facts = m.get(model)
        return facts.get(f"{what}_test", facts.get(f"{what.upper()}_TEST")) if isinstance(facts, dict) else None

    for what in ("rmse", "mae"):
        gbm, en = get("gbm", what), get("en", what)
        if gbm is not None and en is not None:
            return "gbm" if gbm <= en else "en"
    return "gbm"


def one_each(df: DataFrame) -> DataFrame:
    """(ticker, date, pred) of the rows; a repeated (ticker, date) raises when the result is read."""
    one = F.when(F.count(F.lit(1)) == 1, F.first("pred")).otherwise(F.raise_error(F.lit("repeated ticker and date")).cast("double"))
    return df.groupBy("ticker", "date").agg(one.alias("pred"))


def _long(df: DataFrame, date: str) -> DataFrame:
    """(date, ticker, pred) of a wide table."""
    values = [c for c, t in df.dtypes if c != date and (t in NUMERIC or t.startswith("decimal"))]
    return df.select(F.to_date(f"`{date}`").alias("date"), *(F.col(f"`{c}`").cast("double").alias(c) for c in values)).unpivot("date", values, "ticker", "pred")


def _named(df: DataFrame, date: str, ticker, value: str) -> DataFrame:
    return df.select(F.to_date(f"`{date}`").alias("date"), (F.col(f"`{ticker}`") if isinstance(ticker, str) else ticker).cast("string").alias("ticker"), F.col(f"`{value}`").cast("double").alias("pred"))


def normalize_daily(df: DataFrame, tickers: list[str], *, model: str = "gbm", alpha: float = 1.0) -> DataFrame:
    """(ticker, date, pred) of the wanted tickers from a table of test forecasts, times alpha.

    Long tables have `date` and `ticker` in any case, and one of DAILY_VALUES; others are wide, with the date first. A
    column `model` keeps the rows of the model. Symbols match in any case, with _ or -, with or without -USD; several
    that match one ticker are averaged. No known forecast column, or no matching symbol, gives no rows: see with_fallback().
    """
    low = {c.lower(): c for c in df.columns}
    if "model" in low:
        name = F.lower(F.col(f"`{low['model']}`").cast("string"))
        df = df.where(F.coalesce(*(F.when(name == k, v) for k, v in MODEL_NAMES.items()), name) == model)
    if "date" in low and "ticker" in low:
        value = _first(DAILY_VALUES, low)
        if value is None:
            return df.sparkSession.createDataFrame([], "ticker string, date date, pred double")
        d = _named(df, low["date"], low["ticker"], low[value])
    else:
        d = _long(df.drop(low["model"]) if "model" in low else df, df.columns[0])
    d = one_each(d)
    wanted = F.broadcast(df.sparkSession.createDataFrame([(t,) for t in tickers], "symbol string"))  # the portfolio's list
    d = d.join(wanted, symbol_key(F.col("ticker")) == symbol_key(F.col("symbol")))
    return d.groupBy(F.col("symbol").alias("ticker"), "date").agg((F.avg("pred") * alpha).alias("pred"))


def daily_forecasts(spark: SparkSession, folder: str, tickers: list[str], *, k: int = 10, model: str = "gbm") -> DataFrame:
    """Test forecasts of horizon k from preds_test_k{k} (Parquet, else CSV), times alpha_{model} of model_manifest_k{k}.json."""
    return normalize_daily(read_table(spark, f"{folder}/preds_test_k{k}"), tickers, model=model, alpha=model_alpha(spark, f"{folder}/model_manifest_k{k}.json", model))


def numbered(df: DataFrame) -> DataFrame:
    """df, straight from files, with position 0, 1, ...: by the files' names, then by the rows' places in their file.

    Parquet rows tell their place; of other formats the rows of a file meet in one task, which numbers them. Rows are
    counted by file, and only a number a file comes together.
    """
    names = df.columns
    file, row = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    try:
        d = df.select("*", file, row)
        d.schema  # noqa: B018  raises here if the format has no row numbers
    except AnalysisException:
        # The ids of a task's rows rise as it reads them, and a task reads a file's splits from the front.
        d = df.select("*", file, F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
        w = Window.partitionBy("__file").orderBy("__block", "__id")
        d = d.withColumn("__row", F.row_number().over(w) - 1).drop("__block", "__id")
    sizes = d.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))  # a row a file
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__name").rowsBetween(UNBOUNDED, -1)), F.lit(0))
    sizes = sizes.select(F.col("__file").alias("__name"), "__n").select("__name", before.alias("__before"))
    return d.join(sizes, F.col("__file") == F.col("__name")).select(*(F.col(f"`{c}`") for c in names), (F.col("__before") + F.col("__row")).alias("position"))


def by_position(preds: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """(ticker, date, pred): forecasts that belong to the rows (date, ticker) in the same position; unequal counts raise ValueError.

    Both are read straight from files. Positions go by file name, then by row, so part files of any sizes, cut anywhere,
    are put together in the order in which Spark named them.
    """
    a, b = preds.count(), rows.count()
    if a != b:
        raise ValueError(f"{b} rows and {a} forecasts")
    date, ticker = _first(ROW_DATES, rows.columns), _first(ROW_TICKERS, rows.columns)
    if date is None or ticker is None:
        raise ValueError("the rows have no date or no ticker column")
    if value not in preds.columns:
        raise ValueError(f"no forecast column {value}")
    left = numbered(rows).select("position", F.to_date(f"`{date}`").alias("date"), F.col(f"`{ticker}`").cast("string").alias("ticker"))
    right = numbered(preds).select("position", F.col(f"`{value}`").cast("double").alias("pred"))
    return one_each(left.join(right, "position").drop("position"))


def _vector(df: DataFrame, value: str, calendar: DataFrame, ticker: str, tail: bool) -> DataFrame:
    """A file without dates: its values on the first (or last) days of the calendar (date), in order."""
    days = calendar.select("date").distinct()
    v = numbered(df).select("position", F.col(f"`{value}`").cast("double").alias("pred"))
    back = days.count() - v.count() if tail else 0
    days = days.withColumn("position", F.row_number().over(Window.orderBy("date")) - 1 - back)  # a row a date
    return days.join(v, "position").select(F.lit(ticker).alias("ticker"), "date", "pred")


def provider_forecasts(
    spark: SparkSession, folder: str, tickers: list[str], calendar: DataFrame, *, k: int = 10, model: str | None = None, date: str | None = None, ticker: str | None = None, pred: str | None = None,
    single: str | None = None, value: str = "pred_gbm", ticker_folder: str | None = None, rows_path: str | None = None, tail: bool = True,
) -> DataFrame:
    """(ticker, date, pred) for each wanted ticker and day of the calendar (date); null where there is no forecast.

    Layouts, in this order: a folder with a file for each ticker (a missing file gives nulls; one without dates is put on
    the last days, or the first ones); y_true and forecasts without keys, with a table of the rows that they belong to;
    the same for one ticker, on the first days; wide; long, with an optional column `model`. Values are times the
    manifest's factor. A repeated (ticker, date) raises.
    """
    alpha = manifest_alpha(spark, f"{folder}/model_manifest_k{k}.json")
    days = calendar.select("date").distinct()
    grid = days.crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in tickers], "ticker string")))  # the portfolio's list
    if ticker_folder is not None:
        found = None
        for t in tickers:
            df = read_if_there(spark, f"{ticker_folder}/{t}.parquet")
            df = read_if_there(spark, f"{ticker_folder}/{t}.csv", "csv", header=True, inferSchema=True) if df is None else df
            use = None if df is None else value if value in df.columns else _first(TICKER_FILE_VALUES, df.columns) or next(iter(_numbers(df)[::-1]), None)
            if use is None:
                continue
            on = _first(TICKER_FILE_DATES, df.columns)
            one = one_each(_named(df, on, F.lit(t), use)) if on else _vector(df, use, days, t, tail).select("ticker", "date", "pred")
            found = one if found is None else found.unionByName(one)
    else:
        df = spark.read.parquet(find_forecasts(spark, folder, k))
        keyless = not {"date", "Date", "dt", "timestamp", "ticker", "symbol"} & set(df.columns)
        if keyless and rows_path is not None and {"y_true", "pred_en", "pred_gbm"} <= set(df.columns):
            found = by_position(df, spark.read.parquet(rows_path), value)
        elif keyless and "y_true" in df.columns and {"pred_gbm", "pred_en", "pred"} & set(df.columns):
            if single not in tickers or value not in df.columns:
                raise ValueError("a file without dates and tickers needs `single`, one of the tickers, and the name of its forecast column")
            found = _vector(df, value, days, single, tail=False)
        else:
            names = guess_columns(df, date=date, ticker=ticker, pred=pred)
            if names is None:
                found = one_each(_long(df, _first(DATES, df.columns)))
            else:
                if model and "model" in df.columns:
                    df = df.where(F.lower("model") == model.lower())
                found = one_each(_named(df, *names))
    if found is None:
        return grid.select("ticker", "date", F.lit(None).cast("double").alias("pred"))
    return grid.join(found, ["ticker", "date"], "left").select("ticker", "date", (F.col("pred") * alpha).alias("pred"))


def align(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """Forecasts on the days of bars, the last known one carried forward."""
    d = bars.select("ticker", "date").join(forecasts, ["ticker", "date"], "left")
    return d.withColumn("pred", F.last("pred", ignorenulls=True).over(by_ticker().rowsBetween(UNBOUNDED, 0)))
