"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import symbol_key
from ..operators import backtest, dataset, features, forecasters, metrics, ml, regimes, sizing
from ..sources import bars as src
from ..sources import forecasts as fsrc
from ..sources.paths import saved, shared_folder
from ..streaming.bars import stream_hourly
from ..streaming.states import live_states
from . import oracle as q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sql_rounded(select: str, digits: int, *columns: str) -> str:
    """A query whose last SELECT reads `select`'s columns with some rounded."""
    return select.replace("{R}", ", ".join(f"round({c}, {digits}) AS {c}" for c in columns))


def _returns(spark, sf_dir) -> DataFrame:
    return features.log_returns(src.daily(spark, sf_dir))


def _pred(spark, sf_dir) -> DataFrame:
    """(ticker, date, y, pred): the next ten days' volatility, and that of the last ten as its forecast."""
    d = features.realized_vol(_returns(spark, sf_dir), (10,))
    from ..functions.rolling import roll

    return d.select("ticker", "date", F.sqrt(roll(F.sum, F.col("ret") * F.col("ret"), 1, 10, 10) / 10).alias("y"), F.col("rv10").alias("pred"))


# --- bars, alignment, reshaping ---

@query(f"WITH {q.bars()} SELECT ticker, date, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume FROM bars")
def bars_daily(spark, sf_dir):
    return rounded(src.daily(spark, sf_dir).drop("adj_close"), 9, "open", "high", "low", "close")


@query("""SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, round(arg_min(value, row(ts, event_id)), 6) AS open,
    round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, row(ts, event_id)), 6) AS close,
    CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""")
def bars_hourly(spark, sf_dir):
    return rounded(src.hourly(spark, sf_dir).drop("adj_close"), 6, "open", "high", "low", "close")


@query(f"""WITH {q.bars('l_suppkey')} SELECT ticker, date, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low,
    round(close, 9) AS close, volume FROM bars""")
def bars_supplier(spark, sf_dir):
    return rounded(src.by_supplier(spark, sf_dir).drop("adj_close"), 9, "open", "high", "low", "close")


@query(f"""WITH {q.bars()} SELECT ticker, date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS week, round(arg_max(close,
    date), 9) AS close FROM bars GROUP BY 1, 2""")
def bars_weekly(spark, sf_dir):
    return rounded(src.weekly(src.daily(spark, sf_dir)), 9, "close")


_PRIORITY = "o AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2)"
_GRID = f"""WITH {_PRIORITY},
    c AS (SELECT ticker, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
    FROM o GROUP BY ticker),
    j AS (SELECT c.ticker AS ticker, c.date AS date, close
    FROM c LEFT JOIN o ON o.ticker = c.ticker AND o.date = c.date)"""


def _gaps(spark, sf_dir) -> DataFrame:
    b = src.by_priority(spark, sf_dir)
    return src.calendar(b).join(b.select("ticker", "date", "close"), ["ticker", "date"], "left")


@query(f"{_GRID} SELECT ticker, date, round(close, 9) AS close, round(last_value(close IGNORE NULLS) OVER {q.frame(None, 0)}, 9) AS filled FROM j")
def calendar_asof(spark, sf_dir):
    """Every day of a ticker with its last known close."""
    from ..functions.rolling import UNBOUNDED, by_ticker

    d = _gaps(spark, sf_dir)
    return rounded(d.withColumn("filled", F.last("close", ignorenulls=True).over(by_ticker().rowsBetween(UNBOUNDED, 0))), 9, "close", "filled")


@query(f"""{_GRID},
    f AS (SELECT *, last_value(close IGNORE NULLS) OVER {q.frame(None, 0)} AS x
    FROM j) SELECT ticker, date, round(x / lag(x) OVER ({q.W}) - 1, 8) AS ret
    FROM f""")
def simple_returns_pad(spark, sf_dir):
    return rounded(features.simple_returns(_gaps(spark, sf_dir), pad=True), 8, "ret").select("ticker", "date", "ret")


@query(f"{_GRID} SELECT ticker, date, round(close / lag(close) OVER ({q.W}) - 1, 8) AS ret FROM j")
def simple_returns_nofill(spark, sf_dir):
    return rounded(features.simple_returns(_gaps(spark, sf_dir), pad=False), 8, "ret").select("ticker", "date", "ret")


@query(f"""WITH {q.bars()} SELECT date, round(max(CASE WHEN ticker = 'A' THEN close END), 9) AS "A", round(max(CASE
    WHEN ticker = 'N' THEN close END),
    9) AS "N", round(max(CASE WHEN ticker = 'R' THEN close END), 9) AS "R"
    FROM bars GROUP BY date""")
def close_wide(spark, sf_dir):
    return rounded(src.to_wide(src.daily(spark, sf_dir), ["A", "N", "R"]), 9, "A", "N", "R")


@query(f"WITH {q.bars()} SELECT date, ticker, round(close, 9) AS close FROM bars WHERE close IS NOT NULL")
def close_long(spark, sf_dir):
    return rounded(src.to_long(src.to_wide(src.daily(spark, sf_dir), ["A", "N", "R"])), 9, "close")


@query("""SELECT event_type AS ticker, CAST(ts AS DATE) AS date, round(arg_min(value, row(ts, event_id)), 6) AS first_value,
    round(arg_max(value, row(ts, event_id)), 6) AS last_value
    FROM events GROUP BY 1, 2""")
def dedupe_first_last(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), "ts", "event_id", "value")
    return rounded(src.ends_of_day(e, "value", "ts", "event_id"), 6, "first_value", "last_value")


_ALIAS = [("eth_usd", 1.0), ("BTC", 2.0), ("sol-usd", 3.0), ("doge", 4.0)]


@query("""SELECT s.symbol AS symbol, m.value AS value
    FROM (VALUES ('BTC-USD'), ('ETH-USD'), ('SOL'), ('XRP')) s(symbol)
    LEFT JOIN (VALUES ('eth_usd', 1.0::DOUBLE), ('BTC', 2.0::DOUBLE), ('sol-usd', 3.0::DOUBLE), ('doge', 4.0::DOUBLE)) m(name,
    value) ON regexp_replace(upper(replace(s.symbol, '_', '-')), '-USD$', '') = regexp_replace(upper(replace(m.name,
    '_', '-')), '-USD$', '')""")
def symbol_alias_join(spark, sf_dir):
    s = spark.createDataFrame([("BTC-USD",), ("ETH-USD",), ("SOL",), ("XRP",)], "symbol string")
    m = spark.createDataFrame(_ALIAS, "name string, value double")
    return s.join(m, symbol_key(F.col("symbol")) == symbol_key(F.col("name")), "left").select("symbol", "value")


# --- features ---

@query(f"{q.BASE} SELECT ticker, date, round(ret, 8) AS ret FROM r")
def log_returns(spark, sf_dir):
    return rounded(_returns(spark, sf_dir), 8, "ret").select("ticker", "date", "ret")


@query(f"{q.BASE} " + " UNION ALL ".join(f"SELECT date, ticker, {k} AS k, round({q.label(k)}, 8) AS label FROM r" for k in (5, 10, 20)))
def labels(spark, sf_dir):
    return rounded(features.forward_labels(_returns(spark, sf_dir)), 8, "label")


_LABELS = ", ".join([f"lb AS ({' UNION ALL '.join(f'SELECT date, ticker, {k} AS k, {q.label(k)} AS label FROM r' for k in (5, 10, 20))})"])
_SANITY = f"""{q.BASE}, {_LABELS}, sn AS (SELECT k, ticker, count(label) AS n, min(date) FILTER (label IS NOT NULL) AS start,
    max(date) FILTER (label IS NOT NULL) AS "end", avg(label) AS mean, quantile_cont(label, 0.5) AS median,
CASE WHEN count(label) = 1 THEN 0.0 ELSE stddev_samp(label) END AS std, quantile_cont(label, 0.1) AS p10, quantile_cont(label,
    0.9) AS p90 FROM lb GROUP BY k, ticker)"""


@query(sql_rounded(f'{_SANITY} SELECT k, ticker, n, start, "end", {{R}} FROM sn', 8, "mean", "median", "std", "p10", "p90"))
def label_sanity(spark, sf_dir):
    return rounded(metrics.label_sanity(features.forward_labels(_returns(spark, sf_dir))), 8, "mean", "median", "std", "p10", "p90")


@query(f"""{_SANITY} SELECT k, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'round(avg({c}), 8) AS {c}' for c in ('mean', 'median', 'std', 'p10', 'p90'))}
    FROM sn GROUP BY k""")
def label_sanity_by_k(spark, sf_dir):
    return rounded(metrics.label_sanity_by_k(features.forward_labels(_returns(spark, sf_dir))), 8, "mean", "median", "std", "p10", "p90")


@query(f"""{q.BASE} SELECT ticker, date, round({q.rv(5)}, 8) AS rv5, round({q.rv(10)}, 8) AS rv10, round({q.rv(20)}, 8) AS rv20,
    round(sqrt({q.roll('sum', 'ret * ret', -9, 0, 10)}), 8) AS rvs10
    FROM r""")
def realized_vol(spark, sf_dir):
    return rounded(features.realized_vol_sum(features.realized_vol(_returns(spark, sf_dir)), 10), 8, "rv5", "rv10", "rv20", "rvs10").select("ticker", "date", "rv5", "rv10", "rv20", "rvs10")


def _feature(name: str, sql_columns: dict[str, int], fn) -> None:
    def run(spark, sf_dir):
        d = fn(_returns(spark, sf_dir))
        return d.select("ticker", "date", *(F.round(c, n).alias(c) for c, n in sql_columns.items()))

    run.__name__ = name
    query(f"{q.BASE}, {q.FEATURES} SELECT ticker, date, {', '.join(f'round({c}, {n}) AS {c}' for c, n in sql_columns.items())} FROM f3")(run)


_feature("parkinson", {"park_d": 8}, lambda d: d.withColumn("park_d", features.parkinson()))
_feature("vol_of_vol", {"d_rv10": 8, "vov": 8}, lambda d: features.vol_of_vol(features.realized_vol(d, (10,))))
_feature("skew_kurt", {"skew20": 6, "kurt20": 6}, features.shape)
_feature("slope20", {"slope20": 8}, features.slope)
_feature("drawdown60", {"dd60": 8}, features.drawdown)
_feature("ema9", {"ema9": 4}, features.recursive)
_feature("macd", {"macd": 4, "macd_signal": 4, "macd21": 4}, features.recursive)
_feature("ewma94", {"ewma94": 8}, features.recursive)


@query(f"WITH {q.bars()} SELECT ticker, date, {q.CALENDAR.replace('1.0', '1.0::DOUBLE').replace('0.0', '0.0::DOUBLE')} FROM bars")
def calendar_onehot(spark, sf_dir):
    return src.daily(spark, sf_dir).select("ticker", "date", *features.calendar_columns())


_F8 = [c for c in features.NUMERIC if c not in ("ema9", "macd21", "skew20", "kurt20")]
_FR = ", ".join([*(f"round({c}, 8) AS {c}" for c in _F8), "round(ema9, 4) AS ema9", "round(macd21, 4) AS macd21", "round(skew20, 6) AS skew20", "round(kurt20, 6) AS kurt20", "round(label, 8) AS label"])


def _rounded_features(d: DataFrame) -> DataFrame:
    return rounded(rounded(rounded(d, 8, *_F8, "label"), 4, "ema9", "macd21"), 6, "skew20", "kurt20")


@query(f"{q.BASE}, {q.FEATURES}, m AS (SELECT date, ticker, {q.MASKED}, label FROM f3) SELECT date, ticker, {_FR} FROM m")
def features_long(spark, sf_dir):
    return _rounded_features(features.build(src.daily(spark, sf_dir)).drop(*features.DAYS, *features.MONTHS))


def _dataset(spark, sf_dir) -> DataFrame:
    return dataset.split(features.build(src.daily(spark, sf_dir), impute=True))


@query(f"{q.DATASET} SELECT date, ticker, split, {_FR} FROM s")
def dataset_split(spark, sf_dir):
    return _rounded_features(_dataset(spark, sf_dir).drop(*features.DAYS, *features.MONTHS))


def _saved_dataset(spark, sf_dir) -> DataFrame:
    """The same, written first: for queries that read it several times."""
    return saved(_dataset(spark, sf_dir), "dataset")


_HOLES = f"hl AS (SELECT ticker, date, CASE WHEN day(date) % 3 = 0 THEN NULL ELSE ret END AS x FROM r)"


@query(f"{q.BASE}, {_HOLES} SELECT ticker, date, round(x, 8) AS x FROM (SELECT ticker, date, {q.filled('x')} FROM hl)")
def impute_past_median(spark, sf_dir):
    """Returns with every third calendar day taken out, filled from the past."""
    d = _returns(spark, sf_dir).select("ticker", "date", F.when(F.dayofmonth("date") % 3 != 0, F.col("ret")).alias("x"))
    return rounded(features.past_median(d, ["x"]), 8, "x")


_WIN = dataset.winsor_columns(list(features.NUMERIC))


@query(f"""{q.DATASET},
    cp AS (SELECT {', '.join(f'quantile_cont({c}, 0.005) AS {c}_lo, quantile_cont({c}, 0.995) AS {c}_hi' for c in _WIN)}
    FROM s WHERE split = 'train') SELECT date, ticker, {', '.join(f'round(least(greatest({c}, {c}_lo), {c}_hi), 6) AS {c}' for c in _WIN)}
    FROM s CROSS JOIN cp""")
def winsor_train(spark, sf_dir):
    return rounded(dataset.winsorize(_saved_dataset(spark, sf_dir), _WIN), 6, *_WIN).select("date", "ticker", *_WIN)


_NUM = list(features.NUMERIC)


@query(f"""{q.DATASET},
    sc AS (SELECT {', '.join(f'avg({c}) AS {c}_mu, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS {c}_sd' for c in _NUM)}
    FROM s WHERE split = 'train') SELECT date, ticker, {', '.join(f'round(({c} - {c}_mu) / {c}_sd, 5) AS {c}' for c in _NUM)}
    FROM s CROSS JOIN sc""")
def zscore_train(spark, sf_dir):
    return rounded(dataset.scale(_saved_dataset(spark, sf_dir), _NUM), 5, *_NUM).select("date", "ticker", *_NUM)


@query(f"{q.BASE}, {q.FEATURES}, m AS (SELECT ticker, {q.MASKED} FROM f3), t AS (SELECT ticker, {', '.join(f'avg(CAST({c} IS NULL AS INT)) AS {c}' for c in _NUM)} FROM m GROUP BY ticker) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 10) AS rate FROM t" for c in _NUM))
def missingness(spark, sf_dir):
    return rounded(dataset.missing_rates(features.build(src.daily(spark, sf_dir)), _NUM), 10, "rate")


@query(f"""{q.DATASET} SELECT ticker, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
    count(*) FILTER (split = 'test') AS test,
    count(*) AS total FROM s GROUP BY ticker""")
def split_counts(spark, sf_dir):
    return dataset.split_counts(_dataset(spark, sf_dir))


@query(f"""{q.DATASET}, o AS (SELECT *, row_number() OVER (ORDER BY date, ticker) AS rk, count(*) OVER () AS t FROM s),
fo AS (SELECT * FROM (VALUES (1, 0.625), (2, 0.75), (3, 0.875)) v(fold, a)),
ro AS (SELECT fold, date, CASE WHEN rk <= floor(a * t) THEN 'train' WHEN rk <= floor((a + 0.09375) * t) THEN 'val' END AS role FROM o CROSS JOIN fo)
SELECT fold, role, count(*) AS n, min(date) AS start, max(date) AS "end"
    FROM ro WHERE role IS NOT NULL GROUP BY fold, role""")
def time_folds(spark, sf_dir):
    """Rows by fold and role of expanding folds over the rows by date."""
    return dataset.folds(_saved_dataset(spark, sf_dir)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("start"), F.max("date").alias("end"))


# --- forecasters ---

@query(f"{q.BASE}, {q.V1} SELECT ticker, date, round(pred_vol, 8) AS pred_vol FROM v1")
def vol_v1(spark, sf_dir):
    return rounded(forecasters.ewma_blend(src.daily(spark, sf_dir)), 8, "pred_vol").select("ticker", "date", "pred_vol")


@query(f"{q.BASE}, {q.V2} SELECT ticker, date, round(pred_vol, 8) AS pred_vol FROM v2")
def vol_v2(spark, sf_dir):
    return rounded(forecasters.lagged_blend(src.daily(spark, sf_dir)), 8, "pred_vol").select("ticker", "date", "pred_vol")


@query(f"{q.BASE}, {q.V3} SELECT ticker, date, round(pred_vol, 8) AS pred_vol FROM v3")
def vol_v3_lookahead(spark, sf_dir):
    return rounded(forecasters.legacy_lookahead(src.daily(spark, sf_dir)), 8, "pred_vol").select("ticker", "date", "pred_vol")


@query(f"WITH {q.bars()}, {q.V4} SELECT ticker, round(pred_vol, 8) AS pred_vol FROM v4")
def vol_v4_snapshot(spark, sf_dir):
    return rounded(forecasters.legacy_snapshot(src.daily(spark, sf_dir)), 8, "pred_vol")


@query(f"""{q.BASE}, {q.V5} SELECT ticker, idx, date, round(close, 9) AS close, round(ret, 8) AS ret, round(ewma32, 8) AS ewma32,
    round(stdev32, 8) AS stdev32, round(pred_vol, 8) AS pred_vol, round(CASE WHEN pred_vol <> 0 THEN 50000.0 / (close * pred_vol) END,
    6) AS position_size FROM v5""")
def legacy_vectors(spark, sf_dir):
    return rounded(rounded(rounded(forecasters.legacy_vectors(src.daily(spark, sf_dir)), 9, "close"), 8, "ret", "ewma32", "stdev32", "pred_vol"), 6, "position_size")


@query(f"""{q.BASE}, {q.V1},
    te AS (SELECT r.ticker AS ticker, r.date AS date, pred_vol, {q.roll('sum', 'sret2 * sret2', -19, 0, 20).replace('ticker', 'r.ticker').replace('ORDER BY date', 'ORDER BY r.date')} AS s2
    FROM (SELECT *, CASE WHEN rn > 2 THEN sret END AS sret2
    FROM r) r LEFT JOIN v1 ON v1.ticker = r.ticker AND v1.date = r.date)
    SELECT ticker, date, round(pred_vol, 8) AS predicted, round(sqrt(s2), 8) AS realized, round(pred_vol - sqrt(s2),
    8) AS error FROM te WHERE pred_vol IS NOT NULL AND s2 IS NOT NULL""")
def tracking_error(spark, sf_dir):
    return rounded(forecasters.tracking_error(src.daily(spark, sf_dir)), 8, "predicted", "realized", "error")


# --- sizing and backtests ---

@query(f"""{q.BASE}, {q.V1}, {q.WEIGHTS}, {q.BEFORE},
    lv AS (SELECT ticker, arg_max(pred_vol, date) AS pv
    FROM v1 WHERE pred_vol IS NOT NULL GROUP BY ticker)
    SELECT lv.ticker AS ticker, portw, round(price, 9) AS price_used, round(pv, 8) AS predicted_vol, round(50000.0 * portw / (price * pv),
    6) AS shares FROM lv JOIN lastp ON lastp.ticker = lv.ticker JOIN weights ON weights.ticker = lv.ticker""")
def basket_snapshot(spark, sf_dir):
    return rounded(rounded(rounded(sizing.basket_snapshot(src.daily(spark, sf_dir), sizing.weights_table(spark)), 9, "price_used"), 8, "predicted_vol"), 6, "shares")


@query(f"""WITH {q.bars()}, {q.V4}, {q.WEIGHTS}, {q.BEFORE}
    SELECT v4.ticker AS ticker, portw, mult, price AS last_price, round(pred_vol, 8) AS pred_vol, round(25000.0 * portw / (price * pred_vol * mult),
    6) AS units, round(25000.0 * portw / (price * pred_vol * mult) * price * mult, 4) AS notional_alloc
    FROM v4 JOIN lastp ON lastp.ticker = v4.ticker JOIN weights ON weights.ticker = v4.ticker""")
def ewma_snapshot(spark, sf_dir):
    return rounded(rounded(rounded(sizing.ewma_snapshot(src.daily(spark, sf_dir), sizing.weights_table(spark)), 4, "notional_alloc"), 8, "pred_vol"), 6, "units")


def _ml(spark, sf_dir) -> DataFrame:
    """A stand-in model's forecasts (ticker, date, pred)."""
    return _pred(spark, sf_dir).select("ticker", "date", "pred")


@query(f"""{q.BASE}, {q.WEIGHTS}, {q.BEFORE},
    pr AS (SELECT ticker, date, {q.rv(10)} AS pred
    FROM r),
    lv AS (SELECT ticker, arg_max(pred, date) AS pv
    FROM pr WHERE pred IS NOT NULL GROUP BY ticker)
    SELECT lv.ticker AS ticker, portw, mult, price AS last_price, round(pv, 8) AS pred_vol, round(50000.0 * 2.5 * (0.02 / 19) * portw / (price * pv * mult),
    6) AS units, round(50000.0 * 2.5 * (0.02 / 19) * portw / (price * pv * mult) * price * mult, 4) AS notional_alloc
    FROM lv JOIN lastp ON lastp.ticker = lv.ticker JOIN weights ON weights.ticker = lv.ticker""")
def ml_snapshot(spark, sf_dir):
    return rounded(rounded(rounded(sizing.ml_snapshot(_ml(spark, sf_dir), src.daily(spark, sf_dir), sizing.weights_table(spark)), 4, "notional_alloc"), 8, "pred_vol"), 6, "units")


def _portfolio_sql() -> str:
    shares = ", ".join(f"{v} AS {c}" for c, v in {"share_ewma": "round(alloc_ewma / sum(alloc_ewma) OVER (), 4)", "share_ml": "round(alloc_ml / sum(alloc_ml) OVER (), 4)", "ratio": "round(50000.0 * 2.5 * (0.02 / 19) / 25000.0 * vol_ewma / vol_ml, 3)"}.items())
    return f"""SELECT ticker, round(units_ewma, 4) AS units_ewma, round(units_ml, 4) AS units_ml, round(alloc_ewma, 2) AS alloc_ewma,
    round(alloc_ml, 2) AS alloc_ml, {shares}, state FROM (
SELECT a.ticker AS ticker, a.pred_vol AS vol_ewma, b.pred_vol AS vol_ml, a.units AS units_ewma, b.units AS units_ml, a.notional_alloc AS alloc_ewma, b.notional_alloc AS alloc_ml
    FROM ({ORACLES['ewma_snapshot']}) a FULL JOIN ({ORACLES['ml_snapshot']}) b ON a.ticker = b.ticker)
CROSS JOIN ({q.STATE} SELECT arg_max(state, date) AS state FROM ds)"""


@query(_portfolio_sql())
def portfolio_summary(spark, sf_dir):
    b, w = src.daily(spark, sf_dir), sizing.weights_table(spark)
    d = sizing.portfolio_summary(sizing.ewma_snapshot(b, w), sizing.ml_snapshot(_ml(spark, sf_dir), b, w), daily_state(spark, sf_dir))
    return rounded(rounded(rounded(d, 4, "units_ewma", "units_ml"), 2, "alloc_ewma", "alloc_ml"), 4, "share_ewma", "share_ml").withColumn("ratio", F.round("ratio", 3))


def _positions(spark, sf_dir, provider: str) -> DataFrame:
    b = src.daily(spark, sf_dir)
    f = forecasters.lagged_blend(b) if provider == "ewma" else fsrc.align(_ml(spark, sf_dir), b).withColumnRenamed("pred", "pred_vol")
    return backtest.weekly_positions(b, f.select("ticker", "date", "pred_vol"), sizing.weights_table(spark))


@query(f"""{q.BASE}, {q.V2}, {q.weekly_positions('v2')}
    SELECT ticker, week, round(price, 9) AS price, round(vol, 8) AS vol, round(shares, 6) AS shares, round(pnl, 2) AS pnl
    FROM wp""")
def weekly_backtest(spark, sf_dir):
    return rounded(rounded(rounded(rounded(_positions(spark, sf_dir, "ewma"), 9, "price"), 8, "vol"), 6, "shares"), 2, "pnl")


@query(f"""{q.BASE}, {q.V2}, {q.weekly_positions('v2')}
    SELECT week, round(pnl, 2) AS pnl, round(sum(pnl) OVER (ORDER BY week), 2) AS cum_pnl, round(sum(pnl) OVER (ORDER BY week) / 50000.0,
    6) AS cum_return FROM ws""")
def weekly_series(spark, sf_dir):
    return rounded(rounded(backtest.weekly_series(_positions(spark, sf_dir, "ewma")), 2, "pnl", "cum_pnl"), 6, "cum_return")


def _summary_sql(provider: str, ctes: str) -> str:
    return f"""SELECT '{provider}' AS provider, * FROM ({q.BASE}, {ctes}, z AS (SELECT *, max(pnl) OVER (ORDER BY week) - pnl AS dd
    FROM ws) SELECT count(*) AS weeks, round(arg_max(pnl, week), 2) AS cum_pnl, round(arg_max(pnl, week) / 50000.0, 6) AS cum_return,
    round(avg(pnl), 2) AS mean_weekly_pnl, round(stddev_samp(pnl), 2) AS std_weekly_pnl, round(avg(pnl) / stddev_samp(pnl),
    6) AS sharpe_weekly, round(max(dd), 2) AS max_drawdown FROM z)"""


_MLV = f"""pm AS (SELECT ticker, date, {q.rv(10)} AS pv0
    FROM r),
    vm AS (SELECT ticker, date, last_value(pv0 IGNORE NULLS) OVER {q.frame(None, 0)} AS pred_vol
    FROM pm)"""


@query(_summary_sql("legacy", f"{q.V2}, {q.weekly_positions('v2')}") + " UNION ALL " + _summary_sql("ml", f"{_MLV}, {q.weekly_positions('vm')}"))
def ab_compare(spark, sf_dir):
    out = None
    for name, provider in (("legacy", "ewma"), ("ml", "ml")):
        d = backtest.weekly_summary(backtest.weekly_series(_positions(spark, sf_dir, provider))).select(F.lit(name).alias("provider"), "*")
        out = d if out is None else out.unionByName(d)
    return rounded(rounded(out, 2, "cum_pnl", "mean_weekly_pnl", "std_weekly_pnl", "max_drawdown"), 6, "cum_return", "sharpe_weekly")


_DAILY = f"""{q.BASE}, {q.V3}, {q.WEIGHTS},
    fx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back
    FROM v3) WHERE back > 55),
    dp AS (SELECT fx.ticker AS ticker, fx.date AS date, close AS price, portw, CASE WHEN close * pred_vol <> 0 THEN 50000.0 * portw / (close * pred_vol) END AS shares,
    close - lag(close) OVER (PARTITION BY fx.ticker ORDER BY fx.date) AS chg
    FROM fx JOIN weights ON weights.ticker = fx.ticker),
    dq AS (SELECT *, -1.0 * chg * shares AS pnl
    FROM dp WHERE chg IS NOT NULL),
    dt AS (SELECT date, coalesce(sum(pnl), 0.0) AS pnl
    FROM dq GROUP BY date),
    de AS (SELECT date, pnl, sum(pnl) OVER (ORDER BY date) - first_value(pnl) OVER (ORDER BY date) AS cum
    FROM dt),
    dz AS (SELECT date, pnl, cum, 100000.0 + cum AS equity
    FROM de)"""


def _daily(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    b = src.daily(spark, sf_dir)
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    f = forecasters.legacy_lookahead(b).withColumn("back", back).where("back > 55").select("ticker", "date", "pred_vol")
    return backtest.daily_positions(b, f, sizing.weights_table(spark))


@query(f"{_DAILY} SELECT date, round(pnl, 2) AS pnl, round(cum, 2) AS cum, round(equity, 2) AS equity FROM dz")
def legacy_total(spark, sf_dir):
    return rounded(backtest.daily_series(_daily(spark, sf_dir)), 2, "pnl", "cum", "equity")


@query(f"""{_DAILY} SELECT date, ticker, round(coalesce(shares, 0.0), 6) AS shares, round(price, 9) AS price, round(coalesce(shares,
    0.0) * price, 2) AS dollar_value, portw AS weight, 'ewma_legacy' AS vol_provider
    FROM dq""")
def holdings_long(spark, sf_dir):
    return rounded(rounded(rounded(backtest.holdings(_daily(spark, sf_dir), "ewma_legacy"), 6, "shares"), 9, "price"), 2, "dollar_value")


@query(f"""{_DAILY}, mm AS (SELECT *, CASE WHEN lag(equity) OVER (ORDER BY date) <> 0 THEN pnl / lag(equity) OVER (ORDER BY date)
    ELSE 0.0 END AS ret, equity / max(equity) OVER (ORDER BY date) - 1 AS dd FROM dz),
ma AS (SELECT arg_max(equity, date) / arg_min(equity, date) AS total, count(*) AS days, stddev_samp(coalesce(ret, 0.0)) AS sd,
    avg(coalesce(ret, 0.0)) AS mu, min(dd) AS mdd, avg(CAST(pnl > 0 AS INT)) AS hit, coalesce(avg(pnl) FILTER (pnl > 0),
    0.0) AS w, coalesce(avg(-pnl) FILTER (pnl < 0), 0.0) AS l FROM mm)
SELECT round(total - 1, 6) AS total_return, round(CASE WHEN total > 0 THEN pow(total, 365.0 / days) END - 1, 6) AS cagr,
    round(sd * sqrt(365.0), 6) AS vol_ann, round(mu / sd * sqrt(365.0), 6) AS sharpe, round(mdd, 6) AS max_drawdown,
    round(CASE WHEN mdd < 0 THEN (CASE WHEN total > 0 THEN pow(total, 365.0 / days) END - 1) / abs(mdd) END, 6) AS calmar,
    round(hit, 6) AS hit_rate, round(w, 2) AS avg_win, round(l, 2) AS avg_loss, days FROM ma""")
def backtest_metrics(spark, sf_dir):
    d = backtest.equity_metrics(backtest.daily_series(_daily(spark, sf_dir)))
    return rounded(rounded(d, 6, "total_return", "cagr", "vol_ann", "sharpe", "max_drawdown", "calmar", "hit_rate"), 2, "avg_win", "avg_loss")


# --- forecast quality ---

@query(f"""{q.PRED}, {q.DECILES} SELECT decile, count, round(mean_y, 8) AS mean_y, round(mean_pred, 8) AS mean_pred, round(mae,
    8) AS mae, round(mape, 8) AS mape FROM dt""")
def deciles(spark, sf_dir):
    return rounded(metrics.deciles(_pred(spark, sf_dir)), 8, "mean_y", "mean_pred", "mae", "mape")


@query(f"{q.PRED}, {q.DECILES} SELECT round(arg_max(mean_y, decile) / avg(mean_y), 8) AS lift FROM dt")
def top_decile_lift(spark, sf_dir):
    return rounded(metrics.top_decile_lift(metrics.deciles(_pred(spark, sf_dir))), 8, "lift")


@query(f"""{q.PRED} SELECT round(avg(ae), 8) AS mae, round(sqrt(avg((y - pp) * (y - pp))), 8) AS rmse, round(avg(ape), 8) AS mape,
    round(1 - sum((y - pp) * (y - pp)) / (var_pop(y) * count(*)), 8) AS r2, count(*) AS n
    FROM e""")
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(_pred(spark, sf_dir)), 8, "mae", "rmse", "mape", "r2")


@query(f"""{q.PRED} SELECT ticker, count(*) AS n, round(avg(ae), 8) AS mae, round(avg(ape), 8) AS mape, round(sqrt(avg(ae * ae)),
    8) AS rmse FROM e GROUP BY ticker""")
def by_ticker_metrics(spark, sf_dir):
    return rounded(metrics.by_ticker_metrics(_pred(spark, sf_dir)), 8, "mae", "mape", "rmse")


@query(f"{q.PRED} SELECT round(coalesce(quantile_cont(y / pp, 0.5), 1.0), 8) AS alpha, round(sum(y * pred) / sum(pred * pred), 8) AS slope FROM e")
def calibration(spark, sf_dir):
    d = _pred(spark, sf_dir).where("y is not null and pred is not null")
    return rounded(metrics.robust_alpha(d).crossJoin(metrics.calibration_slope(d)), 8, "alpha", "slope")


@query(f"{q.PRED} SELECT ticker, date, round({q.roll('avg', 'ape', -59, 0, 20)}, 8) AS mape FROM e")
def rolling_mape(spark, sf_dir):
    return rounded(metrics.rolling_mape(_pred(spark, sf_dir)), 8, "mape")


@query(f"""{q.PRED},
    b AS (SELECT min(y) AS a, max(y) AS z FROM e),
    h AS (SELECT CAST(least(49, floor((y - a) / ((z - a) / 50))) AS INTEGER) AS bin, a, z
    FROM e CROSS JOIN b) SELECT bin, round(min(a) + bin * (min(z) - min(a)) / 50, 8) AS lo, count(*) AS n
    FROM h GROUP BY bin""")
def label_histogram(spark, sf_dir):
    d = _pred(spark, sf_dir).where("y is not null and pred is not null")
    return rounded(metrics.histogram(d, "y"), 8, "lo")


def _ranked(columns: list[str]) -> str:
    return ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in columns)


@query(f"{q.DATASET}, rk AS (SELECT {_ranked([*_NUM, 'label'])} FROM s WHERE split = 'train') " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr(r_{c}, r_label), 6) AS rho FROM rk" for c in _NUM))
def spearman_features(spark, sf_dir):
    return rounded(metrics.spearman(_saved_dataset(spark, sf_dir).where("split = 'train'"), _NUM, "label"), 6, "rho")


@query(f"{q.DATASET} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, label), 6) AS r FROM s WHERE split = 'train'" for c in _NUM))
def pearson_features(spark, sf_dir):
    return rounded(metrics.pearson(_dataset(spark, sf_dir).where("split = 'train'"), _NUM, "label"), 6, "r")


_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query(f"{q.DATASET}, rk AS (SELECT {_ranked(_NUM)} FROM s WHERE split = 'train') SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(r_{a}, r_{b}), 6) AS rho FROM rk" for a, b in _PAIRS) + ") WHERE abs(rho) >= 0.5")
def redundant_pairs(spark, sf_dir):
    return rounded(metrics.correlated_pairs(_saved_dataset(spark, sf_dir).where("split = 'train'"), _NUM, 0.5), 6, "rho")


# --- regimes ---

def _regime(spark, sf_dir) -> DataFrame:
    b = src.daily(spark, sf_dir)
    sigma = features.realized_vol(features.log_returns(b), (10,)).select("ticker", "date", F.col("rv10").alias("sigma_hat"))
    return regimes.features(b, sigma, lookback=q.LOOK)


@query(f"""{q.REGIME} SELECT date, ticker, price, volume, round(sigma_hat, 8) AS sigma_hat, vol_tercile, round(ema_fast, 4) AS ema_fast,
    round(ema_slow, 4) AS ema_slow, round(ema_slope, 4) AS ema_slope, round(vwap_roll, 4) AS vwap_roll, round(vwap_z,
    6) AS vwap_z FROM g""")
def regime_features(spark, sf_dir):
    return rounded(rounded(rounded(_regime(spark, sf_dir), 4, "ema_fast", "ema_slow", "ema_slope", "vwap_roll"), 8, "sigma_hat"), 6, "vwap_z")


@query(f"{q.REGIME} SELECT date, ticker, state FROM lb")
def regime_labels(spark, sf_dir):
    return regimes.labels(_regime(spark, sf_dir))


@query(f"{q.REGIME} SELECT date, state FROM vt")
def regime_votes(spark, sf_dir):
    return regimes.votes(regimes.labels(_regime(spark, sf_dir)))


@query(f"{q.STATE} SELECT date, state FROM ds")
def daily_state(spark, sf_dir):
    return regimes.hysteresis(regimes.votes(regimes.labels(_regime(spark, sf_dir))))


@query(f"{q.STATE} SELECT from_state, to_state, round(prob, 10) AS prob FROM tr")
def transitions(spark, sf_dir):
    return rounded(regimes.transitions(daily_state(spark, sf_dir)), 10, "prob")


@query(f"{q.STATE} SELECT from_state AS state, round(1 / (1 - prob), 6) AS days FROM tr WHERE from_state = to_state")
def expected_duration(spark, sf_dir):
    return rounded(regimes.expected_durations(regimes.transitions(daily_state(spark, sf_dir))), 6, "days")


_TREES = {"risk_off": "bo * co + bo * cb + co * bc", "neutral": "ob * cb + ob * co + cb * oc", "risk_on": "oc * bc + oc * bo + bc * ob"}
_CELLS = ", ".join(f"max(prob) FILTER (from_state = '{a}' AND to_state = '{b}') AS {x}{y}" for x, a in zip("obc", regimes.STATES, strict=True) for y, b in zip("obc", regimes.STATES, strict=True) if x != y)


@query(f"{q.STATE}, cl AS (SELECT {_CELLS} FROM tr), w AS (" + " UNION ALL ".join(f"SELECT '{s}' AS state, {x} AS v FROM cl" for s, x in _TREES.items()) + ") SELECT state, round(v / sum(v) OVER (), 8) AS prob FROM w")
def stationary_distribution(spark, sf_dir):
    """SQL takes the sums over spanning trees of the three states."""
    return rounded(regimes.stationary(regimes.transitions(daily_state(spark, sf_dir))), 8, "prob")


@query(f'{q.STATE} SELECT run, state, start, "end", length FROM rl')
def state_runs(spark, sf_dir):
    return regimes.runs(daily_state(spark, sf_dir))


@query(f"{q.STATE} SELECT date, state, run, age FROM ag")
def state_age(spark, sf_dir):
    return regimes.ages(daily_state(spark, sf_dir))


@query(f"{q.STATE} SELECT state, age, round(hazard, 10) AS hazard FROM hz")
def hazards(spark, sf_dir):
    return rounded(regimes.hazards(daily_state(spark, sf_dir)), 10, "hazard")


@query(f"{q.STATE} SELECT state, age, round(hazard, 10) AS hazard FROM hs")
def hazards_smoothed(spark, sf_dir):
    return rounded(regimes.smooth(regimes.hazards(daily_state(spark, sf_dir))), 10, "hazard")


@query(f"""{q.STATE}, tm AS (SELECT from_state, sum(prob) AS mass FROM tr
    WHERE from_state <> to_state GROUP BY from_state), tt AS (SELECT state, max(age) AS top FROM hs GROUP BY state),
nc AS (SELECT ag.date AS date, ag.state AS state, ag.age AS age, 1 - coalesce(hs.hazard, 0.05) AS stay
    FROM ag LEFT JOIN tt ON tt.state = ag.state LEFT JOIN hs ON hs.state = ag.state AND hs.age = least(ag.age, top))
SELECT date, nc.state AS state, age, to_state, round(CASE WHEN nc.state = to_state THEN stay ELSE (1 - stay) * prob / mass END,
    8) AS prob FROM nc JOIN tr ON tr.from_state = nc.state JOIN tm ON tm.from_state = nc.state""")
def nowcast(spark, sf_dir):
    path = shared_folder(spark, "daily-state")  # a row a day, read four times
    daily_state(spark, sf_dir).write.parquet(path)
    s = spark.read.parquet(path)
    return rounded(regimes.nowcast(s, regimes.transitions(s), regimes.smooth(regimes.hazards(s))), 8, "prob")


# --- models and streams: no SQL ---

@query()
def elasticnet_fit(spark, sf_dir):
    return ml.fit_report(_saved_dataset(spark, sf_dir), "elasticnet")


@query()
def gbt_fit(spark, sf_dir):
    return ml.fit_report(_saved_dataset(spark, sf_dir), "gbt")


@query()
def feature_importance(spark, sf_dir):
    return ml.importance(_saved_dataset(spark, sf_dir))


@query(f"{q.DATASET}, rk AS (SELECT {_ranked(_NUM)} FROM s WHERE split = 'train') " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(r_{a}, r_{b}), 6) AS rho FROM rk" for a in _NUM for b in _NUM))
def rank_corr_matrix(spark, sf_dir):
    return rounded(ml.rank_matrix(_saved_dataset(spark, sf_dir).where("split = 'train'"), _NUM), 6, "rho")


@query(f"SELECT * FROM ({ORACLES['bars_hourly']}) WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def stream_bars_hourly(spark, sf_dir):
    """The hourly bars that a stream over the events has closed when its input is read."""
    return rounded(stream_hourly(spark, sf_dir).drop("adj_close"), 6, "open", "high", "low", "close")


@query(f"""WITH bh AS ({ORACLES['bars_hourly']}), hb AS (SELECT ticker, ts AS date, close FROM bh),
sa AS (SELECT ticker, date, close, {q.ema('close', '0.2')} AS f, {q.ema('close', '(2.0/22)')} AS s FROM hb),
sr AS (SELECT *, CASE WHEN f > s THEN 'risk_on' WHEN f < s THEN 'risk_off' ELSE 'neutral' END AS raw FROM sa),
sn AS (SELECT *, sum(nw) OVER (PARTITION BY ticker ORDER BY date) AS run FROM (
  SELECT *, CAST(raw IS DISTINCT FROM lag(raw) OVER (PARTITION BY ticker ORDER BY date) AS INTEGER) AS nw FROM sr)),
sg AS (SELECT *, row_number() OVER (PARTITION BY ticker, run ORDER BY date) AS raw_age FROM sn),
ss AS (SELECT *, coalesce(last_value(CASE WHEN raw_age >= 3 THEN raw END IGNORE NULLS) OVER w, first_value(raw) OVER w) AS state
  FROM sg WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, sum(sw) OVER (PARTITION BY ticker ORDER BY date) AS srun FROM (
  SELECT *, CAST(state IS DISTINCT FROM lag(state) OVER (PARTITION BY ticker ORDER BY date) AS INTEGER) AS sw FROM ss))
SELECT ticker, date AS ts, close, round(f, 6) AS ema_fast, round(s, 6) AS ema_slow, raw, state,
  row_number() OVER (PARTITION BY ticker, srun ORDER BY date) AS age FROM st
QUALIFY date <= (SELECT max(date) - INTERVAL 6 HOUR FROM hb)""")
def stream_states(spark, sf_dir):
    """Averages, trend states and ages of the hourly bars, replayed as a stream of several files in the order of time."""
    at = shared_folder(spark, "stream-states")
    b = src.hourly(spark, sf_dir).select("ticker", F.col("ts").cast("timestamp").alias("ts"), F.round("close", 6).alias("close"))
    b = saved(b.withColumn("at", F.unix_timestamp("ts").cast("double")), "hours")
    borders = [float("-inf"), *b.approxQuantile("at", [0.25, 0.5, 0.75], 0.01), float("inf")]
    for low, high in zip(borders, borders[1:], strict=False):  # one after the other: a stream takes files by age
        b.where((F.col("at") > low) & (F.col("at") <= high)).drop("at").write.mode("append").parquet(f"{at}/bars")
    bars = spark.readStream.schema("ticker string, ts timestamp, close double").option("maxFilesPerTrigger", 4).parquet(f"{at}/bars")
    out = live_states(bars, "6 hours").writeStream.outputMode("append").format("parquet").option("path", f"{at}/states").option("checkpointLocation", f"{at}/progress")
    run = out.trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    found = spark.read.parquet(f"{at}/states").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(found, 6, "ema_fast", "ema_slow")
