"""Queries over saved tables: what the sinks write is read back, and what the readers choose between is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import geometric_weights
from ..operators import backtest, dataset, features, forecasters, metrics, ml, regimes, sizing
from ..sources import bars as src
from ..sources import forecasts as fsrc
from ..sources import readers, sinks
from ..sources.paths import read_json, shared_folder, write_json
from . import oracle as q
from .catalog import _DAILY, _F8, _FR, _GRID, _LABELS, _NUM, ORACLES, _daily, _dataset, _gaps, _pred, QUERIES, _regime, _returns, _rounded_features, _saved_dataset, daily_state, query, rounded

TICKERS = ["A", "N", "R"]
__all__ = ["ORACLES", "QUERIES"]


# --- price scans ---

@query(f"{_GRID} SELECT ticker, date, round(last_value(close IGNORE NULLS) OVER {q.frame(None, 0)}, 9) AS price FROM j")
def scan_adjusted_filled(spark, sf_dir):
    """Adjusted closes with gaps carried forward."""
    b = _gaps(spark, sf_dir).withColumn("adj_close", F.col("close"))
    return rounded(readers.adjusted_close(b), 9, "price")


@query(f"{_GRID} SELECT ticker, date, round(close, 9) AS price FROM j WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def scan_adjusted_range(spark, sf_dir):
    """Adjusted closes of two years, gaps left."""
    b = _gaps(spark, sf_dir).withColumn("adj_close", F.col("close"))
    return rounded(readers.adjusted_close(b, fill=False, start="1995-01-01", end="1996-12-31"), 9, "price")


@query(f"""WITH {q.bars()} SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS INTEGER) AS idx,
    date, round(close, 9) AS price FROM bars""")
def scan_newest_first(spark, sf_dir):
    return rounded(readers.newest_first(src.daily(spark, sf_dir)), 9, "price")


@query(f"WITH {q.bars()} SELECT ticker, date, round(close, 9) AS price FROM bars")
def cached_close(spark, sf_dir):
    """Closes of two tickers from a saved table, those of the third from the source."""
    b, at = src.daily(spark, sf_dir), shared_folder(spark, "cached-close")
    sinks.write_table(b.where("ticker <> 'R'").select("ticker", "date", "close"), f"{at}/close")
    return rounded(readers.close_with_fallback(spark, f"{at}/close", b, TICKERS), 9, "price")


@query(f"""WITH {q.bars()} SELECT date, max(CASE WHEN ticker = 'A' THEN round(close, 9) END) AS "A", max(CASE
    WHEN ticker = 'N' THEN round(close,
    9) END) AS "N", max(CASE WHEN ticker = 'R' THEN round(close, 9) END) AS "R"
    FROM bars GROUP BY date""")
def saved_close_wide(spark, sf_dir):
    """The wide closes that saving bars leaves, as CSV."""
    paths = sinks.save_bars(src.daily(spark, sf_dir), shared_folder(spark, "bars"), TICKERS, csv=True)
    d = spark.read.option("header", True).csv(paths["close_wide_csv"])
    return d.select(F.to_date("date").alias("date"), *(F.round(F.col(t).cast("double"), 9).alias(t) for t in TICKERS))


_RET = f"{q.BASE} SELECT date, ticker, round(ret, 8) AS ret FROM r"


@query(_RET)
def saved_log_returns(spark, sf_dir):
    """Log returns as saved."""
    at = shared_folder(spark, "bars")
    sinks.save_bars(src.daily(spark, sf_dir), at)
    return rounded(readers.returns_or_close(spark, at), 8, "ret")


@query(_RET)
def returns_from_saved_close(spark, sf_dir):
    """Log returns of saved closes, where no returns are saved."""
    at = shared_folder(spark, "closes")
    sinks.write_table(src.daily(spark, sf_dir).select("date", "ticker", "close"), f"{at}/close", "ticker")
    return rounded(readers.returns_or_close(spark, at), 8, "ret")


@query(f"""WITH {q.bars()} SELECT date, ticker, round(open, 9) AS open, round(close, 9) AS close,
    CASE WHEN day(date) <> 13 THEN volume END AS volume FROM bars""")
def bars_from_csv(spark, sf_dir):
    """Bars read from CSV with other names, some numbers that aren't any and a row without a date."""
    at, b = shared_folder(spark, "csv"), src.daily(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    volume = F.when(F.dayofmonth("date") != 13, text("volume")).otherwise("n/a")
    out = b.select(text("date").alias("Date"), F.col("ticker").alias("Ticker"), *(text(c).alias(n) for c, n in (("open", "Price Open"), ("high", "HIGH"), ("low", "low"), ("close", "Close"), ("adj_close", "Adj Close"))), volume.alias("Volume"))
    bad = out.limit(1).withColumn("Date", F.lit("no date"))
    sinks.write_csv(out.unionByName(bad), at)
    return rounded(src.load_long(spark, at, "csv").select("date", "ticker", "open", "close", "volume"), 9, "open", "close")


# --- labels, features, data sets ---

@query(f"{q.BASE}, {_LABELS} SELECT date, ticker, round(label, 8) AS label FROM lb WHERE k = 10")
def saved_labels(spark, sf_dir):
    """The labels of one horizon, from its folder."""
    at = shared_folder(spark, "labels")
    sinks.save_labels(features.forward_labels(_returns(spark, sf_dir)), at)
    return rounded(readers.labels_of(spark, at, 10), 8, "label")


@query(f"{q.BASE}, {q.FEATURES}, m AS (SELECT date, ticker, {q.MASKED}, label FROM f3) SELECT date, ticker, {_FR} FROM m")
def saved_features(spark, sf_dir):
    """Raw features, saved and read."""
    at = shared_folder(spark, "features")
    sinks.save_features(features.build(src.daily(spark, sf_dir)), at)
    return _rounded_features(readers.raw_features(spark, at).drop(*features.DAYS, *features.MONTHS))


@query(f"""{q.BASE}, {q.FEATURES},
    m AS (SELECT date, ticker, {q.MASKED}, label
    FROM f3) SELECT ticker, count(*) AS n, count(rv20) AS known, round(avg(rv20), 8) AS rv20
    FROM m GROUP BY ticker""")
def saved_features_csv(spark, sf_dir):
    """The same as CSV, where there is no Parquet."""
    at = shared_folder(spark, "features")
    sinks.write_csv(features.build(src.daily(spark, sf_dir)), f"{at}/features_raw_long.csv")
    d = readers.raw_features(spark, at)
    return rounded(d.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count("rv20").alias("known"), F.avg("rv20").alias("rv20")), 8, "rv20")


@query(f"{q.DATASET} SELECT date, ticker, split, {_FR} FROM s WHERE split = 'val'")
def saved_split(spark, sf_dir):
    """The validation rows of a saved data set."""
    at = shared_folder(spark, "splits")
    sinks.save_splits(_dataset(spark, sf_dir), at)
    return _rounded_features(readers.splits(spark, at, "val").drop(*features.DAYS, *features.MONTHS))


@query(f"""{q.DATASET} SELECT split, count(*) AS rows, count(DISTINCT ticker) AS tickers, CAST(min(date) AS VARCHAR) AS start,
    CAST(max(date) AS VARCHAR) AS "end" FROM s GROUP BY split""")
def split_facts(spark, sf_dir):
    """The facts saved beside the splits."""
    at = shared_folder(spark, "splits")
    sinks.save_splits(_dataset(spark, sf_dir), at)
    facts = readers.split_facts(spark, at)
    return spark.createDataFrame([(s, f["rows"], f["tickers"], f["start"], f["end"]) for s, f in facts.items() if isinstance(f, dict)], "split string, rows long, tickers long, start string, end string")


@query(f"{q.DATASET} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 7) AS mean, round(stddev_pop({c}), 7) AS std FROM s WHERE split = 'train'" for c in _NUM))
def saved_scaler(spark, sf_dir):
    at = shared_folder(spark, "scaler")
    found = read_json(spark, sinks.save_scaler(_dataset(spark, sf_dir), _NUM, at))
    return rounded(spark.createDataFrame([(c, x["mean"], x["std"]) for c, x in found.items()], "feature string, mean double, std double"), 7, "mean", "std")


@query(f"""{q.DATASET} SELECT count(*) AS rows, 32 AS features, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
    count(*) FILTER (split = 'test') AS test FROM s""")
def dataset_counts(spark, sf_dir):
    return dataset.counts(_dataset(spark, sf_dir))


_KEPT = [c for c in _NUM if c != "rv20"]
_CAPPED = dataset.winsor_columns(_KEPT)
_SCALED = ", ".join(f"round(({c} - {c}_mu) / {c}_sd, 5) + 0.0 AS {c}" for c in _KEPT)  # no negative zeros


@query(f"""{q.DATASET}, cp AS (SELECT {', '.join(f'quantile_cont({c}, 0.005) AS {c}_lo, quantile_cont({c}, 0.995) AS {c}_hi' for c in _CAPPED)} FROM s WHERE split = 'train'),
    wz AS (SELECT date, ticker, split, {', '.join(f'least(greatest({c}, {c}_lo), {c}_hi) AS {c}' if c in _CAPPED else c for c in _KEPT)} FROM s CROSS JOIN cp),
    sc AS (SELECT {', '.join(f'avg({c}) AS {c}_mu, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS {c}_sd' for c in _KEPT)} FROM wz WHERE split = 'train')
    SELECT date, ticker, split, {_SCALED} FROM wz CROSS JOIN sc""")
def dataset_prepared(spark, sf_dir):
    """The data set without rv20, clipped and scaled."""
    d = dataset.prepare(features.build(src.daily(spark, sf_dir), impute=True), _NUM, winsor=True, drop=("rv20",))
    return rounded(d.select("date", "ticker", "split", *_KEPT), 5, *_KEPT)


@query(f"""SELECT r.lift AS lift, c.slope AS slope, c.alpha AS alpha, m.mae AS mae, m.n AS n
    FROM ({ORACLES['top_decile_lift']}) r CROSS JOIN ({ORACLES['calibration']}) c CROSS JOIN ({ORACLES['regression_metrics']}) m""")
def forecast_report(spark, sf_dir):
    """One row of the report of saved test forecasts."""
    at = shared_folder(spark, "report")
    _forecasts(spark, sf_dir).write.parquet(f"{at}/preds_test_k10.parquet")
    r = ml.report(spark.read.parquet(f"{at}/preds_test_k10.parquet"))
    one = r["lift"].crossJoin(r["slope"]).crossJoin(r["alpha"]).crossJoin(r["overall"].select("mae", "n"))  # a row each
    return rounded(one, 8, "lift", "slope", "alpha", "mae")


# --- forecasts in files ---

def _forecasts(spark, sf_dir) -> DataFrame:
    """(ticker, date, y_true, pred_gbm, pred_en): last known volatilities as two models' forecasts."""
    d = _pred(spark, sf_dir).where("pred is not null and y is not null")
    return d.select("ticker", "date", F.col("y").alias("y_true"), F.col("pred").alias("pred_gbm"), (F.col("pred") * 1.1).alias("pred_en"))


_PM = f"""{q.BASE},
    pm AS (SELECT ticker, date, {q.rv(10)} AS pv, {q.label(10)} AS y
    FROM r),
    pk AS (SELECT ticker, date, pv FROM pm WHERE pv IS NOT NULL AND y IS NOT NULL)"""
_ON_DAYS = """dd AS (SELECT DISTINCT date FROM bars),
    tt AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) t(ticker)),
    gr AS (SELECT ticker, date FROM tt CROSS JOIN dd)"""


@query(f"{_PM} SELECT ticker || '-USD' AS ticker, date, round(pv * 1.05, 8) AS pred FROM pk WHERE ticker <> 'R'")
def forecasts_daily_long(spark, sf_dir):
    """A long file with models as rows and other spellings of the symbols, times the model's factor."""
    at, d = shared_folder(spark, "forecasts"), _forecasts(spark, sf_dir)
    models = F.array(F.struct(F.lit("GradientBoosting").alias("model"), F.col("pred_gbm").alias("y_hat")), F.struct(F.lit("elasticnet").alias("model"), F.col("pred_en").alias("y_hat")))
    d.select(F.col("date").alias("Date"), F.concat(F.lower("ticker"), F.lit("_usd")).alias("Ticker"), F.explode(models).alias("m")).select("Date", "Ticker", "m.*").write.parquet(f"{at}/preds_test_k10.parquet")
    write_json(spark, f"{at}/model_manifest_k10.json", {"alpha_gbm": 1.05, "alpha_en": 2})
    return rounded(fsrc.daily_forecasts(spark, at, ["A-USD", "N-USD"]), 8, "pred")


def _wide(d: DataFrame, *names: tuple[str, str]) -> DataFrame:
    return d.groupBy("date").agg(*(F.max(F.when(F.col("ticker") == t, F.col("pred_gbm"))).alias(n) for t, n in names))


@query(f"""{_PM} SELECT ticker, date, round(pv, 8) AS pred
    FROM pk WHERE ticker <> 'R' UNION ALL SELECT DISTINCT t.ticker, pk.date, NULL
    FROM pk, (VALUES ('A'), ('N')) t(ticker) WHERE NOT EXISTS (SELECT 1
    FROM pk z WHERE z.date = pk.date AND z.ticker = t.ticker)""")
def forecasts_daily_wide(spark, sf_dir):
    """A wide CSV, whose columns for A and A-USD are averaged, without a manifest."""
    at = shared_folder(spark, "forecasts")
    _wide(_forecasts(spark, sf_dir), ("A", "a"), ("A", "A-USD"), ("N", "N"), ("R", "other")).write.option("header", True).csv(f"{at}/preds_test_k10.csv")
    return rounded(fsrc.daily_forecasts(spark, at, ["A", "N"]), 8, "pred")


@query(f"""{_PM}, {_ON_DAYS} SELECT gr.ticker AS ticker, gr.date AS date, round(pv * 0.9, 8) AS pred
    FROM gr LEFT JOIN pk ON pk.ticker = gr.ticker AND pk.date = gr.date""")
def forecasts_long(spark, sf_dir):
    """A provider's long file on the calendar, times a nested factor."""
    at, b = shared_folder(spark, "forecasts"), src.daily(spark, sf_dir)
    _forecasts(spark, sf_dir).select(F.col("date").alias("asof"), F.col("ticker").alias("security"), F.col("pred_gbm").alias("sigma_hat")).write.parquet(f"{at}/preds_TEST_k10.parquet")
    write_json(spark, f"{at}/model_manifest_k10.json", {"alpha": None, "meta": {"alpha_calibrator": 0.9}})
    return rounded(fsrc.provider_forecasts(spark, at, TICKERS, b), 8, "pred")


@query(f"""{_PM}, {_ON_DAYS} SELECT gr.ticker AS ticker, gr.date AS date, round(pv, 8) AS pred
    FROM gr LEFT JOIN pk ON pk.ticker = gr.ticker AND pk.date = gr.date""")
def forecasts_wide(spark, sf_dir):
    at, b = shared_folder(spark, "forecasts"), src.daily(spark, sf_dir)
    _wide(_forecasts(spark, sf_dir), *((t, t) for t in TICKERS)).withColumnRenamed("date", "index").write.parquet(f"{at}/preds_test_k10.pq")
    return rounded(fsrc.provider_forecasts(spark, at, TICKERS, b), 8, "pred")


@query(f"""{_PM}, {_ON_DAYS} SELECT gr.ticker AS ticker, gr.date AS date, round(CASE WHEN gr.ticker <> 'R' THEN pv END, 8) AS pred
    FROM gr LEFT JOIN pk ON pk.ticker = gr.ticker AND pk.date = gr.date""")
def forecasts_by_ticker_file(spark, sf_dir):
    """A file for each ticker: Parquet, CSV, and none."""
    at, d, b = shared_folder(spark, "forecasts"), _forecasts(spark, sf_dir), src.daily(spark, sf_dir)
    d.where("ticker = 'A'").select("date", "y_true", "pred_gbm").write.parquet(f"{at}/by/A.parquet")
    d.where("ticker = 'N'").select(F.col("date").alias("ts"), F.col("pred_gbm").alias("sigma")).write.option("header", True).csv(f"{at}/by/N.csv")
    return rounded(fsrc.provider_forecasts(spark, at, TICKERS, b, ticker_folder=f"{at}/by"), 8, "pred")


@query(f"""{_PM}, {_ON_DAYS} SELECT gr.ticker AS ticker, gr.date AS date, round(pv * 1.1, 8) AS pred
    FROM gr LEFT JOIN pk ON pk.ticker = gr.ticker AND pk.date = gr.date""")
def forecasts_by_position(spark, sf_dir):
    """Forecasts without keys, and the rows that they belong to, by their places in the files."""
    at, d, b = shared_folder(spark, "forecasts"), _forecasts(spark, sf_dir), src.daily(spark, sf_dir)
    saved = f"{at}/both"
    d.orderBy("ticker", "date").write.parquet(saved)
    both = fsrc.numbered(spark.read.parquet(saved))
    # Part files of several and unequal sizes, cut at other places on either side; their names go by position.
    forecasts, rows = (both.repartitionByRange(n, cut).sortWithinPartitions("position") for n, cut in ((3, F.sqrt("position")), (4, F.col("position") ** 3)))
    forecasts.select("y_true", "pred_en", "pred_gbm").write.parquet(f"{at}/preds_test_k10.parquet")
    rows.select("date", "ticker").write.parquet(f"{at}/rows")
    return rounded(fsrc.provider_forecasts(spark, at, TICKERS, b, rows_path=f"{at}/rows", value="pred_en"), 8, "pred")


@query(f"""{_PM}, {_ON_DAYS},
    va AS (SELECT pv, row_number() OVER (ORDER BY date) AS i
    FROM pk WHERE ticker = 'N'),
    vd AS (SELECT date, row_number() OVER (ORDER BY date) AS i
    FROM dd),
    vv AS (SELECT date, pv FROM vd JOIN va ON va.i = vd.i)
    SELECT gr.ticker AS ticker, gr.date AS date, round(CASE WHEN ticker = 'N' THEN pv END, 8) AS pred
    FROM gr LEFT JOIN vv ON vv.date = gr.date""")
def forecasts_single(spark, sf_dir):
    """Forecasts of one ticker without dates, on the calendar's first days."""
    at, b = shared_folder(spark, "forecasts"), src.daily(spark, sf_dir)
    _forecasts(spark, sf_dir).where("ticker = 'N'").orderBy("date").select("y_true", "pred_gbm").write.parquet(f"{at}/preds_test_k10.parquet")
    return rounded(fsrc.provider_forecasts(spark, at, TICKERS, b, single="N"), 8, "pred")


# --- forecasters and backtests by provider ---

@query(f"{q.BASE}, {q.V3} SELECT ticker, date, round(last_value(pred_vol IGNORE NULLS) OVER {q.frame(None, 0)}, 8) AS pred_vol FROM v3")
def vol_v3_filled(spark, sf_dir):
    """The look-ahead forecast with its last value carried to the end."""
    return rounded(forecasters.legacy_lookahead(src.daily(spark, sf_dir), fill_tail=True), 8, "pred_vol").select("ticker", "date", "pred_vol")


def _backtest_forecasts(spark, sf_dir) -> DataFrame:
    """Model forecasts of two tickers; the third falls back to the lagged blend."""
    at, b = shared_folder(spark, "forecasts"), src.daily(spark, sf_dir)
    _forecasts(spark, sf_dir).where("ticker <> 'R'").select("date", "ticker", "pred_gbm").write.parquet(f"{at}/preds_test_k10.parquet")
    write_json(spark, f"{at}/model_manifest_k10.json", {"alpha_gbm": 1.05})
    ml = fsrc.daily_forecasts(spark, at, TICKERS).withColumnRenamed("pred", "pred_vol").select("ticker", "date", "pred_vol")
    return backtest.with_fallback(ml, forecasters.lagged_blend(b).select("ticker", "date", "pred_vol"))


_WITH_FALLBACK = f"""{_PM}, {q.V2},
    vf AS (SELECT ticker, date, pv * 1.05 AS pred_vol
    FROM pk WHERE ticker <> 'R' UNION ALL SELECT ticker, date, pred_vol
    FROM v2 WHERE ticker = 'R')"""


@query(f"""{_WITH_FALLBACK}, {q.weekly_positions('vf')}
    SELECT ticker, week, round(price, 9) AS price, round(vol, 8) AS vol, round(shares, 6) AS shares, round(pnl, 2) AS pnl
    FROM wp""")
def weekly_backtest_fallback(spark, sf_dir):
    d = backtest.weekly_positions(src.daily(spark, sf_dir), _backtest_forecasts(spark, sf_dir), sizing.weights_table(spark))
    return rounded(rounded(rounded(rounded(d, 9, "price"), 8, "vol"), 6, "shares"), 2, "pnl")


_LEGACY_ML = f"""{_PM}, {q.WEIGHTS}, dp AS (SELECT bars.ticker AS ticker, bars.date AS date, close AS price, portw, CASE
    WHEN close * pv <> 0 THEN 50000.0 * portw / (close * pv) END AS shares, close - lag(close) OVER (PARTITION BY bars.ticker ORDER BY bars.date) AS chg
FROM bars JOIN pk ON pk.ticker = bars.ticker AND pk.date = bars.date JOIN weights ON weights.ticker = bars.ticker), dq AS (SELECT *,
    chg * shares AS pnl FROM dp WHERE chg IS NOT NULL)"""


@query(f"{_LEGACY_ML} SELECT date, round(coalesce(sum(pnl), 0.0), 2) AS pnl FROM dq GROUP BY date")
def legacy_total_ml(spark, sf_dir):
    """The daily backtest with a model's forecasts as provider, sign +1."""
    at, b = shared_folder(spark, "forecasts"), src.daily(spark, sf_dir)
    _forecasts(spark, sf_dir).select("date", "ticker", F.col("pred_gbm").alias("sigma_hat")).write.parquet(f"{at}/preds_test_k10.parquet")
    f = backtest.provider(spark, "ml_manifest", b, folder=at, tickers=TICKERS)
    return rounded(backtest.daily_series(backtest.daily_positions(b, f, sizing.weights_table(spark), sign=1.0)).select("date", "pnl"), 2, "pnl")


@query(f"{_DAILY} SELECT date, ticker, round(coalesce(pnl, 0.0), 2) + 0.0 AS pnl, round(shares, 6) AS shares FROM dq")
def legacy_details(spark, sf_dir):
    """Daily results and shares by ticker."""
    return rounded(rounded(backtest.details(_daily(spark, sf_dir)), 2, "pnl"), 6, "shares").withColumn("pnl", F.col("pnl") + 0.0)


@query(f"{_DAILY} SELECT ticker, count(*) AS n, round(sum(coalesce(shares, 0.0) * price), 0) AS dollar_value FROM dq GROUP BY ticker")
def saved_holdings(spark, sf_dir):
    """Holdings as saved, summed by ticker."""
    at = shared_folder(spark, "holdings")
    sinks.per_ticker(backtest.holdings(_daily(spark, sf_dir), "ewma_legacy"), at)
    return rounded(spark.read.parquet(at).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("dollar_value").alias("dollar_value")), 0, "dollar_value")


@query(f"{_PM} SELECT ticker, date, round(pv, 8) AS pred_gbm FROM pk WHERE ticker = 'A'")
def saved_ticker_forecasts(spark, sf_dir):
    """One ticker's folder of saved forecasts."""
    at = shared_folder(spark, "by-ticker")
    sinks.per_ticker(_forecasts(spark, sf_dir), at)
    return rounded(spark.read.parquet(at).where("ticker = 'A'").select("ticker", "date", "pred_gbm"), 8, "pred_gbm")


@query(f"""{q.BASE}, {q.V5}, {q.WEIGHTS} SELECT v5.ticker AS symbol, round(pred_vol, 8) AS pred_vol_scalar_t0, round(50000.0 * portw / (close * pred_vol * mult),
    6) AS pos_size_scalar_t0, 32 AS n_weights, portw, mult AS multiplier
    FROM v5 JOIN weights ON weights.ticker = v5.ticker
    WHERE idx = 0""")
def saved_legacy_summary(spark, sf_dir):
    at = shared_folder(spark, "legacy")
    v = forecasters.legacy_vectors(src.daily(spark, sf_dir))
    paths = sinks.save_legacy_vectors(v, sizing.weights_table(spark), at, notional=sizing.NOTIONAL, leverage=sizing.LEVERAGE, risk=sizing.RISK, decays=geometric_weights(32))
    d = spark.read.option("header", True).csv(paths["summary"])
    num = lambda c, n: F.round(F.col(c).cast("double"), n).alias(c)
    return d.select("symbol", num("pred_vol_scalar_t0", 8), num("pos_size_scalar_t0", 6), F.size(F.split("weights32", r"\|")).alias("n_weights"), num("portw", 6), num("multiplier", 6))


@query(f"""{q.BASE}, {q.V5}, {q.WEIGHTS} SELECT v5.ticker AS ticker, idx, v5.date AS date, round(stdev32, 8) AS stdev32,
    round(CASE WHEN pred_vol <> 0 THEN 50000.0 * portw / (close * pred_vol * mult) END,
    6) AS position_size FROM v5 JOIN weights ON weights.ticker = v5.ticker""")
def saved_legacy_vectors(spark, sf_dir):
    at = shared_folder(spark, "legacy")
    v = forecasters.legacy_vectors(src.daily(spark, sf_dir))
    paths = sinks.save_legacy_vectors(v, sizing.weights_table(spark), at, notional=sizing.NOTIONAL, leverage=sizing.LEVERAGE, risk=sizing.RISK, decays=geometric_weights(32))
    return rounded(rounded(spark.read.parquet(paths["vectors"]).select("ticker", "idx", "date", "stdev32", "position_size"), 8, "stdev32"), 6, "position_size")


# --- reports ---

@query(ORACLES["deciles"])
def saved_deciles(spark, sf_dir):
    """The decile report as CSV."""
    paths = sinks.save_reports(shared_folder(spark, "reports"), deciles=rounded(metrics.deciles(_pred(spark, sf_dir)), 8, "mean_y", "mean_pred", "mae", "mape"))
    d = spark.read.option("header", True).csv(paths["deciles"])
    return d.select(F.col("decile").cast("int").alias("decile"), F.col("count").cast("long").alias("count"), *(F.col(c).cast("double").alias(c) for c in ("mean_y", "mean_pred", "mae", "mape")))


@query(f"{q.STATE} SELECT from_state, to_state, round(prob, 6) AS prob FROM tr")
def saved_transitions(spark, sf_dir):
    """Transition probabilities as saved with six decimals."""
    at = shared_folder(spark, "regimes")
    sinks.save_regimes(at, transitions=regimes.transitions(daily_state(spark, sf_dir)))
    return readers.transition_table(spark, at)


@query(f"{q.STATE} SELECT date, state FROM ds")
def saved_daily_state(spark, sf_dir):
    at = shared_folder(spark, "regimes")
    sinks.save_regimes(at, state=daily_state(spark, sf_dir))
    return readers.daily_states(spark, at)


@query(f"{q.STATE} SELECT state, age, round(hazard, 10) AS hazard FROM hz")
def saved_hazards(spark, sf_dir):
    at = shared_folder(spark, "regimes")
    paths = sinks.save_regimes(at, hazards=regimes.hazards(daily_state(spark, sf_dir)))
    d = spark.read.option("header", True).csv(paths["hazards"])
    return d.select("state", F.col("age").cast("int").alias("age"), F.round(F.col("hazard").cast("double"), 10).alias("hazard"))


@query(f"{q.REGIME} SELECT ticker, max(date) AS last, round(avg(CAST(sigma_hat IS NOT NULL AS INT)), 8) AS share FROM g GROUP BY ticker")
def regime_coverage(spark, sf_dir):
    return rounded(metrics.coverage(_regime(spark, sf_dir), "sigma_hat"), 8, "share")


@query(f"{q.REGIME} SELECT vol_tercile AS value, count(*) AS n FROM g WHERE vol_tercile IS NOT NULL GROUP BY 1")
def tercile_counts(spark, sf_dir):
    return metrics.value_counts(_regime(spark, sf_dir), "vol_tercile")


@query(f"""{q.REGIME},
    e AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS a, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b
    FROM g) SELECT 'head' AS part, ticker, date, round(price, 9) AS price
    FROM e WHERE a <= 2 UNION ALL SELECT 'tail', ticker, date, round(price, 9)
    FROM e WHERE b <= 2""")
def regime_head_tail(spark, sf_dir):
    return rounded(metrics.head_tail(_regime(spark, sf_dir)).select("part", "ticker", "date", "price"), 9, "price")


@query(f"""SELECT *, CAST(row_number() OVER (ORDER BY abs(rho) DESC, feature) AS INTEGER) AS place
    FROM ({ORACLES['spearman_features']}) ORDER BY abs(rho) DESC, feature LIMIT 5""")
def top_features(spark, sf_dir):
    """The five features whose ranks follow the label most."""
    found = rounded(metrics.spearman(_saved_dataset(spark, sf_dir).where("split = 'train'"), _NUM, "label"), 6, "rho")
    return metrics.top_features(found, 5)


@query(f"""{q.PRED},
    b AS (SELECT min(y) AS a, max(y) AS z, quantile_cont(y, 0.01) AS p, quantile_cont(y, 0.99) AS p2
    FROM e),
    h AS (SELECT CAST(least(49, floor((y - a) / ((z - a) / 50))) AS INTEGER) AS bin, a, z, p, p2
    FROM e CROSS JOIN b),
    hh AS (SELECT bin, min(a) + bin * (min(z) - min(a)) / 50 AS lo, (min(z) - min(a)) / 50 AS step, min(p) AS p, min(p2) AS p2,
    count(*) AS n FROM h GROUP BY bin) SELECT bin, round(lo, 8) AS lo, n, lo <= p2 AND lo + step >= p AS inside
    FROM hh""")
def label_histogram_central(spark, sf_dir):
    """The histogram, with the bins that the central 98 % reach."""
    d = _pred(spark, sf_dir).where("y is not null and pred is not null")
    return rounded(metrics.central_histogram(d, "y"), 8, "lo")


@query(f"""SELECT round(sum(units), 4) AS units, round(sum(notional_alloc), 2) AS notional_alloc, round(median(pred_vol), 8) AS pred_vol
    FROM ({ORACLES['ewma_snapshot']})""")
def snapshot_totals(spark, sf_dir):
    d = sizing.totals(sizing.ewma_snapshot(src.daily(spark, sf_dir), sizing.weights_table(spark)))
    return rounded(rounded(rounded(d, 4, "units"), 2, "notional_alloc"), 8, "pred_vol")


@query(f"""WITH {q.bars()},
    d AS (SELECT ticker, max(date) AS last FROM bars GROUP BY ticker)
    SELECT ticker, last, CAST(last - INTERVAL 4 YEAR AS DATE) AS from_date, last - 30 AS warm_up, strftime(last, '%Y-%m') AS month
    FROM d""")
def date_offsets(spark, sf_dir):
    """Look-back dates of each ticker's last bar."""
    d = src.daily(spark, sf_dir).groupBy("ticker").agg(F.max("date").alias("last"))
    return d.select("ticker", "last", F.add_months("last", -48).alias("from_date"), F.date_sub("last", 30).alias("warm_up"), F.date_format("last", "yyyy-MM").alias("month"))


