"""Small cases against plain Python or pandas, structural facts, and queries against their SQL."""

import datetime as dt
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewick.functions.rolling import symbol_key, week_of
from tidewick.operators import backtest, dataset, features, forecasters, metrics, regimes, sizing
from tidewick.plans import models
from tidewick.sources import bars as src
from tidewick.sources import forecasts as fsrc

DAY = dt.date(2020, 1, 1)
SF = "/root/testdata/sf0.001"


def make_bars(spark, closes, ticker="T"):
    rows = [(DAY + dt.timedelta(i), ticker, c, c, c, c, c, 1.0 + i % 7) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, src.BARS)


def walk(n, seed=1):
    rng = random.Random(seed)
    x = [100.0]
    for _ in range(n - 1):
        x.append(x[-1] * (1 + rng.uniform(-0.05, 0.05)))
    return x


def test_features_equal_pandas(spark):
    closes = walk(130)
    got = features.build(make_bars(spark, closes)).toPandas().sort_values("date").reset_index(drop=True)
    c = pd.Series(closes)
    import numpy as np

    r = np.log(c).diff()
    want = {
        "rv10": np.sqrt((r**2).rolling(10).mean()),
        "skew20": r.rolling(20).skew(),
        "kurt20": r.rolling(20).kurt(),
        "ema9": c.ewm(span=9, adjust=False, min_periods=9).mean(),
        "ewma94": np.sqrt((r**2).ewm(alpha=0.06, adjust=False, min_periods=10).mean()),
        "dd60": (c / c.rolling(60, min_periods=1).max() - 1).where(np.arange(130) >= 59),
        "label": np.sqrt((r**2).rolling(10).mean().shift(-10)),
    }
    for name, x in want.items():
        pd.testing.assert_series_equal(got[name].astype(float), x.astype(float), check_names=False, rtol=1e-9, atol=1e-12)
    assert got["macd21"].first_valid_index() == 45


def test_features_ignore_the_future(spark):
    closes = walk(120)
    a = features.build(make_bars(spark, closes)).drop("label").toPandas().sort_values("date").head(100)
    b = features.build(make_bars(spark, closes[:100] + [5.0] * 20)).drop("label").toPandas().sort_values("date").head(100)
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


@pytest.mark.parametrize(("bars", "known"), [(87, 0), (88, 1), (89, 2)])
def test_first_forecast(spark, bars, known):
    assert forecasters.ewma_blend(make_bars(spark, walk(bars))).where("pred_vol is not null").count() == known


def test_snapshot_needs_86_returns(spark):
    assert forecasters.legacy_snapshot(make_bars(spark, walk(86))).first()["pred_vol"] is None
    assert forecasters.legacy_snapshot(make_bars(spark, walk(87))).first()["pred_vol"] > 0


def test_constant_price_has_no_size(spark):
    b = make_bars(spark, [10.0] * 120)
    w = sizing.weights_table(spark, {"T": 1.0})
    assert sizing.basket_snapshot(b, w).first()["shares"] is None
    f = features.build(b).orderBy("date").collect()[-1]
    assert f["rv10"] == 0 and f["skew20"] is None and f["kurt20"] is None


def test_gap_returns(spark):
    b = make_bars(spark, [1.0, None, 2.0])
    pad = [r["ret"] for r in features.simple_returns(b, pad=True).orderBy("date").collect()]
    none = [r["ret"] for r in features.simple_returns(b, pad=False).orderBy("date").collect()]
    assert pad == [None, 0.0, 1.0] and none == [None, None, None]


def test_weeks_end_on_fridays(spark):
    rows = [(DAY + dt.timedelta(i),) for i in range(30)]
    got = [r[0] for r in spark.createDataFrame(rows, "date date").select(week_of()).collect()]
    assert got == [d[0] + dt.timedelta((4 - d[0].weekday()) % 7) for d in rows]


@pytest.mark.parametrize(("n", "counts"), [(3087, [309, 309, 308, 309, 309, 308, 309, 308, 309, 309]), (4298, [430, 430, 430, 429, 430, 430, 429, 430, 430, 430]), (4, [1, 1, 1, 1])])
def test_decile_counts(spark, n, counts):
    d = spark.range(n).selectExpr("'t' as ticker", "date_add(date'2000-01-01', cast(id as int)) as date", "cast(id % 7 as double) as y", "cast(id * 31 % 1000 as double) + 1 as pred")
    got = [r["count"] for r in metrics.deciles(d).orderBy("decile").collect()]
    assert sum(got) == n and (got == counts or n == 4)


def test_split_counts(spark):
    d = spark.range(1757).selectExpr("'t' as ticker", "date_add(date'2000-01-01', cast(id as int)) as date")
    assert tuple(dataset.split_counts(dataset.split(d)).first()) == ("t", 702, 614, 441, 1757)
    assert dataset.split(d, purge=10).count() == 1757 - 20


def test_scaled_training_part(spark):
    d = dataset.split(spark.range(100).selectExpr("'t' as ticker", "date_add(date'2000-01-01', cast(id as int)) as date", "cast(id * id as double) as x", "1.0D as c"))
    p = dataset.scale(d, ["x", "c"]).where("split = 'train'").toPandas()
    assert abs(p["x"].mean()) < 1e-12 and abs(p["x"].std(ddof=0) - 1) < 1e-12 and (p["c"] == 0).all()


def states(spark, text):
    name = {"a": "risk_off", "b": "neutral", "c": "risk_on"}
    return spark.createDataFrame([(DAY + dt.timedelta(i), name[x]) for i, x in enumerate(text)], "date date, state string")


def plain_hysteresis(s, k):
    now = nxt = None
    n, out = 0, []
    for x in s:
        if now is None or x == now:
            now, nxt, n = x, None, 0
        else:
            n = n + 1 if x == nxt else 1
            nxt = x
            if n >= k:
                now, nxt, n = x, None, 0
        out.append(now)
    return out


@pytest.mark.parametrize("text", ["aaabbabbbbaaa", "abababab", "aabcbbbccca", "a"])
def test_hysteresis(spark, text):
    got = [r["state"] for r in regimes.hysteresis(states(spark, text)).orderBy("date").collect()]
    name = {"a": "risk_off", "b": "neutral", "c": "risk_on"}
    assert got == [name[x] for x in plain_hysteresis(text, 3)]


def test_vote_ties(spark):
    rows = [(DAY, "x", "risk_on"), (DAY, "y", "neutral"), (DAY + dt.timedelta(1), "x", "risk_on"), (DAY + dt.timedelta(1), "y", "risk_off"), (DAY + dt.timedelta(1), "z", "neutral")]
    got = [r["state"] for r in regimes.votes(spark.createDataFrame(rows, "date date, ticker string, state string")).orderBy("date").collect()]
    assert got == ["neutral", "risk_off"]


def test_markov_tables(spark):
    s = states(spark, "aaabbabbbbaaac")
    p = regimes.transitions(s)
    assert all(abs(r[1] - 1) < 1e-12 for r in p.groupBy("from_state").agg({"prob": "sum"}).collect())
    h = regimes.hazards(s)
    assert {(r["state"], r["age"]): r["hazard"] for r in h.collect()}["risk_off", 1] == pytest.approx(1 / 3)
    n = regimes.nowcast(s, p, regimes.smooth(h))
    assert all(abs(r[1] - 1) < 1e-12 for r in n.groupBy("date").agg({"prob": "sum"}).collect())
    assert sum(r["prob"] for r in regimes.stationary(p).collect()) == pytest.approx(1)


def test_symbols_and_layouts(spark):
    d = spark.createDataFrame([("eth_usd",), ("BTC-USD",), ("Btc",)], "s string")
    assert [r[0] for r in d.select(symbol_key(d["s"])).collect()] == ["ETH", "BTC", "BTC"]
    wide = spark.createDataFrame([("2020-01-01", 1.0, 2.0)], "date string, btc double, eth_usd double")
    assert {(r["ticker"], r["pred"]) for r in fsrc.normalize_daily(wide, ["BTC-USD", "ETH-USD"], alpha=2.0).collect()} == {("BTC-USD", 2.0), ("ETH-USD", 4.0)}
    long = spark.createDataFrame([("2020-01-01", "A", 1.0, 7.0, "gbr"), ("2020-01-01", "A_USD", 3.0, 7.0, "gbr"), ("2020-01-01", "A", 9.0, 7.0, "elasticnet")], "Date string, Ticker string, pred double, vol_hat double, model string")
    assert [r["pred"] for r in fsrc.normalize_daily(long, ["A"], model="gbm").collect()] == [2.0]
    assert fsrc.normalize_daily(long.drop("pred", "vol_hat"), ["A"]).count() == 0 == fsrc.normalize_daily(wide, ["XRP"]).count()


@pytest.mark.parametrize(("schema", "want"), [("dt date, code string, x double, sigma double", ("dt", "code", "sigma")), ("Date date, sid string, x int, z double", ("Date", "sid", "z")), ("index date, A double, N double", None), ("ds date, ticker string, y double, pred double", ("ds", "ticker", "pred"))])
def test_guessed_columns(spark, schema, want):
    assert fsrc.guess_columns(spark.createDataFrame([], schema)) == want


@pytest.mark.parametrize("schema", ["ticker string, pred double", "date date, pred double", "date date, ticker string, note string"])
def test_columns_that_cannot_be_told(spark, schema):
    with pytest.raises(ValueError, match="column"):
        fsrc.guess_columns(spark.createDataFrame([], schema))


def test_provider_layouts_that_fail(spark, tmp_path):
    days = make_bars(spark, [1.0, 2.0])
    with pytest.raises(FileNotFoundError):
        fsrc.provider_forecasts(spark, str(tmp_path), ["T"], days)
    spark.createDataFrame([(1.0, 2.0, 3.0)] * 3, "y_true double, pred_en double, pred_gbm double").write.parquet(str(tmp_path / "preds_test_k10.parquet"))
    days.select("date", "ticker").write.parquet(str(tmp_path / "rows"))
    with pytest.raises(ValueError, match="2 rows and 3"):
        fsrc.provider_forecasts(spark, str(tmp_path), ["T"], days, rows_path=str(tmp_path / "rows"))
    with pytest.raises(ValueError, match="single"):
        fsrc.provider_forecasts(spark, str(tmp_path), ["T"], days)
    spark.createDataFrame([(DAY, "T", 1.0), (DAY, "T", 2.0)], "date date, ticker string, pred double").write.mode("overwrite").parquet(str(tmp_path / "preds_test_k10.parquet"))
    with pytest.raises(Exception, match="repeated ticker and date"):
        fsrc.provider_forecasts(spark, str(tmp_path), ["T"], days).collect()
    with pytest.raises(ValueError, match="unknown provider"):
        backtest.provider(spark, "other", days)


def test_files_that_are_missing(spark, tmp_path):
    from tidewick.sources import paths, readers

    with pytest.raises(FileNotFoundError):
        paths.read_table(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        readers.returns_or_close(spark, str(tmp_path))
    assert paths.read_json(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "broken.json").write_text("{")
    assert fsrc.manifest_alpha(spark, str(tmp_path / "broken.json")) == 1.0
    got = readers.close_with_fallback(spark, str(tmp_path / "none"), make_bars(spark, [1.0, 2.0]), ["T"])
    assert sorted(r["price"] for r in got.collect()) == [1.0, 2.0]


def test_adjusted_prices_come_first(spark):
    closes = walk(80)
    b = make_bars(spark, closes)
    half = b.selectExpr("date", "ticker", "open", "high", "low", "close", "close / 2 as adj_close", "volume")
    a, c = (features.build(x).where("ema9 is not null").orderBy("date").first() for x in (b, half))
    assert c["ema9"] == pytest.approx(a["ema9"] / 2) and c["park_d"] == a["park_d"]
    from tidewick.sources import readers

    assert [r["price"] for r in readers.newest_first(half).orderBy("idx").limit(1).collect()] == [pytest.approx(closes[-1] / 2)]


def test_canonical_names():
    assert [src.canonical(x) for x in ("AAA Close", "Adj Close", "adj_close", " High", "TRADE VOLUME", "Date", "Ticker")] == ["close", "adj_close", "adj_close", "high", "volume", "date", "ticker"]


def test_sizes_are_guarded(spark):
    d = spark.createDataFrame([(10.0, 0.5), (10.0, 0.0)], "p double, v double")
    assert d.where("v > 0").select(sizing.checked_shares(d["p"], d["v"], F.lit(1.0), 100.0)).first()[0] == 20.0
    with pytest.raises(Exception, match="must be positive"):
        d.select(sizing.checked_shares(d["p"], d["v"], F.lit(1.0), 100.0)).collect()


def test_quantiles_and_ranks_equal_pandas(spark):
    import numpy as np

    from tidewick.functions import ranks

    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, 700).astype(float), rng.normal(size=700)
    d = spark.createDataFrame([("t", DAY + dt.timedelta(i), float(a), float(b) if i % 50 else None) for i, (a, b) in enumerate(zip(x, y, strict=True))], "ticker string, date date, x double, y double")
    p = pd.DataFrame({"x": x, "y": [b if i % 50 else None for i, b in enumerate(y)]}).astype(float)
    probs = [0.0, 0.005, 0.33, 0.5, 0.995, 1.0]
    for r in ranks.quantiles(d, ["x", "y"], probs).collect():
        assert r["q"] == pytest.approx([p[r["feature"]].quantile(q) for q in probs])
    got = ranks.average_ranks(d, ["x"], "ticker", "date").toPandas().sort_values("date")
    assert got["r"].tolist() == p["x"].rank().tolist()


def test_models_are_saved_and_chosen(spark, tmp_path):
    from tidewick.operators import ml

    rng = random.Random(5)
    rows = [("t", DAY + dt.timedelta(i), *(rng.random() for _ in dataset.feature_columns())) for i in range(120)]
    names = dataset.feature_columns()
    d = spark.createDataFrame(rows, ", ".join(["ticker string", "date date", *(f"{c} double" for c in names)])).withColumn("label", F.col("rv10") * 0.5 + 0.1).coalesce(1)
    assert ml.grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert [len(ml.grid(g)) for g in (ml.ELASTIC_GRID, ml.BOOSTED_GRID)] == [60, 72]
    few = {"elasticnet": [{"alpha": 1.0, "l1_ratio": 0.5}, {"alpha": 1e-6, "l1_ratio": 0.5}], "gbt": [{"maxIter": 2}]}
    found = ml.train(dataset.split(d), str(tmp_path), tuned=few)
    assert {(r["model"], r["split"], r["in_sample"]) for r in found.collect()} == {(m, s, s != "test") for m in ("en", "gbm") for s in ml.SPLITS}
    test = spark.read.parquet(str(tmp_path / "preds_test_k10.parquet")).toPandas().sort_values("date")
    again = ml.predict(ml.load_model(str(tmp_path), "elasticnet"), dataset.split(d).where("split = 'test'")).toPandas().sort_values("date")
    assert test["pred_en"].tolist() == pytest.approx(again["pred"].tolist()) and len(test) == 30
    assert fsrc.model_alpha(spark, str(tmp_path / "model_manifest_k10.json"), "en") == pytest.approx(1.0, abs=0.01)
    from tidewick.sources.paths import read_json

    assert read_json(spark, str(tmp_path / "model_manifest_k10.json"))["best_en"]["alpha"] == 1e-6
    assert fsrc.pick_model(spark, str(tmp_path / "metrics_k10.json")) == "en"


def test_required_columns_and_tickers(spark, tmp_path):
    make_bars(spark, [1.0]).drop("high").write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="high"):
        src.load_long(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="Z"):
        src.require_tickers(make_bars(spark, [1.0]), ["T", "Z"])


def test_weekly_backtest_by_hand(spark):
    b = make_bars(spark, [10.0] * 3 + [11.0] * 7 + [12.0] * 7)
    f = b.selectExpr("ticker", "date", "0.5D as pred_vol")
    rows = backtest.weekly_positions(b, f, sizing.weights_table(spark, {"T": 0.4})).orderBy("week").collect()
    assert [(r["price"], r["pnl"]) for r in rows] == [(10.0, 50_000 / 5.0), (11.0, pytest.approx(50_000 / 5.5))]


NAMES = [n for n in ("bars_daily", "calendar_asof", "labels", "features_long", "dataset_split", "vol_v1", "vol_v2", "vol_v3_lookahead", "legacy_vectors", "weekly_series", "ab_compare", "backtest_metrics", "deciles", "spearman_features", "regime_features", "nowcast", "stream_bars_hourly", "portfolio_summary", "stationary_distribution", "time_folds", "cached_close", "saved_split", "saved_transitions", "forecasts_daily_long", "forecasts_long", "forecasts_by_position", "forecasts_by_ticker_file", "weekly_backtest_fallback", "mutual_info", "stream_states", "legacy_details")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = con.execute(models.ORACLES[name]).df()
    got = models.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)

    def rows(p):
        return sorted(tuple("~" if pd.isna(v) else "%.9g" % v if isinstance(v, float) else str(v)[:19].removesuffix(" 00:00:00") for v in r) for r in p[cols].itertuples(index=False))

    assert rows(got) == rows(want)


def test_boosted_has_the_published_trees():
    from tidewick.operators import ml

    assert {k: ml.BOOSTED[k] for k in ("maxIter", "stepSize", "maxDepth", "subsamplingRate", "minInstancesPerNode")} == {"maxIter": 300, "stepSize": 0.03, "maxDepth": 2, "subsamplingRate": 0.7, "minInstancesPerNode": 20}
