"""The bars source: what is pushed down isn't read, and a stream goes on where it stopped."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tidewick.sources import feed, sinks


def save(spark, path, days=400, first="2020-01-01", tickers=("A", "B B", "C"), mode="overwrite"):
    d = spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"), F.explode(F.array(*map(F.lit, tickers))).alias("ticker"))
    d = d.select("date", "ticker", *(F.lit(float(i)).alias(c) for i, c in enumerate(("open", "high", "low"))), F.dayofyear("date").cast("double").alias("close"), F.lit(None).cast("double").alias("adj_close"), F.lit(1.0).alias("volume"))
    sinks.write_table(d, path, "ticker", mode)
    return d


def test_rows_and_pruning(spark, tmp_path):
    path = str(tmp_path / "bars")
    d = save(spark, path)
    feed.register(spark)
    got = spark.read.format("bars_feed").option("days", 100).load(path)
    assert got.columns == d.columns and got.rdd.getNumPartitions() == 3 * 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, d.collect()), key=lambda r: r[:2]) or got.exceptAll(d).count() == 0 == d.exceptAll(got).count()
    some = got.where("ticker in ('A', 'C') and date >= '2020-03-01' and date < '2020-04-01' and close > 70")
    assert some.count() == d.where("ticker in ('A', 'C') and date >= '2020-03-01' and date < '2020-04-01' and close > 70").count() > 0
    assert some.rdd.getNumPartitions() == 2
    assert got.where("ticker = 'B B' and date = '2020-02-02'").count() == 1 and got.where("ticker = 'Z'").count() == 0
    reader = feed.FeedReader({"path": path, "days": "50"})
    other = EqualTo(("close",), 1.0)
    assert list(reader.pushFilters([In(("ticker",), ("A", "Q")), GreaterThanOrEqual(("date",), dt.date(2020, 6, 1)), LessThan(("date",), dt.date(2020, 8, 1)), other])) == [other]
    spans = reader.partitions()
    assert [(s.ticker, s.low, s.high) for s in spans] == [("A", dt.date(2020, 6, 1), dt.date(2020, 7, 20)), ("A", dt.date(2020, 7, 21), dt.date(2020, 7, 31))]
    assert spark.read.format("bars_feed").load(str(tmp_path / "none")).count() == 0


def test_stream_goes_on_by_day(spark, tmp_path):
    path, out, at = (str(tmp_path / x) for x in ("bars", "out", "at"))
    feed.register(spark)

    def run():
        q = spark.readStream.format("bars_feed").load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.read.parquet(out)

    save(spark, path, 30)
    assert run().count() == 90
    save(spark, path, 10, "2020-01-31", mode="append")
    got = run()
    assert got.count() == 120 and got.select("date", "ticker").distinct().count() == 120
