"""Bars from a stream of trades, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.paths import shared_folder

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(ticker, ts, open, high, low, close, adj_close, volume) by hour, of a stream or a table of events."""
    e = events.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    d = e.groupBy("ticker", F.window("ts", "1 hour").alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.max_by("price", at).alias("adj_close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return d.select("ticker", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "adj_close", "volume")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs hourly_bars over the events file as a stream until its input is read: the hours that the watermark has closed.

    Append mode keeps the state of open hours only, and finished ones go to files; both folders are shared ones.
    """
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = shared_folder(spark, "stream-bars")
    out = hourly_bars(events).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/bars").option("checkpointLocation", f"{folder}/progress")
    run = out.trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return spark.read.parquet(f"{folder}/bars")
