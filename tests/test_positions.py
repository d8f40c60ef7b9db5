"""Files without keys: rows belong together by their places, whatever the part files' sizes."""

import pytest
from pyspark.sql import functions as F

from tidewick.sources import forecasts


def write(df, folder, sizes, fmt="parquet", **options):
    """Part files of the given sizes, each written apart, so that names and not sizes give the order."""
    at = 0
    for i, n in enumerate(sizes):
        part = df.where((F.col("i") >= at) & (F.col("i") < at + n)).drop("i").coalesce(1)
        part.write.format(fmt).options(**options).save(f"{folder}/part={i}")
        at += n


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_unequal_part_files(spark, tmp_path, fmt):
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("i"), F.date_add(F.lit("2000-01-01"), F.col("id").cast("int")).alias("date"), F.lit("N").alias("ticker"), (F.col("id") / 7).alias("pred_gbm"))
    header = {"header": True} if fmt == "csv" else {}
    write(rows.select("i", "pred_gbm"), str(tmp_path / "f"), (100, 2500, 1, 399), fmt, **header)
    write(rows.select("i", "date", "ticker"), str(tmp_path / "r"), (1500, 20, 1480), fmt, **header)
    read = lambda name, schema: spark.read.format(fmt).options(**header).schema(schema).load(str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # files are cut into several splits
    try:
        got = forecasts.by_position(read("f", "pred_gbm double"), read("r", "date date, ticker string"), "pred_gbm")
        wrong = got.join(rows.select("date", F.col("pred_gbm").alias("want")), "date").where("abs(pred - want) > 1e-9").count()
        assert got.count() == 3000 and wrong == 0
        numbers = forecasts.numbered(read("f", "pred_gbm double")).agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()
        assert tuple(numbers) == (0, 2999, 3000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_clashing_and_empty(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3)], "position int, __row int, __file int").write.parquet(str(tmp_path / "c"))
    assert forecasts.numbered(spark.read.parquet(str(tmp_path / "c")).drop("position", "__row", "__file").withColumn("x", F.lit(1))).collect()[0]["position"] == 0
    empty = spark.createDataFrame([], "pred_gbm double")
    empty.write.parquet(str(tmp_path / "e"))
    assert forecasts.numbered(spark.read.parquet(str(tmp_path / "e"))).count() == 0
    with pytest.raises(ValueError, match="1 rows and 0 forecasts"):
        forecasts.by_position(spark.read.parquet(str(tmp_path / "e")), spark.createDataFrame([("2020-01-01", "N")], "date string, ticker string"), "pred_gbm")
