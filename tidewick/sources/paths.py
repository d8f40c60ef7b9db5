"""Folders and small files: where tables are written, whether a file is there, JSON side files."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewick-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back: for what is read several times and dear to compute."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame | None:
    """The table at path, or None if there is nothing."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """path.parquet, else path.csv (with a header, types inferred); raises FileNotFoundError if both are missing."""
    found = read_if_there(spark, f"{path}.parquet")
    if found is None:
        found = read_if_there(spark, f"{path}.csv", "csv", header=True, inferSchema=True)
    if found is None:
        raise FileNotFoundError(f"neither {path}.parquet nor {path}.csv")
    return found


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON side file; None if it is missing or isn't a JSON object."""
    rows = read_if_there(spark, path, "text", wholetext=True)
    try:
        found = json.loads("\n".join(r["value"] for r in rows.collect())) if rows is not None else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def write_json(spark: SparkSession, path: str, facts: dict) -> str:
    """A small JSON side file (a folder with one part, as Spark writes text)."""
    spark.createDataFrame([(json.dumps(facts, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
