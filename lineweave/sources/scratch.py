"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a written table, or what is derived from it, may be broadcast.
SMALL_ROWS = 100_000


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; set to a local one only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lineweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a written table: what follows is planned from there, and no lost executor takes it along.

    Spark takes a table for as large as its files, which are compressed by ten times and more, and would broadcast tables of
    millions of rows by way of the driver; so those of over SMALL_ROWS, counted as they are written, have a hint against it.
    """
    path, seen = scratch(df.sparkSession, label), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table.hint("merge") if seen.get["n"] > SMALL_ROWS else table
