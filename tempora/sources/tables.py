"""Series, frames and metadata as tables, from stored tables or from the driver's sample tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of the sample recordings, 2024-01-01 in UTC, as seconds since 1970.
START = 1_704_067_200
KEYS = ("run_id", "roi")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a temporary folder where none is set, as in tests, which run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, where several results need it."""
    path = scratch(df.sparkSession, "part")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds from the start of the recording of a timestamp in UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6) - F.lit(START)


def event_samples(spark: SparkSession, sf_dir: str, roi: str = "event_type", run: str = "'events'") -> DataFrame:
    """run_id, roi, t, value, tie: the events' values as a series for each type (few long ones) or user (many short ones); run: one run, or an expression."""
    e = table(spark, sf_dir, "events")
    return e.select(F.expr(run).alias("run_id"), F.col(roi).alias("roi"), seconds(F.col("ts")).alias("t"), F.col("value"), F.col("event_id").alias("tie"))


def stored_series(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """Series that save_run wrote; a choice of runs prunes the partitions that are read."""
    out = spark.read.schema("roi string, t double, value double, data_type string, run_id string").parquet(path)
    return out.where(F.col("run_id").isin(runs)) if runs else out


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, pixels (8 by 8 gray numbers), height, width: the embeddings as small frames."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("camera").alias("run_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"))
