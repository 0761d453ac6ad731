"""Recordings joined to one timeline, clip sampling, and batches of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_range(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Frames start <= index < end; the filter reaches the scan."""
    return frames.where((F.col("frame_idx") >= start) & (F.col("frame_idx") < end))


def offsets(recordings: DataFrame, order: str = "path", by: str = "run_id") -> DataFrame:
    """recordings with time_start and time_end: the sum of the durations of those before in order."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("duration").over(w), F.lit(0.0))
    return recordings.withColumn("time_start", start).withColumn("time_end", F.col("time_start") + F.col("duration"))


def merge_recordings(samples: DataFrame, recordings: DataFrame) -> DataFrame:
    """samples (run_id, path, roi, t, value) with t moved by the durations of the recordings with smaller paths."""
    shift = offsets(recordings).select("run_id", "path", "time_start")
    return samples.join(shift, ["run_id", "path"]).withColumn("t", F.col("t") + F.col("time_start")).drop("time_start")


def sampled_frames(recordings: DataFrame, interval: float) -> DataFrame:
    """frame_idx, t of every max(1, int(fps * interval))-th frame of each clip on the common timeline."""
    clips = offsets(recordings, "seq").withColumn("step", F.greatest(F.lit(1), (F.col("fps") * interval).cast("int"))).where("frame_count > 0")
    rows = clips.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count") - 1, F.col("step").cast("long"))))
    return rows.select("run_id", "path", "seq", "frame_idx", (F.col("frame_idx") / F.col("fps") + F.col("time_start")).alias("t"), "time_start", "time_end")


def until_failure(recordings: DataFrame) -> DataFrame:
    """The clips before the first one with an error."""
    bad = F.min(F.when(F.col("error").isNotNull(), F.col("seq"))).over(Window.partitionBy("run_id"))
    return recordings.withColumn("_bad", bad).where("_bad is null OR seq < _bad").drop("_bad")


def batch_summary(recordings: DataFrame, interval: float) -> DataFrame:
    """Clips, duration, frames, sampled frames and effective rate of each batch."""
    step = F.greatest(F.lit(1), (F.col("fps") * interval).cast("int"))
    return recordings.groupBy("run_id").agg(F.count("*").alias("clips"), F.sum("duration").alias("duration"), F.sum("frame_count").alias("frames"), F.sum(F.ceil(F.col("frame_count") / step)).alias("sampled"), F.lit(1 / interval).alias("effective_fps"))
