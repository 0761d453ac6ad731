"""Exports: long and wide tables, parameters, whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.sources.tables import KEYS


def long_export(**parts: tuple[DataFrame, str, str]) -> DataFrame:
    """run_id, roi, t, data_type, value of named parts, each (rows, time column, value column)."""
    out = None
    for name, (rows, time, value) in parts.items():
        part = rows.select(*KEYS, F.col(time).cast("double").alias("t"), F.lit(name).alias("data_type"), F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def threshold_export(limits: DataFrame) -> DataFrame:
    return limits.select(*KEYS, "baseline_mean", "upper", "lower", (F.col("upper") - F.col("lower")).alias("band_width"))


def parameter_table(runs: DataFrame) -> DataFrame:
    """run_id, name, value (text) of a table with a row of parameters for each run; nested ones are left out."""
    flat = [f.name for f in runs.schema.fields if f.name != "run_id" and f.dataType.typeName() not in ("struct", "map", "array")]
    text = runs.select("run_id", *(F.col(c).cast("string").alias(c) for c in flat))
    return text.unpivot(["run_id"], flat, "name", "value")


def parameter_json(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.to_json(F.struct(*(c for c in runs.columns if c != "run_id"))).alias("parameters"))


def wide(rows: DataFrame, rois: list, value: str = "value", minutes: bool = True) -> DataFrame:
    """A row for each time, rounded half-even to 2 digits of minutes (or seconds), and a column for each roi; the last value of a cell wins."""
    key = F.bround(F.col("t") / 60 if minutes else F.col("t"), 2)
    return rows.withColumn("time_key", key).groupBy("run_id", "time_key").pivot("roi", rois).agg(F.max_by(value, F.struct("t", "tie")))


def wide_tolerant(rows: DataFrame, rois: list, value: str = "value", tolerance: float = 0.01) -> DataFrame:
    """Like wide over the times of all rois, but a cell takes the first value within the tolerance of its time: a band join on buckets."""
    m = rows.withColumn("minute", F.col("t") / 60)
    keys = m.select("run_id", F.bround("minute", 2).alias("time_key")).distinct().withColumn("bucket", F.explode(F.array(*(F.floor(F.col("time_key") / tolerance) + k for k in (-1, 0, 1)))))
    near = keys.join(m.withColumn("bucket", F.floor(F.col("minute") / tolerance)), ["run_id", "bucket"]).where(F.abs(F.col("minute") - F.col("time_key")) < tolerance)
    return near.groupBy("run_id", "time_key").pivot("roi", rois).agg(F.min_by(value, F.struct("t", "tie")))


def thinned(spectrum: DataFrame, most: int = 10_000) -> DataFrame:
    """At most about most rows of each series, by regular stride over k."""
    i = F.row_number().over(Window.partitionBy(*KEYS).orderBy("k")) - 1
    n = F.count("*").over(Window.partitionBy(*KEYS))
    return spectrum.withColumns({"_i": i, "_n": n}).where(F.col("_i") % F.ceil(F.col("_n") / most) == 0).drop("_i", "_n")


def top_peaks(peaks: DataFrame, top: int = 5) -> DataFrame:
    return peaks.where(F.col("rank") <= top)


def save_run(path: str, tables: dict[str, DataFrame], attributes: DataFrame | None = None) -> None:
    """One Parquet table for each kind of result, partitioned by run, and a manifest that is written last.

    Saving a run again replaces its partitions, so a run stands once however often it is saved; the other runs of the tables stay. A run whose save broke off isn't in the
    manifest of that save, which names each run's tables with their rows. attributes: run_id, roi (null: of the run), name, value (text).
    """
    tables = tables | ({"attributes": attributes} if attributes is not None else {})
    spark = next(iter(tables.values())).sparkSession
    saved = None
    for name, rows in tables.items():
        replaced(rows, f"{path}/{name}")
    for name, rows in tables.items():
        counted = spark.read.schema(rows.schema).parquet(f"{path}/{name}").join(rows.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("rows")).withColumn("name", F.lit(name))
        saved = counted if saved is None else saved.unionByName(counted)
    replaced(saved.select("name", "rows", "run_id"), f"{path}/manifest")


def replaced(rows: DataFrame, path: str) -> None:
    """Writes rows over the partitions of their runs, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def saved_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id, name, rows of the tables of all runs that were saved to the end."""
    return spark.read.schema("name string, rows long, run_id string").parquet(f"{path}/manifest").select("run_id", "name", "rows")


def load_run(spark: SparkSession, path: str, name: str, runs: list[str] | None = None) -> DataFrame:
    """A kind of result of the runs that were saved to the end; a choice of runs prunes the partitions that are read."""
    out = spark.read.parquet(f"{path}/{name}").join(saved_runs(spark, path).where(F.col("name") == name).select("run_id"), "run_id", "left_semi")
    return out.where(F.col("run_id").isin(runs)) if runs else out


def series_attributes(samples: DataFrame, frame_interval: float) -> DataFrame:
    """run_id, roi, name, value (text): of each series roi_id, n_samples and duration_seconds, of each run (roi null) frame_interval, n_frames (of its longest series) and n_rois."""
    each = samples.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("length"))
    pairs = lambda **kw: F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in kw.items()))).alias("a")
    own = each.select(*KEYS, pairs(roi_id=F.col("roi"), n_samples=F.col("n"), duration_seconds=F.col("length")))
    whole = each.groupBy("run_id").agg(F.count("*").alias("rois"), F.max("n").alias("n"))
    whole = whole.select("run_id", F.lit(None).cast(samples.schema["roi"].dataType).alias("roi"), pairs(frame_interval=F.lit(float(frame_interval)), n_frames=F.col("n"), n_rois=F.col("rois")))
    return own.unionByName(whole).select(*KEYS, "a.name", "a.value")
