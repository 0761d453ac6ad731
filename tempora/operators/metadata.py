"""Recording metadata: (run_id, param, idx, value) and key-value attributes; environment, timing, light."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.fits import ratio

#: Groups of nested attributes whose name isn't put before their keys (fixed by the file format).
BARE_PARENTS = ("esp32_timing", "python_timing", "frame_metadata")
#: Name parts that mark analysis results (fixed values).
ANALYSIS_WORDS = (
    "roi_", "baseline_", "threshold_", "upper_threshold", "lower_threshold", "movement_data", "fraction_data", "sleep_data", "quiescence_data", "intensity_roi_", "analysis_", "processed_", "calculated_",
)
#: Name parts that mark experimental settings (fixed values).
EXPERIMENT_WORDS = (
    "experiment", "date", "time", "duration", "interval", "frame", "fps", "resolution", "microscope", "objective", "magnification", "exposure", "gain",
    "temperature", "humidity", "light", "treatment", "condition", "protocol", "researcher", "lab", "species", "strain", "age", "sex",
)
#: Units of known parameters, and descriptions of some (fixed values).
UNITS = {
    "frame_drift": "seconds", "cumulative_drift": "seconds", "actual_intervals": "seconds", "expected_intervals": "seconds", "frame_intervals": "seconds", "capture_timestamps": "seconds", "expected_timestamps": "seconds",
    "temperature": "celsius", "humidity": "percent", "led_power_percent": "percent", "led_duration_ms": "milliseconds",
    "frame_mean": "pixel_intensity", "frame_max": "pixel_intensity", "frame_min": "pixel_intensity", "frame_std": "pixel_intensity", "frame_index": "dimensionless",
}
DESCRIPTIONS = {
    "frame_drift": "Time difference between expected and actual frame capture",
    "cumulative_drift": "Total accumulated timing error since recording start",
    "actual_intervals": "Measured time between consecutive frames",
    "expected_intervals": "Configured frame interval (should be constant)",
    "temperature": "Ambient temperature during recording",
    "humidity": "Relative humidity during recording",
    "led_duration_ms": "LED flash duration (only parameter in milliseconds)",
    "led_power_percent": "LED illumination power setting",
}


def _numbers_of(text: str) -> dict[str, float]:
    """Names and values of the numbers in a JSON object, by a stack of open objects; none of text that isn't one. The last of one name counts."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return {}
    out, open_ = {}, [("", iter(found.items()))] if isinstance(found, dict) else []
    while open_:
        parent, items = open_[-1]
        for key, value in items:
            if isinstance(value, dict):
                open_.append((key, iter(value.items())))
                break
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                with contextlib.suppress(OverflowError):
                    out[key if not parent or parent in BARE_PARENTS else f"{parent}_{key}"] = float(value)
        else:
            open_.pop()
    return out


def numeric_attributes(frames: DataFrame, column: str = "attrs") -> DataFrame:
    """run_id, frame_idx, param, value of the numbers in nested JSON of any depth; keys get their parent's name before them. Bad JSON, text, lists and booleans are left out.

    A document is walked once, in Arrow batches; nothing of it is a row but its numbers. Of a name that stands twice in a document (in two objects of one name) the last counts.
    """
    kind = frames.schema["frame_idx"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, values = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for name, value in _numbers_of(text).items() if text else ():
                    rows.append(k)
                    names.append(name)
                    values.append(value)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["run_id", "frame_idx", "param", "value"])

    return frames.select("run_id", "frame_idx", column).mapInArrow(run, f"run_id string, frame_idx {kind}, param string, value double")


def align(meta: DataFrame, params: list[str], interval: float) -> DataFrame:
    """A row for each index up to the longest series, with time in minutes and a column for each parameter; series of one value fill their column, short ones end in nulls."""
    n = meta.groupBy("run_id").agg((F.max("idx") + 1).alias("n"))
    spine = n.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("idx"))
    table = meta.groupBy("run_id", "idx").pivot("param", params).agg(F.first("value"))
    counts = meta.groupBy("run_id").pivot("param", params).agg(F.count("value"))
    one = counts.select("run_id", *(F.col(p).alias(f"_{p}") for p in params))
    first = meta.where("idx = 0").groupBy("run_id").pivot("param", params).agg(F.first("value")).select("run_id", *(F.col(p).alias(f"__{p}") for p in params))
    out = spine.join(table, ["run_id", "idx"], "left").join(one, "run_id").join(first, "run_id")
    return out.select("run_id", "idx", (F.col("idx") * interval / 60).alias("minutes"), *(F.when(F.col(f"_{p}") == 1, F.col(f"__{p}")).otherwise(F.col(p)).alias(p) for p in params))


def flatten_static(attributes: DataFrame, column: str = "attrs") -> DataFrame:
    """run_id, category, parameter, value, data_type, source of a two-level JSON document."""
    explode = attributes.sparkSession.tvf.variant_explode
    top = attributes.select("run_id", F.try_parse_json(column).alias("v"), "source").lateralJoin(explode(F.col("v").outer())).select("run_id", F.col("key").alias("category"), F.col("value").alias("v"), "source")
    each = top.lateralJoin(explode(F.col("v").outer())).select("run_id", "category", F.col("key").alias("parameter"), F.col("value").alias("v"), "source")
    return each.select("run_id", "category", "parameter", F.try_variant_get("v", "$", "string").alias("value"), F.lower(F.schema_of_variant("v")).alias("data_type"), "source")


def without_analysis(meta: DataFrame) -> DataFrame:
    return meta.where(~F.lower("param").rlike("|".join(ANALYSIS_WORDS)))


def experimental(attributes: DataFrame, name: str = "parameter") -> DataFrame:
    return attributes.where(F.lower(name).rlike("|".join(EXPERIMENT_WORDS)))


def _of(meta: DataFrame, param: str) -> DataFrame:
    return meta.where(F.col("param") == param)


def timing_performance(meta: DataFrame, actual: str, expected: str) -> DataFrame:
    """Means and sample deviation of intervals, and the accuracy 1 - mean |actual - expected| / mean expected."""
    a = _of(meta, actual).select("run_id", "idx", F.col("value").alias("a"))
    both = a.join(_of(meta, expected).select("run_id", "idx", F.col("value").alias("e")), ["run_id", "idx"])
    return both.groupBy("run_id").agg(F.count("*").alias("n"), F.avg("a").alias("mean_actual"), F.avg("e").alias("mean_expected"), F.stddev_samp("a").alias("std_actual"), (1 - ratio(F.avg(F.abs(F.col("a") - F.col("e"))), F.avg("e"), 0.0)).alias("accuracy"))


def drift_statistics(meta: DataFrame, param: str) -> DataFrame:
    """Largest, least, mean and deviation of drifts in seconds and milliseconds, and their slope by frame."""
    parts = {"max": F.max("value"), "min": F.min("value"), "mean": F.avg("value"), "std": F.stddev_samp("value")}
    return _of(meta, param).groupBy("run_id").agg(*(v.alias(f"{k}_s") for k, v in parts.items()), *((v * 1000).alias(f"{k}_ms") for k, v in parts.items()), F.regr_slope("value", "idx").alias("slope"))


def cumulative_drift(meta: DataFrame, param: str) -> DataFrame:
    return _of(meta, param).groupBy("run_id").agg(F.max_by("value", "idx").alias("last"), F.max("value").alias("max"), F.min("value").alias("min"))


def graded(value: Column, bounds: tuple[float, ...], names: tuple[str, ...]) -> Column:
    out = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(value < bound, name).otherwise(out)
    return out


def image_statistics(meta: DataFrame, param: str) -> DataFrame:
    """Statistics of image means, and stability by their spread in percent."""
    m = _of(meta, param).groupBy("run_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.regr_slope("value", "idx").alias("trend"))
    cv = ratio(F.col("std") * 100, F.col("mean"), 0.0)
    return m.withColumns({"cv_percent": cv, "stability": graded(cv, (5, 10, 20), ("excellent", "good", "moderate", "poor"))})


def environment(meta: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """Statistics of each environmental parameter and a grade of its range by two bounds (2 and 5 degrees, 10 and 20 percent)."""
    m = meta.where(F.col("param").isin(*params)).groupBy("run_id", "param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    span = F.col("max") - F.col("min")
    grade = F.coalesce(*(F.when(F.col("param") == p, graded(span, b, ("stable", "moderate", "variable"))) for p, b in params.items()))
    return m.withColumns({"range": span, "grade": grade})


def led_statistics(meta: DataFrame, power: str, duration: str, success: str) -> DataFrame:
    """Mean, deviation, least and largest power and duration, and how often the light was in step with the camera. A part that a run lacks is null."""
    parts = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    of = lambda param: F.when(F.col("param") == param, F.col("value"))
    stats = [f(of(param)).alias(f"{k}_{name}") for name, param in (("power", power), ("duration", duration)) for k, f in parts.items()]
    m = meta.where(F.col("param").isin(power, duration, success)).groupBy("run_id").agg(*stats, F.avg(of(success)).alias("sync_rate"), F.count(of(success)).alias("frames"), F.count_if(of(success) > 0).alias("successes"), F.count_if(of(success) <= 0).alias("failures"))
    r = F.col("sync_rate")
    grade = F.when(r > 0.98, "excellent").when(r > 0.95, "good").when(r > 0.90, "acceptable").when(r.isNotNull(), "poor")
    return m.withColumn("grade", grade)


def drift_grade(meta: DataFrame, param: str) -> DataFrame:
    largest = F.max(F.abs("value"))
    return _of(meta, param).groupBy("run_id").agg(largest.alias("largest")).withColumn("grade", graded(F.col("largest"), (0.05, 0.1, 0.2), ("excellent", "good", "acceptable", "poor")))


def known_units() -> dict[str, tuple[str, str, str]]:
    """Unit, description and display hint of each known parameter."""
    hint = lambda u: "multiply by 1000 for milliseconds" if u == "seconds" else f"values in {u}"
    return {p: (u, DESCRIPTIONS.get(p, f"Parameter measured in {u}"), hint(u)) for p, u in UNITS.items()}


def units_table(spark: SparkSession) -> DataFrame:
    """param, unit, description, hint of the known parameters."""
    return F.broadcast(spark.createDataFrame([(p, *v) for p, v in known_units().items()], "param string, unit string, description string, hint string"))  # a fixed, small table


def with_units(meta: DataFrame, units: DataFrame) -> DataFrame:
    """Known parameters with length, unit, description and hint, and for drifts in seconds the largest in milliseconds and a grade. Others get none."""
    m = meta.groupBy("run_id", "param").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("most")).join(units, "param")
    drift = (F.col("unit") == "seconds") & F.lower("param").contains("drift")
    grade = F.when(drift, graded(F.col("most"), (0.05, 0.1, 0.2), ("excellent", "good", "acceptable", "poor")))
    return m.select("run_id", "param", "n", "unit", "description", "hint", F.when(drift, F.col("most") * 1000).alias("max_drift_ms"), grade.alias("quality"))


def unit_statistics(meta: DataFrame, units: DataFrame) -> DataFrame:
    """Statistics of each parameter with a unit, for seconds in milliseconds too, and a grade where the description tells of drift."""
    m = meta.groupBy("run_id", "param").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    m = m.join(units, "param").withColumn("range", F.col("max") - F.col("min"))
    timed = F.col("unit") == "seconds"
    most = F.greatest(F.abs("min"), F.abs("max"))
    grade = F.when(timed & F.lower("description").contains("drift"), graded(most, (0.05, 0.1, 0.2), ("excellent", "good", "acceptable", "poor")))
    return m.select("run_id", "param", "unit", "mean", "std", "min", "max", "range", *(F.when(timed, F.col(c) * 1000).alias(f"{c}_ms") for c in ("mean", "std", "max", "range")), grade.alias("quality"))


def legacy_check(attributes: DataFrame) -> DataFrame:
    """Whether a run's attributes (run_id, parameter, value) are those of an old file, with each reason.

    file_version (missing: 1.0) below 2.2 or unreadable; structure other than timeseries_only; and, of a file with time series (timeseries is true): drifts (frame_drift is true) without
    units or display_hint, no or a false expected_intervals_fixed, no unit_standard.
    """
    value, of = F.col("value"), lambda c: F.col("parameter") == c
    # A run's attributes meet as flags of fixed width, which are summed before the shuffle; its texts aren't kept.
    first = lambda c, flag: F.first(F.when(of(c) & value.isNotNull(), flag), True)
    true = {c: first(c, F.lower(value).isin("true", "1")) for c in ("timeseries", "frame_drift", "expected_intervals_fixed")}
    there = {c: F.max(of(c) & value.isNotNull()) for c in ("units", "display_hint", "unit_standard")}
    new = first("file_version", F.coalesce(value.try_cast("double") >= 2.2, F.lit(False)))
    a = attributes.groupBy("run_id").agg(*(F.coalesce(f, F.lit(False)).alias(c) for c, f in {**true, **there, "new": new, "structure": first("structure", value == "timeseries_only")}.items()))
    series = F.col("timeseries")
    reasons = {
        "old_version": ~F.col("new"), "no_units": series & F.col("frame_drift") & ~(F.col("units") & F.col("display_hint")), "intervals_not_fixed": series & ~F.col("expected_intervals_fixed"),
        "no_standard": series & ~F.col("unit_standard"), "other_structure": ~F.col("structure"),
    }
    any_ = None
    for c in reasons.values():
        any_ = c if any_ is None else any_ | c
    return a.select("run_id", *(c.alias(k) for k, c in reasons.items()), any_.alias("legacy"))


def _finite(meta: DataFrame) -> Column:
    v = F.col("value")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def parameter_summary(meta: DataFrame) -> DataFrame:
    """Length of each parameter and statistics of its finite numbers (a deviation from two on), or for one with text how many distinct values it has.

    meta: run_id, param, value and, where parameters may be text, text. A parameter with any text is text as a whole.
    """
    has_text = "text" in meta.columns
    worded = F.count("text") if has_text else F.lit(0).cast("long")
    either = F.coalesce("text", F.col("value").cast("string")) if has_text else F.lit(None).cast("string")
    v = _finite(meta)
    m = meta.groupBy("run_id", "param").agg(
        F.count("*").alias("length"), worded.alias("_words"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("_n"), F.count_distinct(either).alias("distinct_values")
    )
    text = F.col("_words") > 0
    number = lambda c: F.when(~text, F.col(c))
    return m.select("run_id", "param", "length", F.when(text, "text").otherwise("number").alias("data_type"), *(number(c).alias(c) for c in ("min", "max", "mean")), F.when(~text & (F.col("_n") > 1), F.col("std")).alias("std"), F.when(text, F.col("distinct_values")).alias("distinct_values"))


def parameter_inventory(meta: DataFrame) -> DataFrame:
    """Number, names and data types (of the first value) of a run's parameters, without those that start with an underscore, and the longest length.

    meta: run_id, param, idx, value and, where parameters may be text, text.
    """
    # Kinds meet as numbers, whose width is fixed, so that they are aggregated before the shuffle without a sort of all rows.
    kinds = ("empty", "float", "str")
    number = F.when(F.col("value").isNotNull(), 1).otherwise(0)
    kind = F.when(F.col("text").isNotNull(), 2).otherwise(number) if "text" in meta.columns else number
    m = meta.where(~F.col("param").startswith("_")).groupBy("run_id", "param").agg(F.count("*").alias("n"), F.min_by(kind, "idx").alias("kind"))
    m = m.withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("param", c.alias("x")))), lambda p: p["x"]), ",")
    return m.groupBy("run_id").agg(F.count("*").alias("params"), listed(F.col("param")).alias("names"), listed(F.concat_ws(":", "param", "kind")).alias("data_types"), F.max("n").alias("longest"))


#: Names of the white and the infrared lamp's power, the first that a recording has counts; the name that tells neither; and the frames' times (fixed by the file format).
WHITE_NAMES = ("led_white_power_percent", "white_led_power", "led_white_power", "white_led_power_percent")
INFRARED_NAMES = ("led_ir_power_percent", "ir_led_power", "led_ir_power", "ir_led_power_percent")
GENERIC_NAME, TIMES_NAME = "led_power_percent", "capture_timestamps"


def light_channels(meta: DataFrame, interval: float, white: tuple[str, ...] = WHITE_NAMES, infrared: tuple[str, ...] = INFRARED_NAMES, times: str = TIMES_NAME) -> DataFrame:
    """run_id, idx, t, white, infrared (null where a run has none) and the channels' names. A run without a white channel has no rows, even if it has a generic one.

    Times are the run's own where it has them, else idx times interval. The choice of names is a row for each run.
    """
    rank = lambda names: F.coalesce(*(F.when(F.col("param") == n, F.lit(k)) for k, n in enumerate(names)))
    of = meta.where(F.col("param").isin(*white, *infrared, times))
    chosen = of.groupBy("run_id").agg(F.min_by("param", rank(white)).alias("white_name"), F.min_by("param", rank(infrared)).alias("infrared_name"), F.max(F.col("param") == times).alias("timed")).where("white_name IS NOT NULL")
    rows = of.join(chosen, "run_id").groupBy("run_id", "idx", "white_name", "infrared_name", "timed").agg(
        F.max(F.when(F.col("param") == F.col("white_name"), F.col("value"))).alias("white"), F.count_if(F.col("param") == F.col("white_name")).alias("_n"),
        F.max(F.when(F.col("param") == F.col("infrared_name"), F.col("value"))).alias("infrared"), F.max(F.when(F.col("param") == times, F.col("value"))).alias("stamp"),
    )
    t = F.when(F.col("timed"), F.col("stamp")).otherwise(F.col("idx") * F.lit(float(interval)))
    return rows.where("_n > 0").select("run_id", "idx", t.alias("t"), "white", "infrared", "white_name", "infrared_name")


def _in_buckets(led: DataFrame, threshold: float, bucket: float) -> tuple[DataFrame, DataFrame]:
    """led (run_id, t, light) with its time bucket, and each bucket's state at its start: a row for each bucket of a run that has samples."""
    s = led.select("run_id", "t", (F.col("white") > threshold).cast("int").alias("light"), F.floor(F.col("t") / bucket).alias("bucket"))
    last = s.groupBy("run_id", "bucket").agg(F.max(F.struct("t", "light"))["light"].alias("last"), F.max("t").alias("until"))
    return s, last.withColumn("before", F.lag("last").over(Window.partitionBy("run_id").orderBy("bucket")))


def light_periods(led: DataFrame, threshold: float = 0.5, view: tuple[float, float] | None = None, bucket: float = 86_400.0) -> DataFrame:
    """Light intervals (white power above the threshold, up to the first dark sample or the last one) and the dark ones between them, cut to the view.

    Samples are compared inside time buckets with the state that the bucket starts in; only changes and buckets meet by run.
    """
    s, starts = _in_buckets(led, threshold, bucket)
    w = Window.partitionBy("run_id", "bucket").orderBy("t")
    s = s.withColumn("was", F.lag("light").over(w)).join(starts.select("run_id", "bucket", "before"), ["run_id", "bucket"])
    changes = s.withColumn("was", F.coalesce("was", "before", F.lit(0))).where("light <> was").select("run_id", "t", "light")
    by_run = Window.partitionBy("run_id").orderBy("t")
    ends = starts.groupBy("run_id").agg(F.max("until").alias("until"))
    light = changes.withColumn("off", F.lead("t").over(by_run)).where("light = 1").join(ends, "run_id").select("run_id", F.col("t").alias("start"), F.coalesce("off", "until").alias("end"))
    after = F.lead("start").over(Window.partitionBy("run_id").orderBy("start"))
    dark = light.select("run_id", F.col("end").alias("start"), after.alias("end")).where("`end` is not null AND `end` > start")
    out = light.withColumn("phase", F.lit("light")).unionByName(dark.withColumn("phase", F.lit("dark")))
    if view:
        out = out.withColumns({"start": F.greatest("start", F.lit(view[0])), "end": F.least("end", F.lit(view[1]))}).where("`end` > start")
    return out.select("run_id", "phase", "start", "end")


def fixed_schedule(runs: DataFrame, on_hour: float = 7, off_hour: float = 19) -> DataFrame:
    """Light from on_hour to off_hour of each day between a run's t0 and tn, in seconds, cut to the run."""
    day = F.explode(F.sequence(F.floor(F.col("t0") / 86_400), F.floor(F.col("tn") / 86_400)))
    d = runs.select("run_id", "t0", "tn", day.alias("day"))
    d = d.withColumns({"start": F.greatest("t0", F.col("day") * 86_400.0 + on_hour * 3600), "end": F.least("tn", F.col("day") * 86_400.0 + off_hour * 3600)})
    return d.where("`end` > start").select("run_id", "day", "start", "end")


def with_light(samples: DataFrame, led: DataFrame, threshold: float = 0.5, bucket: float = 86_400.0) -> DataFrame:
    """samples with light: 1 or 0 as the last light sample at or before them has it, null before the first.

    A union and a window inside time buckets, and where a bucket has no light sample yet the state that it starts in;
    no join on ranges, and no window over a whole run but that of its buckets.
    """
    s, _ = _in_buckets(led, threshold, bucket)
    a = s.select("run_id", "bucket", "t", "light", F.lit(0).alias("kind"), *(F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in ("roi", "value", "tie")))
    b = samples.select("run_id", F.floor(F.col("t") / bucket).alias("bucket"), "t", F.lit(None).cast("int").alias("light"), F.lit(1).alias("kind"), "roi", "value", "tie")
    w = Window.partitionBy("run_id", "bucket").orderBy("t", "kind", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b)
    last = both.groupBy("run_id", "bucket").agg(F.max(F.when(F.col("light").isNotNull(), F.struct("t", "light")))["light"].alias("last"))
    before = F.last("last", True).over(Window.partitionBy("run_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    out = both.withColumn("light", F.last("light", True).over(w)).where("kind = 1").join(last.select("run_id", "bucket", before.alias("before")), ["run_id", "bucket"])
    return out.withColumn("light", F.coalesce("light", "before")).drop("kind", "bucket", "before")


def detected_interval(stamps: DataFrame, first: int = 9) -> DataFrame:
    """Mean and deviation of the first differences of timestamps (run_id, idx, t)."""
    w = Window.partitionBy("run_id").orderBy("idx")
    g = stamps.withColumns({"gap": F.col("t") - F.lag("t").over(w), "i": F.row_number().over(w)}).where(F.col("gap").isNotNull() & (F.col("i") <= first + 1))
    return g.groupBy("run_id").agg(F.avg("gap").alias("interval"), F.stddev_pop("gap").alias("std"), F.count("*").alias("n"))
