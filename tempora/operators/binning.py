"""Binning, resampling and slicing of series and of bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.fits import ratio
from tempora.operators.preprocess import by_time
from tempora.sources.tables import KEYS


def _binned(rows: DataFrame, time: str, value: str, size: float, anchor, until=None) -> DataFrame:
    k = F.floor((F.col(time) - F.col("_anchor")) / size)
    rows = rows.withColumns({"_t0": F.min(time).over(Window.partitionBy(*KEYS)), "_tn": F.max(time).over(Window.partitionBy(*KEYS)), "_n": F.count("*").over(Window.partitionBy(*KEYS))})
    rows = rows.where("_n >= 2").withColumn("_anchor", anchor).withColumn("_k", k)
    rows = rows.where(F.col("_anchor") + F.col("_k") * size < F.col("_tn"))
    out = rows.groupBy(*KEYS, "_anchor", "_k").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(*KEYS, (F.col("_anchor") + (F.col("_k") + 0.5) * size).alias("bin_center"), "mean", "n")


def lighting_activity(fractions: DataFrame, minutes: float = 30) -> DataFrame:
    """Mean fraction in bins that start at the hour before the first bin."""
    return _binned(fractions, "bin_center", "fraction", minutes * 60, F.floor(F.col("_t0") / 3600) * 3600)


def lighting_amplitude(samples: DataFrame, minutes: float = 30) -> DataFrame:
    """Mean raw value in bins that start at a multiple of their width."""
    return _binned(samples, "t", "value", minutes * 60, F.floor(F.col("_t0") / (minutes * 60)) * (minutes * 60))


def lighting_rest(quiet: DataFrame, minutes: float = 30) -> DataFrame:
    """Mean quiescence in bins that start at the first bin."""
    return _binned(quiet, "bin_center", "quiescent", minutes * 60, F.col("_t0"))


def lighting(quiet: DataFrame, focus: str = "activity", minutes: float = 30) -> DataFrame:
    if focus not in ("activity", "rest"):
        raise ValueError(f"unknown focus {focus!r}: activity or rest")
    return lighting_activity(quiet, minutes) if focus == "activity" else lighting_rest(quiet, minutes)


def resample(samples: DataFrame, size: float) -> DataFrame:
    """idx, t, value: means of bins of size from the first sample on; an empty bin takes the one before, a leading one 0."""
    w = Window.partitionBy(*KEYS)
    ends = samples.groupBy(*KEYS).agg(F.min("t").alias("t0"), F.max("t").alias("tn"))
    bins = F.greatest(F.lit(1), F.ceil((F.col("tn") - F.col("t0")) / size))
    spine = ends.select(*KEYS, "t0", F.explode(F.sequence(F.lit(0), bins.cast("int") - 1)).alias("idx"))
    timed = samples.withColumn("_t0", F.min("t").over(w)).withColumn("idx", F.floor((F.col("t") - F.col("_t0")) / size).cast("int"))
    means = timed.groupBy(*KEYS, "idx").agg(F.avg("value").alias("mean"))
    up_to_now = Window.partitionBy(*KEYS).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = spine.join(means, [*KEYS, "idx"], "left").withColumn("value", F.coalesce(F.last("mean", True).over(up_to_now), F.lit(0.0)))
    return out.select(*KEYS, "idx", (F.col("t0") + F.col("idx") * size).alias("t"), "value")


def resampled_arrays(samples: DataFrame, size: float) -> DataFrame:
    """samples (their number), values: what resample gives, with a row for each series whose run_id and roi are known; no bin is a row, and samples are shuffled once."""
    w = Window.partitionBy(*KEYS)
    timed = samples.where("run_id IS NOT NULL AND roi IS NOT NULL").withColumns({"_t0": F.min("t").over(w), "_tn": F.max("t").over(w)}).withColumn("idx", F.floor((F.col("t") - F.col("_t0")) / size).cast("int"))
    means = timed.groupBy(*KEYS, "idx").agg(F.avg("value").alias("mean"), F.count("*").alias("_n"), F.max(F.col("_tn") - F.col("_t0")).alias("_long"))
    known = F.when(F.col("idx").isNotNull() & F.col("mean").isNotNull(), F.struct("idx", "mean"))
    bins = F.greatest(F.lit(1), F.ceil(F.max("_long") / size).cast("int"))
    series = means.groupBy(*KEYS).agg(F.sum("_n").alias("samples"), bins.alias("_bins"), F.array_sort(F.collect_list(known)).alias("_known"))
    series = series.withColumn("_known", F.concat(F.array(F.struct(F.lit(0).alias("idx"), F.lit(0.0).alias("mean"))), "_known"))
    stay = F.transform("_known", lambda x, i: F.array_repeat(x["mean"], F.coalesce(F.get("_known", i + 1)["idx"], F.col("_bins")) - x["idx"]))
    return series.select(*KEYS, "samples", F.flatten(stay).alias("values"))


def rebin(samples: DataFrame, old: float, new: float) -> DataFrame:
    """Means of time and value of every round(new / old) adjacent samples; unchanged unless new is larger."""
    if new <= old:
        return samples.select(*KEYS, "t", "value")
    factor = round(new / old)
    group = F.floor((F.row_number().over(by_time()) - 1) / factor)
    return samples.withColumn("_g", group).groupBy(*KEYS, "_g").agg(F.avg("t").alias("t"), F.avg("value").alias("value")).drop("_g")


def between_hours(rows: DataFrame, start: float, end: float, time: str = "t") -> DataFrame:
    return rows.where(F.col(time).between(start * 3600, end * 3600))


def preset_window(samples: DataFrame, preset: str) -> DataFrame:
    """last_24h (all of a shorter run), first_24h, second_24h or all, by the run's own start and end."""
    day = 86_400.0
    keep = {
        "last_24h": F.col("t") >= F.col("_tn") - day, "first_24h": F.col("t") <= F.col("_t0") + day,
        "second_24h": (F.col("t") >= F.col("_t0") + day) & (F.col("t") <= F.col("_t0") + 2 * day), "all": F.lit(True),
    }[preset]
    ends = samples.groupBy("run_id").agg(F.min("t").alias("_t0"), F.max("t").alias("_tn"))
    return samples.join(ends, "run_id").where(keep).select(*samples.columns)


def auto_period_range(samples: DataFrame) -> DataFrame:
    """The periods in hours that a run of its length can show."""
    m = samples.groupBy("run_id").agg(((F.max("t") - F.min("t")) / 3600).alias("hours"))
    d = F.col("hours")
    low = F.when(d < 12, 0.5).when(d < 48, 1.0).otherwise(12.0)
    high = F.when(d < 12, F.greatest(F.lit(3.0), d / 2)).when(d < 48, F.least(F.lit(18.0), d / 2)).otherwise(F.least(F.lit(36.0), d / 2))
    return m.select("run_id", "hours", low.alias("min_period"), high.alias("max_period"))


def sliding_windows(samples: DataFrame, hours: float = 24, step: float = 12) -> DataFrame:
    """Each sample once for every whole window of hours that it falls into; window is the window's start."""
    size, hop = hours * 3600, step * 3600
    ends = samples.groupBy("run_id").agg(F.min("t").alias("_t0"), F.max("t").alias("_tn"))
    rows = samples.join(ends, "run_id")
    last = F.floor((F.col("t") - F.col("_t0")) / hop)
    first = F.greatest(F.lit(0), F.floor((F.col("t") - F.col("_t0") - size) / hop) + 1)
    rows = rows.withColumn("_k", F.explode(F.sequence(first, last))).withColumn("window", F.col("_t0") + F.col("_k") * hop)
    return rows.where(F.col("window") + size <= F.col("_tn")).drop("_t0", "_tn", "_k")


def compare_ranges(samples: DataFrame, before: tuple[float, float], after: tuple[float, float]) -> DataFrame:
    """Mean, deviation and count in two ranges of hours, and the change of the mean."""
    tag = F.when(F.col("t").between(before[0] * 3600, before[1] * 3600), "before").when(F.col("t").between(after[0] * 3600, after[1] * 3600), "after")
    m = samples.withColumn("part", tag).where("part is not null").groupBy(*KEYS, "part").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    side = lambda p: m.where(F.col("part") == p).select(*KEYS, *(F.col(c).alias(f"{p}_{c}") for c in ("mean", "std", "n")))
    both = side("before").join(side("after"), list(KEYS))
    return both.withColumns({"change": F.col("after_mean") - F.col("before_mean"), "change_percent": ratio((F.col("after_mean") - F.col("before_mean")) * 100, F.col("before_mean"), 0.0)})


def audit_lighting(quiet: DataFrame, minutes: float = 30) -> DataFrame:
    """Whether binning kept the mean (0.05) and activity mirrors rest (0.2), and how much it compressed."""
    a = lighting_activity(quiet, minutes).groupBy(*KEYS).agg(F.avg("mean").alias("activity"), F.count("*").alias("bins"))
    r = lighting_rest(quiet, minutes).groupBy(*KEYS).agg(F.avg("mean").alias("rest"))
    raw = quiet.groupBy(*KEYS).agg(F.avg("fraction").alias("raw"), F.count("*").alias("n"))
    both = raw.join(a, list(KEYS)).join(r, list(KEYS))
    gap, mirror = F.abs(F.col("raw") - F.col("activity")), F.abs(F.col("activity") - (1 - F.col("rest")))
    return both.select(*KEYS, gap.alias("mean_gap"), (gap < 0.05).alias("mean_kept"), (F.col("n") / F.col("bins")).alias("compression"), mirror.alias("mirror_gap"), (mirror < 0.2).alias("mirrored"))


def peak_bins(binned: DataFrame) -> DataFrame:
    """Bins above mean plus deviation, their number and percentage."""
    m = binned.groupBy(*KEYS).agg(F.avg("mean").alias("_m"), F.stddev_pop("mean").alias("_s"))
    over = F.col("mean") > F.col("_m") + F.col("_s")
    return binned.join(m, list(KEYS)).groupBy(*KEYS).agg(F.count("*").alias("bins"), F.count_if(over).alias("peaks"), (F.count_if(over) * 100 / F.count("*")).alias("percent"))


def data_quality(samples: DataFrame, period_hours: float = 24, gap_factor: float = 5) -> DataFrame:
    """Checks before a rhythm analysis: spread, outliers beyond 3 deviations, no variance, gaps, and three periods of data."""
    m = samples.groupBy(*KEYS).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count("*").alias("n"), ((F.max("t") - F.min("t")) / 3600).alias("hours"))
    out = samples.withColumn("_gap", F.col("t") - F.lag("t").over(by_time())).join(m, list(KEYS))
    mean_gap = F.col("hours") * 3600 / F.greatest(F.lit(1), F.col("n") - 1)
    out = out.groupBy(*KEYS, "n", "hours", "_m", "_s").agg(F.count_if(F.abs(F.col("value") - F.col("_m")) > 3 * F.col("_s")).alias("outliers"), F.count_if(F.col("_gap") > gap_factor * mean_gap).alias("gaps"))
    cv = ratio(F.col("_s"), F.col("_m"), 0.0)
    return out.select(*KEYS, "n", "hours", cv.alias("cv"), (cv < 1).alias("spread_ok"), "outliers", (F.col("_s") == 0).alias("constant"), "gaps", (F.col("hours") >= 3 * period_hours).alias("long_enough"))
