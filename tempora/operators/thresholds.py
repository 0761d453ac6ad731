"""Movement thresholds: (run_id, roi, baseline_mean, upper, lower, status, ...) from series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.fits import percentile, ratio
from tempora.functions.selection import percentiles
from tempora.operators.preprocess import by_time
from tempora.sources.tables import KEYS, stored


def from_baseline(samples: DataFrame, minutes: float, multiplier: float = 1.0, interval: float = 5.0, clamp: bool = False, selected: bool = False) -> DataFrame:
    """Mean plus and minus multiplier deviations over the first minutes; too few samples give (0, 0, 0). clamp keeps lower at 0 at least.

    selected=True uses no window over a series and finds quartiles by refined histograms, for series that one task shouldn't hold.
    """
    need, quartiles = max(10, int(minutes * 60 / interval * 0.8)), {"mid": 0.5, "high": 0.75, "low": 0.25}
    timed = samples.join(samples.groupBy(*KEYS).agg(F.min("t").alias("_t0")), list(KEYS)) if selected else samples.withColumn("_t0", F.min("t").over(Window.partitionBy(*KEYS)))
    span = timed.where(F.col("t") < F.col("_t0") + minutes * 60)
    span = stored(span) if selected else span
    m = span.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"), *(percentile("value", p).alias(k) for k, p in quartiles.items() if not selected))
    m = m.join(percentiles(span, KEYS, "value", quartiles), list(KEYS)) if selected else m
    sound = ~(F.isnan("mean") | F.isnan("std") | F.col("std").isNull())
    enough = F.col("n") >= need
    pick = lambda a, b: F.when(~enough, F.lit(0.0)).when(sound, a).otherwise(b)
    lower = pick(F.col("mean") - multiplier * F.col("std"), F.col("low"))
    return m.select(
        *KEYS, pick(F.col("mean"), F.col("mid")).alias("baseline_mean"), pick(F.col("mean") + multiplier * F.col("std"), F.col("high")).alias("upper"),
        (F.greatest(F.lit(0.0), lower) if clamp else lower).alias("lower"), F.when(enough, "success").otherwise("insufficient_data").alias("status"), F.col("n").alias("samples"),
    )


def adaptive(samples: DataFrame, minutes: float = 15.0, multiplier: float = 2.5, interval: float = 5.0, selected: bool = False) -> DataFrame:
    """Thresholds whose base and width depend on noise, spread and outliers of the first time that so many frames take, or of a shorter series as a whole.

    Series with fewer than 10 samples there get (0, 0, 0) and the status insufficient_analysis_data. selected=True finds the quartiles by refined
    histograms, for series that one task shouldn't hold.
    """
    frames, each = int(minutes * 60 / interval), Window.partitionBy(*KEYS)
    if selected:
        sized = samples.join(samples.groupBy(*KEYS).agg(F.min("t").alias("_t0"), F.count("*").alias("_n")), list(KEYS))
    else:
        sized = samples.withColumns({"_t0": F.min("t").over(each), "_n": F.count("*").over(each)})
    head = sized.where((F.col("t") < F.col("_t0") + frames * interval) | (F.lit(frames) >= F.col("_n")))
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    head = stored(head) if selected else head
    m = head.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"), *(percentile("value", p).alias(k) for k, p in quartiles.items() if not selected))
    m = m.join(percentiles(head, KEYS, "value", quartiles), list(KEYS)) if selected else m
    iqr = F.col("q3") - F.col("q1")
    out = head.join(m, list(KEYS)).groupBy(*KEYS).agg((F.count_if((F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)) * 100 / F.count("*")).alias("outliers"))
    m = m.join(out, list(KEYS))
    m = m.withColumns({"snr": ratio(F.col("mean"), F.col("std"), 0.0), "cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(1.0))})
    m = m.withColumn("robust", (F.col("cv") > 0.5) | (F.col("outliers") > 10))
    m = m.withColumns({"base": F.when(F.col("robust"), F.col("median")).otherwise(F.col("mean")), "width": F.when(F.col("robust"), iqr / 1.349).otherwise(F.col("std"))})
    by_snr = multiplier * F.when(F.col("snr") > 10, 0.7).when(F.col("snr") > 5, 1.0).otherwise(1.3)
    by_cv = F.when(F.col("cv") > 1, 1 + (F.col("cv") - 1) / 2).when(F.col("cv") < 0.2, 0.8 + F.col("cv")).otherwise(F.lit(1.0))
    m = m.withColumn("multiplier", by_snr * by_cv)
    m = m.withColumns({"up": F.col("base") + F.col("multiplier") * F.col("width"), "down": F.col("base") - F.col("multiplier") * F.col("width")})
    m = m.withColumns({"lower": F.when(F.col("down") < 0, F.greatest(F.lit(0.0), F.col("base") - F.col("width"))).otherwise(F.col("down")), "upper": F.when(F.col("up") < 1.1 * F.col("base"), 1.2 * F.col("base")).otherwise(F.col("up"))})
    quality = F.when(F.col("snr") > 10, "high").when(F.col("snr") > 5, "medium").otherwise("low")
    stability = F.when(F.col("cv") < 0.2, "high").when(F.col("cv") < 0.5, "medium").otherwise("low")
    enough = F.col("n") >= 10
    known = {"snr": F.col("snr"), "cv": F.col("cv"), "outliers": F.col("outliers"), "robust": F.col("robust"), "multiplier": F.col("multiplier"), "quality": quality, "stability": stability}
    return m.select(
        *KEYS, *(F.when(enough, F.col(c)).otherwise(F.lit(0.0)).alias(name) for c, name in (("base", "baseline_mean"), ("upper", "upper"), ("lower", "lower"))),
        F.when(enough, "success").otherwise("insufficient_analysis_data").alias("status"), F.col("n").alias("samples"), *(F.when(enough, c).alias(k) for k, c in known.items()),
    )


def calibration(samples: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Statistics of a recording made for calibration, over all its samples."""
    m = samples.groupBy(*KEYS).agg(F.avg("value").alias("baseline_mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("samples"), (F.max("value") - F.min("value")).alias("range"), (F.max("t") - F.min("t")).alias("duration"))
    return m.select(*KEYS, "baseline_mean", (F.col("baseline_mean") + multiplier * F.col("std")).alias("upper"), (F.col("baseline_mean") - multiplier * F.col("std")).alias("lower"), "std", "samples", "range", "duration")


def apply_calibration(samples: DataFrame, known: DataFrame) -> DataFrame:
    """Thresholds for each series of samples by roi; those without calibration get (0, 1, 0) and a status that keeps them out later."""
    rois = samples.select(*KEYS).distinct()
    found = rois.join(known.select("roi", F.col("baseline_mean").alias("_m"), F.col("upper").alias("_u"), F.col("lower").alias("_l")), "roi", "left")
    has = F.col("_m").isNotNull()
    return found.select(
        *KEYS, F.coalesce("_m", F.lit(0.0)).alias("baseline_mean"), F.coalesce("_u", F.lit(1.0)).alias("upper"), F.coalesce("_l", F.lit(0.0)).alias("lower"),
        F.when(has, "success").otherwise("no_calibration_data_for_roi").alias("status"),
    )


def calibration_quality(target: DataFrame, known: DataFrame, first: int = 1000) -> DataFrame:
    """How far the first target samples lie from the calibration, in its deviations and as a ratio of means."""
    head = target.withColumn("_i", F.row_number().over(by_time())).where(F.col("_i") <= first)
    t = head.groupBy(*KEYS).agg(F.avg("value").alias("target_mean"), F.stddev_pop("value").alias("target_std"))
    both = t.join(known.select("roi", F.col("baseline_mean").alias("cal_mean"), F.col("std").alias("cal_std"), F.col("upper"), F.greatest(F.lit(0.0), F.col("lower")).alias("lower")), "roi")
    snr = ratio(F.col("target_mean") - F.col("cal_mean"), F.col("cal_std"), 0.0)
    apart, part = F.abs(snr), ratio(F.col("target_mean"), F.col("cal_mean"), 0.0)
    both_over = lambda x: (snr > x) & (apart > x)
    grade = F.when(both_over(3), "excellent").when(both_over(2), "good").when(both_over(1), "fair").otherwise("poor")
    return both.select(*KEYS, "target_mean", "cal_mean", snr.alias("snr"), apart.alias("separation"), part.alias("ratio"), grade.alias("quality"), "upper", "lower")


def for_range(samples: DataFrame, start: float, end: float, multiplier: float = 1.0) -> DataFrame:
    """Mean plus and minus multiplier deviations of the samples between start and end, of series with more than 10 there."""
    m = samples.where(F.col("t").between(start, end)).groupBy(*KEYS).agg(F.avg("value").alias("baseline_mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("samples")).where("samples > 10")
    return m.select(*KEYS, "baseline_mean", (F.col("baseline_mean") + multiplier * F.col("std")).alias("upper"), (F.col("baseline_mean") - multiplier * F.col("std")).alias("lower"), "samples")


def with_band(thresholds: DataFrame) -> DataFrame:
    """Half the distance of the thresholds, and thresholds rebuilt from mean and band."""
    band = (F.col("upper") - F.col("lower")) / 2
    return thresholds.withColumns({"band": band, "band_upper": F.col("baseline_mean") + band, "band_lower": F.col("baseline_mean") - band})


def suggest_method(samples: DataFrame, first: int = 1000) -> DataFrame:
    """The method that fits a series' first samples."""
    head = samples.withColumn("_i", F.row_number().over(by_time())).where(F.col("_i") <= first)
    m = head.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("range"))
    m = m.withColumns({"cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(1.0)), "spread": F.when(F.col("mean") > 0, F.col("range") / F.col("mean")).otherwise(F.lit(1.0))})
    method = (
        F.when(F.col("n") < 100, "baseline").when(F.col("cv") > 0.8, "adaptive").when((F.col("cv") < 0.2) & (F.col("spread") < 0.5), "baseline")
        .when((F.col("mean") > 100) & (F.col("cv") > 0.3), "adaptive").otherwise("baseline")
    )
    return m.select(*KEYS, "n", "cv", "spread", method.alias("method"))
