"""Timing checks, jump correction and detrending of series (run_id, roi, t, value, tie)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.fits import percentile, ratio, solve3
from tempora.sources.tables import KEYS

#: Factor of the median local deviation beyond which a difference is a jump; samples below which a series isn't detrended.
JUMP_FACTOR, LEAST_SAMPLES = 1.5, 20


def by_time() -> Window:
    return Window.partitionBy(*KEYS).orderBy("t", "tie")


def whole() -> Window:
    return Window.partitionBy(*KEYS)


def quality_of(share: Column, bounds: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The first name whose bound is above the share, else the last."""
    out = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(share < bound, name).otherwise(out)
    return out


def validate_intervals(samples: DataFrame, expected: float, first: int = 50) -> DataFrame:
    """Mean, median, deviation and drift of the first sampling intervals of each series against the expected one."""
    w = by_time()
    head = samples.withColumns({"i": F.row_number().over(w), "gap": F.lead("t").over(w) - F.col("t")}).where(F.col("i") < first).where("gap is not null")
    out = head.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.avg("gap").alias("mean"), percentile("gap", 0.5).alias("median"), F.stddev_pop("gap").alias("std"), F.min("gap").alias("min"), F.max("gap").alias("max"), F.regr_slope("gap", F.col("i") - 1).alias("slope")
    )
    return out.select(
        *KEYS, "n", "mean", "median", "std", "min", "max",
        (F.abs(F.col("mean") - expected) > max(1.0, 0.1 * expected)).alias("needs_correction"), (F.col("std") < 0.05 * expected).alias("consistent"),
        quality_of(F.col("std") / expected, (0.01, 0.03, 0.05), ("excellent", "good", "acceptable", "poor")).alias("quality"),
        F.when(F.col("n") > 10, F.col("slope")).alias("drift"), ratio(F.col("std"), F.col("mean"), 0.0).alias("cv"),
    )


def timing_correction(samples: DataFrame, interval: float, baseline_minutes: float, bin_size: float, tolerance: float = 0.1) -> DataFrame:
    """Corrected interval, baseline (as many whole frames) and bin for series whose median of the first 19 intervals is off by more than a second and the tolerance; sample times stay."""
    w = by_time()
    head = samples.withColumns({"i": F.row_number().over(w), "gap": F.lead("t").over(w) - F.col("t")}).where("i <= 19 and gap is not null")
    out = head.groupBy(*KEYS).agg(percentile("gap", 0.5).alias("actual"))
    off = F.abs(F.col("actual") - interval) > max(1.0, tolerance * interval)
    bin_ = (F.greatest(F.lit(1.0), F.bround(F.lit(bin_size) / F.col("actual"))) * F.col("actual")).cast("int")
    return out.select(
        *KEYS, "actual", off.alias("corrected"), F.when(off, F.col("actual")).otherwise(interval).alias("interval"),
        F.when(off, F.lit(int(baseline_minutes * 60 / interval)) * F.col("actual") / 60).otherwise(baseline_minutes).alias("baseline_minutes"), F.when(off, bin_).otherwise(F.lit(int(bin_size))).alias("bin_size"),
    )


def subtract_minimum(samples: DataFrame) -> DataFrame:
    return samples.withColumn("value", F.col("value") - F.min("value").over(whole()))


def check_normalised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether the least value is 0 and the range is as before, within 0.001."""
    side = lambda df, p: df.groupBy(*KEYS).agg(F.min("value").alias(f"{p}_min"), (F.max("value") - F.min("value")).alias(f"{p}_range"))
    both = side(before, "before").join(side(after, "after"), list(KEYS))
    zero, same = F.abs("after_min") < 0.001, F.abs(F.col("before_range") - F.col("after_range")) < 0.001
    return both.select(*KEYS, "before_range", "after_range", zero.alias("zero_minimum"), same.alias("same_range"), (zero & same).alias("ok"))


def detect_jumps(samples: DataFrame, factor: float = JUMP_FACTOR) -> DataFrame:
    """samples with n and jump: the difference to the next sample where it exceeds factor times the median local deviation, else 0.

    The local deviation covers the differences up to h rows around, h from the series' length. It comes from running sums of the
    centred differences, read h rows on and h + 1 rows back, so a row costs the same whatever h.
    """
    w, all_ = by_time(), whole()
    up_to_now = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = samples.withColumns({"n": F.count("*").over(all_), "diff": F.lead("value").over(w) - F.col("value")})
    out = out.withColumn("_d", F.col("diff") - F.avg("diff").over(all_))
    sums = {"n": F.count("_d"), "a": F.sum("_d"), "b": F.sum(F.col("_d") * F.col("_d"))}
    out = out.withColumns({f"_now_{k}": s.over(up_to_now) for k, s in sums.items()} | {f"_end_{k}": s.over(all_) for k, s in sums.items()})
    pack = lambda side: F.struct(*(F.coalesce(F.col(f"_{side}_{k}").cast("double"), F.lit(0.0)).alias(k) for k in sums))
    out = out.withColumns({"_now": pack("now"), "_end": pack("end")}).drop(*(f"_{side}_{k}" for side in ("now", "end") for k in sums))
    h = F.floor(F.least(F.lit(20), F.floor(F.col("n") / 5)) / 2)
    on = F.coalesce(*(F.when(h == k, F.coalesce(F.lead("_now", k).over(w), F.col("_end"))) for k in range(2, 11)))
    back = F.coalesce(*(F.when(h == k, F.lag("_now", k + 1).over(w)) for k in range(2, 11)))
    out = out.withColumns({"_on": on, "_back": back})
    m, s1, s2 = (F.col(f"_on.{k}") - F.coalesce(F.col(f"_back.{k}"), F.lit(0.0)) for k in sums)
    local = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(s2 - F.try_divide(s1 * s1, m), m)))
    out = out.withColumn("local", F.when(F.col("diff").isNotNull() & (F.col("n") >= 25), local))
    out = out.withColumn("typical", percentile("local", 0.5).over(all_))
    jump = F.when(F.abs("diff") > factor * F.col("typical"), F.col("diff")).otherwise(F.lit(0.0))
    return out.withColumn("jump", F.coalesce(jump, F.lit(0.0))).drop("local", "typical", "diff", "_d", "_now", "_end", "_on", "_back")


def remove_jumps(samples: DataFrame, factor: float = JUMP_FACTOR) -> DataFrame:
    """Every jump is taken off all later samples."""
    before = F.coalesce(F.sum("jump").over(by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return detect_jumps(samples, factor).withColumn("value", F.col("value") - before).drop("jump", "n")


def _quadratic(samples: DataFrame) -> DataFrame:
    """samples with trend (least-squares parabola) and trend_mean. Time is centred and scaled for each series first.

    Sums are taken over the series' window, which shares partitions and sort with the jumps' windows: no join, no further shuffle.
    """
    w = whole()
    x = samples.withColumns({"_mid": F.avg("t").over(w), "_span": F.max("t").over(w) - F.min("t").over(w)}).withColumn("_x", F.coalesce(F.try_divide(F.col("t") - F.col("_mid"), F.col("_span")), F.lit(0.0)))
    power = lambda k: F.lit(1.0) if k == 0 else F.pow("_x", F.lit(k))
    x = x.withColumns({f"_s{k}": F.sum(power(k)).over(w) for k in range(5)} | {f"_y{k}": F.sum(power(k) * F.col("value")).over(w) for k in range(3)})
    c = solve3([[F.col(f"_s{i + j}") for j in range(3)] for i in range(3)], [F.col(f"_y{k}") for k in range(3)])
    x = x.withColumns({f"_c{k}": v for k, v in enumerate(c)})
    trend = F.col("_c0") + F.col("_c1") * F.col("_x") + F.col("_c2") * F.col("_x") * F.col("_x")
    mean = (F.col("_c0") * F.col("_s0") + F.col("_c1") * F.col("_s1") + F.col("_c2") * F.col("_s2")) / F.col("_s0")
    return x.select(*samples.columns, trend.alias("trend"), mean.alias("trend_mean"))


def detrend_quadratic(samples: DataFrame) -> DataFrame:
    """value less its parabola, plus the parabola's mean."""
    return _quadratic(samples).withColumn("value", F.coalesce(F.col("value") - F.col("trend") + F.col("trend_mean"), F.col("value"))).drop("trend", "trend_mean")


def detrend_guarded(samples: DataFrame) -> DataFrame:
    """Like detrend_quadratic; where that would push the mean below half, the trend's rise since the start goes instead."""
    w = whole()
    out = _quadratic(samples).withColumn("_plain", F.col("value") - F.col("trend") + F.col("trend_mean"))
    first = F.first("trend").over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    low = F.avg("_plain").over(w) < 0.5 * F.avg("value").over(w)
    return out.withColumn("value", F.when(low, F.col("value") - (F.col("trend") - first)).otherwise(F.col("_plain"))).drop("_plain", "trend", "trend_mean")


def _with_drift(samples: DataFrame, mean_of: str) -> DataFrame:
    """samples with _slope and _drift: the slope's rise over the series in percent of the mean of column mean_of, 0 unless that is positive."""
    w = whole()
    x = samples.withColumns({"_slope": F.regr_slope("value", "t").over(w), "_mean": F.avg(mean_of).over(w), "_span": F.max("t").over(w) - F.min("t").over(w)})
    drift = F.when(F.col("_mean") > 0, F.abs(F.col("_slope") * F.col("_span")) / F.col("_mean") * 100)
    return x.withColumn("_drift", F.coalesce(drift, F.lit(0.0)))


def remove_drift(samples: DataFrame, mean_of: str = "value", percent: float = 1.0) -> DataFrame:
    """Takes slope times t off series that drift by more than percent of the mean of column mean_of; the intercept stays."""
    out = _with_drift(samples, mean_of)
    return out.withColumn("value", F.when(F.col("_drift") > percent, F.col("value") - F.col("_slope") * F.col("t")).otherwise(F.col("value"))).drop("_slope", "_mean", "_span", "_drift")


def detrend(samples: DataFrame, jumps: bool = True) -> DataFrame:
    """Jumps, parabola, drift; a series of fewer than 20 samples stays as it is. One shuffle on the series, windows of one sort."""
    enough = F.col("_n") >= LEAST_SAMPLES
    level = (remove_jumps(samples) if jumps else samples).withColumns({"_n": F.count("*").over(whole()), "_level": F.col("value")})
    flat = _quadratic(level)
    flat = flat.withColumn("value", F.when(enough, F.coalesce(F.col("value") - F.col("trend") + F.col("trend_mean"), F.col("value"))).otherwise(F.col("value"))).drop("trend", "trend_mean")
    out = _with_drift(flat, "_level")
    return out.withColumn("value", F.when(enough & (F.col("_drift") > 1.0), F.col("value") - F.col("_slope") * F.col("t")).otherwise(F.col("value"))).select(*samples.columns)


def detrend_robust(samples: DataFrame, percent: float = 2.0) -> DataFrame:
    """Jumps and drift alone; drift is measured by the original mean. With drift_percent and drift_removed."""
    out = _with_drift(remove_jumps(samples.withColumn("_raw", F.col("value"))), "_raw").withColumn("drift_percent", F.col("_drift"))
    out = out.withColumn("drift_removed", F.col("drift_percent") > percent)
    return out.withColumn("value", F.when(F.col("drift_removed"), F.col("value") - F.col("_slope") * F.col("t")).otherwise(F.col("value"))).drop("_slope", "_mean", "_span", "_drift", "_raw")


def detrend_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """Slopes and ranges before and after, their reductions in percent, and a class of the slope's reduction."""
    side = lambda df, p: df.groupBy(*KEYS).agg(F.regr_slope("value", "t").alias(f"{p}_slope"), (F.max("value") - F.min("value")).alias(f"{p}_range"))
    both = side(before, "before").join(side(after, "after"), list(KEYS))
    cut = ratio((F.abs("before_slope") - F.abs("after_slope")) * 100, F.abs("before_slope"), 0.0)
    kind = F.when(cut > 50, "effective").when(cut > 20, "moderate").otherwise("limited")
    return both.select(*KEYS, "before_slope", "after_slope", cut.alias("slope_reduction"), kind.alias("effect"), ratio((F.col("before_range") - F.col("after_range")) * 100, F.col("before_range"), 0.0).alias("range_reduction"))
