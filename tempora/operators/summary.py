"""Summaries of runs, of methods and of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.fits import percentile, ratio
from tempora.functions.selection import percentiles
from tempora.sources.tables import KEYS


def run_summary(bins: DataFrame, limits: DataFrame) -> DataFrame:
    """Mean movement and sleep percent over a run's series, the spread of their baselines, and labels of both."""
    each = bins.groupBy(*KEYS).agg((F.avg("fraction") * 100).alias("m"), (F.avg("sleep") * 100).alias("s"))
    m = each.groupBy("run_id").agg(F.count("*").alias("series"), F.avg("m").alias("movement_percent"), F.avg("s").alias("sleep_percent"))
    b = limits.groupBy("run_id").agg(ratio(F.stddev_pop("baseline_mean"), F.avg("baseline_mean"), 0.0).alias("consistency"))
    c, v = F.col("consistency"), F.col("movement_percent")
    # Fixed values.
    label = F.when(c < 0.1, "Good baseline consistency").when(c < 0.3, "Moderate baseline consistency").otherwise("High baseline variability")
    moved = F.when((v > 0) & (v < 100), "Reasonable movement levels").when(v == 0, "No movement detected").otherwise("High movement activity")
    return m.join(b, "run_id").withColumns({"baseline_quality": label, "movement_quality": moved})


def adaptive_summary(limits: DataFrame) -> DataFrame:
    """Statistics of noise, spread and multiplier, counts of labels and the share of robust estimates, over the series that got thresholds."""
    ok, levels = F.col("status") == "success", ("high", "medium", "low")
    stats = [f(F.when(ok, F.col(c))).alias(f"{c}_{n}") for c in ("snr", "cv", "multiplier") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    labels = [F.count_if(ok & (F.col(kind) == q)).alias(f"{kind}_{q}") for kind in ("quality", "stability") for q in levels]
    robust = F.count_if(ok & F.col("robust"))
    return limits.groupBy("run_id").agg(F.count("*").alias("series"), F.count_if(ok).alias("successful"), *stats, *labels, robust.alias("robust"), F.try_divide(robust * 100.0, F.count_if(ok)).alias("robust_percent"))


#: What the recommendations say, by rule.
ADVICE = {
    "none": "No series could be analysed: check the quality of the data", "noisy": "Many series are noisy: a longer interval or better imaging may help",
    "variable": "Signals vary much: thresholds were adjusted to it", "high": "A high mean multiplier: results may be conservative", "low": "A low mean multiplier: signals are clean and results sensitive",
    "robust": "Many series needed a robust baseline: the data may hold outliers or noise", "all": "All series were analysed", "most": "Most series were analysed", "some": "Some series failed: check the quality of their data",
}


def adaptive_recommendations(limits: DataFrame) -> DataFrame:
    """Advice by the shares of noisy, variable and robustly estimated series among those that got thresholds, their mean multiplier, and the share that got some."""
    ok = F.col("status") == "success"
    share = lambda c: F.avg(F.when(ok, c.cast("double")))
    m = limits.groupBy("run_id").agg(
        F.count("*").alias("series"), F.count_if(ok).alias("successful"), share(F.col("quality") == "low").alias("noisy"), share(F.col("cv") > 0.5).alias("variable"),
        share(F.col("robust")).alias("robust"), F.avg(F.when(ok, F.col("multiplier"))).alias("multiplier"),
    )
    done = F.col("successful") / F.col("series")
    rules = F.array(
        F.when(F.col("noisy") > 0.5, ADVICE["noisy"]), F.when(F.col("variable") > 0.3, ADVICE["variable"]),
        F.when(F.col("multiplier") > 3.0, ADVICE["high"]).when(F.col("multiplier") < 1.5, ADVICE["low"]), F.when(F.col("robust") > 0.5, ADVICE["robust"]),
        F.when(done == 1, ADVICE["all"]).when(done > 0.8, ADVICE["most"]).otherwise(F.lit(ADVICE["some"])),
    )
    advice = F.when(F.col("successful") == 0, F.lit(ADVICE["none"])).otherwise(F.array_join(F.array_compact(rules), "; "))
    return m.withColumns({"success": done, "recommendations": advice})


def calibration_summary(limits: DataFrame, bins: DataFrame) -> DataFrame:
    """Matched and missing series, and the mean movement percent of the matched ones."""
    ok = F.col("status") == "success"
    m = limits.groupBy("run_id").agg(F.count_if(ok).alias("matched"), F.count_if(~ok).alias("missing"), (F.count_if(ok) * 100 / F.count("*")).alias("success_percent"))
    each = bins.groupBy(*KEYS).agg((F.avg("fraction") * 100).alias("p")).groupBy("run_id").agg(F.avg("p").alias("movement_percent"))
    return m.join(each, "run_id", "left")


def series_summary(limits: DataFrame, states: DataFrame, bins: DataFrame, bin_size: float = 60) -> DataFrame:
    """Thresholds, movement samples and percent, sleep bins and minutes of each series."""
    a = states.groupBy(*KEYS).agg(F.sum("state").alias("movement_samples"), (F.avg("state") * 100).alias("movement_percent"))
    b = bins.groupBy(*KEYS).agg(F.sum("sleep").alias("sleep_bins"), (F.sum("sleep") * bin_size / 60).alias("sleep_minutes"), F.avg("fraction").alias("mean_fraction"))
    return limits.select(*KEYS, "baseline_mean", "upper", "lower", "status").join(a, list(KEYS), "left").join(b, list(KEYS), "left")


def compare_methods(**bins: DataFrame) -> DataFrame:
    """run_id, roi and for each method the mean movement and sleep percent; a series that a method lacks has 0."""
    out = None
    for name, rows in bins.items():
        part = rows.groupBy(*KEYS).agg((F.avg("fraction") * 100).alias("movement"), (F.avg("sleep") * 100).alias("sleep")).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*KEYS).pivot("method", list(bins)).agg(F.first("movement").alias("movement"), F.first("sleep").alias("sleep")).fillna(0.0)


def method_totals(**bins: DataFrame) -> DataFrame:
    out = None
    for name, rows in bins.items():
        part = rows.groupBy(*KEYS).agg((F.avg("fraction") * 100).alias("m"), (F.avg("sleep") * 100).alias("s")).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("run_id", "method").agg(F.count("*").alias("series"), F.avg("m").alias("movement_percent"), F.avg("s").alias("sleep_percent"))


def display_limits(samples: DataFrame, start: float, end: float, robust: bool = True, margin: float = 0.05, shared: bool = True, selected: bool = False) -> DataFrame:
    """Axis limits of each series in a range: percentiles 5 and 95 or the extremes, with a margin of their distance.

    A shared axis starts at 0 at least, and a flat series gets a tenth of its value, or 1 at 0, on either side; an axis of its own (shared=False) has neither.
    selected=True finds the percentiles by refined histograms, for series that one task shouldn't hold.
    """
    rows = samples.where(F.col("t").between(start, end))
    if robust and selected:
        m = percentiles(rows, KEYS, "value", {"lo": 0.05, "hi": 0.95})
    else:
        low, high = (percentile("value", 0.05), percentile("value", 0.95)) if robust else (F.min("value"), F.max("value"))
        m = rows.groupBy(*KEYS).agg(low.alias("lo"), high.alias("hi"))
    flat, pad = F.col("hi") == F.col("lo"), (F.col("hi") - F.col("lo")) * margin
    if not shared:
        return m.select(*KEYS, (F.col("lo") - pad).alias("axis_min"), (F.col("hi") + pad).alias("axis_max"), flat.alias("flat"))
    pad = F.when(flat & (F.col("hi") == 0), F.lit(1.0)).when(flat, F.abs("hi") * 0.1).otherwise(pad)
    return m.select(*KEYS, F.greatest(F.lit(0.0), F.col("lo") - pad).alias("axis_min"), (F.col("hi") + pad).alias("axis_max"), flat.alias("flat"))


def baseline_visible(samples: DataFrame, limits: DataFrame, start: float, end: float) -> DataFrame:
    m = samples.where(F.col("t").between(start, end)).groupBy(*KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return m.join(limits.select(*KEYS, "baseline_mean"), list(KEYS)).select(*KEYS, "baseline_mean", F.col("baseline_mean").between(F.col("lo"), F.col("hi")).alias("visible"))
