"""Movement states with hysteresis, movement fractions, quiescence and sleep; the analysis pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators import preprocess, thresholds
from tempora.operators.preprocess import by_time
from tempora.sources.tables import KEYS, stored

BIN, QUIET, SLEEP_MINUTES = 60, 0.5, 8


def by_bin() -> Window:
    return Window.partitionBy(*KEYS).orderBy("bin_start")


def hysteresis(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """state of each sample: 1 from above upper until below lower. Right for thresholds in either order; no thresholds, no states.

    A sample beyond one threshold sets the state; one beyond both (lower above upper) flips it. So the state is the last one
    set, or the first sample's, flipped as often as such samples came since.
    """
    up_to_now = by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above, below = F.col("value") > F.col("upper"), F.col("value") < F.col("lower")
    out = samples.join(limits.select(*KEYS, "baseline_mean", "upper", "lower"), list(KEYS))
    out = out.withColumn("_set", F.when(above & ~below, 1).when(below & ~above, 0))
    out = out.withColumn("_flips", F.sum((above & below).cast("int")).over(up_to_now))
    begin = F.when(above, 1).when(below, 0).otherwise((F.col("value") > F.col("baseline_mean")).cast("int"))
    out = out.withColumns({"_begin": F.first(begin).over(up_to_now), "_last": F.last("_set", True).over(up_to_now), "_at": F.last(F.when(F.col("_set").isNotNull(), F.col("_flips")), True).over(up_to_now)})
    state = (F.coalesce("_last", "_begin") + F.col("_flips") - F.coalesce("_at", F.lit(0))) % 2
    return out.select(*KEYS, "t", "value", "tie", state.cast("int").alias("state"))


def above_threshold(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """state with one threshold, the upper one."""
    out = samples.join(limits.select(*KEYS, "upper"), list(KEYS))
    return out.select(*KEYS, "t", "value", "tie", (F.col("value") > F.col("upper")).cast("int").alias("state"))


def movement_fraction(states: DataFrame, bin_size: int = BIN) -> DataFrame:
    """bin_start, bin_center, fraction: the share of each bin spent in state 1; a state lasts to the next sample. Empty bins are 0."""
    return fractions_of_spans(states.select(*KEYS, "t", "state", F.lead("t").over(by_time()).alias("next")).where("next is not null"), bin_size)


def fractions_of_spans(timed: DataFrame, bin_size: int) -> DataFrame:
    """movement_fraction of states that come with the time of the next sample."""
    b = F.lit(float(bin_size))
    # What lies between successive samples covers all bins from the first to the last, so no spine is joined.
    low, high = F.floor(F.col("t") / b), F.ceil(F.col("next") / b) - 1
    spans = timed.where(high >= low).select(*KEYS, "t", "next", "state", F.explode(F.sequence(low, high)).alias("bin"))
    shared = F.least(F.col("next"), (F.col("bin") + 1) * b) - F.greatest(F.col("t"), F.col("bin") * b)
    out = spans.groupBy(*KEYS, "bin").agg(F.sum(F.when(F.col("state") == 1, F.greatest(F.lit(0.0), shared)).otherwise(0.0)).alias("spent"))
    return out.select(*KEYS, (F.col("bin") * b).alias("bin_start"), ((F.col("bin") + 0.5) * b).alias("bin_center"), F.least(F.lit(1.0), F.col("spent") / b).alias("fraction"))


def quiescence(fractions: DataFrame, threshold: float = QUIET) -> DataFrame:
    return fractions.withColumn("quiescent", (F.col("fraction") < threshold).cast("int"))


def runs(rows: DataFrame, state: str, order: str = "bin_start") -> DataFrame:
    """rows with run: a number shared by adjacent rows of equal state."""
    each = Window.partitionBy(*KEYS).orderBy(order)
    alike = Window.partitionBy(*KEYS, state).orderBy(order)
    return rows.withColumn("run", F.row_number().over(each) - F.row_number().over(alike))


def sleep(quiet: DataFrame, minutes: float = SLEEP_MINUTES, bin_size: int = BIN) -> DataFrame:
    """sleep of each bin: in a run of enough adjacent quiescent bins."""
    need = int(minutes * 60) // bin_size
    length = F.count("*").over(Window.partitionBy(*KEYS, "quiescent", "run"))
    return runs(quiet, "quiescent").withColumn("sleep", ((F.col("quiescent") == 1) & (length >= need)).cast("int")).drop("run")


def sleep_bouts(slept: DataFrame, bin_size: int = BIN) -> DataFrame:
    """start, end and minutes of each run of sleep."""
    bouts = runs(slept, "sleep").where("sleep = 1").groupBy(*KEYS, "run").agg(F.min("bin_start").alias("start"), (F.max("bin_start") + bin_size).alias("end"))
    return bouts.select(*KEYS, "start", "end", ((F.col("end") - F.col("start")) / 60).alias("minutes"))


def sleep_totals(slept: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Total sleep, bouts, mean bout and efficiency (sleep of recording) of each series."""
    b = sleep_bouts(slept, bin_size).groupBy(*KEYS).agg(F.sum("minutes").alias("sleep_minutes"), F.count("*").alias("bouts"), F.avg("minutes").alias("mean_bout"))
    whole = slept.groupBy(*KEYS).agg((F.count("*") * bin_size / 60).alias("recorded_minutes"))
    out = whole.join(b, list(KEYS), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*KEYS, "recorded_minutes", zero("sleep_minutes").alias("sleep_minutes"), F.coalesce("bouts", F.lit(0)).alias("bouts"), zero("mean_bout").alias("mean_bout"), (zero("sleep_minutes") / F.col("recorded_minutes")).alias("efficiency"))


def activity_statistics(fractions: DataFrame) -> DataFrame:
    """Mean fraction, its standard error as a share and its 95 % interval."""
    m = fractions.groupBy(*KEYS).agg(F.avg("fraction").alias("mean"), F.count("*").alias("n"))
    error = F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("n"))
    return m.select(*KEYS, "n", "mean", error.alias("standard_error"), (F.col("mean") - 1.96 * error).alias("low"), (F.col("mean") + 1.96 * error).alias("high"))


def fraction_distribution(fractions: DataFrame) -> DataFrame:
    """How many bins are still, partly active and wholly active, and their percentages."""
    n = F.count("*")
    kinds = {"still": F.col("fraction") == 0, "partial": (F.col("fraction") > 0) & (F.col("fraction") < 1), "full": F.col("fraction") == 1}
    return fractions.groupBy(*KEYS).agg(n.alias("bins"), *(F.count_if(c).alias(k) for k, c in kinds.items()), *((F.count_if(c) * 100 / n).alias(f"{k}_percent") for k, c in kinds.items()))


def audit(slept: DataFrame, threshold: float = QUIET) -> DataFrame:
    """Bins whose quiescence breaks the rule, sleep without quiescence, and the ratio of sleep to quiescence."""
    wrong = (F.col("fraction") < threshold).cast("int") != F.col("quiescent")
    m = slept.groupBy(*KEYS).agg(F.count_if(wrong).alias("wrong_quiescence"), F.count_if((F.col("sleep") == 1) & (F.col("quiescent") == 0)).alias("wrong_sleep"), F.sum("quiescent").alias("quiescent_bins"), F.sum("sleep").alias("sleep_bins"))
    return m.withColumn("sleep_ratio", F.col("sleep_bins") / F.greatest(F.lit(1), F.col("quiescent_bins")))


def behaviour(samples: DataFrame, limits: DataFrame, bin_size: int = BIN, threshold: float = QUIET, sleep_minutes: float = SLEEP_MINUTES) -> DataFrame:
    """Bins with fraction, quiescence and sleep, from series and thresholds that worked."""
    fractions = movement_fraction(hysteresis(samples, limits), bin_size)
    return sleep(quiescence(fractions, threshold), sleep_minutes, bin_size)


def analyze(samples: DataFrame, method: str = "baseline", *, calibration: DataFrame | None = None, bin_size: int = BIN, threshold: float = QUIET, sleep_minutes: float = SLEEP_MINUTES, detrended: bool = True, store: bool = False, segment: float | None = None, used: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """thresholds, samples (as used), states and bins by the method: baseline, adaptive or calibration.

    Baseline thresholds come from the series before detrending, adaptive ones from it after; calibration ones from another
    recording, and series without one are left out. Thresholds of (0, 0, 0), where samples are too few, are applied as they are.
    detrended=False takes series as they are. store=True writes states and bins as tables, for callers that read them more than once.
    segment: seconds of the segments that series too long for one task are cut into (see `segments`); the results are the same.
    used: the series as this method detrends them, where they are at hand.
    """
    from tempora.operators import segments

    flat = lambda jumps=True: used if used is not None else detrended_for(samples, jumps, segment)
    if method == "baseline":
        limits = thresholds.from_baseline(samples, options.pop("minutes", 200), selected=bool(segment), **options)
        used = flat() if detrended else samples
    elif method == "adaptive":
        used = flat(False) if detrended else samples
        limits = thresholds.adaptive(used, selected=bool(segment), **options)
    elif method == "calibration":
        if calibration is None:
            raise ValueError("the calibration method needs a calibration recording")
        limits = thresholds.apply_calibration(samples, thresholds.calibration(calibration, **options))
        used = flat() if detrended else samples
    else:
        raise ValueError(f"unknown method {method!r}: baseline, adaptive or calibration")
    good = limits.where("status = 'success'") if method == "calibration" else limits
    keep = stored if store else lambda df: df
    states = keep(segments.hysteresis(used, good, segment) if segment else hysteresis(used, good))
    fractions = segments.movement_fraction(states, bin_size, segment) if segment else movement_fraction(states, bin_size)
    bins = keep(sleep(quiescence(fractions, threshold), sleep_minutes, bin_size))
    return {"thresholds": limits, "samples": used, "states": states, "bins": bins}


def detrended_for(samples: DataFrame, jumps: bool = True, segment: float | None = None) -> DataFrame:
    from tempora.operators import segments

    return segments.detrend(samples, segment, jumps) if segment else preprocess.detrend(samples, jumps)


def analyze_all(samples: DataFrame, methods: dict[str, dict], *, segment: float | None = None, **common) -> dict[str, dict[str, DataFrame]]:
    """analyze by several methods (name to its own options) side by side. Series are detrended once for all methods that take them alike, and kept as a table."""
    flat: dict[bool, DataFrame] = {}
    for method in methods:
        jumps = method != "adaptive"
        if jumps not in flat:
            flat[jumps] = stored(detrended_for(samples, jumps, segment))
    return {method: analyze(samples, method, used=flat[method != "adaptive"], segment=segment, **common, **options) for method, options in methods.items()}
