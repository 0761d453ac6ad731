"""Hysteresis, movement fractions, jumps and detrending of series of any length: scans over segments of time.

A series is cut into segments of so many seconds. A segment is summarised by what it does to what is carried over it (the state that it leaves for
either state that it is entered with, the sum of its jumps, its first and last samples); summaries are composed over the series' segments,
a row for each; then every segment is worked out by itself from what it is entered with. No window holds more than a segment's samples, or a
series' segments. Results are those of `states` and `preprocess`, whose windows hold a series, for segments of any length.

Samples at one instant share a segment, so how far a series can be cut depends on its times. Series are (run_id, roi, t, value, tie); other columns go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.fits import solve3
from tempora.functions.selection import percentiles
from tempora.operators import states
from tempora.operators.preprocess import JUMP_FACTOR, LEAST_SAMPLES
from tempora.sources.tables import KEYS, stored

#: Samples before and after one that its local deviation and its difference take in.
BEFORE, AFTER = 10, 11
PLACE = (*KEYS, "segment")


def with_segments(samples: DataFrame, seconds: float) -> DataFrame:
    return samples.select(*KEYS, "t", "value", "tie", F.floor(F.col("t") / seconds).alias("segment"))


def within() -> Window:
    return Window.partitionBy(*PLACE).orderBy("t", "tie")


def in_order() -> Window:
    """A series' segments: a row for each."""
    return Window.partitionBy(*KEYS).orderBy("segment")


def before() -> Window:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


FIRST, LAST = (lambda c: F.min_by(c, F.struct("t", "tie"))), (lambda c: F.max_by(c, F.struct("t", "tie")))


def hysteresis(samples: DataFrame, limits: DataFrame, seconds: float) -> DataFrame:
    """state of each sample, as states.hysteresis has it.

    A segment sets the state (the last of its samples beyond one threshold alone) and flips it so often after that, or only flips it.
    """
    up_to_now = within().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above, below = F.col("value") > F.col("upper"), F.col("value") < F.col("lower")
    out = with_segments(samples, seconds).join(limits.select(*KEYS, "baseline_mean", "upper", "lower"), list(KEYS))
    begin = F.when(above, 1).when(below, 0).otherwise((F.col("value") > F.col("baseline_mean")).cast("int"))
    out = out.withColumns({"_begin": begin, "_set": F.when(above & ~below, 1).when(below & ~above, 0), "_flips": F.sum((above & below).cast("int")).over(up_to_now)})
    out = out.withColumns({"_last": F.last("_set", True).over(up_to_now), "_at": F.last(F.when(F.col("_set").isNotNull(), F.col("_flips")), True).over(up_to_now)})
    out = out.withColumn("_after", F.col("_flips") - F.coalesce("_at", F.lit(0))).select(*PLACE, "t", "value", "tie", "_begin", "_last", "_after")
    ends = out.groupBy(*PLACE).agg(FIRST("_begin").alias("_first"), LAST("_last").alias("_leaves"), LAST("_after").alias("_more"))
    ends = ends.withColumn("_sum", F.coalesce(F.sum("_more").over(before()), F.lit(0)))
    first = F.first("_first").over(in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    set_, base = F.last("_leaves", True).over(before()), F.last(F.when(F.col("_leaves").isNotNull(), F.col("_sum")), True).over(before())
    entered = (F.coalesce(set_, first) + F.col("_sum") - F.coalesce(base, F.lit(0))) % 2
    both = out.join(ends.select(*PLACE, entered.alias("_entered")), list(PLACE))
    return both.select(*KEYS, "t", "value", "tie", ((F.coalesce("_last", "_entered") + F.col("_after")) % 2).cast("int").alias("state"))


def movement_fraction(of_states: DataFrame, bin_size: int, seconds: float) -> DataFrame:
    """Bins with fractions, as states.movement_fraction has them; a segment's last state lasts to the first sample of the next one."""
    rows = of_states.select(*KEYS, "t", "tie", "state", F.floor(F.col("t") / seconds).alias("segment"))
    rows = rows.withColumn("_next", F.lead("t").over(within()))
    heads = rows.groupBy(*PLACE).agg(F.min("t").alias("_t")).select(*PLACE, F.lead("_t").over(in_order()).alias("_head"))
    timed = rows.join(heads, list(PLACE)).select(*KEYS, "t", "state", F.coalesce("_next", "_head").alias("next")).where("next is not null")
    return states.fractions_of_spans(timed, bin_size)


def _bordered(rows: DataFrame) -> DataFrame:
    """rows, with _ghost copies in each segment of the samples around it, and _total: the series' samples."""
    alone, sample = Window.partitionBy(*PLACE), F.struct("t", "tie", "value")
    numbered = rows.withColumns({"_i": F.row_number().over(within()), "_n": F.count("*").over(alone)})
    ends = numbered.where(f"_i <= {AFTER} OR _i > _n - {BEFORE}").groupBy(*PLACE).agg(
        F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_i") <= AFTER, sample))).alias("head"), F.array_sort(F.collect_list(F.when(F.col("_i") > F.col("_n") - BEFORE, sample))).alias("tail")
    )
    # Each segment has a sample, so as many segments have as many.
    after = F.slice(F.flatten(F.collect_list("head").over(in_order().rowsBetween(1, AFTER))), 1, AFTER)
    back = F.reverse(F.slice(F.reverse(F.flatten(F.collect_list("tail").over(in_order().rowsBetween(-BEFORE, -1)))), 1, BEFORE))
    around = ends.select(*PLACE, F.sum("_n").over(Window.partitionBy(*KEYS)).alias("_total"), F.concat(back, after).alias("around"))
    ghosts = around.select(*PLACE, "_total", F.explode("around").alias("g")).select(*PLACE, "g.t", "g.tie", "g.value", "_total", F.lit(True).alias("_ghost"))
    out = rows.select(*PLACE, "t", "tie", "value", F.lit(None).cast("long").alias("_total"), F.lit(False).alias("_ghost")).unionByName(ghosts)
    # A segment without ghosts is the whole series.
    return out.withColumn("_total", F.coalesce(F.max("_total").over(alone), F.count("*").over(alone)))


def detect_jumps(samples: DataFrame, seconds: float, factor: float = JUMP_FACTOR) -> DataFrame:
    """run_id, roi, segment, t, value, tie, n, jump, as preprocess.detect_jumps has them; the median of the local deviations is selected exactly by histograms."""
    alone, now = Window.partitionBy(*PLACE), within().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _bordered(with_segments(samples, seconds)).withColumn("diff", F.lead("value").over(within()) - F.col("value"))
    out = out.withColumn("_d", F.col("diff") - F.avg("diff").over(alone))
    sums = F.struct(*(F.coalesce(s.over(now).cast("double"), F.lit(0.0)).alias(k) for k, s in (("n", F.count("_d")), ("a", F.sum("_d")), ("b", F.sum(F.col("_d") * F.col("_d"))))))
    out = out.withColumn("_now", sums).withColumn("_end", F.last("_now").over(within().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    h = F.floor(F.least(F.lit(20), F.floor(F.col("_total") / 5)) / 2)
    on = F.coalesce(*(F.when(h == k, F.coalesce(F.lead("_now", k).over(within()), F.col("_end"))) for k in range(2, 11)))
    back = F.coalesce(*(F.when(h == k, F.lag("_now", k + 1).over(within())) for k in range(2, 11)))
    out = out.withColumns({"_on": on, "_back": back}).where("NOT _ghost")
    m, s1, s2 = (F.col(f"_on.{k}") - F.coalesce(F.col(f"_back.{k}"), F.lit(0.0)) for k in ("n", "a", "b"))
    local = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(s2 - F.try_divide(s1 * s1, m), m)))
    out = stored(out.select(*PLACE, "t", "value", "tie", F.col("_total").alias("n"), "diff", F.when(F.col("diff").isNotNull() & (F.col("_total") >= 25), local).alias("local")))
    typical = percentiles(out, KEYS, "local", {"typical": 0.5})
    jump = F.when(F.abs("diff") > factor * F.col("typical"), F.col("diff")).otherwise(F.lit(0.0))
    return out.join(typical, list(KEYS), "left").select(*PLACE, "t", "value", "tie", "n", F.coalesce(jump, F.lit(0.0)).alias("jump"))


def remove_jumps(samples: DataFrame, seconds: float, factor: float = JUMP_FACTOR) -> DataFrame:
    """Every jump is taken off all later samples: those of earlier segments as one sum."""
    rows = stored(detect_jumps(samples, seconds, factor))
    carried = rows.groupBy(*PLACE).agg(F.sum("jump").alias("_sum")).select(*PLACE, F.coalesce(F.sum("_sum").over(before()), F.lit(0.0)).alias("_carried"))
    own = F.coalesce(F.sum("jump").over(within().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("_own", own).join(carried, list(PLACE)).select(*KEYS, "t", (F.col("value") - F.col("_own") - F.col("_carried")).alias("value"), "tie")


def _trends(samples: DataFrame) -> DataFrame:
    """For each series n, mean, and the least-squares parabola over centred and scaled time: from sums that tasks add up before they are shuffled."""
    m = samples.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg("t").alias("mid"), (F.max("t") - F.min("t")).alias("span"))
    x = F.coalesce(F.try_divide(F.col("t") - F.col("mid"), F.col("span")), F.lit(0.0))
    power = lambda k: F.lit(1.0) if k == 0 else F.pow("_x", F.lit(k))
    sums = samples.join(m, list(KEYS)).withColumn("_x", x).groupBy(*KEYS, "n", "mean", "mid", "span").agg(*(F.sum(power(k)).alias(f"s{k}") for k in range(5)), *(F.sum(power(k) * F.col("value")).alias(f"y{k}") for k in range(3)))
    c = solve3([[F.col(f"s{i + j}") for j in range(3)] for i in range(3)], [F.col(f"y{k}") for k in range(3)])
    fitted = sums.withColumns({f"c{k}": v for k, v in enumerate(c)})
    level = (F.col("c0") * F.col("s0") + F.col("c1") * F.col("s1") + F.col("c2") * F.col("s2")) / F.col("s0")
    return fitted.select(*KEYS, "n", "mean", "mid", "span", "c0", "c1", "c2", level.alias("level"))


def detrend_quadratic(samples: DataFrame, least: int = 0) -> DataFrame:
    """value less its parabola, plus the parabola's mean; series of fewer than least samples stay. samples should be a table, as they are read three times."""
    x = F.coalesce(F.try_divide(F.col("t") - F.col("mid"), F.col("span")), F.lit(0.0))
    trend = F.col("c0") + F.col("c1") * x + F.col("c2") * x * x
    flat = F.when(F.col("n") >= least, F.coalesce(F.col("value") - trend + F.col("level"), F.col("value"))).otherwise(F.col("value"))
    return samples.join(_trends(samples), list(KEYS)).select(*KEYS, "t", flat.alias("value"), "tie")


def remove_drift(samples: DataFrame, means: DataFrame | None = None, percent: float = 1.0, least: int = 0) -> DataFrame:
    """Takes slope times t off series that drift by more than percent of their mean, or of that in means (run_id, roi, mean)."""
    m = samples.groupBy(*KEYS).agg(F.count("*").alias("n"), F.regr_slope("value", "t").alias("slope"), F.avg("value").alias("own"), (F.max("t") - F.min("t")).alias("span"))
    m = m.join(means, list(KEYS)) if means is not None else m.withColumn("mean", F.col("own"))
    drift = F.coalesce(F.when(F.col("mean") > 0, F.abs(F.col("slope") * F.col("span")) / F.col("mean") * 100), F.lit(0.0))
    off = m.select(*KEYS, F.when((F.col("n") >= least) & (drift > percent), F.col("slope")).alias("slope"))
    return samples.join(off, list(KEYS)).select(*KEYS, "t", F.coalesce(F.col("value") - F.col("slope") * F.col("t"), F.col("value")).alias("value"), "tie")


def detrend(samples: DataFrame, seconds: float, jumps: bool = True) -> DataFrame:
    """Jumps, parabola, drift, as preprocess.detrend has them; a series of fewer than 20 samples stays as it is."""
    level = stored(remove_jumps(samples, seconds) if jumps else samples.select(*KEYS, "t", "value", "tie"))
    flat = stored(detrend_quadratic(level, LEAST_SAMPLES))
    return remove_drift(flat, level.groupBy(*KEYS).agg(F.avg("value").alias("mean")), least=LEAST_SAMPLES)


def behaviour(samples: DataFrame, limits: DataFrame, seconds: float, bin_size: int = states.BIN, threshold: float = states.QUIET, sleep_minutes: float = states.SLEEP_MINUTES) -> DataFrame:
    """Bins with fraction, quiescence and sleep. Runs of quiescent bins are found over a series' bins: a row for each, however many samples a bin has."""
    fractions = movement_fraction(hysteresis(samples, limits, seconds), bin_size, seconds)
    return states.sleep(states.quiescence(fractions, threshold), sleep_minutes, bin_size)
