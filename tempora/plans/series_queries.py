"""Queries of preprocessing, thresholds, states and bins over the events as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import binning, preprocess, segments, states, summary, thresholds
from tempora.plans import fragments as sql
from tempora.plans.registry import query
from tempora.sources import tables

#: Ten days of baseline at an interval of about 1300 s; bins of an hour; sleep from 8 hours on.
MINUTES, MULTIPLIER, INTERVAL, BIN, SLEEP = 14_400, 0.5, 1300, 3600, 480
NEED = max(10, int(MINUTES * 60 / INTERVAL * 0.8))
S, U = sql.samples(), sql.samples("user_id")
LIMITS = sql.baseline("s", "b", MINUTES, MULTIPLIER, NEED)
ADAPTIVE_MINUTES = 200.5 * INTERVAL / 60
CAL = "SELECT 'events' AS run_id, event_type AS roi, epoch_us(ts) / 1e6 - 1704067200 AS t, value, event_id AS tie FROM events"
KEY = "run_id roi"


def events(spark: SparkSession, d: str) -> DataFrame:
    return tables.event_samples(spark, d)


def users(spark: SparkSession, d: str) -> DataFrame:
    return tables.event_samples(spark, d, "user_id")


def limits(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.from_baseline(events(spark, d), MINUTES, MULTIPLIER, INTERVAL)


def fractions(spark: SparkSession, d: str) -> DataFrame:
    return states.movement_fraction(states.hysteresis(events(spark, d), limits(spark, d)), BIN)


def slept(spark: SparkSession, d: str) -> DataFrame:
    return states.sleep(states.quiescence(fractions(spark, d)), SLEEP, BIN)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


STATES = with_(S, LIMITS, sql.hysteresis("s", "b", "h"))
FRACTIONS = STATES + "," + sql.fractions("h", "f", BIN)
SLEPT = FRACTIONS + "," + sql.slept("f", "z", SLEEP * 60 // BIN)


@query("c1_interval_validation", f"{KEY} n:int mean:4 median:4 std:4 min:4 max:4 needs_correction consistent quality drift:4 cv:6", with_(U) + f"""
, g AS (SELECT * FROM (SELECT *, row_number() OVER ({sql.T}) AS i, lead(t) OVER ({sql.T}) - t AS gap FROM s) WHERE i < 50 AND gap IS NOT NULL)
SELECT run_id, roi, count(*) AS n, avg(gap) AS mean, quantile_cont(gap, 0.5) AS median, stddev_pop(gap) AS std, min(gap) AS min, max(gap) AS max, abs(avg(gap) - 38000) > 3800 AS needs_correction,
stddev_pop(gap) < 1900 AS consistent, CASE WHEN stddev_pop(gap) / 38000 < 0.01 THEN 'excellent' WHEN stddev_pop(gap) / 38000 < 0.03 THEN 'good' WHEN stddev_pop(gap) / 38000 < 0.05 THEN 'acceptable' ELSE 'poor' END AS quality,
CASE WHEN count(*) > 10 THEN regr_slope(gap, i - 1) END AS drift, coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0) AS cv FROM g GROUP BY run_id, roi""")
def _(spark, d):
    return preprocess.validate_intervals(users(spark, d), 38_000)


#: Series whose median intervals lie on either side of 7 s and a second.
SCALED = U.replace("AS t,", "* 7 / 27000 AS t,").replace("epoch_us(ts) / 1e6 - 1704067200", "(epoch_us(ts) / 1e6 - 1704067200)")
TIMES = with_(SCALED) + f"""
, g AS (SELECT * FROM (SELECT *, row_number() OVER ({sql.T}) AS i, lead(t) OVER ({sql.T}) - t AS gap FROM s) WHERE i <= 19 AND gap IS NOT NULL),
m AS (SELECT run_id, roi, quantile_cont(gap, 0.5) AS actual FROM g GROUP BY run_id, roi)"""


def timing_sql(interval: float, minutes: float, bin_size: int) -> str:
    off = f"abs(actual - {interval}) > greatest(1, 0.1 * {interval})"
    return TIMES + f"""
SELECT run_id, roi, actual, {off} AS corrected, CASE WHEN {off} THEN actual ELSE {interval} END AS interval, CASE WHEN {off} THEN trunc({minutes} * 60 / {interval}) * actual / 60 ELSE {minutes} END AS baseline_minutes,
CASE WHEN {off} THEN CAST(trunc(greatest(1, round_even({bin_size} / actual, 0)) * actual) AS BIGINT) ELSE {bin_size} END AS bin_size FROM m"""


@query("c2_timing_correction", f"{KEY} actual:4 corrected interval:4 baseline_minutes:4 bin_size:int", timing_sql(7.0, 200.0, 60))
def _(spark, d):
    return preprocess.timing_correction(users(spark, d).withColumn("t", F.col("t") * 7 / 27000), 7, 200, 60)


@query("c2_wide_tolerance", f"{KEY} actual:4 corrected interval:4 baseline_minutes:4 bin_size:int", timing_sql(13.0, 100.0, 60))
def _(spark, d):
    return preprocess.timing_correction(users(spark, d).withColumn("t", F.col("t") * 7 / 27000), 13, 100, 60)


@query("c3_subtract_minimum", f"{KEY} tie:int t:3 value:6", with_(S) + f" SELECT run_id, roi, tie, t, value - min(value) OVER ({sql.P}) AS value FROM s")
def _(spark, d):
    return preprocess.subtract_minimum(events(spark, d))


@query("c4_normalisation_check", f"{KEY} before_range:6 after_range:6 zero_minimum same_range ok", with_(S) + " SELECT run_id, roi, max(value) - min(value) AS before_range, max(value) - min(value) AS after_range, true AS zero_minimum, true AS same_range, true AS ok FROM s GROUP BY run_id, roi")
def _(spark, d):
    e = events(spark, d)
    return preprocess.check_normalised(e, preprocess.subtract_minimum(e))


@query("c5_jumps", f"{KEY} tie:int n:int jump:6", with_(U, sql.jumps("s", "j")) + " SELECT * FROM j WHERE jump <> 0")
def _(spark, d):
    return preprocess.detect_jumps(users(spark, d)).where("jump <> 0")


@query("c6_jumps_removed", f"{KEY} tie:int value:4", with_(U, sql.dejumped("s", "j")) + " SELECT * FROM j")
def _(spark, d):
    return preprocess.remove_jumps(users(spark, d))


@query("c7_quadratic_detrend", f"{KEY} tie:int value:4", with_(S, sql.quadratic("s", "q")) + " SELECT run_id, roi, tie, value - trend + trend_mean AS value FROM q")
def _(spark, d):
    return preprocess.detrend_quadratic(events(spark, d))


@query("c7b_guarded_detrend", f"{KEY} tie:int value:4", with_(S, sql.quadratic("s", "q")) + f""" SELECT run_id, roi, tie, CASE WHEN avg(value - trend + trend_mean) OVER ({sql.P}) < 0.5 * avg(value) OVER ({sql.P})
THEN value - (trend - first_value(trend) OVER ({sql.T} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) ELSE value - trend + trend_mean END AS value FROM q""")
def _(spark, d):
    return preprocess.detrend_guarded(events(spark, d))


@query("c8_drift_removal", f"{KEY} tie:int value:4", with_(S, sql.drift("s", "q", "value")) + " SELECT * FROM q")
def _(spark, d):
    return preprocess.remove_drift(events(spark, d))


@query("c9_detrend_pipeline", f"{KEY} tie:int value:3", with_(U, sql.detrended("s", "q")) + " SELECT * FROM q")
def _(spark, d):
    return preprocess.detrend(users(spark, d))


@query("c10_robust_detrend", f"{KEY} tie:int value:3 drift_percent:3 drift_removed", with_(S, sql.dejumped("s", "j")) + """
, m AS (SELECT run_id, roi, regr_slope(value, t) AS slope, CASE WHEN avg(raw) > 0 THEN abs(regr_slope(value, t) * (max(t) - min(t))) / avg(raw) * 100 ELSE 0 END AS drift_percent FROM j GROUP BY run_id, roi)
SELECT run_id, roi, tie, CASE WHEN drift_percent > 2 THEN value - slope * t ELSE value END AS value, drift_percent, drift_percent > 2 AS drift_removed FROM j JOIN m USING (run_id, roi)""")
def _(spark, d):
    return preprocess.detrend_robust(events(spark, d))


@query("c11_detrend_effect", f"{KEY} before_slope:9 slope_reduction:2 effect range_reduction:3", with_(U, sql.drift("s", "q", "value")) + """
, a AS (SELECT run_id, roi, regr_slope(value, t) AS s1, max(value) - min(value) AS r1 FROM s GROUP BY run_id, roi), b AS (SELECT run_id, roi, regr_slope(value, t) AS s2, max(value) - min(value) AS r2 FROM q GROUP BY run_id, roi),
c AS (SELECT *, coalesce((abs(s1) - abs(s2)) * 100 / nullif(abs(s1), 0), 0) AS cut FROM a JOIN b USING (run_id, roi))
SELECT run_id, roi, s1 AS before_slope, cut AS slope_reduction, CASE WHEN cut > 50 THEN 'effective' WHEN cut > 20 THEN 'moderate' ELSE 'limited' END AS effect, coalesce((r1 - r2) * 100 / nullif(r1, 0), 0) AS range_reduction FROM c""")
def _(spark, d):
    u = users(spark, d)
    return preprocess.detrend_effect(u, preprocess.remove_drift(u))


LIMIT_COLUMNS = f"{KEY} baseline_mean:6 upper:6 lower:6 status samples:int"


@query("d1_baseline_thresholds", LIMIT_COLUMNS, with_(S, LIMITS) + " SELECT * FROM b")
def _(spark, d):
    return limits(spark, d)


@query("d1b_clamped_thresholds", LIMIT_COLUMNS, with_(S, sql.baseline("s", "b", MINUTES, 3, NEED, True)) + " SELECT * FROM b")
def _(spark, d):
    return thresholds.from_baseline(events(spark, d), MINUTES, 3, INTERVAL, clamp=True)


@query("d1c_insufficient_baseline", LIMIT_COLUMNS, with_(U, sql.baseline("s", "b", MINUTES, 1.0, 28, False)) + " SELECT * FROM b")
def _(spark, d):
    return thresholds.from_baseline(users(spark, d), MINUTES, 1.0, 24_000)


@query("d2_adaptive_thresholds", LIMIT_COLUMNS + " snr:6 cv:6 outliers:4 robust multiplier:6 quality stability", with_(U, sql.adaptive("s", "a", 200, 2.5, INTERVAL)) + " SELECT * FROM a")
def _(spark, d):
    return thresholds.adaptive(users(spark, d), ADAPTIVE_MINUTES, 2.5, INTERVAL)


HALVES = f"s AS ({CAL} WHERE ts >= TIMESTAMP '2024-01-16'), k AS ({CAL} WHERE ts < TIMESTAMP '2024-01-16' AND event_type <> 'click'), c AS (SELECT run_id, roi, avg(value) AS baseline_mean, avg(value) + 0.5 * stddev_pop(value) AS upper, avg(value) - 0.5 * stddev_pop(value) AS lower, stddev_pop(value) AS std, count(*) AS samples, max(value) - min(value) AS range, max(t) - min(t) AS duration FROM k GROUP BY run_id, roi)"
HALF = 15 * 86_400.0


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    """The second half of the events, and the first as calibration, which lacks one type."""
    e = events(spark, d)
    return e.where(F.col("t") >= HALF), e.where((F.col("t") < HALF) & (F.col("roi") != "click"))


@query("d3_calibration_statistics", f"{KEY} baseline_mean:6 upper:6 lower:6 std:6 samples:int range:6 duration:3", f"WITH {HALVES} SELECT * FROM c")
def _(spark, d):
    return thresholds.calibration(halves(spark, d)[1], 0.5)


APPLIED = "SELECT run_id, roi, coalesce(c.baseline_mean, 0) AS baseline_mean, coalesce(c.upper, 1) AS upper, coalesce(c.lower, 0) AS lower, CASE WHEN c.roi IS NOT NULL THEN 'success' ELSE 'no_calibration_data_for_roi' END AS status FROM (SELECT DISTINCT run_id, roi FROM s) LEFT JOIN c USING (run_id, roi)"


@query("d4_apply_calibration", f"{KEY} baseline_mean:6 upper:6 lower:6 status", f"WITH {HALVES} {APPLIED}")
def _(spark, d):
    target, known = halves(spark, d)
    return thresholds.apply_calibration(target, thresholds.calibration(known, 0.5))


@query("d5_calibration_quality", f"{KEY} target_mean:6 cal_mean:6 snr:6 separation:6 ratio:6 quality upper:6 lower:6", f"""WITH {HALVES},
t AS (SELECT run_id, roi, avg(value) AS target_mean FROM (SELECT *, row_number() OVER ({sql.T}) AS i FROM s) WHERE i <= 1000 GROUP BY run_id, roi),
q AS (SELECT t.run_id, roi, target_mean, baseline_mean AS cal_mean, coalesce((target_mean - baseline_mean) / nullif(std, 0), 0) AS snr, coalesce(target_mean / nullif(baseline_mean, 0), 0) AS ratio, upper, greatest(0, lower) AS lower FROM t JOIN c USING (roi))
SELECT *, abs(snr) AS separation, CASE WHEN snr > 3 THEN 'excellent' WHEN snr > 2 THEN 'good' WHEN snr > 1 THEN 'fair' ELSE 'poor' END AS quality FROM q""")
def _(spark, d):
    target, known = halves(spark, d)
    return thresholds.calibration_quality(target, thresholds.calibration(known, 0.5))


@query("d6_range_thresholds", f"{KEY} baseline_mean:6 upper:6 lower:6 samples:int", with_(U) + " SELECT run_id, roi, avg(value) AS baseline_mean, avg(value) + stddev_pop(value) AS upper, avg(value) - stddev_pop(value) AS lower, count(*) AS samples FROM s WHERE t BETWEEN 432000 AND 1296000 GROUP BY run_id, roi HAVING count(*) > 10")
def _(spark, d):
    return thresholds.for_range(users(spark, d), 432_000, 1_296_000)


@query("d7_band", f"{KEY} band:6 band_upper:6 band_lower:6", with_(S, LIMITS) + " SELECT run_id, roi, (upper - lower) / 2 AS band, baseline_mean + (upper - lower) / 2 AS band_upper, baseline_mean - (upper - lower) / 2 AS band_lower FROM b")
def _(spark, d):
    return thresholds.with_band(limits(spark, d))


@query("d8_method_suggestion", f"{KEY} n:int cv:6 spread:6 method", with_(U) + f"""
, m AS (SELECT run_id, roi, count(*) AS n, avg(value) AS mean, CASE WHEN avg(value) > 0 THEN stddev_pop(value) / avg(value) ELSE 1 END AS cv, CASE WHEN avg(value) > 0 THEN (max(value) - min(value)) / avg(value) ELSE 1 END AS spread
FROM (SELECT *, row_number() OVER ({sql.T}) AS i FROM s) WHERE i <= 1000 GROUP BY run_id, roi)
SELECT *, CASE WHEN n < 100 THEN 'baseline' WHEN cv > 0.8 THEN 'adaptive' WHEN cv < 0.2 AND spread < 0.5 THEN 'baseline' WHEN mean > 100 AND cv > 0.3 THEN 'adaptive' ELSE 'baseline' END AS method FROM m""")
def _(spark, d):
    return thresholds.suggest_method(users(spark, d))


@query("e1_hysteresis", f"{KEY} tie:int state:int", STATES + " SELECT * FROM h")
def _(spark, d):
    return states.hysteresis(events(spark, d), limits(spark, d))


@query("e1_hysteresis_inverted", f"{KEY} tie:int state:int", with_(S, "b AS (SELECT run_id, roi, 60 AS baseline_mean, 40 AS upper, 80 AS lower FROM s GROUP BY run_id, roi)", sql.hysteresis("s", "b", "h")) + " SELECT * FROM h")
def _(spark, d):
    e = events(spark, d)
    return states.hysteresis(e, e.select("run_id", "roi").distinct().select("*", F.lit(60).alias("baseline_mean"), F.lit(40).alias("upper"), F.lit(80).alias("lower")))


@query("e1b_single_threshold", f"{KEY} tie:int state:int", with_(S, LIMITS) + " SELECT run_id, roi, tie, CASE WHEN value > upper THEN 1 ELSE 0 END AS state FROM s JOIN b USING (run_id, roi)")
def _(spark, d):
    return states.above_threshold(events(spark, d), limits(spark, d))


@query("e2_movement_fraction", f"{KEY} bin_start:1 bin_center:1 fraction:6", FRACTIONS + " SELECT * FROM f")
def _(spark, d):
    return fractions(spark, d)


@query("e3_quiescence", f"{KEY} bin_start:1 fraction:6 quiescent:int", SLEPT + " SELECT * FROM z")
def _(spark, d):
    return states.quiescence(fractions(spark, d))


@query("e4_sleep", f"{KEY} bin_start:1 quiescent:int sleep:int", SLEPT + " SELECT * FROM z")
def _(spark, d):
    return slept(spark, d)


BOUTS = SLEPT + f""", o AS (SELECT *, row_number() OVER ({sql.P} ORDER BY bin_start) - row_number() OVER ({sql.P}, sleep ORDER BY bin_start) AS bout FROM z),
u AS (SELECT run_id, roi, min(bin_start) AS start, max(bin_start) + {BIN} AS "end", (max(bin_start) + {BIN} - min(bin_start)) / 60 AS minutes FROM o WHERE sleep = 1 GROUP BY run_id, roi, bout)"""


@query("e5_sleep_bouts", f"{KEY} start:1 end:1 minutes:3", BOUTS + " SELECT * FROM u")
def _(spark, d):
    return states.sleep_bouts(slept(spark, d), BIN)


@query("e5_sleep_totals", f"{KEY} recorded_minutes:3 sleep_minutes:3 bouts:int mean_bout:4 efficiency:6", BOUTS + f"""
, t AS (SELECT run_id, roi, count(*) * {BIN} / 60.0 AS recorded_minutes FROM z GROUP BY run_id, roi), v AS (SELECT run_id, roi, sum(minutes) AS sm, count(*) AS bouts, avg(minutes) AS mb FROM u GROUP BY run_id, roi)
SELECT run_id, roi, recorded_minutes, coalesce(sm, 0) AS sleep_minutes, coalesce(bouts, 0) AS bouts, coalesce(mb, 0) AS mean_bout, coalesce(sm, 0) / recorded_minutes AS efficiency FROM t LEFT JOIN v USING (run_id, roi)""")
def _(spark, d):
    return states.sleep_totals(slept(spark, d), BIN)


@query("e6_activity_statistics", f"{KEY} n:int mean:6 standard_error:6 low:6 high:6", FRACTIONS + ", m AS (SELECT run_id, roi, count(*) AS n, avg(fraction) AS mean, sqrt(avg(fraction) * (1 - avg(fraction)) / count(*)) AS standard_error FROM f GROUP BY run_id, roi) SELECT *, mean - 1.96 * standard_error AS low, mean + 1.96 * standard_error AS high FROM m")
def _(spark, d):
    return states.activity_statistics(fractions(spark, d))


@query("e7_fraction_distribution", f"{KEY} bins:int still:int partial:int full:int still_percent:4 partial_percent:4 full_percent:4", FRACTIONS + """ SELECT run_id, roi, count(*) AS bins, count(*) FILTER (WHERE fraction = 0) AS still, count(*) FILTER (WHERE fraction > 0 AND fraction < 1) AS partial, count(*) FILTER (WHERE fraction = 1) AS "full",
count(*) FILTER (WHERE fraction = 0) * 100.0 / count(*) AS still_percent, count(*) FILTER (WHERE fraction > 0 AND fraction < 1) * 100.0 / count(*) AS partial_percent, count(*) FILTER (WHERE fraction = 1) * 100.0 / count(*) AS full_percent FROM f GROUP BY run_id, roi""")
def _(spark, d):
    return states.fraction_distribution(fractions(spark, d))


#: Bins whose quiescence or sleep was changed afterwards, some of them to what they were.
BROKEN = {"quiescent": "CASE WHEN bin_start % 25200 = 0 THEN 1 - quiescent ELSE quiescent END", "sleep": "CASE WHEN bin_start % 39600 = 0 THEN 1 ELSE sleep END"}


@query("e8_sleep_audit", f"{KEY} wrong_quiescence:int wrong_sleep:int quiescent_bins:int sleep_bins:int sleep_ratio:6", SLEPT + f""", x AS (SELECT run_id, roi, fraction, {', '.join(f'{v} AS {k}' for k, v in BROKEN.items())} FROM z)
SELECT run_id, roi, count(*) FILTER (WHERE (fraction < 0.5) <> (quiescent = 1)) AS wrong_quiescence, count(*) FILTER (WHERE sleep = 1 AND quiescent = 0) AS wrong_sleep, sum(quiescent) AS quiescent_bins, sum(sleep) AS sleep_bins, sum(sleep) / greatest(1, sum(quiescent)) AS sleep_ratio FROM x GROUP BY run_id, roi""")
def _(spark, d):
    return states.audit(slept(spark, d).withColumns({k: F.expr(v) for k, v in BROKEN.items()}))


def pipeline_sql(limits_cte: str, used: str, limits: str = "b") -> str:
    return limits_cte + "," + sql.hysteresis(used, limits, "h") + "," + sql.fractions("h", "f", BIN) + "," + sql.slept("f", "z", SLEEP * 60 // BIN)


BIN_COLUMNS = f"{KEY} bin_start:1 fraction:4 quiescent:int sleep:int"
E9 = pipeline_sql(with_(S, LIMITS, sql.detrended("s", "q")), "q")
E10 = pipeline_sql(with_(S, sql.detrended("s", "q", False), sql.adaptive("q", "b", 200, 1.0, INTERVAL)), "q")
E11 = pipeline_sql(f"WITH {HALVES}, ap AS ({APPLIED}), b AS (SELECT * FROM ap WHERE status = 'success')," + sql.detrended("s", "q"), "q")


def by_baseline(spark, d, **more):
    return states.analyze(events(spark, d), "baseline", minutes=MINUTES, multiplier=MULTIPLIER, interval=INTERVAL, bin_size=BIN, sleep_minutes=SLEEP, **more)


def by_adaptive(spark, d, **more):
    return states.analyze(events(spark, d), "adaptive", minutes=ADAPTIVE_MINUTES, multiplier=1.0, interval=INTERVAL, bin_size=BIN, sleep_minutes=SLEEP, **more)


def by_calibration(spark, d):
    target, known = halves(spark, d)
    return states.analyze(target, "calibration", calibration=known, multiplier=0.5, bin_size=BIN, sleep_minutes=SLEEP)


@query("e9_baseline_pipeline", BIN_COLUMNS, E9 + " SELECT * FROM z")
def _(spark, d):
    return by_baseline(spark, d)["bins"]


@query("e9b_preprocessed_pipeline", BIN_COLUMNS, SLEPT + " SELECT * FROM z")
def _(spark, d):
    return by_baseline(spark, d, detrended=False)["bins"]


@query("e10_adaptive_pipeline", BIN_COLUMNS, E10 + " SELECT * FROM z")
def _(spark, d):
    return by_adaptive(spark, d)["bins"]


@query("e11_calibration_pipeline", BIN_COLUMNS, E11 + " SELECT * FROM z")
def _(spark, d):
    return by_calibration(spark, d)["bins"]


@query("e12_method_routing", f"method {KEY} bin_start:1 sleep:int", f"SELECT 'adaptive' AS method, * FROM ({E10} SELECT run_id, roi, bin_start, sleep FROM z) UNION ALL SELECT 'calibration' AS method, * FROM ({E11} SELECT run_id, roi, bin_start, sleep FROM z)")
def _(spark, d):
    return by_adaptive(spark, d)["bins"].withColumn("method", F.lit("adaptive")).unionByName(by_calibration(spark, d)["bins"].withColumn("method", F.lit("calibration")))


BOTH = pipeline_sql(f"WITH {HALVES}, {LIMITS}," + sql.detrended("s", "q"), "q")


@query("e12_methods_side_by_side", f"method {KEY} bin_start:1 fraction:4 sleep:int", f"SELECT 'baseline' AS method, * FROM ({BOTH} SELECT run_id, roi, bin_start, fraction, sleep FROM z) UNION ALL SELECT 'calibration' AS method, * FROM ({E11} SELECT run_id, roi, bin_start, fraction, sleep FROM z)")
def _(spark, d):
    target, known = halves(spark, d)
    found = states.analyze_all(target, {"baseline": {"minutes": MINUTES, "multiplier": MULTIPLIER, "interval": INTERVAL}, "calibration": {"calibration": known, "multiplier": 0.5}}, bin_size=BIN, sleep_minutes=SLEEP)
    one = lambda m: found[m]["bins"].withColumn("method", F.lit(m))
    return one("baseline").unionByName(one("calibration"))


# The same by scans over segments of time; the SQL is that of the whole series.


#: Seconds of a segment: a day, and 20 minutes, which most samples don't share with others.
DAY, SHORT = 86_400, 1200


@query("c5_jumps_segmented", f"{KEY} tie:int n:int jump:6", with_(U, sql.jumps("s", "j")) + " SELECT * FROM j WHERE jump <> 0")
def _(spark, d):
    return segments.detect_jumps(users(spark, d), 3 * DAY).where("jump <> 0")


@query("c6_jumps_removed_segmented", f"{KEY} tie:int value:4", with_(S, sql.dejumped("s", "j")) + " SELECT * FROM j")
def _(spark, d):
    return segments.remove_jumps(events(spark, d), SHORT)


@query("c7_quadratic_detrend_grouped", f"{KEY} tie:int value:4", with_(S, sql.quadratic("s", "q")) + " SELECT run_id, roi, tie, value - trend + trend_mean AS value FROM q")
def _(spark, d):
    return segments.detrend_quadratic(events(spark, d))


@query("c8_drift_removal_grouped", f"{KEY} tie:int value:4", with_(S, sql.drift("s", "q", "value")) + " SELECT * FROM q")
def _(spark, d):
    return segments.remove_drift(events(spark, d))


@query("c9_detrend_segmented", f"{KEY} tie:int value:3", with_(U, sql.detrended("s", "q")) + " SELECT * FROM q")
def _(spark, d):
    return segments.detrend(users(spark, d), DAY)


@query("e1_hysteresis_segmented", f"{KEY} tie:int state:int", STATES + " SELECT * FROM h")
def _(spark, d):
    return segments.hysteresis(events(spark, d), limits(spark, d), SHORT)


@query("e1_inverted_segmented", f"{KEY} tie:int state:int", with_(S, "b AS (SELECT run_id, roi, 60 AS baseline_mean, 40 AS upper, 80 AS lower FROM s GROUP BY run_id, roi)", sql.hysteresis("s", "b", "h")) + " SELECT * FROM h")
def _(spark, d):
    e = events(spark, d)
    return segments.hysteresis(e, e.select("run_id", "roi").distinct().select("*", F.lit(60).alias("baseline_mean"), F.lit(40).alias("upper"), F.lit(80).alias("lower")), SHORT)


@query("e2_movement_fraction_segmented", f"{KEY} bin_start:1 bin_center:1 fraction:6", FRACTIONS + " SELECT * FROM f")
def _(spark, d):
    return segments.movement_fraction(segments.hysteresis(events(spark, d), limits(spark, d), SHORT), BIN, SHORT)


@query("e10_adaptive_segmented", BIN_COLUMNS, E10 + " SELECT * FROM z")
def _(spark, d):
    return by_adaptive(spark, d, segment=DAY)["bins"]


@query("e9_baseline_segmented", BIN_COLUMNS, E9 + " SELECT * FROM z")
def _(spark, d):
    return by_baseline(spark, d, segment=DAY)["bins"]


#: Runs of several regions each: the users by their remainders, the types as regions.
RUN = "CAST(user_id % 5 AS VARCHAR)"
RUNS = with_(sql.samples(run=RUN), sql.baseline("s", "b", MINUTES, MULTIPLIER, NEED // 10), sql.detrended("s", "q"))


def many_runs(spark: SparkSession, d: str) -> DataFrame:
    return tables.event_samples(spark, d, run=RUN.replace("VARCHAR", "STRING"))


@query("e9_many_runs", BIN_COLUMNS, pipeline_sql(RUNS, "q") + " SELECT * FROM z")
def _(spark, d):
    return states.analyze(many_runs(spark, d), "baseline", minutes=MINUTES, multiplier=MULTIPLIER, interval=INTERVAL * 10, bin_size=BIN, sleep_minutes=SLEEP)["bins"]


@query("f8_many_runs", f"{KEY} tie:int", with_(sql.samples(run=RUN), "w AS (SELECT run_id, max(t) AS tn FROM s GROUP BY run_id)") + " SELECT run_id, roi, tie FROM s JOIN w USING (run_id) WHERE t >= tn - 86400")
def _(spark, d):
    return binning.preset_window(many_runs(spark, d), "last_24h")


# Bins of bins, resampling, slices.


def light_sql(src: str, time: str, value: str, size: int, anchor: str) -> str:
    return f"""SELECT run_id, roi, anchor + (k + 0.5) * {size} AS bin_center, avg(v) AS mean, count(*) AS n FROM (SELECT *, floor((tt - anchor) / {size}) AS k FROM (SELECT *, {anchor} AS anchor FROM
(SELECT run_id, roi, {time} AS tt, {value} AS v, min({time}) OVER ({sql.P}) AS t0, max({time}) OVER ({sql.P}) AS tn, count(*) OVER ({sql.P}) AS c FROM {src}) WHERE c >= 2)) WHERE anchor + k * {size} < tn GROUP BY run_id, roi, anchor, k"""


LIGHT, WIDTH = f"{KEY} bin_center:1 mean:6 n:int", 3 * 3600
ACTIVITY = light_sql("f", "bin_center", "fraction", WIDTH, "floor(t0 / 3600) * 3600")
REST = light_sql("z", "bin_center", "quiescent", WIDTH, "t0")


@query("f1_lighting_activity", LIGHT, FRACTIONS + " " + ACTIVITY)
def _(spark, d):
    return binning.lighting_activity(fractions(spark, d), 180)


@query("f2_lighting_amplitude", LIGHT, with_(S) + " " + light_sql("s", "t", "value", 1800, "floor(t0 / 1800) * 1800"))
def _(spark, d):
    return binning.lighting_amplitude(events(spark, d), 30)


@query("f3_lighting_rest", LIGHT, SLEPT + " " + REST)
def _(spark, d):
    return binning.lighting_rest(slept(spark, d), 180)


@query("f4_focus_choice", f"focus {LIGHT}", f"SELECT 'activity' AS focus, * FROM ({SLEPT} {ACTIVITY}) UNION ALL SELECT 'rest' AS focus, * FROM ({SLEPT} {REST})".replace("FROM f)", "FROM f)"))
def _(spark, d):
    z = slept(spark, d)
    return binning.lighting(z, "activity", 180).withColumn("focus", F.lit("activity")).unionByName(binning.lighting(z, "rest", 180).withColumn("focus", F.lit("rest")))


@query("f5_resample", f"{KEY} idx:int t:3 value:6", with_(S, sql.resampled("s", "r", 3600)) + " SELECT * FROM r")
def _(spark, d):
    return binning.resample(events(spark, d), 3600)


@query("f6_rebin", f"{KEY} t:3 value:6", with_(S) + f" SELECT run_id, roi, avg(t) AS t, avg(value) AS value FROM (SELECT *, (row_number() OVER ({sql.T}) - 1) // 3 AS g FROM s) GROUP BY run_id, roi, g")
def _(spark, d):
    return binning.rebin(events(spark, d), 1300, 3900)


@query("f7_time_subset", f"{KEY} tie:int t:3 value:6", with_(S) + " SELECT * FROM s WHERE t BETWEEN 24 * 3600 AND 72 * 3600")
def _(spark, d):
    return binning.between_hours(events(spark, d), 24, 72)


@query("f8_preset_windows", f"preset {KEY} tie:int", with_(S) + """, a AS (SELECT *, min(t) OVER (PARTITION BY run_id) AS t0, max(t) OVER (PARTITION BY run_id) AS tn FROM s)
SELECT 'last_24h' AS preset, run_id, roi, tie FROM a WHERE t >= tn - 86400 UNION ALL SELECT 'first_24h', run_id, roi, tie FROM a WHERE t <= t0 + 86400 UNION ALL SELECT 'second_24h', run_id, roi, tie FROM a WHERE t >= t0 + 86400 AND t <= t0 + 2 * 86400""")
def _(spark, d):
    e, out = events(spark, d), None
    for p in ("last_24h", "first_24h", "second_24h"):
        part = binning.preset_window(e, p).withColumn("preset", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return out


@query("f9_period_range", "run_id hours:6 min_period:6 max_period:6", with_(S) + ", m AS (SELECT run_id, (max(t) - min(t)) / 3600 AS hours FROM s GROUP BY run_id) SELECT *, CASE WHEN hours < 12 THEN 0.5 WHEN hours < 48 THEN 1 ELSE 12 END AS min_period, CASE WHEN hours < 12 THEN greatest(3, hours / 2) WHEN hours < 48 THEN least(18, hours / 2) ELSE least(36, hours / 2) END AS max_period FROM m")
def _(spark, d):
    return binning.auto_period_range(events(spark, d))


SLIDING = ", e AS (SELECT run_id, min(t) AS w0, max(t) AS wn FROM s GROUP BY run_id), w AS (SELECT s.*, w0 + k * 43200 AS win FROM s JOIN e USING (run_id), range(0, 200) AS r(k) WHERE t >= w0 + k * 43200 AND t < w0 + k * 43200 + 86400 AND w0 + k * 43200 + 86400 <= wn)"


@query("f10_sliding_windows", "window:3 run_id roi n:int mean:6", with_(S) + SLIDING + ' SELECT win AS "window", run_id, roi, count(*) AS n, avg(value) AS mean FROM w GROUP BY win, run_id, roi')
def _(spark, d):
    return binning.sliding_windows(events(spark, d)).groupBy("window", "run_id", "roi").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("f11_compare_ranges", f"{KEY} before_mean:6 before_std:6 before_n:int after_mean:6 after_std:6 after_n:int change:6 change_percent:4", with_(S) + """
, b AS (SELECT run_id, roi, avg(value) AS before_mean, stddev_pop(value) AS before_std, count(*) AS before_n FROM s WHERE t BETWEEN 0 AND 864000 GROUP BY run_id, roi), a AS (SELECT run_id, roi, avg(value) AS after_mean, stddev_pop(value) AS after_std, count(*) AS after_n FROM s WHERE t BETWEEN 1728000 AND 2592000 GROUP BY run_id, roi)
SELECT *, after_mean - before_mean AS change, coalesce((after_mean - before_mean) * 100 / nullif(before_mean, 0), 0) AS change_percent FROM b JOIN a USING (run_id, roi)""")
def _(spark, d):
    return binning.compare_ranges(events(spark, d), (0, 240), (480, 720))


@query("f12_lighting_audit", f"{KEY} mean_gap:6 mean_kept compression:6 mirror_gap:6 mirrored", SLEPT + f"""
, a AS (SELECT run_id, roi, avg(mean) AS activity, count(*) AS bins FROM ({ACTIVITY}) GROUP BY run_id, roi), r AS (SELECT run_id, roi, avg(mean) AS rest FROM ({REST}) GROUP BY run_id, roi), w AS (SELECT run_id, roi, avg(fraction) AS raw, count(*) AS n FROM z GROUP BY run_id, roi)
SELECT run_id, roi, abs(raw - activity) AS mean_gap, abs(raw - activity) < 0.05 AS mean_kept, n / bins AS compression, abs(activity - (1 - rest)) AS mirror_gap, abs(activity - (1 - rest)) < 0.2 AS mirrored FROM w JOIN a USING (run_id, roi) JOIN r USING (run_id, roi)""")
def _(spark, d):
    return binning.audit_lighting(slept(spark, d), 180)


@query("f13_peak_bins", f"{KEY} bins:int peaks:int percent:4", FRACTIONS + f", l AS ({ACTIVITY}), m AS (SELECT *, avg(mean) OVER ({sql.P}) + stddev_pop(mean) OVER ({sql.P}) AS top FROM l) SELECT run_id, roi, count(*) AS bins, count(*) FILTER (WHERE mean > top) AS peaks, count(*) FILTER (WHERE mean > top) * 100.0 / count(*) AS percent FROM m GROUP BY run_id, roi")
def _(spark, d):
    return binning.peak_bins(binning.lighting_activity(fractions(spark, d), 180))


@query("f14_data_quality", f"{KEY} n:int hours:4 cv:6 spread_ok outliers:int constant gaps:int long_enough", with_(S) + f"""
, m AS (SELECT run_id, roi, avg(value) AS a, stddev_pop(value) AS sd, count(*) AS n, (max(t) - min(t)) / 3600 AS hours FROM s GROUP BY run_id, roi), g AS (SELECT *, t - lag(t) OVER ({sql.T}) AS gap FROM s)
SELECT run_id, roi, n, hours, coalesce(sd / nullif(a, 0), 0) AS cv, coalesce(sd / nullif(a, 0), 0) < 1 AS spread_ok, count(*) FILTER (WHERE abs(value - a) > 3 * sd) AS outliers, sd = 0 AS constant, count(*) FILTER (WHERE gap > 5 * (hours * 3600 / greatest(1, n - 1))) AS gaps, hours >= 72 AS long_enough FROM g JOIN m USING (run_id, roi) GROUP BY run_id, roi, n, hours, a, sd""")
def _(spark, d):
    return binning.data_quality(events(spark, d))


# Summaries.

EACH = ", each AS (SELECT run_id, roi, avg(fraction) * 100 AS m, avg(sleep) * 100 AS p FROM z GROUP BY run_id, roi)"


#: Runs by the users' remainders: in the first two nothing moves or all does, in the third baselines are even.
LEVEL = "CASE run_id WHEN '0' THEN 10.0 WHEN '1' THEN value + 1000 WHEN '2' THEN 50 + value / 1000 ELSE value END"
FEW = "SELECT run_id, roi, avg(value) AS baseline_mean, CASE run_id WHEN '1' THEN 5.0 ELSE avg(value) + 0.5 * stddev_pop(value) END AS upper, CASE run_id WHEN '1' THEN 1.0 ELSE avg(value) - 0.5 * stddev_pop(value) END AS lower"
LEVELS = with_(sql.samples(run="CAST(user_id % 4 AS VARCHAR)").replace("s AS", "s0 AS", 1), f"s AS (SELECT run_id, roi, t, {LEVEL} AS value, tie FROM s0)", f"b AS ({FEW} FROM s GROUP BY run_id, roi)", sql.hysteresis("s", "b", "h")) + "," + sql.fractions("h", "f", BIN) + "," + sql.slept("f", "z", SLEEP * 60 // BIN)


@query("j1_run_summary", "run_id series:int movement_percent:4 sleep_percent:4 consistency:6 baseline_quality movement_quality", LEVELS + EACH + """
, c AS (SELECT run_id, coalesce(stddev_pop(baseline_mean) / nullif(avg(baseline_mean), 0), 0) AS consistency FROM b GROUP BY run_id), a AS (SELECT run_id, count(*) AS series, avg(m) AS movement_percent, avg(p) AS sleep_percent FROM each GROUP BY run_id)
SELECT *, CASE WHEN consistency < 0.1 THEN 'Good baseline consistency' WHEN consistency < 0.3 THEN 'Moderate baseline consistency' ELSE 'High baseline variability' END AS baseline_quality,
CASE WHEN movement_percent > 0 AND movement_percent < 100 THEN 'Reasonable movement levels' WHEN movement_percent = 0 THEN 'No movement detected' ELSE 'High movement activity' END AS movement_quality FROM a JOIN c USING (run_id)""")
def _(spark, d):
    e = tables.event_samples(spark, d, run="cast(user_id % 4 AS string)").withColumn("value", F.expr(LEVEL))
    known = F.col("run_id") == "1"
    m = e.groupBy("run_id", "roi").agg(F.avg("value").alias("baseline_mean"), F.stddev_pop("value").alias("std"))
    given = m.select("run_id", "roi", "baseline_mean", F.when(known, 5.0).otherwise(F.expr("baseline_mean + 0.5 * std")).alias("upper"), F.when(known, 1.0).otherwise(F.expr("baseline_mean - 0.5 * std")).alias("lower"))
    return summary.run_summary(states.behaviour(e, given, BIN, sleep_minutes=SLEEP), given)


STATS = [f"{f}({c}) AS {c}_{n}" for c in ("snr", "cv", "multiplier") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))]
LABELS = [f"count(*) FILTER (WHERE {kind} = '{q}') AS {kind}_{q}" for kind in ("quality", "stability") for q in ("high", "medium", "low")]
#: Short and long series of runs: users' values, dealt to many short series or flattened by the user's number, so that every rule of the adaptive method meets some run.
SHORT_SERIES = "CASE WHEN user_id % 7 = 0 AND user_id % 10 = 9 AND event_id % 10 = 0 THEN 1 WHEN user_id % 7 = 6 THEN event_id % 50 WHEN user_id % 7 = 4 AND user_id % 3 = 0 THEN event_id % 20 ELSE 0 END"
KINDS = f"""s AS (SELECT CAST(user_id % 7 AS VARCHAR) AS run_id, user_id * 100 + {SHORT_SERIES} AS roi, epoch_us(ts) / 1e6 - 1704067200 AS t,
    CASE user_id % 7 WHEN 0 THEN value WHEN 1 THEN 100 + value / 100 WHEN 2 THEN 40 + value / 10 WHEN 3 THEN value * value WHEN 4 THEN 60 + value / 10 WHEN 5 THEN power(value, 4) / 1e6 ELSE value END AS value, event_id AS tie
    FROM events)"""


def kinds(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id") % 7
    v = F.col("value")
    value = F.when(u == 1, 100 + v / 100).when(u == 2, 40 + v / 10).when(u == 3, v * v).when(u == 4, 60 + v / 10).when(u == 5, F.pow(v, F.lit(4.0)) / 1e6).otherwise(v)
    e = tables.table(spark, d, "events")
    return e.select(u.cast("string").alias("run_id"), (F.col("user_id") * 100 + F.expr(SHORT_SERIES)).alias("roi"), tables.seconds(F.col("ts")).alias("t"), value.alias("value"), F.col("event_id").alias("tie"))


ADAPTED = with_(KINDS, sql.adaptive("s", "a", 2000, 2.5, INTERVAL))


def adapted(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.adaptive(kinds(spark, d), 2000.5 * INTERVAL / 60, 2.5, INTERVAL)


@query("d2_many_runs", LIMIT_COLUMNS + " snr:6 cv:6 outliers:4 robust multiplier:6 quality stability", ADAPTED + " SELECT * FROM a")
def _(spark, d):
    return adapted(spark, d)


def over_good(x: str) -> str:
    """An aggregate of STATS or LABELS over the series that got thresholds."""
    call, name = x.split(" AS ")
    return f"{call} FILTER (WHERE status = 'success') AS {name}" if "FILTER" not in call else f"{call[:-1]} AND status = 'success') AS {name}"


@query("j2_adaptive_summary", "run_id series:int successful:int " + " ".join(x.split(" AS ")[1] + ":5" for x in STATS) + " " + " ".join(x.split(" AS ")[1] + ":int" for x in LABELS) + " robust:int robust_percent:4", ADAPTED + f" SELECT run_id, count(*) AS series, count(*) FILTER (WHERE status = 'success') AS successful, {', '.join(map(over_good, STATS + LABELS))}, count(*) FILTER (WHERE robust) AS robust, count(*) FILTER (WHERE robust) * 100.0 / nullif(count(*) FILTER (WHERE status = 'success'), 0) AS robust_percent FROM a GROUP BY run_id")
def _(spark, d):
    return summary.adaptive_summary(adapted(spark, d))


@query("j3_adaptive_recommendations", "run_id series:int successful:int noisy:6 variable:6 robust:6 multiplier:5 success:6 recommendations", ADAPTED + """
, g AS (SELECT * FROM a WHERE status = 'success'), n AS (SELECT run_id, count(*) AS series FROM a GROUP BY run_id),
m AS (SELECT run_id, count(*) AS successful, avg(CASE WHEN quality = 'low' THEN 1.0 ELSE 0 END) AS noisy, avg(CASE WHEN cv > 0.5 THEN 1.0 ELSE 0 END) AS variable, avg(CASE WHEN robust THEN 1.0 ELSE 0 END) AS robust, avg(multiplier) AS multiplier FROM g GROUP BY run_id),
w AS (SELECT n.run_id, series, coalesce(successful, 0) AS successful, noisy, variable, robust, multiplier, coalesce(successful, 0) / series AS success FROM n LEFT JOIN m USING (run_id))
SELECT *, CASE WHEN successful = 0 THEN 'No series could be analysed: check the quality of the data' ELSE concat_ws('; ', CASE WHEN noisy > 0.5 THEN 'Many series are noisy: a longer interval or better imaging may help' END, CASE WHEN variable > 0.3 THEN 'Signals vary much: thresholds were adjusted to it' END,
CASE WHEN multiplier > 3 THEN 'A high mean multiplier: results may be conservative' WHEN multiplier < 1.5 THEN 'A low mean multiplier: signals are clean and results sensitive' END, CASE WHEN robust > 0.5 THEN 'Many series needed a robust baseline: the data may hold outliers or noise' END,
CASE WHEN success = 1 THEN 'All series were analysed' WHEN success > 0.8 THEN 'Most series were analysed' ELSE 'Some series failed: check the quality of their data' END) END AS recommendations FROM w""")
def _(spark, d):
    return summary.adaptive_recommendations(adapted(spark, d))


@query("j4_calibration_summary", "run_id matched:int missing:int success_percent:4 movement_percent:3", E11 + EACH + ", v AS (SELECT run_id, avg(m) AS movement_percent FROM each GROUP BY run_id) SELECT run_id, count(*) FILTER (WHERE status = 'success') AS matched, count(*) FILTER (WHERE status <> 'success') AS missing, count(*) FILTER (WHERE status = 'success') * 100.0 / count(*) AS success_percent, any_value(movement_percent) AS movement_percent FROM ap LEFT JOIN v USING (run_id) GROUP BY run_id")
def _(spark, d):
    out = by_calibration(spark, d)
    return summary.calibration_summary(out["thresholds"], out["bins"])


@query("j5_roi_summary", f"{KEY} baseline_mean:6 upper:6 lower:6 status movement_samples:int movement_percent:4 sleep_bins:int sleep_minutes:3 mean_fraction:4", E9 + f"""
, x AS (SELECT run_id, roi, sum(state) AS movement_samples, avg(state) * 100 AS movement_percent FROM h GROUP BY run_id, roi), y AS (SELECT run_id, roi, sum(sleep) AS sleep_bins, sum(sleep) * {BIN} / 60.0 AS sleep_minutes, avg(fraction) AS mean_fraction FROM z GROUP BY run_id, roi)
SELECT * FROM b LEFT JOIN x USING (run_id, roi) LEFT JOIN y USING (run_id, roi)""")
def _(spark, d):
    out = by_baseline(spark, d, store=True)
    return summary.series_summary(out["thresholds"], out["states"], out["bins"], BIN)


METHODS = f"ba AS ({SLEPT}{EACH} SELECT * FROM each), ca AS ({E11}{EACH} SELECT * FROM each)"


@query("j6_method_comparison", f"{KEY} baseline_movement:4 baseline_sleep:4 calibration_movement:4 calibration_sleep:4", f"WITH {METHODS} SELECT run_id, roi, coalesce(ba.m, 0) AS baseline_movement, coalesce(ba.p, 0) AS baseline_sleep, coalesce(ca.m, 0) AS calibration_movement, coalesce(ca.p, 0) AS calibration_sleep FROM ba FULL JOIN ca USING (run_id, roi)")
def _(spark, d):
    return summary.compare_methods(baseline=slept(spark, d), calibration=by_calibration(spark, d)["bins"])


@query("j6_method_totals", "run_id method series:int movement_percent:4 sleep_percent:4", f"WITH {METHODS} SELECT run_id, 'baseline' AS method, count(*) AS series, avg(m) AS movement_percent, avg(p) AS sleep_percent FROM ba GROUP BY run_id UNION ALL SELECT run_id, 'calibration', count(*), avg(m), avg(p) FROM ca GROUP BY run_id")
def _(spark, d):
    return summary.method_totals(baseline=slept(spark, d), calibration=by_calibration(spark, d)["bins"])


#: Some users' values are flat, some of these at 0.
FLAT = "CASE WHEN roi % 5 = 0 THEN 0 WHEN roi % 5 = 1 THEN 50 WHEN roi % 5 = 2 THEN -20 ELSE value END"
SHOWN = with_(U.replace("s AS", "s0 AS", 1), f"s AS (SELECT run_id, roi, t, tie, {FLAT} AS value FROM s0)") + """
, m AS (SELECT run_id, roi, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM s WHERE t BETWEEN 432000 AND 1296000 GROUP BY run_id, roi)"""
SHARED = SHOWN + """
, p AS (SELECT *, hi = lo AS flat, CASE WHEN hi = lo AND hi = 0 THEN 1 WHEN hi = lo THEN abs(hi) * 0.1 ELSE (hi - lo) * 0.05 END AS pad FROM m)
SELECT run_id, roi, greatest(0, lo - pad) AS axis_min, hi + pad AS axis_max, flat FROM p"""


def shown(spark: SparkSession, d: str) -> DataFrame:
    return users(spark, d).withColumn("value", F.expr(FLAT).cast("double"))


@query("j7_display_limits", f"{KEY} axis_min:8 axis_max:8 flat", SHARED)
def _(spark, d):
    return summary.display_limits(shown(spark, d), 432_000, 1_296_000)


@query("j7_selected_limits", f"{KEY} axis_min:8 axis_max:8 flat", SHARED)
def _(spark, d):
    return summary.display_limits(shown(spark, d), 432_000, 1_296_000, selected=True)


@query("j7_own_axis_limits", f"{KEY} axis_min:8 axis_max:8 flat", SHOWN + " SELECT run_id, roi, lo - (hi - lo) * 0.05 AS axis_min, hi + (hi - lo) * 0.05 AS axis_max, hi = lo AS flat FROM m")
def _(spark, d):
    return summary.display_limits(shown(spark, d), 432_000, 1_296_000, shared=False)


@query("j8_baseline_visible", f"{KEY} baseline_mean:6 visible", with_(S, LIMITS) + ", m AS (SELECT run_id, roi, min(value) AS lo, max(value) AS hi FROM s WHERE t BETWEEN 432000 AND 1296000 GROUP BY run_id, roi) SELECT run_id, roi, baseline_mean, baseline_mean BETWEEN lo AND hi AS visible FROM m JOIN b USING (run_id, roi)")
def _(spark, d):
    return summary.baseline_visible(events(spark, d), limits(spark, d), 432_000, 1_296_000)
