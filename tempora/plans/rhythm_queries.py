"""Queries of periods and of pairs over the events as regular series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import binning, pairs, rhythm
from tempora.plans import fragments as sql
from tempora.plans.registry import query
from tempora.plans.series_queries import KEY, S, events, with_
from tempora.sources import sinks, tables

#: Bins of an hour; periods from 12 to 36 hours; shuffles of the permutation test.
HOUR, LOW, HIGH, SHUFFLES = 3600, 12, 36, 1000
R = with_(S, sql.resampled("s", "r", HOUR))
FISHER = R + f"""
, g AS (SELECT *, 12 + k * (least({HIGH}.0, n / 2.0) - 12) / 99 AS period_h FROM (SELECT *, count(*) OVER ({sql.P}) AS n FROM r), range(0, 100) AS x(k) WHERE n >= 10),
gc AS (SELECT *, cos(idx * (2 * pi() / period_h)) AS cs, sin(idx * (2 * pi() / period_h)) AS sn FROM g),
fz AS (SELECT run_id, roi, k, period_h, count(*) AS n, count(*) * (coalesce((count(*) * sum(value * cs) - sum(value) * sum(cs)) ** 2 / nullif((count(*) * sum(value * value) - sum(value) ** 2) * (count(*) * sum(cs * cs) - sum(cs) ** 2), 0), 0)
    + coalesce((count(*) * sum(value * sn) - sum(value) * sum(sn)) ** 2 / nullif((count(*) * sum(value * value) - sum(value) ** 2) * (count(*) * sum(sn * sn) - sum(sn) ** 2), 0), 0)) AS z FROM gc GROUP BY run_id, roi, k, period_h),
fb AS (SELECT * FROM (SELECT *, row_number() OVER ({sql.P} ORDER BY z DESC, k) AS pos, count(*) FILTER (WHERE z > -2 * ln(0.05)) OVER ({sql.P}) AS significant_periods FROM fz) WHERE pos = 1)"""
#: The fit at the dominant period, significant or not, so that there is something to compare.
FIT = FISHER + ", rp AS (SELECT r.*, period_h FROM r JOIN fb USING (run_id, roi))," + sql.sinusoid("rp", "ft", 1.0, "period_h") + f"""
, cv AS (SELECT r.run_id, r.roi, idx, a * cos(idx * (2 * pi() / period_h)) + b * sin(idx * (2 * pi() / period_h)) + c AS fitted FROM r JOIN ft USING (run_id, roi)),
cu AS (SELECT *, (fitted - min(fitted) OVER ({sql.P})) / (max(fitted) OVER ({sql.P}) - min(fitted) OVER ({sql.P}) + 1e-10) AS scaled FROM cv)"""
PHASES = FIT + f"""
, wk AS (SELECT *, CASE WHEN scaled > 0.5 THEN 1 ELSE 0 END AS wake FROM cu), wl AS (SELECT *, lag(wake) OVER ({sql.P} ORDER BY idx) AS was FROM wk),
on_ AS (SELECT *, lead(idx) OVER ({sql.P} ORDER BY idx) AS end_idx FROM wl WHERE wake <> was),
ph AS (SELECT run_id, roi, CASE WHEN wake = 1 THEN 'wake' ELSE 'sleep' END AS phase, CAST(idx AS DOUBLE) AS start_h, CAST(end_idx AS DOUBLE) AS end_h, CAST(end_idx - idx AS DOUBLE) AS duration_h FROM on_ WHERE end_idx IS NOT NULL)"""


def regular(spark: SparkSession, d: str) -> DataFrame:
    return binning.resample(events(spark, d), HOUR)


def fisher(spark, d) -> DataFrame:
    return rhythm.fisher_periodogram(regular(spark, d), HOUR, LOW, HIGH)


def fit(spark, d) -> DataFrame:
    r = regular(spark, d)
    return rhythm.sinusoid(r.join(rhythm.dominant_period(fisher(spark, d)).select("run_id", "roi", "period_h"), ["run_id", "roi"]), HOUR)


def curve(spark, d) -> DataFrame:
    return rhythm.fitted_curve(regular(spark, d), fit(spark, d), HOUR)


@query("g1_fisher_periodogram", f"{KEY} k:int period_h:6 z:5 n:int", FISHER + " SELECT * FROM fz")
def _(spark, d):
    return fisher(spark, d)


@query("g2_dominant_period", f"{KEY} n:int period_h:6 z:5 p:7 critical:6 significant significant_periods:int", FISHER + " SELECT *, exp(-z / 2) AS p, -2 * ln(0.05) AS critical, exp(-z / 2) < 0.05 AS significant FROM fb")
def _(spark, d):
    return rhythm.dominant_period(fisher(spark, d))


@query("g3_sinusoid_fit", f"{KEY} period_h:6 n:int a:5 b:5 c:5 amplitude:5 phase:5", FIT + " SELECT * FROM ft")
def _(spark, d):
    return fit(spark, d)


@query("g3_fitted_curve", f"{KEY} idx:int fitted:4 scaled:4", FIT + " SELECT * FROM cu")
def _(spark, d):
    return curve(spark, d)


@query("g4_wake_sleep_phases", f"{KEY} phase start_h:3 end_h:3 duration_h:3", PHASES + " SELECT * FROM ph")
def _(spark, d):
    return rhythm.phases(curve(spark, d), HOUR)


@query("g4_phase_shares", f"{KEY} wake_fraction:6 sleep_fraction:6", PHASES + " SELECT run_id, roi, avg(wake) AS wake_fraction, 1 - avg(wake) AS sleep_fraction FROM wk GROUP BY run_id, roi")
def _(spark, d):
    return rhythm.phase_shares(curve(spark, d))


@query("g5_fisher_summary", f"{KEY} bins:int mean:5 std:5 period_h:6 z:5 p:7 significant amplitude:4 phase:4 wake_fraction:6 wake_phases:int sleep_phases:int error", PHASES + """
, bs AS (SELECT run_id, roi, count(*) AS bins, avg(value) AS mean, stddev_pop(value) AS std FROM r GROUP BY run_id, roi), sg AS (SELECT *, exp(-z / 2) AS p, exp(-z / 2) < 0.9 AS significant FROM fb),
wf AS (SELECT run_id, roi, avg(wake) AS wake_fraction FROM wk GROUP BY run_id, roi), pc AS (SELECT run_id, roi, count(*) FILTER (WHERE phase = 'wake') AS wake_phases, count(*) FILTER (WHERE phase = 'sleep') AS sleep_phases FROM ph GROUP BY run_id, roi)
SELECT run_id, roi, bins, mean, std, sg.period_h, z, p, significant, CASE WHEN significant THEN amplitude END AS amplitude, CASE WHEN significant THEN phase END AS phase, CASE WHEN significant THEN wake_fraction END AS wake_fraction,
CASE WHEN significant THEN wake_phases END AS wake_phases, CASE WHEN significant THEN sleep_phases END AS sleep_phases, CAST(NULL AS VARCHAR) AS error FROM bs JOIN sg USING (run_id, roi) JOIN ft USING (run_id, roi) JOIN wf USING (run_id, roi) LEFT JOIN pc USING (run_id, roi)""")
def _(spark, d):
    return rhythm.fisher_summary(events(spark, d), HOUR, LOW, HIGH, 0.9)


def weight_sql(window: str, i: str = "idx", n: str = "n") -> str:
    x = f"({i} * 2 * pi() / greatest(1, {n} - 1))"
    return {"hann": f"(0.5 - 0.5 * cos({x}))", "hamming": f"(0.54 - 0.46 * cos({x}))", "blackman": f"(0.42 - 0.5 * cos({x}) + 0.08 * cos(2 * {x}))", "none": "1.0"}[window]


def spectrum_sql(window: str, out: str = "sp") -> str:
    return f"""
{out}_n AS (SELECT *, count(*) OVER ({sql.P}) AS n FROM r), {out}_c AS (SELECT run_id, roi, regr_slope(value, idx) AS sl, regr_intercept(value, idx) AS ic FROM r GROUP BY run_id, roi),
{out}_x AS (SELECT run_id, roi, idx, n, (value - (sl * idx + ic)) * {weight_sql(window)} AS x, pow(2.0, ceil(log2(n * 4.0))) AS size FROM {out}_n JOIN {out}_c USING (run_id, roi)),
{out}_k AS (SELECT *, unnest(range(CAST(ceil(size / {HIGH}) AS BIGINT), CAST(floor(size / {LOW}) AS BIGINT) + 1)) AS k FROM {out}_x),
{out} AS (SELECT run_id, roi, n, size, k, size / k AS period_h, sum(x * cos(k * idx * (2 * pi() / size))) ** 2 + sum(x * sin(k * idx * (2 * pi() / size))) ** 2 AS power FROM {out}_k GROUP BY run_id, roi, n, size, k)"""


def mixed(perm: str, idx: str, seed: int = 1) -> str:
    """The 64-bit mix by which shuffles are ranked."""
    x = f"CAST((CAST({perm} AS UHUGEINT) * 4294967296 + CAST({idx} AS UHUGEINT) + {seed * 0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = f"CAST((CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    return f"xor({x}, {x} >> 31)"


SPECTRUM = R + "," + spectrum_sql("hann")
BEST = SPECTRUM + f", sb AS (SELECT * FROM (SELECT *, row_number() OVER ({sql.P} ORDER BY power DESC, k) AS pos FROM sp) WHERE pos = 1)"
PERMUTED = BEST + f"""
, pw AS (SELECT r.run_id, r.roi, idx, power AS observed, {weight_sql("hann")} * cos(k * idx * (2 * pi() / size)) AS c, {weight_sql("hann")} * sin(k * idx * (2 * pi() / size)) AS s FROM r JOIN sb USING (run_id, roi)),
pl AS (SELECT run_id, roi, regr_slope(c, idx) AS cs, regr_intercept(c, idx) AS ci, regr_slope(s, idx) AS ss, regr_intercept(s, idx) AS si FROM pw GROUP BY run_id, roi),
pd AS (SELECT run_id, roi, idx, observed, c - (cs * idx + ci) AS c, s - (ss * idx + si) AS s FROM pw JOIN pl USING (run_id, roi)),
pm AS (SELECT run_id, roi, perm, value, row_number() OVER ({sql.P}, perm ORDER BY {mixed("perm", "idx")}) - 1 AS idx FROM r, range(1, {SHUFFLES + 1}) AS q(perm)),
ps AS (SELECT run_id, roi, perm, observed, sum(value * c) ** 2 + sum(value * s) ** 2 AS power FROM pm JOIN pd USING (run_id, roi, idx) GROUP BY run_id, roi, perm, observed),
pp AS (SELECT run_id, roi, count(*) FILTER (WHERE power >= observed) / count(*) AS p, count(*) AS permutations FROM ps GROUP BY run_id, roi)"""
PEAKS = SPECTRUM + f"""
, tl AS (SELECT *, lag(power) OVER w AS l, lead(power) OVER w AS h FROM sp WINDOW w AS ({sql.P} ORDER BY k)), pk AS (SELECT run_id, roi, k AS peak, period_h, power AS pp FROM tl WHERE power > l AND power > h),
eg AS (SELECT run_id, roi, peak, pk.period_h, pp, max(k) FILTER (WHERE k < peak AND power > pp) AS lo, min(k) FILTER (WHERE k > peak AND power > pp) AS hi, max(power) AS most FROM pk JOIN sp USING (run_id, roi) GROUP BY run_id, roi, peak, pk.period_h, pp),
pr AS (SELECT run_id, roi, peak, eg.period_h, pp, most, pp - greatest(min(power) FILTER (WHERE k <= peak AND k > coalesce(lo, -1)), min(power) FILTER (WHERE k >= peak AND (k < hi OR hi IS NULL))) AS prominence FROM eg JOIN sp USING (run_id, roi) GROUP BY run_id, roi, peak, eg.period_h, pp, most),
pe AS (SELECT run_id, roi, row_number() OVER ({sql.P} ORDER BY pp DESC, peak) AS rank, period_h, pp AS power, prominence FROM pr WHERE prominence >= 0.1 * most)"""


def power(spark, d, window: str | None = "hann") -> DataFrame:
    return rhythm.spectrum(regular(spark, d), HOUR, LOW, HIGH, window)


@query("g6_fourier_spectrum", f"{KEY} k:int period_h:6 power:2", SPECTRUM + " SELECT * FROM sp")
def _(spark, d):
    return power(spark, d)


@query("g7_windows", f"name {KEY} k:int power:2", " UNION ALL ".join(f"SELECT '{w}' AS name, * FROM ({R}, {spectrum_sql(w)} SELECT run_id, roi, k, power FROM sp)" for w in ("hann", "hamming", "blackman", "none")))
def _(spark, d):
    out = None
    for w in ("hann", "hamming", "blackman", "none"):
        part = power(spark, d, w).withColumn("name", F.lit(w))
        out = part if out is None else out.unionByName(part)
    return out


@query("g8_permutation_test", f"{KEY} p:6 permutations:int", PERMUTED + " SELECT * FROM pp")
def _(spark, d):
    return rhythm.permutation_test(regular(spark, d), rhythm.spectrum_best(power(spark, d)), SHUFFLES)


@query("g9_spectral_peaks", f"{KEY} rank:int period_h:6 power:2 prominence:2", PEAKS + " SELECT * FROM pe")
def _(spark, d):
    return rhythm.spectral_peaks(power(spark, d))


def fourier_sql(start: str, shuffles: int = SHUFFLES, low: float = LOW, high: float = HIGH) -> str:
    """start: CTEs s and r of all series. Series of fewer than 10 samples have no spectrum, as rq leaves them out."""
    rest = (PERMUTED + PEAKS[len(SPECTRUM):])[len(R):].replace(f"range(1, {SHUFFLES + 1})", f"range(1, {shuffles + 1})").replace(f"size / {HIGH})", f"size / {high})").replace(f"size / {LOW})", f"size / {low})").replace("FROM r)", "FROM rq)").replace("FROM r ", "FROM rq ").replace("FROM r,", "FROM rq,")
    rest = rest.replace("r.run_id", "rq.run_id").replace("r.roi", "rq.roi")
    return start + ", cn AS (SELECT run_id, roi, count(*) AS samples FROM s GROUP BY run_id, roi), rq AS (SELECT r.* FROM r JOIN cn USING (run_id, roi) WHERE samples >= 10)" + rest + """
, pn AS (SELECT run_id, roi, count(*) AS peaks FROM pe GROUP BY run_id, roi), bs AS (SELECT run_id, roi, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM r GROUP BY run_id, roi),
fo AS (SELECT run_id, roi, samples, bs.n, mean, std, sb.period_h, sb.power, p, CASE WHEN sb.power IS NOT NULL THEN coalesce(peaks, 0) END AS peaks, coalesce(p < 0.05, false) AS significant,
    CASE WHEN samples < 10 OR bs.n < 10 THEN 'too few samples' WHEN sb.power IS NULL THEN 'no period in range' END AS error FROM cn JOIN bs USING (run_id, roi) LEFT JOIN sb USING (run_id, roi) LEFT JOIN pp USING (run_id, roi) LEFT JOIN pn USING (run_id, roi))"""


FOURIER = f"{KEY} samples:int n:int mean:4 std:4 period_h:6 power:2 p:6 peaks:int significant error"
#: Runs of five days of each user: some of too few samples, and by the narrow range some without a bin in it.
SHORT_RUN, NARROW = "CAST(CAST(floor((epoch_us(ts) / 1e6 - 1704067200) / 432000) AS BIGINT) AS VARCHAR)", (30, 31)
SHORT_RUNS = with_(sql.samples("user_id", run=SHORT_RUN), sql.resampled("s", "r", HOUR))


def short_runs(spark, d) -> DataFrame:
    return tables.event_samples(spark, d, "user_id", run=f"cast(cast(floor((unix_micros(cast(ts AS timestamp)) / 1e6 - {tables.START}) / 432000) AS bigint) AS string)")


@query("g10_fourier_summary", FOURIER, fourier_sql(R) + " SELECT * FROM fo")
def _(spark, d):
    return rhythm.fourier_summary(events(spark, d), HOUR, LOW, HIGH, SHUFFLES)


@query("g10_short_series", FOURIER, fourier_sql(SHORT_RUNS, 20, *NARROW) + " SELECT * FROM fo")
def _(spark, d):
    return rhythm.fourier_summary(short_runs(spark, d), HOUR, *NARROW, 20)


@query("g17_fourier_significance", "run_id series:int significant:int percent:4", fourier_sql(SHORT_RUNS, 20) + " SELECT run_id, count(*) AS series, count(*) FILTER (WHERE significant) AS significant, count(*) FILTER (WHERE significant) * 100.0 / count(*) AS percent FROM fo GROUP BY run_id")
def _(spark, d):
    return rhythm.significance_summary(rhythm.fourier_summary(short_runs(spark, d), HOUR, LOW, HIGH, 20))


@query("g11_method_agreement", "run_id compared:int agree:int agree_percent:4 mean_gap:5 std_gap:5", BEST + FISHER[len(R):] + ", ag AS (SELECT run_id, abs(fb.period_h - sb.period_h) AS gap FROM fb JOIN sb USING (run_id, roi)) SELECT run_id, count(*) AS compared, count(*) FILTER (WHERE gap < 2) AS agree, count(*) FILTER (WHERE gap < 2) * 100.0 / count(*) AS agree_percent, avg(gap) AS mean_gap, stddev_pop(gap) AS std_gap FROM ag GROUP BY run_id")
def _(spark, d):
    return rhythm.method_agreement(rhythm.dominant_period(fisher(spark, d)), rhythm.spectrum_best(power(spark, d)))


PERIODS = rhythm.period_choice(LOW, HIGH)


def cosinor_sql(out: str) -> str:
    """From the fit ft of each run, roi, period_h."""
    det = "(m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02))"
    return f"""
{out}_a AS (SELECT *, c AS mesor, a AS beta, b AS gamma, atan2(-b, a) AS acrophase, yy - y2 * y2 / n AS tss, yy - a * y0 - b * y1 - c * y2 AS rss, {det} AS det FROM ft),
{out}_b AS (SELECT *, ((tss - rss) / 2) / nullif(rss / (n - 3), 0) AS f, 1 - coalesce(rss / nullif(tss, 0), 1) AS r2, rss / (n - 3) * (m11 * m22 - m12 * m12) / det AS vbb, rss / (n - 3) * (m00 * m22 - m02 * m02) / det AS vgg,
    rss / (n - 3) * (m02 * m12 - m01 * m22) / det AS vbg, rss / (n - 3) * (m00 * m11 - m01 * m01) / det AS vmm FROM {out}_a),
{out}_c AS (SELECT *, sqrt(vmm) AS se_mesor, sqrt((beta * beta * vbb + 2 * beta * gamma * vbg + gamma * gamma * vgg) / nullif(amplitude ** 2, 0)) AS se_amplitude,
    sqrt((gamma * gamma * vbb - 2 * beta * gamma * vbg + beta * beta * vgg) / nullif(amplitude ** 4, 0)) AS se_acrophase FROM {out}_b),
{out} AS (SELECT *, pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0) AS p, (-acrophase * period_h / (2 * pi())) - period_h * floor((-acrophase * period_h / (2 * pi())) / period_h) AS peak_h FROM {out}_c)"""


#: For each n of co the t that 0.975 lies below at n - 3 degrees of freedom, by halving on the finite sums that give its distribution there.
T_QUANTILE = """
, tn AS (SELECT DISTINCT n, CAST(n - 3 AS DOUBLE) AS df FROM co),
tq(n, df, lo, hi, i) AS (SELECT n, df, 0.0::DOUBLE, 1000.0::DOUBLE, 0 FROM tn UNION ALL SELECT n, df, CASE WHEN share < 0.95 THEN mid ELSE lo END, CASE WHEN share < 0.95 THEN hi ELSE mid END, i + 1 FROM
    (SELECT *, CASE WHEN df % 2 = 1 THEN 2 / pi() * (a + sin(a) * coalesce(list_sum(list_transform(range(0, CAST((df - 1) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5)) * pow(cos(a), 2 * k + 1))), 0))
        ELSE sin(a) * list_sum(list_transform(range(0, CAST(df // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * pow(cos(a), 2 * k))) END AS share FROM
    (SELECT *, (lo + hi) / 2 AS mid, atan((lo + hi) / 2 / sqrt(df)) AS a FROM tq WHERE i < 60))),
tv AS (SELECT n, lo AS t FROM tq WHERE i = 60), cw AS (SELECT co.*, t * se_amplitude AS amplitude_half_width, t * se_acrophase AS acrophase_half_width FROM co LEFT JOIN tv USING (n))"""


COSINOR_COLUMNS = f"{KEY} n:int period_h:4 mesor:5 beta:5 gamma:5 amplitude:5 acrophase:4 peak_h:3 f:4 p:5 r2:6 se_mesor:5 se_amplitude:5 se_acrophase:4 amplitude_half_width:4 acrophase_half_width:4"
COSINOR24 = R + "," + sql.sinusoid("r", "ft", 1.0, "24") + "," + cosinor_sql("co")
MANY = R + f", rm AS (SELECT r.*, tp FROM r, (SELECT unnest({PERIODS}) AS tp))," + sql.sinusoid("rm", "ft", 1.0, "tp") + "," + cosinor_sql("co") + f", cb AS (SELECT *, row_number() OVER ({sql.P} ORDER BY r2 DESC, period_h) = 1 AS best FROM co)"


@query("g12_cosinor", COSINOR_COLUMNS, COSINOR24.replace("WITH ", "WITH RECURSIVE ", 1) + T_QUANTILE + " SELECT * FROM cw")
def _(spark, d):
    return rhythm.cosinor(regular(spark, d), HOUR, 24.0)


@query("g12_short_series", f"{KEY} n:int amplitude:4 amplitude_half_width:4 acrophase_half_width:4", SHORT_RUNS.replace("WITH ", "WITH RECURSIVE ", 1) + ", rs AS (SELECT * FROM r WHERE idx < 5 + roi % 6)," + sql.sinusoid("rs", "fs", 1.0, "5") + ", ft AS (SELECT * FROM fs WHERE n > 4)," + cosinor_sql("co") + T_QUANTILE + " SELECT * FROM cw WHERE amplitude > 0.001")
def _(spark, d):
    return rhythm.cosinor(binning.resample(short_runs(spark, d), HOUR).where("idx < 5 + roi % 6"), HOUR, 5.0).where("n > 4 AND amplitude > 0.001")


@query("g13_cosinor_periods", f"{KEY} period_h:4 amplitude:5 r2:6 best", MANY + " SELECT * FROM cb")
def _(spark, d):
    return rhythm.cosinor_periods(regular(spark, d), HOUR, PERIODS)


@query("g14_test_periods", "run_id period_h:4 series:int", R + f", n AS (SELECT run_id, count(DISTINCT roi) AS series FROM r GROUP BY run_id) SELECT run_id, unnest([12.0, 18.0, 24.0, 30.0, 36.0][2:5]) AS period_h, series FROM n UNION ALL SELECT run_id, 12.0, series FROM n")
def _(spark, d):
    r = regular(spark, d).groupBy("run_id").agg(F.count_distinct("roi").alias("series"))
    return r.withColumn("period_h", F.explode(F.array(*(F.lit(p) for p in PERIODS + ([18.0] if 18.0 not in PERIODS else [])))))


POPULATION = MANY.replace("ft", "f1").replace("co_", "c1_").replace("co AS", "c1 AS").replace("FROM co)", "FROM c1)") + ", mp AS (SELECT run_id, quantile_cont(period_h, 0.5) AS mid FROM cb WHERE best GROUP BY run_id), rq AS (SELECT r.*, mid FROM r JOIN mp USING (run_id))," + sql.sinusoid("rq", "ft", 1.0, "mid") + "," + cosinor_sql("co")


@query("g15_population_cosinor", "run_id period_h:4 n:int mesor:5 amplitude:5 acrophase:4 significant:int proportion:6", POPULATION + """ , pc AS (SELECT run_id, period_h, count(*) AS n, avg(mesor) AS mesor, avg(beta) AS mb, avg(gamma) AS mg, count(*) FILTER (WHERE p < 0.05) AS significant FROM co GROUP BY run_id, period_h)
SELECT *, sqrt(mb * mb + mg * mg) AS amplitude, atan2(-mg, mb) AS acrophase, significant / n AS proportion FROM pc""")
def _(spark, d):
    return rhythm.population_cosinor(regular(spark, d), HOUR, PERIODS)


#: Runs of a quarter of the users each.
QUARTERS = with_(sql.samples(run="CAST(user_id % 4 AS VARCHAR)"), sql.resampled("s", "r", HOUR))


@query("g16_boundary_diagnostics", "run_id series:int at_edge:int edge_warning mismatches:int mismatch_warning significant:int cosinor_at_edge:int cosinor_warning hint", QUARTERS + (BEST + PEAKS[len(SPECTRUM):] + MANY[len(R):])[len(R):] + """
, en AS (SELECT run_id, roi, min(period_h) AS lo, max(period_h) AS hi FROM sp GROUP BY run_id, roi),
ea AS (SELECT sb.run_id, sb.roi, pe.power IS NOT NULL AND (abs(sb.period_h - hi) < 0.05 * (hi - lo) OR abs(sb.period_h - lo) < 0.05 * (hi - lo)) AS edge, abs(pe.period_h - sb.period_h) > 0.5 AND pe.power >= 0.9 * sb.power AS off FROM sb JOIN en USING (run_id, roi) LEFT JOIN (SELECT * FROM pe WHERE rank = 1) AS pe ON sb.run_id = pe.run_id AND sb.roi = pe.roi),
a AS (SELECT run_id, count(*) AS series, count(*) FILTER (WHERE edge) AS at_edge, count(*) FILTER (WHERE off) AS mismatches FROM ea GROUP BY run_id),
tt AS (SELECT run_id, min(period_h) AS tl, max(period_h) AS th FROM cb GROUP BY run_id),
b AS (SELECT run_id, count(*) AS significant, count(*) FILTER (WHERE period_h IN (tl, th)) AS cosinor_at_edge, min(period_h) AS least, max(period_h) AS most, min(tl) AS tl, max(th) AS th FROM cb JOIN tt USING (run_id) WHERE best AND p < 0.5 GROUP BY run_id)
SELECT run_id, series, at_edge, at_edge > 0.3 * series AS edge_warning, mismatches, mismatches > 0 AS mismatch_warning, coalesce(significant, 0) AS significant, coalesce(cosinor_at_edge, 0) AS cosinor_at_edge, coalesce(cosinor_at_edge > 0.3 * significant AND significant > 0, false) AS cosinor_warning,
CASE WHEN significant >= 3 AND most > 12 AND th < 24 THEN 'consider a test period of 24 h' WHEN significant >= 3 AND least < 2 AND tl > 1 THEN 'consider test periods of 0.5 to 1 h' END AS hint FROM a LEFT JOIN b USING (run_id)""")
def _(spark, d):
    r = binning.resample(tables.event_samples(spark, d, run="cast(user_id % 4 AS string)"), HOUR)
    return rhythm.boundary_diagnostics(rhythm.spectrum(r, HOUR, LOW, HIGH), rhythm.cosinor_periods(r, HOUR, PERIODS), 0.5)


@query("g17_significance_summary", "run_id series:int significant:int percent:4", FISHER + " SELECT run_id, count(*) AS series, count(*) FILTER (WHERE exp(-z / 2) < 0.05) AS significant, count(*) FILTER (WHERE exp(-z / 2) < 0.05) * 100.0 / count(*) AS percent FROM fb GROUP BY run_id")
def _(spark, d):
    return rhythm.significance_summary(rhythm.dominant_period(fisher(spark, d)))


CUT = with_(S.replace("s AS", "s0 AS"), "s1 AS (SELECT * FROM s0 WHERE t BETWEEN 36000 AND 1800000)", f"s AS (SELECT run_id, roi, avg(t) AS t, avg(value) AS value FROM (SELECT *, (row_number() OVER ({sql.T}) - 1) // 6 AS g FROM s1) GROUP BY run_id, roi, g)")


@query("g18_rhythm_dispatch", f"{KEY} period_h:4 amplitude:5 r2:6 best", CUT + "," + sql.resampled("s", "r", 7800) + f", rm AS (SELECT r.*, tp FROM r, (SELECT unnest({PERIODS}) AS tp))," + sql.sinusoid("rm", "ft", 7800 / 3600, "tp") + "," + cosinor_sql("co") + f" SELECT *, row_number() OVER ({sql.P} ORDER BY r2 DESC, period_h) = 1 AS best FROM co")
def _(spark, d):
    return rhythm.rhythm(events(spark, d), "cosinor", 7800, LOW, HIGH, old_interval=1300, hours=(10, 500))


@query("g18_dispatch_fisher", f"{KEY} bins:int period_h:6 z:5 significant", FISHER + ", bs AS (SELECT run_id, roi, count(*) AS bins FROM r GROUP BY run_id, roi) SELECT run_id, roi, bins, period_h, z, exp(-z / 2) < 0.05 AS significant FROM bs JOIN fb USING (run_id, roi)")
def _(spark, d):
    return rhythm.rhythm(events(spark, d), "fisher", HOUR, LOW, HIGH)


@query("g18_dispatch_fourier", FOURIER, fourier_sql(R, 20) + " SELECT * FROM fo")
def _(spark, d):
    return rhythm.rhythm(events(spark, d), "fourier", HOUR, LOW, HIGH, permutations=20)


# Pairs.

PAIRS = R + """, pj AS (SELECT a.run_id, a.roi AS roi1, b.roi AS roi2, idx, a.value AS x, b.value AS y FROM r AS a JOIN r AS b USING (run_id, idx) WHERE a.roi < b.roi), pa AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY run_id, roi1, roi2) AS n FROM pj) WHERE n >= 10)"""
W2 = "OVER (PARTITION BY run_id, roi1, roi2)"
LAG = 12
CROSS = PAIRS + f"""
, pz AS (SELECT run_id, roi1, roi2, idx, n, (x - avg(x) {W2}) / (stddev_pop(x) {W2} + 1e-10) AS x, (y - avg(y) {W2}) / (stddev_pop(y) {W2} + 1e-10) AS y FROM pa),
cl AS (SELECT a.run_id, a.roi1, a.roi2, a.n, lag, sum(a.x * b.y) / a.n AS correlation FROM pz AS a, range(-{LAG}, {LAG + 1}) AS l(lag) JOIN pz AS b ON a.run_id = b.run_id AND a.roi1 = b.roi1 AND a.roi2 = b.roi2 AND b.idx = a.idx - lag GROUP BY a.run_id, a.roi1, a.roi2, a.n, lag),
cc AS (SELECT run_id, roi1, roi2, n, correlation, CAST(lag AS DOUBLE) AS lag_h, zero_lag, correlation > 0.5 AS similar FROM (SELECT *, row_number() OVER (PARTITION BY run_id, roi1, roi2 ORDER BY correlation DESC, lag) AS pos, max(correlation) FILTER (WHERE lag = 0) {W2} AS zero_lag FROM cl) WHERE pos = 1)"""
PAIR = "run_id roi1 roi2"


def correlations(spark, d) -> DataFrame:
    return pairs.correlation(regular(spark, d), HOUR, LAG)


@query("h1_cross_correlation", f"{PAIR} n:int lag:int correlation:6", CROSS + " SELECT * FROM cl")
def _(spark, d):
    return pairs.cross_correlation(regular(spark, d), HOUR, LAG)


@query("h1_best_correlation", f"{PAIR} n:int correlation:6 lag_h:3 zero_lag:6 similar", CROSS + " SELECT * FROM cc")
def _(spark, d):
    return correlations(spark, d)


def square_sql(src: str, value: str, diagonal: float, sign: int) -> str:
    return f"""sq AS (SELECT run_id, roi1, roi2, {value} AS value FROM {src} UNION ALL SELECT run_id, roi2, roi1, {sign} * {value} FROM {src} UNION ALL SELECT DISTINCT run_id, roi, roi, CAST({diagonal} AS DOUBLE) FROM r)"""


@query("h2_correlation_matrix", f"{PAIR} value:6", CROSS + ", " + square_sql("cc", "correlation", 1, 1) + " SELECT * FROM sq")
def _(spark, d):
    return pairs.matrix(correlations(spark, d), "correlation", 1)


@query("h2_lag_matrix", f"{PAIR} value:3", CROSS + ", " + square_sql("cc", "lag_h", 0, -1) + " SELECT * FROM sq")
def _(spark, d):
    return pairs.matrix(correlations(spark, d), "lag_h", 0, -1)


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("h2_wide_matrix", "run_id roi1 " + " ".join(f"{t}:6" for t in TYPES), CROSS + ", " + square_sql("cc", "correlation", 1, 1) + " SELECT run_id, roi1, " + ", ".join(f"max(value) FILTER (WHERE roi2 = '{t}') AS {t}" for t in TYPES) + " FROM sq GROUP BY run_id, roi1")
def _(spark, d):
    return pairs.wide_matrix(pairs.matrix(correlations(spark, d), "correlation", 1), TYPES)


@query("h3_similar_pairs", f"{PAIR} correlation:6 lag_h:3 synchronized rank:int", CROSS + " SELECT *, abs(lag_h) < 1 AS synchronized, row_number() OVER (PARTITION BY run_id ORDER BY correlation DESC, roi1, roi2) AS rank FROM cc WHERE correlation >= 0.05")
def _(spark, d):
    return pairs.similar_pairs(correlations(spark, d), 0.05)


@query("h4_clusters", f"{KEY} cluster:int size:int")
def _(spark, d):
    return pairs.clusters(correlations(spark, d), "average", 0.94)


SINE = R + "," + sql.sinusoid("r", "ft", 1.0, "24")


@query("h5_phase_difference", f"{PAIR} radians:4 hours:4 amplitude1:5 amplitude2:5 in_phase anti_phase", SINE + """
, d AS (SELECT a.run_id, a.roi AS roi1, b.roi AS roi2, a.amplitude AS amplitude1, b.amplitude AS amplitude2, atan2(sin(b.phase - a.phase), cos(b.phase - a.phase)) AS radians FROM ft AS a JOIN ft AS b ON a.run_id = b.run_id AND a.roi < b.roi)
SELECT *, radians / (2 * pi()) * 24 AS hours, abs(radians / (2 * pi()) * 24) < 6 AS in_phase, abs(radians / (2 * pi()) * 24) > 18 AS anti_phase FROM d""")
def _(spark, d):
    return pairs.phase_difference(regular(spark, d), HOUR, 24)


COHERENCE = PAIRS + f"""
, wa AS (SELECT *, CAST(least(n, greatest(16, least(256, n // 8))) AS BIGINT) AS size FROM pa), wb AS (SELECT *, size - size // 2 AS step FROM wa), wc AS (SELECT *, (n - (size - step)) // step AS segments FROM wb),
wd AS (SELECT run_id, roi1, roi2, size, seg, idx - seg * step AS i, x, y FROM wc, range(0, 400) AS g(seg) WHERE seg < segments AND idx >= seg * step AND idx < seg * step + size),
we AS (SELECT run_id, roi1, roi2, size, seg, i, (x - avg(x) OVER w) * (0.5 - 0.5 * cos(i * 2 * pi() / size)) AS x, (y - avg(y) OVER w) * (0.5 - 0.5 * cos(i * 2 * pi() / size)) AS y FROM wd WINDOW w AS (PARTITION BY run_id, roi1, roi2, seg)),
wf AS (SELECT *, unnest(range(0, size // 2 + 1)) AS k FROM we),
wg AS (SELECT run_id, roi1, roi2, size, seg, k, sum(x * cos(k * i * (2 * pi() / size))) AS xr, sum(x * sin(k * i * (2 * pi() / size))) AS xi, sum(y * cos(k * i * (2 * pi() / size))) AS yr, sum(y * sin(k * i * (2 * pi() / size))) AS yi FROM wf GROUP BY run_id, roi1, roi2, size, seg, k),
wh AS (SELECT run_id, roi1, roi2, k, CASE WHEN k > 0 THEN size / k ELSE 0 END AS period_h, coalesce((sum(xr * yr + xi * yi) ** 2 + sum(xr * yi - xi * yr) ** 2) / nullif(sum(xr * xr + xi * xi) * sum(yr * yr + yi * yi), 0), 0) AS coherence FROM wg GROUP BY run_id, roi1, roi2, size, k),
wr AS (SELECT *, period_h BETWEEN 19.2 AND 28.8 AS inside, row_number() OVER (PARTITION BY run_id, roi1, roi2 ORDER BY coherence DESC, k) AS pos, row_number() OVER (PARTITION BY run_id, roi1, roi2 ORDER BY period_h BETWEEN 19.2 AND 28.8 DESC, coherence DESC, k) AS near FROM wh WHERE k >= 0),
ws AS (SELECT run_id, roi1, roi2, max(coherence) FILTER (WHERE near = 1) AS coherence, max(period_h) FILTER (WHERE near = 1) AS period_h, max(coherence) FILTER (WHERE near = 1) > 0.3 AS synchronized, max(coherence) FILTER (WHERE pos = 1) AS max_coherence, max(period_h) FILTER (WHERE pos = 1) AS max_period_h, bool_or(inside) AS target_in_range FROM wr GROUP BY run_id, roi1, roi2)"""


#: Coherence from which independent series, as the events are, count as synchronized, so that some do.
SYNC = 0.01


def coherences(spark, d) -> DataFrame:
    return pairs.coherence(regular(spark, d), HOUR, 24, 0.3)


@query("h6_coherence_spectrum", f"{PAIR} k:int period_h:6 coherence:5", COHERENCE + " SELECT * FROM wh WHERE k > 0")
def _(spark, d):
    return pairs.coherence_spectrum(regular(spark, d), HOUR).where("k > 0")


@query("h6_coherence", f"{PAIR} coherence:5 period_h:6 synchronized target_in_range", COHERENCE + " SELECT * FROM ws")
def _(spark, d):
    return coherences(spark, d)


@query("h7_coherence_matrix", f"{PAIR} value:5", COHERENCE + ", " + square_sql("ws", "coherence", 1, 1) + " SELECT * FROM sq")
def _(spark, d):
    return pairs.matrix(coherences(spark, d), "coherence", 1)


@query("h8_top_coherent", f"{PAIR} coherence:5 period_h:6 rank:int synchronized_pairs:int", COHERENCE.replace("> 0.3 AS synchronized", f"> {SYNC} AS synchronized") + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coherence DESC, roi1, roi2) AS rank, count(*) OVER (PARTITION BY run_id) AS synchronized_pairs FROM ws WHERE synchronized) WHERE rank <= 5")
def _(spark, d):
    return pairs.top_coherent(pairs.coherence(regular(spark, d), HOUR, 24, SYNC))


def hilbert_sql(src: str, keys: str, value: str, out: str) -> str:
    """The Hilbert transform as a circular convolution with its kernel."""
    k = "(((a.idx - b.idx) % a.n + a.n) % a.n)"
    even = f"(1 - CASE WHEN {k} % 2 = 0 THEN 1 ELSE -1 END) / a.n / tan(pi() * {k} / a.n)"
    odd = f"(1 / tan(pi() * {k} / a.n) - CASE WHEN {k} % 2 = 0 THEN 1 ELSE -1 END / sin(pi() * {k} / a.n)) / a.n"
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys.split(", "))
    mine = ", ".join(f"a.{c}" for c in keys.split(", "))
    return f"""{out}_c AS (SELECT {keys}, idx, count(*) OVER (PARTITION BY {keys}) AS n, {value} - avg({value}) OVER (PARTITION BY {keys}) AS v FROM {src}),
{out} AS (SELECT {mine}, a.idx, a.v AS re, sum(CASE WHEN a.idx = b.idx THEN 0 WHEN a.n % 2 = 0 THEN b.v * {even} ELSE b.v * {odd} END) AS im FROM {out}_c AS a JOIN {out}_c AS b ON {on} GROUP BY {mine}, a.idx, a.v)"""


LOCKING = PAIRS + ", " + hilbert_sql("pa", "run_id, roi1, roi2", "x", "hx") + ", " + hilbert_sql("pa", "run_id, roi1, roi2", "y", "hy") + """
, hd AS (SELECT run_id, roi1, roi2, avg(cos(atan2(hy.im, hy.re) - atan2(hx.im, hx.re))) AS mc, avg(sin(atan2(hy.im, hy.re) - atan2(hx.im, hx.re))) AS ms FROM hx JOIN hy USING (run_id, roi1, roi2, idx) GROUP BY run_id, roi1, roi2),
hl AS (SELECT run_id, roi1, roi2, sqrt(mc * mc + ms * ms) AS plv, atan2(ms, mc) / (2 * pi()) * 24 AS hours FROM hd)"""
PHASE = R + ", " + hilbert_sql("r", "run_id, roi", "value", "hs") + """
, hp AS (SELECT run_id, roi, atan2(avg(sin(atan2(im, re))), avg(cos(atan2(im, re)))) AS radians, avg(sqrt(re * re + im * im)) AS amplitude FROM hs GROUP BY run_id, roi),
hq AS (SELECT *, radians / (2 * pi()) * 24 - 24 * floor(radians / (2 * pi())) AS phase_h FROM hp), hc AS (SELECT *, CASE WHEN phase_h < 6 THEN 'early_active' WHEN phase_h < 12 THEN 'mid_active' WHEN phase_h < 18 THEN 'late_active' ELSE 'night_active' END AS cluster FROM hq)"""


@query("h9_phase_locking", f"{PAIR} plv:5 hours:3 phase_std:4 quality synchronized", LOCKING + " SELECT *, CASE WHEN plv > 0 THEN sqrt(greatest(0, -2 * ln(plv))) ELSE pi() END AS phase_std, CASE WHEN plv > 0.8 THEN 'strong' WHEN plv > 0.5 THEN 'moderate' WHEN plv > 0.3 THEN 'weak' ELSE 'none' END AS quality, plv > 0.5 AS synchronized FROM hl")
def _(spark, d):
    return pairs.phase_locking(regular(spark, d), 24)


@query("h10_series_phase", f"{KEY} radians:4 phase_h:3 amplitude:4", PHASE + " SELECT * FROM hq")
def _(spark, d):
    return pairs.series_phase(regular(spark, d), 24)


@query("h11_phase_clusters", f"{KEY} phase_h:3 cluster", PHASE + " SELECT * FROM hc")
def _(spark, d):
    return pairs.phase_clusters(regular(spark, d), 24)


@query("h11_phase_members", "run_id cluster members:int rois mean_amplitude:4", PHASE + " SELECT run_id, cluster, count(*) AS members, string_agg(roi, ',' ORDER BY roi) AS rois, avg(amplitude) AS mean_amplitude FROM hc GROUP BY run_id, cluster")
def _(spark, d):
    return pairs.phase_members(pairs.phase_clusters(regular(spark, d), 24))


@query("h12_pair_status", f"{PAIR} correlation:6 lag_h:3 status rank:int", CROSS + " SELECT *, CASE WHEN correlation > 0.7 THEN 'Synchronized' WHEN correlation > 0.3 THEN 'Moderate' ELSE 'Low' END AS status, row_number() OVER (PARTITION BY run_id ORDER BY correlation DESC, roi1, roi2) AS rank FROM cc")
def _(spark, d):
    return pairs.pair_status(correlations(spark, d))


#: Series with a day's swing in three types, one of them three hours late, so that some pairs are similar and some of these at once.
SWING = "value + CASE WHEN roi IN ('click', 'view') THEN 300 * sin(idx * 2 * pi() / 24) WHEN roi = 'signup' THEN 300 * sin((idx - 3) * 2 * pi() / 24) ELSE 0 END"
SWUNG = with_(S, sql.resampled("s", "rr", HOUR), f"r AS (SELECT run_id, roi, idx, t, {SWING} AS value FROM rr)") + CROSS[len(R):]
LINKED = SWUNG + """, ed AS (SELECT run_id, roi1 AS a, roi2 AS b FROM cc WHERE correlation >= 0.5 UNION SELECT run_id, roi2, roi1 FROM cc WHERE correlation >= 0.5 UNION SELECT DISTINCT run_id, roi, roi FROM r)"""


def swung(spark, d) -> DataFrame:
    return pairs.correlation(regular(spark, d).withColumn("value", F.expr(SWING)), HOUR, LAG)


@query("h13_similarity_summary", "run_id pairs:int similar_pairs:int synchronized_pairs:int rank:int roi1 roi2 correlation:6 lag_h:3 synchronized", SWUNG + """
, si AS (SELECT *, abs(lag_h) < 1 AS synchronized, row_number() OVER (PARTITION BY run_id ORDER BY correlation DESC, roi1, roi2) AS rank FROM cc WHERE correlation >= 0.7), n AS (SELECT run_id, count(*) AS pairs FROM cc GROUP BY run_id),
m AS (SELECT run_id, count(*) AS similar_pairs, count(*) FILTER (WHERE synchronized) AS synchronized_pairs FROM si GROUP BY run_id)
SELECT run_id, pairs, coalesce(similar_pairs, 0) AS similar_pairs, coalesce(synchronized_pairs, 0) AS synchronized_pairs, rank, roi1, roi2, correlation, lag_h, synchronized FROM n LEFT JOIN m USING (run_id) LEFT JOIN (SELECT * FROM si WHERE rank <= 5) USING (run_id)""")
def _(spark, d):
    return pairs.similarity_summary(swung(spark, d))


@query("h13_no_similar_pairs", "run_id pairs:int similar_pairs:int rank:int", CROSS + " SELECT run_id, count(*) AS pairs, 0 AS similar_pairs, CAST(NULL AS BIGINT) AS rank FROM cc GROUP BY run_id")
def _(spark, d):
    return pairs.similarity_summary(correlations(spark, d))


@query("h4_single_linkage", f"{KEY} cluster:int size:int", LINKED.replace("WITH ", "WITH RECURSIVE ", 1) + """
, reach(run_id, a, b) AS (SELECT run_id, a, b FROM ed UNION SELECT p.run_id, p.a, e.b FROM reach AS p JOIN ed AS e ON p.run_id = e.run_id AND p.b = e.a), ro AS (SELECT run_id, a AS roi, min(b) AS root FROM reach GROUP BY run_id, a)
SELECT run_id, roi, dense_rank() OVER (PARTITION BY run_id ORDER BY root) AS cluster, count(*) OVER (PARTITION BY run_id, root) AS size FROM ro""")
def _(spark, d):
    return pairs.clusters(swung(spark, d), "single", 0.5)


@query("h13_cluster_summary", "run_id cluster:int size:int rois", LINKED.replace("WITH ", "WITH RECURSIVE ", 1) + """
, reach(run_id, a, b) AS (SELECT run_id, a, b FROM ed UNION SELECT p.run_id, p.a, e.b FROM reach AS p JOIN ed AS e ON p.run_id = e.run_id AND p.b = e.a), ro AS (SELECT run_id, a AS roi, min(b) AS root FROM reach GROUP BY run_id, a),
cn AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY root) AS cluster FROM ro) SELECT run_id, cluster, count(*) AS size, string_agg(roi, ',' ORDER BY roi) AS rois FROM cn GROUP BY run_id, cluster""")
def _(spark, d):
    return pairs.cluster_summary(pairs.clusters(swung(spark, d), "single", 0.5))


@query("g18_dispatch_similarity", f"{PAIR} n:int correlation:6 lag_h:3", CROSS.replace(f"range(-{LAG}, {LAG + 1})", f"range(-{HIGH // 2}, {HIGH // 2 + 1})") + " SELECT * FROM cc")
def _(spark, d):
    return rhythm.rhythm(events(spark, d), "similarity", HOUR, LOW, HIGH)


@query("g18_dispatch_coherence", f"{PAIR} coherence:5 period_h:6 target_in_range", COHERENCE + " SELECT * FROM ws")
def _(spark, d):
    return rhythm.rhythm(events(spark, d), "coherence", HOUR, LOW, HIGH)


@query("g18_dispatch_phase", f"{KEY} phase_h:3 cluster", PHASE + " SELECT * FROM hc")
def _(spark, d):
    return rhythm.rhythm(events(spark, d), "phase", HOUR, LOW, HIGH)


#: Runs of several regions each: the users by their remainders, the types as regions.
RUN = "user_id % 4"
MANY_RUNS = with_(sql.samples(run=f"CAST({RUN} AS VARCHAR)"), sql.resampled("s", "r", 4 * HOUR))


def many_runs(spark, d) -> DataFrame:
    return binning.resample(tables.event_samples(spark, d, run=f"cast({RUN} AS string)"), 4 * HOUR)


@query("h1_many_runs", f"{PAIR} n:int correlation:6 lag_h:3 zero_lag:6 similar", MANY_RUNS + CROSS[len(R):].replace(f"range(-{LAG}, {LAG + 1})", "range(-3, 4)").replace("CAST(lag AS DOUBLE) AS lag_h", "CAST(lag * 4 AS DOUBLE) AS lag_h") + " SELECT * FROM cc")
def _(spark, d):
    return pairs.correlation(many_runs(spark, d), 4 * HOUR, LAG)


@query("g12_many_runs", f"{KEY} n:int period_h:4 mesor:5 amplitude:5 acrophase:4 r2:6", MANY_RUNS + "," + sql.sinusoid("r", "ft", 4.0, "24") + "," + cosinor_sql("co") + " SELECT * FROM co")
def _(spark, d):
    return rhythm.cosinor(many_runs(spark, d), 4 * HOUR, 24.0)


# Exports of rhythm results.


@query("a14_fisher_export", f"{KEY} period_h:6 z:5 p:7 significant", FISHER + " SELECT run_id, roi, period_h, z, exp(-z / 2) AS p, exp(-z / 2) < 0.05 AS significant FROM fb")
def _(spark, d):
    return rhythm.dominant_period(fisher(spark, d)).select("run_id", "roi", "period_h", "z", "p", "significant")


@query("a14_top_peaks", f"{KEY} rank:int period_h:6 power:2", PEAKS + " SELECT * FROM pe WHERE rank <= 5")
def _(spark, d):
    return sinks.top_peaks(rhythm.spectral_peaks(power(spark, d)))


@query("a15_thinned_spectrum", f"{KEY} k:int power:2", SPECTRUM + f" SELECT * FROM (SELECT *, row_number() OVER ({sql.P} ORDER BY k) - 1 AS i, count(*) OVER ({sql.P}) AS c FROM sp) WHERE i % CAST(ceil(c / 100.0) AS BIGINT) = 0")
def _(spark, d):
    return sinks.thinned(power(spark, d), 100)
