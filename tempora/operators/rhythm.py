"""Periods of regular series (run_id, roi, idx, value): Fisher-type periodogram, Fourier spectrum, cosinor."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import student
from tempora.functions.fits import ratio, solve3
from tempora.operators import binning
from tempora.sources.tables import KEYS

PERIODS, ALPHA, LEAST = 100, 0.05, 10
TAU = 2 * math.pi


def _whole() -> Window:
    return Window.partitionBy(*KEYS)


def _r_squared(n: Column, x: str, y: str) -> Column:
    """Squared correlation from sums; 0 for a constant series."""
    top = n * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    bottom = (n * F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x)) * (n * F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y))
    return F.coalesce(F.try_divide(top * top, bottom), F.lit(0.0))


def fisher_periodogram(regular: DataFrame, interval: float, low: float = 12, high: float = 36, periods: int = PERIODS) -> DataFrame:
    """k, period_h, z: n times the squared correlations with cosine and sine at evenly spaced periods."""
    hours = interval / 3600
    counted = regular.withColumn("n", F.count("*").over(_whole())).where(F.col("n") >= LEAST)
    first, last = max(low, 3 * hours), F.least(F.lit(float(high)), F.col("n") * hours / 2)
    rows = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(periods - 1)))).withColumn("period_h", first + F.col("k") * (last - first) / (periods - 1))
    angle = F.col("idx") * (TAU * hours / F.col("period_h"))
    rows = rows.withColumns({"c": F.cos(angle), "s": F.sin(angle)})
    n = F.count("*")
    return rows.groupBy(*KEYS, "k", "period_h").agg((n * (_r_squared(n, "value", "c") + _r_squared(n, "value", "s"))).alias("z"), n.alias("n"))


def dominant_period(periodogram: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The period of the largest score (the first on ties), its p-value, the critical score and how many periods exceed it."""
    critical = -2 * math.log(alpha)
    best = F.max_by(F.struct("period_h", "z", "n"), F.struct(F.col("z"), -F.col("k")))
    m = periodogram.groupBy(*KEYS).agg(best.alias("b"), F.count_if(F.col("z") > critical).alias("significant_periods"))
    p = F.exp(-F.col("b.z") / 2)
    return m.select(*KEYS, F.col("b.n").alias("n"), F.col("b.period_h").alias("period_h"), F.col("b.z").alias("z"), p.alias("p"), F.lit(critical).alias("critical"), (p < alpha).alias("significant"), "significant_periods")


def _cos_sin(regular: DataFrame, angle: Column) -> DataFrame:
    return regular.withColumns({"_c": F.cos(angle), "_s": F.sin(angle)})


def sinusoid(regular: DataFrame, interval: float, period: Column | float = "period_h") -> DataFrame:
    """a, b, c of a cos + b sin + c by least squares at the period (a number, or a column of regular), amplitude and phase."""
    p = F.col(period) if isinstance(period, str) else F.lit(period)
    x = _cos_sin(regular.withColumn("_p", p), F.col("idx") * (TAU * interval / 3600 / p))
    base = ["_c", "_s", "_1"]
    x = x.withColumn("_1", F.lit(1.0))
    sums = {f"m{i}{j}": F.sum(F.col(base[i]) * F.col(base[j])) for i in range(3) for j in range(i, 3)} | {f"y{i}": F.sum(F.col(base[i]) * F.col("value")) for i in range(3)}
    m = x.groupBy(*KEYS, F.col("_p").alias("period_h")).agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("yy"), *(v.alias(k) for k, v in sums.items()))
    at = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")
    a, b, c = solve3([[at(i, j) for j in range(3)] for i in range(3)], [F.col(f"y{i}") for i in range(3)])
    m = m.withColumns({"a": a, "b": b, "c": c})
    return m.withColumns({"amplitude": F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")), "phase": F.atan2("b", "a")})


def fitted_curve(regular: DataFrame, fit: DataFrame, interval: float) -> DataFrame:
    """idx, fitted and its values scaled to 0 .. 1 over the series."""
    x = regular.join(fit.select(*KEYS, "period_h", "a", "b", "c"), list(KEYS))
    angle = F.col("idx") * (TAU * interval / 3600 / F.col("period_h"))
    x = x.withColumn("fitted", F.col("a") * F.cos(angle) + F.col("b") * F.sin(angle) + F.col("c"))
    low, high = F.min("fitted").over(_whole()), F.max("fitted").over(_whole())
    return x.select(*KEYS, "idx", "fitted", ((F.col("fitted") - low) / (high - low + 1e-10)).alias("scaled"))


def phases(curve: DataFrame, interval: float, threshold: float = 0.5) -> DataFrame:
    """Wake and sleep phases: from an onset to the next opposite one; the parts before the first and after the last onset are dropped."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    x = curve.withColumn("wake", (F.col("scaled") > threshold).cast("int")).withColumn("_was", F.lag("wake").over(w))
    onsets = x.where("wake <> _was").select(*KEYS, "idx", "wake", F.lead("idx").over(w).alias("end_idx")).where("end_idx is not null")
    hours = interval / 3600
    return onsets.select(*KEYS, F.when(F.col("wake") == 1, "wake").otherwise("sleep").alias("phase"), (F.col("idx") * hours).alias("start_h"), (F.col("end_idx") * hours).alias("end_h"), ((F.col("end_idx") - F.col("idx")) * hours).alias("duration_h"))


def phase_shares(curve: DataFrame, threshold: float = 0.5) -> DataFrame:
    wake = F.avg((F.col("scaled") > threshold).cast("double"))
    return curve.groupBy(*KEYS).agg(wake.alias("wake_fraction"), (1 - wake).alias("sleep_fraction"))


def fisher_summary(samples: DataFrame, interval: float, low: float = 12, high: float = 36, alpha: float = ALPHA) -> DataFrame:
    """Resampled length, mean and deviation of each series, its dominant period, and its phases where that is significant; else an error."""
    regular = binning.resample(samples, interval)
    basic = regular.groupBy(*KEYS).agg(F.count("*").alias("bins"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    best = dominant_period(fisher_periodogram(regular, interval, low, high), alpha)
    strong = regular.join(best.where("significant").select(*KEYS, "period_h"), list(KEYS))
    fit = sinusoid(strong, interval)
    curve = fitted_curve(regular, fit, interval)
    count = phases(curve, interval).groupBy(*KEYS).agg(F.count_if(F.col("phase") == "wake").alias("wake_phases"), F.count_if(F.col("phase") == "sleep").alias("sleep_phases"))
    out = basic.join(best.drop("n"), list(KEYS), "left").join(fit.select(*KEYS, "amplitude", "phase"), list(KEYS), "left").join(phase_shares(curve), list(KEYS), "left").join(count, list(KEYS), "left")
    return out.withColumn("error", F.when(F.col("bins") < LEAST, "too few samples"))


def window_weight(name: str | None, i: Column, n: Column) -> Column:
    """Symmetric windows: hann, hamming, blackman, or none."""
    x = i * TAU / F.greatest(F.lit(1), n - 1)
    forms = {"hann": 0.5 - 0.5 * F.cos(x), "hamming": 0.54 - 0.46 * F.cos(x), "blackman": 0.42 - 0.5 * F.cos(x) + 0.08 * F.cos(2 * x)}
    return forms.get(name, F.lit(1.0))


def linear_residual(rows: DataFrame, column: str, keys: tuple[str, ...] = KEYS) -> Column:
    w = Window.partitionBy(*keys)
    return F.col(column) - (F.regr_slope(column, "idx").over(w) * F.col("idx") + F.regr_intercept(column, "idx").over(w))


def series_arrays(regular: DataFrame) -> DataFrame:
    """A row for each series with its values in the order of idx."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return regular.groupBy(*KEYS).agg(F.transform(ordered, lambda p: p["value"]).alias("values"))


def _weights(name: str | None, n: int) -> np.ndarray:
    x = np.arange(n) * (TAU / max(1, n - 1))
    forms = {"hann": lambda: 0.5 - 0.5 * np.cos(x), "hamming": lambda: 0.54 - 0.46 * np.cos(x), "blackman": lambda: 0.42 - 0.5 * np.cos(x) + 0.08 * np.cos(2 * x)}
    return forms.get(name, lambda: np.ones(n))()


#: Products of samples and bins up to which a band's bins are summed one by one instead of taken from a transform.
DIRECT = 1 << 15


def band_power(values: np.ndarray, window: str | None, size: int, first: int, last: int, direct: int = DIRECT) -> np.ndarray:
    """Power of the detrended, weighted, zero-padded values at bins first .. last: by sums where the band is narrow, else by a real transform of size numbers."""
    n = len(values)
    i = np.arange(n) - (n - 1) / 2
    x = (values - values.mean() - i * ((i @ values) / max(i @ i, 1e-300))) * _weights(window, n)
    if (last - first + 1) * n <= direct:
        angle = np.outer(np.arange(first, last + 1), np.arange(n)) % size * (TAU / size)
        return (np.cos(angle) @ x) ** 2 + (np.sin(angle) @ x) ** 2
    found = np.fft.rfft(x, size)[first : last + 1]
    return found.real**2 + found.imag**2


def _banded(series: DataFrame, interval: float, low: float, high: float) -> tuple[DataFrame, Column]:
    """series (n) with the padded size of its transform, first and last bin between low and high hours; and the column of the hours of that size."""
    x = series.withColumn("size", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") * 4.0))))
    span = F.col("size") * (interval / 3600)
    return x.withColumns({"first": F.greatest(F.lit(1), F.ceil(span / high)).cast("long"), "last": F.least(F.floor(span / low), F.floor(F.col("size") / 2)).cast("long")}), span


def spectrum(regular: DataFrame, interval: float, low: float = 12, high: float = 36, window: str | None = "hann") -> DataFrame:
    """k, period_h, power at the padded transform's bins whose period is between low and high hours. A series is a row while it is transformed, so its cost is n log n however wide the band."""
    x = series_arrays(regular).withColumn("n", F.size("values").cast("long")).where(F.col("n") >= LEAST)
    x, span = _banded(x, interval, low, high)
    x = x.where("first <= last")

    @F.pandas_udf("array<double>")
    def power(values: pd.Series, size: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([band_power(np.asarray(v, float), window, int(m), a, b) for v, m, a, b in zip(values, size, first, last, strict=True)])

    out = x.select(*KEYS, "n", "size", "first", F.posexplode(power("values", "size", "first", "last")).alias("pos", "power")).withColumn("k", F.col("first") + F.col("pos"))
    return out.select(*KEYS, "n", "size", "k", (span / F.col("k")).alias("period_h"), "power")


def spectrum_best(power: DataFrame) -> DataFrame:
    """The bin of the largest power, that of the longest of equal periods."""
    best = F.max_by(F.struct("k", "period_h", "power", "n", "size"), F.struct(F.col("power"), -F.col("k")))
    return power.groupBy(*KEYS).agg(best.alias("b")).select(*KEYS, "b.*")


def shuffle_marks(seed: int, perm: int, n: int) -> np.ndarray:
    """A number for each index, no two alike: index and shuffle side by side, moved by the seed, with their bits mixed."""
    x = np.arange(n, dtype=np.uint64) + np.uint64((perm << 32) + seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permutation_test(regular: DataFrame, best: DataFrame, permutations: int = 1000, window: str | None = "hann", seed: int = 1) -> DataFrame:
    """p of the best bin: the share of shuffled series with at least its power.

    Detrending and windowing are linear, so a shuffled series' power is that of its sums with two fixed weight series,
    made once. Shuffles are ranks of a 64-bit mix of seed, shuffle and index, the same in every run. A series is a row with its
    values and weights as arrays, shuffled there; no shuffled value is a row.
    """
    x = regular.join(best.select(*KEYS, "n", "size", "k", F.col("power").alias("observed")), list(KEYS))
    angle = F.col("k") * F.col("idx") * (TAU / F.col("size"))
    weight = window_weight(window, F.col("idx"), F.col("n"))
    w = x.withColumns({"c": weight * F.cos(angle), "s": weight * F.sin(angle)})
    weights = w.select(*KEYS, "idx", "value", "observed", linear_residual(w, "c").alias("c"), linear_residual(w, "s").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "value", "c", "s")))
    series = weights.groupBy(*KEYS, "observed").agg(ordered.alias("a")).select(*KEYS, "observed", *(F.col(f"a.{c}").alias(c) for c in ("value", "c", "s")))

    @F.pandas_udf("double")
    def share(observed: pd.Series, value: pd.Series, c: pd.Series, s: pd.Series) -> pd.Series:
        p = np.zeros(len(observed))
        size = value.map(len)
        for n in size.unique():
            same = np.flatnonzero(size == n)  # series of one length are shuffled alike
            v, cs, sn = (np.stack(x.iloc[same].to_list()) for x in (value, c, s))
            for perm in range(1, permutations + 1):
                v_now = v[:, np.argsort(shuffle_marks(seed, perm, n))]
                p[same] += (v_now * cs).sum(1) ** 2 + (v_now * sn).sum(1) ** 2 >= observed.to_numpy()[same]
        return pd.Series(p / permutations)

    return series.select(*KEYS, share("observed", "value", "c", "s").alias("p"), F.lit(permutations).alias("permutations"))


def spectral_peaks(power: DataFrame, share: float = 0.1) -> DataFrame:
    """Local maxima of the band (a plateau counts at its middle), not its ends, with a prominence of at least share of the largest power; rank by power."""
    w = Window.partitionBy(*KEYS).orderBy("k")
    new = (F.lag("power").over(w).isNull()) | (F.lag("power").over(w) != F.col("power"))
    x = power.withColumn("_new", new.cast("int")).withColumn("_flat", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    flat = x.groupBy(*KEYS, "_flat", "power").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min_by("size", "k").alias("size"))
    f = Window.partitionBy(*KEYS).orderBy("_flat")
    top = flat.withColumns({"_l": F.lag("power").over(f), "_r": F.lead("power").over(f)}).where("power > _l AND power > _r")
    peaks = top.select(*KEYS, F.floor((F.col("k0") + F.col("k1")) / 2).alias("peak"), F.col("power").alias("peak_power"))
    both = peaks.join(power.select(*KEYS, "k", "power"), list(KEYS))
    edges = both.groupBy(*KEYS, "peak", "peak_power").agg(F.max(F.when((F.col("k") < F.col("peak")) & (F.col("power") > F.col("peak_power")), F.col("k"))).alias("low"), F.min(F.when((F.col("k") > F.col("peak")) & (F.col("power") > F.col("peak_power")), F.col("k"))).alias("high"), F.max("power").alias("most"))
    near = edges.join(power.select(*KEYS, "k", "power", "period_h"), list(KEYS))
    left = F.min(F.when((F.col("k") <= F.col("peak")) & (F.col("k") > F.coalesce("low", F.lit(-1))), F.col("power")))
    right = F.min(F.when((F.col("k") >= F.col("peak")) & ((F.col("k") < F.col("high")) | F.col("high").isNull()), F.col("power")))
    out = near.groupBy(*KEYS, "peak", "peak_power", "most").agg((F.col("peak_power") - F.greatest(left, right)).alias("prominence"), F.max(F.when(F.col("k") == F.col("peak"), F.col("period_h"))).alias("period_h"))
    out = out.where(F.col("prominence") >= share * F.col("most"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("peak_power"), "peak"))
    return out.select(*KEYS, rank.alias("rank"), "period_h", F.col("peak_power").alias("power"), "prominence")


def peak_count(power: np.ndarray, share: float = 0.1) -> int:
    """How many peaks spectral_peaks finds in the powers of a band."""
    start = np.flatnonzero(np.append(True, power[1:] != power[:-1]))
    level, end = power[start], np.append(start[1:], len(power)) - 1
    count = 0
    for i in np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1:
        at, higher = (start[i] + end[i]) // 2, np.flatnonzero(power > level[i])
        low, high = higher[higher < at].max(initial=-1), higher[higher > at].min(initial=len(power))
        count += level[i] - max(power[low + 1 : at + 1].min(), power[at:high].min()) >= share * power.max()
    return int(count)


#: Numbers of series that are shuffled at once.
TOGETHER = 1 << 20


def _share_as_strong(v: np.ndarray, k: np.ndarray, observed: np.ndarray, size: int, permutations: int, window: str | None, seed: int) -> np.ndarray:
    """permutation_test's p of series of one length, the rows of v, at their bins k."""
    n = v.shape[1]
    kinds, which = np.unique(k, return_inverse=True)
    i = np.arange(n) - (n - 1) / 2
    angle = kinds[:, None] * np.arange(n) * (TAU / size)
    weights = []
    for x in (_weights(window, n) * np.cos(angle), _weights(window, n) * np.sin(angle)):
        weights.append((x - x.mean(1, keepdims=True) - i * ((x @ i) / (i @ i))[:, None])[which])
    hits = np.zeros(len(v))
    for perm in range(1, permutations + 1):
        now = v[:, np.argsort(shuffle_marks(seed, perm, n))]
        hits += sum((now * x).sum(1) ** 2 for x in weights) >= observed
    return hits / permutations


def _figures(v: np.ndarray, first: int, last: int, size: int, permutations: int, window: str | None, seed: int) -> np.ndarray:
    """Mean and deviation of series of one length, the rows of v; where there is a band (first isn't 0) also the best bin, its power, the number of peaks and p."""
    mean = v.cumsum(1)[:, -1] / v.shape[1]
    out = [mean, np.sqrt(((v - mean[:, None]) ** 2).mean(1))]
    if first:
        power = np.stack([band_power(x, window, size, first, last) for x in v])
        at = power.argmax(1)
        best = power[np.arange(len(v)), at]
        out += [first + at, best, [peak_count(x) for x in power], _share_as_strong(v, first + at, best, size, permutations, window, seed)]
    return np.stack(out, 1).astype(float)


def fourier_summary(samples: DataFrame, interval: float, low: float = 12, high: float = 36, permutations: int = 1000, window: str | None = "hann", alpha: float = ALPHA, seed: int = 1) -> DataFrame:
    """Best period of each series with its p and peaks. A series of fewer than 10 samples or bins, or of no bin in the range, has an error instead, and isn't significant.

    A series is a row with its values from the first bin on: samples are shuffled once, and spectrum, peaks and permutation test follow in the same task, for series of one length together.
    """
    x = binning.resampled_arrays(samples, interval).withColumn("n", F.size("values").cast("long"))
    x, span = _banded(x, interval, low, high)
    fits = (F.col("samples") >= LEAST) & (F.col("n") >= LEAST) & (F.col("first") <= F.col("last"))

    @F.pandas_udf("array<double>")
    def figures(values: pd.Series, first: pd.Series, last: pd.Series, size: pd.Series) -> pd.Series:
        out = np.empty(len(values), object)
        for (n, a), rows in first.groupby([values.map(len).to_numpy(), first.to_numpy()]).indices.items():
            for part in np.array_split(rows, -(-len(rows) * n // TOGETHER)):
                if len(part):
                    found = _figures(np.stack(values.iloc[part].to_list()), int(a), int(last.iloc[part[0]]), int(size.iloc[part[0]]), permutations, window, seed)
                    for i, figure in zip(part, found, strict=True):
                        out[i] = figure
        return pd.Series(out)

    x = x.withColumn("_f", figures("values", F.when(fits, F.col("first")).otherwise(0), "last", "size"))
    mean, std, k, power, peaks, p = (F.get("_f", F.lit(i)) for i in range(6))
    error = F.when((F.col("samples") < LEAST) | (F.col("n") < LEAST), "too few samples").when(power.isNull(), "no period in range")
    return x.select(
        *KEYS, "samples", "n", mean.alias("mean"), std.alias("std"), (span / k).alias("period_h"), power.alias("power"), p.alias("p"), peaks.cast("long").alias("peaks"),
        F.coalesce(p < alpha, F.lit(False)).alias("significant"), error.alias("error"),
    )


def method_agreement(fisher: DataFrame, fourier: DataFrame, hours: float = 2.0) -> DataFrame:
    """Share of series whose two periods differ by less than hours; mean and deviation of the differences."""
    both = fisher.select(*KEYS, F.col("period_h").alias("f")).join(fourier.select(*KEYS, F.col("period_h").alias("g")), list(KEYS)).where("f > 0 AND g > 0")
    gap = F.abs(F.col("f") - F.col("g"))
    return both.groupBy("run_id").agg(F.count("*").alias("compared"), F.count_if(gap < hours).alias("agree"), (F.count_if(gap < hours) * 100 / F.count("*")).alias("agree_percent"), F.avg(gap).alias("mean_gap"), F.stddev_pop(gap).alias("std_gap"))


def t_quantile(df: Column, p: float = 0.975) -> Column:
    """Quantile of Student's t; null where there are no degrees of freedom."""

    @F.pandas_udf("double")
    def of(v: pd.Series) -> pd.Series:
        kinds, which = np.unique(v.to_numpy(float), return_inverse=True)
        return pd.Series(student.quantile(kinds, p)[which]).astype(object).where(lambda x: x.notna(), None)

    return of(df.cast("double"))


def cosinor(regular: DataFrame, interval: float, period: float | str) -> DataFrame:
    """Mesor, beta, gamma, amplitude, acrophase, peak time, F, p, R2, standard errors and half-widths of 95 % intervals of a cosine at the period."""
    m = sinusoid(regular, interval, period)
    n, rest = F.col("n"), F.when(F.col("n") > 3, F.col("n") - 3)
    m = m.withColumns({"mesor": F.col("c"), "beta": F.col("a"), "gamma": F.col("b")})
    m = m.withColumns({"tss": F.col("yy") - F.col("y2") * F.col("y2") / n, "rss": F.col("yy") - F.col("beta") * F.col("y0") - F.col("gamma") * F.col("y1") - F.col("mesor") * F.col("y2")})
    f = ratio((F.col("tss") - F.col("rss")) / 2, F.col("rss") / rest)
    det = F.col("m00") * (F.col("m11") * F.col("m22") - F.col("m12") * F.col("m12")) - F.col("m01") * (F.col("m01") * F.col("m22") - F.col("m12") * F.col("m02")) + F.col("m02") * (F.col("m01") * F.col("m12") - F.col("m11") * F.col("m02"))
    s2 = F.col("rss") / rest
    v = lambda x: s2 * F.try_divide(x, det)
    vbb, vgg = v(F.col("m11") * F.col("m22") - F.col("m12") * F.col("m12")), v(F.col("m00") * F.col("m22") - F.col("m02") * F.col("m02"))
    vbg, vmm = v(F.col("m02") * F.col("m12") - F.col("m01") * F.col("m22")), v(F.col("m00") * F.col("m11") - F.col("m01") * F.col("m01"))
    a2 = F.col("amplitude") * F.col("amplitude")
    se_a = F.sqrt(F.try_divide(F.col("beta") * F.col("beta") * vbb + 2 * F.col("beta") * F.col("gamma") * vbg + F.col("gamma") * F.col("gamma") * vgg, a2))
    se_p = F.sqrt(F.try_divide(F.col("gamma") * F.col("gamma") * vbb - 2 * F.col("beta") * F.col("gamma") * vbg + F.col("beta") * F.col("beta") * vgg, a2 * a2))
    acro = F.atan2(-F.col("gamma"), F.col("beta"))
    m = m.withColumns({"acrophase": acro, "f": f, "r2": 1 - ratio(F.col("rss"), F.col("tss"), 1.0), "se_mesor": F.sqrt(vmm), "se_amplitude": se_a, "se_acrophase": se_p})
    m = m.withColumns({"p": F.pow(1 + 2 * F.col("f") / rest, -rest / 2), "peak_h": F.pmod(-F.col("acrophase") * F.col("period_h") / TAU, F.col("period_h")), "_t": t_quantile(rest)})
    m = m.withColumns({"amplitude_half_width": F.col("_t") * F.col("se_amplitude"), "acrophase_half_width": F.col("_t") * F.col("se_acrophase")})
    return m.select(*KEYS, "n", "period_h", "mesor", "beta", "gamma", "amplitude", "acrophase", "peak_h", "f", "p", "r2", "se_mesor", "se_amplitude", "se_acrophase", "amplitude_half_width", "acrophase_half_width")


def period_choice(low: float, high: float) -> list[float]:
    """Test periods: 12, 24 and 30 h where inside, the ends and the middle."""
    return sorted({p for p in (12.0, 24.0, 30.0) if low <= p <= high} | {float(low), (low + high) / 2, float(high)})


def cosinor_periods(regular: DataFrame, interval: float, periods: list[float]) -> DataFrame:
    """cosinor at each test period, with best: the one of the largest R2, the shortest on ties."""
    rows = regular.withColumn("period_h", F.explode(F.array(*(F.lit(p) for p in periods))))
    out = cosinor(rows, interval, "period_h")
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("r2"), "period_h"))
    return out.withColumn("best", rank == 1)


def population_cosinor(regular: DataFrame, interval: float, periods: list[float], alpha: float = ALPHA) -> DataFrame:
    """Mean of the series' vectors at the median of their best periods."""
    best = cosinor_periods(regular, interval, periods).where("best")
    middle = best.groupBy("run_id").agg(F.expr("percentile(period_h, 0.5)").alias("period_h"))
    fit = cosinor(regular.join(middle, "run_id"), interval, "period_h")
    m = fit.groupBy("run_id", "period_h").agg(F.count("*").alias("n"), F.avg("mesor").alias("mesor"), F.avg("beta").alias("_b"), F.avg("gamma").alias("_g"), F.count_if(F.col("p") < alpha).alias("significant"))
    return m.select("run_id", "period_h", "n", "mesor", F.sqrt(F.col("_b") * F.col("_b") + F.col("_g") * F.col("_g")).alias("amplitude"), F.atan2(-F.col("_g"), F.col("_b")).alias("acrophase"), "significant", (F.col("significant") / F.col("n")).alias("proportion"))


def boundary_diagnostics(power: DataFrame, periods: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Signs that a range of periods doesn't fit a run. power: spectra of its series; periods: cosinors at all test periods, with best.

    at_edge: series with peaks whose best period is nearer to an end of the spectrum's periods than 5 % of their width; a warning above 30 % of the series with a
    spectrum. mismatches: series whose highest peak lies over half an hour off the best period, with 0.9 of its power at least. cosinor_at_edge: significant
    series whose best test period is the first or last one; a warning above 30 % of these. A hint needs three significant series.
    """
    best, peaks = spectrum_best(power), spectral_peaks(power).where("rank = 1").select(*KEYS, F.col("period_h").alias("peak_h"), F.col("power").alias("peak_power"))
    ends = power.groupBy(*KEYS).agg(F.min("period_h").alias("low"), F.max("period_h").alias("high"))
    each = best.join(ends, list(KEYS)).join(peaks, list(KEYS), "left")
    gap, width = (lambda c: F.abs(F.col("period_h") - F.col(c))), 0.05 * (F.col("high") - F.col("low"))
    edge = F.col("peak_h").isNotNull() & ((gap("high") < width) | (gap("low") < width))
    off = (gap("peak_h") > 0.5) & (F.col("peak_power") >= 0.9 * F.col("power"))
    a = each.groupBy("run_id").agg(F.count("*").alias("series"), F.count_if(edge).alias("at_edge"), F.count_if(off).alias("mismatches"))
    tested = periods.groupBy("run_id").agg(F.min("period_h").alias("test_low"), F.max("period_h").alias("test_high"))
    good = periods.where(F.col("best") & (F.col("p") < alpha)).join(tested, "run_id")
    b = good.groupBy("run_id", "test_low", "test_high").agg(F.count("*").alias("significant"), F.count_if((F.col("period_h") == F.col("test_low")) | (F.col("period_h") == F.col("test_high"))).alias("cosinor_at_edge"), F.min("period_h").alias("least"), F.max("period_h").alias("most"))
    many = F.col("significant") >= 3
    hint = F.when(many & (F.col("most") > 12) & (F.col("test_high") < 24), "consider a test period of 24 h").when(many & (F.col("least") < 2) & (F.col("test_low") > 1), "consider test periods of 0.5 to 1 h")
    out = a.join(b.withColumn("hint", hint), "run_id", "left").fillna(0, ["significant", "cosinor_at_edge"])
    return out.select(
        "run_id", "series", "at_edge", (F.col("at_edge") > 0.3 * F.col("series")).alias("edge_warning"), "mismatches", (F.col("mismatches") > 0).alias("mismatch_warning"),
        "significant", "cosinor_at_edge", ((F.col("cosinor_at_edge") > 0.3 * F.col("significant")) & (F.col("significant") > 0)).alias("cosinor_warning"), "hint",
    )


def significance_summary(results: DataFrame) -> DataFrame:
    """Number of series and how many, and what share, are significant."""
    return results.groupBy("run_id").agg(F.count("*").alias("series"), F.count_if(F.col("significant")).alias("significant"), (F.count_if(F.col("significant")) * 100 / F.count("*")).alias("percent"))


def rhythm(samples: DataFrame, method: str, interval: float, low: float = 12, high: float = 36, *, old_interval: float | None = None, hours: tuple[float, float] | None = None, **options) -> DataFrame:
    """Runs one method on series: re-binned if the interval is larger than the old one, cut to hours if given."""
    from tempora.operators import pairs

    rows = samples if hours is None else binning.between_hours(samples, *hours)
    if old_interval is not None and interval > old_interval:
        rows = binning.rebin(rows, old_interval, interval)
    regular = binning.resample(rows, interval)
    middle = (low + high) / 2
    kinds = {
        "fisher": lambda: fisher_summary(rows, interval, low, high, **options), "fourier": lambda: fourier_summary(rows, interval, low, high, **options),
        "cosinor": lambda: cosinor_periods(regular, interval, period_choice(low, high), **options),
        "similarity": lambda: pairs.correlation(regular, interval, high / 2, **options), "coherence": lambda: pairs.coherence(regular, interval, middle, **options),
        "phase": lambda: pairs.phase_clusters(regular, middle, **options),
    }
    if method not in kinds:
        raise ValueError(f"unknown method {method!r}: {', '.join(kinds)}")
    return kinds[method]()
