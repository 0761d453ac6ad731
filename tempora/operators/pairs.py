"""Comparison of the series of a run, two at a time: correlation, coherence, phase; clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.fits import ratio
from tempora.operators.rhythm import series_arrays, sinusoid
from tempora.sources.tables import KEYS, stored

PAIR = ("run_id", "roi1", "roi2")
TAU = 2 * math.pi


#: Blocks of a run's series whose pairs meet in one partition.
PAIR_BLOCKS = 4


def met(left: DataFrame, right: DataFrame, on: tuple[str, ...], blocks: int = PAIR_BLOCKS) -> DataFrame:
    """All pairs of rows of a run with equal columns `on`, roi1 < roi2. A run's pairs are spread over blocks squared keys. left has roi1, right roi2."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks).cast("long"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = left.withColumns({"b1": block("roi1")}).withColumn("b2", every)
    b = right.withColumns({"b2": block("roi2")}).withColumn("b1", every)
    return a.join(b, ["run_id", *on, "b1", "b2"]).where("roi1 < roi2").drop("b1", "b2")


def pair_arrays(regular: DataFrame, blocks: int = PAIR_BLOCKS) -> DataFrame:
    """x, y, n of each pair roi1 < roi2: arrays cut to the shorter series, of 10 values at least."""
    s = series_arrays(regular)
    a, b = s.select("run_id", F.col("roi").alias("roi1"), F.col("values").alias("x")), s.select("run_id", F.col("roi").alias("roi2"), F.col("values").alias("y"))
    both = met(a, b, (), blocks).withColumn("n", F.least(F.size("x"), F.size("y"))).where("n >= 10")
    return both.select(*PAIR, "n", F.slice("x", 1, F.col("n")).alias("x"), F.slice("y", 1, F.col("n")).alias("y"))


def lagged_products(x: np.ndarray, y: np.ndarray, low: int, high: int) -> np.ndarray:
    """sum of x[l] y[l - lag] / n of the standard scores, for each lag from low to high; by transforms where lags are many."""
    n = len(x)
    x, y = ((v - v.mean()) / (v.std() + 1e-10) for v in (x, y))
    if (high - low) * n < 1 << 20:
        return np.array([x[max(0, d) : n + min(0, d)] @ y[max(0, -d) : n - max(0, d)] for d in range(low, high + 1)]) / n
    size = 1 << (2 * n - 1).bit_length()
    whole = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    return whole[np.arange(low, high + 1) % size] / n


def cross_correlation(regular: DataFrame, interval: float, max_lag_h: float = 12) -> DataFrame:
    """lag (samples), correlation of each pair: sum of z1[l] z2[l - lag] / n. A positive lag means that roi1 is later.

    Pairs are rows with both series as arrays; no lag is a row before it has its correlation.
    """
    cap = int(max_lag_h * 3600 / interval)

    @F.pandas_udf("array<double>")
    def lags(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            n = len(a)
            most = min(cap, n // 2)
            # The centred form of length n has no lag of +n/2 if n is even.
            high = most - 1 if most == n // 2 and n % 2 == 0 else most
            out.append(lagged_products(np.asarray(a, float), np.asarray(b, float), -most, high))
        return pd.Series(out)

    p = pair_arrays(regular).withColumn("lags", lags("x", "y"))
    p = p.select(*PAIR, "n", F.posexplode("lags").alias("pos", "correlation"))
    return p.select(*PAIR, "n", (F.col("pos") - F.least(F.lit(cap), F.floor(F.col("n") / 2))).cast("int").alias("lag"), "correlation")


def correlation(regular: DataFrame, interval: float, max_lag_h: float = 12, similar: float = 0.5) -> DataFrame:
    """Largest correlation of each pair (the first lag on ties), its lag in hours, and that at no lag."""
    c = cross_correlation(regular, interval, max_lag_h)
    best = F.max_by(F.struct("lag", "correlation"), F.struct(F.col("correlation"), -F.col("lag")))
    m = c.groupBy(*PAIR, "n").agg(best.alias("b"), F.max(F.when(F.col("lag") == 0, F.col("correlation"))).alias("zero_lag"))
    return m.select(*PAIR, "n", F.col("b.correlation").alias("correlation"), (F.col("b.lag") * (interval / 3600)).alias("lag_h"), "zero_lag", (F.col("b.correlation") > similar).alias("similar"))


def matrix(pairs: DataFrame, value: str, diagonal: float, sign: int = 1) -> DataFrame:
    """run_id, roi1, roi2, value of the whole square: pairs, their mirror images (sign -1: negated) and the diagonal."""
    cell = lambda i, j, v: F.struct(F.col(i).alias("roi1"), F.col(j).alias("roi2"), v.cast("double").alias("value"))
    v, one = F.col(value), F.lit(float(diagonal))
    cells = F.explode(F.array(cell("roi1", "roi2", v), cell("roi2", "roi1", sign * v), cell("roi1", "roi1", one), cell("roi2", "roi2", one)))
    return pairs.select("run_id", cells.alias("c")).select("run_id", "c.*").groupBy(*PAIR).agg(F.first("value").alias("value"))  # pairs are worked out once


def wide_matrix(square: DataFrame, rois: list) -> DataFrame:
    return square.groupBy("run_id", "roi1").pivot("roi2", rois).agg(F.first("value"))


def similar_pairs(correlations: DataFrame, threshold: float = 0.7, sync_hours: float = 1.0) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("correlation"), "roi1", "roi2"))
    return correlations.where(F.col("correlation") >= threshold).select(*PAIR, "correlation", "lag_h", (F.abs("lag_h") < sync_hours).alias("synchronized"), rank.alias("rank"))


def pair_status(correlations: DataFrame) -> DataFrame:
    status = F.when(F.col("correlation") > 0.7, "Synchronized").when(F.col("correlation") > 0.3, "Moderate").otherwise("Low")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("correlation"), "roi1", "roi2"))
    return correlations.select(*PAIR, "correlation", "lag_h", status.alias("status"), rank.alias("rank"))


def similarity_summary(correlations: DataFrame, top: int = 5, threshold: float = 0.7, sync_hours: float = 1.0) -> DataFrame:
    """A run's pairs, the similar ones (of the threshold and more) and those of them that are synchronized, with a row for each of the top similar pairs; a run without any has one row."""
    similar = similar_pairs(correlations, threshold, sync_hours)
    found = similar.groupBy("run_id").agg(F.count("*").alias("similar_pairs"), F.count_if("synchronized").alias("synchronized_pairs"))
    counts = correlations.groupBy("run_id").agg(F.count("*").alias("pairs")).join(found, "run_id", "left").fillna(0, ["similar_pairs", "synchronized_pairs"])
    return counts.join(similar.where(F.col("rank") <= top), "run_id", "left").select("run_id", "pairs", "similar_pairs", "synchronized_pairs", "rank", "roi1", "roi2", "correlation", "lag_h", "synchronized")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """run_id, cluster, size and the members' rois of each cluster."""
    return clustered.groupBy("run_id", "cluster").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list(F.col("roi").cast("string"))), ",").alias("rois"))


def merges(distance: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Hierarchical merges (a member of either cluster, height) by nearest-neighbour chains: each step extends the chain or merges its last two, so the work is quadratic."""
    n = len(distance)
    d = distance.astype(float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, out = np.ones(n), np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        i = chain[-1]
        j = int(np.argmin(d[i]))
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:  # ties go back, so that the chain ends
            j = chain[-2]
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        a, b, nearest = size[i], size[j], d[i, j]
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.where(np.isinf(d[i]) | np.isinf(d[j]), np.inf, np.maximum(d[i], d[j]))
        elif method == "ward":
            new = ((a + size) * d[i] + (b + size) * d[j] - size * nearest) / (a + b + size)
        else:
            new = (a * d[i] + b * d[j]) / (a + b)
        out.append((i, j, nearest))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i], alive[j] = a + b, False
    return out


def linkage_clusters(distance: np.ndarray, cut: float, method: str = "average") -> np.ndarray:
    """Cluster numbers from 1, in order of first member: what merges at a height of cut at most."""
    parent = list(range(len(distance)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j, height in merges(distance, method):
        if height <= (cut * cut if method == "ward" else cut):
            i, j = find(i), find(j)
            parent[max(i, j)] = min(i, j)
    label = np.array([find(i) for i in range(len(distance))])
    return np.unique(label, return_inverse=True)[1] + 1


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest of edges (run_id, roi1, roi2, distance), and (run_id, roi, root): the least roi of each tree.

    In each round every tree takes its shortest edge to another one (ties: the first pair), and what is so joined is one tree; the number of
    trees at least halves. These edges are the merges of single linkage, their distances its heights.
    """
    taken, roots = [], None
    left = stored(edges.select(*PAIR, "distance", F.col("roi1").alias("a"), F.col("roi2").alias("b")))
    while not left.isEmpty():
        side = lambda t: left.select("run_id", F.col(t).alias("tree"), F.struct("distance", "roi1", "roi2").alias("edge"), F.col("b" if t == "a" else "a").alias("to"))  # noqa: B023,E731
        best = stored(side("a").unionByName(side("b")).groupBy("run_id", "tree").agg(F.min(F.struct("edge", "to")).alias("m")).select("run_id", "tree", "m.edge", "m.to"))
        taken.append(best.select("run_id", "edge.roi1", "edge.roi2", "edge.distance").distinct())
        # Two trees that take one edge point at each other; the lesser is the root, all others lead there.
        back = best.select("run_id", F.col("tree").alias("to"), F.col("to").alias("again"))
        to = stored(best.join(back, ["run_id", "to"]).select("run_id", "tree", F.when((F.col("again") == F.col("tree")) & (F.col("tree") < F.col("to")), F.col("tree")).otherwise(F.col("to")).alias("to")))
        while True:
            step = to.select("run_id", F.col("tree").alias("to"), F.col("to").alias("next"))
            further = stored(to.join(step, ["run_id", "to"]).select("run_id", "tree", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            to = further.drop("moved")
            if further.where("moved").isEmpty():
                break
        if roots is None:
            roots = to.select("run_id", F.col("tree").alias("roi"), F.col("to").alias("root"))
        else:
            roots = stored(roots.join(to.select("run_id", F.col("tree").alias("root"), "to"), ["run_id", "root"], "left").select("run_id", "roi", F.coalesce("to", "root").alias("root")))
        at = lambda c: to.select("run_id", F.col("tree").alias(c), F.col("to").alias(f"_{c}"))  # noqa: B023,E731
        left = stored(left.join(at("a"), ["run_id", "a"]).join(at("b"), ["run_id", "b"]).where("_a <> _b").select(*PAIR, "distance", F.col("_a").alias("a"), F.col("_b").alias("b")))
    forest = taken[0] if taken else left.select(*PAIR, "distance")
    for more in taken[1:]:
        forest = forest.unionByName(more)
    if roots is None:
        return forest, left.select("run_id", F.col("roi1").alias("roi"), F.col("a").alias("root"))
    least = roots.groupBy("run_id", "root").agg(F.min("roi").alias("least"))
    return forest, roots.join(least, ["run_id", "root"]).select("run_id", "roi", F.col("least").alias("root"))


def clusters(correlations: DataFrame, method: str = "average", cut: float = 0.5) -> DataFrame:
    """roi, cluster, size: hierarchical clusters of distance 1 - correlation.

    Single linkage is a spanning forest worked out by joins, however many series a run has. The merges of the other three are sequential:
    a run is a task, which holds the square of its series and works on it once; runs are parallel.
    """
    if method not in ("average", "single", "complete", "ward"):
        raise ValueError(f"unknown linkage {method!r}")
    if method == "single":
        rois = correlations.select("run_id", F.explode(F.array("roi1", "roi2")).alias("roi")).distinct()
        _, roots = spanning_forest(correlations.select(*PAIR, (1 - F.col("correlation")).alias("distance")).where(F.col("distance") <= cut))
        rooted = rois.join(roots, ["run_id", "roi"], "left").select("run_id", "roi", F.coalesce("root", "roi").alias("root"))
        named = rooted.groupBy("run_id", "root").agg(F.count("*").alias("size"))
        named = named.withColumn("cluster", F.row_number().over(Window.partitionBy("run_id").orderBy("root")).cast("long"))
        return rooted.join(named, ["run_id", "root"]).select("run_id", "roi", "cluster", "size")
    kind = correlations.schema["roi1"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(rows.roi1) | set(rows.roi2))
        at = {r: k for k, r in enumerate(ids)}
        d = np.ones((len(ids), len(ids)))
        i, j = rows.roi1.map(at).to_numpy(), rows.roi2.map(at).to_numpy()
        d[i, j] = d[j, i] = 1 - rows.correlation.to_numpy()
        label = linkage_clusters(d, cut, method)
        return pd.DataFrame({"run_id": rows.run_id.iloc[0], "roi": ids, "cluster": label, "size": np.bincount(label)[label]})

    return correlations.select(*PAIR, "correlation").groupBy("run_id").applyInPandas(run, f"run_id string, roi {kind}, cluster long, size long")


def phase_difference(regular: DataFrame, interval: float, period: float) -> DataFrame:
    """Phase of roi2 less that of roi1 at the period, wrapped, in radians and hours."""
    f = sinusoid(regular, interval, period).select("run_id", "roi", "phase", "amplitude")
    a, b = (f.select("run_id", *(F.col(c).alias(f"{c}{k}") for c in ("roi", "phase", "amplitude"))) for k in (1, 2))
    both = a.join(b, "run_id").where("roi1 < roi2")
    gap = F.col("phase2") - F.col("phase1")
    both = both.withColumn("radians", F.atan2(F.sin(gap), F.cos(gap))).withColumn("hours", F.col("radians") / TAU * period)
    return both.select(*PAIR, "radians", "hours", "amplitude1", "amplitude2", (F.abs("hours") < 0.25 * period).alias("in_phase"), (F.abs("hours") > 0.75 * period).alias("anti_phase"))


#: Segments of a series whose spectra are a row.
SPECTRA = 64


def segment_size(n: Column) -> Column:
    return F.least(n, F.greatest(F.lit(16), F.least(F.lit(256), F.floor(n / 8)))).cast("int")


def segment_count(n: Column, size: Column) -> Column:
    step = size - F.floor(size / 2)
    return F.floor((n - (size - step)) / step).cast("int")


def segment_spectra(regular: DataFrame, rows: int = SPECTRA) -> DataFrame:
    """run_id, roi, n, size, part, re, im: spectra of half-overlapping Hann segments of each series, up to `rows` of them a row, one after another.

    A segment's size follows from the shorter series of a pair, so a series has spectra for its own size and for those of the shorter ones of its run.
    """
    s = series_arrays(regular).withColumn("n", F.size("values")).where("n >= 10")
    sizes = s.groupBy("run_id", segment_size(F.col("n")).alias("size")).agg(F.min("n").alias("least")).groupBy("run_id").agg(F.collect_list(F.struct("size", "least")).alias("sizes"))
    needed = F.transform(F.filter("sizes", lambda x: x["least"] <= F.col("n")), lambda x: x["size"])
    kind = regular.schema["roi"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                values = np.asarray(r.values_, float)
                for size in sorted(r.sizes):
                    step = size - size // 2
                    count = (len(values) - (size - step)) // step
                    hann = 0.5 - 0.5 * np.cos(np.arange(size) * (TAU / size))
                    windows = np.lib.stride_tricks.sliding_window_view(values, size)[::step][:count]
                    for part, low in enumerate(range(0, count, rows)):
                        x = windows[low : low + rows]
                        found = np.fft.rfft((x - x.mean(1, keepdims=True)) * hann, axis=1)
                        yield pd.DataFrame({"run_id": [r.run_id], "roi": [r.roi], "n": [r.n], "size": [size], "part": [part], "re": [found.real.ravel()], "im": [found.imag.ravel()]})

    each = s.join(sizes, "run_id").select("run_id", "roi", "n", F.col("values").alias("values_"), needed.alias("sizes"))
    return each.mapInPandas(run, f"run_id string, roi {kind}, n int, size int, part int, re array<double>, im array<double>")


def coherence_spectrum(regular: DataFrame, interval: float, rows: int = SPECTRA) -> DataFrame:
    """k, period_h (0 for the constant), coherence by averaged half-overlapping Hann segments. Transforms are made once a series; pairs only multiply them."""
    s = segment_spectra(regular, rows)
    a = s.select("run_id", "size", "part", F.col("roi").alias("roi1"), F.col("n").alias("n1"), F.col("re").alias("xr"), F.col("im").alias("xi"))
    b = s.select("run_id", "size", "part", F.col("roi").alias("roi2"), F.col("n").alias("n2"), F.col("re").alias("yr"), F.col("im").alias("yi"))
    n = F.least("n1", "n2")
    both = met(a, b, ("size", "part")).where(F.col("size") == segment_size(n)).withColumn("held", segment_count(n, F.col("size")) - F.col("part") * rows).where("held > 0")

    @F.pandas_udf("array<struct<re:double,im:double,xx:double,yy:double>>")
    def products(size: pd.Series, held: pd.Series, xr: pd.Series, xi: pd.Series, yr: pd.Series, yi: pd.Series) -> pd.Series:
        out = []
        for bins, most, *parts in zip(size // 2 + 1, held, xr, xi, yr, yi, strict=True):
            xr_, xi_, yr_, yi_ = (np.asarray(p).reshape(-1, bins)[:most] for p in parts)
            sums = ((xr_ * yr_ + xi_ * yi_).sum(0), (xr_ * yi_ - xi_ * yr_).sum(0), (xr_ * xr_ + xi_ * xi_).sum(0), (yr_ * yr_ + yi_ * yi_).sum(0))
            out.append([dict(zip(("re", "im", "xx", "yy"), v, strict=True)) for v in zip(*(x.tolist() for x in sums), strict=True)])
        return pd.Series(out)

    each = both.select(*PAIR, "size", F.posexplode(products("size", "held", "xr", "xi", "yr", "yi")).alias("k", "p"))
    m = each.groupBy(*PAIR, "size", "k").agg(*(F.sum(f"p.{c}").alias(c) for c in ("re", "im", "xx", "yy")))
    period = F.when(F.col("k") > 0, F.col("size") * (interval / 3600) / F.greatest(F.col("k"), F.lit(1))).otherwise(F.lit(0.0))
    share = F.try_divide(F.expr("re * re + im * im"), F.expr("xx * yy"))
    return m.select(*PAIR, "k", period.alias("period_h"), F.coalesce(share, F.lit(0.0)).alias("coherence"))


def coherence(regular: DataFrame, interval: float, target_h: float = 24, synchronized: float = 0.6) -> DataFrame:
    """Largest coherence within 20 % of the target period, or of all if none is there (target_in_range false), and its period."""
    s = coherence_spectrum(regular, interval)
    inside = F.col("period_h").between(0.8 * target_h, 1.2 * target_h)
    best = lambda cond: F.max_by(F.when(cond, F.struct("period_h", "coherence")), F.when(cond, F.struct(F.col("coherence"), -F.col("k"))))
    m = s.groupBy(*PAIR).agg(best(inside).alias("near"), best(F.lit(True)).alias("any"), F.max(inside).alias("target_in_range"))
    pick = lambda c: F.coalesce(F.col(f"near.{c}"), F.col(f"any.{c}"))
    return m.select(*PAIR, pick("coherence").alias("coherence"), pick("period_h").alias("period_h"), (pick("coherence") > synchronized).alias("synchronized"), F.col("any.coherence").alias("max_coherence"), F.col("any.period_h").alias("max_period_h"), "target_in_range")


def top_coherent(coherences: DataFrame, top: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("coherence"), "roi1", "roi2"))
    total = F.count("*").over(Window.partitionBy("run_id"))
    return coherences.where("synchronized").select(*PAIR, "coherence", "period_h", rank.alias("rank"), total.alias("synchronized_pairs")).where(F.col("rank") <= top)


def analytic(x: np.ndarray) -> np.ndarray:
    """The signal with its Hilbert transform as imaginary part."""
    n = len(x)
    spectrum, weight = np.fft.fft(x), np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(spectrum * weight)


def series_phases(regular: DataFrame) -> DataFrame:
    """run_id, roi, n, length, phase, amplitude: the phases of each series' analytic signal as an array, and its mean envelope.

    A pair is as long as its shorter series, so a longer one has phases for each length among the shorter ones of its run; where all are as long, one.
    """
    s = series_arrays(regular).withColumn("n", F.size("values"))
    lengths = s.groupBy("run_id").agg(F.collect_set("n").alias("lengths"))
    needed = F.filter("lengths", lambda m: m <= F.col("n"))
    kind = regular.schema["roi"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                values = np.asarray(r.values_, float)
                for length in sorted(r.lengths):
                    x = values[:length]
                    a = analytic(x - x.mean())
                    yield pd.DataFrame({"run_id": [r.run_id], "roi": [r.roi], "n": [r.n], "length": [length], "phase": [np.angle(a)], "amplitude": [np.abs(a).mean()]})

    each = s.join(lengths, "run_id").select("run_id", "roi", "n", F.col("values").alias("values_"), needed.alias("lengths"))
    return each.mapInPandas(run, f"run_id string, roi {kind}, n int, length int, phase array<double>, amplitude double")


def phase_locking(regular: DataFrame, period: float) -> DataFrame:
    """How constant the phase difference of each pair is, its circular mean in hours and its circular deviation."""
    s = series_phases(regular).where("length >= 10")
    a, b = s.select("run_id", "length", F.col("roi").alias("roi1"), F.col("n").alias("n1"), F.col("phase").alias("x")), s.select("run_id", "length", F.col("roi").alias("roi2"), F.col("n").alias("n2"), F.col("phase").alias("y"))
    both = met(a, b, ("length",)).where("length = least(n1, n2)")

    @F.pandas_udf("re double, im double")
    def mean(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = np.array([np.mean(np.exp(1j * (np.asarray(q) - np.asarray(p)))) for p, q in zip(x, y, strict=True)], complex)
        return pd.DataFrame({"re": found.real, "im": found.imag})

    m = both.select(*PAIR, mean("x", "y").alias("m")).select(*PAIR, F.sqrt(F.expr("m.re * m.re + m.im * m.im")).alias("plv"), F.atan2("m.im", "m.re").alias("radians"))
    plv = F.col("plv")
    quality = F.when(plv > 0.8, "strong").when(plv > 0.5, "moderate").when(plv > 0.3, "weak").otherwise("none")
    spread = F.when(plv > 0, F.sqrt(F.greatest(F.lit(0.0), -2 * F.ln(plv)))).otherwise(F.lit(math.pi))
    return m.select(*PAIR, "plv", (F.col("radians") / TAU * period).alias("hours"), spread.alias("phase_std"), quality.alias("quality"), (plv > 0.5).alias("synchronized"))


def series_phase(regular: DataFrame, period: float) -> DataFrame:
    """Circular mean of each series' phase in hours, and its mean envelope."""

    @F.pandas_udf("radians double, amplitude double")
    def circular(values: pd.Series) -> pd.DataFrame:
        found = [analytic(np.asarray(v, float) - np.mean(v)) for v in values]
        angles = [np.angle(a) for a in found]
        return pd.DataFrame({"radians": [np.arctan2(np.mean(np.sin(p)), np.mean(np.cos(p))) for p in angles], "amplitude": [np.abs(a).mean() for a in found]}, dtype=float)

    m = series_arrays(regular).select(*KEYS, circular("values").alias("c")).select(*KEYS, "c.radians", "c.amplitude")
    return m.withColumn("phase_h", F.pmod(F.col("radians") / TAU * period, F.lit(float(period))))


def phase_clusters(regular: DataFrame, period: float) -> DataFrame:
    """series_phase with the quarter of a day it falls in, whatever the period."""
    h = F.col("phase_h")
    kind = F.when((h >= 0) & (h < 6), "early_active").when((h >= 6) & (h < 12), "mid_active").when((h >= 12) & (h < 18), "late_active").otherwise("night_active")
    return series_phase(regular, period).withColumn("cluster", kind)


def phase_members(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("run_id", "cluster").agg(F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_list(F.col("roi").cast("string"))), ",").alias("rois"), ratio(F.sum("amplitude"), F.count("*")).alias("mean_amplitude"))
