"""Rules at their bounds, and pair operators on series of different lengths, against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import student
from tempora.operators import pairs, preprocess, rhythm, summary


def test_student_quantiles_against_tables():
    table = {1: 12.706204736174707, 2: 4.302652729749464, 3: 3.182446305283708, 5: 2.570581835636314, 10: 2.2281388519649385, 30: 2.0422724563012373, 120: 1.9799304050824413, 1000: 1.9623390808264078}
    got = student.quantile(np.array([*table, 0, -1, np.nan]))
    assert np.allclose(got[: len(table)], list(table.values()), rtol=1e-9, atol=0) and np.isnan(got[len(table) :]).all()
    assert student.quantile(np.array([1.0]), 0.75)[0] == pytest.approx(1.0, abs=1e-12)


@pytest.mark.parametrize("n", [10, 11, 255, 256, 777])
@pytest.mark.parametrize("window", ["hann", "hamming", "blackman", None])
def test_both_ways_to_a_band(n, window):
    x = np.random.default_rng(n).normal(size=n) + 0.1 * np.arange(n)
    size = 1 << math.ceil(math.log2(4 * n))
    a, b = (rhythm.band_power(x, window, size, 1, size // 2, d) for d in (0, 1 << 40))
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9 * a.max())
    slope, ground = np.polyfit(np.arange(n), x, 1)
    y = (x - slope * np.arange(n) - ground) * rhythm._weights(window, n)
    assert a[3] == pytest.approx(abs(sum(v * np.exp(-2j * np.pi * 4 * i / size) for i, v in enumerate(y))) ** 2, rel=1e-6)


def test_band_of_a_long_series():
    """100,000 samples with a band as wide as the spectrum: a sum for each bin would be 10**10 products."""
    x = np.sin(np.arange(100_000) * 0.01)
    size = 1 << 19
    power = rhythm.band_power(x, "hann", size, 1, size // 2)
    assert abs((int(power.argmax()) + 1) / size * 2 * np.pi - 0.01) < 1e-5


def regular(spark, series):
    rows = [("r", roi, i, float(v)) for roi, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, roi int, idx long, value double").repartition(3)


@pytest.fixture(scope="module")
def unequal():
    rng = np.random.default_rng(7)
    base = np.sin(np.arange(700) / 5)
    return {k: base[:n] * (k % 3) + rng.normal(size=n) for k, n in enumerate([5, 10, 17, 130, 131, 400, 400, 640, 700])}


def by_pairs(series):
    return [(a, b, series[a][:n], series[b][:n]) for a, b in itertools.combinations(sorted(series), 2) if (n := min(len(series[a]), len(series[b]))) >= 10]


@pytest.mark.parametrize("rows", [2, 64])
def test_coherence_of_unequal_series(spark, unequal, rows):
    got = {(r["roi1"], r["roi2"], r["k"]): r["coherence"] for r in pairs.coherence_spectrum(regular(spark, unequal), 3600, rows).collect()}
    want = {}
    for a, b, x, y in by_pairs(unequal):
        n = len(x)
        size = min(n, max(16, min(256, n // 8)))
        step, hann = size - size // 2, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        starts = range(0, n - size + 1, step)
        u, v = ([np.fft.rfft((s[i : i + size] - s[i : i + size].mean()) * hann) for i in starts] for s in (x, y))
        cross, xx, yy = sum(np.conj(p) * q for p, q in zip(u, v, strict=True)), sum(abs(p) ** 2 for p in u), sum(abs(q) ** 2 for q in v)
        for k in range(1, size // 2 + 1):
            want[a, b, k] = abs(cross[k]) ** 2 / (xx[k] * yy[k])
    assert {k for k in got if k[2]} == set(want)
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items())


def test_phase_locking_of_unequal_series(spark, unequal):
    got = {(r["roi1"], r["roi2"]): (r["plv"], r["hours"]) for r in pairs.phase_locking(regular(spark, unequal), 24).collect()}
    want = {}
    for a, b, x, y in by_pairs(unequal):
        mean = np.mean(np.exp(1j * (np.angle(pairs.analytic(y - y.mean())) - np.angle(pairs.analytic(x - x.mean())))))
        want[a, b] = (abs(mean), np.angle(mean) / (2 * np.pi) * 24)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items())


def test_lags_are_places(spark, unequal):
    rows = pairs.cross_correlation(regular(spark, unequal), 3600, 12).where("roi1 = 3 AND roi2 = 8").collect()
    x, y = ((v - v.mean()) / (v.std() + 1e-10) for v in (unequal[3], unequal[8][:130]))
    for r in rows:
        assert r["correlation"] == pytest.approx(sum(x[i] * y[i - r["lag"]] for i in range(130) if 0 <= i - r["lag"] < 130) / 130, abs=1e-9)
    assert sorted(r["lag"] for r in rows) == list(range(-12, 13))


def kruskal(edges):
    parent, taken = {}, []

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for d, a, b in sorted(edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            taken.append((a, b, d))
    return sorted(taken), find


def test_spanning_forest(spark):
    rnd = random.Random(3)
    runs = {f"r{k}": [(rnd.choice([0.1, 0.2, 0.3, rnd.random()]), *sorted(rnd.sample(range(40), 2))) for _ in range(n)] for k, n in enumerate([1, 30, 60, 200])}
    runs = {k: [(d, a, b) for (a, b), d in {(a, b): d for d, a, b in edges}.items()] for k, edges in runs.items()}
    df = spark.createDataFrame([(k, a, b, d) for k, edges in runs.items() for d, a, b in edges], "run_id string, roi1 int, roi2 int, distance double")
    forest, roots = pairs.spanning_forest(df)
    got = sorted(map(tuple, forest.collect()))
    assert got == sorted((k, *e) for k, edges in runs.items() for e in kruskal(edges)[0])
    trees = {(r["run_id"], r["roi"]): r["root"] for r in roots.collect()}
    for k, edges in runs.items():
        find, rois = kruskal(edges)[1], {v for e in edges for v in e[1:]}
        assert all(trees[k, v] == min(w for w in rois if find(w) == find(v)) for v in rois)


@pytest.mark.parametrize("method", ["single", "average", "complete"])
def test_clusters_by_joins_and_by_chains(spark, method):
    rng = np.random.default_rng(5)
    c = rng.uniform(-1, 1, (14, 14))
    df = spark.createDataFrame([("r", i, j, float(c[i, j])) for i in range(14) for j in range(i + 1, 14)], "run_id string, roi1 int, roi2 int, correlation double")
    d = 1 - np.triu(c, 1) - np.triu(c, 1).T
    for cut in (0.1, 0.5, 0.9, 3.0):
        got = [(r["cluster"], r["size"]) for r in pairs.clusters(df, method, cut).orderBy("roi").collect()]
        groups = [{i} for i in range(14)]
        reach = {"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[method]
        while len(groups) > 1:
            gap, a, b = min((reach([d[i, j] for i in x for j in y]), p, q) for (p, x), (q, y) in itertools.combinations(enumerate(groups), 2))
            if gap > cut:
                break
            groups[a] |= groups.pop(b)
        groups.sort(key=min)
        want = [next((k + 1, len(g)) for k, g in enumerate(groups) if i in g) for i in range(14)]
        assert got == want


def test_runs_without_any_link(spark):
    df = spark.createDataFrame([("r", 1, 2, -0.5)], "run_id string, roi1 int, roi2 int, correlation double")
    assert [(r["roi"], r["cluster"], r["size"]) for r in pairs.clusters(df, "single", 0.5).orderBy("roi").collect()] == [(1, 1, 1), (2, 2, 1)]
    found = pairs.similarity_summary(df.withColumn("lag_h", F.lit(0.0))).collect()
    assert [(r["pairs"], r["similar_pairs"], r["rank"]) for r in found] == [(1, 0, None)]


@pytest.mark.parametrize("gap,interval,corrected", [(6.0, 5, False), (6.01, 5, True), (4.0, 5, False), (3.99, 5, True), (22.0, 20, False), (22.1, 20, True)])
def test_timing_tolerance(spark, gap, interval, corrected):
    df = spark.createDataFrame([("r", 1, i * gap, 0.0, i) for i in range(25)], "run_id string, roi int, t double, value double, tie int")
    (r,) = preprocess.timing_correction(df, interval, 33.33, 61).collect()
    assert r["corrected"] == corrected
    assert r["baseline_minutes"] == pytest.approx(int(33.33 * 60 / interval) * gap / 60 if corrected else 33.33)


def test_series_too_short_have_an_error(spark):
    rows = [("r", 1, float(i * 3600), float(i % 24), i) for i in range(200)] + [("r", 2, float(i * 3600), 1.0, i) for i in range(9)] + [("r", 3, float(i), 1.0, i) for i in range(50)]
    df = spark.createDataFrame(rows, "run_id string, roi int, t double, value double, tie int")
    got = {r["roi"]: r for r in rhythm.fourier_summary(df, 3600, permutations=20).collect()}
    assert got[1]["error"] is None and got[1]["significant"] and 23 < got[1]["period_h"] < 25
    assert (got[2]["error"], got[2]["samples"], got[2]["significant"]) == ("too few samples", 9, False)
    assert (got[3]["error"], got[3]["n"], got[3]["power"]) == ("too few samples", 1, None)
    (s,) = rhythm.significance_summary(rhythm.fourier_summary(df, 3600, permutations=20)).collect()
    assert (s["series"], s["significant"]) == (3, 1)
    assert {r["error"] for r in rhythm.fourier_summary(df.where("roi = 1"), 3600, 1000, 1001, permutations=2).collect()} == {"no period in range"}


def spectra(spark, runs):
    """Each series: power by k, at periods 12 + k."""
    rows = [(run, roi, 50, 64.0, k, 12.0 + k, float(v)) for run, series in runs.items() for roi, values in enumerate(series) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, roi int, n int, size double, k long, period_h double, power double")


def cosinors(spark, runs, periods):
    rows = [(run, roi, p, p == best, 0.01) for run, bests in runs.items() for roi, best in enumerate(bests) for p in periods]
    return spark.createDataFrame(rows, "run_id string, roi int, period_h double, best boolean, p double")


def test_boundary_diagnostics(spark):
    inner = [1.0] * 10 + [9.0] + [1.0] * 14  # periods 12 .. 36, whose twentieth is 1.2 h
    at_end, near_end, beyond = (list(inner) for _ in range(3))
    at_end[24], near_end[23], beyond[22] = 20.0, 20.0, 20.0
    at_end[10], near_end[10], beyond[10] = 19.0, 19.0, 19.0
    power = spectra(spark, {"few": [at_end, inner, inner, inner], "many": [at_end, near_end, inner], "off": [beyond, inner, inner], "flat": [[3.0] * 25]})
    periods = cosinors(spark, {"few": [12.0, 24.0, 24.0, 24.0], "many": [12.0, 36.0, 24.0], "off": [24.0, 24.0, 24.0], "flat": [36.0]}, [12.0, 24.0, 36.0])
    got = {r["run_id"]: r for r in rhythm.boundary_diagnostics(power, periods).collect()}
    assert [(k, got[k]["at_edge"], got[k]["edge_warning"], got[k]["mismatches"], got[k]["mismatch_warning"]) for k in ("few", "many", "off", "flat")] == [("few", 1, False, 1, True), ("many", 2, True, 1, True), ("off", 0, False, 0, False), ("flat", 0, False, 0, False)]
    assert [(k, got[k]["significant"], got[k]["cosinor_at_edge"], got[k]["cosinor_warning"]) for k in ("few", "many", "flat")] == [("few", 4, 1, False), ("many", 3, 2, True), ("flat", 1, 1, True)]
    assert all(r["hint"] is None for r in got.values())
    power = spectra(spark, {"a": [inner], "b": [inner], "c": [inner]})
    hints = {}
    for name, bests, tested in (("a", [14.0, 8.0, 8.0], [8.0, 14.0, 20.0]), ("b", [1.5, 8.0, 8.0], [1.5, 8.0, 10.0]), ("c", [14.0, 8.0], [8.0, 14.0])):
        hints |= {r["run_id"]: r["hint"] for r in rhythm.boundary_diagnostics(power.where(f"run_id = '{name}'"), cosinors(spark, {name: bests}, tested)).collect()}
    assert hints == {"a": "consider a test period of 24 h", "b": "consider test periods of 0.5 to 1 h", "c": None}


@pytest.mark.parametrize("fraction,label", [(0.0, "No movement detected"), (0.5, "Reasonable movement levels"), (1.0, "High movement activity")])
def test_movement_labels(spark, fraction, label):
    bins = spark.createDataFrame([("r", 1, fraction, 0), ("r", 1, fraction, 1)], "run_id string, roi int, fraction double, sleep int")
    limits = spark.createDataFrame([("r", 1, 10.0), ("r", 2, 12.0)], "run_id string, roi int, baseline_mean double")
    (r,) = summary.run_summary(bins, limits).collect()
    assert (r["movement_quality"], r["baseline_quality"]) == (label, "Good baseline consistency")
