"""Operators against plain loops, known periods, and metamorphic checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import binning, frames, metadata, pairs, preprocess, rhythm, states, summary, thresholds
from tempora.sources import sinks
from tempora.streaming import incremental

SCHEMA = "run_id string, roi int, t double, value double, tie long"


def series(spark, values, step=5.0, roi=1, times=None):
    t = times if times is not None else [i * step for i in range(len(values))]
    return spark.createDataFrame([("r", roi, float(a), float(v), i) for i, (a, v) in enumerate(zip(t, values, strict=True))], SCHEMA)


def values(df, column="value"):
    return [r[column] for r in df.orderBy("roi", "t", "tie").collect()]


def loop_states(v, mean, upper, lower):
    s = 1 if v[0] > upper else 0 if v[0] < lower else int(v[0] > mean)
    out = []
    for x in v:
        s = (1 if x > upper else 0) if s == 0 else (0 if x < lower else 1)
        out.append(s)
    return out


@pytest.mark.parametrize(("upper", "lower"), [(60, 40), (40, 60), (50, 50), (0, 0)])
def test_hysteresis(spark, upper, lower):
    v = np.random.default_rng(upper).uniform(0, 100, 200).round()
    limits = spark.createDataFrame([("r", 1, 50.0, float(upper), float(lower))], "run_id string, roi int, baseline_mean double, upper double, lower double")
    assert values(states.hysteresis(series(spark, v), limits), "state") == loop_states(v, 50, upper, lower)


def loop_fraction(t, s, size):
    low, high = math.floor(t[0] / size), math.ceil(t[-1] / size)
    out = []
    for k in range(low, high):
        spent = sum(max(0, min(b, (k + 1) * size) - max(a, k * size)) for a, b, x in zip(t, t[1:], s, strict=False) if x)
        out.append(min(1.0, spent / size))
    return out


def test_movement_fraction(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(1, 200, 80))
    s = rng.integers(0, 2, 80)
    df = series(spark, s, times=t).withColumn("state", F.col("value").cast("int"))
    got = [r["fraction"] for r in states.movement_fraction(df, 60).orderBy("bin_start").collect()]
    assert got == pytest.approx(loop_fraction(t.tolist(), s.tolist(), 60))
    assert states.movement_fraction(df.limit(1), 60).count() == 0


def test_sleep_runs(spark):
    f = [0.1] * 7 + [0.9] + [0.1] * 8 + [0.9, 0.1]
    df = spark.createDataFrame([("r", 1, i * 60.0, i * 60.0 + 30, x) for i, x in enumerate(f)], "run_id string, roi int, bin_start double, bin_center double, fraction double")
    out = states.sleep(states.quiescence(df))
    assert [r["sleep"] for r in out.orderBy("bin_start").collect()] == [0] * 8 + [1] * 8 + [0, 0]
    assert [r["minutes"] for r in states.sleep_bouts(out).collect()] == [8.0]


def loop_jumps(v):
    n, d = len(v), np.diff(v)
    if n < 25:
        return list(v)
    h = min(20, n // 5) // 2
    sd = [np.std(d[max(0, i - h) : i + h + 1]) for i in range(n - 1)]
    out = np.array(v, float)
    for i in np.flatnonzero(np.abs(d) > 1.5 * np.median(sd)):
        out[i + 1 :] -= d[i]
    return out.tolist()


@pytest.mark.parametrize("n", [9, 10, 24, 25, 30, 57, 160])
def test_jumps(spark, n):
    v = np.random.default_rng(n).normal(100, 2, n)
    v[n // 2 :] += 50
    assert values(preprocess.remove_jumps(series(spark, v))) == pytest.approx(loop_jumps(v))


def test_quadratic_detrend(spark):
    t = np.arange(60) * 5.0 + 1.7e9
    v = 3 + 1e-3 * (t - t[0]) + 1e-5 * (t - t[0]) ** 2 + np.random.default_rng(2).normal(0, 1, 60)
    x = (t - t.mean()) / (t[-1] - t[0])
    p = np.polyval(np.polyfit(x, v, 2), x)
    assert values(preprocess.detrend_quadratic(series(spark, v, times=t))) == pytest.approx((v - p + p.mean()).tolist(), abs=1e-6)


def test_short_series_pass_detrending(spark):
    v = list(np.random.default_rng(3).uniform(0, 9, 19))
    assert values(preprocess.detrend(series(spark, v))) == pytest.approx(v)


def test_thresholds_do_not_depend_on_detrending(spark):
    v = np.linspace(100, 200, 1000) + np.random.default_rng(42).normal(0, 2, 1000)
    df = series(spark, v)
    a = states.analyze(df, "baseline", minutes=10, multiplier=2, interval=5)["thresholds"].first()
    b = states.analyze(df, "baseline", minutes=10, multiplier=2, interval=5, detrended=False)["thresholds"].first()
    assert a["upper"] == pytest.approx(b["upper"], abs=0.001)
    assert 100 <= a["baseline_mean"] <= 112


def test_too_little_baseline(spark):
    r = thresholds.from_baseline(series(spark, [1.0] * 9), 200).first()
    assert (r["baseline_mean"], r["upper"], r["lower"], r["status"]) == (0.0, 0.0, 0.0, "insufficient_data")


def test_constant_series(spark):
    regular = binning.resample(series(spark, [5.0] * 80, 3600), 3600)
    assert rhythm.dominant_period(rhythm.fisher_periodogram(regular, 3600)).first()["z"] == 0.0


def test_partitioning_does_not_matter(spark):
    df = series(spark, np.random.default_rng(4).uniform(0, 9, 300)).unionByName(series(spark, np.random.default_rng(5).uniform(0, 9, 300), roi=2))
    assert values(preprocess.detrend(df)) == pytest.approx(values(preprocess.detrend(df.repartition(7))))


@pytest.fixture(scope="module")
def daily(spark):
    """24 h, 24 h shifted, 20 h; 72 hours at 10 minutes."""
    rng, t = np.random.default_rng(42), np.arange(432) / 6
    rows = []
    for roi, (p, phase) in enumerate([(24, 0), (24, math.pi), (20, 0)], 1):
        v = np.clip(0.4 * np.sin(2 * np.pi * t / p + phase) + 0.5 + rng.normal(0, 0.05, len(t)), 0, 1)
        rows += [("r", roi, float(h * 3600), float(x), i) for i, (h, x) in enumerate(zip(t, v, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def test_known_periods(spark, daily):
    fisher = {r["roi"]: r for r in rhythm.fisher_summary(daily, 600).collect()}
    fourier = {r["roi"]: r for r in rhythm.fourier_summary(daily, 600, permutations=30).collect()}
    cosinor = {r["roi"]: r for r in rhythm.cosinor_periods(binning.resample(daily, 600), 600, [20.0, 24.0, 30.0]).where("best").collect()}
    for roi, p in ((1, 24), (2, 24), (3, 20)):
        assert fisher[roi]["period_h"] == pytest.approx(p, abs=1.5) and fisher[roi]["significant"]
        assert fourier[roi]["period_h"] == pytest.approx(p, abs=2) and fourier[roi]["p"] < 0.05
        assert cosinor[roi]["period_h"] == p and cosinor[roi]["r2"] > 0.8


def test_cosinor_matches_least_squares(spark, daily):
    v = np.array(values(daily.where("roi = 1")))
    x = 2 * np.pi * np.arange(len(v)) / 6 / 24
    m = np.column_stack([np.cos(x), np.sin(x), np.ones(len(v))])
    beta, gamma, mesor = np.linalg.lstsq(m, v[: len(v)], rcond=None)[0]
    r = rhythm.cosinor(binning.resample(daily.where("roi = 1"), 600), 600, 24.0).first()
    assert (r["mesor"], r["beta"], r["gamma"]) == pytest.approx((mesor, beta, gamma), abs=0.01)


def test_t_quantile(spark):
    known = {5: 2.5706, 10: 2.2281, 30: 2.0423, 120: 1.9799}
    for df, want in known.items():
        got = spark.range(1).select(rhythm.t_quantile(F.lit(df)).alias("q")).first()["q"]
        assert got == pytest.approx(want, rel=0.005)


def test_pairs(spark, daily):
    regular = binning.resample(daily, 600)
    c = {(r["roi1"], r["roi2"]): r for r in pairs.correlation(regular, 600, 12).collect()}
    assert abs(c[1, 2]["lag_h"]) == pytest.approx(12, abs=0.5) and c[1, 2]["zero_lag"] < -0.5
    swapped = regular.withColumn("roi", -F.col("roi"))
    d = {(r["roi1"], r["roi2"]): r for r in pairs.correlation(swapped, 600, 6).collect()}
    e = {(r["roi1"], r["roi2"]): r for r in pairs.correlation(regular, 600, 6).collect()}
    assert d[-3, -1]["correlation"] == pytest.approx(e[1, 3]["correlation"]) and d[-3, -1]["lag_h"] == pytest.approx(-e[1, 3]["lag_h"])
    lock = {(r["roi1"], r["roi2"]): r for r in pairs.phase_locking(regular, 24).collect()}
    assert lock[1, 2]["quality"] == "strong" and abs(lock[1, 2]["hours"]) == pytest.approx(12, abs=0.5)
    assert not pairs.phase_difference(regular, 600, 24).where("anti_phase").count()


def loop_cross(a, b, most):
    n = len(a)
    a, b = (a - a.mean()) / (a.std() + 1e-10), (b - b.mean()) / (b.std() + 1e-10)
    return {d: sum(a[i] * b[i - d] for i in range(n) if 0 <= i - d < n) / n for d in range(-most, most + 1)}


def test_cross_correlation_loop(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=31), rng.normal(size=31)
    df = series(spark, a, 60).unionByName(series(spark, b, 60, 2)).withColumn("idx", F.col("tie"))
    got = {r["lag"]: r["correlation"] for r in pairs.cross_correlation(df, 60, 8 / 60).collect()}
    assert got == pytest.approx(loop_cross(a, b, 8))


def test_linkage():
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.85, 0.9], [0.9, 0.85, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    for method in ("average", "single", "complete"):
        assert pairs.linkage_clusters(d, 0.5, method).tolist() == [1, 1, 2, 2]
    assert pairs.linkage_clusters(d, 0.05).tolist() == [1, 2, 3, 4]
    assert pairs.linkage_clusters(d, 0.95, "single").tolist() == [1, 1, 1, 1]


def test_frame_difference(spark):
    px = np.random.default_rng(7).integers(0, 255, (5, 16))
    f = spark.createDataFrame([("r", i, [float(v) for v in row]) for i, row in enumerate(px)], "run_id string, frame_idx long, pixels array<float>")
    m = spark.createDataFrame([("r", 1, p) for p in (0, 3, 7)], "run_id string, roi int, px int")
    got = [r["value"] for r in frames.activity(f, m, 5).orderBy("t").collect()]
    assert got == [float(np.abs(px[i + 1][[0, 3, 7]] - px[i][[0, 3, 7]]).sum()) for i in range(4)]


def test_wells(spark):
    c = spark.createDataFrame([("r", i, x, y, 5) for i, (x, y) in enumerate([(10, 10), (30, 12), (50, 11), (10, 40), (30, 41), (50, 42)])], "run_id string, circle_id int, x int, y int, r int")
    assert {r["circle_id"]: r["well"] for r in frames.number_wells(c).collect()} == {0: 1, 1: 2, 2: 3, 5: 4, 4: 5, 3: 6}


def test_errors(spark):
    df = series(spark, [1.0] * 30)
    for call in (lambda: states.analyze(df, "magic"), lambda: states.analyze(df, "calibration"), lambda: rhythm.rhythm(df, "magic", 60), lambda: binning.lighting(df, "magic")):
        with pytest.raises(ValueError):
            call()


def loop_linkage(points, cut, method):
    """Clusters by the definitions: distances of all members, or for ward the growth of the squared distances to centres."""
    groups = [[i] for i in range(len(points))]

    def apart(a, b):
        each = [math.dist(points[i], points[j]) for i in a for j in b]
        if method == "ward":
            x, y = np.array(points)[a], np.array(points)[b]
            return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * math.dist(x.mean(0), y.mean(0))
        return {"single": min, "complete": max, "average": lambda e: sum(e) / len(e)}[method](each)

    while len(groups) > 1:
        d, i, j = min((apart(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > cut:
            break
        groups[i] += groups.pop(j)
    label = {}
    for k, g in enumerate(sorted(map(sorted, groups)), 1):
        label |= dict.fromkeys(g, k)
    return [label[i] for i in range(len(points))]


@pytest.mark.parametrize("method", ["average", "single", "complete", "ward"])
def test_linkage_by_definition(method):
    rng = np.random.default_rng(3)
    for n in (2, 7, 25):
        points = rng.normal(size=(n, 2)).tolist()
        d = np.array([[math.dist(p, q) for q in points] for p in points])
        for cut in (0.2, 0.6, 1.1, 2.5):
            assert pairs.linkage_clusters(d, cut, method).tolist() == loop_linkage(points, cut, method)


def test_clusters_of_several_runs(spark):
    rows = [(r, i, j, 1 - abs(x[i] - x[j])) for r, x in (("a", [0, 0.1, 0.9, 0.95, 2.0]), ("b", [0.0, 0.5, 0.9])) for i in range(len(x)) for j in range(i + 1, len(x))]
    df = spark.createDataFrame(rows, "run_id string, roi1 int, roi2 int, correlation double")
    for method in ("average", "single", "complete"):
        got = {(r["run_id"], r["roi"]): (r["cluster"], r["size"]) for r in pairs.clusters(df, method, 0.45).collect()}
        want = {}
        for run, x in (("a", [0, 0.1, 0.9, 0.95, 2.0]), ("b", [0.0, 0.5, 0.9])):
            label = loop_linkage([[v] for v in x], 0.45, method)
            want |= {(run, i): (c, label.count(c)) for i, c in enumerate(label)}
        assert got == want


def test_clusters_of_the_query(spark, small):
    from tempora.plans import catalog, rhythm_queries

    square = {(r["roi1"], r["roi2"]): r["correlation"] for r in rhythm_queries.correlations(spark, small).collect()}
    ids = sorted({i for p in square for i in p})
    groups = [[i] for i in ids]
    apart = lambda a, b: sum(1 - square[min(i, j), max(i, j)] for i in a for j in b) / len(a) / len(b)
    while len(groups) > 1:
        d, i, j = min((apart(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > 0.94:
            break
        groups[i] = groups[i] + groups.pop(j)
    want = {i: len(g) for g in groups for i in g}
    rows = catalog.queries()["h4_clusters"](spark, small).collect()
    assert {r["roi"]: r["size"] for r in rows} == want and len({r["cluster"] for r in rows}) == len(groups)


@pytest.mark.parametrize("most", [5, 300])
def test_products_by_transform(most):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=2500), rng.normal(size=2500)
    want = loop_cross(a[:700], b[:700], most)
    assert dict(zip(range(-most, most + 1), pairs.lagged_products(a[:700], b[:700], -most, most), strict=True)) == pytest.approx(want)
    long = pairs.lagged_products(a, b, -1200, 1200)
    z = lambda v: (v - v.mean()) / (v.std() + 1e-10)
    assert [long[1200 + d] for d in (-1200, -1, 0, 1, 777)] == pytest.approx([sum(z(a)[max(0, d) : 2500 + min(0, d)] * z(b)[max(0, -d) : 2500 - max(0, d)]) / 2500 for d in (-1200, -1, 0, 1, 777)])


def test_permutation_loop(spark):
    import hashlib

    v = np.random.default_rng(12).normal(size=60) + np.sin(np.arange(60) / 3)
    regular = binning.resample(series(spark, v, 3600.0), 3600)
    x = np.array([r["value"] for r in regular.orderBy("idx").collect()])
    best = rhythm.spectrum_best(rhythm.spectrum(regular, 3600, 4, 36)).first()
    n, i = len(x), np.arange(len(x))

    def power(y):
        y = (y - np.polyval(np.polyfit(i, y, 1), i)) * np.hanning(n)
        return abs(np.sum(y * np.exp(-2j * np.pi * best["k"] * i / best["size"]))) ** 2

    assert power(x) == pytest.approx(best["power"])
    hits = 0
    for perm in range(1, 51):
        order = sorted(range(n), key=lambda k: hashlib.md5(f"1:{perm}:{k}".encode()).hexdigest())
        hits += power(x[order]) >= best["power"]
    got = rhythm.permutation_test(regular, rhythm.spectrum_best(rhythm.spectrum(regular, 3600, 4, 36)), 50).first()
    assert (got["p"], got["permutations"]) == (hits / 50, 50)


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_frame_difference_across_segments_and_runs(spark, segment):
    rng = np.random.default_rng(8)
    index = {"a": [0, 1, 2, 5, 9, 30, 31], "b": [7], "c": [100, 101]}
    px = {(r, i): rng.integers(0, 255, 9) for r, rows in index.items() for i in rows}
    f = spark.createDataFrame([(r, i, [float(v) for v in p]) for (r, i), p in px.items()], "run_id string, frame_idx long, pixels array<float>")
    masks = {("a", 1): [0, 8], ("a", 2): [4], ("b", 1): [1], ("c", 7): [2, 3, 4]}
    m = spark.createDataFrame([(r, roi, p) for (r, roi), ps in masks.items() for p in ps], "run_id string, roi int, px int")
    want = {(r, roi, k * 5.0): float(np.abs(px[r, j] - px[r, i])[ps].sum()) for (r, roi), ps in masks.items() for k, (i, j) in enumerate(zip(index[r], index[r][1:], strict=False))}
    assert {(x["run_id"], x["roi"], x["t"]): x["value"] for x in frames.activity(f, m, 5, segment=segment).collect()} == want


@pytest.mark.parametrize(("upper", "lower"), [(60, 40), (40, 60), (50, 50)])
def test_streamed_states_continue_each_other(upper, lower):
    v = np.random.default_rng(1).uniform(0, 100, 90).round()
    want, got, bit = loop_states(v, 50, upper, lower), [], None
    for a, b in ((0, 1), (1, 30), (30, 31), (31, 90)):
        part = incremental.states_after(v[a:b], 50, upper, lower, bit)
        bit = int(part[-1])
        got += part.tolist()
    assert got == want


def test_streams_of_several_files(spark, tmp_path):
    """Frames and samples of two runs in several files, a few for each batch; a series without limits is left out."""
    rng = np.random.default_rng(2)
    px = {(r, i): rng.integers(0, 255, 4) for r in "ab" for i in range(12)}
    for k in range(4):
        rows = [(r, i, [float(v) for v in px[r, i]]) for r in "ab" for i in range(3 * k, 3 * k + 3)]
        spark.createDataFrame(rows, "run_id string, frame_idx long, pixels array<float>").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/frames")
        values = [(r, roi, float(3 * k + i), float(rng.uniform(0, 100).__round__()), 3 * k + i) for r in "ab" for roi in (1, 2) for i in range(3)]
        spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/samples")
    stream = lambda name: spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/{name}").schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}")
    m = spark.createDataFrame([("a", 1, 0), ("a", 1, 3), ("b", 5, 2)], "run_id string, roi int, px int")
    out = incremental.run_to_table(incremental.activity(stream("frames"), m, 5), f"file://{tmp_path}/one")
    want = {(r, roi, i * 5.0): float(np.abs(px[r, i + 1] - px[r, i])[p].sum()) for r, roi, p in (("a", 1, [0, 3]), ("b", 5, [2])) for i in range(11)}
    assert {(x["run_id"], x["roi"], x["t"]): x["value"] for x in out.collect()} == want
    limits = spark.createDataFrame([("a", 1, 50.0, 60.0, 40.0), ("b", 1, 50.0, 40.0, 60.0), ("b", 2, 10.0, 20.0, 5.0)], "run_id string, roi int, baseline_mean double, upper double, lower double")
    got = incremental.run_to_table(incremental.hysteresis(stream("samples"), limits), f"file://{tmp_path}/two")
    batch = states.hysteresis(spark.read.parquet(f"file://{tmp_path}/samples"), limits)
    key = lambda df: sorted((r["run_id"], r["roi"], r["tie"], r["state"]) for r in df.collect())
    assert key(got) == key(batch) and len(key(got)) == 36


def test_streams_of_samples_in_any_order(spark, tmp_path):
    """Shuffled samples within the watermark give the states of a batch, over several files and a restart between them; later ones are dropped and counted."""
    rng = np.random.default_rng(4)
    rows = [(r, roi, float(10 * i), float(round(rng.uniform(0, 100))), i) for r in "ab" for roi in (1, 2) for i in range(60)]
    come = sorted(rows, key=lambda x: x[2] + rng.uniform(0, 100))
    limits = spark.createDataFrame([("a", 1, 50.0, 60.0, 40.0), ("b", 1, 50.0, 40.0, 60.0), ("b", 2, 10.0, 20.0, 5.0)], "run_id string, roi int, baseline_mean double, upper double, lower double")
    dropped: list[int] = []

    def step(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/samples")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/samples")
        out = incremental.run_to_table(incremental.ordered_hysteresis(stream, limits, "100 seconds"), f"file://{tmp_path}/out", rocksdb=True, dropped=dropped)
        return sorted((x["run_id"], x["roi"], x["tie"], x["state"]) for x in out.collect())

    for k in range(0, len(come), 60):
        got = step(come[k : k + 60])
    batch = sorted((x["run_id"], x["roi"], x["tie"], x["state"]) for x in states.hysteresis(spark.createDataFrame(rows, SCHEMA), limits).where("t <= 490").collect())
    assert got == batch and dropped == [0] * 4
    got = step([("a", 1, 2000.0, 99.0, 200), ("b", 1, 5.0, 99.0, 201)])
    full = sorted((x["run_id"], x["roi"], x["tie"], x["state"]) for x in states.hysteresis(spark.createDataFrame(rows, SCHEMA), limits).collect())
    assert got == full and dropped[-1] == 1


@pytest.mark.parametrize("bucket", [10.0, 45.0, 86_400.0])
def test_light_by_loop(spark, bucket):
    rng = np.random.default_rng(int(bucket))
    lamp, seen = [], []
    for run in ("a", "b", "c"):
        t = sorted(rng.choice(400, 40, replace=False).tolist())
        lamp += [(run, float(x), float(rng.integers(0, 2))) for x in t]
        seen += [(run, 1, float(x), 0.0, i) for i, x in enumerate(sorted(rng.choice(500, 60).tolist()))]
    led = spark.createDataFrame(lamp, "run_id string, t double, white double")
    got = {(r["run_id"], r["tie"]): r["light"] for r in metadata.with_light(spark.createDataFrame(seen, SCHEMA), led, 0.5, bucket).collect()}
    assert got == {(run, i): next((int(w) for r, x, w in reversed(lamp) if r == run and x <= t), None) for run, _, t, _, i in seen}
    want = []
    for run in ("a", "b", "c"):
        own, start = [(t, w) for r, t, w in lamp if r == run], None
        light = []
        for t, w in own:
            if w and start is None:
                start = t
            elif not w and start is not None:
                light.append((start, t))
                start = None
        if start is not None:
            light.append((start, own[-1][0]))
        want += [(run, "light", a, b) for a, b in light] + [(run, "dark", a[1], b[0]) for a, b in zip(light, light[1:], strict=False)]
    assert sorted(map(tuple, metadata.light_periods(led, 0.5, None, bucket).collect())) == sorted(want)


def test_adaptive_windows_go_by_time(spark):
    t = [0, 1, 2, 3, 50, 51, 52, 53, 54, 55, 56, 57, 200, 201, 202, 203, 204, 205]
    v = np.random.default_rng(3).uniform(50, 60, len(t))
    r = thresholds.adaptive(series(spark, v, times=t), 12 * 5 / 60, 2.5, 5.0).first()  # 12 frames of 5 s
    inside = v[np.array(t) < 60]
    assert (r["samples"], r["snr"], r["status"]) == (len(inside), pytest.approx(inside.mean() / inside.std()), "success")
    short = thresholds.adaptive(series(spark, [1.0] * 9)).first()
    assert (short["baseline_mean"], short["upper"], short["lower"], short["status"], short["snr"]) == (0.0, 0.0, 0.0, "insufficient_analysis_data", None)
    bins = states.analyze(series(spark, [1.0] * 9), "adaptive", bin_size=10)["bins"]
    assert {x["fraction"] for x in bins.collect()} == {1.0}


def test_every_rule_of_the_recommendations(spark, small):
    from tempora.plans import catalog

    told = "; ".join(r["recommendations"] for r in catalog.queries()["j3_adaptive_recommendations"](spark, small.replace("0.001", "0.01")).collect())
    assert [k for k, text in summary.ADVICE.items() if text not in told] == []


def test_deep_attributes(spark):
    doc = '{"a": {"b": {"c": {"d": {"e": {"f": 1, "t": true, "s": "x", "l": [1], "q": "}}\\\\\\"}{"}}}}}, "esp32_timing": {"x": 2.5}, "n": null, "z": -3e2}'
    df = spark.createDataFrame([("r", 1, doc), ("r", 2, "no json"), ("r", 3, None), ("q", 1, "7")], "run_id string, frame_idx long, attrs string")
    assert sorted(tuple(r) for r in metadata.numeric_attributes(df).collect()) == [("r", 1, "e_f", 1.0), ("r", 1, "x", 2.5), ("r", 1, "z", -300.0)]


def test_last_of_a_name_counts(spark):
    df = spark.createDataFrame([("r", 1, '{"a": {"x": 1}, "b": {"a": {"x": 2}}, "a_x": 3}'), ("r", 2, '{"a_x": 3, "a": {"x": 1}}'), ("r", 3, "[1]"), ("r", 4, '{"big": 1' + "0" * 400 + ', "n": NaN}')], "run_id string, frame_idx long, attrs string")
    got = [tuple(r) for r in metadata.numeric_attributes(df).orderBy("frame_idx").collect()]
    assert got[:2] == [("r", 1, "a_x", 3.0), ("r", 2, "a_x", 1.0)] and [r[2] for r in got[2:]] == ["n"]


def test_runs_saved_twice_and_broken_off(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.5), ("b", 1, 2.5)], "run_id string, roi int, value double")
    sinks.save_run(path, {"bins": rows, "states": rows})
    sinks.save_run(path, {"bins": rows.where("run_id = 'a' AND roi = 1"), "states": rows.where("run_id = 'a'")})
    key = lambda name: sorted((r["run_id"], r["roi"]) for r in sinks.load_run(spark, path, name).collect())
    assert key("bins") == [("a", 1), ("b", 1)] and key("states") == [("a", 1), ("a", 2), ("b", 1)]
    sinks.replaced(rows.withColumn("run_id", F.lit("c")), f"{path}/bins")  # a save that ends before its manifest
    assert key("bins") == [("a", 1), ("b", 1)] and "c" not in {r["run_id"] for r in sinks.saved_runs(spark, path).collect()}
    assert sorted((r["run_id"], r["name"], r["rows"]) for r in sinks.saved_runs(spark, path).collect()) == [("a", "bins", 1), ("a", "states", 2), ("b", "bins", 1), ("b", "states", 1)]
