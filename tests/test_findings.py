"""What a review found: tables as folders, halves in rounding, growth of the larger queries."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tempora.operators import metadata
from tempora.plans import record_queries
from tempora.streaming import incremental


def test_streams_read_tables_that_are_folders(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/embeddings.parquet").repartition(3)
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    e.limit(1).write.parquet(f"{tmp_path}/embeddings.parquet2")
    for d in (small, str(tmp_path)):
        q = record_queries.stream_of(spark, d, "embeddings").writeStream.format("parquet").option("path", f"{tmp_path}/out{len(d)}").option("checkpointLocation", f"{tmp_path}/state{len(d)}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out{len(d)}").count() == e.count()


def test_halves_are_rounded_as_in_sql(spark):
    import duckdb

    from tempora.plans.registry import rounded

    numbers = [1.005, 2.675, -1.005, 0.000000005, 123.123456785, 123456789012.1234567, 1e305, 0.0, -0.0, 77.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [tuple(r) for r in df.orderBy("i").select(*(rounded(F.col("x"), k) for k in (2, 8))).collect()]
    want = [duckdb.sql(f"SELECT round(CAST('{x!r}' AS DOUBLE), 2), round(CAST('{x!r}' AS DOUBLE), 8)").fetchall()[0] for x in numbers]
    assert got == want


def plan(df):
    return df._jdf.queryExecution().toString()


def test_attributes_are_checked_without_a_sort_of_their_texts(spark):
    rows = [("a", "file_version", "2.2"), ("a", "structure", "timeseries_only"), ("a", "timeseries", "TRUE"), ("a", "units", "s"), ("a", "display_hint", "ms"), ("a", "expected_intervals_fixed", "1"), ("a", "unit_standard", "SI"), ("a", "frame_drift", "true"),
            ("b", "file_version", None), ("b", "other", "x"), ("c", "file_version", "beta"), ("c", "timeseries", "true"), ("c", "frame_drift", "1"), ("c", "units", "s")]
    out = metadata.legacy_check(spark.createDataFrame(rows, "run_id string, parameter string, value string"))
    assert "SortAggregate" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [("a", *[False] * 6), ("b", True, False, False, False, True, True), ("c", *[True] * 6)]


def test_parameters_are_listed_without_a_sort_of_their_rows(spark):
    rows = [("a", "p", 1, None, "x"), ("a", "p", 0, 2.0, None), ("a", "q", 0, None, None), ("a", "r", 3, 1.0, None), ("a", "r", 2, None, "x"), ("a", "_h", 0, 1.0, None)]
    out = metadata.parameter_inventory(spark.createDataFrame(rows, "run_id string, param string, idx long, value double, text string"))
    assert "SortAggregate" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [("a", 3, "p,q,r", "p:float,q:empty,r:str", 2)]


def test_a_series_of_a_batch_meets_as_numbers():
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"run_id": "a", "t": rng.integers(0, 50, 999) / 2, "tie": rng.permutation(999), "value": rng.normal(size=999)})
    held = [incremental._numbers(rows[a : a + 100]) for a in range(0, 999, 100)]
    want = rows.sort_values(["t", "tie"])
    t, tie, value = incremental._in_order(held)
    assert not held and all(np.array_equal(a, b) for a, b in ((t, want.t), (tie, want.tie), (value, want.value)))


def test_waiting_samples_are_stored_by_batch():
    class Value:
        def __init__(self): self.x = None  # noqa: E704
        def exists(self): return self.x is not None  # noqa: E704
        def get(self): return self.x  # noqa: E704
        def update(self, x): self.x = x  # noqa: E704

    class List:
        def __init__(self): self.rows = []  # noqa: E704
        def get(self): return iter(self.rows)  # noqa: E704
        def appendList(self, x): self.rows += x  # noqa: E704,N802
        def put(self, x): self.rows = list(x)  # noqa: E704
        def clear(self): self.rows = []  # noqa: E704

    class Handle:
        getValueState = lambda self, *a: Value()
        getListState = lambda self, *a: List()
        registerTimer = lambda self, ms: None

    class Times:
        now = 0
        getCurrentWatermarkInMs = lambda self: self.now

    rng, step, times = np.random.default_rng(6), incremental._OrderedStates(), Times()
    step.init(Handle())
    rows = pd.DataFrame({"t": rng.permutation(600) / 2, "tie": range(600), "value": rng.normal(size=600), "baseline_mean": 0.0, "upper": 0.8, "lower": -0.8})
    list(step.handleInputRows(("a", 1), iter([rows[:300], rows[300:]]), times))
    assert len(step.waiting.rows) == 2
    out = []
    for until in (100.0, 1000.0):
        times.now = (until + incremental.EPOCH) * 1000
        out += list(step.handleExpiredTimer(("a", 1), times, None))
    want = rows.sort_values("t")
    assert [len(x) for x in out] == [201, 399] and not step.waiting.rows
    got = pd.concat(out)
    assert np.array_equal(got.tie, want.tie) and np.array_equal(got.state, incremental.states_after(want.value.to_numpy(), 0.0, 0.8, -0.8, None))


def test_fourier_summary_equals_its_steps_and_shuffles_once(spark):
    from tempora.operators import binning, rhythm

    rng = np.random.default_rng(4)
    rows = [("a", roi, float(t), float(np.round(v, 2)) if t % 7 else None) for roi in range(40) for t, v in zip(np.sort(rng.integers(0, 86_400 * (1 + roi % 5), 4 + roi)), rng.normal(50, 20, 4 + roi), strict=True)]
    rows += [("a", 50, 3600.0 * i, 5.0) for i in range(30)] + [("a", 51, 0.0, None), ("a", 52, 7200.0, 3.0), ("a", 53, 0.0, None), ("a", 53, 90_000.0, 1.0), ("a", 54, None, 1.0), ("a", None, 1.0, 1.0)]
    rows += [("b", 0, 3600.0 * i, 1.0 + (i // 3) % 4) for i in range(96)]
    samples = spark.createDataFrame(rows, "run_id string, roi int, t double, value double").repartition(3)
    regular = binning.resample(samples.where("roi IS NOT NULL"), 3600)
    got = {tuple(r)[:2]: list(r["values"]) for r in binning.resampled_arrays(samples, 3600).collect()}
    assert got == {tuple(r)[:2]: list(r["values"]) for r in rhythm.series_arrays(regular).collect()}
    found = rhythm.fourier_summary(samples, 3600, 3, 40, 30)
    assert plan(found).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
    seen = {(r["run_id"], r["roi"]): r for r in found.collect()}
    power = rhythm.spectrum(regular, 3600, 3, 40)
    best = {(r["run_id"], r["roi"]): r for r in rhythm.spectrum_best(power).collect()}
    p = {(r["run_id"], r["roi"]): r["p"] for r in rhythm.permutation_test(regular, rhythm.spectrum_best(power), 30).collect()}
    peaks = {(r["run_id"], r["roi"]): r["count"] for r in rhythm.spectral_peaks(power).groupBy("run_id", "roi").count().collect()}
    means = {(r["run_id"], r["roi"]): r for r in regular.groupBy("run_id", "roi").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).collect()}
    assert seen.keys() == means.keys() and sum(r["error"] is None for r in seen.values()) > 25
    for key, r in seen.items():
        assert r["n"] == means[key]["n"] and np.allclose([r["mean"], r["std"]], [means[key]["mean"], means[key]["std"]])
        if r["error"] is None and r["std"] > 0:
            assert np.allclose([r["period_h"], r["power"]], [best[key]["period_h"], best[key]["power"]]) and (r["p"], r["peaks"]) == (p[key], peaks.get(key, 0))
        else:
            assert r["std"] == 0 or (r["samples"] < 10 or r["n"] < 10) and r["period_h"] is None and not r["significant"]
