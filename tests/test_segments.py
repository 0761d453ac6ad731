"""Scans over segments against the windows over whole series, and exact selection against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import selection
from tempora.operators import preprocess, segments, states

SCHEMA = "run_id string, roi int, t double, value double, tie long"


def rows_of(rnd, n, roi):
    t, out = rnd.random() * 100, []
    for i in range(n):
        level = 50 * (i > n // 3) + 0.02 * i
        out.append(("r", roi, round(t, 1), level + rnd.gauss(0, 3) if rnd.random() < 0.95 else float(rnd.choice([0, 100])), i))
        t += rnd.choice([0, 0, 0.1, 1, 5, 30, 400]) if rnd.random() < 0.5 else 5
    return out


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(11)
    rows = [r for roi, n in enumerate([1, 2, 9, 19, 20, 24, 25, 60, 200, 500]) for r in rows_of(rnd, n, roi)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def limits(df, low, high):
    return df.select("run_id", "roi").distinct().select("*", F.lit(50.0).alias("baseline_mean"), F.lit(high).alias("upper"), F.lit(low).alias("lower"))


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and math.isclose(p, q, rel_tol=1e-7, abs_tol=1e-6) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("seconds", [0.5, 40, 1e9])
@pytest.mark.parametrize("low,high", [(20.0, 60.0), (60.0, 40.0)])
def test_hysteresis_and_fractions(series, seconds, low, high):
    whole, cut = states.hysteresis(series, limits(series, low, high)), segments.hysteresis(series, limits(series, low, high), seconds)
    assert table(whole, "roi", "tie", "state") == table(cut, "roi", "tie", "state")
    near(table(states.movement_fraction(whole, 60), "roi", "bin_start", "fraction"), table(segments.movement_fraction(cut, 60, seconds), "roi", "bin_start", "fraction"))


@pytest.mark.parametrize("seconds", [0.5, 40, 1e9])
def test_jumps_and_detrending(series, seconds):
    near(table(preprocess.detect_jumps(series), "roi", "tie", "n", "jump"), table(segments.detect_jumps(series, seconds), "roi", "tie", "n", "jump"))
    near(table(preprocess.detrend(series), "roi", "tie", "value"), table(segments.detrend(series, seconds), "roi", "tie", "value"))


def test_empty_series(series):
    none = series.limit(0)
    assert segments.detrend(none, 60).collect() == [] and segments.hysteresis(none, limits(series, 1.0, 2.0), 60).collect() == []


def test_pipeline(series):
    whole, cut = (states.analyze(series, "baseline", minutes=5, interval=5, segment=s)["bins"] for s in (None, 100))
    near(table(whole, "roi", "bin_start", "fraction", "sleep"), table(cut, "roi", "bin_start", "fraction", "sleep"))


@pytest.mark.parametrize("bins,small", [(16, 2), (4096, 1000)])
def test_percentiles(spark, bins, small):
    rnd = random.Random(2)
    groups = {
        "even": [float(i) for i in range(101)], "one": [3.5], "two": [-1.0, 4.0], "same": [2.0] * 50, "ties": [float(rnd.randint(0, 5)) for _ in range(300)],
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(60)], "normal": [rnd.gauss(0, 1) for _ in range(400)], "huge": [-1.7e308, 1.7e308, 0.0, 5e-324],
    }
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: r for r in selection.percentiles(df, ("k",), "v", {"a": 0.0, "b": 0.05, "m": 0.5, "q": 0.77, "z": 1.0}, bins, small).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = sorted(vs)
        for c, p in (("a", 0.0), ("b", 0.05), ("m", 0.5), ("q", 0.77), ("z", 1.0)):
            at = p * (len(vs) - 1)
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            want = low + (high - low) * (at - math.floor(at)) if at % 1 else low
            assert got[k][c] == pytest.approx(want, rel=1e-12, abs=0) or k == "huge" and math.isinf(high - low), (k, c)
