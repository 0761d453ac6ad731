"""Every registered query of the library against its SQL, on the smallest tables."""

import functools
import glob
import math
import os

import pytest

from tempora.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    @functools.cache
    def of(path):
        c = duckdb.connect()
        for f in glob.glob(f"{path}/*.parquet"):
            c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        return c

    return of


#: Queries that have no rows on the smallest tables, so that the next ones are taken.
LARGER = ("a6_until_failure", "e5_sleep_bouts")


#: Queries that SQL can't express, with the test that holds them.
BY_HAND = {"h4_clusters": "test_reference_loops.test_clusters_of_the_query"}


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, db, name):
    path = small.replace("0.001", "0.01") if name in LARGER else small
    df = catalog.queries()[name](spark, path)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    assert got, "a query without rows proves nothing"
    if sql is None:
        assert name in BY_HAND
        return
    r = db(path).sql(sql)
    at = [list(r.columns).index(c) for c in columns]
    want = [tuple(plain(row[i]) for i in at) for row in r.fetchall()]
    key = lambda t: tuple("" if v is None else f"{v:.9f}" if isinstance(v, float) else str(v) for v in t)
    assert len(got) == len(want)
    a, b = sorted(got, key=key), sorted(want, key=key)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(close(p, q) for p, q in zip(x, y, strict=True))]
    assert not bad, bad[:3]
