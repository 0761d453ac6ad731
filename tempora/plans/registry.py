"""Registration of queries with their SQL; both sides select, cast and round by one list of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(c: Column, digits: int) -> Column:
    """c with its halves rounded as the SQL side does it: the product with a power of ten is rounded, and numbers that this overflows stay."""
    power = F.lit(10.0**digits)
    out = F.round(c * power) / power
    return F.when(F.abs(out) == float("inf"), c).otherwise(out) + F.lit(0.0)


def query(name: str, columns: str, sql: str | None = None):
    """columns: names, with :int for whole numbers and :k for numbers rounded to k digits. sql: text whose last SELECT has them."""
    parts = [(c.split(":") + [""])[:2] for c in columns.split()]

    def spark_column(df: DataFrame, c: str, kind: str):
        if kind == "int":
            return F.col(f"`{c}`").cast("long").alias(c)
        return rounded(F.col(f"`{c}`").cast("double"), int(kind)).alias(c) if kind else F.col(f"`{c}`").alias(c)

    def sql_column(c: str, kind: str) -> str:
        if kind == "int":
            return f'CAST("{c}" AS BIGINT) AS "{c}"'
        return f'round(CAST("{c}" AS DOUBLE), {kind}) + CAST(0 AS DOUBLE) AS "{c}"' if kind else f'"{c}"'

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(spark_column(df, c, k) for c, k in parts))

        QUERIES[name] = run
        if sql:
            SQL[name] = f"SELECT {', '.join(sql_column(c, k) for c, k in parts)} FROM ({sql}) AS result"
        return f

    return register
