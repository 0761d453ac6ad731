"""Least squares in closed form from grouped sums, and other numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, or the default where b is 0."""
    out = F.try_divide(a, b)
    return out if default is None else F.coalesce(out, F.lit(default))


def determinant(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve3(m: list[list[Column]], y: list[Column]) -> list[Column]:
    """The three unknowns of m x = y by Cramer's rule; null if the matrix is singular."""
    whole = determinant(m)
    swap = lambda k: [[y[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]
    return [F.try_divide(determinant(swap(k)), whole) for k in range(3)]


def percentile(column: str, p: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.expr(f"percentile({column}, {p})")
