"""Vector arithmetic as column expressions.

Vectors are array<double> columns of a length known when the plan is made. Everything is unrolled
into plain arithmetic on elements, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from math import cos, pi, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def items(v: Column | str, n: int) -> list[Column]:
    v = F.col(v) if isinstance(v, str) else v
    return [v.getItem(k) for k in range(n)]


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def dot(a, b, n: int) -> Column:
    return total([x * y for x, y in zip(items(a, n), items(b, n), strict=True)])


def mean(v, n: int) -> Column:
    return total(items(v, n)) / F.lit(float(n))


def energy(v, n: int) -> Column:
    """Sum of squares."""
    return dot(v, v, n)


def norm(v, n: int) -> Column:
    return F.sqrt(energy(v, n))


def centred(v, n: int) -> Column:
    m = mean(v, n)
    return F.array(*[x - m for x in items(v, n)])


def mirror(v) -> Column:
    return F.reverse(v)


def ramp(low: float, high: float, n: int) -> list[float]:
    """n evenly spaced values from low to high."""
    return np.linspace(low, high, n).tolist()


def dct_matrix(n: int) -> list[list[float]]:
    """Rows of the orthonormal DCT-II."""
    return [[(sqrt(1 / n) if k == 0 else sqrt(2 / n)) * cos(pi * (2 * j + 1) * k / (2 * n)) for j in range(n)] for k in range(n)]


def dct(xs: list[Column]) -> list[Column]:
    """DCT-II coefficients, orthonormal, of the elements xs."""
    return [total([x * F.lit(c) for x, c in zip(xs, row, strict=True)]) for row in dct_matrix(len(xs))]


def clip(x: Column, limit: float) -> Column:
    return F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))


def correlation_bound(r, d, n: int) -> Column:
    """|<r, d>| / (|r| |d|) of centred vectors; 0 if one is shorter than 1e-12."""
    a, b = norm(r, n), norm(d, n)
    return F.when((a < 1e-12) | (b < 1e-12), F.lit(0.0)).otherwise(F.abs(dot(r, d, n)) / (a * b))
