"""Numeric Column helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and infinities become null, so that averages skip them."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(num, den) -> Column:
    """Division that gives null on a zero denominator."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def clamp(c, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def dist(dx, dy) -> Column:
    dx, dy = col(dx), col(dy)
    return F.sqrt(dx * dx + dy * dy)


def wrap_angle(a) -> Column:
    """Angle wrapped into [-pi, pi)."""
    a = col(a)
    return a - 2 * math.pi * F.floor((a + math.pi) / (2 * math.pi))


def rounded6(c) -> Column:
    return F.floor(col(c) * 1e6 + 0.5) / 1e6


def dot(a, b) -> Column:
    """Inner product of two arrays in double precision, summed left to right."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def sq_l2(a, b) -> Column:
    def step(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(col(a), col(b), step), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))
