"""Scalar expressions of scoring, all inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    """Logistic function that stays finite on both sides."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def dot(intercept: float, terms: Sequence[tuple[float, Column]]) -> Column:
    """intercept + sum of coefficient * column, in the order given."""
    return reduce(lambda acc, t: acc + F.lit(float(t[0])) * t[1], terms, F.lit(float(intercept)))


def bin_index(x: Column, cuts: Sequence[float]) -> Column:
    """Cuts below x (left bisection); NaN, which no cut is below, falls into bin 0."""
    n = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < x)) if cuts else F.lit(0)
    return F.when(F.isnan(x), F.lit(0)).otherwise(n)


def strides(shape: Sequence[int]) -> list[int]:
    """Row-major strides."""
    out = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        out[k] = out[k + 1] * shape[k + 1]
    return out


def flat_index(bins: Sequence[Column], shape: Sequence[int]) -> Column:
    return reduce(lambda a, b: a + b, (b.cast("long") * F.lit(s) for b, s in zip(bins, strides(shape), strict=True)))


def isotonic(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation between (xs, ys), clipped at the ends; NaN stays NaN."""
    ax, ay = F.array(*(F.lit(float(v)) for v in xs)), F.array(*(F.lit(float(v)) for v in ys))
    i = F.size(F.filter(ax, lambda v: v <= x))
    x0, x1, y0, y1 = F.get(ax, i - 1), F.get(ax, i), F.get(ay, i - 1), F.get(ay, i)
    between = F.when(x1 == x0, y1).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.when(F.isnan(x), x).when(x <= float(xs[0]), F.lit(float(ys[0]))).when(x >= float(xs[-1]), F.lit(float(ys[-1]))).otherwise(between)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b as SQL engines of IEEE numbers have it: where b is 0, infinite with the sign of a, or NaN if a is 0 as well."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))
