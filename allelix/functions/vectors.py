"""Arithmetic on arrays of doubles and on scalars, masks of bits, and distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def elementwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, op)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def logs(v: Column) -> Column:
    return F.transform(v, lambda x: F.ln(x))


def xlogx(x: Column) -> Column:
    """x ln x; null at 0 and below."""
    return x * F.ln(x)


def guarded_xlogx(x: Column) -> Column:
    """x ln x, and 0 where x is 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(x))


def x_plus_logx(x: Column) -> Column:
    return x + F.ln(x)


def sum_xlogx(v: Column) -> Column:
    return total(F.transform(v, guarded_xlogx))


def is_set(mask: Column, i: Column) -> Column:
    """Whether bit i of the mask is set."""
    return F.getbit(mask.cast("long"), i) == 1


def masked(v: Column, mask: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    """f of each element whose bit is set in the mask, 0 for the others."""
    return F.transform(v, lambda x, i: F.when(is_set(mask, i), f(x)).otherwise(F.lit(0.0)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def integer_power(base: Column, exponent: Column) -> Column:
    return F.pow(base, exponent).cast("long")


def linear_distance(p: Column, q: Column) -> Column:
    return F.abs(p - q)


def circular_distance(p: Column, q: Column, size: Column) -> Column:
    return F.least(size - F.abs(p - q), F.abs(p - q))
