"""Distances as column expressions, all evaluated inside generated code or built-in array functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX, INT_MIN = 2147483647, -2147483648


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two lists of words."""
    return reduce(lambda x, y: x + y, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=False)))


def ternary(sa: list[Column], ma: list[Column], sb: list[Column], mb: list[Column]) -> Column:
    """The squared distance of two vectors over -1, 0 and 1, from sign and mask words."""
    each = (4 * F.bit_count(x.bitwiseAND(y).bitwiseAND(p.bitwiseXOR(q))) + F.bit_count(x.bitwiseXOR(y)) for p, x, q, y in zip(sa, ma, sb, mb, strict=True))
    return reduce(lambda x, y: x + y, each)


def squared(a: Column, b: Column) -> Column:
    """The squared distance of two arrays, in doubles."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v)


def squared_half(query: Column, stored: Column) -> Column:
    """The same with the difference taken in floats."""
    d = F.zip_with(query, stored, lambda x, y: (x.cast("float") - y.cast("float")).cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v)


def asymmetric(z: Column, code: Column) -> Column:
    """The squared distance of a rotated query and a code unpacked to its values."""
    return squared(z, code)


def clamped(value: Column) -> Column:
    """Truncated to an int that stays within its range."""
    return F.least(F.greatest(value, F.lit(float(INT_MIN))), F.lit(float(INT_MAX))).cast("int")


def score(distance: Column) -> Column:
    return clamped(distance * 1e6)


def scaled(distance: Column) -> Column:
    """The whole-number key of float mode."""
    return clamped(distance * 1000)
