"""Array columns of numbers: all arithmetic in double, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def normalized(c: Column, mean: float, std: float) -> Column:
    return F.transform(c, lambda x: (x - mean) / std)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, even where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum_exp(c: Column) -> Column:
    return let(F.array_max(c), lambda top: F.ln(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top)


def log_softmax(c: Column) -> Column:
    return let(log_sum_exp(c), lambda whole: F.transform(c, lambda x: x - whole))


def argmax(c: Column) -> Column:
    """Place of the largest value, from 0; the first of equal ones."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def fused(a: Column, b: Column, how: str) -> Column:
    """``mul``, ``add`` or ``concat``; anything else is a ValueError."""
    if how == "mul":
        return F.zip_with(a, b, lambda x, y: x * y)
    if how == "add":
        return F.zip_with(a, b, lambda x, y: x + y)
    if how == "concat":
        return F.concat(a, b)
    raise ValueError(f"unknown fusion {how!r}")
