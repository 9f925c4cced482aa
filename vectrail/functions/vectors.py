"""Vectors (ARRAY<DOUBLE>) as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used;
    inside a lambda it would else be computed anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normalise(a: Column) -> Column:
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n)))


def unit_or_null(a: Column, least: float = 1e-8, renormalise: bool = True) -> Column:
    """Of length one (or as it is, unless ``renormalise``); null where it vanishes."""
    return let(a, lambda v: F.when(norm(v) >= least, normalise(v) if renormalise else v))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)
