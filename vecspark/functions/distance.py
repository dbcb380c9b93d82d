"""Distances of vector columns as expressions, in double precision and in order of the elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; fails on vectors of different length."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))) + F.coalesce(same.cast("double"), F.lit(0.0))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - inner_product(a, b) / (F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b)))
