"""Column functions over array<double> vectors; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(column: Column | str) -> Column:
    return F.col(column).cast("array<double>") if isinstance(column, str) else column.cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_finite(v: Column) -> Column:
    """True for a vector without null, NaN and infinite components."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def hashed_unit(*columns: Column | int) -> Column:
    """A pseudo-random number in [0, 1) that depends on the columns alone, not on the partitioning."""
    return F.pmod(F.xxhash64(*[F.lit(c) if isinstance(c, int) else c for c in columns]), F.lit(1 << 40)) / float(1 << 40)


def hashed_normal(column: Column, seed: int) -> Column:
    """A standard normal number made from two hashed uniform ones."""
    u = 1.0 - hashed_unit(column, 2 * seed)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * 3.141592653589793 * hashed_unit(column, 2 * seed + 1))
