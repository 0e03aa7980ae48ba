"""Validation of points and matrices, symmetry, diagonals and symmetrisation in long form.

A matrix is a table (i, j, value): what is missing is zero (or, of distances, infinite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_vector, is_finite


class InvalidInput(ValueError):
    """The data or parameters can't be used."""


def as_points(df: DataFrame, id_column: str, vector: str | Column) -> DataFrame:
    """(id, v) from an id column and a vector of any numeric type."""
    return df.select(F.col(id_column).cast("long").alias("id"), as_vector(vector).alias("v"))


def point_report(points: DataFrame) -> DataFrame:
    """One row: rows, distinct ids, smallest and largest dimension, rows with null or non-finite components."""
    return points.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.min(F.size("v")).alias("min_dim"),
        F.max(F.size("v")).alias("max_dim"),
        F.count_if(~F.coalesce(is_finite(F.col("v")), F.lit(False))).alias("bad"),
    )


def check_points(points: DataFrame, min_samples: int = 1, min_features: int = 1) -> tuple[int, int]:
    """(rows, dimension); raises InvalidInput unless ids are distinct and all vectors finite and of one dimension."""
    r = point_report(points).first()
    if r["n"] < min_samples:
        raise InvalidInput(f"{r['n']} points, at least {min_samples} are needed")
    if r["ids"] != r["n"]:
        raise InvalidInput("ids are null or repeated")
    if r["bad"]:
        raise InvalidInput(f"{r['bad']} points hold null, NaN or infinite components")
    if r["n"] and (r["min_dim"] != r["max_dim"] or r["min_dim"] < min_features):
        raise InvalidInput(f"dimensions from {r['min_dim']} to {r['max_dim']}, at least {min_features} are needed")
    return r["n"], r["max_dim"] or 0


def check_seed(seed: int | None) -> int:
    """A seed for hashed random numbers; None is 0, so that runs repeat."""
    if seed is None:
        return 0
    if isinstance(seed, bool) or not isinstance(seed, int):
        raise InvalidInput(f"{seed!r} can't be used as a seed")
    return seed


def check_square(matrix: DataFrame, n: int | None = None) -> DataFrame:
    """The matrix, if its ids are not null and, with ``n``, lie in 0..n-1."""
    bad = F.col("i").isNull() | F.col("j").isNull()
    if n is not None:
        bad |= (F.col("i") < 0) | (F.col("j") < 0) | (F.col("i") >= n) | (F.col("j") >= n)
    if not matrix.where(bad).isEmpty():
        raise InvalidInput("the matrix is not square over the ids")
    return matrix


def asymmetry(matrix: DataFrame, value: str) -> DataFrame:
    """One row with the largest |a(i, j) - a(j, i)|, null for an empty matrix."""
    both = matrix.select("i", "j", F.col(value).alias("x")).unionByName(matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col(value)).alias("x")))
    return both.groupBy("i", "j").agg(F.sum("x").alias("x")).agg(F.max(F.abs("x")).alias("asymmetry"))


def is_symmetric(matrix: DataFrame, value: str, tolerance: float = 1e-8) -> bool:
    worst = asymmetry(matrix, value).first()[0]
    return worst is None or worst < tolerance


def symmetrize(matrix: DataFrame, value: str) -> DataFrame:
    """(A + A^T) / 2; an entry that only one side has is halved."""
    half = (F.col(value) * 0.5).alias(value)
    turned = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), half)
    return matrix.select("i", "j", half).unionByName(turned).groupBy("i", "j").agg(F.sum(value).alias(value))


def check_symmetric(matrix: DataFrame, value: str, tolerance: float = 1e-10, raise_error: bool = False) -> DataFrame:
    """The matrix if it is symmetric, else its symmetric part, or InvalidInput."""
    if is_symmetric(matrix, value, tolerance):
        return matrix
    if raise_error:
        raise InvalidInput("the matrix is not symmetric")
    return symmetrize(matrix, value)


def set_diagonal(matrix: DataFrame, value: str, ids: DataFrame, to: float = 1.0) -> DataFrame:
    """The matrix with ``to`` on the diagonal of all ids."""
    diagonal = ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(to).cast("double").alias(value))
    return matrix.where("i <> j").select("i", "j", value).unionByName(diagonal)


def censor(edges: DataFrame, radius: float) -> DataFrame:
    """Distances up to the radius, without the zeros (self edges and copies)."""
    return edges.where((F.col("d") <= radius) & (F.col("d") > 0))


def systematic_sample(points: DataFrame, step: int, first: int = 0) -> DataFrame:
    """Every ``step``-th id, from ``first`` on."""
    if step < 1:
        raise InvalidInput("the step must be 1 at least")
    return points.where(F.pmod(F.col("id") - first, F.lit(step)) == 0)


def max_distance(edges: DataFrame) -> DataFrame:
    """One row with the largest distance; null without edges."""
    return edges.agg(F.max("d").alias("d"))


def rows_of(matrix: DataFrame, sample: DataFrame, row: str = "i") -> DataFrame:
    """Rows of a sample of ids."""
    return matrix.join(sample.select(F.col("id").alias(row)), row, "left_semi").select(matrix.columns)
