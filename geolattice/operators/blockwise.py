"""Eigenpairs of symmetric matrices whose vectors do not fit the driver: LOBPCG over DataFrames.

The block, its image, the residuals and the last step stay in one table, a row an
id. A round multiplies the residuals by the matrix (one join and one sum by id),
adds up the Gram matrices of basis and image in the tasks, and sends these few
numbers to the driver, which solves the small problem and returns coefficients.
Rounds are cut by Parquet tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hashed_normal
from ..sources.storage import Scratch, cut


def list_array(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow column of lists, from its buffer."""
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def image(entries: DataFrame, vectors: DataFrame, column: str, width: int, shift: float = 0.0, factor: bool = False) -> DataFrame:
    """(id, y): A v, or shift v - A v, of entries (i, j, x) and the arrays of ``width`` numbers in ``column``; ids without entries are rows of zeros. With ``factor`` the entries are B's, A being B B^T."""
    x = vectors.select(F.col("id").alias("j"), F.col(column).alias("_v"))
    sums = [F.sum(F.col("x") * F.col("_v")[k]) for k in range(width)]
    if factor:
        x = entries.join(x.withColumnRenamed("j", "i"), "i").groupBy("j").agg(F.array(*sums).alias("_v"))
    y = entries.join(x, "j").groupBy(F.col("i").alias("id")).agg(F.array(*sums).alias("_y"))
    y = vectors.select("id", F.col(column).alias("_v")).join(y, "id", "left")
    zero = F.coalesce("_y", F.array_repeat(F.lit(0.0), width))
    return y.select("id", (F.zip_with("_v", zero, lambda a, b: shift * a - b) if shift else zero).alias("y"))


def _grams(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """S^T S and S^T A S of the basis ``s`` and its image ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            s, a = _matrix(batch.column(0)), _matrix(batch.column(1))
            if len(s):
                total = total + np.stack([s.T @ s, s.T @ a])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total).tobytes()], pa.binary())], ["g"])

    parts = [np.frombuffer(r["g"]) for r in state.select("s", "a").mapInArrow(run, "g binary").collect()]  # a few numbers a task
    both = sum(parts).reshape(2, -1)
    m = int(round(both.shape[1] ** 0.5))
    return both[0].reshape(m, m), both[1].reshape(m, m)


def _ritz(gram: np.ndarray, inner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest Ritz values and the coefficients of unit vectors, with directions that the basis hardly holds left out."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    size, u = np.linalg.eigh(gram * scale[:, None] * scale)
    good = size > 1e-11 * size.max()
    white = scale[:, None] * u[:, good] / np.sqrt(size[good])
    small = white.T @ inner @ white
    values, v = np.linalg.eigh((small + small.T) / 2)
    return values[::-1][:k], white @ v[:, ::-1][:, :k]


def _turned(state: DataFrame, values: np.ndarray, x: np.ndarray, p: np.ndarray) -> DataFrame:
    """(id, x, ax, r, p, ap): new block, its image, residuals, and the step with its image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, a = _matrix(batch.column(1)), _matrix(batch.column(2))
            parts = [s @ x, a @ x, a @ x - (s @ x) * values, s @ p, a @ p]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(list_array, parts)], ["id", "x", "ax", "r", "p", "ap"])

    arrays = ", ".join(f"{c} array<double>" for c in ("x", "ax", "r", "p", "ap"))
    return state.select("id", "s", "a").mapInArrow(run, f"id long, {arrays}")


def largest_pairs(matrix: DataFrame, value: str, ids: DataFrame, k: int, shift: float = 0.0, tolerance: float = 1e-6, rounds: int = 200, seed: int = 0, factor: bool = False) -> tuple[np.ndarray, DataFrame]:
    """The k largest eigenvalues of A (of shift - A if there is a shift), and vectors (id, v) of unit length; with ``factor`` the entries are B's, A being B B^T."""
    spark, width = matrix.sparkSession, k + 5
    with Scratch(spark, "blockwise") as scratch:
        # Kept by column, so that in each round only the block moves to the entries.
        entries = scratch.cut(matrix.select("i", "j", F.col(value).cast("double").alias("x")), "entries").repartition("i" if factor else "j").persist()
        try:
            start = ids.select("id").distinct().select("id", F.array(*[hashed_normal(F.col("id"), seed * 1000 + c) for c in range(width)]).alias("s"))
            start = scratch.cut(start, "start")
            state = scratch.cut(start.join(image(entries, start, "s", width, shift, factor).withColumnRenamed("y", "a"), "id"), "state")
            for step in range(rounds):
                gram, inner = _grams(state)
                if step and np.sqrt(np.diag(gram)[width : width + k].max()) <= tolerance * max(1.0, np.abs(values).max()):  # noqa: F821
                    break
                values, x = _ritz(gram, inner, width)
                p = x.copy()
                p[:width] = 0
                turned = scratch.cut(_turned(state, values, x, p), "turned")
                blocks = ("x", "r", "p") if step else ("x", "r")
                joined = turned.join(image(entries, turned, "r", width, shift, factor).withColumnRenamed("y", "ar"), "id")
                state = scratch.cut(joined.select("id", F.concat(*blocks).alias("s"), F.concat(*(f"a{c}" for c in blocks)).alias("a")), "state")
            found = _turned(state, values, *(2 * [_first(width, state.select(F.size("s")).first()[0])]))
            return values[:k], cut(found.select("id", F.slice("x", 1, k).alias("v")), "vectors")
        finally:
            entries.unpersist()


def _first(width: int, size: int) -> np.ndarray:
    return np.eye(size, width)


def fixed_signs(vectors: DataFrame, k: int) -> DataFrame:
    """Makes each column's entry of largest size positive; near ties go to the smallest id."""
    return _with_factors(vectors, k, [F.lit(1.0)] * k)


def unit_columns(vectors: DataFrame, k: int) -> DataFrame:
    """Columns of length one, with fixed signs."""
    squares = vectors.agg(*[F.sum(F.col("v")[c] * F.col("v")[c]) for c in range(k)]).first()  # k numbers
    return _with_factors(vectors, k, [F.lit(1 / x**0.5 if x else 1.0) for x in squares])


def _with_factors(vectors: DataFrame, k: int, factors: list[Column]) -> DataFrame:
    size = [F.abs(F.col("v")[c]) for c in range(k)]
    most = vectors.agg(*[F.max(s) for s in size]).first()  # k numbers
    near = [F.when(s >= (m or 0.0) * (1 - 1e-9), F.col("id")) for s, m in zip(size, most)]
    signs = vectors.agg(*[F.min_by(F.signum(F.col("v")[c]), near[c]) for c in range(k)]).first()
    return vectors.select("id", F.array(*[F.col("v")[c] * factors[c] * F.lit(float(signs[c] or 1.0)) for c in range(k)]).alias("v"))
