"""Point sets made from hashed random numbers: the same whatever the partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import hashed_normal, hashed_unit


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def uniform(spark: SparkSession, n: int, dims: int, seed: int = 0) -> DataFrame:
    """Uniform in the unit cube."""
    return _ids(spark, n).select("id", F.array(*[hashed_unit(F.col("id"), seed * 1000 + k) for k in range(dims)]).alias("v"))


def normal(spark: SparkSession, n: int, dims: int, seed: int = 0) -> DataFrame:
    """Standard normal."""
    return _ids(spark, n).select("id", F.array(*[hashed_normal(F.col("id"), seed * 1000 + k) for k in range(dims)]).alias("v"))


def grid(spark: SparkSession, side: int, dims: int = 2) -> DataFrame:
    """Whole-number points of a cube; id counts with the first coordinate slowest."""
    at = lambda k: F.pmod(F.floor(F.col("id") / side ** (dims - 1 - k)), F.lit(side)).cast("double")
    return _ids(spark, side**dims).select("id", F.array(*[at(k) for k in range(dims)]).alias("v"))


def blobs(spark: SparkSession, n: int, dims: int, centers: int, spread: float = 1.0, width: float = 10.0, seed: int = 0) -> DataFrame:
    """(id, v, label): normal clouds of equal sizes around centres uniform in [-width, width]."""
    label = F.pmod(F.col("id"), F.lit(centers))
    v = [(hashed_unit(label, seed * 1000 + 500 + k) * 2 - 1) * width + spread * hashed_normal(F.col("id"), seed * 1000 + k) for k in range(dims)]
    return _ids(spark, n).select("id", F.array(*v).alias("v"), label.cast("int").alias("label"))


def s_curve(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """An S-shaped sheet in three dimensions."""
    t = 3 * math.pi * (hashed_unit(F.col("id"), seed * 1000) - 0.5)
    v = [F.sin(t), 2.0 * hashed_unit(F.col("id"), seed * 1000 + 1), F.signum(t) * (F.cos(t) - 1)]
    return _ids(spark, n).select("id", F.array(*_noisy(v, noise, seed)).alias("v"))


def circle(spark: SparkSession, n: int, radius: float = 1.0) -> DataFrame:
    """n points at even steps on a circle, in order of their ids."""
    at = F.col("id") * (2 * math.pi / n)
    return _ids(spark, n).select("id", F.array(radius * F.cos(at), radius * F.sin(at)).alias("v"))


def _folded(x: np.ndarray) -> list[np.ndarray]:
    """An axis bent into an S: its values run over three half circles of equal curvature."""
    length = x.max() - x.min()
    t = 3 * math.pi * ((x - x.min()) / (length or 1.0) - 0.5)
    size = (length or 1.0) / (3 * math.pi)
    return [size * np.sign(t) * (1 - np.cos(t)), size * np.sin(t)]


def folded_sheet(spark: SparkSession, side: int, folds: int = 2, rotate: bool = True, seed: int = 0) -> DataFrame:
    """A square grid of side * side points; each fold bends every axis into an S-curve, which doubles the dimension. ``rotate`` turns all by a random orthogonal matrix.

    A folded axis depends on one coordinate of the grid, so that only tables of ``side`` values are needed.
    """
    axes = [(k, np.arange(side) / max(1, side - 1)) for k in range(2)]
    for _ in range(folds):
        axes = [(k, y) for k, x in axes for y in _folded(x)]
    turn = np.eye(len(axes))
    if rotate:
        turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal(turn.shape))
    # Rows of both grid coordinates' parts, already turned; a point is the sum of two of them.
    parts = [np.stack([x if k == own else np.zeros(side) for own, x in axes], 1) @ turn for k in range(2)]
    tables = [spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(part)], f"g{k} long, t{k} array<double>") for k, part in enumerate(parts)]
    ids = _ids(spark, side * side).select("id", F.pmod(F.col("id"), F.lit(side)).alias("g0"), F.floor(F.col("id") / side).alias("g1"))
    both = ids.join(F.broadcast(tables[0]), "g0").join(F.broadcast(tables[1]), "g1")  # ``side`` rows each
    return both.select("id", F.zip_with("t0", "t1", lambda a, b: a + b).alias("v"))


def hourglass(spark: SparkSession, n: int, noise: float | Sequence[float] = 0.0, extra_dims: int = 0, extra_noise: float | Sequence[float] = 0.1, scale: float = 1.75, seed: int = 0) -> DataFrame:
    """A sphere drawn in at its waist (radius -4 z^4 + 4 z^2 + 1), with normal noise on its coordinates and in further dimensions; a sequence gives each dimension's deviation."""
    g = [hashed_normal(F.col("id"), seed * 1000 + k) for k in range(3)]
    length = F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])
    z = g[2] / length
    r = -4 * F.pow(z, 4) + 4 * z * z + 1
    theta, phi = F.atan2(g[1], g[0]), F.acos(z / r)
    v = [0.5 * r * F.cos(theta) * F.sin(phi), 0.5 * r * F.sin(theta) * F.sin(phi), r * F.cos(phi)]
    v = _noisy([scale * c for c in v], noise, seed)
    far = extra_noise if isinstance(extra_noise, Sequence) else [extra_noise] * extra_dims
    if len(far) != extra_dims:
        raise ValueError("give one deviation for each further dimension")
    v += [s * hashed_normal(F.col("id"), seed * 1000 + 200 + k) for k, s in enumerate(far)]
    return _ids(spark, n).select("id", F.array(*v).alias("v"))


def swiss_roll(spark: SparkSession, n: int, dims: int = 20, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """A rolled sheet in three dimensions; the further ones hold normal noise."""
    t = 1.5 * math.pi * (1 + 2 * hashed_unit(F.col("id"), seed * 1000))
    v = [t * F.cos(t), 21.0 * hashed_unit(F.col("id"), seed * 1000 + 1), t * F.sin(t)]
    v += [F.lit(0.0)] * (dims - 3)
    return _ids(spark, n).select("id", F.array(*_noisy(v, noise, seed)).alias("v"))


def _noisy(v: list[Column], noise: float | Sequence[float], seed: int) -> list[Column]:
    sizes = list(noise) if isinstance(noise, Sequence) else [noise] * len(v)
    if len(sizes) != len(v):
        raise ValueError("give one deviation for each dimension")
    return [c + s * hashed_normal(F.col("id"), seed * 1000 + 100 + k) if s else c for k, (c, s) in enumerate(zip(v, sizes))]
