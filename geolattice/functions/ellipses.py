"""Geometry of covariance ellipses as numbers; nothing is drawn."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .small_matrices import eigenvalues_2x2


def covariance_ellipses(points: DataFrame, group: str, deviations: float = 2.0) -> DataFrame:
    """(group, x, y, width, height, angle) of 2-d points: centre, full axes of the ellipse of so many deviations, and the long axis' angle in degrees."""
    x, y = F.col("v")[0], F.col("v")[1]
    c = points.groupBy(group).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_samp(x).alias("a"), F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("d"))
    return c.select(group, "x", "y", *ellipse(F.col("a"), F.col("b"), F.col("d"), deviations))


def ellipse(a: Column, b: Column, d: Column, deviations: float = 2.0) -> list[Column]:
    """width, height and angle of the covariance [[a, b], [b, d]]."""
    big, small = eigenvalues_2x2(a, b, d)
    angle = F.degrees(F.when(b != 0, F.atan2(big - a, b)).when(a >= d, F.lit(0.0)).otherwise(F.lit(math.pi / 2)))
    return [(2 * deviations * F.sqrt(big)).alias("width"), (2 * deviations * F.sqrt(F.greatest(small, F.lit(0.0)))).alias("height"), angle.alias("angle")]


def ellipse_3d(covariance: np.ndarray, deviations: float = 2.0) -> tuple[float, float, float, np.ndarray]:
    """width, height, angle in its plane (degrees, 0 to 180) and upward unit normal of the ellipse of the two largest axes.

    The plane's own axes are what the x and y axes become when the z axis is turned
    into the normal the short way.
    """
    values, vectors = np.linalg.eigh(covariance)
    width, height = 2 * deviations * np.sqrt(np.maximum(values[::-1][:2], 0))
    normal, long = vectors[:, 0], vectors[:, 2]
    normal = normal if normal[2] >= 0 else -normal
    right, ahead = plane_axes(normal)
    return float(width), float(height), float(np.degrees(np.arctan2(long @ ahead, long @ right)) % 180), normal


def plane_axes(normal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the x and y axes go when the z axis is turned into an upward unit normal."""
    a, b, c = (float(x) for x in normal)
    k = 1 / (1 + c)
    return np.array([1 - a * a * k, -a * b * k, -a]), np.array([-a * b * k, 1 - b * b * k, -b])


def ellipse_3d_of(covariance: Column | str) -> Column:
    """``ellipse_3d`` of a column of 3 x 3 arrays, as a struct."""

    @F.pandas_udf("struct<width double, height double, angle double, normal array<double>>")
    def run(covariances: pd.Series) -> pd.DataFrame:
        got = [ellipse_3d(np.array([list(r) for r in c], float)) for c in covariances]
        return pd.DataFrame({"width": [g[0] for g in got], "height": [g[1] for g in got], "angle": [g[2] for g in got], "normal": [g[3].tolist() for g in got]})

    return run(covariance)
