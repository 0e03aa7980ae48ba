"""Eigenpairs of long curves, whose eigenvalues lie close together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolattice.operators import eigen, local
from geolattice.operators.spectral import SpectralEmbedding
from geolattice.sources import generators

N = 3600  # more than the dense limit


def path(spark):
    link = spark.range(N - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    both = link.unionByName(link.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return both.select("i", "j", F.lit(-1.0).alias("m")).unionByName(both.select("i", F.col("i").alias("j"), F.lit(1.0).alias("m")))


def test_null_space_of_a_path_is_waves(spark):
    found, _ = eigen.null_space(path(spark), "m", spark.range(N), 3)
    for k in range(3):
        v = found.matrix[:, k] * np.sign(found.matrix[0, k])
        assert np.abs(v - np.sqrt(2 / N) * np.cos(np.pi * (k + 1) * (np.arange(N) + 0.5) / N)).max() < 1e-10
        assert found.values[k] == pytest.approx(2 - 2 * np.cos(np.pi * (k + 1) / N), rel=1e-6)


def test_local_fits_of_a_circle_are_waves(spark):
    p = generators.circle(spark, N)
    y = local.LocallyLinearEmbedding(2, radius=2 * np.sin(1.5 * np.pi / N)).fit(p).embedding_.orderBy("id").toPandas()["y"]
    y = np.stack(y)
    assert (y * np.roll(y, -54, axis=0)).sum() == pytest.approx(2 * np.cos(2 * np.pi * 54 / N), abs=5e-6)


def test_circle_in_the_plane_of_two_eigenvectors(spark):
    y = SpectralEmbedding(2, radius=2 * np.sin(2.5 * np.pi / N)).fit(generators.circle(spark, N)).embedding_.toPandas()["y"]
    assert np.allclose((np.stack(y) ** 2).sum(1), 2 / N, rtol=1e-4)


def test_thin_solves_find_parts_and_both_ends():
    x = np.random.default_rng(3).standard_normal((80, 3))
    a = np.zeros((80, 80))
    for k in range(1, 4):
        a[np.arange(80 - k), np.arange(k, 80)] = x[: 80 - k, k - 1]
    a[:40, 40:] = 0  # two parts
    a = a + a.T + np.diag(np.random.default_rng(4).standard_normal(80))
    i, j = np.nonzero(a)
    thin = eigen.Thin.of((i, j, a[i, j]), 80)
    want = np.linalg.eigvalsh(a)
    values, v = thin.pairs(3, True, np.abs(a).sum(1).max(), np.random.default_rng(0).standard_normal((80, 15)))
    assert np.allclose(values, want[::-1][:3]) and np.allclose(a @ v, v * values, atol=1e-8)


def test_wide_graphs_are_left_to_block_iterations(monkeypatch):
    monkeypatch.setattr(eigen, "WIDEST", 8)
    i, j = np.nonzero(np.ones((40, 40)))
    assert eigen.Thin.of((i, j, np.ones(1600)), 40) is None
