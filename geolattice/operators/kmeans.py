"""K-means with orthogonal starting centres, and spectral clustering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, squared_distance
from ..plans.geometry import Geometry
from .checks import InvalidInput
from .spectral import bind_geometry, spectrum


def _centres(centres: Sequence[Sequence[float]]):
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])


def assign(points: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """(id, v, label): the nearest of k centres, the first of equally near ones."""
    d = F.transform(_centres(centres), lambda c: squared_distance(F.col("v"), c))
    return points.select("id", "v", (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("label"))


def centroids(labelled: DataFrame, dims: int) -> DataFrame:
    """(label, c): means of the labels' points."""
    return labelled.groupBy("label").agg(F.array(*[F.avg(F.col("v")[k]) for k in range(dims)]).alias("c"))


def orthogonal_centres(points: DataFrame, k: int, first: int | None = None) -> list[list[float]]:
    """k starting centres: the point of id ``first`` (the smallest by default), then again and again the point whose largest cosine to the chosen ones is smallest in size."""
    pick = lambda df: df.select("v").first()
    row = pick(points.where(F.col("id") == first)) if first is not None else pick(points.orderBy("id").limit(1))
    if row is None:
        raise InvalidInput("there is no first centre")
    chosen = [list(row["v"])]
    while len(chosen) < k:
        cosines = F.transform(_centres(chosen), lambda c: dot(F.col("v"), c) / (norm(F.col("v")) * norm(c)))
        far = F.abs(F.array_max(cosines))
        best = points.where(~F.coalesce(F.isnan(far), F.lit(True))).agg(F.min_by("v", F.struct(far, F.col("id"))).alias("v")).first()
        chosen.append(list(best["v"] if best["v"] is not None else chosen[-1]))
    return chosen


@dataclass
class KMeans:
    """Lloyd's iteration until the set of centres stands still; an empty cluster restarts at the point farthest from its centre."""

    n_clusters: int
    max_iter: int = 100
    tolerance: float = 1e-12
    first: int | None = None

    def fit(self, points: DataFrame) -> KMeans:
        points = points.persist()
        centres = orthogonal_centres(points, self.n_clusters, self.first)
        dims = len(centres[0])
        self.n_iter_ = 0
        for _ in range(self.max_iter):
            labelled = assign(points, centres)
            found = {r["label"]: list(r["c"]) for r in centroids(labelled, dims).collect()}  # k rows
            taken: list[int] = []
            for label in range(len(centres)):
                if label not in found:
                    own = F.transform(_centres(centres), lambda c: squared_distance(F.col("v"), c))
                    free = points.where(~F.col("id").isin(taken)) if taken else points
                    r = free.agg(F.max_by(F.struct("id", "v"), F.struct(F.array_min(own), -F.col("id"))).alias("p")).first()["p"]
                    taken.append(r["id"])
                    found[label] = list(r["v"])
            new = [found[label] for label in range(len(centres))]
            self.n_iter_ += 1
            still = np.allclose(sorted(new), sorted(centres), rtol=0, atol=self.tolerance)
            centres = new
            if still:
                break
        self.centres_ = centres
        self.labels_ = assign(points, centres).select("id", "label")
        points.unpersist()
        return self


@dataclass
class SpectralClustering:
    """Clusters by k-means over the leading eigenvectors of the random walk's transition matrix, L + I with the unscaled L."""

    n_clusters: int
    radius: float | None = None
    geom: Geometry | Mapping | None = None
    laplacian_method: str = "randomwalk"
    eigen_solver: str = "auto"
    additional_vectors: int = 0
    random_state: int | None = None
    max_iter: int = 100

    def fit(self, data: DataFrame, input_type: str = "affinity") -> SpectralClustering:
        geom = self.geom_ = bind_geometry(self.geom, self.radius, data, input_type)
        geom.laplacian_method = self.laplacian_method
        geom.laplacian_kwds.pop("scale", None)
        geom.compute_laplacian_matrix()
        k = self.n_clusters + self.additional_vectors
        found = spectrum(geom.laplacian, geom.weights, geom.ids(), self.laplacian_method, k, None, self.eigen_solver, seed=self.random_state or 0)
        v = found.vectors.select("id", F.slice("v", 2, k - 1).alias("v"))
        length = norm(F.col("v"))
        v = v.select("id", F.transform("v", lambda x: x / F.when(length > 0, length).otherwise(1.0)).alias("v"))
        self.eigenvalues_ = found.values + 1
        model = KMeans(self.n_clusters, self.max_iter).fit(v)
        self.labels_ = self.embedding_ = model.labels_
        return self

    def fit_transform(self, data: DataFrame, input_type: str = "affinity") -> DataFrame:
        return self.fit(data, input_type).labels_
