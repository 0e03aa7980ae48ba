"""Times the headline queries at $BENCH_SF_DIR and the two larger workloads on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up (compilation, Python workers) and is timed in a
second run, with its number of rows. ``value`` is the sum over the headline queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from geolattice.operators import neighbors, spectral
from geolattice.queries import QUERIES
from geolattice.shipping import ship
from geolattice.sources import generators

HEADLINE = (
    "radius_join", "knn_join", "grid_join", "complete_adjacency", "gaussian_affinity", "laplacian_geometric", "laplacian_symmetricnormalized",
    "neighbourhood_statistics", "connected_components", "shortest_paths", "spectral_embedding", "dual_metric", "riemann_metric", "barycenter_weights",
    "ltsa_matrix", "isomap_embedding", "kmeans_clusters", "radius_search", "relaxation_loss",
)


def s_curve_edges(spark: SparkSession) -> DataFrame:
    """Radius search over 100,000 points of an S-curve."""
    return neighbors.adjacency(generators.s_curve(spark, 100_000), "blocks", radius=0.1)


def swiss_roll_embedding(spark: SparkSession) -> DataFrame:
    """Spectral embedding of 10,000 points of a swiss roll in 20 dimensions, seven components."""
    roll = generators.swiss_roll(spark, 10_000, 20)
    geom = {"adjacency_radius": 2.0, "affinity_radius": 1.0}
    return spectral.SpectralEmbedding(7, geom=geom, eigen_solver="amg").fit(roll).embedding_


def timed(make) -> tuple[float, int]:
    start = time.time()
    rows = make().count()
    return round(time.time() - start, 3), rows


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken, first, rows = {}, {}, {}
    for name in HEADLINE:
        for into in (first, taken):
            start, seen = time.time(), Observation()
            QUERIES[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            into[name], rows[name] = round(time.time() - start, 3), seen.get["rows"]
            spark.catalog.clearCache()
    ship(spark)
    larger = {}
    for name, make in (("s_curve_100k_radius_0.1", s_curve_edges), ("swiss_roll_10k_20d_embedding", swiss_roll_embedding)):
        larger[name] = dict(zip(("sec", "rows"), timed(lambda: make(spark))))  # noqa: B023
        spark.catalog.clearCache()
    out = {"metric": "total wall time of the headline queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": Path(folder).name.removeprefix("sf")}
    print(json.dumps(out | {"first_run": first, "rows": rows, "larger": larger}))
    spark.stop()


if __name__ == "__main__":
    main()
