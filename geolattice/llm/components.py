"""Connected components of a link table whose ends may be null or equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node that has a link to another one; component is the smallest node reachable.

    Null ends and self links are ignored; repeated links count once.
    """
    edges = links.select(F.col(a).cast("long").alias("i"), F.col(b).cast("long").alias("j")).where("i <> j")
    return graph.connected_components(edges).select(F.col("id").alias("node"), "component")
