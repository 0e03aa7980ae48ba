"""Comparing all members of an area block by block, spread over tasks by pairs of tiles.

An area (a cluster, a cell) is cut into blocks of rows. TILE blocks make a tile, and
each pair of tiles whose sizes allow links is a unit of work, with a row for each of
its blocks. Units are dealt out by their hash, so that a large area is as many units
as it needs and no task holds it. Pairs of tiles are made from small rows; a block
travels once for each tile that its own meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 4


def units(blocks: DataFrame, keys: list[str], payload: list[str], percent: int = 100, within: bool = True) -> DataFrame:
    """(unit, side, block, payload) of ``blocks`` (keys, class, block, low, high, payload).

    Tiles meet within one class (with ``within``) and with the next one if their
    sizes, ``low`` to ``high``, allow a ratio of ``percent``. A unit of a tile and itself has only
    rows of side 0; its blocks meet each other and themselves.
    """
    tiled = blocks.withColumn("tile", F.floor(F.col("block") / TILE))
    tiles = tiled.groupBy(*keys, "class", "tile").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    left = tiles.select(*keys, F.col("class").alias("at"), F.col("class").alias("ca"), F.col("tile").alias("ta"), F.col("low").alias("la"), F.col("high").alias("ha"))
    right = tiles.select(*keys, F.explode(F.array("class", F.col("class") - 1)).alias("at"), F.col("class").alias("cb"), F.col("tile").alias("tb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    pairs = left.join(right, [*keys, "at"]).where(f"(ca < cb or ta <= tb) and {percent} * la <= 100 * hb and {percent} * lb <= 100 * ha")
    pairs = pairs if within else pairs.where("ca < cb")
    pairs = pairs.withColumn("unit", F.xxhash64(*keys, "ca", "ta", "cb", "tb"))
    one = F.struct(F.lit(0).alias("side"), F.col("ca").alias("class"), F.col("ta").alias("tile"))
    two = F.struct(F.lit(1).alias("side"), F.col("cb").alias("class"), F.col("tb").alias("tile"))
    same = F.col("ca").eqNullSafe(F.col("cb")) & (F.col("ta") == F.col("tb"))
    asked = pairs.select(*keys, "unit", F.explode(F.when(same, F.array(one)).otherwise(F.array(one, two))).alias("part")).select(*keys, "unit", "part.*")
    return asked.join(tiled, [*keys, "class", "tile"]).select("unit", "side", "block", *payload)


def block_pairs(sides: list[int]) -> list[tuple[int, int]]:
    """Pairs of rows of a unit to compare, given their sides: across sides, or all of one and each with itself."""
    zero, other = [i for i, s in enumerate(sides) if s == 0], [i for i, s in enumerate(sides) if s]
    return [(a, b) for a in zero for b in other] if other else [(a, b) for k, a in enumerate(zero) for b in zero[k:]]
