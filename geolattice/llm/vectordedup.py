"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

Vectors are compared within their label only. Equal ones collapse first. A label
of more than CELL vectors is divided by unit centres (spherical k-means on a
bounded sample); a vector goes to its best cell and to every other whose cosine
is within SLACK of the best, so that most near pairs meet in some cell. Cells are
cut into blocks of rows, pairs of blocks (dealt out over tasks) are multiplied as
matrices in double precision, and only sums of links and spanning forests leave a task. A pair that
shares several cells counts in the first of them. All vectors are indexed and
cells have no cap; what is approximate is only that a near pair may share no
cell (the README has measured recall).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Scratch
from ..operators.tiles import block_pairs, units
from .components import connected_components
from .forest import forest
from .session import materialize

COSINE = 0.93
CELL, BLOCK = 2048, 1024
SLACK = 0.15
SAMPLE, PER_CELL, MOST_CELLS, ROUNDS = 20_000, 10, 8192, 8


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres of unit vectors; starts from rows at even steps, an empty cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        best = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, best, x)
        norm = np.sqrt((total**2).sum(1))
        moved = norm > 0
        centres[moved] = total[moved] / norm[moved, None]
    return centres


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Rows of a list array without nulls, all of one length, as unit vectors in double precision."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


def fit_cells(distinct: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Centres by (label, size), for labels that need more than one cell; MOST_CELLS in all, fitted on PER_CELL vectors each, SAMPLE at least."""
    sizes = distinct.groupBy("label", "size").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    large = sizes.orderBy(F.desc("n"), "label", "size").limit(MOST_CELLS // 2).collect()  # a bounded number
    if not large:
        return {}
    total = sum(r["n"] for r in large)
    scale = min(1.0, MOST_CELLS / sum(-(-r["n"] // CELL) for r in large))
    cells = {(r["label"], r["size"]): max(2, int(scale * -(-r["n"] // CELL))) for r in large}
    most = max(SAMPLE, PER_CELL * sum(cells.values()))
    wanted = sizes.orderBy(F.desc("n"), "label", "size").limit(MOST_CELLS // 2).select("label", "size")
    rows = distinct.join(F.broadcast(wanted), ["label", "size"]) if total > most else distinct
    hash_ = F.xxhash64("vec_id", F.lit(5))
    if total > 2 * most:  # tasks send little more than is wanted
        rows = rows.where(F.shiftrightunsigned(hash_, 1) <= int((most + 8 * most**0.5) / total * (1 << 63)))
    sample = rows.select("vec_id", "label", "size", "vector").orderBy(hash_, "vec_id").limit(most).collect()  # a bounded number
    centres = {}
    for key, k in cells.items():
        x = np.array([r["vector"] for r in sample if (r["label"], r["size"]) == key], np.float64)
        if len(x) > k:
            x /= np.sqrt((x * x).sum(1))[:, None]
            centres[key] = spherical_kmeans(x, k)
    return centres


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label).

    Two vectors of equal, non-null label link when their cosine is at least
    ``cosine``. ``n_links`` counts the other vectors linked directly, copies
    included; ``component_id`` is the smallest vec_id reachable, itself included;
    ``kept`` says that it is the row's own. A vector that is null, empty, zero or
    holds null or non-finite components, or whose label is null, links with
    nothing, nor do vectors of different lengths. Rows repeated in id, label and
    vector count as one vector; a row without vec_id has no component and is kept.
    """
    with Scratch(vectors.sparkSession, "vectors") as scratch:
        return materialize(_classes(vectors, cosine, scratch), "classes")


def _classes(vectors: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    one, two = F.xxhash64("label", "vector").alias("one"), F.xxhash64(F.lit(11), "vector", "label").alias("two")
    keys = rows.select("vec_id", F.when(F.col("ok"), one).alias("one"), F.when(F.col("ok"), two).alias("two"))
    single = rows.where("ok").groupBy("vec_id", one, two).agg(F.first("label").alias("label"), F.first("vector").alias("vector"))
    distinct = single.groupBy("one", "two").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    distinct = materialize(distinct.withColumn("size", F.size("vector")), "vectors", scratch)
    shared = spark.sparkContext.broadcast(fit_cells(distinct))  # MOST_CELLS centres at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            label, size, ids, copies = (np.asarray(batch.column(i)) for i in range(4))
            vectors = batch.column(4)
            out = []
            for key in sorted(set(zip(label.tolist(), size.tolist()))):
                index = np.flatnonzero((label == key[0]) & (size == key[1]))
                x = unit_rows(vectors.take(pa.array(index)))
                if key in centres:
                    near = x @ centres[key].T
                    row, cell = np.nonzero(near >= near.max(1, keepdims=True) - SLACK)
                else:
                    row, cell = np.arange(len(x)), np.zeros(len(x), np.int64)
                cuts = np.searchsorted(row, np.arange(len(x) + 1))
                lists = [cell[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
                data = [v.tobytes() for v in x]
                out += [(key[0], key[1], int(c), int(ids[index[r]]), int(copies[index[r]]), lists[r], data[r]) for r, c in zip(row.tolist(), cell.tolist())]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            names = ("label", "size", "cell", "vec_id", "copies", "cells", "unit")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], list(names))

    placed = distinct.select(F.col("label").cast("long").alias("label"), "size", "vec_id", "copies", "vector")
    placed = placed.mapInArrow(assign, "label long, size int, cell int, vec_id long, copies long, cells binary, unit binary")
    placed = materialize(placed, "placed", scratch)
    parts = placed.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = placed.join(parts, ["label", "size", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "parts"))
    blocks = blocks.groupBy("label", "size", "cell", "block").agg(F.collect_list(F.struct("vec_id", "copies", "cells", "unit")).alias("m"))
    blocks = blocks.select("*", F.lit(0).alias("class"), F.lit(1).alias("low"), F.lit(1).alias("high"))
    pairs = units(materialize(blocks, "blocks", scratch), ["label", "size", "cell"], ["cell", "m"])

    def compare(table: pa.Table) -> pa.Table:
        cell, read = table["cell"][0].as_py(), [_read(x.as_py()) for x in table["m"]]
        return pa.concat_tables([_compare(cell, i == j, read[i], read[j], cosine) for i, j in block_pairs(table["side"].to_pylist())])

    found = materialize(pairs.groupBy("unit").applyInArrow(compare, "a long, b long, n long"), "links", scratch)
    names = connected_components(found.where("b is not null"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    stats = distinct.select("one", "two", "vec_id", "copies").join(counts.withColumnRenamed("a", "vec_id"), "vec_id", "left").join(names.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    stats = stats.select("one", "two", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    out = keys.join(stats, ["one", "two"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _read(rows: list[dict]) -> tuple:
    ids, copies = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "copies"))
    return ids, copies, np.stack([np.frombuffer(r["unit"]) for r in rows]), [np.frombuffer(r["cells"], np.int32) for r in rows]


def _compare(cell: int, same: bool, one: tuple, two: tuple, cosine: float) -> pa.Table:
    """Links between two blocks of a cell: (vec_id, null, sum of copies linked) and, as a spanning forest, (vec_id, vec_id, null)."""
    ida, ca, a, la = one
    idb, cb, b, lb = two
    x, y = np.nonzero(a @ b.T >= cosine)
    if same:
        keep = x < y
        x, y = x[keep], y[keep]
    before = max(max((int((c < cell).sum()) for c in la), default=0), max((int((c < cell).sum()) for c in lb), default=0))
    if before and len(x):  # pairs that also share an earlier cell count there

        def earlier(lists: list[np.ndarray], fill: int) -> np.ndarray:
            out = np.full((len(lists), before), fill, np.int32)
            for i, c in enumerate(lists):
                c = c[c < cell]
                out[i, : len(c)] = c
            return out

        ea, eb = earlier(la, -1), earlier(lb, -2)
        seen = np.zeros(len(x), bool)
        for i in range(before):
            for j in range(before):
                seen |= ea[x, i] == eb[y, j]
        x, y = x[~seen], y[~seen]
    ids, index = np.unique(np.concatenate([ida, idb]), return_inverse=True)
    xa, yb = index[x], index[len(ida) + y]
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, xa, cb[y])
    np.add.at(n, yb, ca[x])
    root = forest(len(ids), xa, yb)
    far, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(n)
    none = pa.nulls
    return pa.Table.from_arrays(
        [
            pa.array(np.r_[ids[some], ids[root[far]]], pa.int64()),
            pa.concat_arrays([none(len(some), pa.int64()), pa.array(ids[far], pa.int64())]),
            pa.concat_arrays([pa.array(n[some], pa.int64()), none(len(far), pa.int64())]),
        ],
        ["a", "b", "n"],
    )
