"""Scratch tables, the shared folder, and units of tiles."""

from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from geolattice.operators.tiles import block_pairs, units
from geolattice.sources import storage


def test_scratch_tables_go_on_failure_too(spark):
    with pytest.raises(RuntimeError), storage.Scratch(spark, "test") as scratch:
        kept = scratch.cut(spark.range(5))
        folder = Path(scratch.folder.removeprefix("file://"))
        assert kept.count() == 5 and folder.exists()
        raise RuntimeError
    assert not folder.exists()
    out = storage.cut(spark.range(3), "result")
    assert out.count() == 3 and "result-" in out.inputFiles()[0]


@pytest.mark.parametrize("master, refused", [("yarn", True), ("spark://a:7077", True), ("local-cluster[2,1,1024]", True), ("local[4]", False), ("local", False)])
def test_a_cluster_needs_a_shared_folder(master, refused):
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None, master=master)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    if refused:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_folder(session)
    else:
        assert storage.shared_folder(session).startswith("file://")


@pytest.mark.parametrize("within", [True, False])
def test_every_pair_of_blocks_meets_once(spark, within):
    """Two areas, three classes of one to eleven blocks; sizes let neighbouring classes meet."""
    rows = [(area, c, b, 10 * 2**c, 15 * 2**c, f"{area}{c}-{b}") for area in "xy" for c in range(3) for b in range(1 + 5 * c + (area == "y"))]
    blocks = spark.createDataFrame(rows, "area string, class long, block long, low long, high long, name string")
    met = []
    for _, unit in units(blocks, ["area"], ["name"], 50, within).toPandas().groupby("unit"):
        names, sides = unit["name"].tolist(), unit["side"].tolist()
        met += [tuple(sorted((names[a], names[b]))) for a, b in block_pairs(sides)]
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and (a[1] == b[1] and within or abs(a[1] - b[1]) == 1):
                want.add(tuple(sorted((a[5], b[5]))))
    assert set(met) == want and len(met) == len(want)


def test_block_pairs():
    assert block_pairs([0, 1, 0]) == [(0, 1), (2, 1)] and block_pairs([0, 0]) == [(0, 0), (0, 1), (1, 1)]
    assert np.array(block_pairs([0] * 5)).shape == (15, 2)
