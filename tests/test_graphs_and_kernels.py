"""Checks, neighbour joins, kernels, Laplacians and graphs against dense numpy."""

import numpy as np
import pytest

from geolattice.operators import checks, graph, laplacian, neighbors, sparse
from geolattice.operators.checks import InvalidInput
from geolattice.plans.geometry import Geometry
from geolattice.sources import generators, storage


def cloud(spark, x):
    return spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(x)], "id long, v array<double>")


def dense(df, value, n, fill=0.0):
    out = np.full((n, n), fill)
    for r in df.collect():
        out[r["i"], r["j"]] = r[value]
    return out


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def x():
    return np.random.RandomState(36).rand(100, 3)


@pytest.mark.parametrize("method", ["auto", "brute", "blocks", "grid"])
@pytest.mark.parametrize("radius", [0.1, 0.5, 1.0])
def test_radius_methods_equal_brute_force(spark, x, method, radius):
    d = distances(x)
    got = dense(neighbors.adjacency(cloud(spark, x), method, radius=radius), "d", 100, np.inf)
    assert np.allclose(got, np.where(d <= radius, d, np.inf)) and (np.diag(got) == 0).all()


@pytest.mark.parametrize("k", [1, 5, 15, 200])
@pytest.mark.parametrize("cell", [1024, 10])
def test_nearest_equal_brute_force(spark, x, k, cell, monkeypatch):
    monkeypatch.setattr(neighbors, "CELL", cell)
    monkeypatch.setattr(neighbors, "LEAST_TILE", 7)
    d = distances(x)
    got = {}
    for r in neighbors.adjacency(cloud(spark, x), n_neighbors=k).collect():
        got.setdefault(r["i"], []).append((r["d"], r["j"]))
    for i in range(100):
        want = sorted((d[i, j], j) for j in range(100))[:k]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_radius_by_many_cells(spark, x, monkeypatch):
    monkeypatch.setattr(neighbors, "CELL", 8)
    monkeypatch.setattr(neighbors, "LEAST_TILE", 5)
    d = distances(x)
    got = neighbors.adjacency(cloud(spark, x), radius=0.3)
    assert got.count() == (d <= 0.3).sum()
    assert np.allclose(dense(got, "d", 100, np.inf), np.where(d <= 0.3, d, np.inf))


def test_ties_and_copies(spark):
    x = np.array([[0, 0], [0, 0], [1, 0], [0, 1], [-1, 0]])
    got = sorted((r["i"], r["j"]) for r in neighbors.adjacency(cloud(spark, x), n_neighbors=3).collect())
    assert got[:6] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert neighbors.adjacency(cloud(spark, x), radius=0).count() == 7


def test_rules_and_names(spark, x):
    p = cloud(spark, x)
    for kwds in ({}, {"radius": 1, "n_neighbors": 2}, {"radius": -1}, {"n_neighbors": 0}):
        with pytest.raises(InvalidInput):
            neighbors.adjacency(p, **kwds)
    with pytest.raises(ValueError, match="blocks"):
        neighbors.adjacency(p, "nothing", radius=1)
    with pytest.raises(InvalidInput):
        neighbors.adjacency(cloud(spark, np.ones((2, 4))), "grid", radius=1)
    assert neighbors.adjacency(p.limit(0), radius=1).count() == 0


def test_own_methods(spark, x):
    @neighbors.adjacencies.register("mine")
    def mine(points, **kwds):
        return neighbors.block_neighbors(points, **kwds).where("i <> j")

    assert neighbors.adjacency(cloud(spark, x), "mine", radius=0.2).where("i = j").count() == 0
    neighbors.adjacencies.unregister("mine")
    assert "mine" not in neighbors.adjacencies.names()


@pytest.mark.parametrize("cell", [1024, 10])
def test_other_tables_equal_brute_force(spark, x, cell, monkeypatch):
    monkeypatch.setattr(neighbors, "CELL", cell)
    monkeypatch.setattr(neighbors, "LEAST_TILE", 7)
    a, b = x[:70], np.concatenate([x[60:], x[:3] + 2])
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    got = neighbors.block_neighbors(cloud(spark, a), radius=0.4, others=cloud(spark, b)).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted(map(tuple, np.argwhere(d <= 0.4).tolist()))
    got = neighbors.block_neighbors(cloud(spark, a), n_neighbors=4, others=cloud(spark, b)).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted((i, j) for i in range(70) for j in sorted(range(43), key=lambda j: (d[i, j], j))[:4])
    assert neighbors.block_neighbors(cloud(spark, a), radius=1.0, others=cloud(spark, b[:0])).count() == 0


def test_grid_splits_dense_cubes(spark, x, monkeypatch):
    monkeypatch.setattr(neighbors, "DENSE_CUBE", 3)
    for dims in (1, 2, 3):
        d = distances(x[:, :dims])
        got = sorted((r["i"], r["j"]) for r in neighbors.adjacency(cloud(spark, x[:, :dims]), "grid", radius=0.3).collect())
        assert got == sorted(map(tuple, np.argwhere(d <= 0.3).tolist()))


def test_cell_index_is_saved_and_finds_most(spark, x, tmp_path):
    p = cloud(spark, x)
    index = neighbors.CellIndex.build(p, 8)
    index.save(f"file://{tmp_path}/index")
    loaded = neighbors.CellIndex.load(spark, f"file://{tmp_path}/index")
    read = lambda df: sorted((r["i"], r["j"], r["d"]) for r in df.collect())
    d = distances(x)
    for found in ({"radius": 0.3}, {"n_neighbors": 5}):
        exact = read(neighbors.adjacency(p, "blocks", **found))
        assert read(loaded.search(probes=8, **found)) == exact  # all cells: exact
        some = read(loaded.search(probes=3, **found))
        assert some == read(index.search(probes=3, **found)) and len(set(some) & set(exact)) > 0.8 * len(exact)
        assert all(abs(d[i, j] - v) < 1e-12 for i, j, v in some)
    asked = cloud(spark, x[:2] + 0.01)
    assert {r["i"] for r in loaded.search(n_neighbors=3, queries=asked).collect()} == {0, 1}
    assert neighbors.adjacency(p, "cells", n_neighbors=4, cells=4, probes=4).count() == 400
    near = neighbors.recall(neighbors.adjacency(p, "lsh", n_neighbors=5, tables=8), neighbors.adjacency(p, n_neighbors=5)).first()
    assert near["recall"] > 0.8


def test_auto_takes_the_grid_for_many_points_of_few_dimensions(spark, x, monkeypatch):
    monkeypatch.setattr(neighbors, "GRID_FROM", 50)
    called = []
    monkeypatch.setitem(neighbors.adjacencies._methods, "grid", lambda p, **k: called.append(k) or p)
    neighbors.adjacency(cloud(spark, x), radius=0.1)
    neighbors.adjacency(cloud(spark, x[:40]), radius=0.1)
    neighbors.adjacency(cloud(spark, np.ones((60, 4))), radius=0.1)
    assert called == [{"radius": 0.1}]


def test_lsh_finds_most(spark, x):
    p = cloud(spark, x)
    r = neighbors.recall(neighbors.adjacency(p, "lsh", radius=0.3, tables=8), neighbors.adjacency(p, radius=0.3)).first()
    assert r["recall"] > 0.8


def test_train_and_test_blocks(spark):
    x = np.random.RandomState(36).randn(14, 2)
    train, test = cloud(spark, x[:10]), cloud(spark, x[10:])
    got = dense(neighbors.complete_adjacency(train, test, 1.5, 10), "d", 14, np.inf)
    d = distances(x)
    assert np.allclose(got, np.where(d <= 1.5, d, np.inf))


# --- checks -----------------------------------------------------------------------------------------------------------
def test_point_checks(spark):
    good = cloud(spark, np.ones((3, 2)))
    assert checks.check_points(good) == (3, 2)
    for rows in ([(1, [1.0]), (1, [2.0])], [(1, [1.0, 2.0]), (2, [1.0])], [(1, [float("nan")])], [(1, [float("inf")])], [(1, None)], [(None, [1.0])], [(1, [None])]):
        with pytest.raises(InvalidInput):
            checks.check_points(spark.createDataFrame(rows, "id long, v array<double>"))
    with pytest.raises(InvalidInput):
        checks.check_points(good, min_samples=4)
    with pytest.raises(InvalidInput):
        checks.check_points(good, min_features=3)
    assert checks.check_seed(None) == 0
    with pytest.raises(InvalidInput):
        checks.check_seed("x")


def test_symmetry(spark):
    m = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (0, 2, 4.0)], "i long, j long, d double")
    assert not checks.is_symmetric(m, "d") and checks.is_symmetric(m.where("j < 2"), "d") and checks.is_symmetric(m.limit(0), "d")
    got = {(r["i"], r["j"]): r["d"] for r in checks.check_symmetric(m, "d").collect()}
    assert got == {(0, 1): 2.0, (1, 0): 2.0, (0, 2): 2.0, (2, 0): 2.0}
    with pytest.raises(InvalidInput):
        checks.check_symmetric(m, "d", raise_error=True)
    with pytest.raises(InvalidInput):
        checks.check_square(m, 2)


# --- kernel and Laplacians -----------------------------------------------------------------------------------------------
def reference_laplacian(a, name, exponent=1.0, scale=None):
    d = a.sum(1)
    div = np.where(d == 0, 1, d)
    eye = np.diag((d != 0).astype(float))
    if name == "unnormalized":
        lap = s = a - np.diag(d)
        w = d
    elif name == "randomwalk":
        lap, s, w = a / div[:, None] - eye, a, d
    elif name == "symmetricnormalized":
        lap = s = a / np.sqrt(np.outer(div, div)) - eye
        w = np.sqrt(d)
    else:
        e = 1.0 if name == "geometric" else exponent
        k = a / np.outer(div, div) ** e
        w = k.sum(1)
        lap, s = k / np.where(w == 0, 1, w)[:, None] - np.diag((w != 0).astype(float)), k
    if scale:
        s = s * 4 / scale**2 if s is lap else s
        lap = lap * 4 / scale**2
    return lap, s, w


@pytest.mark.parametrize("name", ["geometric", "randomwalk", "renormalized", "symmetricnormalized", "unnormalized"])
@pytest.mark.parametrize("scale", [None, 0.3])
def test_laplacians(spark, name, scale):
    x = np.random.RandomState(42).rand(20, 2)
    d = distances(x)
    a = np.where(d <= 0.5, np.exp(-((d / 0.3) ** 2)), 0)
    aff = laplacian.affinity(neighbors.adjacency(cloud(spark, x), radius=0.5), radius=0.3)
    assert np.allclose(dense(aff, "w", 20), a)
    lap, w = laplacian.laplacian(aff, name, scale=scale, exponent=1.5)
    want = reference_laplacian(a, name, 1.5, scale)
    assert np.allclose(dense(lap, "l", 20), want[0]) and np.allclose(dense(lap, "s", 20), want[1])
    weights = {r["i"]: r["w"] for r in w.collect()}
    assert np.allclose([weights[i] for i in range(20)], want[2])
    if name not in laplacian.SYMMETRIC and scale is None:  # w (L + I) = S
        assert np.allclose(want[2][:, None] * (dense(lap, "l", 20) + np.eye(20)), dense(lap, "s", 20))


def test_zero_degree_and_missing_diagonal(spark):
    a = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 2, 0.0)], "i long, j long, w double")
    lap, _ = laplacian.laplacian(a, "randomwalk")
    assert dense(lap, "l", 3).tolist() == [[-1, 1, 0], [1, -1, 0], [0, 0, 0]]


def test_one_way_edges_weigh_half(spark):
    e = spark.createDataFrame([(0, 0, 0.0), (1, 1, 0.0), (0, 1, 1.0)], "i long, j long, d double")
    assert np.allclose(dense(laplacian.affinity(e, radius=1.0), "w", 2), [[1, np.exp(-1) / 2], [np.exp(-1) / 2, 1]])
    with pytest.raises(InvalidInput):
        laplacian.affinity(e)
    with pytest.raises(ValueError):
        laplacian.laplacian(laplacian.affinity(e, radius=1.0), "nothing")


def test_sparse_algebra(spark):
    a = np.random.RandomState(1).rand(6, 6) * (np.random.RandomState(2).rand(6, 6) > 0.5)
    m = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, x double")
    y = spark.createDataFrame([(k, float(k)) for k in range(6)], "id long, y double")
    got = {r["id"]: r["z"] for r in sparse.mat_vec(m, "x", y, "y", "z").collect()}
    assert all(np.isclose(got.get(k, 0), v) for k, v in enumerate(a @ np.arange(6)))
    assert np.allclose(dense(sparse.gram(m, "x"), "m", 6), a.T @ a)
    full = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6)], "i long, j long, x double")
    assert np.allclose(dense(sparse.center(full, "x"), "k", 6), a - a.mean(0) - a.mean(1)[:, None] + a.mean())


# --- graphs -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("finish", [100_000, 0])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH", finish)
    e = spark.createDataFrame([(3, 4, 1.0), (4, 9, 1.0), (1, 2, 1.0), (5, 5, 0.0)], "i long, j long, d double")
    ids = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 9, 11)], "id long")
    got = {r["id"]: r["component"] for r in graph.connected_components(e, ids).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 9: 3, 5: 5, 11: 11}
    assert {r["id"] for r in graph.component_of(e, 9, ids).collect()} == {3, 4, 9}
    assert not graph.is_connected(e, ids) and graph.is_connected(e.where("i > 2 and i < 5"))
    chain = spark.range(200).selectExpr("id as i", "id + 1 as j", "1.0d as d")
    assert graph.component_count(chain) == 1


def test_paths_on_a_grid(spark):
    p = generators.grid(spark, 5)
    e = neighbors.adjacency(p, radius=1.0)
    d = graph.shortest_paths(e, p)
    at = {r["id"]: r["v"] for r in p.collect()}
    assert d.count() == 625
    assert all(np.isclose(r["d"], abs(at[r["src"]][0] - at[r["dst"]][0]) + abs(at[r["src"]][1] - at[r["dst"]][1])) for r in d.collect())
    with pytest.raises(ValueError):
        graph.shortest_paths(e, p, most=10)


# --- geometry and storage -------------------------------------------------------------------------------------------------------
def test_geometry_cache(spark, x):
    g = Geometry(adjacency_radius=0.5, affinity_kwds={"radius": 0.3}, laplacian_method="unnormalized")
    with pytest.raises(InvalidInput):
        g.compute_adjacency_matrix()
    g.set_matrix(cloud(spark, x), "data")
    lap = g.compute_laplacian_matrix()
    assert g.adjacency is not None and g.affinity is not None and lap is g.laplacian
    g.compute_adjacency_matrix(radius=0.2)
    assert g.affinity is None and g.laplacian is None and g.adjacency_kwds == {"radius": 0.5}
    with pytest.raises(InvalidInput):
        g.set_matrix(cloud(spark, x), "distance")
    with pytest.raises(InvalidInput):
        Geometry(nothing=1)
    g.delete_adjacency_matrix()
    assert g.adjacency is None and g.ids().count() == 100


def test_parts_round_trip(spark, x, tmp_path):
    e = neighbors.adjacency(cloud(spark, x), radius=0.2)
    for k in (2, 5):
        storage.save_sparse(e, f"{tmp_path}/s{k}", k)
        assert sorted(map(tuple, storage.load_sparse(spark, f"{tmp_path}/s{k}").collect())) == sorted(map(tuple, e.collect()))
    storage.save_dense(cloud(spark, x), f"{tmp_path}/d", 3)
    assert len([p for p in (tmp_path / "d").iterdir() if p.name.startswith("part")]) == 3
    assert storage.load_dense(spark, f"{tmp_path}/d").count() == 100
    storage.save_report(spark, {"a": 1, "b": "x"}, f"{tmp_path}/r")
    assert storage.load_report(spark, f"{tmp_path}/r") == {"a": 1, "b": "x"}
