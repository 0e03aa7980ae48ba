"""Eigenproblems, embeddings, metric, radius, clustering and relaxation."""

import warnings

import numpy as np
import pytest
from test_graphs_and_kernels import cloud, dense, distances

from geolattice.functions import ellipses, small_matrices
from geolattice.operators import eigen, graph, isomap, kmeans, laplacian, local, neighbors, radius, relaxation, rmetric, spectral
from geolattice.operators.checks import InvalidInput
from geolattice.operators.nystrom import nystrom_extension
from geolattice.plans.geometry import Geometry
from geolattice.sources import generators


def rows(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()], float)


def long_form(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, x double"), spark.range(len(a))


# --- eigenproblems -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("solver", ["dense", "lobpcg", "arpack", "amg", "auto"])
@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("local_entries", [2_000_000, 0])
def test_solvers_agree(spark, solver, largest, local_entries, monkeypatch):
    monkeypatch.setattr(eigen, "LOCAL_ENTRIES", local_entries)
    x = np.random.RandomState(0).uniform(size=(100, 40))
    g = x.T @ x
    g += np.diag(np.arange(40.0) * 3)  # separate eigenvalues
    m, ids = long_form(spark, g)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # multigrid says that it falls back on the diagonal
        found = eigen.solve(m, "x", ids, 3, solver, largest, rounds=200)
    want = np.linalg.eigvalsh(g)
    assert np.allclose(found.values, want[::-1][:3] if largest else want[:3], atol=1e-5)
    assert (eigen.residuals(m, "x", found) < 1e-3).all()
    assert np.allclose(found.matrix.T @ found.matrix, np.eye(3), atol=1e-6)
    if solver == "dense":
        assert np.allclose(rows(found.vectors, "v"), found.matrix)


@pytest.mark.parametrize("solver", ["dense", "arpack"])
@pytest.mark.parametrize("largest", [True, False])
def test_matrices_that_are_not_symmetric(spark, solver, largest):
    r = np.random.RandomState(3)
    a = np.diag(np.arange(40.0)) + 0.1 * np.triu(r.randn(40, 40), 1)
    frame = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(40) if a[i, j]], "i long, j long, x double")
    found = eigen.solve(frame, "x", spark.range(40), 3, solver, largest=largest)
    assert np.allclose(found.values, [39, 38, 37] if largest else [0, 1, 2], atol=1e-6)
    assert np.allclose(a @ found.matrix, found.matrix * found.values, atol=1e-5)
    for other in ("lobpcg", "amg"):
        with pytest.raises(ValueError, match="symmetric"):
            eigen.solve(frame, "x", spark.range(40), 3, other)


def test_multigrid_needs_fewer_rounds():
    """A grid's Laplacian: the preconditioned iteration gets there while the plain one is still far off."""
    side = 50
    n = side * side
    at = np.arange(n).reshape(side, side)
    links = np.concatenate([np.stack([at[:, :-1].ravel(), at[:, 1:].ravel()]), np.stack([at[:-1].ravel(), at[1:].ravel()])], 1)
    i, j = np.r_[links[0], links[1], np.arange(n)], np.r_[links[1], links[0], np.arange(n)]
    x = np.r_[-np.ones(2 * links.shape[1]), np.bincount(np.r_[links[0], links[1]], minlength=n) + 1e-6]
    order = np.argsort(i, kind="stable")
    matrix = (i[order], j[order], x[order])
    grid = eigen.Multigrid(matrix, n)
    assert len(grid.levels) >= 1
    start = np.random.RandomState(1).standard_normal((n, 8))
    apply = lambda v: -eigen._times(matrix, v)
    exact = np.sort([2 - 2 * np.cos(np.pi * a / side) + 2 - 2 * np.cos(np.pi * b / side) for a in range(4) for b in range(4)])[:3]
    plain, _ = eigen.lobpcg(apply, start, 3, 1e-9, 12)
    fast, _ = eigen.lobpcg(apply, start, 3, 1e-9, 12, grid)
    assert np.abs(-fast - exact).max() < 0.05 * np.abs(-plain - exact).max()


def test_too_large_problems_are_refused_before_they_are_fetched(spark, monkeypatch):
    monkeypatch.setattr(eigen, "DENSE_MOST", 5)
    frame = spark.createDataFrame([(i, i, 1.0) for i in range(8)], "i long, j long, x double")
    with pytest.raises(ValueError, match="too large"):
        eigen.solve(frame, "x", spark.range(8), 2, "dense")


def test_solver_names(spark):
    m, ids = long_form(spark, np.eye(4))
    with pytest.raises(ValueError):
        eigen.solve(m, "x", ids, 2, "nothing")
    assert eigen.choose_solver("lobpcg", 10, 3) == "dense" and eigen.choose_solver("auto", 10**6, 3) == "lobpcg"


def test_null_space_of_a_path(spark):
    n = 20
    a = np.diag(np.ones(n - 1), 1)
    lap = np.diag((a + a.T).sum(1)) - a - a.T
    m, ids = long_form(spark, lap)
    found, error = eigen.null_space(m, "x", ids, 2)
    want = 2 - 2 * np.cos(np.pi * np.arange(1, 3) / n)
    assert np.allclose(found.values, want) and np.isclose(error, want.sum())


# --- embeddings ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("method", ["geometric", "symmetricnormalized", "unnormalized", "randomwalk"])
def test_spectral_embedding(spark, method):
    x = np.random.RandomState(42).rand(100, 5)
    geom = {"adjacency_radius": 1.0, "affinity_radius": 1.0, "laplacian_method": method}
    model = spectral.SpectralEmbedding(2, geom=geom).fit(cloud(spark, x))
    lap = dense(model.geom_.laplacian, "l", 100)
    values = np.sort(np.linalg.eigvals(lap).real)[::-1][:3]
    assert np.allclose(model.eigenvalues_[1:], values[1:], atol=1e-8) and model.eigenvalues_[0] == 0
    v = rows(model.eigenvectors_, "v")
    assert np.abs(lap @ v - v * values).max() < 1e-8 and np.allclose((v**2).sum(0), 1)
    assert rows(model.embedding_, "y").shape == (100, 2)


def test_two_blocks_separate(spark):
    r = np.random.RandomState(0)
    a = np.zeros((40, 40))
    for s in (slice(0, 20), slice(20, 40)):
        b = r.rand(20, 20) + 0.5
        a[s, s] = b + b.T
    a[0, 20] = a[20, 0] = 0.01
    np.fill_diagonal(a, 1)
    m = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, w double")
    for kwds in ({}, {"diffusion_maps": True, "diffusion_time": 1}, {"diffusion_maps": True}):
        y = rows(spectral.SpectralEmbedding(1, **kwds).fit(m, "affinity").embedding_, "y")[:, 0]
        assert len(set(np.sign(y[:20]))) == len(set(np.sign(y[20:]))) == 1 and np.sign(y[0]) != np.sign(y[20])
    with pytest.warns(UserWarning, match="connected"):
        spectral.SpectralEmbedding(1).fit(m.where("(i < 20) = (j < 20)"), "affinity")


def test_diffusion_times(spark):
    v, lam = eigen.vector_frame(spark, np.arange(3), 2 * np.ones((3, 2))), np.array([0.0, -0.5])
    assert np.allclose(rows(spectral.diffusion_coordinates(v, lam, 0), "v")[:, 1], 1.0)
    assert np.allclose(rows(spectral.diffusion_coordinates(v, lam, 2), "v")[:, 1], 0.25)
    with pytest.warns(UserWarning):
        spectral.diffusion_coordinates(v, lam, 1, "randomwalk")


@pytest.mark.parametrize("largest", [True, False])
def test_pairs_over_tables_equal_those_on_the_driver(spark, largest, monkeypatch):
    r = np.random.RandomState(9)
    x = r.rand(60, 2)
    a = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) * 20)
    a[a < 0.05] = 0
    m, ids = long_form(spark, a)
    near = eigen.solve(m, "x", ids, 3, "dense", largest=largest)
    far = eigen.solve(m, "x", ids, 3, "distributed", largest=largest, rounds=60)
    assert far.matrix is None and np.allclose(far.values, near.values, atol=1e-5)
    assert np.allclose(np.abs(rows(far.vectors, "v")), np.abs(near.matrix), atol=1e-2 if not largest else 1e-3)
    monkeypatch.setattr(eigen, "DENSE_LIMIT", 10)
    monkeypatch.setattr(eigen, "BLOCK_LIMIT", 10)
    assert eigen.choose_solver("auto", 60, 3) == "distributed"
    with pytest.raises(ValueError, match="symmetric"):
        eigen.solve(m.where("i <= j"), "x", ids, 3, "distributed")


def test_an_embedding_over_tables(spark):
    """The same embedding, up to signs, when no array of the driver is used."""
    p = generators.blobs(spark, 60, 3, 1, seed=5).select("id", "v")
    geom = {"adjacency_radius": 4.0, "affinity_radius": 2.0}
    one, two = (rows(spectral.SpectralEmbedding(2, geom=geom, eigen_solver=s).fit(p).embedding_, "y") for s in ("dense", "distributed"))
    assert np.allclose(np.abs(one), np.abs(two), atol=1e-3)


def test_predict(spark):
    p = generators.blobs(spark, 120, 5, 1, seed=42)
    train, test = p.where("id < 100").select("id", "v"), p.where("id >= 100").selectExpr("id - 100 as id", "v")
    model = spectral.SpectralEmbedding(2, radius=5.0)
    with pytest.raises(InvalidInput):
        model.predict(test)
    model.fit(train)
    new, every = model.predict(test)
    assert new.count() == 20 and every.count() == 120
    by_affinity = spectral.SpectralEmbedding(2).fit(model.geom_.affinity, "affinity")
    with pytest.raises(InvalidInput):
        by_affinity.predict(test)
    nearest = spectral.SpectralEmbedding(2, geom={"adjacency_n_neighbors": 20, "affinity_radius": 5.0}).fit(train)
    with pytest.raises(InvalidInput):
        nearest.predict(test)


def test_nystrom_rebuilds_low_rank(spark):
    r = np.random.RandomState(123)
    x = r.randn(10, 2)
    g = x @ x.T
    l = 5
    values, vectors = np.linalg.eigh(g[:l, :l])
    values, vectors = values[::-1][:2], vectors[:, ::-1][:, :2]
    m, _ = long_form(spark, g)
    lam, v = nystrom_extension(m, "x", eigen.vector_frame(spark, np.arange(l), vectors), values, l, 10)
    v = rows(v, "v")
    assert np.allclose(v * lam @ v.T, g)


def test_isomap_keeps_a_grid(spark):
    p = generators.grid(spark, 5)
    y = rows(isomap.Isomap(2, radius=10.0).fit_transform(p), "y")
    assert np.allclose(distances(y), distances(rows(p, "v")), atol=1e-6)
    with pytest.raises(InvalidInput):
        isomap.Isomap(2, radius=0.5).fit(p)


def test_landmarks_place_every_point(spark):
    """In a graph of all pairs paths are distances, and both forms give the points back, up to a rigid motion."""
    x = np.random.RandomState(8).rand(40, 2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    for landmarks in (None, 9):
        y = rows(isomap.Isomap(2, radius=2.0, landmarks=landmarks).fit(table).embedding_, "y")
        assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d, atol=1e-6)


@pytest.mark.parametrize("method", ["auto", "D", "BF", "FW", "J"])
def test_path_methods_on_chains_and_parts(spark, method, monkeypatch):
    """A long chain (more rounds than auto waits for), a ring with a shortcut, and an id alone."""
    monkeypatch.setattr(graph, "ROUNDS", 5)
    edges = [(k, k + 1, 1.0) for k in range(30)] + [(100 + k, 100 + (k + 1) % 8, 1.0) for k in range(8)] + [(100, 104, 0.5), (7, 7, 0.0)]
    ids = spark.createDataFrame([(k,) for k in [*range(31), *range(100, 108), 500]], "id long")
    got = {(r["src"], r["dst"]): r["d"] for r in graph.shortest_paths(spark.createDataFrame(edges, "i long, j long, d double"), ids, method=method).collect()}
    assert len(got) == 31 * 31 + 64 + 1 and all(got[a, b] == abs(a - b) for a in range(31) for b in range(31))
    assert got[100, 103] == 1.5 and got[101, 105] == 2.5 and got[500, 500] == 0
    with pytest.raises(InvalidInput):
        graph.shortest_paths(spark.createDataFrame(edges, "i long, j long, d double"), ids, method="X")


def test_barycenter_and_lle(spark):
    x = np.array([[0, 1], [1.01, 1], [2, 0]])
    p = cloud(spark, x)
    w = dense(local.barycenter_weights(p, neighbors.adjacency(p, radius=10)), "w", 3)
    assert np.allclose(w.sum(1), 1) and (np.diag(w) == 0).all()
    grid = np.array([[a, b] for a in range(5) for b in range(5)]) + 1e-10 * np.random.RandomState(0).rand(25, 2)
    model = local.LocallyLinearEmbedding(2, radius=3.0).fit(cloud(spark, grid))
    p = cloud(spark, grid)
    w = dense(local.barycenter_weights(p, neighbors.adjacency(p, radius=3.0)), "w", 25)
    assert np.linalg.norm(w @ grid - grid) < 0.1
    y = rows(model.embedding_, "y")
    assert np.linalg.norm(w @ y - y) ** 2 == pytest.approx(model.error_, abs=1e-6)
    with pytest.raises(InvalidInput):
        local.LocallyLinearEmbedding(2).fit(neighbors.adjacency(p, radius=3.0), "adjacency")


def test_ltsa_flattens_a_plane(spark):
    r = np.random.RandomState(3)
    flat = r.rand(60, 2)
    x = flat @ np.linalg.qr(r.randn(3, 2))[0].T
    p = cloud(spark, x)
    m = dense(local.alignment_matrix(p, neighbors.adjacency(p, radius=0.5), 2), "m", 60)
    assert np.allclose(m, m.T) and np.allclose(m.sum(1), 0, atol=1e-10)
    y = rows(local.LTSA(2, radius=0.5).fit(p).embedding_, "y")
    a = np.column_stack([flat, np.ones(60)])
    assert np.linalg.norm(a @ np.linalg.lstsq(a, y, rcond=None)[0] - y) < 1e-6
    with pytest.raises(InvalidInput):
        local.LTSA(4, radius=0.5).fit(p)


# --- metric ----------------------------------------------------------------------------------------------------------------
def test_metric(spark):
    x = np.random.RandomState(5).rand(80, 2)
    aff = laplacian.affinity(neighbors.adjacency(cloud(spark, x), radius=0.4), radius=0.3)
    lap, _ = laplacian.laplacian(aff, "geometric", scale=0.3)
    y = spark.createDataFrame([(k, [float(a), float(b), float(a + b)]) for k, (a, b) in enumerate(x)], "id long, y array<double>")
    L, Y = dense(lap, "l", 80), rows(y, "y")
    want = np.einsum("ij,ija,ijb->iab", L, Y[None] - Y[:, None], Y[None] - Y[:, None]) / 2
    model = rmetric.RiemannMetric(y, lap, n_dim=2)
    got = model.get_rmetric().orderBy("id").collect()
    assert np.allclose([r["h"] for r in got], want)
    assert np.allclose([r["g"] for r in got], np.linalg.pinv(want, rcond=1e-8, hermitian=True), rtol=1e-6)
    assert model.get_detG().count() == 80
    lazy = rmetric.dual_metric(lap, y, 3, spark.createDataFrame([(3,), (7,)], "id long")).orderBy("id").collect()
    assert [r["id"] for r in lazy] == [3, 7] and np.isclose(lazy[1]["h_12"], want[7, 0, 1])
    flat = rmetric.RiemannMetric(y.selectExpr("id", "slice(y, 1, 2) as y"), lap, mode_inv="inv")
    assert np.allclose([r["g"] for r in flat.get_rmetric().orderBy("id").collect()], np.linalg.inv(want[:, :2, :2]))
    with pytest.raises(InvalidInput):
        rmetric.RiemannMetric(y, lap, n_dim=4)


def test_small_matrices():
    h = np.array([[[2.0, 1], [1, 3]], [[1.0, 0], [0, 0]]])
    g, s = small_matrices.pseudo_inverse(h)
    assert np.allclose(g, np.linalg.pinv(h)) and np.allclose(s, np.linalg.svd(h, compute_uv=False))


# --- radius and dimension -----------------------------------------------------------------------------------------------------
def test_statistics(spark):
    x = np.random.RandomState(1234).randn(100, 3)
    p, d = cloud(spark, x), distances(x)
    e = neighbors.adjacency(p, radius=3.0)
    stats, dim = radius.analyze_radius(e, p, 1.0, 3.0, 5)
    steps = np.geomspace(1, 3, 5)
    want = [((d <= r) & (d > 0)).sum(1) for r in steps]
    for r, n in zip(stats.orderBy("radius").collect(), want):
        assert np.isclose(r["avg_n"], n.mean()) and (r["min_n"], r["max_n"], r["isolated"]) == (n.min(), n.max(), (n == 0).sum())
    assert np.isclose(dim.first()[0], np.polyfit(np.log(steps), np.log([n.mean() for n in want]), 1)[0])
    assert radius.doubling_dimension(stats.limit(0)).first()[0] == 0


def test_distortion_prefers_a_radius_and_finds_dimension(spark):
    p = generators.uniform(spark, 300, 2, seed=1).selectExpr("id", "array(v[0] * 4, v[1] * 4, 0.0d) as v")
    e = neighbors.adjacency(p, radius=1.5).persist()
    best, table = radius.estimate_radius(p, e, p, 2, 0.3, 1.5, 5)
    got = {round(r["radius"], 6): r["distortion"] for r in table.collect()}
    assert len(got) == 5 and got[round(best, 6)] == min(got.values()) < 1
    serial = radius.radius_distortion(p, e, p, 2, [best]).first()
    assert np.isclose(serial["distortion"], got[round(best, 6)])
    lonely = radius.radius_distortion(p, e, p, 2, [1e-9]).first()
    assert lonely["distortion"] == float("inf") and lonely["used"] == 0
    values = radius.local_singular_values(p, e, [1.0])
    dims = {r["dimension"]: r["count"] for r in radius.local_dimension(values).groupBy("dimension").count().collect()}
    assert dims[2] > 290
    assert radius.mean_singular_values(values).count() == 3
    with pytest.raises(InvalidInput):
        radius.radius_steps(1, 2, 3, "cubic")


def test_one_distortion_by_hand(spark):
    x = np.random.RandomState(7).rand(40, 2)
    p, r, h = cloud(spark, x), 0.6, 0.2
    d = distances(x)
    near = d <= r
    w = np.where(near, np.exp(-((d / h) ** 2)), 0)
    lap = reference_geometric(w) * 4 / h**2
    out = []
    for i in range(40):
        p_i = w[i] / w[i].sum()
        y = radius.tangent_projection(x, p_i, 2)
        a = y - y[i]
        out.append(np.linalg.norm(0.5 * (a.T * lap[i]) @ a - np.eye(2), 2))
    got = radius.radius_distortion(p, neighbors.adjacency(p, radius=r), p, 2, [r]).first()
    assert got["used"] == 40 and np.isclose(got["distortion"], np.mean(out))


def reference_geometric(a):
    d = a.sum(1)
    k = a / np.outer(d, d)
    return k / k.sum(1)[:, None] - np.eye(len(a))


# --- clustering ------------------------------------------------------------------------------------------------------------------
def test_kmeans(spark):
    p = generators.blobs(spark, 90, 3, 3, spread=0.3, seed=4)
    model = kmeans.KMeans(3).fit(p.select("id", "v"))
    both = model.labels_.withColumnRenamed("label", "c").join(p.select("id", "label"), "id")
    assert both.select("c", "label").distinct().count() == 3 and model.n_iter_ < 20
    once = kmeans.KMeans(3, max_iter=1).fit(p.select("id", "v"))
    assert once.n_iter_ == 1


def test_orthogonal_centres(spark):
    p = cloud(spark, np.repeat(np.eye(3), 4, axis=0))
    assert sorted(map(tuple, kmeans.orthogonal_centres(p, 3))) == sorted(map(tuple, np.eye(3)))


def test_empty_cluster_restarts(spark):
    p = cloud(spark, np.array([[1.0, 0], [1, 0], [5, 1], [1, 0]]))
    labels = {r["id"]: r["label"] for r in kmeans.KMeans(3, max_iter=3).fit(p).labels_.collect()}
    assert set(labels) == {0, 1, 2, 3} and labels[0] == labels[1] != labels[2]


def test_spectral_clustering(spark):
    p = cloud(spark, np.repeat(np.eye(3), 20, axis=0) * 10 + np.random.RandomState(0).rand(60, 3))
    model = kmeans.SpectralClustering(3, geom={"adjacency_radius": 40.0, "affinity_radius": 4.0})
    assert model.fit(p, "data") is model
    labels = [r["label"] for r in model.labels_.orderBy("id").collect()]
    assert len({*labels[:20]}) == len({*labels[20:40]}) == len({*labels[40:]}) == 1 and len(set(labels)) == 3


# --- relaxation --------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def toy(spark):
    x = np.random.RandomState(8).rand(30, 2)
    aff = laplacian.affinity(neighbors.adjacency(cloud(spark, x), radius=0.6), radius=0.4)
    lap, _ = laplacian.laplacian(aff, "geometric", scale=0.4)
    lap = lap.persist()
    y2 = spark.createDataFrame([(k, [float(a) * 1.5, float(b) * 0.7]) for k, (a, b) in enumerate(x)], "id long, y array<double>")
    y3 = spark.createDataFrame([(k, [float(a) * 1.5, float(b) * 0.7, float(a * b)]) for k, (a, b) in enumerate(x)], "id long, y array<double>")
    return lap, y2, y3


@pytest.mark.parametrize("projected", [False, True])
@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("step", ["fixed", "momentum"])
def test_relaxation_lowers_the_loss(toy, projected, extra, step):
    lap, y2, y3 = toy
    model = relaxation.RiemannianRelaxation(lap, y3 if extra else y2, 2, niter=3, projected=projected, step_method=step, niter_trace=1).relax()
    t = model.trace
    assert len(t.loss) == 4 and len(t.eta) == 3 and len(t.first) == len(t.last) == 1
    assert all(b <= a + 1e-12 for a, b, rose in zip(t.loss, t.loss[1:], t.rose) if not rose) and t.loss[-1] < t.loss[0]
    assert model.embedding.count() == 30 and t.frame(lap.sparkSession).count() == 4


def test_gradient_by_differences(toy):
    lap, y2, _ = toy
    model = relaxation.RiemannianRelaxation(lap, y2, 2, sqrd=False, subset=list(range(10)))
    g = model.compute_gradient()
    for i, c in ((3, 0), (17, 1), (25, 0)):
        up, down = model.y.copy(), model.y.copy()
        up[i, c] += 1e-6
        down[i, c] -= 1e-6
        assert np.isclose((model.loss(up) - model.loss(down)) / 2e-6, g[i, c], atol=1e-5)


def test_projected_steps_are_the_same_in_exact_differences(toy):
    lap, y2, _ = toy
    model = relaxation.RiemannianRelaxation(lap, y2, 2, projected=True)
    centred = model.y - model.y.mean(0)
    assert np.allclose(model._from_differences(model.differences), centred, atol=1e-7)


def test_settings(toy):
    lap, y2, y3 = toy
    s = relaxation.Settings().check(2, 2)
    assert (s.niter, s.lossf, s.eta_max, s.linesearch, s.sqrd, s.alpha) == (2000, "rloss", 16.0, True, True, 0.0)
    assert relaxation.Settings(projected=True).check(3, 2).eta_max == 2048 and relaxation.Settings(niter=2.6).check(3, 2).niter == 3
    for kwds, y in (({"lossf": "rloss"}, y3), ({"lossf": "epsilon"}, y2), ({"projected": True, "subset": [1]}, y2), ({"lossf": "x"}, y2)):
        with pytest.raises(InvalidInput):
            relaxation.RiemannianRelaxation(lap, y, 2, **kwds)
    with pytest.raises(ValueError):
        relaxation.RiemannianRelaxation(lap, y2, 2, step_method="x")


def test_trace_is_saved_and_runs_resume(spark, toy, tmp_path):
    lap, y2, _ = toy
    folder = f"file://{tmp_path}"
    settings = {"niter": 4, "niter_trace": 2, "step_method": "momentum", "save_every": 2, "folder": folder}
    whole = relaxation.RiemannianRelaxation(lap, y2, 2, name="whole", save_init=True, **settings).relax()
    assert len(whole.trace.loss) == 5 and len(whole.trace.first_metric) == len(whole.trace.last_metric) == 2
    trace, _ = relaxation.Trace.load(spark, f"{folder}/whole/trace")
    assert trace.loss == whole.trace.loss and trace.eta == whole.trace.eta and trace.rose == whole.trace.rose
    assert all(np.array_equal(a, b) for n in relaxation._KEPT for a, b in zip(getattr(trace, n), getattr(whole.trace, n)))
    assert np.array_equal(trace.best, whole.trace.best)
    again = relaxation.RiemannianRelaxation.from_init(spark, f"{folder}/whole", 2, name="again", **settings).resume(f"{folder}/whole/backup-2")
    assert np.allclose(again.trace.loss, whole.trace.loss) and np.allclose(again.y, whole.y)
    with pytest.warns(UserWarning, match="rounded"):
        relaxation.Settings(niter=2.6).check(2, 2)
    with pytest.raises(InvalidInput):
        relaxation.Settings(save_init=True).check(2, 2)


def test_pairs(spark, toy):
    got = [tuple(r) for r in relaxation.neighbour_pairs(toy[0]).orderBy("pid").collect()]
    assert [g[0] for g in got] == list(range(len(got))) and got == sorted(got, key=lambda g: g[1:])


# --- generators and ellipses ------------------------------------------------------------------------------------------------------
def test_generators_do_not_depend_on_partitions(spark):
    a = generators.hourglass(spark, 200, noise=0.05, extra_dims=2, seed=3)
    b = generators.hourglass(spark, 200, noise=0.05, extra_dims=2, seed=3).repartition(7)
    assert np.array_equal(rows(a, "v"), rows(b, "v")) and rows(a, "v").shape == (200, 5)
    clean = rows(generators.hourglass(spark, 500, scale=1.0), "v")
    z = clean[:, 2]
    r = -4 * z**4 + 4 * z**2 + 1
    assert np.allclose(4 * (clean[:, 0] ** 2 + clean[:, 1] ** 2) + z**2, r**2)
    assert rows(generators.swiss_roll(spark, 10), "v").shape == (10, 20)
    assert rows(generators.folded_sheet(spark, 6), "v").shape == (36, 8) and rows(generators.s_curve(spark, 9, 0.1), "v").shape == (9, 3)
    with pytest.raises(ValueError):
        generators.hourglass(spark, 5, extra_dims=2, extra_noise=[1.0])


def test_ellipses(spark):
    r = np.random.RandomState(2)
    x = r.randn(300, 2) @ np.array([[2, 0.5], [0, 0.6]])
    df = spark.createDataFrame([(1, [float(a), float(b)]) for a, b in x], "g int, v array<double>")
    got = ellipses.covariance_ellipses(df, "g", 2).first()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose([got["width"], got["height"]], 4 * np.sqrt(values[::-1]))
    long = vectors[:, 1] * np.sign(vectors[0, 1])
    assert np.isclose(got["angle"] % 180, np.degrees(np.arctan2(long[1], long[0])) % 180)
    c = np.diag([4.0, 1.0, 0.1])
    width, height, angle, normal = ellipses.ellipse_3d(c)
    assert np.allclose([width, height, angle % 180], [8, 4, 0]) and np.allclose(normal, [0, 0, 1])
    q, _ = np.linalg.qr(r.randn(3, 3))
    width, height, angle, normal = ellipses.ellipse_3d(q @ c @ q.T)
    right, ahead = ellipses.plane_axes(normal)
    frame = np.stack([right, ahead, normal])
    assert np.allclose(frame @ frame.T, np.eye(3)) and np.isclose(np.linalg.det(frame), 1) and normal[2] >= 0
    long = np.cos(np.radians(angle)) * right + np.sin(np.radians(angle)) * ahead
    assert np.isclose(abs(long @ q[:, 0]), 1) and np.isclose(abs(normal @ q[:, 2]), 1) and np.allclose([width, height], [8, 4])


def test_geometry_settings_win(spark):
    g = Geometry(adjacency_radius=2.0)
    assert spectral.bind_geometry(g, 5.0).adjacency_kwds["radius"] == 2.0 and g.affinity_kwds["radius"] == 5.0
    with pytest.raises(InvalidInput):
        spectral.bind_geometry("x", 1.0)
