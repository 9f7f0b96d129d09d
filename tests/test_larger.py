"""What larger tables need: results beyond the local matrix, and small problems solved whole."""

import numpy as np
import pytest

from netloom.operators import clustering, embedding, linalg, neighbors
from netloom.sources import frames
from netloom.sources.frames import Sparse, from_dense


def pair_value(w, x, y, objective):
    if objective == "kmodularity":
        w = w * np.sqrt(w.size) / 2 / w.sum()
        w = w - np.outer(w.sum(1), w.sum(0)) / w.sum()
    a, b = np.eye(2)[x], np.eye(2)[y]
    sizes = (a.sum(0), b.sum(0)) if objective != "spectral" else (a.T @ w.sum(1), b.T @ w.sum(0))
    return (np.diag(a.T @ w @ b) / np.sqrt(sizes[0] * sizes[1])).sum()


@pytest.mark.parametrize("objective", ["kmeans", "kmodularity", "spectral"])
def test_coloyvain_of_few_nodes_is_the_best_pair(spark, objective):
    # nearly rank one, as trade between regions: 60 random starts of the climb stay below the best pair
    rng = np.random.default_rng(0)
    w = np.outer([620, 646, 625, 660, 623], [200, 174, 194, 193, 203]) * (1 + 0.02 * rng.normal(size=(5, 5)))
    x, y, q, value = clustering.coloyvain(from_dense(spark, w), 2, objective, start="random", replicates=60)
    mx, my = (np.array([r.m for r in p.orderBy("i").collect()]) for p in (x, y))
    every = [np.array([b >> i & 1 for i in range(5)]) for b in range(1, 31)]
    best = max(pair_value(w, a, b, objective) for a in every for b in every)
    assert np.isclose(q, best, rtol=1e-9) and np.isclose(pair_value(w, mx, my, objective), best, rtol=1e-9) and np.isclose(value.sum(), q)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, x array<double>")


def labels_of(p):
    return np.array([r.m for r in p.orderBy("i").collect()])


@pytest.mark.parametrize("objective", ["kmeans", "kmodularity", "modularity", "spectral"])
def test_rows_over_the_local_matrix(spark, monkeypatch, objective):
    x = np.random.default_rng(2).normal(size=(60, 5)) + (4 if objective == "spectral" else 0)
    want, q = clustering.loyvain(frame(spark, x), 3, objective, "cosim", replicates=2)
    monkeypatch.setattr(clustering, "LOCAL_CELLS", 60 * 5)  # the rows fit, their 60 x 60 products do not
    got, r = clustering.loyvain(frame(spark, x), 3, objective, "cosim", replicates=2)
    assert np.isclose(q, r) and (labels_of(want) == labels_of(got)).all()


def test_rows_over_the_local_limit_are_distributed(spark, monkeypatch):
    x = np.repeat(np.eye(3), 20, 0) + 0.1 * np.random.default_rng(3).normal(size=(60, 3))
    monkeypatch.setattr(clustering, "LOCAL_CELLS", 100)
    m = labels_of(clustering.loyvain(frame(spark, x), 3, "kmeans", "cosim", numbatches=2, replicates=2)[0]).reshape(3, 20)
    assert len(set(m[:, 0])) == 3 and (m == m[:, :1]).all()


def sparse_network(n, seed=4):
    rng = np.random.default_rng(seed)
    w = np.triu(rng.integers(1, 4, (n, n)) * (rng.random((n, n)) < 0.3), 1).astype(float)
    w[: n // 2, : n // 2] *= 3
    return w + w.T + np.diag(rng.integers(0, 3, n))


def test_top_of_a_block_with_ties():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 6, (40, 300)) / 5.0
    w[3], w[4, 7:] = 1.0, -np.inf
    r, j, v = neighbors._top(w, np.arange(300), 5)
    for i in range(40):
        want = [c for c in np.argsort(-w[i], kind="stable")[:5] if w[i, c] > -np.inf]
        assert j[r == i].tolist() == want and (v[r == i] == w[i, want]).all()


def test_sparse_eigenvectors():
    w = sparse_network(150)
    d, u = linalg.eigen_sparse(Sparse.dense(w), 4)
    e, z = linalg.eigen(w, 4)
    assert np.allclose(d, e) and np.allclose(u, z, atol=1e-7)
    twice = np.kron(np.eye(2), w)  # every eigenvalue twice
    d, u = linalg.eigen_sparse(Sparse.dense(twice), 4)
    assert np.allclose(d, np.repeat(e[:2], 2)) and np.allclose(twice @ u, u * d, atol=1e-6) and np.allclose(u.T @ u, np.eye(4))


def test_neighbour_components_over_the_local_matrix(spark, monkeypatch):
    rows = frame(spark, np.random.default_rng(6).normal(size=(120, 8)))
    get = lambda: neighbors.components(rows, 3, neighbours=5, similarity="cosim").orderBy("i", "comp").toPandas()
    want = get()
    monkeypatch.setattr(neighbors, "LOCAL_CELLS", 1000)
    monkeypatch.setattr(frames, "EDGES_AT_ONCE", 300)
    got = get()
    assert (got[["i", "comp"]] == want[["i", "comp"]]).all(None) and np.allclose(got.value, want.value, atol=1e-7)


@pytest.mark.parametrize("objective", ["kmeans", "kmodularity", "kmodularity_ctr", "modularity", "modularity_ctr", "spectral"])
def test_networks_over_the_local_matrix(spark, monkeypatch, objective):
    net = from_dense(spark, sparse_network(40))
    want, q = clustering.loyvain(net, 3, objective, replicates=2)
    monkeypatch.setattr(clustering, "LOCAL_CELLS", 1000)
    got, r = clustering.loyvain(net, 3, objective, replicates=2)
    assert np.isclose(q, r) and (labels_of(want) == labels_of(got)).all()


def test_binary_neighbour_components_over_the_local_matrix(spark, monkeypatch):
    rows = frame(spark, np.random.default_rng(7).normal(size=(100, 6)))
    get = lambda: labels_of(neighbors.components(rows, 4, "binary", neighbours=5, similarity="cosim", replicates=2))
    want = get()
    monkeypatch.setattr(clustering, "LOCAL_CELLS", 1000)
    assert (get() == want).all()


def test_index_has_every_row_and_meets_all_cells_it_probes(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(90, 6))
    x[5] = x[6] = x[7]
    rows = frame(spark, x)
    want = {(r.i, r.j, r.w) for r in neighbors.nearest_rows(rows, 4, "cosim").collect()}
    for block in (8_000_000, 200):
        monkeypatch.setattr(neighbors, "BLOCK_CELLS", block)
        assert {(r.i, r.j, r.w) for r in neighbors.approximate_rows(rows, 4, cells=5, probes=5, sample=40).collect()} == want
        assert len({r.i for r in neighbors.approximate_rows(rows, 4, cells=5, probes=1).select("i").collect()}) == 90


def test_indirect_neighbours_do_not_list_pairs(spark):
    # pairs of rows that share a bucket went through a join and an aggregate; now each row's neighbours leave its task
    plan = neighbors.approximate_rows(frame(spark, np.random.default_rng(9).normal(size=(50, 4))), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_mumap_and_modularity_need_no_matrix(spark, monkeypatch):
    rows = frame(spark, np.random.default_rng(10).normal(size=(90, 6)))
    get = lambda: embedding.mumap(rows, kappa=6, maxiter=20, learnrate=0.05, replicates=2)
    place = lambda u: np.array([r.u for r in u.orderBy("i").collect()])
    want = get()
    for module in (embedding, clustering, neighbors, frames):
        monkeypatch.setattr(module, "LOCAL_CELLS", 90 * 90 - 1, raising=False)
    monkeypatch.setattr(frames.Network.dense, "__defaults__", (90 * 90 - 1,))
    monkeypatch.setattr(embedding, "PAIRS_AT_ONCE", 100)
    got = get()
    assert np.allclose(place(want[0]), place(got[0])) and (labels_of(want[1]) == labels_of(got[1])).all()
    assert place(got[0]).shape == (90, 3) and got[2].count() == want[2].count()


def test_sparse_louvain_ends_where_no_node_gains():
    for seed in range(5):
        w = sparse_network(50, seed)
        m = clustering.louvain_labels(w, 1.0, np.random.default_rng(seed))
        for _ in range(20):  # moves of merged nodes can open new ones of single nodes
            last, m = m, clustering.louvain_labels(w, 1.0, np.random.default_rng(seed), m)
            if (last == m).all():
                break
        k = int(m.max()) + 2  # and an empty module
        b = w - np.outer(w.sum(1), w.sum(1)) / w.sum()
        s = b @ np.eye(k)[m]
        gain = s - (s[np.arange(50), m] - np.diag(b))[:, None]
        gain[np.arange(50), m] = 0
        assert gain.max() / w.sum() < 1e-9 and len(set(m.tolist())) == k - 1 > 1
