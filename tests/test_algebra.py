"""Gains equal recomputed objectives; gradients equal differences; invariants on small seeded matrices."""

import numpy as np
import pytest

from netloom.functions import sphere
from netloom.operators import canonical, clustering, embedding, linalg, moments, neighbors
from netloom.plans.options import Climb
from netloom.sources.frames import Network, from_dense

rng = np.random.default_rng(1)
W = np.maximum(np.corrcoef(rng.normal(size=(16, 32))), 0)


def value(w, m, k, kind, weight, other=None, hot=None):
    h = clustering.one_hot(m, k)
    return clustering._value(kind, ((w @ (h if hot is None else hot)) * h).sum(0), h.T @ weight, other).sum()


@pytest.mark.parametrize("objective", ["kmeans", "kmodularity", "kmodularity_ctr", "modularity", "modularity_ctr", "spectral"])
def test_gain_is_objective_difference(objective):
    k = 4
    w, kind, weight = clustering.prepared(W.copy(), k, objective)
    m = np.arange(16) % k
    g = clustering.move_gains(w, clustering.one_hot(m, k), m, weight, kind, np.arange(16))
    for i in range(16):
        for to in range(k):
            m2 = m.copy()
            m2[i] = to
            assert np.isclose(g[i, to], value(w, m2, k, kind, weight) - value(w, m, k, kind, weight), atol=1e-9)


def test_co_gain_is_objective_difference():
    k, w = 3, rng.random((12, 9))
    m, my = np.arange(12) % k, np.arange(9) % k
    hot = clustering.one_hot(my, k)
    other = hot.sum(0)
    g = clustering.move_gains(w, clustering.one_hot(m, k), m, np.ones(12), "root", np.arange(12), other, hot)
    m2 = m.copy()
    m2[0] = 2
    assert np.isclose(g[0, 2], value(w, m2, k, "root", np.ones(12), other, hot) - value(w, m, k, "root", np.ones(12), other, hot))


@pytest.mark.parametrize("objective", ["kmeans", "kmodularity", "modularity", "spectral"])
@pytest.mark.parametrize("start", ["greedy", "balanced", "random"])
@pytest.mark.parametrize("batches", [1, 4, 16])
def test_sweep_of_options(objective, start, batches):
    for k in (1, 4, 16):
        w, kind, weight = clustering.prepared(W.copy(), k, objective)
        opts = Climb(start=start, numbatches=batches, maxiter=50)
        r = np.random.default_rng(0)
        m0 = clustering.start_labels(W, k, start, r)
        m, q, _ = clustering.climb(w, m0, k, weight, kind, opts, r)
        assert np.isfinite(q) and set(m) <= set(range(k))
        assert q >= value(w, m0, k, kind, weight) - 1e-9
        if objective != "modularity":
            assert set(m) == set(range(k))


def test_gradient_and_single_module_cost():
    a = (rng.random((12, 12)) > 0.6).astype(float)
    a = np.triu(a, 1) + np.triu(a, 1).T
    for m in (np.arange(12) % 3, np.zeros(12, int)):
        p = embedding.Problem(a, m, 1.0, 1.0, 1.0)
        u = embedding._unit(rng.normal(size=(12, 3)))
        _, g = p.cost(u)
        for i, c in ((0, 0), (5, 2)):
            d = np.zeros_like(u)
            d[i, c] = 1e-6
            assert np.isclose((p.cost(u + d)[0] - p.cost(u - d)[0]) / 2e-6, g[i, c], atol=1e-4)
        for f in (embedding.adam(p, u, 50, 0.05, 1e-9), embedding.trust_regions(p, u, 50, 1e-9)):
            assert min(f[1]) <= f[1][0] and np.allclose(np.linalg.norm(f[0], axis=1), 1)


def test_louvain_beats_trivial_partitions():
    w = np.kron(np.eye(3), np.ones((5, 5))) + 0.01
    m = clustering.louvain_labels(w, 1.0, np.random.default_rng(0))
    assert len(set(m)) == 3 and all(len(set(m[5 * i : 5 * i + 5])) == 1 for i in range(3))


def test_residual_invariants_and_isolated_nodes(spark):
    w = rng.random((6, 6))
    w[2], w[:, 2] = 0, 0
    net = from_dense(spark, w)
    r = moments.residual(net).groupBy("i").sum("w").collect()
    assert len(r) == 6 and all(abs(x[1]) < 1e-9 for x in r)
    assert {x.i: x.value for x in moments.degree(net).collect()}[2] == 0.0
    assert {x.i: x.value for x in moments.dispersion(net).collect()}[2] is None
    got = {x.i: x.value for x in moments.degree(net, "residual").collect()}
    u, s, vt = np.linalg.svd(w)
    assert np.allclose([got[i] for i in range(6)], (w - s[0] * np.outer(u[:, 0], vt[0])).sum(1))
    with pytest.raises(ValueError):
        moments.residual(from_dense(spark, -w))
    with pytest.raises(ValueError):
        from_dense(spark, np.triu(w)).checked(symmetric=True)


def test_neighbors_are_exact_with_ties_and_duplicates(spark):
    x = rng.normal(size=(20, 4))
    x[3] = x[4] = x[5]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "i long, x array<double>")
    got = neighbors.nearest_rows(df, 3, "cosim").toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 10)
    np.fill_diagonal(s, -9)
    for i in range(20):
        assert set(got[got.i == i].j) == set(np.argsort(-s[i], kind="stable")[:3])
    c = neighbors.common(got_df := neighbors.nearest_rows(df, 3, "cosim")).toPandas()
    assert (c[c.i == c.j].c == 3).all() and got_df.count() == 60


def test_shrinkage_and_rotation(spark):
    s = linalg.shrink(W)
    assert np.allclose(s, s.T) and np.isfinite(linalg.shrink(W[:3, :3])).all()
    r = sphere.turn_to(np.array([0.0, 0.0, -1.0]), 2)
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(np.array([0, 0, -1.0]) @ r, [0, 0, 1])


def test_canonical_components(spark):
    x, y = rng.normal(size=(30, 5)), rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(x, y))], "i long, x array<double>, y array<double>")
    xc, yc = x - x.mean(0), y - y.mean(0)
    a, b, _, r = canonical.canoncov(df, 4, resid=False)
    assert np.allclose(r, np.linalg.svd(xc.T @ yc)[1][:4]) and np.allclose(np.diag(a.T @ xc.T @ yc @ b), r)
    a, b, _, r = canonical.canoncov(df, 4, resid=False, corr=True)
    assert np.allclose(r, np.linalg.svd(np.linalg.qr(xc)[0].T @ np.linalg.qr(yc)[0])[1])


def test_network_of_empty_edges(spark):
    net = Network.of(spark.createDataFrame([], "i long, j long, w double"), spark.range(3).withColumnRenamed("id", "i"))
    assert net.n_rows == 3 and {x.value for x in moments.degree(net).collect()} == {0.0}


def test_streaming_degrees(spark, tmp_path):
    from netloom.streaming import moments as stream

    spark.createDataFrame([(1, 2, 3.0), (1, 3, 4.0), (2, 1, 1.0)], "i long, j long, w double").write.parquet(str(tmp_path / "e"))
    q = stream.degrees(spark.readStream.schema("i long, j long, w double").parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.i, r.first, r.n) for r in spark.sql("select * from deg").collect()} == {(1, 7.0, 2), (2, 1.0, 1)}


def test_one_module_cost_is_the_cost_over_all_pairs():
    a = np.triu((rng.random((14, 14)) > 0.5).astype(float), 1)
    a = a + a.T
    u = embedding._unit(rng.normal(size=(14, 3)))
    for alpha, beta, gamma in ((1.0, 1.0, 1.0), (2.0, 0.7, 1.3)):
        want = 0.0
        for i in range(14):
            for j in range(14):
                d2 = ((u[i] - u[j]) ** 2).sum()
                want -= (a[i, j] - gamma * a[i].sum() * a[j].sum() / a.sum()) / (1 + alpha * d2**beta)
        assert np.isclose(embedding.Problem(a, np.zeros(14, int), alpha, beta, gamma).cost(u)[0], want)


def test_solvers_reach_a_stationary_point():
    a = np.kron(np.eye(2), np.ones((6, 6))) - np.eye(12)
    p = embedding.Problem(a, np.zeros(12, int), 1.0, 1.0, 1.0)
    u = embedding._unit(np.random.default_rng(4).normal(size=(12, 3)))
    for v, history in (embedding.trust_regions(p, u, 500, 1e-9), embedding.adam(p, u, 5000, 0.05, 1e-12)):
        assert np.abs(embedding.tangent(v, p.cost(v)[1])).max() < 1e-2 * np.abs(embedding.tangent(u, p.cost(u)[1])).max() and history[-1] < history[0]


def test_orders_of_the_greedy_start():
    w = np.array([[0, 5, 1.0], [5, 0, 2], [1, 2, 0]])
    assert embedding.module_order(w) == [1, 2, 0]
    assert sorted(embedding.spread(sphere.fibonacci_array(9))) == list(range(9))


def test_meridians_against_all_pairs(spark):
    x = rng.normal(size=(200, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pts = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, x double, y double, z double")
    t = -np.pi + 2 * np.pi * np.arange(144) / 144
    line = np.stack([np.cos(t)[:, None] + 0 * x[:, 2], np.sin(t)[:, None] + 0 * x[:, 2], 0 * t[:, None] + x[:, 2]], 2)
    line /= np.linalg.norm(line, axis=2, keepdims=True)
    want = ((line * x).sum(2) > np.cos(sphere.NEAR * np.pi / 144)).sum(1)
    assert (sphere.meridian_counts(pts) == want).all()
    assert sphere.middle_of_longest_gap(np.array([0, 1, 0, 0, 0, 1, 0], bool)) == 3 and sphere.middle_of_longest_gap(np.array([0, 0, 1, 1, 0, 0, 0], bool)) == 6
    turned, r = sphere.rotation(pts)
    got = turned.orderBy("i").toPandas()[["x", "y", "z"]].to_numpy()
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(got, x @ r)


def test_power_iteration_agrees_with_the_dense_form(spark, monkeypatch):
    net = from_dense(spark, rng.random((8, 6)))
    u, v, s = linalg.leading(net)
    monkeypatch.setattr(linalg, "LOCAL_CELLS", 4)
    u2, v2, s2 = linalg.leading(net)
    assert np.isclose(s, s2) and all(np.allclose(a.orderBy(a.columns[0]).toPandas().iloc[:, 1], b.orderBy(b.columns[0]).toPandas().iloc[:, 1], atol=1e-5) for a, b in ((u, u2), (v, v2)))
    with pytest.raises(RuntimeError):
        linalg.leading(net, rounds=1)
