"""Clustering by batched single-node moves: loyvain, coloyvain and modularity.

Small problems (a dense similarity under LOCAL_CELLS) run as one numpy kernel for each replicate, replicates in parallel over the
cluster. Larger data runs distributed(): one job for each batch, with k x p centroids as the only broadcast.

A module's value is c (modularity), c / v (kmeans: v is its size, spectral: its degree) or c / sqrt(v * vy) (between two sides).
"""

from __future__ import annotations

import logging
from collections import deque
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..plans.options import OBJECTIVES, SIMILARITIES, Climb, one_of
from ..sources.frames import LOCAL_CELLS, Network, Sparse, dense_vectors, partition_frame
from ..sources.scratch import settle
from . import linalg, moments

log = logging.getLogger(__name__)


def _value(kind: str, c, size, other=None, bad=0.0):
    """Value of modules; `bad` where there is none (size zero)."""
    if kind == "sum":
        return c
    with np.errstate(divide="ignore", invalid="ignore"):
        out = c / size if kind == "ratio" else c / np.sqrt(size * other)
    return np.where(np.isfinite(out), out, bad)


def one_hot(m: np.ndarray, k: int) -> np.ndarray:
    return np.eye(k)[m]


class Dots:
    """The matrix x x' of dot products of rows, by its factor: n x p cells instead of n x n."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def __len__(self) -> int:
        return len(self.x)

    def __matmul__(self, h: np.ndarray) -> np.ndarray:
        return self.x @ (self.x.T @ h)

    def moved(self, i: np.ndarray, delta: np.ndarray) -> np.ndarray:
        """Columns i times delta."""
        return self.x @ (self.x[i].T @ delta)

    def diagonal(self) -> np.ndarray:
        return (self.x * self.x).sum(1)

    def least(self) -> float:
        """The least cell, block by block."""
        step = max(1, LOCAL_CELLS // 4 // max(1, len(self.x)))
        return min(float((self.x[s : s + step] @ self.x.T).min()) for s in range(0, len(self.x), step))


def move_gains(w, h, m, weight, kind, at, other=None, other_hot=None):
    """Gains (len(at) x k) of moving each node of `at` alone to each module. With other_hot, w's columns are the other side, which stays."""
    s = w[at] @ (h if other_hot is None else other_hot)
    c = ((w @ (h if other_hot is None else other_hot)) * h).sum(0)
    size = h.T @ weight
    return _gains(s, c, size, m[at], weight[at], np.diag(w)[at] if other_hot is None else None, kind, other)


def _gains(s, c, size, cur, vu, wii, kind, other):
    two, own = (2.0, wii) if wii is not None else (1.0, np.zeros(len(cur)))
    rows = np.arange(len(cur))
    oa = None if other is None else other[cur]
    up = _value(kind, c + two * s + own[:, None], size + vu[:, None], other, -np.inf) - _value(kind, c, size, other)
    leave = _value(kind, c[cur] - two * s[rows, cur] + own, size[cur] - vu, oa, -np.inf) - _value(kind, c[cur], size[cur], oa)
    g = up + leave[:, None]
    g[~np.isfinite(g)] = -np.inf
    g[rows, cur] = 0.0
    return g


def climb(w, m, k, weight, kind, opts: Climb, rng, other=None, other_hot=None):
    """(labels, quality, value of each module) at the best partition seen."""
    n = len(w)
    m = m.copy()
    h = one_hot(m, k)
    basis = (lambda: h) if other_hot is None else (lambda: other_hot)
    s = w @ basis()
    wii = w.diagonal() if other_hot is None else None
    score = lambda: _value(kind, (s * h).sum(0), h.T @ weight, other)
    best = (float(score().sum()), m.copy())
    trivial = k == 1 or (k == n and kind != "sum")
    for sweep in range(0 if trivial else opts.maxiter):
        top = 0.0
        for at in np.array_split(rng.permutation(n), opts.batches(n)):
            c, size = (s * h).sum(0), h.T @ weight
            g = _gains(s[at], c, size, m[at], weight[at], None if wii is None else wii[at], kind, other)
            if kind != "sum":
                alone = h.sum(0)[m[at]] == 1
                g[alone] = -np.inf
                g[np.flatnonzero(alone), m[at][alone]] = 0.0
            new = g.argmax(1)
            gain = float(g.max())
            if gain <= opts.tolerance:
                continue
            top = max(top, gain)
            moved = new != m[at]
            i, to = at[moved], new[moved]
            if kind != "sum":  # every module keeps a node: movers go to the modules that would be empty
                while len(empty := np.flatnonzero(h.sum(0) - np.bincount(m[i], minlength=k) + np.bincount(to, minlength=k) == 0)):
                    to[rng.permutation(len(to))[: len(empty)]] = empty[: len(to)]
            delta = one_hot(to, k) - h[i]
            if other_hot is None:
                s = s + (w[:, i] @ delta if isinstance(w, np.ndarray) else w.moved(i, delta))
            h[i] += delta
            m[i] = to
        q = float(score().sum())
        if q > best[0]:
            best = (q, m.copy())
        if top < opts.tolerance:
            break
    else:
        if not trivial:
            log.warning("clustering stopped at maxiter=%d before it settled", opts.maxiter)
    m = best[1]
    h = one_hot(m, k)
    s = w @ basis()
    return m, best[0], score()


def start_labels(rows: np.ndarray, k: int, start, rng) -> np.ndarray:
    """Labels from greedy (farthest point), balanced (k-means++) or random starts over cosine distances of rows, or given labels."""
    n = len(rows)
    if not isinstance(start, str):
        m = np.asarray(start, np.int64)
        if len(m) != n or set(m.tolist()) != set(range(k)):
            raise ValueError("start labels must be 0..k-1 for every node")
        return m
    if start == "random":
        m = rng.integers(0, k, n)
        m[rng.permutation(n)[:k]] = np.arange(k)
        return m
    if isinstance(rows, Sparse):
        norm = np.sqrt(np.bincount(rows.row, rows.val**2, n))
        norm = np.where(norm > 0, norm, 1)
        far = lambda at: 1 - (rows @ (rows.line(at) / norm[at])) / norm
    else:
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        u = rows / np.where(norm > 0, norm, 1)
        far = lambda at: 1 - u @ u[at]
    seeds = [int(rng.integers(n))]
    dist = [far(seeds[0])]
    least = dist[0].copy()
    for _ in range(1, k):
        least[seeds] = 0
        p = np.maximum(least, 0)
        if start == "greedy" or p.sum() <= 0:
            left = np.where(np.isin(np.arange(n), seeds), -np.inf, least)
            seeds.append(int(left.argmax()))
        else:
            seeds.append(int(np.searchsorted(np.cumsum(p / p.sum()), rng.random(), side="right").clip(0, n - 1)))
        dist.append(far(seeds[-1]))
        least = np.minimum(least, dist[-1])
    m = np.argmin(np.stack(dist, 1), 1)
    m[seeds] = np.arange(k)
    return m


def _replicates(spark: SparkSession, run, opts: Climb) -> list:
    """run(seed) -> bytes of the best, over the cluster: one task for each replicate."""

    def task(frames):
        for f in frames:
            for r in f["id"]:
                q, labels, extra = run(int(r))
                yield pd.DataFrame({"r": [int(r)], "q": [q], "m": [labels.astype(np.int32).tobytes()], "x": [np.asarray(extra, float).tobytes()]})

    out = spark.range(0, opts.replicates, 1, opts.replicates).mapInPandas(task, "r long, q double, m binary, x binary")
    best = out.orderBy(F.desc("q"), "r").first()
    return [best.q, np.frombuffer(best.m, np.int32), np.frombuffer(best.x)]


def similarity_matrix(x: np.ndarray, kind: str, objective: str = "kmeans") -> np.ndarray:
    """Rows whose dot products are the similarity, after the objective's global residual."""
    x = x.astype(float)
    g = x.mean(0)
    if objective in ("kmodularity", "modularity"):
        x = x - np.outer(x @ g, g) / (g @ g or 1.0)
    elif objective.endswith("_ctr"):
        x = x - g
    if kind in ("corr", "cov"):
        x = x - x.mean(1, keepdims=True)
    if kind in ("corr", "cosim"):
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)
    return x / np.sqrt(x.shape[1])


def prepared(w: np.ndarray, k: int, objective: str) -> tuple[np.ndarray, str, np.ndarray]:
    """(matrix, value kind, node weights) of an objective on a symmetric similarity."""
    n = len(w)
    if objective in ("kmodularity", "modularity", "kmodularity_ctr", "modularity_ctr"):
        w = w / (np.abs(w).sum() or 1.0) * (n / k if objective.startswith("k") else 1.0)
        d, t = w.sum(1), w.sum()
        w = w - (np.outer(d, d) / (t or 1.0) if not objective.endswith("_ctr") else (d[:, None] + d[None, :]) / n - t / n**2)
    if objective == "spectral":
        if w.min() < 0:
            raise ValueError("spectral clustering needs similarities that are not negative")
        return w, "ratio", w.sum(1)
    return w, "sum" if objective.startswith("modularity") else "ratio", np.ones(n)


def prepared_sparse(w: Sparse, k: int, objective: str) -> tuple[Sparse, str, np.ndarray]:
    """prepared() of a network by its edges; what an objective takes from every cell is kept as a product a b'."""
    n, a, b, scale = len(w), None, None, 1.0
    if objective in ("kmodularity", "modularity", "kmodularity_ctr", "modularity_ctr"):
        scale = (n / k if objective.startswith("k") else 1.0) / (np.abs(w.val).sum() or 1.0)
        d = scale * np.bincount(w.row, w.val, n)
        t = d.sum()
        a, b = (np.stack([d, np.ones(n)], 1), np.stack([np.full(n, 1 / n), d / n - t / n**2], 1)) if objective.endswith("_ctr") else (d[:, None], d[:, None] / (t or 1.0))
    if objective == "spectral":
        if w.val.min(initial=0.0) < 0:
            raise ValueError("spectral clustering needs similarities that are not negative")
        return w, "ratio", np.bincount(w.row, w.val, n)
    return Sparse(n, w.row, w.col, w.val, scale, a, b), "sum" if objective.startswith("modularity") else "ratio", np.ones(n)


def loyvain(x: Network | DataFrame, k: int, objective: str = "kmodularity", similarity: str = "network", **options) -> tuple[DataFrame, float]:
    """((i, m), Q) of a Network (similarity network) or of rows (i, x).

    A network whose matrix would be over LOCAL_CELLS is kept by its edges. The matrix of rows is kept by its factor where it would be over LOCAL_CELLS. Rows that are themselves over it go to distributed(), a replicate for each
    seed, for kmeans and kmodularity; the other objectives raise there.
    """
    one_of("objective", objective, OBJECTIVES)
    one_of("similarity", similarity, SIMILARITIES)
    opts = Climb(**options)
    if similarity != "network" and objective in ("kmeans", "kmodularity") and isinstance(opts.start, str) and opts.start == "greedy":
        size = x.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()
        if 1 <= k <= size.n and size.n * size.p > LOCAL_CELLS:
            found = [distributed(x, k, objective, similarity, opts.maxiter, opts.batches(size.n), opts.tolerance, opts.seed + r) for r in range(opts.replicates)]
            return max(found, key=lambda f: f[1])
    if similarity == "network":
        x.checked(symmetric=True, nonnegative=objective != "kmeans")
        spark = x.edges.sparkSession
        if x.n_rows * x.n_cols <= LOCAL_CELLS:
            rows, ids, _ = x.dense()
            w, kind, weight = prepared(rows, k, objective)
        else:
            rows, ids = x.sparse()
            w, kind, weight = prepared_sparse(rows, k, objective)
    else:
        spark = x.sparkSession
        ids, raw = dense_vectors(x)
        rows = similarity_matrix(raw, similarity, objective)
        w = Dots(rows) if len(rows) ** 2 > LOCAL_CELLS else rows @ rows.T
        if objective == "spectral":
            if (w.least() if isinstance(w, Dots) else w.min()) < 0:
                raise ValueError("spectral clustering needs similarities that are not negative")
            kind, weight = "ratio", w @ np.ones(len(rows))
        else:  # the rows are residuals already
            kind, weight = "sum" if objective.startswith("modularity") else "ratio", np.ones(len(rows))
    if not 1 <= k <= len(ids):
        raise ValueError("k must be between 1 and the number of nodes")
    opts.batches(len(ids))
    send = spark.sparkContext.broadcast((w, rows))  # under LOCAL_CELLS; by factors the rows are sent once, as both

    def run(r: int):
        w, rows = send.value
        rng = np.random.default_rng([opts.seed, r])
        m, q, _ = climb(w, start_labels(rows, k, opts.start, rng), k, weight, kind, opts, rng)
        return q, m, []

    q, m, _ = _replicates(spark, run, opts)
    return partition_frame(spark, ids, m), q


def _align(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of modules by repeatedly taking the greatest block."""
    k = len(c)
    c = np.nan_to_num(c, nan=-1e300, neginf=-1e300)
    x, y = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for h in range(k):
        i, j = np.unravel_index(c.argmax(), c.shape)
        x[i] = y[j] = h
        c[i, :] = c[:, j] = -np.inf
    return x, y


def coclimb(w: np.ndarray, k: int, objective: str, opts: Climb, rng) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    kind = "root"
    wx, wy = (np.ones(w.shape[0]), np.ones(w.shape[1])) if objective != "spectral" else (w.sum(1), w.sum(0))
    mx, my = start_labels(w, k, opts.start, rng), start_labels(w.T, k, opts.start, rng)
    hx, hy = one_hot(mx, k), one_hot(my, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        ax, ay = _align((hx.T @ w @ hy) / np.sqrt(np.outer(hx.T @ wx, hy.T @ wy)))
    mx, my = ax[mx], ay[my]
    q, value = -np.inf, np.zeros(k)
    for _ in range(opts.maxiter):
        hy = one_hot(my, k)
        mx, _, _ = climb(w, mx, k, wx, kind, opts, rng, hy.T @ wy, hy)
        hx = one_hot(mx, k)
        new, q, value = climb(w.T, my, k, wy, kind, opts, rng, hx.T @ wx, hx)
        if (new == my).all():
            break
        my = new
    return mx, my, q, value


#: Most pairs of labellings (times modules) that coloyvain tries one by one instead of climbing.
EXACT_PAIRS = 4_000_000


def best_pair(w: np.ndarray, k: int, objective: str) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """The best of all pairs of labellings that use every label on both sides; of equal ones the first, counting with the first node as the least digit."""

    def hot(n: int) -> np.ndarray:
        m = np.arange(k**n)[:, None] // k ** np.arange(n) % k
        h = np.eye(k)[m]
        return h[(h.sum(1) > 0).all(1)]

    hx, hy = hot(w.shape[0]), hot(w.shape[1])
    wx, wy = (np.ones(w.shape[0]), np.ones(w.shape[1])) if objective != "spectral" else (w.sum(1), w.sum(0))
    value = np.stack([_value("root", hx[:, :, h] @ w @ hy[:, :, h].T, (hx[:, :, h] @ wx)[:, None], (hy[:, :, h] @ wy)[None, :]) for h in range(k)], 2)
    q = value.sum(2)
    a, b = np.unravel_index((q >= q.max() - 1e-12 * np.abs(q).max()).argmax(), q.shape)
    return hx[a].argmax(1), hy[b].argmax(1), float(q[a, b]), value[a, b]


def coloyvain(x: Network | DataFrame, k: int, objective: str = "kmodularity", similarity: str = "network", **options) -> tuple[DataFrame, DataFrame, float, np.ndarray]:
    """(partition of rows, of columns, R, R of each module) of a bipartite Network, or of rows (x, y): the columns of x against those of y.

    With so few nodes that all pairs of labellings can be tried (EXACT_PAIRS) the result is the best of them, whatever the named start and the replicates.
    """
    one_of("objective", objective, ("kmeans", "kmodularity", "spectral"))
    one_of("similarity", similarity, SIMILARITIES)
    opts = Climb(**options)
    if similarity == "network":
        spark = x.edges.sparkSession
        w, ri, ci = x.dense()
    else:
        spark = x.sparkSession
        w = cross_similarity(x, similarity)
        ri, ci = np.arange(w.shape[0]), np.arange(w.shape[1])
    if objective in ("kmodularity", "spectral") and w.min() < 0:
        raise ValueError("weights must not be negative")
    if objective == "kmodularity":
        w = w * np.sqrt(w.shape[0] * w.shape[1]) / k / (np.abs(w).sum() or 1.0)
        w = w - np.outer(w.sum(1), w.sum(0)) / (w.sum() or 1.0)
    if not 1 <= k <= min(w.shape):
        raise ValueError("k must be between 1 and the smaller side")
    opts.batches(min(w.shape))
    if isinstance(opts.start, str) and k ** sum(w.shape) * k <= EXACT_PAIRS:
        mx, my, q, value = best_pair(w, k, objective)
        return partition_frame(spark, ri, mx), partition_frame(spark, ci, my), q, value
    send = spark.sparkContext.broadcast(w)

    def run(r: int):
        mx, my, q, value = coclimb(send.value, k, objective, opts, np.random.default_rng([opts.seed, r]))
        return q, np.concatenate([mx, my]), value

    q, m, value = _replicates(spark, run, opts)
    return partition_frame(spark, ri, m[: len(ri)]), partition_frame(spark, ci, m[len(ri) :]), q, value


def cross_similarity(rows: DataFrame, similarity: str) -> np.ndarray:
    """Similarity of every column of x with every column of y, by partition sums."""
    x, y = (linalg.column_means(rows, c) for c in ("x", "y"))
    n = rows.count()
    p, q = len(x), len(y)
    two = lambda a, b: linalg.cross(rows.select(F.col(a).alias("x"), F.col(b).alias("y")), p if a == "x" else q, p if b == "x" else q)
    z = two("x", "y")
    centre = similarity in ("corr", "cov")
    if centre:
        z = z - n * np.outer(x, y)
    if similarity in ("dot", "cov"):
        return z / n
    sx, sy = (np.diag(two(c, c)) - (n * mean**2 if centre else 0) for c, mean in (("x", x), ("y", y)))
    return z / np.sqrt(np.outer(np.where(sx > 0, sx, 1), np.where(sy > 0, sy, 1)))


def louvain_labels(w: np.ndarray | Sparse, gamma: float, rng, start=None, tolerance: float = 1e-10) -> np.ndarray:
    """Modularity by moves of single nodes until none gains, then of merged nodes, until nothing changes. Weights are not negative.

    A node is offered the modules of its neighbours and an empty one: no other module can gain more than the empty one.
    """
    w = w if isinstance(w, Sparse) else Sparse.dense(w)
    n, t = len(w), w.val.sum() or 1.0
    label = np.arange(n) if start is None else np.unique(start, return_inverse=True)[1].astype(np.int64)
    group = np.arange(n)  # node -> super-node
    while True:
        a = w.merged(group)
        size = len(a)
        d, loop = np.bincount(a.row, a.val, size), a.diagonal()
        m = np.zeros(size, np.int64)
        m[group] = label
        slots = max(size, label.max() + 1)
        dm, many = np.bincount(m, d, slots), np.bincount(m, minlength=slots)
        empty = np.flatnonzero(many == 0)[::-1].tolist()
        changed, queue = False, deque(rng.permutation(size).tolist())
        waiting = np.ones(size, bool)
        while queue:
            i = queue.popleft()
            waiting[i] = False
            cur = m[i]
            near, val = a.col[a.start[i] : a.start[i + 1]], a.val[a.start[i] : a.start[i + 1]]
            to, at = np.unique(m[near], return_inverse=True)
            s = np.bincount(at, val, len(to))
            stay = s[to == cur].sum() - loop[i] - gamma * d[i] * (dm[cur] - d[i]) / t
            gain = s - gamma * d[i] * dm[to] / t - stay
            gain[to == cur] = 0
            best, most = (int(to[gain.argmax()]), gain.max()) if len(to) else (cur, 0.0)
            if many[cur] > 1 and -stay > most:
                best, most = empty[-1], -stay
            if most / t > tolerance:
                if many[best] == 0:
                    empty.remove(best)
                dm[cur] -= d[i]
                dm[best] += d[i]
                many[cur] -= 1
                many[best] += 1
                if many[cur] == 0:
                    empty.append(int(cur))
                m[i] = best
                changed = True
                for j in near[~waiting[near] & (m[near] != best)].tolist():
                    waiting[j] = True
                    queue.append(j)
        label = np.unique(m[group], return_inverse=True)[1]
        if not changed or (label == group).all():
            return label
        group = label
        label = np.arange(group.max() + 1)[group]


def modularity(net: Network, gamma: float = 1.0, start=None, replicates: int = 10, finaltune: bool = False, tolerance: float = 1e-10, seed: int = 1) -> tuple[DataFrame, float]:
    """((i, m), Q): modularity maximisation with resolution gamma, the best of the replicates. A network is kept by its edges, at most LOCAL_EDGES."""
    net.checked(symmetric=True, nonnegative=True)
    spark = net.edges.sparkSession
    w, ids = net.sparse()
    t = w.val.sum() or 1.0
    send = spark.sparkContext.broadcast(w)

    def run(r: int):
        w = send.value
        rng = np.random.default_rng([seed, r])
        m = louvain_labels(w, gamma, rng, start, tolerance)
        if finaltune:
            m = louvain_labels(w, gamma, rng, m, tolerance)
        inside = w.val[m[w.row] == m[w.col]].sum() / t
        return float(inside - gamma * ((np.bincount(m[w.row], w.val) / t) ** 2).sum()), m, []

    q, m, _ = _replicates(spark, run, Climb(replicates=replicates))
    return partition_frame(spark, ids, m), q


def distributed(rows: DataFrame, k: int, objective: str = "kmeans", similarity: str = "corr", sweeps: int = 10, numbatches: int = 4, tolerance: float = 1e-10, seed: int = 1) -> tuple[DataFrame, float]:
    """loyvain for rows (i, x) of any number: kmeans or kmodularity. One pass over the data for each batch; k x p centroid sums are all that is sent.

    Seeds are k rows by hash order, nodes start at the most similar one. Batches are hash classes, so a rerun gives the same result.
    """
    one_of("objective", objective, ("kmeans", "kmodularity"))
    u = settle((moments.residual_rows(rows) if objective == "kmodularity" else rows).select("i", v.similar(F.col("x"), similarity).alias("u")).withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(numbatches))))
    seeds = np.array([r.u for r in u.orderBy(F.xxhash64(F.lit(seed), F.lit("s"), "i"), "i").limit(k).collect()])

    def assign(batches, c):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"i": b["i"], "m": pa.array((b["u"].flatten().to_numpy().reshape(len(b), -1) @ c.T).argmax(1).astype(np.int32))})

    def sums(batches):
        s, n = None, np.zeros(k, np.int64)
        for b in batches:
            if len(b):
                x, m = b["u"].flatten().to_numpy().reshape(len(b), -1), b["m"].to_numpy()
                s = np.zeros((k, x.shape[1])) if s is None else s
                np.add.at(s, m, x)
                n += np.bincount(m, minlength=k)
        if s is not None:
            yield pa.RecordBatch.from_pydict({"m": np.arange(k, dtype=np.int32), "s": pa.array(list(s), pa.list_(pa.float64())), "n": n})

    def move(batches, at, s, n):
        for b in batches:
            x, m = b["u"].flatten().to_numpy().reshape(len(b), -1), b["m"].to_numpy().copy()
            own = b["batch"].to_numpy() == at
            if own.any():
                g = _gains(x[own] @ s.T, (s * s).sum(1), n.astype(float), m[own], np.ones(own.sum()), (x[own] ** 2).sum(1), "ratio", None)
                alone = n[m[own]] == 1
                to = np.where((g.max(1) > tolerance) & ~alone, g.argmax(1), m[own])
                m[own] = to
            yield pa.RecordBatch.from_pydict({"i": b["i"], "m": pa.array(m.astype(np.int32))})

    def totals(p: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = u.join(p, "i").mapInArrow(sums, "m int, s array<double>, n long").select("m", "n", F.posexplode("s").alias("at", "x")).groupBy("m", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
        s, n = np.zeros((k, got["at"].max() + 1)), np.zeros(k, np.int64)
        s[got.m, got["at"]] = got.x
        n[got.m] = got.n
        return s, n

    p = settle(u.mapInArrow(partial(assign, c=seeds), "i long, m int"))
    s, n = totals(p)
    value = lambda s, n: float(((s * s).sum(1) / np.maximum(n, 1)).sum())
    best = (value(s, n), p)
    for _ in range(sweeps):
        before = best[0]
        for at in range(numbatches):
            p = settle(u.join(p, "i").mapInArrow(partial(move, at=at, s=s, n=n), "i long, m int"))
            s, n = totals(p)
            if (q := value(s, n)) > best[0] and n.all():
                best = (q, p)
        if best[0] - before <= tolerance:
            break
    return best[1], best[0]
