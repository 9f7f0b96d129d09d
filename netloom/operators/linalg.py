"""Linear algebra: power iteration on edges, cross products by partition sums, small decompositions on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.frames import LOCAL_CELLS, Network, from_dense
from ..sources.scratch import settle


def signed(u: np.ndarray) -> np.ndarray:
    """Columns with the sign that makes the entry of greatest magnitude positive."""
    at = np.abs(u).argmax(0)
    s = np.sign(u[at, np.arange(u.shape[1])])
    return u * np.where(s == 0, 1, s)


def leading(net: Network, rounds: int = 100, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame, float]:
    """Leading singular triple: (i, u), (j, v), s; the entry of u of greatest magnitude is positive. Small networks by a dense SVD, larger ones by power iteration, two join-aggregates a round; it raises where that does not settle."""
    spark = net.edges.sparkSession
    if net.n_rows * net.n_cols <= LOCAL_CELLS // 4:
        w, ri, ci = net.dense()
        u, s, vt = np.linalg.svd(w, full_matrices=False)
        u1 = signed(u[:, :1])[:, 0]
        v1 = vt[0] * np.sign(u1 @ u[:, 0])
        return spark.createDataFrame([(int(a), float(b)) for a, b in zip(ri, u1)], "i long, u double"), spark.createDataFrame([(int(a), float(b)) for a, b in zip(ci, v1)], "j long, v double"), float(s[0])
    v = settle(net.cols.withColumn("v", 1 + F.pmod(F.xxhash64("j"), F.lit(1000)) / 1000.0))
    last = 0.0
    for _ in range(rounds):
        u = net.edges.join(v, "j").groupBy("i").agg(F.sum(F.col("w") * F.col("v")).alias("u"))
        norm = u.agg(F.sqrt(F.sum(F.col("u") ** 2))).first()[0] or 1.0
        u = u.select("i", (F.col("u") / norm).alias("u"))
        v = net.edges.join(u, "i").groupBy("j").agg(F.sum(F.col("w") * F.col("u")).alias("v"))
        s = v.agg(F.sqrt(F.sum(F.col("v") ** 2))).first()[0] or 0.0
        v = settle(v.select("j", (F.col("v") / (s or 1.0)).alias("v")))
        if abs(s - last) <= tolerance * max(1.0, s):
            break
        last = s
    else:
        raise RuntimeError(f"power iteration did not settle in {rounds} rounds")
    top = u.orderBy(F.desc(F.abs("u")), "i").first()
    if top is not None and top.u < 0:
        u, v = u.select("i", (-F.col("u")).alias("u")), v.select("j", (-F.col("v")).alias("v"))
    return u, v, s


def cross(pairs: DataFrame, p: int, q: int, fold: int = 64) -> np.ndarray:
    """X'Y of rows (x, y): a p x q partial product for each partition, summed by `fold` groups before the driver adds them."""

    def part(batches):
        z = None
        for b in batches:
            if len(b):
                x, y = (b[c].flatten().to_numpy().reshape(len(b), -1) for c in ("x", "y"))
                z = x.T @ y if z is None else z + x.T @ y
        if z is not None:
            yield pa.RecordBatch.from_pydict({"z": [z.tobytes()]})

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"z": [sum(np.frombuffer(z) for z in t["z"].to_pylist()).tobytes()]})

    parts = pairs.select("x", "y").mapInArrow(part, "z binary")
    sums = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(fold)).alias("g")).applyInArrow(add, "z binary").collect()
    return sum((np.frombuffer(r.z).reshape(p, q) for r in sums), np.zeros((p, q)))


def column_means(rows: DataFrame, name: str) -> np.ndarray:
    got = rows.select(F.posexplode(name).alias("at", "v")).groupBy("at").agg(F.avg("v").alias("g")).orderBy("at").collect()
    return np.array([r.g for r in got])


def eigen(w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k eigenpairs of a symmetric matrix of greatest magnitude, in that order."""
    d, u = np.linalg.eigh((w + w.T) / 2)
    at = np.argsort(-np.abs(d), kind="stable")[:k]
    return d[at], signed(u[:, at])


def eigen_sparse(w, k: int, tolerance: float = 1e-10, keep: int = 0, rounds: int = 2000, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """k eigenpairs of greatest magnitude of a symmetric matrix with @, in that order: Lanczos with whole orthogonalisation and thick restarts.

    After the residuals are under tolerance (times the greatest value) it goes on from a new random vector until they are so again with the same values, so
    that a value that occurs more than once is found as often. Raises where that takes over `rounds` restarts.
    """
    n = len(w)
    m = min(n, keep or max(2 * k + 40, 60))
    rng = np.random.default_rng(seed)
    v, av = np.empty((n, m), order="F"), np.empty((n, m), order="F")
    have, nxt, last = 0, rng.normal(size=n), None
    for _ in range(rounds):
        for j in range(have, m):
            for _ in range(2):
                size = np.linalg.norm(nxt)
                nxt = nxt - v[:, :j] @ (v[:, :j].T @ nxt)
                if np.linalg.norm(nxt) <= 1e-10 * size:  # the space is whole: go on elsewhere
                    nxt = rng.normal(size=n)
                    nxt -= v[:, :j] @ (v[:, :j].T @ nxt)
            nxt -= v[:, :j] @ (v[:, :j].T @ nxt)
            v[:, j] = nxt / np.linalg.norm(nxt)
            av[:, j] = nxt = w @ v[:, j]
        d, y = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
        y = y[:, at := np.argsort(-np.abs(d), kind="stable")]
        d = d[at]
        if m == n:
            return d[:k], signed(v @ y[:, :k])
        rest = np.linalg.norm(av @ y[:, :k] - (v @ y[:, :k]) * d[:k], axis=0)
        nxt = av[:, -1] - v @ (v.T @ av[:, -1])
        if rest.max() <= tolerance * max(np.abs(d[0]), 1e-300):
            if last is not None and np.allclose(d[:k], last, rtol=0, atol=tolerance * np.abs(d[0])):
                return d[:k], signed(v @ y[:, :k])
            last, nxt = d[:k], rng.normal(size=n)
        have = k + (m - k) // 2
        v[:, :have], av[:, :have] = v @ y[:, :have], av @ y[:, :have]
    raise RuntimeError(f"the eigenvectors did not settle in {rounds} restarts")


def shrinkage(net: Network) -> Network:
    """The symmetric network with a shrunk spectrum, every cell written out; it needs its matrix on one machine and raises above the local limit."""
    w, ri, _ = net.checked(symmetric=True).dense()
    return from_dense(net.edges.sparkSession, shrink(w), ri, ri, keep_zeros=True)


def shrink(w: np.ndarray) -> np.ndarray:
    """Symmetric matrix with its spectrum replaced by a cubic in the rank, fitted without the leading eigenvalues before the knee."""
    if not np.allclose(w, w.T):
        raise ValueError("the matrix must be symmetric")
    d, u = np.linalg.eigh(w)
    d, u = d[::-1], u[:, ::-1]
    n = len(d)
    rank = np.arange(1, n + 1) / n  # scaled ranks: the same cubic, better conditioned

    def fit(skip: int) -> tuple[np.ndarray, float]:
        c = np.polynomial.polynomial.polyfit(rank[skip:], d[skip:], min(3, n - skip - 1))
        r = d[skip:] - np.polynomial.polynomial.polyval(rank[skip:], c)
        return c, float(np.sqrt((r @ r) / (n - skip)))

    best, whole = fit(0)
    last = 0.0
    for skip in range(1, n - 1):
        c, rms = fit(skip)
        rise = ((whole - rms) / whole if whole > 0 else 0.0) - skip / (n - 1)
        if rise < last:
            break
        best, last = c, rise
    return (u * np.polynomial.polynomial.polyval(rank, best)) @ u.T
