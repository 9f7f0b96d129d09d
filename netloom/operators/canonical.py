"""Canonical covariance and correlation of paired rows (i, x, y)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.options import Climb, one_of
from ..sources.scratch import settle
from . import clustering, linalg


def _centred(rows: DataFrame, resid: bool) -> DataFrame:
    """Columns centred, or the degree residual of x and of y (both must not be negative)."""
    for c in ("x", "y"):
        mean = linalg.column_means(rows, c)
        if not resid:
            g = F.array(*map(F.lit, map(float, mean)))
            rows = rows.withColumn(c, F.zip_with(c, g, lambda a, b: a - b))
            continue
        if rows.agg(F.min(F.array_min(c))).first()[0] < 0:
            raise ValueError("degree residuals need x and y that are not negative")
        share = F.array(*map(F.lit, map(float, mean / (mean.sum() or 1.0))))  # column sums over the total
        rows = rows.withColumn("_s", F.aggregate(c, F.lit(0.0), lambda s, v: s + v)).withColumn(c, F.zip_with(c, share, lambda a, b: a - F.col("_s") * b)).drop("_s")
    return rows


def _whiten(gram: np.ndarray) -> np.ndarray:
    """V S^-1 V' of the smallest rank whose relative error (Frobenius, of the data) is at most eps^(1/4)."""
    d, u = np.linalg.eigh(gram)
    d, u = np.maximum(d[::-1], 0), u[:, ::-1]
    left = np.sqrt(np.maximum(d.sum() - np.cumsum(d), 0) / (d.sum() or 1.0))
    r = int(np.argmax(left <= np.finfo(float).eps ** 0.25)) + 1
    s = np.sqrt(d[:r])
    return (u[:, :r] / np.where(s > 0, s, np.inf)) @ u[:, :r].T


def canoncov(rows: DataFrame, k: int, kind: str = "weighted", resid: bool = True, corr: bool = False, **options):
    """(A p x k, B q x k, scores (i, u, v), R of length k): singular vectors (weighted) or co-clusters (binary) of the cross product of x and y."""
    one_of("kind", kind, ("weighted", "binary"))
    rows = settle(_centred(rows, resid).select("i", "x", "y"))
    first = rows.agg(F.max(F.size("x")).alias("p"), F.max(F.size("y")).alias("q")).first()
    p, q = first.p, first.q
    if not 1 <= k <= min(p, q):
        raise ValueError("k must be between 1 and the number of columns of the smaller side")
    z = linalg.cross(rows, p, q)
    gram = lambda c, n: linalg.cross(rows.select(F.col(c).alias("x"), F.col(c).alias("y")), n, n)
    wx, wy = (_whiten(gram("x", p)), _whiten(gram("y", q))) if corr else (np.eye(p), np.eye(q))
    z = wx @ z @ wy
    if kind == "weighted":
        a, r, bt = np.linalg.svd(z, full_matrices=False)
        s = np.sign(a[np.abs(a).argmax(0), np.arange(a.shape[1])])
        s[s == 0] = 1
        a, b, r = (a * s)[:, :k], (bt.T * s)[:, :k], r[:k]
    else:
        opts = Climb(**({"numbatches": min(32, p, q)} | options))
        best = max((clustering.coclimb(z, k, "kmeans", opts, np.random.default_rng([opts.seed, i])) for i in range(opts.replicates)), key=lambda x: x[2])
        order = np.argsort(-best[3], kind="stable")
        a, b, r = clustering.one_hot(best[0], k)[:, order], clustering.one_hot(best[1], k)[:, order], best[3][order]
    a, b = wx @ a, wy @ b

    def score(batches):
        for t in batches:
            u, v = (t[c].flatten().to_numpy().reshape(len(t), -1) @ m for c, m in (("x", a), ("y", b)))
            yield pa.RecordBatch.from_pydict({"i": t["i"], "u": pa.array(list(u), pa.list_(pa.float64())), "v": pa.array(list(v), pa.list_(pa.float64()))})

    return a, b, rows.mapInArrow(score, "i long, u array<double>, v array<double>"), r
