"""Typed frames: networks as edges (i, j, w), data as rows (i, features), partitions (i, m)."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import settle

#: Most cells of a matrix that is brought to the driver or one task (800 MB of doubles at 1e8; here 128 MB).
LOCAL_CELLS = 16_000_000
#: Most edges of a sparse matrix on the driver or in one task (16 bytes an edge).
LOCAL_EDGES = 32_000_000
#: Edges that come to the driver at once.
EDGES_AT_ONCE = 2_000_000


class Sparse:
    """A square matrix by its cells other than zero (row, col, val), sorted by row and column, times `scale` and minus a b'."""

    def __init__(self, n: int, row: np.ndarray, col: np.ndarray, val: np.ndarray, scale: float = 1.0, a: np.ndarray | None = None, b: np.ndarray | None = None):
        self.n, self.row, self.col, self.val, self.scale, self.a, self.b = n, row, col, val, scale, a, b
        self.start = np.searchsorted(row, np.arange(n + 1))

    @staticmethod
    def of(n: int, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> Sparse:
        """Cells in any order; repeated ones are summed."""
        key = row.astype(np.int64) * n + col
        at = np.argsort(key, kind="stable")
        key, val = key[at], np.asarray(val, float)[at]
        if len(key):
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, val = (key, val) if len(first) == len(key) else (key[first], np.add.reduceat(val, first))
        return Sparse(n, (key // n).astype(np.int32), (key % n).astype(np.int32), val)

    @staticmethod
    def dense(w: np.ndarray) -> Sparse:
        r, c = np.nonzero(w)
        return Sparse(len(w), r.astype(np.int32), c.astype(np.int32), w[r, c].astype(float))

    def __len__(self) -> int:
        return self.n

    def __matmul__(self, h: np.ndarray) -> np.ndarray:
        if h.ndim == 1:
            return (self @ h[:, None])[:, 0]
        out = self.scale * np.stack([np.bincount(self.row, self.val * h[self.col, c], self.n) for c in range(h.shape[1])], 1)
        return out if self.a is None else out - self.a @ (self.b.T @ h)

    def moved(self, i: np.ndarray, delta: np.ndarray) -> np.ndarray:
        """Columns i times delta; the cells are symmetric."""
        many = self.start[i + 1] - self.start[i]
        at = np.repeat(self.start[i] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        by, col, val = np.repeat(np.arange(len(i)), many), self.col[at], self.val[at]
        out = self.scale * np.stack([np.bincount(col, val * delta[by, c], self.n) for c in range(delta.shape[1])], 1)
        return out if self.a is None else out - self.a @ (self.b[i].T @ delta)

    def diagonal(self) -> np.ndarray:
        on = self.row == self.col
        d = self.scale * np.bincount(self.row[on], self.val[on], self.n)
        return d if self.a is None else d - (self.a * self.b).sum(1)

    def line(self, i: int) -> np.ndarray:
        """Row i of the cells, without scale and a b'."""
        out = np.zeros(self.n)
        out[self.col[self.start[i] : self.start[i + 1]]] = self.val[self.start[i] : self.start[i + 1]]
        return out

    def merged(self, group: np.ndarray) -> Sparse:
        """The cells summed by groups of nodes 0, 1, ..."""
        return Sparse.of(int(group.max()) + 1, group[self.row], group[self.col], self.val)


@dataclass(frozen=True)
class Network:
    """Edges (i, j, w) with the row and column nodes (i) and (j): isolated nodes count, so nodes are a table of their own."""

    edges: DataFrame
    rows: DataFrame
    cols: DataFrame
    n_rows: int
    n_cols: int

    @staticmethod
    def of(edges: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None, square: bool = True) -> Network:
        """Edges as doubles, repeated pairs summed. Without node tables a square network has every id that an edge has."""
        e = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
        if rows is None and square:
            rows = e.select("i").union(e.select("j")).distinct()
        rows = e.select("i").distinct() if rows is None else rows.select(F.col("i").cast("long").alias("i"))
        cols = (rows.select(F.col("i").alias("j")) if square else e.select("j").distinct()) if cols is None else cols.select(F.col(cols.columns[0]).cast("long").alias("j"))
        return Network(e, rows, cols, rows.count(), rows.count() if square else cols.count())

    def settled(self) -> Network:
        """The same network with its edges computed once."""
        return replace(self, edges=settle(self.edges))

    def checked(self, symmetric: bool = False, nonnegative: bool = False) -> Network:
        """Raise where weights are null, not finite, negative, or not symmetric, in one job."""
        e = self.edges
        bad = F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf"))
        r = e.agg(F.sum(bad.cast("int")).alias("bad"), F.min("w").alias("least")).first()
        if r.bad:
            raise ValueError("weights must be finite")
        if nonnegative and r.least is not None and r.least < 0:
            raise ValueError("weights must not be negative")
        if symmetric:
            back = e.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
            gap = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)))
            if not e.join(back, ["i", "j"], "full").where(gap > 1e-8 + 1e-5 * F.abs(F.coalesce("v", F.lit(0.0)))).isEmpty():
                raise ValueError("the network must be symmetric")
        return self

    def dense(self, limit: int = LOCAL_CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matrix, row ids, column ids) on the driver, only under the size limit."""
        if self.n_rows * self.n_cols > limit:
            raise ValueError(f"{self.n_rows} x {self.n_cols} is over the local limit of {limit} cells")
        ri = np.array(sorted(r.i for r in self.rows.collect()), np.int64)
        ci = np.array(sorted(r.j for r in self.cols.collect()), np.int64)
        w = np.zeros((len(ri), len(ci)))
        p = self.edges.toPandas()
        w[np.searchsorted(ri, p.i.to_numpy()), np.searchsorted(ci, p.j.to_numpy())] = p.w.to_numpy()
        return w, ri, ci

    def sparse(self, limit: int = LOCAL_EDGES) -> tuple[Sparse, np.ndarray]:
        """(matrix, node ids) of a square network on the driver, by at most `limit` edges."""
        many = self.edges.count()
        if many > limit:
            raise ValueError(f"{many} edges are over the local limit of {limit}")
        ids = np.sort(self.rows.select("i").toArrow()["i"].to_numpy())
        parts = max(1, -(-many // EDGES_AT_ONCE))
        got = []
        for p in range(parts):
            e = self.edges.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).select("i", "j", "w").toArrow()
            got.append((*(np.searchsorted(ids, e[c].to_numpy()).astype(np.int32) for c in "ij"), e["w"].to_numpy()))
        return Sparse.of(len(ids), *(np.concatenate([g[c] for g in got]) for c in range(3))), ids


def from_dense(spark: SparkSession, w: np.ndarray, rows=None, cols=None, keep_zeros: bool = False) -> Network:
    """A network of a small matrix; absent cells are zero."""
    rows, cols = (np.arange(n) if x is None else x for n, x in zip(w.shape, (rows, cols)))
    r, c = np.indices(w.shape) if keep_zeros else np.nonzero(w)
    r, c = np.ravel(r), np.ravel(c)
    edges = spark.createDataFrame(pa.table({"i": pa.array(np.asarray(rows)[r], pa.int64()), "j": pa.array(np.asarray(cols)[c], pa.int64()), "w": pa.array(w[r, c].astype(float))}))
    node = lambda x, name: spark.createDataFrame([(int(v),) for v in x], f"{name} long")
    return Network(edges, node(rows, "i"), node(cols, "j"), len(rows), len(cols))


def vectors(df: DataFrame, id_: str, features: str) -> DataFrame:
    """(i, x) with x as array<double>."""
    return df.select(F.col(id_).cast("long").alias("i"), F.col(features).cast("array<double>").alias("x"))


def dense_vectors(df: DataFrame, limit: int = LOCAL_CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) on the driver, only under the size limit."""
    r = df.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()
    if r.n * (r.p or 0) > limit:
        raise ValueError(f"{r.n} x {r.p} is over the local limit of {limit} cells")
    p = df.select("i", "x").orderBy("i").toArrow()
    return p["i"].to_numpy(), p["x"].combine_chunks().flatten().to_numpy().reshape(r.n, r.p) if r.n else np.empty((0, 0))


def partition_frame(spark: SparkSession, ids, m) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, m)], "i long, m int")
