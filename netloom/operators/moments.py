"""Degree, dispersion and residuals of networks and data, as aggregates over edges.

Means and variances are over the full width, zeros included. Residual networks are dense; residual_factors() keeps them as
edges with row sums, column sums and total, and only residual() writes out all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..sources.frames import Network
from . import linalg


def _by_row(net: Network, *aggs: Column) -> DataFrame:
    return net.rows.join(net.edges.groupBy("i").agg(*aggs), "i", "left")


def degree(net: Network, kind: str = "first") -> DataFrame:
    """(i, value): row sums (first), sums of squares (second), or row sums after removing the leading rank-one part (residual)."""
    if kind in ("first", "second"):
        return _by_row(net, F.sum("w" if kind == "first" else F.col("w") * F.col("w")).alias("value")).select("i", F.coalesce("value", F.lit(0.0)).alias("value"))
    if kind == "residual":
        left, right, s = linalg.leading(net)
        scale = right.agg(F.sum("v").alias("t")).first().t * s
        return degree(net).join(left, "i", "left").select("i", (F.col("value") - F.coalesce("u", F.lit(0.0)) * scale).alias("value"))
    raise ValueError("kind: first, second or residual")


def dispersion(net: Network, kind: str = "coefvar2", partition: DataFrame | None = None) -> DataFrame:
    """(i, value): squared coefficient of variation of each row, or k-participation over a partition(i, m). Rows of zeros give null."""
    if kind == "coefvar2":
        n = float(net.n_cols)
        s = _by_row(net, F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
        mean = F.col("s") / n
        return s.select("i", F.try_divide(F.col("q") / n - mean * mean, mean * mean).alias("value"))
    if kind == "kpartcoef":
        if partition is None:
            raise ValueError("kpartcoef needs a partition")
        sizes = partition.groupBy("m").agg(F.count("*").alias("size"))
        k = net.edges.join(partition.select(F.col("i").alias("j"), "m"), "j").groupBy("i", "m").agg(F.sum("w").alias("w")).join(F.broadcast(sizes) if net.n_cols < 1_000_000 else sizes, "m")
        x = F.col("w") / F.col("size")
        got = k.groupBy("i").agg((1 - F.try_divide(F.sum(x * x), F.sum(x) * F.sum(x))).alias("value"))
        return net.rows.join(got, "i", "left").select("i", "value")
    raise ValueError("kind: coefvar2 or kpartcoef")


def residual_factors(net: Network) -> tuple[DataFrame, DataFrame, float]:
    """Row sums (i, so), column sums (j, si), total."""
    so = _by_row(net, F.sum("w").alias("so")).select("i", F.coalesce("so", F.lit(0.0)).alias("so"))
    si = net.cols.join(net.edges.groupBy("j").agg(F.sum("w").alias("si")), "j", "left").select("j", F.coalesce("si", F.lit(0.0)).alias("si"))
    return so, si, net.edges.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("t")).first().t


def residual(net: Network, kind: str = "degree") -> DataFrame:
    """All cells (i, j, w) of the residual: degree, degree_ctr or rankone. A sink: the result has n_rows * n_cols rows."""
    if kind == "degree":
        net.checked(nonnegative=True)
    if kind == "rankone":
        left, right, s = linalg.leading(net)
        cells = net.rows.join(left, "i", "left").crossJoin(net.cols.join(right, "j", "left")).join(net.edges, ["i", "j"], "left")
        return cells.select("i", "j", (F.coalesce("w", F.lit(0.0)) - s * F.coalesce("u", F.lit(0.0)) * F.coalesce("v", F.lit(0.0))).alias("w"))
    so, si, t = residual_factors(net)
    cells = so.crossJoin(si).join(net.edges, ["i", "j"], "left")
    w = F.coalesce("w", F.lit(0.0))
    if kind == "degree":
        return cells.select("i", "j", (w - F.coalesce(F.try_divide(F.col("so") * F.col("si"), F.lit(t)), F.lit(0.0))).alias("w"))
    if kind == "degree_ctr":
        return cells.select("i", "j", (w - F.col("so") / net.n_cols - F.col("si") / net.n_rows + t / (net.n_rows * net.n_cols)).alias("w"))
    raise ValueError("kind: degree, degree_ctr or rankone")


def mean_row(rows: DataFrame) -> list[float]:
    """Column means of rows (i, x): one number for each feature."""
    got = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("g")).orderBy("at").collect()
    return [r.g for r in got]


def residual_rows(rows: DataFrame, kind: str = "global") -> DataFrame:
    """(i, x) with the mean row regressed out (global) or subtracted (global_ctr)."""
    g = mean_row(rows)
    lit = F.array(*map(F.lit, g)) if g else F.array().cast("array<double>")
    if kind == "global_ctr":
        return rows.select("i", F.zip_with("x", lit, lambda a, b: a - b).alias("x"))
    if kind == "global":
        scale = sum(a * a for a in g) or 1.0
        return rows.select("i", v.let(v.dot(F.col("x"), lit) / scale, lambda share: F.zip_with("x", lit, lambda a, b: a - share * b)).alias("x"))
    raise ValueError("kind: global or global_ctr")
