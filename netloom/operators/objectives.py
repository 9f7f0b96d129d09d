"""Objectives and single-move gains of given partitions, as aggregates over edges joined with the partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..plans.options import OBJECTIVES, one_of
from ..sources.frames import Network


def modules(net: Network, partition: DataFrame) -> DataFrame:
    """(m, c, n, d): within-module weight, size, total degree."""
    p = partition.select("i", "m")
    size = p.groupBy("m").agg(F.count("*").alias("n"))
    e = net.edges.join(p, "i").join(p.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j")
    sums = e.groupBy("m").agg(F.sum(F.when(F.col("m") == F.col("mj"), F.col("w")).otherwise(0.0)).alias("c"), F.sum("w").alias("d"))
    return size.join(sums, "m", "left").select("m", F.coalesce("c", F.lit(0.0)).alias("c"), "n", F.coalesce("d", F.lit(0.0)).alias("d"))


def quality(net: Network, partition: DataFrame, objective: str = "kmeans") -> DataFrame:
    """(q): the objective's value. Residuals stay factored: a module's residual weight is c - d^2 / total, or the centred form."""
    one_of("objective", objective, OBJECTIVES)
    t = net.edges.agg(F.sum("w").alias("t"), F.sum(F.abs("w")).alias("a"))
    s = modules(net, partition).crossJoin(F.broadcast(t))  # t is one row
    n = float(net.n_rows)
    k = F.count("*")
    c = {"kmodularity": F.col("c") - F.col("d") ** 2 / F.col("t"), "modularity": F.col("c") - F.col("d") ** 2 / F.col("t")}
    centred = F.col("c") - 2 * F.col("n") * F.col("d") / n + F.col("n") ** 2 * F.col("t") / n**2
    value = {
        "kmeans": F.sum(F.col("c") / F.col("n")),
        "spectral": F.sum(F.try_divide("c", "d")),
        "kmodularity": n / k * F.sum(c["kmodularity"] / F.col("n") / F.col("a")),
        "kmodularity_ctr": n / k * F.sum(centred / F.col("n") / F.col("a")),
        "modularity": F.sum(c["modularity"] / F.col("a")),
        "modularity_ctr": F.sum(centred / F.col("a")),
    }[objective]
    return s.agg(value.alias("q"))


def quality_rows(rows: DataFrame, partition: DataFrame, similarity: str = "dot") -> DataFrame:
    """(q): k-means objective of rows (i, x): sum over modules of the squared norm of the summed rows over the size."""
    u = rows.select("i", v.similar(F.col("x"), similarity).alias("u")).join(partition, "i")
    sums = u.select("m", F.posexplode("u").alias("at", "v")).groupBy("m", "at").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return sums.groupBy("m").agg((F.sum(F.col("s") ** 2) / F.max("n")).alias("q")).agg(F.sum("q").alias("q"))


def gains(net: Network, partition: DataFrame, objective: str = "kmeans") -> DataFrame:
    """(i, m, gain): the change of the objective when node i alone moves to module m. kmeans or spectral; nodes alone in their module do not move."""
    one_of("objective", objective, ("kmeans", "spectral"))
    s = modules(net, partition)
    s = s.select("m", "c", "n", (F.col("n").cast("double") if objective == "kmeans" else F.col("d")).alias("v"))
    p = partition.select("i", "m")
    to = net.edges.join(p.select(F.col("i").alias("j"), "m"), "j").groupBy("i", "m").agg(F.sum("w").alias("s"))
    own = net.edges.where("i = j").select("i", F.col("w").alias("wii"))
    deg = net.edges.groupBy("i").agg(F.sum("w").alias("deg"))
    node = p.withColumnRenamed("m", "a").join(own, "i", "left").join(deg, "i", "left").select("i", "a", F.coalesce("wii", F.lit(0.0)).alias("wii"), (F.lit(1.0) if objective == "kmeans" else F.coalesce("deg", F.lit(0.0))).alias("vu"))
    node = node.join(to.withColumnRenamed("m", "a").withColumnRenamed("s", "sa"), ["i", "a"], "left").join(s.select(F.col("m").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("v").alias("va")), "a")
    # the k modules' statistics are one row each
    g = node.crossJoin(F.broadcast(s)).join(to, ["i", "m"], "left")
    sb, sa = F.coalesce("s", F.lit(0.0)), F.coalesce("sa", F.lit(0.0))
    up = F.try_divide(F.col("c") + 2 * sb + F.col("wii"), F.col("v") + F.col("vu")) - F.try_divide("c", "v")
    down = F.try_divide(F.col("ca") - 2 * sa + F.col("wii"), F.col("va") - F.col("vu")) - F.try_divide("ca", "va")
    return g.where("na > 1 and m <> a").select("i", "m", (up + down).alias("gain"))


def blocks(net: Network, px: DataFrame, py: DataFrame, objective: str = "kmeans") -> DataFrame:
    """(mx, my, c): block weights between two partitions over the root of sizes (kmeans) or degrees (spectral)."""
    e = net.edges.join(px.select("i", F.col("m").alias("mx")), "i").join(py.select(F.col("i").alias("j"), F.col("m").alias("my")), "j")
    c = e.groupBy("mx", "my").agg(F.sum("w").alias("c"))
    if objective == "kmeans":
        a, b = px.groupBy(F.col("m").alias("mx")).agg(F.count("*").alias("a")), py.groupBy(F.col("m").alias("my")).agg(F.count("*").alias("b"))
    else:
        a, b = e.groupBy("mx").agg(F.sum("w").alias("a")), e.groupBy("my").agg(F.sum("w").alias("b"))
    return c.join(F.broadcast(a), "mx").join(F.broadcast(b), "my").select("mx", "my", F.try_divide(F.col("c"), F.sqrt(F.col("a") * F.col("b"))).alias("c"))


def co_quality(net: Network, px: DataFrame, py: DataFrame, objective: str = "kmeans") -> DataFrame:
    return blocks(net, px, py, objective).where("mx = my").agg(F.sum("c").alias("q"))
