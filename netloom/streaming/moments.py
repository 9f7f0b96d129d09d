"""Degrees over a stream of edges: sums merge, so each batch only adds to the state. An extension: the operators are the same as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame, by: str = "i") -> DataFrame:
    """Streaming (by, first, second, n) of edges(i, j, w)."""
    return edges.groupBy(by).agg(F.sum("w").alias("first"), F.sum(F.col("w") * F.col("w")).alias("second"), F.count("*").alias("n"))


def windowed_degrees(edges: DataFrame, ts: str = "ts", window: str = "1 day", late: str = "1 hour", by: str = "i") -> DataFrame:
    """The same in tumbling windows with a watermark, so that old windows leave the state."""
    return edges.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.sum("w").alias("first"), F.sum(F.col("w") * F.col("w")).alias("second"))
