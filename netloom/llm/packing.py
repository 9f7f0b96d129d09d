"""Packing by optimal length buckets.

Lengths (in tokens) are counted over all documents. Dynamic programming over that histogram chooses at most BUCKETS
boundaries that minimise padding: with lengths l_1 < ... < l_m and counts c_i, a bucket (i, j] pads each of its documents to l_j. The
recurrence is solved exactly by divide and conquer (the cost has the Monge property), in O(BUCKETS * m log m).
Inside a bucket documents fill batches of floor(TOKEN_BUDGET / boundary) rows (at least one).

Rows are numbered inside (bucket, slot) with slots by a hash of the id, and slots are laid end to end by their counts, so a bucket
that holds a third of all rows is spread over SLOTS tasks. Only the length histogram (one row for each length) and the slot counts reach the driver.

Lengths are bytes of UTF-8 over BYTES_PER_TOKEN, rounded up, plus one end mark; another length column can be given.

Defined results: null text counts as empty and has length 1; null ids are packed too (in order of the text's hash); repeated rows are each
packed; ties are ordered by id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, texts

BUCKETS, TOKEN_BUDGET, SLOTS, BYTES_PER_TOKEN = 16, 65_536, 256, 4


@dataclass(frozen=True)
class Plan:
    bounds: tuple[int, ...]  # the greatest length of each bucket
    padding: int  # tokens


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> Plan:
    """The boundaries of at most `buckets` buckets with the least padding. lengths rise."""
    m = len(lengths)
    if not m:
        return Plan((), 0)
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    best = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    choice = []
    for _ in range(min(buckets, m)):
        now, arg = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64), np.zeros(m + 1, np.int64)
        stack = [(1, m, 0, m - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (n[j] - n[i]) - (s[j] - s[i])
            k = int(cost.argmin())
            now[j], arg[j] = cost[k], i[k]
            stack += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        choice.append(arg)
        if now[m] >= best[m]:
            choice.pop()
            break
        best = np.minimum(now, np.iinfo(np.int64).max // 4)
    out, j = [], m
    for arg in reversed(choice):
        out.append(int(lengths[j - 1]))
        j = int(arg[j])
    return Plan(tuple(sorted(out)), int(best[m]))


def lengths_of(text: Column) -> Column:
    return (F.ceil(F.octet_length(text) / BYTES_PER_TOKEN) + 1).cast("long")


def plan(rows: DataFrame, buckets: int = BUCKETS) -> Plan:
    """rows(length): from the histogram over all of them."""
    h = rows.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toPandas()
    return boundaries(h.length.to_numpy(np.int64), h.n.to_numpy(np.int64), buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row for each row of docs: doc_id, length, bucket, boundary, batch (in the bucket), place (in the batch), padding."""
    rows = cut(texts(docs).select("doc_id", lengths_of(F.col("text")).alias("length"), F.xxhash64("text").alias("h")), "lengths")
    bounds = plan(rows, buckets).bounds
    if not bounds:
        return rows.select("doc_id", "length", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("boundary"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("padding"))
    edges = F.array(*map(F.lit, bounds))
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda x: x < F.col("length")))).withColumn("slot", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SLOTS)).cast("int"))
    counts = {(r.bucket, r.slot): r.n for r in rows.groupBy("bucket", "slot").agg(F.count("*").alias("n")).collect()}  # at most BUCKETS * SLOTS rows
    start, total = {}, dict.fromkeys(range(len(bounds)), 0)
    for key in sorted(counts):
        start[key] = total[key[0]]
        total[key[0]] += counts[key]
    b, s, n = zip(*((*key, at) for key, at in start.items()))
    # an Arrow table becomes a local relation; a list would go through an RDD, with Python workers of another daemon on each executor
    first = rows.sparkSession.createDataFrame(pa.table({"bucket": pa.array(b, pa.int32()), "slot": pa.array(s, pa.int32()), "first": pa.array(n, pa.int64())}))
    one = F.row_number().over(W.partitionBy("bucket", "slot").orderBy("length", "doc_id", "h"))
    placed = rows.withColumn("at", one - 1).join(F.broadcast(first), ["bucket", "slot"]).withColumn("at", F.col("at") + F.col("first"))
    boundary = F.get(edges, F.col("bucket")).cast("long")
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / boundary)).cast("long")
    return placed.select("doc_id", "length", "bucket", boundary.alias("boundary"), F.floor(F.col("at") / each).cast("long").alias("batch"), (F.col("at") % each).cast("long").alias("place"), (boundary - F.col("length")).alias("padding"))
