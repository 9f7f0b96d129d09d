"""MinHash near-deduplication by a signature-coordinate inverted join.

Each document is posted under its (coordinate, value) pairs. Documents with Jaccard similarity J agree in about J * K of
K coordinates, so a pair is a candidate when it collides at least MATCHES times. Two rules keep the lists short and lose
no such pair: a pair's value that only one document has is skipped, and of a document's m remaining pairs, in order of
rising frequency, only the first m - MATCHES + 1 are posted (two sets that share MATCHES of their pairs share one of these
prefixes). Candidates are counted on the full signatures and confirmed on the full shingle sets.

Copies with equal shingle sets are one class, its smallest id stands for it; linkage.py finds components without
writing out a list's pairs. K = 64 and MATCHES = 33: at J = 0.75 a pair misses with probability 1.1e-5, above it more rarely.

Defined results: null text counts as empty; documents without words have no shingles, are linked with nothing, and stay;
with fewer than five words the whole sequence is one shingle; rows with a null id take no part, have a null component and stay;
rows with one id are one node, also where their texts differ: what any of them is linked with is one component; ties go to the smallest id; an empty table gives an empty result; extra columns are ignored
by decide() and passed on by keep().
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_map, chain, cut, forget, only, sized, texts, without
from .components import components
from .linkage import SETS, link

COORDINATES, MATCHES = 64, 33


def _signatures(batches):
    a, b = shingles.coefficients(COORDINATES)
    for batch in batches:
        n, key, sig = [], [], []
        for t in batch["text"].to_pylist():
            s = shingles.shingles(t)
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(shingles.signature(s, a, b) if len(s) else None)
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_shingles": pa.array(n, pa.int64()), "key": pa.array(key, pa.binary()), "sig": pa.array(sig, pa.list_(pa.int32()))})


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"id": b["doc_id"], "set": pa.array([shingles.shingles(t).tobytes() for t in b["text"].to_pylist()], pa.binary())})


def posts(classes: DataFrame, least: int = MATCHES) -> DataFrame:
    """(token, id, weight): the prefix of each class's shared coordinate-value pairs; weight is how common its pairs are."""
    tokens = classes.select("id", F.posexplode("sig").alias("at", "v")).select("id", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("v")).alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    mine = tokens.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"), F.sum("n").alias("weight"))
    mine = mine.where(F.size("t") >= least)
    return mine.select("id", "weight", F.explode(F.slice("t", F.lit(1), F.size("t") - least + 1)).alias("p")).select(F.col("p.token").alias("token"), "id", "weight")


def decide(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    return _decide(docs)[0]


def _decide(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What decide() returns, and the tables that it reads."""
    own = texts(docs)
    rows = cut(arrow_map(own, _signatures, "doc_id long, n_shingles long, key binary, sig array<int>"), "signatures")
    classes = cut(rows.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
    posted = cut(posts(classes), "postings")
    sets = lambda ids, then=None, schema=SETS: arrow_map(only(own, ids.select(F.col("id").alias("doc_id"))), chain(_sets, then), schema)
    comp = link(posted, classes.select("id", "sig"), MATCHES, sets)
    of = classes.select("key", "id").join(comp, "id", "left").select("key", F.coalesce("component", "id").alias("class"))
    out = rows.select("doc_id", "n_shingles", "key").join(of, "key", "left")
    # rows with one id are one node, whatever their texts
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component"))
    split = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    split = cut(split, "split-ids")  # ids whose rows have different texts
    used = [rows, classes, comp, split]
    joined = F.col("component")
    if not split.isEmpty():
        every = cut(out.join(split.select("doc_id", "a"), "doc_id").select("a", F.col("component").alias("b")), "id-links")
        over = components(every)
        out = out.join(sized(over.select(F.col("id").alias("component"), F.col("component").alias("over"))), "component", "left")
        joined = F.coalesce("over", "component")
        used += [every, over]
    out = out.select("doc_id", "n_shingles", joined.alias("component_id"), F.coalesce(F.col("doc_id") == joined, F.lit(True)).alias("kept"))
    forget(posted)
    return out, used


def keep(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest id."""
    rows, used = _decide(docs)
    copies = cut(rows.where("not kept").select("doc_id").distinct(), "near-copies")
    forget(*used)
    return without(docs, copies)
