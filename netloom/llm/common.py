"""What the training-data operators share: scratch tables, bounded broadcasts, label folds, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch; long texts make larger batches costly in worker memory.
ARROW_ROWS = 128
#: Most ids that are broadcast (8 bytes each, 16-32 MB as a hashed relation); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset (local tests) a folder of this process."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="netloom-"))
    return _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/netloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends at files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the files of tables made by cut() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(spark, at)


def delete(spark: SparkSession, at: str) -> None:
    """Delete a folder that scratch() named, and no other."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if path.getName().startswith("netloom-"):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches bounded by ARROW_ROWS. The session keeps that setting: Spark reads it when the result is run, after this call."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df.mapInArrow(f, schema)


def _chained(batches, first, then):
    return then(first(batches))


def chain(first: Callable, then: Callable | None) -> Callable:
    """One function for arrow_map from two: a second arrow_map in the same stage would keep a second Python worker for each core."""
    return partial(_chained, first=first, then=then) if then else first


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) alone, whatever else docs has; null text counts as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def sized(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """ids, marked for broadcast if it has at most `limit` rows; else the join shuffles. Count a cut() table only."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids(doc_id). Rows with a null id stay."""
    return docs.join(sized(ids.select(F.col("doc_id").alias(doc_id))), doc_id, "left_anti").select(docs.columns)


def only(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.join(sized(ids.select(F.col("doc_id").alias(doc_id))), doc_id, "left_semi").select(docs.columns)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, n: int, held: int, bound: int) -> DataFrame:
    """At most `bound` labelled rows outside the held-out fold, the first by a hash of the id: (doc_id, text, y, part).

    Labels that are null or not 0/1 are left out; of repeated labels for an id the smallest counts, of repeated rows the least text.
    part is 0..3; the fitters calibrate on part 0 and fit on the rest. The ids are broadcast: `bound` is their size limit.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(fold(F.col("doc_id"), n) != held)
        .groupBy("doc_id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    kept = cut(texts(docs).join(F.broadcast(ids), "doc_id").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)).cast("int")), "training")
    again = kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return kept
    one = cut(kept.groupBy("doc_id", "y", "part").agg(F.min("text").alias("text")).select(kept.columns), "training")
    forget(kept)
    return one
