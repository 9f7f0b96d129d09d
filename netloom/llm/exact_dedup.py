"""Exact deduplication by stateful streaming.

Texts are equal when they are identical after each run of [\\x20\\x09-\\x0D] is replaced by one space. A Structured
Streaming aggregation keyed by the SHA-256 of the normalised text keeps its state on disk (RocksDB, no watermark, so
nothing expires): digest, stable identifier (smallest doc_id), count, and content locator (input file and block offset).
The state is then read back as a table. On hits, that is digests seen more than once, the full bytes are compared;
rows of one digest with different bytes (a collision) are regrouped by the bytes themselves.

Only the texts of hits are shuffled. The bytes of a digest's rows are all equal exactly when their least and greatest are, and both
aggregate on the map side, so a group of any size crosses the shuffle as one row for each task. Beyond BROADCAST_HITS hits the texts meet
the digests of hits in a shuffled join. RocksDB's pre-allocation of files is off: with many small state partitions it takes more disk than the state.

Only DataFrame and SQL functions run on executors.

Defined results: null text counts as empty; rows with a null id come after all ids, and stay only where their whole
group has none; repeated rows of one id and text count in group_size and stay or go together; rows of one id with different texts are
decided each by its text; an empty table gives an empty result; extra columns are ignored by decide() and passed on by keep().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, forget, scratch, sized, texts

#: Files that one micro-batch takes, so that a batch stays bounded whatever the corpus.
FILES_PER_BATCH = 1024
#: Most digests of hits (about 100 bytes each) and most ids with rows to drop that are broadcast; beyond it the join shuffles.
BROADCAST_HITS = 200_000
STORE = "spark.sql.streaming.stateStore"
#: State on disk; no file is pre-allocated (4 MB for each manifest, held while a partition's store is open).
SETTINGS = {f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{STORE}.rocksdb.allowFAllocate": "false"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _groups(rows: DataFrame, files_per_batch: int) -> DataFrame:
    """(digest, keep_id, n, locator), a table, from the state of a stream over rows(doc_id, digest, locator), made by cut()."""
    spark = rows.sparkSession
    at = scratch(spark, "state")
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = (
            spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
            .groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "locator")).alias("first"), F.count("*").alias("n"))
        )
        stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").load(at)
        first = state.schema["value"].dataType.names
        groups = cut(state.select(F.col("key.digest").alias("digest"), F.col(f"value.{first[0]}.doc_id").alias("keep_id"), F.col(f"value.{first[0]}.locator").alias("locator"), F.col(f"value.{first[1]}").alias("n")), "groups")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    delete(spark, at)
    return groups


def decide(docs: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, locator (of the row that stays)."""
    return _decide(docs, files_per_batch)[0]


def _decide(docs: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> tuple[DataFrame, list[DataFrame]]:
    """What decide() returns, and the tables that it reads."""
    spark = docs.sparkSession
    rows = texts(docs).select("doc_id", normalised(F.col("text")).alias("norm"), F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("offset")).alias("locator"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    staged = cut(rows.select("doc_id", "digest", "locator"), "digests")
    state = _groups(staged, files_per_batch) if staged.inputFiles() and not staged.isEmpty() else spark.createDataFrame([], "digest binary, keep_id long, locator struct<file:string,offset:long>, n long")
    hits = cut(state.where("n > 1").select("digest"), "hits")
    again = rows.join(sized(hits, BROADCAST_HITS), "digest", "left_semi")
    differ = cut(again.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("digest"), "collisions")
    forget(hits)
    hex_ = F.lower(F.hex("digest")).alias("text_sha256")
    out = staged.select("doc_id", "digest").join(state, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), hex_, "locator", "digest"
    )
    if differ.isEmpty():
        forget(differ)
        return out.drop("digest"), [staged, state]
    # Collided digests: their rows group by the bytes.
    whole = rows.join(differ, "digest", "left_semi")
    group = whole.groupBy("digest", "norm").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "locator")).alias("first"), F.count("*").alias("group_size"))
    split = whole.select("doc_id", "digest", "norm").join(group, ["digest", "norm"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.col("first.doc_id").isNull()).alias("kept"), hex_, F.col("first.locator").alias("locator")
    )
    return out.join(differ, "digest", "left_anti").drop("digest").unionByName(split), [staged, state, differ]


def keep(docs: DataFrame) -> DataFrame:
    """docs without the copies; each text's row with the smallest doc_id stays.

    A row goes if its id and digest are among those to drop. Only rows whose id has any are hashed again.
    """
    rows, used = _decide(docs)
    drop = rows.where("not kept").groupBy(F.col("doc_id").alias("_drop")).agg(F.collect_set("text_sha256").alias("_shas"))  # as many digests as the id has texts
    drop = cut(drop, "copies")
    forget(*used)
    sha = F.sha2(normalised(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"), 256)
    out = docs.join(sized(drop, BROADCAST_HITS), F.col("doc_id").cast("long").eqNullSafe(F.col("_drop")), "left")
    return out.where(F.col("_shas").isNull() | ~F.array_contains("_shas", sha)).select(docs.columns)
