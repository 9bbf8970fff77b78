"""Exact deduplication as a stream with disk-backed keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsonde.llm.exchange import attach, keyed, shared_folder, stored

STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A store reserves some MB on its executor's disk while it is open; the job is over after a few batches.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
ENTRY = "digest binary, keep struct<missing:boolean,doc_id:long,key:long,n_bytes:long,locator:string>"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def ingest(spark: SparkSession, source: str, state: str, files_per_batch: int = 1000) -> DataFrame:
    """Let a stream take in all new files of entries in `source` and return what its state says of every digest.

    Entries have the columns of ENTRY. State is keyed by digest, lives in RocksDB on the executors' disks with its
    log in `state`, and never expires; for each digest it holds the smallest identifier, where its content lies,
    and the number of rows. A later call with the same `state` goes on where the last one ended.
    """
    before = {k: spark.conf.get(k) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        held = (spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).parquet(source)
                .groupBy("digest").agg(F.min("keep").alias("keep"), F.count("*").alias("size")))

        def save(changed: DataFrame, number: int) -> None:
            changed.write.mode("overwrite").parquet(f"{state}/changes/batch={number}")  # a repeated batch replaces

        (held.writeStream.outputMode("update").option("checkpointLocation", f"{state}/log").foreachBatch(save)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    changes = spark.read.schema(held.schema).parquet(f"{state}/changes")
    return changes.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("size").alias("size"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, per_copy: int = 1000,
                key: str | None = None) -> DataFrame:
    """Group equal texts; of each group the row with the smallest doc_id stays.

    docs has doc_id (integer), text and, if the caller has one, a unique long column named by `key`; other columns
    are not read. Returns one row per document: doc_id, keep_id, group_size, kept, digest, and the key as _row_key.
    Texts are equal when identical after replacing runs of ASCII white space by one space; null counts as empty.

    A stream takes in digest, identifier and locator of every row. Rows that hit a digest already held are then
    compared with the keeper's full bytes; a keeper with many copies is joined in as many parts as it has
    thousands of copies. Should texts with one digest differ, those rows are grouped by their bytes instead.

    Rows that repeat a doc_id count each; of equal texts with the same doc_id one row stays. A null doc_id comes
    after all others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    frame = keyed(docs, key)
    text = normalised(F.col("text"))
    entries = frame.select(
        digest(text).alias("digest"),
        F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").cast("long").alias("doc_id"),
                 F.col("_row_key").alias("key"), F.octet_length(text).cast("long").alias("n_bytes"),
                 F.input_file_name().alias("locator")).alias("keep"))
    entries.write.parquet(f"{folder}/entries")
    rows = spark.read.schema(ENTRY).parquet(f"{folder}/entries")
    if rows.isEmpty():
        groups = spark.createDataFrame([], f"{ENTRY}, size long")
    else:
        groups = stored(ingest(spark, f"{folder}/entries", f"{folder}/state"), "groups")
    groups = groups.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.key").alias("keep_key"), "size")
    found = stored(attach(rows.select("digest", F.col("keep.key").alias("_row_key"), F.col("keep.doc_id").alias("doc_id")),
                          groups, "digest", "size"), "found")

    # full bytes of every hit against its keeper's
    hits = found.filter("size > 1").select("_row_key", "digest", "keep_key", "size")
    texts = hits.join(frame.select("_row_key", text.alias("bytes")), "_row_key")
    parts = F.ceil(F.col("size") / per_copy)
    keepers = (texts.filter("_row_key = keep_key")
               .select("keep_key", F.col("bytes").alias("kept_bytes"),
                       F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part")))
    members = texts.filter("_row_key <> keep_key").withColumn("part", F.pmod(F.xxhash64("_row_key"), parts).cast("int"))
    different = (members.join(keepers, ["keep_key", "part"]).filter("bytes <> kept_bytes")
                 .select("digest").distinct())
    different = stored(different, "different")
    if not different.isEmpty():
        mixed = stored(texts.join(different, "digest", "left_semi").join(found.select("_row_key", "doc_id"), "_row_key")
                       .select("_row_key", "doc_id", "digest", "bytes"), "mixed")
        alike = mixed.groupBy("digest", "bytes").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row_key")).alias("k"), F.count("*").alias("size"))
        apart = mixed.join(alike, ["digest", "bytes"]).select(
            "digest", "_row_key", "doc_id", F.col("k.doc_id").alias("keep_id"), F.col("k._row_key").alias("keep_key"), "size")
        found = found.join(different, "digest", "left_anti").unionByName(apart)
    return found.select("doc_id", "keep_id", F.col("size").alias("group_size"),
                        (F.col("_row_key") == F.col("keep_key")).alias("kept"), "digest", "_row_key")
