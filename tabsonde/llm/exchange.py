"""What the operators share with Spark: scratch tables, row keys, sizes of blocks, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place all executors share: spark.checkpoint.dir. Where that is unset and all runs on this
    machine, a local one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tabsonde-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}")
    return _made[-1]


_made: list[str] = []


def scratch() -> int:
    """A mark for release(): how many folders have been made so far."""
    return len(_made)


def release(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Remove the folders made since the mark, but for those that `keep` reads. Nothing may need them any more."""
    files = keep.inputFiles()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in _made[mark:]:
        if not any(folder.split(":", 1)[-1].lstrip("/") in f for f in files):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    _made[mark:] = [f for f in _made[mark:] if any(f.split(":", 1)[-1].lstrip("/") in x for x in files)]


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows written to the shared folder and read back: computed once, and safe if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks_for(df: DataFrame, block_mb: int = 12) -> int:
    """How many blocks of about block_mb the rows make, by Spark's own size estimate; shuffle partitions at least."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Estimates of non-file inputs can be far too high; a million blocks of 12 MB are 12 TB of Parquet.
    return max(least, min(1_000_000, -(-size // (block_mb << 20))))


KEY = "_row_key"


def keyed(docs: DataFrame, key: str | None = None, **more) -> DataFrame:
    """KEY, doc_id and text of every row, and the columns given by name in `more`. Nothing else of docs remains, so
    no column of it can clash. KEY is a unique long: the column `key` where the caller has made one, else doc_id
    where that is unique and never null, else numbers given to a stored copy of the rows."""
    wanted = docs.select("doc_id", "text", *([F.col(key).alias(KEY)] if key else []), *(c.alias(n) for n, c in more.items()))
    if key:
        return wanted
    again = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1)
    if isinstance(docs.schema["doc_id"].dataType, (T.LongType, T.IntegerType)) and not again.take(1):
        return wanted.withColumn(KEY, F.col("doc_id").cast("long"))
    return stored(wanted.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def carried(docs: DataFrame, carry: list[str] | None, results: list[str]) -> tuple[list[str], dict]:
    """Columns to carry along other than doc_id and text, and what keyed() takes for them, under names of their own.
    A column named like a result cannot come along."""
    carry = [c for c in dict.fromkeys(carry or []) if c not in ("doc_id", "text")]
    if clash := sorted(set(carry) & set(results)):
        raise ValueError(f"columns named like results cannot be carried: {clash}")
    return carry, {f"_c{i}": docs[f"`{c}`"] for i, c in enumerate(carry)}


def with_fields(ddl: str, frame: DataFrame, names: dict[str, str]) -> T.StructType:
    """The columns of `ddl`, after doc_id and before the columns `names` of frame, under their new names."""
    fields = T._parse_datatype_string(ddl).fields
    return T.StructType([T.StructField("doc_id", frame.schema["doc_id"].dataType), *fields,
                         *(T.StructField(new, frame.schema[old].dataType) for old, new in names.items())])


def block_of(key: str, n: int):
    """Block number of a long key; blocks_of gives the same in Python."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % n).cast("int")


def blocks_of(keys, n: int):
    import zlib
    return [zlib.crc32(str(k).encode()) % n for k in keys]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), itself included.

    Alternating large-star and small-star rounds: each hangs a node's neighbours on the smallest one, so rounds
    grow with the logarithm of a component's size. A round counts and aggregates; no group is collected.
    """
    spark = nodes.sparkSession
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u <> v").distinct(), "links")
    before = None
    while True:
        # large star: neighbours above u go to the smallest of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # small star: u and its smaller neighbours go to the smallest of them
        large = stored(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        links = stored(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    roots = links.groupBy("u").agg(F.min("v").alias("m"))
    return (nodes.select("id").join(roots, nodes["id"] == roots["u"], "left")
            .select("id", F.coalesce("m", "id").alias("component")))


def attach(rows: DataFrame, groups: DataFrame, on: str, size: str) -> DataFrame:
    """Each row with its group (one row per value of `on`, with its number of rows in `size`). Groups above a
    thousandth of all rows, so at most 1000, are broadcast; the rest is joined by shuffling."""
    large = max(2, rows.count() // 1000)
    hot = F.broadcast(groups.filter(F.col(size) > large))
    rest = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(groups.filter(F.col(size) <= large), on))
