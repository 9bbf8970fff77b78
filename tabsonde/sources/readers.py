"""Reading tables: CSV with encoding fallback, JSON, Parquet and existing frames."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsonde.operators.columns import detect_date_columns, narrow_types

FALLBACK_ENCODING = "x-windows-949"  # CP949, Korean
READABLE = (".csv", ".json", ".parquet")


def _csv(spark: SparkSession, path: str, schema: T.StructType | None, encoding: str) -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", False)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def is_utf8(spark: SparkSession, path: str) -> bool:
    """False if any line of the file holds bytes that are not UTF-8 (a scan that stops early)."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() == 0


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             encoding: str | None = None) -> DataFrame:
    """CSV with a header in the encoding named. Without one, a scan finds out whether the files are
    UTF-8; if not they are read as CP949.

    Spark reads CP949 only with spark.sql.legacy.javaCharsets=true. Rows are read when a plan runs, so
    the setting is left on; it allows more encodings and changes no other read.
    """
    encoding = encoding or ("UTF-8" if is_utf8(spark, path) else FALLBACK_ENCODING)
    if encoding == FALLBACK_ENCODING:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return _csv(spark, path, schema, encoding)


def read_csv_narrow(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV in input splits, numeric types narrowed over the whole file."""
    return narrow_types(read_csv(spark, path, schema))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              multi_line: bool = False) -> DataFrame:
    """One record per line, or with multi_line one document per file holding an array of records (one
    task per file)."""
    reader = spark.read.option("multiLine", multi_line)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def load(source: DataFrame | str, spark: SparkSession | None = None,
         schema: T.StructType | None = None, encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """A frame as it is, or a path by its extension, with trimmed column names. Unknown or empty input
    raises ValueError."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        raise ValueError("a source is a DataFrame or a path")
    spark = spark or SparkSession.getActiveSession()
    path = source.rstrip("/").lower()
    if not path.endswith(READABLE):
        raise ValueError(f"unsupported file: {source}; readable: {', '.join(READABLE)}")
    if path.endswith(".csv"):
        out = read_csv(spark, source, schema, encoding)
    elif path.endswith(".json"):
        out = read_json(spark, source, schema, multi_line)
    else:
        out = (spark.read.schema(schema) if schema else spark.read).parquet(source)
    return require_rows(trimmed(out))


def trimmed(df: DataFrame) -> DataFrame:
    """Column names without white space around them; names that would then be equal stay as they are."""
    names = [c.strip() for c in df.columns]
    return df.toDF(*[n if names.count(n) == 1 else c for n, c in zip(names, df.columns)])


def require_rows(df: DataFrame) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise ValueError("the table is empty")
    return df


def load_prepared(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """Load, check and turn date-like text into timestamps."""
    return detect_date_columns(load(source, spark))


def cached(df: DataFrame) -> DataFrame:
    """Keep a table that several analyses read; the caller unpersists it."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
