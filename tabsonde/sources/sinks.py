"""Writing tables, reports and cached results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsonde.operators.report import ReportConfig, report_tables, sections


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with header, one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json_report(df: DataFrame, path: str, config: ReportConfig | None = None, mode: str = "errorifexists") -> str:
    """One JSON table per report section under `path`."""
    for name, table in sections(df, config).items():
        table.write.mode(mode).json(f"{path}/{name}")
    return path


def write_report(df: DataFrame, path: str, config: ReportConfig | None = None, mode: str = "errorifexists") -> str:
    """The long report table as Parquet, one folder per section."""
    report_tables(df, config).write.mode(mode).partitionBy("part").parquet(path)
    return path


def quick_report(df: DataFrame, path: str) -> str:
    """All sections with default settings."""
    return write_report(df, path)


def detailed_report(df: DataFrame, path: str, config: ReportConfig | None = None) -> str:
    return write_report(df, path, config or ReportConfig(title="Detailed data report"))


def result_key(name: str, df: DataFrame, params: dict | None = None) -> str:
    """A key from the operation, its parameters, the plan and the state of the input files.

    The hash of a plan may differ between sessions; the result is then built again.
    """
    files = sorted(df.inputFiles())
    state = []
    if files:
        found = df.sparkSession.read.format("binaryFile").load(files).select("path", "modificationTime", "length")
        one = F.xxhash64("path", F.unix_micros("modificationTime"), "length").cast("decimal(38,0)")
        state = [str(v) for v in found.agg(F.count(F.lit(1)), F.sum("length"), F.sum(one)).first()]  # one row for all files
    plan = [df.schema.json(), df.semanticHash()]
    text = json.dumps([name, params or {}, plan, state], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def _is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote the folder committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def cached_result(base: str, key: str, spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The result stored under base/key, built and written first if it is absent or incomplete."""
    path = f"{base}/{key}"
    if not _is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
