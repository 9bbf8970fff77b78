"""Spreading small inputs over all cores before costly work per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTES_PER_CORE = 128 * 1024 * 1024


def widen(df: DataFrame) -> DataFrame:
    """Rebalance a table whose files are too few and too small to occupy every core.

    A Parquet row group is read by one task, so a small table keeps one core busy. Anything
    above BYTES_PER_CORE per core is left as it is: its splits already fill the cluster, and
    shuffling it would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    size = (df.sparkSession.read.format("binaryFile").load(files).select("length")
            .agg(F.sum("length")).first()[0])
    return df.repartition(cores) if size is not None and size < cores * BYTES_PER_CORE else df
