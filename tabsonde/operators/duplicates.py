"""Equal rows (null equals null)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every row that occurs more than once, with `extra_copies` after the first.

    Copies are counted on the map side, so a row that fills a third of the table does not
    travel to one task.
    """
    return (df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("extra_copies"))
            .where(F.col("extra_copies") > 0))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: all rows, distinct rows, rows equal to an earlier one."""
    return (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
            .withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct")))


def drop_duplicates(df: DataFrame, position: str | None = None, keep: str = "first") -> DataFrame:
    """One copy of every row. With a `position` column (a unique row number, not part of
    the comparison) the copy with the first or last position stays."""
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    if position is None:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != position]
    pick = F.min(position) if keep == "first" else F.max(position)
    return df.groupBy(*others).agg(pick.alias(position)).select(*df.columns)


def flag_duplicates(df: DataFrame, position: str) -> DataFrame:
    """The rows equal to an earlier row, found by their unique position."""
    first = drop_duplicates(df, position).select(position)
    return df.join(first, position, "left_anti")


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, matched by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
