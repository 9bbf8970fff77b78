"""User functions on pieces of a table (Arrow batches, never single rows)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from tabsonde.operators.grouping import AGGREGATES

Piece = Callable[[pd.DataFrame], pd.DataFrame]
Stream = Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _on_batches(func: Piece, rows: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = rows or max(len(pdf), 1)
            for start in range(0, len(pdf), step):
                yield func(pdf.iloc[start:start + step])
    return run


def apply_chunks(df: DataFrame, func: Piece, schema: str, rows: int = 10_000) -> DataFrame:
    """Apply `func` to chunks of at most `rows` rows; Arrow batches bound the chunk from above
    (spark.sql.execution.arrow.maxRecordsPerBatch)."""
    return df.mapInPandas(_on_batches(func, rows), schema)


def apply_parallel(df: DataFrame, func: Piece, schema: str, pieces: int | None = None) -> DataFrame:
    """Apply `func` to the batches of `pieces` evenly filled partitions."""
    return (df.repartition(pieces) if pieces else df).mapInPandas(_on_batches(func, None), schema)


def apply_grouped(df: DataFrame, by: Sequence[str], partial: Piece, schema: str,
                  combine: dict[str, str]) -> DataFrame:
    """Reduce every batch with `partial`, then combine its rows per key with built-in aggregates.

    Only partial results are shuffled, so a key with most of the rows is no problem; `combine`
    has to be an aggregate of partial results (sum, min, max).
    """
    unfit = {c: f for c, f in combine.items() if f not in ("sum", "min", "max")}
    if unfit:
        raise ValueError(f"partial results combine by sum, min or max, not {unfit}")
    parts = df.mapInPandas(_on_batches(partial, None), schema)
    return parts.groupBy(*by).agg(*[AGGREGATES[f](c).alias(c) for c, f in combine.items()])


def apply_groups(df: DataFrame, by: Sequence[str], func: Piece, schema: str, most: int = 1_000_000) -> DataFrame:
    """Apply any `func` to all rows of each key at once (a null key is a key).

    A group is held by one task, so keys with more than `most` rows are refused after a count, not cut;
    `apply_group_batches` and `apply_grouped` take those.
    """
    largest = df.groupBy(*by).count().agg({"count": "max"}).first()[0] or 0
    if largest > most:
        raise ValueError(f"a group has {largest} rows, more than {most}: use apply_group_batches or apply_grouped")
    return df.groupBy(*by).applyInPandas(func, schema)


def apply_group_batches(df: DataFrame, by: Sequence[str], func: Stream, schema: str, order: Sequence[str] = ()) -> DataFrame:
    """Apply `func(key, batches)` to the rows of each key as they stream by (a null key is a key).

    Batches are Arrow batches (spark.sql.execution.arrow.maxRecordsPerBatch rows at most), in the order of `order` if
    given; `func` yields frames as it goes. A group of any size needs the memory of a batch and of what `func` keeps:
    rows are dealt by key and sorted once by key and order, on disk where they do not fit.
    """
    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from func(key, batches)

    # typed by hand: as text, annotations could not be told apart
    run.__annotations__ = {"key": tuple[Any, ...], "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    rows = df.repartition(*by).sortWithinPartitions(*by, *order)
    return rows.groupBy(*by).applyInPandas(run, schema)
