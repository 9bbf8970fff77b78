"""Windows over ordered series of any length: positions, neighbours and running sums.

A series that fits in one task is windowed as it is. Longer ones are put in ranges of the total order, numbered, and
cut into stretches of equal length; each stretch also receives the rows that its windows reach at both ends, so a lag,
a lead or a centred frame runs per stretch and is exact, and no task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsonde.plans.ordering import BUCKET, add_bucket, running_sums

TOGETHER = 1 << 20  # rows of all series up to which each is windowed in one task
STRETCH = 1 << 16  # rows of a stretch at least; eight times the reach of its windows otherwise
_rows: WeakKeyDictionary = WeakKeyDictionary()


def row_count(df: DataFrame) -> int:
    """Rows of a frame, counted once."""
    if df not in _rows:
        _rows[df] = df.count()
    return _rows[df]


def fits(df: DataFrame) -> bool:
    return row_count(df) <= TOGETHER


def short(df: DataFrame) -> DataFrame:
    """Say that no series of df can be long, as the calendar bounds it."""
    _rows[df] = 0
    return df


def known_rows(df: DataFrame, like: DataFrame) -> DataFrame:
    """Say that df has as many rows as `like`, at most."""
    if like in _rows:
        _rows[df] = _rows[like]
    return df


def _whole(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # TOGETHER rows at most


def numbered(series: DataFrame, by: Sequence[str], order: str, sums: dict[str, tuple[Column, str | None, str | None]] | None = None,
             n: str | None = None) -> DataFrame:
    """Add `pos`, the row's number in its series from 0, the series' length as `n` if named, and for each column of
    `sums` its running total and its total under the two names given (either may be None)."""
    wanted = {"_i": (F.lit(1), "_upto", n), **{f"_{k}": v for k, v in (sums or {}).items()}}
    if fits(series):
        w = _whole(by)
        run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = series.select("*", *[F.sum(e).over(run).alias(name) for e, name, _ in wanted.values() if name],
                            *[F.sum(e).over(w).alias(name) for e, _, name in wanted.values() if name])
    else:
        out = running_sums(add_bucket(series, by, [order]), by, [order], {k: e for k, (e, _, _) in wanted.items()},
                           {k: t for k, (_, _, t) in wanted.items() if t})
        out = out.drop(BUCKET, *[k for k, (_, name, _) in wanted.items() if not name])
        out = out.withColumnsRenamed({k: name for k, (_, name, _) in wanted.items() if name})
    return known_rows(out.withColumn("pos", F.col("_upto").cast("bigint") - 1).drop("_upto"), series)


def framed(rows: DataFrame, by: Sequence[str], reach: int, columns: Callable[[object], dict[str, Column]]) -> DataFrame:
    """Add columns over windows that reach at most `reach` rows to either side. rows carry `pos`; `columns` takes the
    window, ordered by it, and gives the columns by name."""
    if fits(rows):
        return known_rows(rows.withColumns(columns(_whole(by).orderBy("pos"))), rows)
    size = max(STRETCH, 8 * reach)
    place = F.pmod("pos", F.lit(size))
    own = F.floor(F.col("pos") / size)
    halo = F.array_compact(F.array(own, F.when(place < reach, own - 1), F.when(place >= size - reach, own + 1)))
    near = rows.withColumn("_stretch", F.explode(halo))
    w = Window.partitionBy(*by, "_stretch").orderBy("pos")
    out = near.withColumns(columns(w)).where(F.col("_stretch") == own).drop("_stretch")
    return known_rows(out, rows)
