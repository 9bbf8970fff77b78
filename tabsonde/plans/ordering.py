"""Global order without a one-partition window.

A window with no PARTITION BY sends the whole table to one task. Here rows are cut
into ranges of the total order (by..., order...) at cut points taken from a random
sample; windows run inside a range, and what crosses a range border travels through
a summary with one row per (by, range). Cut points decide only how evenly the work is
spread: every result is exact for any cut points.

`order` has to identify rows within `by`, so no range can be filled by one value.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
SAMPLE_PER_BUCKET = 24
MAX_BUCKETS = 4096


def bucket_count(df: DataFrame) -> int:
    """Ranges per job: a few per shuffle partition, so they grow with the cluster."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_BUCKETS, 4 * parts))


def sampled_rows(df: DataFrame, rows: int, total: int | None = None) -> DataFrame:
    """About twice `rows` random rows, all rows when there are fewer. `total` saves counting."""
    size = df.agg(F.count(F.lit(1)).alias("n")).scalar() if total is None else F.lit(total)
    return df.where(F.rand(11) * size < F.lit(2.0 * rows))


def _cut_points(df: DataFrame, keys: Sequence[str], buckets: int) -> tuple[str, str, int] | None:
    """The cut points as a JSON text, their schema and their number."""
    picked = sampled_rows(df.select(*keys), buckets * SAMPLE_PER_BUCKET).select(F.struct(*keys).alias("k"))
    row = (picked.agg(F.array_sort(F.collect_set("k")).alias("s"))
           .select(F.filter("s", lambda _, i: (F.pmod(i + 1, F.greatest(
               F.lit(1), F.floor(F.size("s") / buckets).cast("int"))) == 0)).alias("c"))
           .select(F.to_json("c").alias("j"), F.size("c").alias("n")).first())
    if row is None or not row["n"]:
        return None
    ddl = f"array<{picked.schema['k'].dataType.simpleString()}>"
    return row["j"], ddl, row["n"]


def add_bucket(df: DataFrame, by: Sequence[str], order: Sequence[str],
               sample_from: DataFrame | None = None) -> DataFrame:
    """Add the number of the range each row falls in (one small sampling job).

    `sample_from` is a cheaper frame to sample, such as the rows `df` was counted from.
    """
    keys = [*by, *order]
    cuts = _cut_points(df if sample_from is None else sample_from, keys, bucket_count(df))
    if cuts is None:
        return df.withColumn(BUCKET, F.lit(0))
    text, ddl, n = cuts
    if not json.loads(text):
        return df.withColumn(BUCKET, F.lit(0))
    return _search(df, F.struct(*keys), F.from_json(F.lit(text), ddl), n, BUCKET)


def _search(df: DataFrame, key: Column, points: Column, n: int, name: str) -> DataFrame:
    """Add the number of `points` (a sorted literal array of n) that are not above `key`.

    Binary search as one projection per halving: it stays in generated code, which a lambda
    over the array would not, and costs log2(n) comparisons per row.
    """
    out = df.withColumn("_key", key).withColumn(name, F.lit(0))
    for width in [1 << b for b in reversed(range(n.bit_length()))]:
        passed = F.get(points, F.col(name) + (width - 1)) <= F.col("_key")
        out = out.withColumn(name, F.col(name) + F.when(passed, F.lit(width)).otherwise(F.lit(0)))
    return out.drop("_key")


def count_not_above(df: DataFrame, column: str, points: Sequence[float], name: str) -> DataFrame:
    """Add how many of the sorted numbers are at or below a column."""
    if not points:
        return df.withColumn(name, F.lit(0))
    array = F.from_json(F.lit(json.dumps(list(points))), "array<double>")
    return _search(df, F.col(column), array, len(points), name)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on null-safe equality of `keys`, keeping the left copies."""
    renamed = right.select(*[F.col(k).alias(f"_j_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(F.broadcast(renamed), cond, how).drop(*[f"_j_{k}" for k in keys])


def crossing(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keep only keys that lie in several ranges.

    A range is contiguous in (by, order), so it holds at most two keys that go on in
    another range: at most 2 * (ranges + 1) rows remain, which is what makes the
    broadcast safe whatever the number of keys.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return summary.withColumn("_w", F.count(F.lit(1)).over(w)).where("_w > 1").drop("_w")


def _by_window(by: Sequence[str]):
    # Over the summary only: at most ranges + 1 rows per key.
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str],
                 sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running totals along `order` within `by`.

    `df` must carry the range column of `add_bucket(df, by, order)`. `totals` maps the name
    of a sum to the name of a further column with its total per `by` key.
    """
    part = Window.partitionBy(*by, BUCKET)
    w = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names, totals = list(sums), totals or {}
    summary = df.groupBy(*by, BUCKET).agg(*[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()])
    before = _by_window(by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = crossing(summary, by).select(
        *by, BUCKET, *[F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(_by_window(by)).alias(f"_t_{n}") for n in totals])
    rows = df.select("*", *[F.sum(e).over(w).alias(f"_i_{n}") for n, e in sums.items()],
                     *[F.sum(sums[n]).over(whole).alias(f"_w_{n}") for n in totals])
    out = null_safe(rows, offsets, [*by, BUCKET])
    zero = F.lit(0)
    return out.select(
        *df.columns,
        *[(F.coalesce(f"_i_{n}", zero) + F.coalesce(f"_o_{n}", zero)).alias(n) for n in names],
        *[F.coalesce(f"_t_{n}", f"_w_{n}").alias(name) for n, name in totals.items()])


def carry(df: DataFrame, by: Sequence[str], order: Sequence[str],
          values: dict[str, Column], forward: bool) -> DataFrame:
    """Add the nearest non-null value at or before (after) each row along `order`."""
    names = list(values)
    key = F.struct(*order)
    part = Window.partitionBy(*by, BUCKET)
    # Backwards is forwards in descending order: a frame that reaches to the end of the
    # partition would be evaluated anew for every row.
    w = (part.orderBy(*order) if forward else part.orderBy(*[F.desc(o) for o in order])).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    near = {n: F.last(e, ignorenulls=True).over(w) for n, e in values.items()}
    end = F.max_by if forward else F.min_by
    ends = [end(e, F.when(e.isNotNull(), key)).alias(f"_s_{n}") for n, e in values.items()]
    beyond = (_by_window(by).orderBy(BUCKET) if forward else _by_window(by).orderBy(F.desc(BUCKET))).rowsBetween(
        Window.unboundedPreceding, -1)
    summary = crossing(df.groupBy(*by, BUCKET).agg(*ends), by).select(
        *by, BUCKET, *[F.last(f"_s_{n}", ignorenulls=True).over(beyond).alias(f"_o_{n}") for n in names])
    rows = df.select("*", *[e.alias(f"_i_{n}") for n, e in near.items()])
    out = null_safe(rows, summary, [*by, BUCKET])
    return out.select(*df.columns, *[F.coalesce(f"_i_{n}", f"_o_{n}").alias(n) for n in names])


def ranked_frequency(df: DataFrame, value: str, by: Sequence[str] = (),
                     weights: dict[str, Column] | None = None) -> DataFrame:
    """(by, value, n, weights..., upto, n_group): distinct values in order with running counts.

    `upto` counts the rows with a value not above this one, so a value holds the ranks
    upto - n + 1 .. upto and the average rank upto - (n - 1) / 2. `n_group` counts all rows
    of the `by` key. Weights are summed per value next to n.
    """
    present = df.where(F.col(value).isNotNull())
    extra = weights or {}
    freq = present.groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in extra.items()])
    return running_sums(add_bucket(freq, by, [value], sample_from=present), by, [value],
                        {"upto": F.col("n")}, {"upto": "n_group"}).drop(BUCKET)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, tiebreak: Sequence[str],
                  weight: str, rank: str, total: str, sample_from: DataFrame) -> DataFrame:
    """Add the average rank of `value` within `by` to rows that stand for `weight` equal rows.

    Rows are spread over ranges of (by, value, tiebreak), so one value with a third of all
    rows does not meet in one task. A value that lies in several ranges gets its first and
    last rank from a summary of the values at range borders: at most one per border.
    """
    order = [value, *tiebreak]
    df = add_bucket(df, by, order, sample_from)
    w = F.col(weight)
    # One row per (by, range): its size and its first and last value with their sizes.
    summary = (df.groupBy(*by, BUCKET, value).agg(F.sum(w).alias("w")).groupBy(*by, BUCKET)
               .agg(F.sum("w").alias("s"), F.min(F.struct(F.col(value).alias("v"), "w")).alias("a"),
                    F.max(F.struct(F.col(value).alias("v"), "w")).alias("b")))
    before = _by_window(by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    placed = (summary.withColumn("o", F.coalesce(F.sum("s").over(before), F.lit(0)))
              .withColumn("t", F.sum("s").over(_by_window(by))))
    offsets = crossing(placed, by).select(*by, BUCKET, F.col("o").alias("_o"), F.col("t").alias("_t"))
    edges = F.array_distinct(F.array(
        F.struct(F.col("a.v").alias("v"), F.col("o").alias("lo"), (F.col("o") + F.col("a.w")).alias("hi")),
        F.struct(F.col("b.v").alias("v"), (F.col("o") + F.col("s") - F.col("b.w")).alias("lo"),
                 (F.col("o") + F.col("s")).alias("hi"))))
    borders = (placed.select(*by, F.explode(edges).alias("e")).groupBy(*by, F.col("e.v").alias(value))
               .agg(F.count(F.lit(1)).alias("_p"), F.min("e.lo").alias("_glo"), F.max("e.hi").alias("_ghi"))
               .where("_p > 1").drop("_p"))
    part = Window.partitionBy(*by, BUCKET)
    run = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ties = Window.partitionBy(*by, BUCKET, value)
    rows = df.select("*", F.sum(w).over(run).alias("_i"), F.sum(w).over(whole).alias("_w"))
    rows = rows.select("*", F.min(F.col("_i") - w).over(ties).alias("_lo"), F.max("_i").over(ties).alias("_hi"))
    out = null_safe(null_safe(rows, offsets, [*by, BUCKET]), borders, [*by, value])
    shift = F.coalesce("_o", F.lit(0))
    lo, hi = F.coalesce("_glo", F.col("_lo") + shift), F.coalesce("_ghi", F.col("_hi") + shift)
    keep = [c for c in df.columns if c != BUCKET]
    return out.select(*keep, ((lo + hi + 1) / 2).alias(rank), F.coalesce("_t", "_w").alias(total))


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str],
           sizes: DataFrame, hot_share: int = 2000, unmatched: bool = False) -> DataFrame:
    """Join of rows with a table that has one row per key; a null key equals a null key. Rows without
    a partner go, or stay with nulls if `unmatched`.

    `sizes` gives the number of rows `n` of each key. Keys with more than 1 / hot_share of all
    rows number at most hot_share; they are broadcast. The rest is shuffled, and no key of it
    can be large: rows already served by the broadcast are spread by a salt. `rows` occurs once
    in the plan, so plans of several attached columns grow linearly.
    """
    keys = list(keys)
    added = [c for c in table.columns if c not in keys]
    total = sizes.agg(F.sum("n").alias("t")).scalar()
    joined = [F.col(k).alias(f"_j_{k}") for k in keys]
    same = lambda: reduce(and_, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    hot = F.broadcast(sizes.where(F.col("n") * hot_share > total).select(*joined))
    packed = table.select(*keys, F.struct(F.lit(True).alias("_found"), *added).alias("_hot"))
    hot_table = F.broadcast(packed.join(hot, same(), "left_semi").select(*joined, "_hot"))
    names = [f"_j_{k}" for k in keys]
    served = rows.join(hot_table, same(), "left").drop(*names).withColumn(
        "_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.monotonically_increasing_id() % 100003 + 1))
    cold = packed.join(hot, same(), "left_anti").select(*joined, F.lit(0).cast("bigint").alias("_j_salt"),
                                                        F.col("_hot").alias("_cold"))
    both = served.join(cold, same() & (F.col("_salt") == F.col("_j_salt")), "left")
    given = F.coalesce("_hot", "_cold")
    both = both.withColumn("_given", given)
    return ((both if unmatched else both.where(F.col("_given").isNotNull()))
            .select(*rows.columns, *[F.col(f"_given.{c}").alias(c) for c in added]))
