"""Pearson, Spearman and Kendall correlation: matrices and tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsonde.functions import ranks
from tabsonde.functions.special import normal_upper_col, t_two_sided_col
from tabsonde.plans.aggregates import pair_sums, pearson
from tabsonde.plans.ordering import BUCKET, add_bucket, attach, bucket_count, crossing, null_safe, ranked_frequency, running_sums
from tabsonde.plans.storage import Scratch
from tabsonde.schema import as_double, numeric_columns, require_numeric, spread

PAIRS_PER_AGGREGATE = 30


def pair_table(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_1, column_2, n, mean_x, mean_y, sxx, syy, sxy) for all pairs of columns.

    Every pair uses the rows where both are present. Many columns without groups go through one scan
    of matrix products; else there is one scan per PAIRS_PER_AGGREGATE pairs.
    """
    pairs = list(combinations(cols, 2))
    if len(pairs) > PAIRS_PER_AGGREGATE and not by:
        return _gram_pairs(df, cols)
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_AGGREGATE):
        aggs, structs = [], []
        for i, (a, b) in enumerate(pairs[start:start + PAIRS_PER_AGGREGATE]):
            fields = [F.lit(a).alias("column_1"), F.lit(b).alias("column_2")]
            for k, e in pair_sums(as_double(a), as_double(b)).items():
                aggs.append(e.alias(f"_{i}_{k}"))
                fields.append(F.col(f"_{i}_{k}").alias(k))
            structs.append(F.struct(*fields))
        wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
        parts.append(spread(wide, structs, by))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _gram_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same sums for all pairs from one scan.

    With 0 for missing values and a matrix P of what is present, P'P counts the rows of each pair, X'P and
    (X*X)'P add up one side over the rows where the other is present, and X'X adds up products. Each partition
    sends one row per pair. Values are taken from a nearby point first, which changes no result but keeps digits.
    """
    p = len(cols)
    near = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(cols)])
    some = near.limit(1000).agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(p)]).first()
    shift = np.array([some[f"c{i}"] or 0.0 for i in range(p)])
    first, second = np.triu_indices(p, 1)
    names = ["column_1", "column_2", "n", "sx", "sy", "qx", "qy", "qxy"]

    def sums(batches):
        total = np.zeros((4, p, p))
        for pdf in batches:
            x = pdf.to_numpy(float)
            present = ~np.isnan(x)
            x, here = np.where(present, x - shift, 0.0), present.astype(float)
            total += [here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x]
        n, s, q, c = total
        yield pd.DataFrame(dict(zip(names, [first, second, n[first, second], s[first, second], s[second, first],
                                            q[first, second], q[second, first], c[first, second]])))

    parts = near.mapInPandas(sums, "column_1 int, column_2 int, n double, sx double, sy double, qx double, qy double, qxy double")
    whole = parts.groupBy("column_1", "column_2").agg(*[F.sum(c).alias(c) for c in names[2:]])
    name = F.array(*[F.lit(c) for c in cols])
    at = F.array(*[F.lit(float(v)) for v in shift])
    i, j, n = F.col("column_1"), F.col("column_2"), F.col("n")
    centred = lambda q, a, b: F.when(n > 0, F.col(q) - F.col(a) * F.col(b) / n)
    return whole.select(
        F.get(name, i).alias("column_1"), F.get(name, j).alias("column_2"), n.cast("bigint").alias("n"),
        (F.get(at, i) + F.try_divide("sx", "n")).alias("mean_x"), (F.get(at, j) + F.try_divide("sy", "n")).alias("mean_y"),
        F.greatest(centred("qx", "sx", "sx"), F.when(n > 0, 0.0)).alias("sxx"),
        F.greatest(centred("qy", "sy", "sy"), F.when(n > 0, 0.0)).alias("syy"), centred("qxy", "sx", "sy").alias("sxy"))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(column_1, column_2, n, r): Pearson for every pair; null where a side is constant."""
    cols = list(cols or numeric_columns(df))
    require_numeric(df, cols)
    return pair_table(df, cols, by).select(
        *by, "column_1", "column_2", "n", pearson(F.col("sxy"), F.col("sxx"), F.col("syy")).alias("r"))


def r_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation under t with n - 2 degrees of freedom."""
    t = F.try_divide(r * F.sqrt(n - 2), F.sqrt(1 - r * r))
    return F.when(n > 2, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided_col(t, n - 2)))


def _pairs(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    return (df.select(*by, as_double(x).alias("_x"), as_double(y).alias("_y"))
            .where(F.col("_x").isNotNull() & F.col("_y").isNotNull()))


def _long_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(_pair, _x, _y): all pairs of columns stacked, so one job serves them all."""
    structs = [F.struct(F.lit(i).alias("_pair"), as_double(a).alias("_x"), as_double(b).alias("_y"))
               for i, (a, b) in enumerate(pairs)]
    return spread(df, structs).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())


def _weighted_r(weighted: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Pearson of two columns with row counts n. The columns are ranks, which sum exactly
    enough in doubles after shifting by half the group size."""
    w = F.col("n")
    s = [F.sum(w).alias("n"), F.sum(w * F.col(x)).alias("sx"), F.sum(w * F.col(y)).alias("sy"),
         F.sum(w * F.col(x) * F.col(x)).alias("sxx"), F.sum(w * F.col(y) * F.col(y)).alias("syy"),
         F.sum(w * F.col(x) * F.col(y)).alias("sxy")]
    g = weighted.groupBy(*by).agg(*s) if by else weighted.agg(*s)
    n = F.col("n")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / n
    return g.where(n > 0).select(*by, "n", pearson(cxy, cxx, cyy).alias("r"))


#: Distinct pairs of values that one task takes in whole; groups with more are ranked by ranges.
TOGETHER = 1 << 19


def _counted(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("n"))


def _by_size(pairs: DataFrame, by: Sequence[str], whole, spread_out) -> DataFrame:
    """`whole` for groups with at most TOGETHER distinct pairs, `spread_out` for the others; both take counted pairs."""
    counted = _counted(pairs, by)
    sizes = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else counted.agg(F.count(F.lit(1)).alias("_n"))
    least, most = sizes.agg(F.min("_n"), F.max("_n")).first()  # two numbers
    if (most or 0) <= TOGETHER:
        return whole(counted, by)
    if least > TOGETHER:
        return spread_out(counted, pairs, by)
    return whole(_of_sizes(counted, sizes.where(F.col("_n") <= TOGETHER), by), by).unionByName(
        spread_out(_of_sizes(counted, sizes.where(F.col("_n") > TOGETHER), by),
                   _of_sizes(pairs, sizes.where(F.col("_n") > TOGETHER), by), by))


def _of_sizes(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [f"_g{i}" for i in range(len(by))]
    keys = groups.select(*[F.col(b).alias(n) for b, n in zip(by, names)])
    return rows.join(keys, reduce(and_, [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names)]), "left_semi")


def _in_one_task(counted: DataFrame, by: Sequence[str], run, fields: str) -> DataFrame:
    """`run(x, y, n) -> values` for the counted pairs of each group, all in one task."""
    schema = T.StructType([*(counted.schema[b] for b in by), *T._parse_datatype_string(fields).fields])
    names = [f.name for f in schema]

    def apply(table: pa.Table) -> pa.Table:
        x, y, n = (table.column(c).to_numpy() for c in ("_x", "_y", "n"))
        return pa.table([*(table.column(b).slice(0, 1) for b in by), *(pa.array([v]) for v in run(x, y, n))], names=names)

    grouped = counted.groupBy(*by) if by else counted.withColumn("_one", F.lit(0)).groupBy("_one")
    return grouped.applyInArrow(apply, schema)


def _spearman(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pearson of average ranks; equal pairs are counted first."""
    return _by_size(pairs, by, _spearman_whole, _spearman_spread)


def _spearman_whole(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    def run(x, y, n):
        u, v = (ranks.average_ranks(c, n) - (n.sum() + 1) / 2 for c in (x, y))
        return int(n.sum()), float((n * u * v).sum()), float((n * u * u).sum()), float((n * v * v).sum())
    got = _in_one_task(counted, by, run, "n bigint, cxy double, cxx double, cyy double")
    return got.select(*by, "n", pearson(F.col("cxy"), F.col("cxx"), F.col("cyy")).alias("r"))


def _spearman_spread(counted: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each margin's frequency table is put in order, and its ranks go back to the pairs by value: pairs are joined,
    never sorted."""
    rows = counted
    for v in ("_x", "_y"):
        table = ranked_frequency(pairs, v, by)
        half = (F.col("n_group") + 1) / 2
        rank = table.select(*by, v, (F.col("upto") - (F.col("n") - 1) / 2 - half).alias(f"{v}_rank"))
        sizes = counted.groupBy(*by, v).agg(F.count(F.lit(1)).alias("n"))
        rows = attach(rows, rank, [*by, v], sizes)
    return _weighted_r(rows.select(*by, "n", F.col("_x_rank").alias("u"), F.col("_y_rank").alias("v")), "u", "v", by)


# ---- Kendall ---------------------------------------------------------------------------

TIES = "s double, n_x bigint, t_x double, c_x double, d_x double, t_y double, c_y double, d_y double"


def _kendall_whole(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, s, n_x, ties of both margins) of groups that one task takes in."""
    def run(x, y, n):
        return ranks.kendall_sum(x, y, n), int(n.sum()), *ranks.tie_sums(x, n), *ranks.tie_sums(y, n)
    return _in_one_task(counted, by, run, TIES)


def _kendall_spread(counted: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same for groups of any size."""
    n = F.col("n").cast("double")

    def margin(v: str) -> DataFrame:
        g = counted.groupBy(*by, v).agg(F.sum("n").alias("n"))
        aggs = [F.sum(n * (n - 1) / 2).alias(f"t{v}"), F.sum(n * (n - 1) * (n - 2)).alias(f"c{v}"),
                F.sum(n * (n - 1) * (2 * n + 5)).alias(f"d{v}"), *([F.sum("n").alias("n_x")] if v == "_x" else [])]
        return g.groupBy(*by).agg(*aggs) if by else g.agg(*aggs)

    mx, my, s = margin("_x"), margin("_y"), _kendall_s(counted, by)
    if not by:
        return mx.crossJoin(my).crossJoin(s)  # one row each
    for other in (my, s):
        names = [f"_k{i}" for i in range(len(by))]
        right = other.select(*[F.col(b).alias(k) for b, k in zip(by, names)], *[c for c in other.columns if c not in by])
        mx = mx.join(right, reduce(and_, [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, names)])).drop(*names)
    return mx


def _kendall_s(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, s): concordant minus discordant pairs of weighted points, pairs tied on either side left out.

    Dense ranks of y have at most seven digits of base 32 below 2**35 values, so a point makes at most seven rows, one
    for each digit. Rows of a digit that agree in all higher digits form a block; in the order (digit, block, x) they
    are cut into ranges, and each range runs through its rows with a vector of 32 counts (see functions.ranks). A
    block that began in an earlier range finds its counts so far in a summary of the ranges' borders.
    """
    values = counted.select(*by, "_y").distinct()
    table = ranked_frequency(values, "_y", by).select(*by, "_y", (F.col("upto") - 1).cast("bigint").alias("_rank"))
    sizes = counted.groupBy(*by, "_y").agg(F.count(F.lit(1)).alias("n"))
    ranked = attach(counted, table, [*by, "_y"], sizes)
    last = ranks.levels(table.agg(F.max("_rank")).first()[0] or 0) - 1
    shift = lambda places: F.call_function("shiftright", F.col("_rank"), places)
    each = (ranked.select(*by, "_x", "n", "_rank", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("_level"))
            .select(*by, "_level", shift((F.col("_level") + 1) * ranks.BITS).alias("_block"), "_x",
                    (shift(F.col("_level") * ranks.BITS) % ranks.BASE).cast("int").alias("_digit"), "n"))
    keys = [*by, "_level", "_block"]
    placed = add_bucket(each, keys, ["_x", "_digit"])
    # what each block holds ahead of a range, by digit; blocks that lie in one range need nothing
    per_digit = placed.groupBy(*keys, BUCKET, "_digit").agg(F.sum("n").alias("n"))
    cells = per_digit.groupBy(*keys, BUCKET).agg(F.map_from_entries(F.collect_list(F.struct("_digit", "n"))).alias("_m"))
    run = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    ahead = crossing(cells, keys).select(*keys, BUCKET, F.array(*[
        F.coalesce(F.sum(F.coalesce(F.col("_m")[g], F.lit(0))).over(run), F.lit(0)).cast("double")
        for g in range(ranks.BASE)]).alias("_before"))
    # Equal x of a block may be cut by a border; what is tied ahead of the range is not earlier.
    border = placed.groupBy(*keys, BUCKET).agg(F.min("_x").alias("_first"), F.max("_x").alias("_x"))
    starts = null_safe(border.select(*keys, BUCKET, "_first"), ahead, [*keys, BUCKET], "inner")
    tied = (placed.join(F.broadcast(starts.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)],
                                                  F.col(BUCKET).alias("_tb"), F.col("_first").alias("_tx"))),
                        reduce(and_, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)])
                        & (F.col("_x") == F.col("_tx")) & (F.col(BUCKET) < F.col("_tb")))
            .groupBy(*keys, F.col("_tb").alias(BUCKET), "_digit").agg(F.sum("n").alias("n"))
            .groupBy(*keys, BUCKET).agg(F.map_from_entries(F.collect_list(F.struct("_digit", "n"))).alias("_tm")))
    ties = tied.select(*keys, BUCKET, F.array(*[F.coalesce(F.col("_tm")[g], F.lit(0)).cast("double")
                                                for g in range(ranks.BASE)]).alias("_tied"))
    rows = null_safe(null_safe(placed, ahead, [*keys, BUCKET]), ties, [*keys, BUCKET])
    parts = bucket_count(placed)
    rows = rows.repartition(parts, BUCKET).sortWithinPartitions(BUCKET, *keys, "_x")
    schema = T.StructType([*(counted.schema[b] for b in by), T.StructField("s", T.DoubleType())])

    def sums(batches):
        state = None  # last key and x, counts ahead of the next row, those of them tied with the last x
        for batch in batches:
            columns = [pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy().astype(np.int64)
                       for c in [BUCKET, *keys]]
            x, digit, n = (batch.column(c).to_numpy() for c in ("_x", "_digit", "n"))
            start = ranks.runs(*columns)
            out = []
            for a, b in zip(start, np.append(start[1:], batch.num_rows)):
                key = tuple(batch.column(c)[a].as_py() for c in [BUCKET, *keys])
                if state is not None and state[0] == key:
                    _, at, before, held = state
                    held = held if at == x[a] else None
                else:
                    before, held = (np.array(v) if (v := batch.column(c)[a].as_py()) is not None else None
                                    for c in ("_before", "_tied"))
                block = np.zeros(b - a, np.int64)
                s, before, held = ranks.signs(block, x[a:b], digit[a:b], n[a:b], before, held)
                state = (key, x[b - 1], before, held)
                out.append((a, s))
            first = pa.array([a for a, _ in out])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in by), pa.array([s for _, s in out])],
                                             names=[*by, "s"])

    whole = rows.mapInArrow(sums, schema)
    total = F.sum("s").alias("s")
    return whole.groupBy(*by).agg(total) if by else whole.agg(total)


def _kendall(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, r, z): tau-b and its normal approximation with tie correction."""
    found = _by_size(pairs, by, _kendall_whole, _kendall_spread)
    m = F.col("n_x").cast("double")
    pairs_all = m * (m - 1) / 2
    tau = F.try_divide(F.col("s"), F.sqrt(pairs_all - F.col("t_x")) * F.sqrt(pairs_all - F.col("t_y")))
    var = ((m * (m - 1) * (2 * m + 5) - F.col("d_x") - F.col("d_y")) / 18
           + F.coalesce(F.try_divide(F.col("c_x") * F.col("c_y"), 9 * m * (m - 1) * (m - 2)), F.lit(0.0))
           + F.coalesce(F.try_divide(F.lit(2.0) * F.col("t_x") * F.col("t_y"), m * (m - 1)), F.lit(0.0)))
    return found.select(*by, F.col("n_x").alias("n"), tau.alias("r"), F.try_divide(F.col("s"), F.sqrt(var)).alias("z"))


def correlation_test(df: DataFrame, x: str, y: str, method: str = "pearson",
                     by: Sequence[str] = ()) -> DataFrame:
    """(by, method, n, correlation, p_value) over rows where both columns are present.

    Kendall's p is the normal approximation with tie correction.
    """
    require_numeric(df, [x, y])
    by = list(by)
    if method == "pearson":
        got = pair_table(df.select(*by, x, y), [x, y], by).select(
            *by, "n", pearson(F.col("sxy"), F.col("sxx"), F.col("syy")).alias("r"))
    elif method == "spearman":
        got = _spearman(_pairs(df, x, y, by), by)
    elif method == "kendall":
        got = _kendall(_pairs(df, x, y, by), by)
        return got.select(*by, F.lit(method).alias("method"), "n", F.col("r").alias("correlation"),
                          (2 * normal_upper_col(F.abs("z"))).alias("p_value"))
    else:
        raise ValueError(f"unknown method: {method}")
    return got.select(*by, F.lit(method).alias("method"), "n", F.col("r").alias("correlation"),
                      r_p_value(F.col("r"), F.col("n")).alias("p_value"))


#: Distinct values of a column whose ranks are broadcast to all rows.
FEW_VALUES = 1 << 16


def _spearman_complete(df: DataFrame, cols: Sequence[str], use: Sequence[int]) -> dict[tuple[int, int], tuple[int, float | None]]:
    """{(i, j): (n, r)} for pairs of the columns `use`, which miss no value, so a column's ranks are the same in all its
    pairs. Pairs of two columns with more than FEW_VALUES distinct values are left out.

    One frequency table of all columns gives the ranks. Those of columns with few values are broadcast to the rows. For a
    column with many, rows are first added up by its values, and its ranks join those sums: no row is shuffled more than
    once a column, however many pairs there are.
    """
    scratch = Scratch(df.sparkSession)
    cells = spread(df, [F.struct(F.lit(i).alias("_c"), as_double(cols[i]).alias("_v")) for i in use])
    counted = scratch.keep(cells.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("n")), "counted")
    placed = running_sums(add_bucket(counted, ["_c"], ["_v"]), ["_c"], ["_v"], {"upto": F.col("n")}, {"upto": "n_group"})
    rank = F.col("upto") - (F.col("n") - 1) / 2 - (F.col("n_group") + 1) / 2
    table = scratch.keep(placed.select("_c", "_v", "n", rank.alias("rank")), "ranks")
    scratch.drop("counted")
    facts = {r["_c"]: r for r in table.groupBy("_c").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"), F.sum(
        F.col("n") * F.col("rank") * F.col("rank")).alias("square")).collect()}  # one row a column
    few = [i for i in use if facts[i]["values"] <= FEW_VALUES]
    rows = df.select(*[as_double(cols[i]).alias(f"_v{i}") for i in use])
    for i in few:
        own = table.where(F.col("_c") == i).select(F.col("_v").alias("_at"), F.col("rank").alias(f"_r{i}"))
        rows = rows.join(F.broadcast(own), F.col(f"_v{i}") == F.col("_at")).drop("_at")
    products: dict[tuple[int, int], float] = {}
    pairs = list(combinations(few, 2))
    for start in range(0, len(pairs), PAIRS_PER_AGGREGATE):
        some = pairs[start:start + PAIRS_PER_AGGREGATE]
        products |= zip(some, rows.agg(*[F.sum(F.col(f"_r{i}") * F.col(f"_r{j}")) for i, j in some]).first())
    for i in (i for i in use if i not in few and few):
        sums = rows.groupBy(f"_v{i}").agg(*[F.sum(f"_r{j}").alias(f"_s{j}") for j in few])
        own = table.where(F.col("_c") == i).select(F.col("_v").alias("_at"), "rank")
        both = sums.join(own.hint("merge"), F.col(f"_v{i}") == F.col("_at"))
        products |= zip([(min(i, j), max(i, j)) for j in few], both.agg(*[F.sum(F.col("rank") * F.col(f"_s{j}")) for j in few]).first())
    scratch.drop("ranks")
    size = {i: math.sqrt(facts[i]["square"]) for i in use}
    return {(i, j): (facts[i]["n"], v / (size[i] * size[j]) if size[i] * size[j] else None) for (i, j), v in products.items()}


def rank_correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None,
                            method: str = "spearman") -> DataFrame:
    """(column_1, column_2, n, r) for every pair, ranked over the rows where both are present."""
    cols = list(cols or numeric_columns(df))
    require_numeric(df, cols)
    pairs = list(combinations(range(len(cols)), 2))
    found: dict[tuple[int, int], tuple[int, float | None]] = {}
    if method == "spearman" and pairs:
        total, *present = df.agg(F.count(F.lit(1)), *[F.count(as_double(c)) for c in cols]).first()
        complete = [i for i, n in enumerate(present) if n == total]
        if total and len(complete) > 1:
            found = _spearman_complete(df, cols, complete)
    rest = [(cols[i], cols[j]) for i, j in pairs if (i, j) not in found]
    done = [(cols[i], cols[j], *found[i, j]) for i, j in pairs if (i, j) in found]
    done = df.sparkSession.createDataFrame(done, "column_1 string, column_2 string, n bigint, r double") if done else None
    if done is not None and not rest:
        return done
    fn = {"spearman": _spearman, "kendall": _kendall}[method]
    first, second = (F.array(*[F.lit(p[i]) for p in rest]) for i in (0, 1))
    got = fn(_long_pairs(df, rest), ["_pair"]).select(
        F.get(first, F.col("_pair")).alias("column_1"), F.get(second, F.col("_pair")).alias("column_2"), "n", "r")
    return got if done is None else done.unionByName(got)
