"""Exact quantiles by sampling a bracket and counting.

`percentile` keeps every distinct value of a column in one task. Here a small sample
gives a narrow interval around each wanted rank, one scan counts what lies below and
inside it, and only the inside is sorted. If the rank falls outside (the sample was
unlucky) the interval moves to the side that holds it; if too much lies inside, it is
split by equal-width bins until it is small. The answer is exact in every case.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsonde.plans.aggregates import unpivot_values
from tabsonde.plans.ordering import ranked_frequency, sampled_rows
from tabsonde.schema import as_double

SAMPLE = 8192
INSIDE_LIMIT = 2_000_000
BINS = 1024
MAX_ROUNDS = 40


class _Target:
    """One wanted (column, probability) and the interval known to hold it."""

    def __init__(self, column: str, p: float, n: int, lo: float, hi: float):
        self.column, self.p, self.n = column, p, n
        position = p * (n - 1)
        self.first = int(math.floor(position))
        self.last = min(self.first + 1, n - 1)
        self.fraction = position - self.first
        self.lo, self.hi = lo, hi
        self.below = self.inside = 0

    def holds(self) -> bool:
        return self.below <= self.first and self.last < self.below + self.inside


def _count(df: DataFrame, targets: list[_Target]) -> None:
    aggs = []
    for i, t in enumerate(targets):
        v = as_double(t.column)
        aggs += [F.count_if(v < t.lo).alias(f"b{i}"), F.count_if(v.between(t.lo, t.hi)).alias(f"i{i}")]
    row = df.agg(*aggs).first()
    for i, t in enumerate(targets):
        t.below, t.inside = row[f"b{i}"], row[f"i{i}"]


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """Shrink every interval to the equal-width bins that hold the wanted ranks."""
    cells = []
    for i, t in enumerate(targets):
        v = as_double(t.column)
        share = (v - t.lo) / (t.hi - t.lo)
        b = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        cells.append(F.when(v.between(t.lo, t.hi),
                            F.struct(F.lit(i).alias("t"), b.alias("b"), v.alias("v"))))
    counted = (df.select(F.explode_outer(F.array(*cells)).alias("c")).where("c IS NOT NULL")
               .groupBy("c.t", "c.b").agg(F.count(F.lit(1)).alias("n"), F.min("c.v").alias("lo"),
                                          F.max("c.v").alias("hi"))
               .orderBy("t", "b").collect())  # at most BINS rows per target
    for i, t in enumerate(targets):
        seen, keep, below = t.below, [], None
        for r in (r for r in counted if r["t"] == i):
            if seen + r["n"] > t.first and seen <= t.last:
                below = seen if below is None else below
                keep.append(r)
            seen += r["n"]
        t.lo, t.hi = keep[0]["lo"], keep[-1]["hi"]
        t.below, t.inside = below, sum(r["n"] for r in keep)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]
                     ) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated quantiles of whole columns: {(column, p): value}.

    Null and NaN are ignored; a column without values gives None.
    """
    cols, probs = list(cols), list(probs)
    df = df.select(*cols)
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[e for i, c in enumerate(cols) for e in (
        F.count(as_double(c)).alias(f"n{i}"), F.min(as_double(c)).alias(f"lo{i}"),
        F.max(as_double(c)).alias(f"hi{i}"))]).first()
    sample = sampled_rows(df.select(*[as_double(c).alias(c) for c in cols]), SAMPLE, facts["rows"]).toPandas()
    out: dict[tuple[str, float], float | None] = {}
    targets: list[_Target] = []
    for i, c in enumerate(cols):
        n, low, high = facts[f"n{i}"], facts[f"lo{i}"], facts[f"hi{i}"]
        s = sample[c].dropna().sort_values().to_numpy()
        for p in probs:
            if not n:
                out[c, p] = None
                continue
            t = _Target(c, p, n, low, high)
            slack = 5 * math.sqrt(len(s) * p * (1 - p)) + 4
            a, b = int(p * len(s) - slack), int(p * len(s) + slack)
            if a >= 0 and len(s):
                t.lo = float(s[a])
            if b < len(s):
                t.hi = float(s[b])
            targets.append(t)
    if targets:
        _count(df, targets)
    for t in targets:
        if not t.holds():
            i = cols.index(t.column)
            t.lo, t.hi, t.below, t.inside = facts[f"lo{i}"], facts[f"hi{i}"], 0, t.n
    for _ in range(MAX_ROUNDS):
        wide = [t for t in targets if t.inside > INSIDE_LIMIT and t.lo < t.hi]
        if not wide:
            break
        before = [t.inside for t in wide]
        _narrow(df, wide)
        if before == [t.inside for t in wide]:
            break
    open_targets = [t for t in targets if t.lo < t.hi]
    for t in targets:
        if t.lo == t.hi:
            out[t.column, t.p] = t.lo
    if open_targets:
        # Values are counted once per column; then each finds the intervals it lies in.
        names = sorted({t.column for t in open_targets})
        wanted = {c: [(i, t) for i, t in enumerate(open_targets) if t.column == c] for c in names}

        def inside(c: str):
            v = as_double(c)
            hit = F.lit(False)
            for _, t in wanted[c]:
                hit = hit | v.between(t.lo, t.hi)
            return F.when(hit, F.struct(F.lit(names.index(c)).alias("c"), v.alias("v")))

        counted = (df.select(F.explode_outer(F.array(*[inside(c) for c in names])).alias("x")).where("x IS NOT NULL")
                   .groupBy(F.col("x.c").alias("c"), F.col("x.v").alias("v")).agg(F.count(F.lit(1)).alias("n")))
        ids = [F.when((F.col("c") == names.index(c)) & F.col("v").between(t.lo, t.hi), F.lit(i))
               for c in names for i, t in wanted[c]]
        freq = counted.select("v", "n", F.explode_outer(F.array(*ids)).alias("t")).where("t IS NOT NULL")
        upto = F.sum("n").over(Window.partitionBy("t").orderBy("v"))
        bounds = F.create_map(*[x for i, t in enumerate(open_targets) for x in (
            F.lit(i), F.struct(F.lit(t.first - t.below).alias("a"), F.lit(t.last - t.below).alias("b")))])
        picked = (freq.withColumn("upto", upto).withColumn("w", F.element_at(bounds, F.col("t")))
                  .groupBy("t").agg(
                      F.min(F.when(F.col("upto") > F.col("w.a"), F.col("v"))).alias("x"),
                      F.min(F.when(F.col("upto") > F.col("w.b"), F.col("v"))).alias("y")))
        for r in picked.collect():  # one row per (column, probability)
            t = open_targets[r["t"]]
            out[t.column, t.p] = r["x"] + (r["y"] - r["x"]) * t.fraction
    return out


def few_groups(df: DataFrame, by: Sequence[str], limit: int = 40) -> list | None:
    """The distinct keys if there are at most `limit`, else None."""
    rows = df.select(*by).distinct().limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def grouped_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str],
                      probs: dict[str, float]) -> DataFrame:
    """(by, column_name, <one column per named probability>), exact, for any number of groups.

    Few groups are treated as columns of their own, which shuffles next to nothing. Otherwise
    values are counted per group and ranked by ranges of (group, value), so a group with a
    third of all rows is spread over many tasks.
    """
    groups = few_groups(df, by)
    if groups is None:
        return _ranked_quantiles(df, by, cols, probs)
    split, where = {}, {}
    for g, key in enumerate(groups):
        match = F.lit(True)
        for k in by:
            match = match & F.col(k).eqNullSafe(F.lit(key[k]))
        for c in cols:
            name = f"_g{g}_{len(split)}"
            split[name] = F.when(match, as_double(c)).alias(name)
            where[name] = (key, c)
    got = column_quantiles(df.select(*split.values()), list(split), list(probs.values()))
    rows = [(*[key[k] for k in by], c, *[got[name, p] for p in probs.values()])
            for name, (key, c) in where.items() if got[name, next(iter(probs.values()))] is not None]
    schema = T.StructType([df.schema[k] for k in by] + [T.StructField("column_name", T.StringType())]
                          + [T.StructField(p, T.DoubleType()) for p in probs])
    return df.sparkSession.createDataFrame(rows, schema)


def _ranked_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    keys = [*by, "column_name"]
    ranked = ranked_frequency(unpivot_values(df, cols, by, numeric=True), "value", keys)
    aggs = []
    for name, p in probs.items():
        first = F.floor(F.lit(p) * (F.col("n_group") - 1))
        last = F.least(first + 1, F.col("n_group") - 1)
        aggs += [F.min(F.when(F.col("upto") > first, F.col("value"))).alias(f"_x_{name}"),
                 F.min(F.when(F.col("upto") > last, F.col("value"))).alias(f"_y_{name}")]
    got = ranked.groupBy(*keys).agg(F.max("n_group").alias("_n"), *aggs)
    out = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        out.append((F.col(f"_x_{name}") + (F.col(f"_y_{name}") - F.col(f"_x_{name}"))
                    * (pos - F.floor(pos))).alias(name))
    return got.select(*keys, *out)
