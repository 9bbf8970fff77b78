"""Global order, quantiles, joins on hot keys: exact whatever the partitions or the skew."""

from __future__ import annotations

import io
import random
import re
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsonde.operators import correlation, missing
from tabsonde.plans import ordering, quantiles


def skewed(spark, n=4000, parts=5):
    """A third of the rows share one value and one key."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        v = 7.0 if hot else round(rng.gauss(0, 10), 1)
        rows.append((i, "hot" if hot else f"k{rng.randrange(40)}", v, None if rng.random() < 0.4 else v))
    return spark.createDataFrame(rows, "id long, k string, v double, gap double").repartition(parts), rows


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_running_sums(spark, parts):
    df, rows = skewed(spark, parts=parts)
    got = ordering.running_sums(ordering.add_bucket(df, ["k"], ["v", "id"]), ["k"], ["v", "id"],
                                {"s": F.col("id")}, {"s": "all"}).select("id", "s", "all").collect()
    want, total = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        total[r[1]] = total.get(r[1], 0) + r[0]
        want[r[0]] = total[r[1]]
    keys = {r[0]: r[1] for r in rows}
    assert all(r.s == want[r.id] and r["all"] == total[keys[r.id]] for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("forward", [True, False])
def test_carry(spark, by, forward):
    df, rows = skewed(spark)
    got = {r.id: r.gap for r in missing.fill_carried(df, ["gap"], ["id"], by, forward).collect()}
    last, want = {}, {}
    for r in (rows if forward else rows[::-1]):
        key = r[1] if by else 0
        if r[3] is not None:
            last[key] = r[3]
        want[r[0]] = last.get(key)
    assert got == want


def test_ranked_frequency(spark):
    df, rows = skewed(spark)
    vs = np.array([r[2] for r in rows])
    got = ordering.ranked_frequency(df, "v").collect()
    assert len(got) == len(set(vs.tolist()))
    for r in got:
        assert (r.n, r.upto, r.n_group) == ((vs == r.v).sum(), (vs <= r.v).sum(), len(vs))


def test_average_ranks_of_a_hot_value(spark):
    df, rows = skewed(spark)
    got = ordering.average_ranks(df.withColumn("w", F.lit(1)), [], "v", ["id"], "w", "rank", "total", df).collect()
    vs = np.array([r[2] for r in rows])
    for r in got:
        assert r["rank"] == (vs < r.v).sum() + ((vs == r.v).sum() + 1) / 2 and r.total == len(vs)


@pytest.mark.parametrize("parts", [1, 6])
def test_attach(spark, parts):
    df, rows = skewed(spark, parts=parts)
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    table = df.groupBy("k").agg(F.max("v").alias("top"))
    got = ordering.attach(df, table, ["k"], sizes, hot_share=20).collect()
    top = {}
    for r in rows:
        top[r[1]] = max(top.get(r[1], -1e9), r[2])
    assert len(got) == len(rows) and all(r.top == top[r.k] for r in got)


def test_column_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = {"normal": rng.normal(size=30000), "ties": rng.integers(0, 9, 30000).astype(float),
            "hot": np.where(rng.random(30000) < 0.4, 3.0, rng.exponential(size=30000)), "heavy": rng.standard_cauchy(30000)}
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*data.values())], ", ".join(f"{c} double" for c in data))
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]

    def check():
        got = quantiles.column_quantiles(df, list(data), probs)
        for c, v in data.items():
            for p in probs:
                assert got[c, p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)
    check()
    monkeypatch.setattr(quantiles, "INSIDE_LIMIT", 50)  # split intervals by bins
    check()
    monkeypatch.setattr(quantiles, "SAMPLE", 5)  # poor sample: the interval has to move
    check()


def test_quantiles_of_little_or_nothing(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, None), (4.0, None, None), (10.0, None, float("nan")), (None, None, None)],
                               "x double, y double, z double")
    got = quantiles.column_quantiles(df, ["x", "y", "z"], [0.25, 0.5])
    assert got["x", 0.25] == 1.75 and got["x", 0.5] == 3.0
    assert got["y", 0.5] is None and got["z", 0.25] == 5.0


def test_grouped_quantiles(spark):
    df, rows = skewed(spark)
    got = {r.k: r for r in quantiles.grouped_quantiles(df, ["k"], ["v"], {"q1": 0.25, "m": 0.5}).collect()}
    for k in {r[1] for r in rows}:
        v = [r[2] for r in rows if r[1] == k]
        assert got[k].q1 == pytest.approx(np.quantile(v, 0.25)) and got[k].m == pytest.approx(np.quantile(v, 0.5))


def brute_kendall(x, y):
    return float(np.sum(np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])) / 2)


@pytest.mark.parametrize("buckets", [1, 3])
def test_kendall_sums(spark, monkeypatch, buckets):
    """With and without ties, by key, for any ranges of the running sums."""
    monkeypatch.setattr(ordering, "bucket_count", lambda df: buckets)
    rng = np.random.default_rng(3)
    parts = {"ties": (rng.integers(0, 9, 300), rng.integers(0, 7, 300)), "smooth": (rng.normal(size=200), rng.normal(size=200)),
             "one": (np.arange(5), np.zeros(5)), "line": (np.arange(40), np.arange(40) * 2)}
    rows = [(k, float(a), float(b)) for k, (x, y) in parts.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, _x double, _y double").repartition(4)
    counted = df.groupBy("k", "_x", "_y").count().withColumnRenamed("count", "n")
    got = {r["k"]: r["s"] for r in correlation._kendall_s(counted, ["k"]).collect()}
    for k, (x, y) in parts.items():
        assert got.get(k, 0.0) == brute_kendall(x, y), k
    whole = correlation._kendall_s(counted.where("k = 'ties'").drop("k"), []).first()["s"]
    assert whole == brute_kendall(*parts["ties"])


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_unkeyed_order_needs_no_single_partition_of_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    text = plan(missing.fill_carried(df, ["l_tax"], order))
    assert "hashpartitioning(_bucket" in text
    # Only the summary with one row per range may meet in one partition.
    inputs = re.findall(r"Input \[\d+\]: \[([^\]]*)\]\nArguments: SinglePartition", text)
    assert inputs and all("l_orderkey" not in i for i in inputs)


def test_filter_and_columns_reach_the_scan(spark):
    import datetime as dt

    from tabsonde.operators.columns import filter_date_range
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    text = plan(filter_date_range(df, {"ts": (dt.date(2024, 1, 2), dt.date(2024, 1, 3))}).select("event_id"))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text
