"""Rows with null keys, results that do not depend on partitions, plans that grow linearly."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabsonde.functions.text import cleaned, listed_words, occurrences
from tabsonde.operators import charts, clustering, columns, grouping, insights, joins, models, text
from tabsonde.plans.ordering import attach


def scans(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") + plan.count("FileScan")


@pytest.mark.parametrize("share", [1, 3, 10_000])
def test_attach_keeps_null_keys(spark, share):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 50 + i) for i in range(40)] + [("b", 99), ("c", 100)],
                                 "k string, i int")
    table = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", 3.0)], "k string, v double")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = attach(rows, table, ["k"], sizes, share)
    assert got.columns == ["k", "i", "v"]
    assert {r.i: r.v for r in got.collect()} == {**{i: 1.0 for i in range(50)}, **{50 + i: 2.0 for i in range(40)}, 99: 3.0}
    kept = attach(rows, table, ["k"], sizes, share, unmatched=True).collect()
    assert len(kept) == 92 and [r.v for r in kept if r.k == "c"] == [None]


def test_group_statistics_of_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "g string, v double")
    got = {(r.g, r.v): (r.group_mean, r.z) for r in joins.attach_group_stats(df, ["g"], "v").collect()}
    assert got[None, 9.0] == (None, None) and got["a", 1.0] == (2.0, pytest.approx(-1 / math.sqrt(2)))


def test_null_groups_are_left_out(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 3.0), (None, "x", 9.0), ("a", "x", 2.0)], "g string, h string, v double")
    assert [tuple(r) for r in grouping.group_count(df, ["g"], "v").collect()] == [("a", 3)]
    assert [tuple(r) for r in grouping.group_share(df, ["g"], "v").collect()] == [("a", 3, 100.0)]
    assert [tuple(r) for r in grouping.group_mean(df, ["g", "h"], "v").collect()] == [("a", "x", 1.5)]


def test_more_aggregates(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, None), ("a", 3, 7.0), ("a", 4, 7.0)], "g string, o int, v double")
    got = grouping.group_aggregate(df, ["g"], {"v": ["median", "first", "last", "mode", "q25", "range", "size", "product"]}, ["o"]).first()
    assert tuple(got)[1:] == (7.0, 5.0, 7.0, 7.0, 6.0, 2.0, 4, 245.0)
    with pytest.raises(ValueError):
        grouping.group_aggregate(df, ["g"], {"v": "first"})


def test_crosstab_of_many_values(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("a"), (F.col("id") % 15_000).cast("string").alias("b"))
    got = grouping.crosstab(df, "a", "b")
    assert got.count() == 15_000 and got.agg(F.sum("n")).first()[0] == 30_000
    assert got.where("abs(expected - 1) < 1e-9").count() == 15_000


def test_scans_of_category_codes_grow_linearly(spark):
    df = spark.createDataFrame([("a", "b", "c", 1)] * 3, "x string, y string, z string, n int")
    one, two, three = (scans(charts.parallel_lines(df, ["x", "y", "z"][:k])) for k in (1, 2, 3))
    assert two - one == three - two and three < 60
    rows = spark.createDataFrame([("b", None), (None, "q"), ("a", "p"), ("b", "q")], "x string, y string")
    assert sorted(((r.x, r.y) for r in charts.parallel_lines(rows, ["x", "y"]).collect()), key=repr) == sorted(
        [(1, None), (None, 1), (0, 0), (1, 1)], key=repr)
    assert {(r.x, r.x_code) for r in columns.convert_type(rows, "x", "category").collect()} == {("b", 1), (None, None), ("a", 0)}


def test_all_ranks_points_and_columns(spark, monkeypatch):
    monkeypatch.setattr(charts, "RANKS", 7)
    df = spark.createDataFrame([(float(v),) for v in [3] * 20 + [1] * 5 + [2]], "v double")
    got = charts.qq_points(df, "v").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(1, 27)) and [r["sample"] for r in got] == [1.0] * 5 + [2.0] + [3.0] * 20
    wide = spark.createDataFrame([tuple([None] * 30)], ", ".join(f"c{i} int" for i in range(30)))
    assert len(charts.missing_matrix(wide).columns) == 31


def test_forest_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", F.sin(F.col("id") * 1.0).alias("x"), F.cos(F.col("id") * 3.0).alias("y"))
    df = df.unionByName(spark.createDataFrame([(9999, 30.0, -30.0)], "id long, x double, y double"))
    one, four = (clustering.grow_forest(df.repartition(k), ["x", "y"], 20, 64, ["id"]).sort_values(["tree", "node"]).reset_index(drop=True)
                 for k in (1, 4))
    assert one.equals(four) and one["tree"].nunique() == 20
    rows = clustering.anomalies(df, ["x", "y"], 0.01, ["id"]).orderBy(F.desc("score")).first()
    assert rows["id"] == 9999 and rows["is_anomaly"]


def test_trends_of_every_date(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(day + dt.timedelta(days=i), day + dt.timedelta(days=2 * i), None if i > 4 else 1.0, float(i))
                                for i in range(40)], "d timestamp, e timestamp, short double, v double")
    got = {r["columns"]: r["value"] for r in insights.trend_insights(df).collect()}
    assert set(got) == {"d, v", "e, v"} and all(v > 0 for v in got.values())
    with pytest.raises(ValueError):
        insights.trend_insights(df.select("d", "short"))


def test_stop_words_read_as_cleaned(spark):
    df = spark.createDataFrame([("Don't stop, can't stop: I'll see DON'T!",), (None,)], "t string")
    assert {r.term: r.n for r in text.term_counts(df, "t").collect()} == {"stop": 2, "see": 1}
    assert "dont" in cleaned(["don't", "a.b"]) and "ab" in cleaned(["a.b"])
    row = df.where("t is not null").select(occurrences(F.col("t"), ["stop", "see", "top"]).alias("n"), listed_words(F.col("t"), ["stop", "dont"]).alias("w"),
                                           occurrences(F.col("t"), []).alias("none")).first()
    assert (row.n, row.w, row.none) == (3, ["dont", "stop", "stop", "dont"], 0)


def test_models_take_all_features(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "_prepared", lambda df, target, features, key, task: seen.extend(features) or (_ for _ in ()).throw(StopIteration))
    df = spark.createDataFrame([tuple(range(9))], ", ".join(f"c{i} int" for i in range(9)))
    with pytest.raises(StopIteration):
        models.evaluate_models(df, "c0", ["c1"], task="regression")
    assert seen == [f"c{i}" for i in range(1, 9)]


def test_pairs_of_many_columns_in_one_scan(spark):
    from tabsonde.operators import correlation
    cols = [f"c{i}" for i in range(12)]
    df = spark.range(500).select(*[F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(7)) > 0, F.sin(F.col("id") * (i + 1)) * 3 + 1e6 * i).alias(c)
                                   for i, c in enumerate(cols)]).withColumn("c11", F.lit(None).cast("double")).repartition(5)
    wide = {(r.column_1, r.column_2): r for r in correlation.correlation_matrix(df, cols).collect()}
    assert len(wide) == 66
    assert correlation.correlation_matrix(df, cols)._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    for a, b in (("c0", "c1"), ("c3", "c9"), ("c5", "c11")):
        narrow = correlation.correlation_matrix(df, [a, b]).first()
        got = wide[a, b]
        assert got.n == narrow.n and (got.r is None) == (narrow.r is None)
        assert narrow.r is None or got.r == pytest.approx(narrow.r, abs=1e-9)


def test_modes_of_mixed_types_in_one_scan(spark):
    from tabsonde.operators import missing
    df = spark.createDataFrame([(2**60 + 1, "b", 1.5, None), (2**60 + 1, "a", float("nan"), None), (None, "a", 2.5, None),
                                (7, None, 1.5, None), (7, "b", None, None)], "l long, s string, d double, e int")
    got = missing.fill_mode(df, ["l", "s", "d", "e"]).collect()
    assert [r.l for r in got] == [2**60 + 1, 2**60 + 1, 7, 7, 7] and [r.s for r in got] == ["b", "a", "a", "a", "b"]
    assert [r.d for r in got] == [1.5, 1.5, 2.5, 1.5, 1.5] and [r.e for r in got] == [None] * 5


def test_chi_square_of_a_wide_table(spark):
    from tabsonde.operators import hypothesis
    df = spark.range(40_000).select((F.col("id") % 2).cast("string").alias("a"), F.floor(F.col("id") / 4).cast("string").alias("b"))
    got = hypothesis.chi_square(df, "a", "b").first()
    assert (got.n, got.dof) == (40_000, 9_999) and got.chi2 == pytest.approx(0.0, abs=1e-6)


def test_shapiro_gives_reasons(spark):
    from tabsonde.operators import hypothesis
    df = spark.range(6000).select(F.lit("big").alias("g"), F.rand(1).alias("v")).unionByName(
        spark.createDataFrame([("few", 1.0), *[("same", 2.0)] * 5, *[("fine", float(i * i)) for i in range(9)]], "g string, v double"))
    got = {r.g: r for r in hypothesis.normality_shapiro(df, "v", ["g"]).collect()}
    assert {k: r.reason for k, r in got.items()} == {"big": "more than 5,000 values", "few": "fewer than 3 values", "same": "constant", "fine": None}
    assert got["fine"].statistic is not None and got["big"].statistic is None
