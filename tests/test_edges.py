"""Empty, constant, all-null, one-row and one-group inputs, and properties of results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsonde.functions.text import STOP_WORDS
from tabsonde.operators import (charts, clustering, columns, correlation, duplicates, experiment, grouping,
                                hypothesis, insights, missing, models, outliers, profile, regression, text,
                                timeseries, userfuncs)


@pytest.fixture(scope="module")
def odd(spark):
    """A constant, an all-null, a NaN column and one with values."""
    nan = float("nan")
    return spark.createDataFrame([(i, 5.0, None, nan if i % 2 else float(i), "a" if i % 3 else None) for i in range(12)],
                                 "id long, const double, nothing double, holes double, s string").cache()


def empty(df):
    return df.where(F.lit(False))


def test_describe(odd):
    got = {r.column_name: r for r in profile.describe_numeric(odd).collect()}
    assert got["nothing"].n == 0 and got["nothing"].median is None
    assert got["holes"].n == 6 and got["holes"].mean == 5.0 and got["const"].std == 0.0
    none = profile.describe_numeric(empty(odd), ["const"]).first()
    assert none.n == 0 and none.mean is None


def test_skewness_is_the_corrected_one(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double")
    r = profile.skewness_profile(df).first()
    assert r.skewness == pytest.approx(1.46933, abs=1e-5) and not r.is_skewed
    assert profile.skewness_profile(df.where("x < 3")).first().skewness is None


def test_nan_counts_as_missing(odd):
    got = {r.column_name: r.n_missing for r in missing.missing_profile(odd).collect()}
    assert got == {"nothing": 12, "holes": 6, "s": 4}
    assert profile.dataset_summary(odd).first().missing_cells == 22
    assert profile.dataset_summary(empty(odd)).first().missing_percent == 0.0


def test_fills(odd):
    filled = missing.fill_mean(odd, ["holes", "nothing"])
    assert filled.where("holes IS NULL").count() == 0 and filled.where("nothing IS NOT NULL").count() == 0
    assert missing.fill_median(odd, ["holes"]).agg(F.min("holes")).first()[0] == 0.0
    assert missing.fill_mode(odd, ["s"]).where("s = 'a'").count() == 12
    with pytest.raises(ValueError):
        missing.fill_missing(odd, "forward_fill", ["holes"])
    with pytest.raises(ValueError):
        missing.fill_mean(odd, ["s"])


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert missing.column_modes(df, ["v"]).first()[0] == "a"


def test_interpolation(spark):
    df = spark.createDataFrame(list(enumerate([None, 1.0, None, None, 4.0, None])), "i int, v double")
    got = [r.v for r in missing.interpolate(df, ["v"], ["i"]).orderBy("i").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_outliers(odd, spark):
    assert outliers.outlier_bounds(odd, ["const", "nothing", "holes"]) == {}
    df = spark.createDataFrame([(i, float(i % 10), 100.0 if i == 3 else 1.0 + i % 2) for i in range(60)], "i int, a double, b double")
    assert outliers.outlier_rows(df, ["i"], ["a", "b"]).collect()[0].i == 3
    assert outliers.remove_outliers(df, ["a", "b"]).count() == 59
    once = outliers.cap_outliers(df, ["a", "b"])
    assert once.exceptAll(outliers.cap_outliers(once, ["a", "b"])).count() <= once.count()
    assert outliers.replace_outliers(df, ["b"], "median").agg(F.max("b")).first()[0] == 2.0
    assert outliers.outlier_rows(odd, ["id"], ["const"]).count() == 0
    kept = outliers.cap_outliers(odd, ["holes"])
    assert kept.where("holes IS NULL").count() == 6


def test_a_row_outlying_in_two_columns_goes_once(spark):
    df = spark.createDataFrame([(i, 900.0 if i == 0 else float(i % 9), -900.0 if i == 0 else float(i % 7)) for i in range(50)],
                               "i int, a double, b double")
    assert outliers.remove_outliers(df, ["a", "b"]).count() == 49


def test_duplicates(spark):
    rows = [(1, None, 10), (1, None, 11), (2, "x", 12), (1, None, 13)]
    df = spark.createDataFrame(rows, "a int, b string, pos int")
    part = df.select("a", "b")
    assert duplicates.duplicate_count(part).first() == (4, 2, 2)
    assert [r.extra_copies for r in duplicates.duplicate_groups(part).collect()] == [2]
    assert {r.pos for r in duplicates.drop_duplicates(df, "pos").collect()} == {10, 12}
    assert {r.pos for r in duplicates.drop_duplicates(df, "pos", "last").collect()} == {13, 12}
    assert {r.pos for r in duplicates.flag_duplicates(df, "pos").collect()} == {11, 13}
    assert duplicates.duplicate_count(empty(part)).first() == (0, 0, 0)


def test_date_names_of_numbers_stay_numbers(spark):
    df = spark.createDataFrame([(1, "2024-01-05", "x")], "lifetime int, order_date string, note string")
    got = columns.detect_date_columns(df)
    assert dict(got.dtypes) == {"lifetime": "int", "order_date": "timestamp", "note": "string"}


def test_end_day_is_included(spark):
    import datetime as dt
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-02 23:30:00'), (timestamp_ntz'2024-01-03 00:00:00') AS t(ts)")
    assert columns.filter_date_range(df, {"ts": (dt.date(2024, 1, 1), dt.date(2024, 1, 2))}).count() == 1


def test_convert_type(spark):
    df = spark.createDataFrame([(1, "3"), (2, "x"), (3, None), (4, "3")], "i int, v string")
    assert [r.v for r in columns.convert_type(df, "v", "numeric").orderBy("i").collect()] == [3.0, None, None, 3.0]
    got = columns.convert_type(df, "v", "category").orderBy("i").collect()
    assert [r.v_code for r in got] == [0, 1, None, 0]
    with pytest.raises(ValueError):
        columns.convert_type(df, "v", "colour")


def test_narrowing_bounds(spark):
    df = spark.sql("SELECT * FROM VALUES (127L, 128L, -32768L, 0.1D, 0.5D), (-128L, 0L, 3L, 1D, null) AS t(a, b, c, d, e)")
    got = {r.column_name: r.to_type for r in columns.narrowing_plan(df).collect()}
    assert got == {"a": "tinyint", "b": "smallint", "c": "smallint", "d": "double", "e": "float"}


def test_correlation_of_a_constant_is_null(odd):
    got = {(r.column_1, r.column_2): r for r in correlation.correlation_matrix(odd, ["id", "const", "nothing"]).collect()}
    assert got["id", "const"].r is None and got["id", "nothing"].r is None and got["id", "nothing"].n == 0
    r = correlation.correlation_test(odd, "id", "holes").first()
    assert r.correlation == pytest.approx(1.0) and r.p_value == pytest.approx(0.0, abs=1e-12) and r.n == 6


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=300), 1)
    y = np.round(x + rng.normal(size=300), 1)
    g = rng.integers(0, 2, 300)
    pdf = pd.DataFrame({"x": x, "y": y, "g": np.where(g == 1, "one", "two"), "i": np.arange(300)})
    return spark.createDataFrame(pdf).cache(), pdf


def test_rank_correlations(pairs):
    df, pdf = pairs
    rx, ry = pdf.x.rank(), pdf.y.rank()
    got = correlation.correlation_test(df, "x", "y", "spearman").first()
    assert got.correlation == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    back = correlation.correlation_test(df, "y", "x", "spearman").first()
    assert back.correlation == pytest.approx(got.correlation)
    a, b = correlation.correlation_test(df, "x", "y", "kendall").first(), correlation.correlation_test(df, "y", "x", "kendall").first()
    assert a.correlation == pytest.approx(b.correlation) and 0 < a.p_value < 1e-10
    grouped = {r.g: r.correlation for r in correlation.correlation_test(df, "x", "y", "spearman", ["g"]).collect()}
    for k, p in pdf.groupby("g"):
        assert grouped[k] == pytest.approx(np.corrcoef(p.x.rank(), p.y.rank())[0, 1])


def test_rank_matrix_ranks_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 9.0, None), (2.0, 7.0, 1.0), (3.0, 8.0, 2.0), (4.0, 1.0, 0.0)], "a double, b double, c double")
    got = {(r.column_1, r.column_2): r for r in correlation.rank_correlation_matrix(df).collect()}
    assert got["a", "c"].n == 3 and got["a", "c"].r == pytest.approx(-0.5) and got["a", "b"].r == pytest.approx(-0.8)
    k = {(r.column_1, r.column_2): r.r for r in correlation.rank_correlation_matrix(df, method="kendall").collect()}
    assert k["a", "b"] == pytest.approx(-2 / 3)


def test_pooled_t_squared_is_f(pairs):
    df, _ = pairs
    t = experiment.t_test(df, "g", "y").first()
    f = hypothesis.anova(df, "g", "y").first()
    assert t.statistic ** 2 == pytest.approx(f.f) and t.p_value == pytest.approx(f.p_value)
    less, more = (experiment.t_test(df, "g", "y", a).first().p_value for a in ("less", "greater"))
    assert less + more == pytest.approx(1.0)


def test_control_is_chosen(pairs):
    df, _ = pairs
    a, b = experiment.t_test(df, "g", "y", control="one").first(), experiment.t_test(df, "g", "y", control="two").first()
    assert a.statistic == pytest.approx(-b.statistic) and (b.control, b.treatment) == ("two", "one")


def test_wrong_number_of_groups(spark, odd):
    three = spark.createDataFrame([(k, float(i)) for i, k in enumerate("aabbcc")], "g string, v double")
    r = hypothesis.t_test(three, "g", "v").first()
    assert r.n_groups == 3 and r.statistic is None and r.p_value is None
    assert hypothesis.anova(three.where("g = 'a'"), "g", "v").first().f is None
    nulls = three.where("g <> 'c'").unionByName(spark.createDataFrame([(None, 1.0)], "g string, v double"))
    assert hypothesis.t_test(nulls, "g", "v").first().n_groups == 2


def test_unequal_variances_use_welch(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 200)] + [("b", float(v)) for v in rng.normal(0, 9, 100)]
    r = hypothesis.t_test(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()
    assert not r.equal_var and r.levene_p < 0.001 and r.dof < 298


def test_paired(spark):
    rows = [(i, g, float(i + (g == "b") * (1 + i % 2))) for i in range(10) for g in "ab"]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    r = hypothesis.paired_t_test(df, "g", "v", ["i"]).first()
    assert r.n_pairs == 10 and r.mean_difference == -1.5 and r.statistic == pytest.approx(-9.0) and r.dof == 9
    assert hypothesis.paired_t_test(df.where("i > 0 OR g = 'a'"), "g", "v", ["i"]).first().statistic is None


def test_chi_square(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 5}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "p string, q string")
    r = hypothesis.chi_square(df, "p", "q").first()
    n, ad = 65, abs(10 * 5 - 20 * 30)
    assert r.dof == 1 and r.chi2 == pytest.approx(n * (ad - n / 2) ** 2 / (30 * 35 * 40 * 25))
    one = hypothesis.chi_square(df.where("q = 'x'"), "p", "q").first()
    assert one.dof == 0 and one.chi2 == 0.0 and one.p_value == 1.0 and one.cramers_v is None
    grid = grouping.crosstab(df.where("NOT (p = 'a' AND q = 'y')"), "p", "q", zeros=True).collect()
    assert len(grid) == 4 and sum(g.n for g in grid) == 45 and min(g.n for g in grid) == 0


def test_normality(spark):
    rng = np.random.default_rng(9)
    n = 1500
    pdf = pd.DataFrame({"v": np.r_[rng.normal(5, 2, n), rng.exponential(1, n)], "g": ["norm"] * n + ["exp"] * n})
    got = {(r.g, r.test): r for r in hypothesis.normality_tests(spark.createDataFrame(pdf), "v", ["g"]).collect()}
    for test in ("shapiro_wilk", "kolmogorov_smirnov", "jarque_bera"):
        assert got["norm", test].p_value > 0.01 and got["exp", test].p_value < 1e-6
    assert got["norm", "anderson_darling"].statistic < 0.787 < got["exp", "anderson_darling"].statistic
    # 148 .. 261 is the weight example of Shapiro and Wilk (1965): W = 0.79.
    weights = spark.createDataFrame([(float(v),) for v in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)], "v double")
    r = hypothesis.normality_shapiro(weights, "v").first()
    assert r.statistic == pytest.approx(0.79, abs=0.005) and r.p_value == pytest.approx(0.0067, abs=0.002)
    assert hypothesis.normality_shapiro(spark.range(6000).selectExpr("CAST(id AS DOUBLE) AS v"), "v").first().statistic is None


def test_experiment(pairs, spark):
    df, pdf = pairs
    e = experiment.effect(df, "g", "y").first()
    a, b = pdf.y[pdf.g == "one"], pdf.y[pdf.g == "two"]
    assert e.difference == pytest.approx(b.mean() - a.mean()) and e.ci_low < e.difference < e.ci_high
    assert e["size"] == "very small"
    big = spark.createDataFrame([("a", float(i % 5 + 9)) for i in range(50)] + [("b", float(i % 5)) for i in range(50)], "g string, v double")
    assert experiment.effect(big, "g", "v").first()["size"] == "large"
    assert spark.range(1).select(experiment.required_n(F.lit(0.5))).first()[0] == 64
    u = experiment.mann_whitney(df, "g", "y").first()
    want = sum((b.to_numpy()[:, None] > a.to_numpy()[None]).ravel()) + 0.5 * sum((b.to_numpy()[:, None] == a.to_numpy()[None]).ravel())
    assert u.statistic == want and u.n_1 == len(a)
    keyed = experiment.mann_whitney(df.withColumn("k", F.lit("z")), "g", "y", by=["k"]).first()
    assert keyed.statistic == want
    one = [experiment.mann_whitney(df, "g", "y", alt).first().p_value for alt in ("greater", "less")]
    assert 0.99 < sum(one) < 1.02


def test_regression(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(scale=0.1, size=500)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "twin": 2 * x[:, 0]}))
    got = {r.term: r for r in regression.linear_regression(df, ["a", "b"], "y").collect()}
    design = np.column_stack([np.ones(500), x])
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    se = np.sqrt(rss[0] / 497 * np.diag(np.linalg.inv(design.T @ design)))
    for term, c, s in zip(["intercept", "a", "b"], beta, se):
        assert got[term].coefficient == pytest.approx(c) and got[term].std_error == pytest.approx(s)
    assert all(r.coefficient is None for r in regression.linear_regression(df, ["a", "twin"], "y").collect())
    res = regression.predictions(df, ["a", "b"], "y")
    assert abs(res.agg(F.avg("residual")).first()[0]) < 1e-10
    assert regression.predictions(df, ["a", "twin"], "y").first().fitted is None
    one = regression.simple_regression(df, "a", "y").first()
    assert one.slope == pytest.approx(np.polyfit(x[:, 0], y, 1)[0])
    pred = regression.predictive_analysis(df.withColumn("id", F.monotonically_increasing_id()), ["a", "b"], "y", ["id"])
    rows = pred.orderBy("rank").collect()
    assert [r.feature for r in rows] == ["a", "b"] and rows[0].r2 > 0.99


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    picks = [{r.id for r in df.repartition(p).where(regression.split_bucket(["id"]) < 8).collect()} for p in (1, 4, 17)]
    assert picks[0] == picks[1] == picks[2] and 750 < len(picks[0]) < 850


def test_planted_clusters(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(np.vstack([rng.normal(c, 0.1, (60, 2)) for c in (0, 5, 10)]), columns=["a", "b"])
    rows = clustering.kmeans(spark.createDataFrame(pdf), ["a", "b"], 3).collect()
    assert {r["size"] for r in rows} == {60} and rows[0].silhouette > 0.95
    assert sorted(round(r["mean"]) for r in rows if r.column_name == "a") == [0, 5, 10]
    pcs = clustering.principal_components(spark.createDataFrame(pdf), ["a", "b"], 2).collect()
    assert sum({r.component: r.explained_variance for r in pcs}.values()) == pytest.approx(1.0)


def test_planted_anomalies(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"i": range(1010), "a": np.r_[rng.normal(size=1000), np.full(10, 15.0) + rng.normal(size=10)],
                        "b": np.r_[rng.normal(size=1000), np.full(10, -15.0) + rng.normal(size=10)]})
    got = clustering.anomalies(spark.createDataFrame(pdf), ["a", "b"], 0.02, ["i"])
    assert got.where("is_anomaly AND i >= 1000").count() == 10
    assert 15 <= got.where("is_anomaly").count() <= 21


def test_series(spark):
    days = pd.date_range("2024-01-01", periods=96)
    wave = np.tile([3.0, -1.0, -2.0, 0.0], 24)
    pdf = pd.DataFrame({"t": days, "v": np.arange(96) * 0.5 + wave + 10})
    s = timeseries.aggregate(spark.createDataFrame(pdf), "t", "v")
    d = timeseries.decompose(s, 4).orderBy("ts").collect()
    inner = [r for r in d if r.trend is not None]
    assert len(inner) == 92
    for r in inner:
        assert r.trend + r.seasonal + r.residual == pytest.approx(r.value)
        assert r.seasonal == pytest.approx(wave[r.pos]) and r.residual == pytest.approx(0.0, abs=1e-9)
    assert timeseries.seasonality_strength(s, 4).first().strength > 0
    t = timeseries.trend(s).first()
    assert t.direction == "upward" and t.strength == "strong" and t.slope == pytest.approx(0.5, abs=0.01)
    assert timeseries.trend(s.limit(5)).count() == 0
    flat = s.withColumn("value", F.lit(1.0))
    assert timeseries.seasonality_strength(flat, 4).first().strength == 0.0
    assert timeseries.unit_root_test(flat).first().statistic is None
    p = timeseries.periodogram(s.withColumn("value", F.col("value") - 0.5 * F.datediff("ts", F.lit("2024-01-01"))), 2).first()
    assert p.period == pytest.approx(4.0)
    f = timeseries.forecast(s, (0, 1, 0), 2).orderBy("step").collect()
    assert str(f[0].ts.date()) == "2024-04-06" and f[0].low < f[0].forecast < f[0].high


def test_hot_series_is_reduced_before_it_is_windowed(spark):
    df = spark.range(50000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k",
                                       "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id % 240) AS t", "id * 1.0D AS v")
    s = timeseries.aggregate(df, "t", "v", ["k"])
    assert s.where("k = 'hot'").count() == 10


def test_text(spark):
    df = spark.createDataFrame([(1, "Good!  GOOD day, not bad"), (2, "awful 한글 food"), (3, ""), (4, None)], "i int, t string")
    assert [r.t for r in text.clean_text(df, "t").orderBy("i").collect()] == ["good good day not bad", "awful 한글 food", "", None]
    got = {r.i: (r.positive_words, r.negative_words, r.sentiment, r.score) for r in text.sentiment(df.where("i < 4"), "t").collect()}
    assert got[1] == (2, 1, "positive", pytest.approx(2 / 3)) and got[2] == (0, 1, "negative", -1.0) and got[3] == (0, 0, "neutral", 0.0)
    top = text.keywords_by_frequency(df, "t", 2).collect()
    assert (top[0].term, top[0].n) == ("good", 2)
    scores = {r.term: r.score for r in text.keywords_by_tfidf(df, "t", 3).collect()}
    assert set(scores) == {"good", "awful", "bad"} and all(0 <= s <= 1 for s in scores.values())
    assert text.keywords_by_tfidf(empty(df), "t").count() == 0
    assert len(STOP_WORDS) == 181 == len(set(STOP_WORDS))


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert set(StopWordsRemover.loadDefaultStopWords("english")) == set(STOP_WORDS)


def test_histogram(odd, spark):
    got = charts.histogram(odd, ["id", "const", "nothing"], 4).collect()
    assert sum(r.n for r in got if r.column_name == "id") == 12 == sum(r.n for r in got if r.column_name == "const")
    assert not [r for r in got if r.column_name == "nothing"]
    assert {r.bin for r in got if r.column_name == "id"} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        charts.histogram(odd, ["nothing"])


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"v": rng.normal(size=4000)}))
    d = charts.density(df, ["v"], 200, 200).orderBy("x").collect()
    assert np.trapezoid([r.density for r in d], [r.x for r in d]) == pytest.approx(1.0, abs=0.01)


def test_qq(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 2, 2, None or 5)], "v double")
    got = charts.qq_points(df, "v", None).orderBy("i").collect()
    assert [r["sample"] for r in got] == [1, 2, 2, 3, 5] and got[2].theoretical == pytest.approx(0.0)
    many = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS v")
    some = charts.qq_points(many, "v", 100).orderBy("i").collect()
    assert [r.i for r in some] == [math.ceil((j - 0.5) * 50) for j in range(1, 101)]
    assert all(r["sample"] == r.i - 1 for r in some)


def test_parallel_codes_and_labels_agree(spark):
    df = spark.createDataFrame([(1, "z"), (2, "a"), (3, None), (4, "z")], "n int, s string")
    axes = {r.label: r.low for r in charts.parallel_axes(df, ["n", "s"]).where("kind = 'label'").collect()}
    lines = {r.n: r.s for r in charts.parallel_lines(df, ["n", "s"]).collect()}
    assert axes == {"a": 0.0, "z": 1.0} and lines == {1: 1, 2: 0, 3: None, 4: 1}


def test_scatter_sample_is_stable(spark):
    df = spark.range(20000).selectExpr("id", "id * 1.0D AS x", "id * 2.0D AS y")
    a = {r.id for r in charts.scatter_sample(df.repartition(3), ["x", "y"], ["id"], 500).collect()}
    assert a == {r.id for r in charts.scatter_sample(df.repartition(11), ["x", "y"], ["id"], 500).collect()} and 400 < len(a) < 600


def test_missing_matrix_keeps_the_worst_columns(spark):
    df = spark.range(10).select("id", *[F.when(F.col("id") >= i, F.col("id")).alias(f"c{i}") for i in range(6)])
    got = charts.missing_matrix(df, 2)
    assert got.columns == ["c4", "c5", "n_rows"] and sum(r.n_rows for r in got.collect()) == 10


def test_missing_pattern(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 7 = 0, null, 1D) AS a", "IF(id % 7 = 0, null, 2D) AS b",
                                      "IF(id % 5 = 0, null, 3D) AS c", "IF(id % 50 <> 0, null, 4D) AS d", "null AS e")
    df = df.withColumn("e", F.lit(None).cast("double"))
    got = {r.column_name: r.pattern for r in missing.missing_pattern(df).collect()}
    assert got["a"] == got["b"] == "MAR" and got["d"] == got["e"] == "mostly_missing"
    alone = missing.missing_pattern(df.select("id", "c")).collect()
    assert [(r.column_name, r.pattern) for r in alone] == [("c", "unavailable")]


def test_insights_stay_silent_without_findings(spark):
    df = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS a", "CAST((id * 37) % 100 AS DOUBLE) AS b", "concat('k', id % 4) AS k")
    assert insights.quality_insights(df).count() == 0 and insights.category_insights(df).count() == 0
    assert insights.correlation_insights(df).count() == 0


def test_task_type(spark):
    df = spark.range(50).selectExpr("id", "id % 5 AS few", "concat('a', id) AS s")
    assert [models.task_type(df, c).first().task for c in ("id", "few", "s")] == ["regression", "classification", "classification"]


def test_separable_classes(spark):
    df = spark.range(300).selectExpr("id", "IF(id % 2 = 0, 'u', 'v') AS y", "IF(id % 2 = 0, 0D, 5D) + pmod(id * 7919, 100) / 100 AS x")
    got = models.evaluate_models(df, "y", ["id"], ["x"], models=["linear"]).first()
    assert got.score == 1.0 and got.cv_score == 1.0 and got.is_best


def test_user_functions(spark):
    df = spark.range(2500).selectExpr("id", "id % 3 AS k")
    sizes = userfuncs.apply_chunks(df.coalesce(1), lambda p: pd.DataFrame({"n": [len(p)]}), "n long", 1000).collect()
    assert sum(r.n for r in sizes) == 2500 and max(r.n for r in sizes) <= 1000
    assert userfuncs.apply_parallel(df, lambda p: p.assign(id=p.id + 1), "id long, k long", 4).agg(F.sum("id")).first()[0] == sum(range(1, 2501))
    with pytest.raises(ValueError):
        userfuncs.apply_grouped(df, ["k"], lambda p: p, "k long, id long", {"id": "mean"})
    out = duplicates.union_frames([df.select("id", "k"), df.select("k", "id")])
    assert out.count() == 5000


def test_user_function_sees_whole_groups(spark):
    df = spark.range(1000).selectExpr("id", "nullif(id % 3, 2) AS k").repartition(7)
    out = userfuncs.apply_groups(df, ["k"], lambda p: p.head(1)[["k"]].assign(middle=p.id.median()), "k long, middle double")
    assert {r.k: r.middle for r in out.collect()} == {0: 499.5, 1: 499.0, None: 500.0}
    with pytest.raises(ValueError):
        userfuncs.apply_groups(df, ["k"], lambda p: p, "id long, k long", most=300)


def test_user_function_streams_through_groups(spark):
    """Order inside groups, a null key, and a group of five million rows that is never held whole."""
    def check(key, batches):
        last, n, most = -1, 0, 0
        for pdf in batches:
            ids = pdf.id.to_numpy()
            assert ids[0] > last and (np.diff(ids) > 0).all()
            last, n, most = ids[-1], n + len(pdf), max(most, len(pdf))
        yield pd.DataFrame({"k": [key[0]], "n": [n]})
        yield pd.DataFrame({"k": [key[0]], "n": [most]})

    df = spark.range(5_001_000).selectExpr("id", "CASE WHEN id < 5000000 THEN 1 WHEN id % 3 = 0 THEN 2 END AS k")
    out = userfuncs.apply_group_batches(df.repartition(9), ["k"], check, "k int, n long", ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "hashpartitioning(k" in plan
    got = {}
    for r in out.collect():
        got.setdefault(r.k, []).append(r.n)
    assert {k: max(v) for k, v in got.items()} == {1: 5_000_000, 2: 333, None: 667}
    assert min(got[1]) <= 10_000
    assert userfuncs.apply_group_batches(df.limit(0), ["k"], check, "k int, n long").count() == 0


def test_group_shares_add_up(odd):
    rows = grouping.group_share(odd, ["s"], "id").collect()
    assert sum(r.percent for r in rows) == pytest.approx(100.0)
    with pytest.raises(ValueError):
        grouping.group_aggregate(odd, ["s"], {"id": "nonsense"})
