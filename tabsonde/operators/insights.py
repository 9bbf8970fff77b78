"""Rule-based findings: (type, columns, metric, value, level, message)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsonde.operators.clustering import anomaly_summary
from tabsonde.operators.correlation import correlation_matrix, r_p_value
from tabsonde.operators.duplicates import union_frames
from tabsonde.operators.missing import missing_profile
from tabsonde.operators.outliers import flag_outliers
from tabsonde.operators.profile import frequency_facts, skewness_profile
from tabsonde.operators.regression import predictive_analysis
from tabsonde.operators.timeseries import aggregate, trend
from tabsonde.plans.aggregates import frequency_table
from tabsonde.schema import as_double, categorical_columns, numeric_columns, temporal_columns

COLUMNS = ["type", "columns", "metric", "value", "level", "message"]
# Thresholds of the rules.
CORRELATION, STRONG, DOMINANT, RARE, RARE_SHOWN = 0.7, 0.8, 0.7, 0.01, 5
SERIES, TOP_FEATURES = 10, 3  # dates that a trend needs, predictors that a finding names
HIGH_MISSING, SKEWED, VOLATILE, GOOD_FIT, FAIR_FIT = 20.0, 2.0, 0.1, 0.7, 0.5


def finding(df: DataFrame, kind: str, columns: Column, metric: str, value: Column, level: Column,
            message: Column, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.lit(kind).alias("type"), columns.alias("columns"), F.lit(metric).alias("metric"),
                     value.cast("double").alias("value"), level.alias("level"), message.alias("message"))


def _num(c: Column, digits: int = 2) -> Column:
    return F.round(c, digits).cast("string")


def correlated_pairs(df: DataFrame, threshold: float = CORRELATION) -> DataFrame:
    """(column_1, column_2, n, r, r_squared, p_value, level) of pairs with |r| >= threshold."""
    m = correlation_matrix(df).where(F.abs("r") >= threshold)
    return (m.withColumn("r_squared", F.col("r") ** 2)
            .withColumn("level", F.when(F.abs("r") >= STRONG, "high").otherwise("moderate"))
            .withColumn("p_value", r_p_value(F.col("r"), F.col("n"))))


def correlation_insights(df: DataFrame, threshold: float = CORRELATION) -> DataFrame:
    m = correlated_pairs(df, threshold)
    text = F.concat(F.col("column_1"), F.lit(" and "), F.col("column_2"), F.lit(" move "),
                    F.when(F.col("r") > 0, "together").otherwise("in opposite directions"), F.lit(" (r = "), _num(F.col("r")), F.lit(")"))
    return finding(m, "correlation", F.concat_ws(", ", "column_1", "column_2"), "r", F.col("r"), F.col("level"), text)


def _shares(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    freq = frequency_table(df, cols)
    facts = frequency_facts(freq)  # one row per column
    return freq.join(F.broadcast(facts.select("column_name", "total")), "column_name"), facts


def category_imbalance(df: DataFrame, cols: Sequence[str] | None = None, limit: float = DOMINANT) -> DataFrame:
    """(column_name, value, n, ratio): columns whose most frequent value exceeds the limit."""
    _, facts = _shares(df, list(cols or categorical_columns(df)))
    ratio = F.col("mode_n") / F.col("total")
    return (facts.where((F.col("n_unique") > 1) & (ratio > limit))
            .select("column_name", F.col("mode").alias("value"), F.col("mode_n").alias("n"), ratio.alias("ratio")))


def rare_categories(df: DataFrame, cols: Sequence[str] | None = None, limit: float = RARE,
                    shown: int = RARE_SHOWN) -> DataFrame:
    """(column_name, rare_count, examples): values below the limit and the most frequent of them.

    Only the first few values per column are gathered, whatever the number of rare ones.
    """
    freq, _ = _shares(df, list(cols or categorical_columns(df)))
    rare = freq.where(F.col("n") / F.col("total") < limit)
    counted = rare.groupBy("column_name").agg(F.count(F.lit(1)).alias("rare_count"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    top = (rare.select("column_name", "value", "n").withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown)
           .groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("v"))
           .select("column_name", F.concat_ws(", ", F.col("v.value")).alias("examples")))
    return counted.join(F.broadcast(top), "column_name")


def category_insights(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    big, rare = category_imbalance(df, cols), rare_categories(df, cols)
    first = finding(big, "imbalance", F.col("column_name"), "dominant_ratio", F.col("ratio"), F.lit("warning"),
                    F.concat(F.lit("'"), F.col("value"), F.lit("' makes up most of "), F.col("column_name")))
    second = finding(rare, "rare_categories", F.col("column_name"), "rare_count", F.col("rare_count"), F.lit("info"),
                     F.concat(F.col("column_name"), F.lit(" has rare values such as "), F.col("examples")))
    return first.unionByName(second)


def anomaly_insights(df: DataFrame, features: Sequence[str] | None = None, contamination: float = 0.1) -> DataFrame:
    """The share of anomalous rows, and the column with most outlying cells among all rows."""
    features = list(features or numeric_columns(df))
    share = anomaly_summary(df, features, contamination).select("n", "ratio").limit(1)
    flagged = flag_outliers(df, features)
    counts = flagged.agg(*[F.count_if(f"{c}_outlier").alias(c) for c in features])
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("k"), F.lit(c).alias("c")) for c in features]))
    both = share.crossJoin(counts.select(best.alias("b")))  # one row each
    text = F.concat(F.col("n").cast("string"), F.lit(" rows stand out; most outlying values are in "), F.col("b.c"))
    return finding(both, "anomaly", F.col("b.c"), "outlier_ratio", F.col("ratio"), F.lit("warning"), text)


def trend_insights(df: DataFrame, ts: str | None = None, value: str | None = None, by: Sequence[str] = (),
                   grain: str = "day") -> DataFrame:
    """Direction, volatility and seasonality of every date column, or of the one named.

    Each date column goes with the number named, else with the first number that has values on at least
    SERIES dates; date columns without one have no finding.
    """
    dates, numbers = [ts] if ts else temporal_columns(df), [value] if value else numeric_columns(df)
    if not dates or not numbers:
        raise ValueError("a trend needs a date column and a numeric column")
    if ts is None or value is None:
        step = {d: F.date_trunc(grain, F.col(d)) for d in dates}
        long = df.agg(*[F.count_distinct(F.when(as_double(v).isNotNull(), step[d])).alias(f"{i}_{j}")
                        for i, d in enumerate(dates) for j, v in enumerate(numbers)]).first()
        chosen = [(d, next((v for j, v in enumerate(numbers) if long[f"{i}_{j}"] >= SERIES), None)) for i, d in enumerate(dates)]
        chosen = [(d, v) for d, v in chosen if v is not None]
        if not chosen:
            raise ValueError("no series is long enough for a trend")
        return union_frames([trend_insights(df, d, v, by, grain) for d, v in chosen])
    t = trend(aggregate(df, ts, value, by, grain), by)
    text = F.concat(F.lit(value), F.lit(": trend "), F.col("direction"),
                    F.when(F.col("direction") == "upward", "; room for growth").when(F.col("direction") == "downward", "; needs attention").otherwise(""),
                    F.when(F.col("volatility") > VOLATILE, "; volatile").otherwise(""),
                    F.when(F.col("has_seasonality"), "; seasonal").otherwise(""))
    return finding(t, "trend", F.lit(f"{ts}, {value}"), "slope", F.col("slope"), F.col("strength"), text, by)


def predictive_insights(df: DataFrame, predictors: Sequence[str], target: str, key: Sequence[str]) -> DataFrame:
    ranked = predictive_analysis(df, predictors, target, key).where(F.col("rank") <= TOP_FEATURES)
    top = ranked.groupBy("r2").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))),
                                                                 lambda v: v["feature"])).alias("feature"))
    quality = F.when(F.col("r2") > GOOD_FIT, "high").when(F.col("r2") > FAIR_FIT, "adequate").otherwise("limited")
    text = F.concat(F.lit(f"{target} is predicted with "), quality, F.lit(" accuracy; strongest predictors: "), F.col("feature"))
    return finding(top, "predictive", F.lit(target), "r2", F.col("r2"), quality, text)


def quality_insights(df: DataFrame, missing: DataFrame | None = None, correlations: DataFrame | None = None) -> DataFrame:
    """Columns with over 20 % missing, number of pairs with |r| over 0.8, columns with |skewness| over 2. Profiles of
    missing values and correlations that are known already are taken as they are."""
    gone = (missing_profile(df) if missing is None else missing).where(F.col("percent") > HIGH_MISSING)
    parts = [finding(gone, "high_missing", F.col("column_name"), "percent", F.col("percent"), F.lit("warning"),
                     F.concat(F.col("column_name"), F.lit(": consider filling or dropping it")))]
    numeric = numeric_columns(df)
    if len(numeric) > 1:
        pairs = ((correlation_matrix(df, numeric) if correlations is None else correlations).where(F.abs("r") > STRONG).agg(F.count(F.lit(1)).alias("n"))
                 .where("n > 0"))
        parts.append(finding(pairs, "high_correlation", F.lit(""), "pairs", F.col("n"), F.lit("info"),
                             F.concat(F.col("n").cast("string"), F.lit(" pairs are nearly collinear"))))
    if numeric:
        skewed = skewness_profile(df, numeric, SKEWED).where("is_skewed")
        parts.append(finding(skewed, "skewed", F.col("column_name"), "skewness", F.col("skewness"), F.lit("info"),
                             F.concat(F.col("column_name"), F.lit(": consider a log or root transform"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
