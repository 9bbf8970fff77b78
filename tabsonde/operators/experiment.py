"""A/B experiments: arm statistics, tests, effect size and sample size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsonde.functions.special import normal_ppf, normal_upper_col, t_ppf_col, t_two_sided_col, t_upper_col
from tabsonde.operators.hypothesis import two_groups
from tabsonde.plans.ordering import attach, ranked_frequency
from tabsonde.schema import as_double, require_columns, require_numeric

ALTERNATIVES = ("two-sided", "greater", "less")


def arm_statistics(df: DataFrame, arm: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, arm, n, mean, std, se) per arm."""
    require_numeric(df, [metric])
    v = as_double(metric)
    return (df.where(F.col(arm).isNotNull()).groupBy(*by, arm)
            .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
            .withColumn("se", F.try_divide(F.col("std"), F.sqrt("n"))))


def _arms(df: DataFrame, arm: str, metric: str, by: Sequence[str], control) -> DataFrame:
    """Moments with arm 1 = control, arm 2 = treatment. The control is the given value,
    otherwise the smallest."""
    if control is not None:
        df = df.withColumn(arm, F.when(F.col(arm).isNotNull(), F.struct(
            (F.col(arm) != F.lit(control)).alias("treated"), F.col(arm).alias("name"))))
    two = two_groups(df, arm, metric, by)
    if control is not None:
        two = two.withColumn("group_1", F.col("group_1.name")).withColumn("group_2", F.col("group_2.name"))
    return two.withColumnsRenamed({"group_1": "control", "group_2": "treatment"})


def _tail(p_upper: Column, p_two: Column, alternative: str) -> Column:
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative is one of {ALTERNATIVES}")
    return {"two-sided": p_two, "greater": p_upper, "less": 1 - p_upper}[alternative]


def t_test(df: DataFrame, arm: str, metric: str, alternative: str = "two-sided",
           control=None, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Pooled t-test of treatment minus control."""
    n1, n2 = F.col("n_1"), F.col("n_2")
    dof = n1 + n2 - 2
    var = F.try_divide((n1 - 1) * F.col("std_1") ** 2 + (n2 - 1) * F.col("std_2") ** 2, dof)
    t = F.try_divide(F.col("mean_2") - F.col("mean_1"), F.sqrt(var * (1 / n1 + 1 / n2)))
    out = _arms(df, arm, metric, by, control)
    valid = F.col("n_groups") == 2
    out = out.withColumn("statistic", F.when(valid, t)).withColumn("dof", F.when(valid, dof))
    p = _tail(t_upper_col(F.col("statistic"), F.col("dof")), t_two_sided_col(F.col("statistic"), F.col("dof")),
              alternative)
    out = out.withColumn("p_value", p)
    return out.select(*by, "control", "treatment", "n_1", "n_2", "statistic", "dof", "p_value",
                      (F.col("p_value") < alpha).alias("is_significant"))


def effect(df: DataFrame, arm: str, metric: str, confidence: float = 0.95, control=None,
           by: Sequence[str] = ()) -> DataFrame:
    """Cohen's d, its size in words, and the interval of the mean difference.

    The interval uses the unpooled standard error with n1 + n2 - 2 degrees of freedom.
    """
    out = _arms(df, arm, metric, by, control).where("n_groups = 2")
    v1, v2 = F.col("std_1") ** 2, F.col("std_2") ** 2
    out = (out.withColumn("difference", F.col("mean_2") - F.col("mean_1"))
           .withColumn("se", F.sqrt(v1 / F.col("n_1") + v2 / F.col("n_2")))
           .withColumn("effect_size", F.try_divide(F.col("difference"), F.sqrt((v1 + v2) / 2)))
           .withColumn("t_critical", t_ppf_col(F.lit((1 + confidence) / 2), F.col("n_1") + F.col("n_2") - 2)))
    d = F.abs("effect_size")
    label = F.when(d < 0.2, "very small").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")
    margin = F.col("t_critical") * F.col("se")
    return out.select(*by, "control", "treatment", "difference", "se", "effect_size", label.alias("size"),
                      (F.col("difference") - margin).alias("ci_low"), (F.col("difference") + margin).alias("ci_high"))


def mann_whitney(df: DataFrame, arm: str, metric: str, alternative: str = "two-sided", control=None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Rank test of the treatment's U, normal approximation with tie and continuity correction.

    Values are counted per arm before they are ranked, so the data volume that is sorted is
    the number of distinct values.
    """
    require_columns(df, [arm])
    require_numeric(df, [metric])
    rows = df.where(F.col(arm).isNotNull()).select(*by, F.col(arm).alias("_arm"), as_double(metric).alias("_v"))
    ends = rows.where(F.col("_v").isNotNull())
    ends = (ends.groupBy(*by, "_arm").agg(F.count(F.lit(1)).alias("n")))
    base = F.lit(control) if control is not None else F.min("_arm")
    facts = [base.alias("control"), F.count(F.lit(1)).alias("n_groups")]
    arms = ends.groupBy(*by).agg(*facts) if by else ends.agg(*facts)
    if by:
        marked = attach(rows, arms, by, ends.groupBy(*by).agg(F.sum("n").alias("n")))
    else:
        marked = rows.crossJoin(F.broadcast(arms))  # one row
    marked = marked.where("n_groups = 2")
    treated = (F.col("_arm") != F.col("control")).cast("bigint")
    ranked = ranked_frequency(marked, "_v", by, {"n_2": treated})
    n = F.col("n").cast("double")
    rank = F.col("upto") - (n - 1) / 2
    aggs = [F.sum("n").alias("total"), F.sum("n_2").alias("n_2"), F.sum(F.col("n_2") * rank).alias("r_2"),
            F.sum(n * n * n - n).alias("ties")]
    got = ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)
    m2, m1 = F.col("n_2").cast("double"), (F.col("total") - F.col("n_2")).cast("double")
    m = F.col("total").cast("double")
    u = F.col("r_2") - m2 * (m2 + 1) / 2
    sd = F.sqrt(m1 * m2 / 12 * (m + 1 - F.try_divide(F.col("ties"), m * (m - 1))))
    diff = F.col("u") - m1 * m2 / 2
    shift = {"two-sided": F.abs(diff) - 0.5, "greater": diff - 0.5, "less": -diff - 0.5}[alternative]
    z = F.try_divide(shift, sd)
    p = normal_upper_col(F.col("z"))
    if alternative == "two-sided":
        p = F.least(2 * p, F.lit(1.0))
    return (got.withColumn("u", u).withColumn("z", z)
            .select(*by, (F.col("total") - F.col("n_2")).alias("n_1"), "n_2", F.col("u").alias("statistic"),
                    "z", p.alias("p_value")))


def required_n(effect_size: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    """Rows per arm for a two-sided t-test; the last term is the small-sample correction."""
    za, zb = normal_ppf(1 - alpha / 2), normal_ppf(power)
    return F.ceil(F.try_divide(F.lit(2 * (za + zb) ** 2), effect_size * effect_size) + F.lit(za * za / 4))


def sample_size(df: DataFrame, arm: str, metrics: Sequence[str], power: float = 0.8, alpha: float = 0.05,
                control=None, by: Sequence[str] = ()) -> DataFrame:
    """Per metric: observed effect, rows per arm needed to detect it, and whether both have them."""
    out = None
    for metric in metrics:
        pooled = F.sqrt((F.col("std_1") ** 2 + F.col("std_2") ** 2) / 2)
        m = (_arms(df, arm, metric, by, control).where("n_groups = 2")
             .select(*by, F.lit(metric).alias("metric"), "n_1", "n_2",
                     F.try_divide(F.col("mean_2") - F.col("mean_1"), pooled).alias("effect_size")))
        out = m if out is None else out.unionByName(m)
    need = required_n(F.col("effect_size"), power, alpha)
    return out.select(*by, "metric", "effect_size", "n_1", "n_2", need.alias("required_n"),
                      F.coalesce(F.least("n_1", "n_2") >= need, F.lit(False)).alias("enough"))
