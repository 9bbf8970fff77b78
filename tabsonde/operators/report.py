"""Report tables: every section as rows (section, metric, column_name, item, value, text)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsonde.operators.charts import histogram, missing_matrix
from tabsonde.operators.columns import conversion_options
from tabsonde.operators.correlation import correlation_matrix
from tabsonde.operators.duplicates import duplicate_count, union_frames
from tabsonde.operators.insights import quality_insights
from tabsonde.operators.missing import missing_profile
from tabsonde.operators.profile import (dataset_summary, describe_categorical, describe_numeric, memory_total,
                                        type_distribution)
from tabsonde.plans.storage import Scratch
from tabsonde.schema import categorical_columns, numeric_columns

SECTION_COLUMNS = ["section", "metric", "column_name", "item", "value", "text"]
STATISTICS = ["n", "mean", "std", "min", "q25", "median", "q75", "max"]
HISTOGRAM_BINS = 20


@dataclass
class ReportConfig:
    """Which sections a report has."""

    title: str = "Data report"
    include_summary: bool = True
    include_statistics: bool = True
    include_visualizations: bool = True
    include_insights: bool = True


def _line(section: str, metric: Column, value: Column | None = None, text: Column | None = None,
          column: Column | None = None, item: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(section).alias("section"), metric.alias("metric"),
                    (none if column is None else column).alias("column_name"),
                    (none if item is None else item).alias("item"),
                    (F.lit(None) if value is None else value).cast("double").alias("value"),
                    (none if text is None else text).cast("string").alias("text"))


def _lines(df: DataFrame, lines: Sequence[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


class Facts:
    """What several sections tell of a table, each computed once, when first asked for, and kept as a small table."""

    def __init__(self, df: DataFrame):
        self.df, self.scratch = df, Scratch(df.sparkSession)

    @cached_property
    def missing(self) -> DataFrame:
        return self.scratch.keep(missing_profile(self.df), "missing")

    @cached_property
    def described(self) -> DataFrame:
        return self.scratch.keep(describe_numeric(self.df), "described")

    @cached_property
    def correlations(self) -> DataFrame:
        return self.scratch.keep(correlation_matrix(self.df, numeric_columns(self.df)), "correlations")

    @cached_property
    def categories(self) -> DataFrame:
        return self.scratch.keep(describe_categorical(self.df), "categories")


def _described(facts: Facts, section: str) -> DataFrame:
    return _lines(facts.described, [_line(section, F.lit(s), F.col(s), column=F.col("column_name")) for s in STATISTICS])


def summary_section(df: DataFrame, known: Facts | None = None) -> DataFrame:
    """Shape, size, types, missing values, numeric and categorical columns."""
    known = known or Facts(df)
    facts = ["n_rows", "n_columns", "missing_cells", "missing_percent", "numeric_columns", "categorical_columns",
             "datetime_columns"]
    parts = [
        _lines(dataset_summary(df), [_line("basic_info", F.lit(m), F.col(m)) for m in facts]),
        _lines(memory_total(df), [_line("basic_info", F.lit("bytes"), F.col("bytes"))]),
        _lines(type_distribution(df), [_line("basic_info", F.lit("type"), F.col("n_columns"), item=F.col("type"))]),
        _lines(known.missing, [
            _line("missing", F.lit(m), F.col(m), column=F.col("column_name")) for m in ("n_missing", "percent")])]
    if numeric_columns(df):
        parts.append(_described(known, "numeric"))
    if categorical_columns(df):
        top = known.categories
        parts.append(_lines(top, [_line("categorical", F.lit("top"), F.col("n"), F.col("value"), F.col("column_name"),
                                        F.col("rank").cast("string"))]))
        parts.append(_lines(top.where("rank = 1"), [
            _line("categorical", F.lit("n_unique"), F.col("n_unique"), column=F.col("column_name")),
            _line("categorical", F.lit("mode"), F.col("mode_n"), F.col("mode"), F.col("column_name"))]))
    return union_frames(parts)


def statistics_section(df: DataFrame, known: Facts | None = None) -> DataFrame:
    """Descriptive statistics, correlations and quality counts."""
    known = known or Facts(df)
    parts = [_lines(duplicate_count(df), [_line("quality", F.lit("duplicate_rows"), F.col("n_duplicates"))]),
             _lines(known.missing, [_line("quality", F.lit("missing_values"), F.col("n_missing"),
                                                column=F.col("column_name"))])]
    numeric = numeric_columns(df)
    if numeric:
        parts.append(_described(known, "basic_stats"))
    if len(numeric) > 1:
        parts.append(_lines(known.correlations, [
            _line("correlations", F.lit("r"), F.col("r"), column=F.col("column_1"), item=F.col("column_2"))]))
    return union_frames(parts)


def chart_section(df: DataFrame, known: Facts | None = None) -> DataFrame:
    """Data of the overview charts: missing patterns of all columns, types, histograms and correlations."""
    known = known or Facts(df)
    flags = df.columns
    patterns = missing_matrix(df) if flags else None
    parts = [_lines(type_distribution(df), [_line("chart_types", F.lit("columns"), F.col("n_columns"), item=F.col("type"))])]
    if patterns is not None:
        bits = F.concat(*[F.col(c).cast("string") for c in flags])
        parts.append(_lines(patterns, [_line("chart_missing", F.lit("pattern"), F.col("n_rows"), item=bits)]))
    numeric = numeric_columns(df)
    if numeric:
        parts.append(_lines(histogram(df, numeric, HISTOGRAM_BINS), [
            _line("chart_histogram", F.lit("n"), F.col("n"), column=F.col("column_name"), item=F.col("bin").cast("string"))]))
    if len(numeric) > 1:
        parts.append(_lines(known.correlations, [
            _line("chart_correlation", F.lit("r"), F.col("r"), column=F.col("column_1"), item=F.col("column_2"))]))
    return union_frames(parts)


def insight_section(df: DataFrame, known: Facts | None = None) -> DataFrame:
    known = known or Facts(df)
    many = len(numeric_columns(df)) > 1
    return _lines(quality_insights(df, known.missing, known.correlations if many else None), [
        _line("insights", F.col("type"), F.col("value"), F.col("message"), F.col("columns"), F.col("level"))])


def sections(df: DataFrame, config: ReportConfig | None = None) -> dict[str, DataFrame]:
    """The sections a configuration asks for, by name."""
    config = config or ReportConfig()
    chosen = [("summary", config.include_summary, summary_section),
              ("statistics", config.include_statistics, statistics_section),
              ("charts", config.include_visualizations, chart_section),
              ("insights", config.include_insights, insight_section)]
    known = Facts(df)  # shared by all sections
    return {name: build(df, known) for name, wanted, build in chosen if wanted}


def report_tables(df: DataFrame, config: ReportConfig | None = None) -> DataFrame:
    """All sections as one long table."""
    parts = [f.withColumn("part", F.lit(name)) for name, f in sections(df, config).items()]
    if not parts:
        raise ValueError("the report has no section")
    return union_frames(parts).select("part", *SECTION_COLUMNS)


def quality_check(df: DataFrame) -> DataFrame:
    """(issue, column_name, n): missing values, duplicate rows, text that reads as numbers."""
    gone = missing_profile(df).select(F.lit("missing_values").alias("issue"), "column_name", F.col("n_missing").alias("n"))
    same = (duplicate_count(df).where("n_duplicates > 0")
            .select(F.lit("duplicate_rows").alias("issue"), F.lit(None).cast("string").alias("column_name"), F.col("n_duplicates").alias("n")))
    parts = [gone, same]
    text = categorical_columns(df)
    if text:
        like = conversion_options(df.select(*text)).where("to_numeric")
        parts.append(like.select(F.lit("numeric_text").alias("issue"), "column_name",
                                 F.round(F.col("numeric_rate") * F.col("n_rows")).cast("bigint").alias("n")))
    return union_frames(parts)
