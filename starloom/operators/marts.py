"""The summary queries behind a dashboard. All give whole results; a chart that shows less passes a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.profiling import AUDIT_WORDS, TECHNICAL_CATEGORY_WORDS, is_usable

# Fixed value: the most slices a pie shows.
PIE_LIMIT = 15


def _measure(metric: str | None) -> Column:
    return F.sum(metric) if metric else F.count(F.lit(1))


def _first(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def kpi_total(df: DataFrame, metric: str | None = None, output: str = "value") -> DataFrame:
    """One number: the sum of a metric, or the row count."""
    return df.agg(_measure(metric).alias(output))


def time_series(df: DataFrame, date: str, metric: str | None = None, output: str = "value", limit: int | None = None) -> DataFrame:
    """The metric per date, by date; with a limit the newest dates, newest first. Load timestamps are not business dates
    and are refused."""
    if any(word in date.upper() for word in AUDIT_WORDS):
        raise ValueError(f"{date} is a load timestamp")
    order = F.col(date).asc_nulls_first() if limit is None else F.col(date).desc_nulls_last()
    return _first(df.groupBy(date).agg(_measure(metric).alias(output)).orderBy(order), limit)


def by_category(df: DataFrame, category: str, metric: str | None = None, output: str = "value", limit: int | None = None) -> DataFrame:
    """The metric per category, sorted by name."""
    return _first(df.groupBy(category).agg(_measure(metric).alias(output)).orderBy(F.col(category).asc_nulls_first()), limit)


def business_categories(names: list[str]) -> list[str]:
    """Category columns worth a chart: usable and not technical."""
    return [n for n in names if is_usable(n) and not any(w in n.upper() for w in TECHNICAL_CATEGORY_WORDS)]


def distribution(df: DataFrame, category: str, metric: str | None = None, output: str = "value", limit: int | None = None) -> DataFrame:
    """Each category's value and share of the whole, largest first.

    The total is a one-row subquery that adds up all slices, also those a limit leaves out.
    """
    slices = df.groupBy(category).agg(_measure(metric).alias(output))
    total = slices.agg(F.sum(output).alias("total")).scalar()
    top = _first(slices.orderBy(F.col(output).desc(), F.col(category).asc_nulls_first()), limit)
    return top.withColumn("share", F.try_divide(F.col(output), total))


def chart_kind(distinct: int) -> str:
    return "pie" if distinct <= PIE_LIMIT else "bar"


def detail_table(df: DataFrame, column: str, raw: bool = False, limit: int | None = None) -> DataFrame:
    """The column as it is, or its values with row counts."""
    if raw:
        return _first(df.select(column).orderBy(F.col(column).desc()), limit)
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return _first(counted.orderBy(F.col("count").desc(), F.col(column).asc_nulls_first()), limit)
