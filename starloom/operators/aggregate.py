"""Grouping and ordered analytics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.operators.ordered import SplitPolicy, lag_lead
from starloom.operators.profiling import value_counts

# Aggregate names.
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "SUM": lambda c: F.sum(c),
    "COUNT": lambda c: F.count(c),
    "MAX": lambda c: F.max(c),
    "MIN": lambda c: F.min(c),
    "AVG": lambda c: F.avg(c),
    "COUNT_ALL": lambda c: F.count(F.lit(1)),
}


@dataclass(frozen=True)
class Aggregate:
    output: str
    kind: str
    subject: str = "*"
    type: T.DataType | None = None

    def expr(self) -> Column:
        value = AGGREGATES[self.kind](self.subject)
        return (value.try_cast(self.type) if self.type else value).alias(self.output)


def group_by(df: DataFrame, group: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """Only group and aggregate columns come out; an empty group gives one row."""
    return df.groupBy(*group).agg(*[a.expr() for a in aggregates])


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: float | None = None) -> DataFrame:
    """Rows and distinct non-NULL values of each column, one row per column.

    Values are counted per (column, value) first, so a common value is merged before the shuffle and
    the second aggregate sees every value once. With ``approximate``, the relative error that is allowed, one sketch per
    column is kept instead and no value is shuffled.
    """
    if approximate is not None:
        counts = df.agg(
            F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(c, approximate).alias(f"_c{i}") for i, c in enumerate(columns)]
        )
        rows = [
            F.struct(F.lit(c).alias("column"), F.col("_n").alias("total_count"), F.col(f"_c{i}").alias("distinct_count"))
            for i, c in enumerate(columns)
        ]
        return counts.select(F.inline(F.array(*rows)))
    return value_counts(df, columns).groupBy("column").agg(
        F.sum("n").alias("total_count"), F.count("value").alias("distinct_count")
    )


def analytic_query(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    fields: Sequence[tuple[str, str, str, int]],
    policy: SplitPolicy = SplitPolicy(),
) -> DataFrame:
    """``(result, subject, LEAD|LAG, offset)`` columns over an explicit order, unique per group."""
    return lag_lead(df, group, order, fields, policy)


def frequency_segment(
    df: DataFrame, key: str, threshold: int = 3, output: str = "segment", high: str = "FRECUENTE", low: str = "REGULAR"
) -> DataFrame:
    """Label each key by whether it has more than ``threshold`` rows."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.withColumn(output, F.when(F.col("n_rows") > threshold, F.lit(high)).otherwise(F.lit(low)))
