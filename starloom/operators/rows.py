"""Row-wise operators: projection, casts, filters, sorting, duplicates and computed columns."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import spark_type
from starloom.functions.casting import cast_to, literal
from starloom.functions.text import join_text, literal_pattern, normalise, replace_text
from starloom.operators.sequence import spread, with_index

# -- projection and casts ------------------------------------------------------------------------


def select_columns(df: DataFrame, columns: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Keep only the listed columns; a pair renames."""
    pairs = [(c, c) if isinstance(c, str) else c for c in columns]
    return df.select(*[F.col(name).alias(rename) for name, rename in pairs])


def remove_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*columns)


def cast_columns(df: DataFrame, types: Mapping[str, str | T.DataType], layouts: Mapping[str, str] = {}) -> DataFrame:
    """Retype columns by canonical name or Spark type; values that do not fit become NULL."""
    wanted = {n: spark_type(t) if isinstance(t, str) else t for n, t in types.items()}
    return df.withColumns(
        {n: cast_to(F.col(n), df.schema[n].dataType, t, layouts.get(n)) for n, t in wanted.items()}
    )


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Project onto a target schema: its columns, order, types and decimal scales."""
    return df.select(
        *[cast_to(F.col(f.name), df.schema[f.name].dataType, f.dataType).alias(f.name) for f in target]
    )


# -- filters -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    """``column operator value`` or ``column operator other_column``."""

    column: str
    operator: str
    value: object = None
    other: str | None = None

    def expr(self) -> Column:
        left = F.col(self.column)
        if self.operator == "IS NULL":
            return left.isNull()
        if self.operator == "IS NOT NULL":
            return left.isNotNull()
        right = F.col(self.other) if self.other else literal(self.value)
        compare: dict[str, Callable[[], Column]] = {
            "=": lambda: left == right,
            "<>": lambda: left != right,
            "!=": lambda: left != right,
            ">": lambda: left > right,
            "<": lambda: left < right,
            ">=": lambda: left >= right,
            "<=": lambda: left <= right,
            "CONTAINS": lambda: F.contains(left, right),
        }
        if self.operator not in compare:
            raise ValueError(f"unknown operator: {self.operator}")
        return compare[self.operator]()


def all_of(conditions: Sequence[Condition]) -> Column:
    """The conjunction of several conditions."""
    return functools.reduce(lambda a, b: a & b, [c.expr() for c in conditions])


def filter_rows(df: DataFrame, *conditions: Condition) -> DataFrame:
    """Rows for which every condition holds."""
    return df.where(all_of(conditions))


def split_rows_by(df: DataFrame, *conditions: Condition) -> tuple[DataFrame, DataFrame]:
    """The true and the false branch; a condition that is NULL goes to the false branch."""
    holds = all_of(conditions)
    return df.where(holds), df.where(~F.coalesce(holds, F.lit(False)))


# -- order and duplicates ------------------------------------------------------------------------


def sort_key(column: str, dtype: T.DataType, ascending: bool = True) -> Column:
    """Case-insensitive for text; NULLs first ascending, last descending."""
    key = F.lower(column) if isinstance(dtype, T.StringType) else F.col(column)
    return key.asc_nulls_first() if ascending else key.desc_nulls_last()


def sort_rows(df: DataFrame, columns: Sequence[str | tuple[str, bool]]) -> DataFrame:
    """Total order of the table.

    A hash of the row is the last sort key, so rows that tie are spread over the sort's ranges
    instead of all going to one task.
    """
    pairs = [(c, True) if isinstance(c, str) else c for c in columns]
    keys = [sort_key(c, df.schema[c].dataType, asc) for c, asc in pairs]
    return df.withColumn("_tie", spread(df)).orderBy(*keys, "_tie").drop("_tie")


def sorted_position(df: DataFrame, columns: Sequence[str], output: str = "position") -> DataFrame:
    """The 1-based place of each row in the case-insensitive order of ``columns``."""
    keys = [F.lower(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in columns]
    return with_index(df, keys, output, start=1)


def unique_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ignore_case: Sequence[str] = ()
) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate rather than a window: each task keeps one row per key before the shuffle, so a key
    with very many rows costs no more than any other.
    """
    groups = [F.lower(k) if k in ignore_case else F.col(k) for k in keys]
    rest = F.struct(*[F.col(c) for c in df.columns])
    first = F.min_by(rest, F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*[g.alias(f"_k{i}") for i, g in enumerate(groups)]).agg(first.alias("_row")).select("_row.*")


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    rest = F.struct(*[F.col(c) for c in df.columns])
    last = F.max_by(rest, F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(last.alias("_row")).select("_row.*")


# -- computed columns ----------------------------------------------------------------------------

# Calculation names.
CALCULATIONS: dict[str, Callable[..., Column]] = {
    "CONSTANT": lambda a: a,
    "COPY_OF_FIELD": lambda a: a,
    "ADD": lambda a, b: F.try_add(a, b),
    "SUBTRACT": lambda a, b: F.try_subtract(a, b),
    "MULTIPLY": lambda a, b: F.try_multiply(a, b),
    "DIVIDE": lambda a, b: F.try_divide(a, b),
    "REMAINDER": lambda a, b: F.try_mod(a, b),
    "SQUARE": lambda a: F.try_multiply(a, a),
    "SQUARE_ROOT": lambda a: F.sqrt(a),
    "ABS": lambda a: F.abs(a),
    "ROUND_1": lambda a: F.round(a, 0),
    "NVL": lambda a, b: F.coalesce(a, b),
    "ADD3": lambda a, b, c: F.try_add(F.try_add(a, b), c),
    "PERCENT_1": lambda a, b: F.try_divide(F.lit(100) * a, b),
    "PERCENT_2": lambda a, b: a - F.try_divide(a * b, F.lit(100)),
    "PERCENT_3": lambda a, b: a + F.try_divide(a * b, F.lit(100)),
    "DATE_DIFF": lambda a, b: F.datediff(a, b),
    "ADD_DAYS": lambda a, b: F.date_add(a.cast("date"), b.cast("int")),
    "YEAR_OF_DATE": lambda a: F.year(a),
    "MONTH_OF_DATE": lambda a: F.month(a),
    "DAY_OF_MONTH": lambda a: F.dayofmonth(a),
    "DAY_OF_WEEK": lambda a: F.dayofweek(a),
    "DAY_OF_YEAR": lambda a: F.dayofyear(a),
    "WEEK_OF_YEAR": lambda a: F.weekofyear(a),
    "QUARTER_OF_DATE": lambda a: F.quarter(a),
}


@dataclass(frozen=True)
class Calculation:
    output: str
    kind: str
    a: str
    b: str | None = None
    c: str | None = None
    type: T.DataType | None = None


def calculate(df: DataFrame, calculations: Sequence[Calculation]) -> DataFrame:
    """Apply calculations in turn; a later one may use an earlier result."""
    for item in calculations:
        operands = [F.col(n) for n in (item.a, item.b, item.c) if n is not None]
        value = CALCULATIONS[item.kind](*operands)
        df = df.withColumn(item.output, value.try_cast(item.type) if item.type else value)
    return df


def formula(df: DataFrame, output: str, expression: str, boolean_as_int: bool = False) -> DataFrame:
    """A Spark SQL expression as a new or replaced column."""
    value = F.expr(expression)
    if boolean_as_int:
        value = F.when(value, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return df.withColumn(output, value)


def add_constants(df: DataFrame, constants: Mapping[str, tuple[object, str | T.DataType]]) -> DataFrame:
    """Typed literal columns; empty text is NULL, and text that is not of its type is an error."""
    added = {}
    for name, (value, kind) in constants.items():
        target = spark_type(kind) if isinstance(kind, str) else kind
        literal = F.lit(None if value == "" else value)
        if isinstance(value, str) and value and isinstance(target, (T.DateType, T.TimestampNTZType)):
            if not value[:4].isdigit():
                raise ValueError(f"{name}: {value!r} is not a date constant")
        added[name] = literal.cast(target)
    return df.withColumns(added)


def string_operations(
    df: DataFrame, column: str, trim: str = "both", case: str = "none", output: str | None = None
) -> DataFrame:
    return df.withColumn(output or column, normalise(F.col(column), trim, case))


def replace_in_string(
    df: DataFrame,
    column: str,
    search: str,
    replacement: str = "",
    regex: bool = False,
    case_sensitive: bool = False,
    output: str | None = None,
) -> DataFrame:
    return df.withColumn(output or column, replace_text(F.col(column), search, replacement, regex, case_sensitive))


def concat_fields(
    df: DataFrame,
    columns: Sequence[str],
    output: str,
    separator: str = "",
    enclosure: str = "",
    remove: bool = False,
) -> DataFrame:
    joined = df.withColumn(output, join_text([F.col(c) for c in columns], separator, enclosure))
    return joined.drop(*[c for c in columns if c != output]) if remove else joined


def map_values(
    df: DataFrame, column: str, mapping: Mapping[str, str], output: str | None = None, default: str | None = None
) -> DataFrame:
    """Translate values. No match gives ``default``; without one, the value itself when done in
    place and NULL when written to a new column."""
    value = F.col(column)
    kind = df.schema[column].dataType
    # Keys are compared as values of the column's type. A column that is replaced by texts becomes text.
    keep = value.cast("string") if output in (None, column) else F.lit(None).cast("string")
    fallback = F.lit(default) if default is not None else keep
    entries = [x for old, new in mapping.items() for x in (F.lit(old).cast(kind), F.lit(new).cast("string"))]
    known = F.element_at(F.create_map(*entries), value)
    has = F.coalesce(value.isin(*[F.lit(k).cast(kind) for k in mapping]), F.lit(False))
    return df.withColumn(output or column, F.when(has, known).otherwise(fallback))


def if_null(df: DataFrame, replacements: Mapping[str, object]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in replacements.items()}
    )


def empty_as(df: DataFrame, column: str, replacement: str) -> DataFrame:
    """Replace NULL and blank text."""
    blank = F.col(column).isNull() | (F.trim(column) == "")
    return df.withColumn(column, F.when(blank, F.lit(replacement)).otherwise(F.col(column)))


def null_if(df: DataFrame, column: str, value: object, output: str | None = None) -> DataFrame:
    return df.withColumn(output or column, F.nullif(F.col(column), F.lit(value)))


def number_range(
    df: DataFrame,
    column: str,
    ranges: Sequence[tuple[float | None, float | None, str]],
    output: str = "range",
    fallback: str = "0",
) -> DataFrame:
    """The label of the first range with ``lower <= value < upper``; a range without both bounds
    is left out."""
    value, result = F.col(column), None
    for lower, upper, label in ranges:
        if lower is None or upper is None:
            continue
        inside = (value >= lower) & (value < upper)
        result = F.when(inside, F.lit(label)) if result is None else result.when(inside, F.lit(label))
    return df.withColumn(output, F.lit(fallback) if result is None else result.otherwise(F.lit(fallback)))


def split_columns(
    df: DataFrame, column: str, delimiter: str, fields: Sequence[tuple[str, str | T.DataType, str]]
) -> DataFrame:
    """One delimited column to several ``(name, type, trim)`` columns of the same row."""
    parts = F.split(column, literal_pattern(delimiter))
    added = {}
    for i, (name, kind, trim) in enumerate(fields):
        target = spark_type(kind) if isinstance(kind, str) else kind
        added[name] = cast_to(normalise(F.get(parts, F.lit(i)), trim), T.StringType(), target)
    kept = df.withColumns(added)
    return kept.drop(column) if column not in added else kept


def regex_evaluation(
    df: DataFrame,
    column: str,
    pattern: str,
    result: str,
    captures: Sequence[str] = (),
    case_insensitive: bool = False,
) -> DataFrame:
    """Whether the whole value matches, and its capture groups (NULL when it does not)."""
    full = ("(?i)" if case_insensitive else "") + rf"\A(?:{pattern})\z"
    matched = F.coalesce(F.col(column).rlike(full), F.lit(False))
    groups = {n: F.when(matched, F.regexp_extract(column, full, i)) for i, n in enumerate(captures, 1)}
    return df.withColumns({result: matched, **groups})


def system_date(df: DataFrame, output: str, run_time: Column | None = None) -> DataFrame:
    """The run's UTC timestamp, one value for every row."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    now = utc if run_time is None else run_time
    return df.withColumn(output, now)


def script(
    df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str
) -> DataFrame:
    """A user row script over Arrow batches."""
    return df.mapInPandas(function, schema)
