"""Row validation, constraint counts, key and interval checks, thresholds and row metrics."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import MAX_DATE, Check, DimContract
from starloom.contracts import Column as TargetColumn
from starloom.functions.casting import cast_to, literal, parse_datetime
from starloom.operators.joins import not_exists_in
from starloom.operators.ordered import SplitPolicy, lag_lead, running, split_points


@dataclass(frozen=True)
class Rule:
    """Tests for one column; a row that fails carries ``error_code``."""

    column: str
    error_code: str
    null_allowed: bool = True
    min_length: int | None = None
    max_length: int | None = None
    only_numeric: bool = False
    type: T.DataType | None = None
    mask: str | None = None
    minimum: object = None
    maximum: object = None
    regex: str | None = None

    def violated(self, source: T.DataType) -> Column:
        value = F.col(self.column)
        text = value.cast("string")
        tests = []
        if self.min_length is not None:
            tests.append(F.length(text) < self.min_length)
        if self.max_length is not None:
            tests.append(F.length(text) > self.max_length)
        if self.only_numeric:
            tests.append(~text.rlike(r"^\s*[+-]?(\d+([.]\d*)?|[.]\d+)\s*$"))
        if self.type is not None:
            tests.append(cast_to(value, source, self.type, self.mask).isNull())
        elif self.mask is not None:
            tests.append(parse_datetime(text, self.mask).isNull())
        comparable = cast_to(value, source, self.type, self.mask) if self.type is not None else value
        if self.minimum is not None:
            tests.append(comparable < literal(self.minimum))
        if self.maximum is not None:
            tests.append(comparable > literal(self.maximum))
        if self.regex is not None:
            tests.append(~text.rlike(rf"\A(?:{self.regex})\z"))
        failed = functools.reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))
        missing = F.lit(False) if self.null_allowed else value.isNull()
        return missing | (value.isNotNull() & failed)


def with_errors(df: DataFrame, rules: Sequence[Rule], output: str = "errors", validate_all: bool = True) -> DataFrame:
    """Add the failed rules' codes, comma separated, or NULL for a valid row.

    ``validate_all=False`` keeps the first failure only.
    """
    failures = [F.when(r.violated(df.schema[r.column].dataType), F.lit(r.error_code)) for r in rules]
    codes = F.concat_ws(",", *failures) if validate_all else F.coalesce(*failures, F.lit(""))
    return df.withColumn(output, F.nullif(codes, F.lit("")))


def validate(df: DataFrame, rules: Sequence[Rule], validate_all: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their errors."""
    checked = with_errors(df, rules, "errors", validate_all)
    return checked.where(F.col("errors").isNull()).drop("errors"), checked.where(F.col("errors").isNotNull())


def apply_policy(df: DataFrame, rule: Rule, policy: str, default: object = None) -> DataFrame:
    """What to do with an invalid value: ``reject`` the row, ``nullify`` it, or set a ``default``."""
    dtype = df.schema[rule.column].dataType
    bad = rule.violated(dtype)
    if policy == "reject":
        return df.where(~bad)
    if policy not in ("nullify", "default"):
        raise ValueError(f"unknown policy: {policy}")
    replacement = F.lit(None if policy == "nullify" else default).cast(dtype)
    return df.withColumn(rule.column, F.when(bad, replacement).otherwise(F.col(rule.column)))


# -- constraints ---------------------------------------------------------------------------------


def breaks(check: Check) -> Column:
    """True where a value is outside its constraint; NULL passes, as in SQL."""
    value, tests = F.col(check.column), [F.lit(False)]
    if check.minimum is not None:
        tests.append(value < F.lit(check.minimum))
    if check.maximum is not None:
        tests.append(value > F.lit(check.maximum))
    if check.values:
        tests.append(~value.isin(*check.values))
    return F.coalesce(functools.reduce(lambda a, b: a | b, tests), F.lit(False))


def constraint_violations(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Rows outside each constraint, counted in one scan: one row per constraint."""
    counts = df.agg(*[F.count_if(breaks(c)).alias(f"_c{i}") for i, c in enumerate(checks)])
    return counts.select(
        F.inline(
            F.array(*[F.struct(F.lit(c.column).alias("column"), F.col(f"_c{i}").alias("violations")) for i, c in enumerate(checks)])
        )
    )


def within_constraints(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Rows that meet every constraint."""
    return df.where(~functools.reduce(lambda a, b: a | b, [breaks(c) for c in checks]))


def required_violations(df: DataFrame, target: Sequence[TargetColumn]) -> DataFrame:
    """NULLs per required column without a default; a column the stream lacks counts every row."""
    needed = [c.name for c in target if c.required and not c.has_default]
    counts = df.agg(
        *[
            (F.count_if(F.col(n).isNull()) if n in df.columns else F.count(F.lit(1))).alias(f"_c{i}")
            for i, n in enumerate(needed)
        ]
    )
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_c{i}").alias("missing")) for i, n in enumerate(needed)]))
    )


def cast_failures(df: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Values that are present but do not convert to their target type, per column."""
    bad = {
        n: F.col(n).isNotNull() & cast_to(F.col(n), df.schema[n].dataType, t).isNull() for n, t in types.items()
    }
    counts = df.agg(*[F.count_if(b).alias(f"_c{i}") for i, b in enumerate(bad.values())])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_c{i}").alias("failures")) for i, n in enumerate(bad)]))
    )


def field_metadata(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Compare a stream's schema with the expected one: ok, missing, unexpected or type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    rows = []
    for name in [*want, *[n for n in have if n not in want]]:
        state = (
            "missing" if name not in have
            else "unexpected" if name not in want
            else "ok" if have[name] == want[name]
            else "type"
        )
        rows.append((name, want.get(name), have.get(name), state))
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string, state string")


# -- keys ----------------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def orphans(df: DataFrame, table: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Foreign keys without a referenced row, with their row counts.

    Counted per key before the join, so a frequent orphan is one row there.
    """
    present = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counted = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return not_exists_in(counted, table, keys)


def unknown_share(fact: DataFrame, foreign_keys: Sequence[str], unknown: int = 0) -> DataFrame:
    """Rows resolved to the unknown member, per foreign key."""
    counts = fact.agg(*[F.count_if(F.col(k) == unknown).alias(f"_c{i}") for i, k in enumerate(foreign_keys)])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"_c{i}").alias("unknown_rows")) for i, k in enumerate(foreign_keys)]))
    )


def fan_out(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Business keys whose row count a join changed."""
    # Both sides in one grouping, which takes NULL keys as equal; keys that only the join made are left out.
    side = lambda df, is_before: df.select(*keys, F.lit(is_before).alias("_before"))
    both = side(before, True).union(side(after, False)).groupBy(*keys)
    counted = both.agg(F.count_if(F.col("_before")).alias("rows_before"), F.count_if(~F.col("_before")).alias("rows_after"))
    return counted.where("rows_before > 0 AND rows_before <> rows_after")


def interval_problems(
    dim: DataFrame, contract: DimContract, policy: SplitPolicy = SplitPolicy(), neighbours_only: bool = False
) -> DataFrame:
    """Versions a lookup cannot trust: no end date, an end before the start, or an overlap.

    Of two neighbours that overlap the earlier one is named. A version that starts inside an earlier, longer one is named
    itself, however many versions lie between them; ``neighbours_only`` leaves these out.
    """
    c = contract
    order = [c.date_from, c.version_field]
    known = dim.where(F.col(c.technical_key) != c.unknown_key_value)
    start, end = F.col(c.date_from), F.col(c.date_to)
    group = list(c.natural_keys)
    cuts = split_points(known, group, order, policy)
    # A version that ends before it starts covers nothing.
    reach = {"_reach": F.when(end > start, end)}
    rows = running(known, group, order, maxs=reach, cuts=cuts)
    rows = lag_lead(
        rows, group, order, [("_next", c.date_from, "LEAD", 1), ("_before", "_reach", "LAG", 1), ("_last_end", c.date_to, "LAG", 1)], cuts
    )
    problem = (
        F.when(end.isNull(), F.lit("open end is NULL"))
        .when(end < start, F.lit("ends before it starts"))
        .when(F.col("_next") < end, F.lit("overlaps the next version"))
        .when((F.col("_before") > start) & ~F.coalesce(F.col("_last_end") > start, F.lit(False)), F.lit("lies in an earlier version"))
    )
    named = rows.withColumn("problem", problem).where(F.col("problem").isNotNull())
    if neighbours_only:
        named = named.where(F.col("problem") != "lies in an earlier version")
    return named.select(*c.natural_keys, c.version_field, c.date_from, c.date_to, "problem")


def open_versions(dim: DataFrame, contract: DimContract) -> DataFrame:
    """The versions in force now."""
    return dim.where(F.col(contract.date_to) >= literal(MAX_DATE))


# -- control -------------------------------------------------------------------------------------


class RowThresholdExceeded(RuntimeError):
    pass


def abort_above(df: DataFrame, threshold: int = 0, message: str = "Proceso abortado", with_error: bool = True) -> bool:
    """Stop when a stream has more than ``threshold`` rows; looks at one row beyond it at most.

    Raises, or returns True when ``with_error`` is off. False means the stream is within bounds.
    """
    exceeded = df.limit(threshold + 1).count() > threshold
    if exceeded and with_error:
        raise RowThresholdExceeded(message)
    return exceeded


def row_metrics(df: DataFrame, name: str, columns: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """Count rows, and NULLs of ``columns``, while some action runs; read them from the observation."""
    seen = Observation(name)
    counts = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen
