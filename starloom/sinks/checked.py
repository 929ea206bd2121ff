"""A load that goes on after bad rows: one job writes good rows to the table and bad ones, with their reasons, beside it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import Check
from starloom.contracts import Column as TargetColumn
from starloom.functions.casting import cast_to
from starloom.operators.quality import breaks

_BRANCH, _ROW, _ERRORS = "branch", "_row", "_errors"


@dataclass(frozen=True)
class LoadCounts:
    """Rows written to the table, rows refused, and how many rows each column had refused."""

    accepted: int
    rejected: int
    by_column: dict[str, int]


def _stored(kind: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(kind, (T.VarcharType, T.CharType)) else kind


def _reasons(source: T.StructType, target: Sequence[TargetColumn], checks: Sequence[Check]) -> dict[str, Column]:
    """Per column what is wrong with its value, NULL if nothing is. Columns named ``_new_<name>`` hold the converted values."""
    found = {}
    for c in target:
        if c.name not in source.names:
            found[c.name] = F.lit(f"{c.name}: missing") if c.required and not c.has_default else F.lit(None).cast("string")
            continue
        old, new, kind = F.col(c.name), F.col(f"_new_{c.name}"), source[c.name].dataType
        reason = F.when(old.isNotNull() & new.isNull(), F.lit(f"{c.name}: not a {_stored(c.type).simpleString()}"))
        if c.required and not c.has_default:
            reason = reason.when(old.isNull(), F.lit(f"{c.name}: missing"))
        if isinstance(c.type, (T.VarcharType, T.CharType)):
            reason = reason.when(F.length(new) > c.type.length, F.lit(f"{c.name}: longer than {c.type.length}"))
        if isinstance(c.type, (T.DecimalType, T.IntegralType)) and isinstance(kind, (T.StringType, T.NumericType)):
            scale = c.type.scale if isinstance(c.type, T.DecimalType) else 0
            exact = old.try_cast(T.DecimalType(38, 15))
            reason = reason.when(exact != F.round(exact, scale), F.lit(f"{c.name}: more than {scale} decimals"))
        for check in checks:
            if check.column == c.name:
                beyond = breaks(Check(f"_new_{c.name}", check.minimum, check.maximum, check.values))
                reason = reason.when(beyond, F.lit(f"{c.name}: outside its range"))
        found[c.name] = reason
    return found


def load_checked(
    df: DataFrame, path: str, target: Sequence[TargetColumn], checks: Sequence[Check] = (), truncate: bool = False
) -> LoadCounts:
    """Append the rows of ``df`` that fit the target's columns to the table at ``path``; keep the others with all of their reasons.

    A value must convert to its column's type without losing decimals, fit its length, be there if the column is required
    and has no default, and keep its checks (NULL keeps any). Columns the stream lacks are NULL. Rows are judged and
    written in one pass; the two branches are folders of one Parquet table, written by one job, so either all of a load
    is there or none.
    """
    values = [
        cast_to(F.col(c.name), df.schema[c.name].dataType, _stored(c.type)) if c.name in df.columns else F.lit(None).cast(_stored(c.type))
        for c in target
    ]
    converted = df.select("*", *[v.alias(f"_new_{c.name}") for c, v in zip(target, values, strict=True)])
    reasons = _reasons(df.schema, target, checks)
    judged = converted.withColumns({f"_why_{n}": r for n, r in reasons.items()}).withColumn(
        _ERRORS, F.array_compact(F.array(*[F.col(f"_why_{n}") for n in reasons]))
    )
    good = F.size(_ERRORS) == 0
    seen = Observation("load")
    judged = judged.observe(
        seen,
        F.count_if(good).alias("accepted"),
        F.count_if(~good).alias("rejected"),
        *[F.count(f"_why_{n}").alias(f"column_{i}") for i, n in enumerate(reasons)],
    )
    columns = [F.when(good, F.col(f"_new_{c.name}")).alias(c.name) for c in target]
    as_it_was = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    written = judged.select(
        *columns, F.when(~good, as_it_was).alias(_ROW), _ERRORS, F.when(good, F.lit("accepted")).otherwise(F.lit("rejected")).alias(_BRANCH)
    )
    written.write.mode("overwrite" if truncate else "append").partitionBy(_BRANCH).parquet(path)
    counts = seen.get
    return LoadCounts(counts["accepted"], counts["rejected"], {n: counts[f"column_{i}"] for i, n in enumerate(reasons)})


def _branch(spark: SparkSession, path: str, target: Sequence[TargetColumn], name: str) -> DataFrame:
    fields = [T.StructField(c.name, _stored(c.type)) for c in target]
    extra = [T.StructField(_ROW, T.StringType()), T.StructField(_ERRORS, T.ArrayType(T.StringType())), T.StructField(_BRANCH, T.StringType())]
    return spark.read.schema(T.StructType([*fields, *extra])).parquet(path).where(F.col(_BRANCH) == name)


def accepted_rows(spark: SparkSession, path: str, target: Sequence[TargetColumn]) -> DataFrame:
    """The table itself; the folder of rejected rows is not opened."""
    return _branch(spark, path, target, "accepted").select(*[c.name for c in target])


def rejected_rows(spark: SparkSession, path: str, target: Sequence[TargetColumn]) -> DataFrame:
    """(row, errors): refused rows as JSON of what they were, and why."""
    return _branch(spark, path, target, "rejected").select(F.col(_ROW).alias("row"), F.col(_ERRORS).alias("errors"))
