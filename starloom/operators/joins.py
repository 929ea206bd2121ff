"""Joins, lookups, existence tests, unions and row-shape changes.

No join here forces a broadcast of user data: Spark picks a broadcast from the sizes it knows.

Lookup and existence tables are reduced to one row per key by an aggregate, so a lookup never
multiplies rows, and the reduced table is written before the join. Spark then knows its size, and
both join sides are plain shuffles, the form in which adaptive execution can split a partition that
one frequent stream key has made too large. Joined straight to the aggregate it could not.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.text import literal_pattern
from starloom.operators.ordered import SplitPolicy, running
from starloom.operators.sequence import spread
from starloom.session import barrier


def _free_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rename right columns that the left side already has to ``name_1``."""
    taken = set(left.columns)
    return right.select(*[F.col(c).alias(f"{c}_1" if c in taken else c) for c in right.columns])


def _equal(left_keys: Sequence[str], right_keys: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(left_keys, right_keys)])


def _names(keys: Sequence[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def _key_set(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of a table, written out."""
    return barrier(table.select(*[F.col(c).alias(n) for c, n in zip(keys, _names(keys))]).distinct(), "keys")


def merge_join(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "INNER"
) -> DataFrame:
    """INNER, LEFT OUTER, RIGHT OUTER or FULL OUTER join; clashing right columns get the suffix _1."""
    how = how.upper().removesuffix(" JOIN").removesuffix(" OUTER").strip()
    side = _free_names(left, right)
    keys = [f"{k}_1" if k in left.columns else k for k in right_keys]
    on = _equal(left_keys, keys)
    if how == "FULL":
        # A full outer join cannot split a skewed key at run time, its two halves can. Rows with a
        # NULL key match nothing and skip the second join.
        matched = left.join(side, on, "left")
        complete = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        other = side.where(complete).join(_key_set(left, left_keys), _equal(keys, _names(left_keys)), "left_anti")
        unmatched = other.unionByName(side.where(~complete))
        return matched.unionByName(unmatched, allowMissingColumns=True).select(*matched.columns)
    kinds = {"INNER": "inner", "LEFT": "left", "RIGHT": "right"}
    return left.join(side, on, kinds[how])


def join_rows(left: DataFrame, right: DataFrame, condition: Column | str) -> DataFrame:
    """Theta join: every pair of rows that meets the condition. An empty side gives an empty result.

    Any condition will do, so all rows are paired; where it puts a value of one side between two of the other, use
    :func:`starloom.operators.bands.band_join`.
    """
    side = _free_names(left, right)
    return left.join(side, F.expr(condition) if isinstance(condition, str) else condition, "inner")


def with_parameters(df: DataFrame, **parameters: object) -> DataFrame:
    """Put a one-row parameter stream next to every row."""
    row = df.sparkSession.range(1).select(*[F.lit(v).alias(n) for n, v in parameters.items()])
    return df.crossJoin(F.broadcast(row))  # exactly one row


def first_per_key(table: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key by ``order``; NULL keys cannot be looked up and are left out."""
    present = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    picked = F.min_by(F.struct(*[F.col(v) for v in values]), F.struct(*[F.col(o) for o in order]))
    return table.where(present).groupBy(*keys).agg(picked.alias("_picked")).select(
        *keys, *[F.col(f"_picked.{v}").alias(v) for v in values]
    )


@dataclass(frozen=True)
class LookupValue:
    """A looked-up column, its output name and the value used when there is no match."""

    name: str
    rename: str | None = None
    default: object = None

    @property
    def output(self) -> str:
        return self.rename or self.name


def common_type(*columns: tuple[DataFrame, str]) -> T.DataType:
    """The type in which the columns can be compared: what a union gives them."""
    first, *others = [df.select(F.col(name).alias("v")) for df, name in columns]
    for other in others:
        first = first.union(other)
    return first.schema["v"].dataType


def stream_lookup(
    stream: DataFrame,
    table: DataFrame,
    keys: Mapping[str, str],
    values: Sequence[LookupValue],
    order: Sequence[str],
) -> DataFrame:
    """Equality lookup ``{stream_column: table_column}``; the first match by ``order`` wins."""
    names = [v.name for v in values]
    side = first_per_key(table, list(keys.values()), names, order)
    side = side.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys.values())],
        *[F.col(n).alias(f"_v{i}") for i, n in enumerate(names)],
        F.lit(True).alias("_hit"),
    )
    side = barrier(side, "lookup")
    on = _equal(list(keys), _names(keys))
    outputs = {v.output for v in values}
    filled = [
        F.when(F.col("_hit"), F.col(f"_v{i}"))
        .otherwise(F.lit(v.default).cast(table.schema[v.name].dataType))
        .alias(v.output)
        for i, v in enumerate(values)
    ]
    return stream.join(side, on, "left").select(*[c for c in stream.columns if c not in outputs], *filled)


def database_lookup(
    stream: DataFrame,
    table: DataFrame,
    equal: Mapping[str, str],
    comparison: tuple[str, str, str] | tuple[str, str, str, str],
    values: Sequence[LookupValue],
    order: Sequence[str],
    policy: SplitPolicy = SplitPolicy(),
) -> DataFrame:
    """Lookup on equality keys, which may be empty, plus one comparison; at most one row comes back.

    ``(stream_column, operator, table_column)`` with <, <=, > or >= gives the first match by
    ``order``. ``(low, "BETWEEN", table_column, high)`` gives the match with the smallest table
    value, ties by ``order``.

    Rows and candidates are put in one order per key and each row reads the best candidate on its
    side of it, so candidates are never paired with rows and a large key is cut into chunks. Both are compared in the wider
    of their types.
    """
    low, op, column, *high = comparison
    if op not in ("<", "<=", ">", ">=", "BETWEEN") or (op == "BETWEEN") != bool(high):
        raise ValueError(f"unsupported comparison: {comparison}")
    keys = _names(equal)
    kind_of = common_type((stream, low), (table, column))
    upward = op in ("<", "<=", "BETWEEN")  # candidates lie above the row
    # Where values are equal, strict operators have to meet the row before the candidates.
    candidates_first = op in ("<=", ">=", "BETWEEN")
    candidate_kind, row_kind = (0, 1) if candidates_first != upward else (1, 0)
    rank = F.struct(*[F.col(o) for o in order])
    picked = F.struct(*[F.col(v.name).alias(f"v{i}") for i, v in enumerate(values)])
    candidates = table.where(F.col(column).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(equal.values(), keys)],
        F.col(column).cast(kind_of).alias("_value"),
        F.lit(candidate_kind).alias("_kind"),
        F.lit(0).cast("long").alias("_spread"),
        rank.alias("_rank"),
        F.struct(rank.alias("rank"), F.col(column).alias("value"), picked.alias("picked")).alias("_candidate"),
    )
    for k in keys:
        candidates = candidates.where(F.col(k).isNotNull())
    rows = stream.select(
        *[F.col(c).alias(k) for c, k in zip(equal, keys)],
        F.col(low).cast(kind_of).alias("_value"),
        F.lit(row_kind).alias("_kind"),
        spread(stream).alias("_spread"),
        F.struct(*[F.col(c) for c in stream.columns]).alias("_row"),
    )
    both = candidates.unionByName(rows, allowMissingColumns=True)
    placing = ["_value", "_kind", "_spread", "_rank"]
    found = {"_best": F.col("_candidate")}
    # With BETWEEN the nearest candidate decides; otherwise the first by rank on that side.
    kind = {"lasts": found} if op == "BETWEEN" else {"mins": found}
    best = running(both, keys, placing, cuts=policy, reverse=upward, **kind).where(F.col("_kind") == row_kind)
    hit = F.col("_best").isNotNull() & F.col("_value").isNotNull()
    for k in keys:
        hit = hit & F.col(k).isNotNull()
    if high:
        hit = hit & F.coalesce(F.col("_best.value") <= F.col(f"_row.{high[0]}"), F.lit(False))
    outputs = {v.output for v in values}
    return best.select(
        *[F.col(f"_row.{c}").alias(c) for c in stream.columns if c not in outputs],
        *[
            F.when(hit, F.col(f"_best.picked.v{i}"))
            .otherwise(F.lit(v.default).cast(table.schema[v.name].dataType))
            .alias(v.output)
            for i, v in enumerate(values)
        ],
    )


def merge_rows(
    reference: DataFrame, compare: DataFrame, keys: Sequence[str], values: Sequence[str], flag: str = "flagfield"
) -> DataFrame:
    """Compare two versions of a table: identical, changed, new or deleted per key.

    Both versions hold one row per key; NULL keys are equal, repeated keys are an error. The compared row is returned, the
    reference row if deleted. Both sides meet in one grouping, which keeps one row per key and task.
    """
    row = F.struct(*[F.col(c).alias(c) for c in [*keys, *values]])
    missing = F.lit(None).cast(compare.select(row.alias("r")).schema["r"].dataType)
    old = reference.select(*keys, row.alias("_old"), missing.alias("_new"))
    new = compare.select(*keys, missing.alias("_old"), row.alias("_new"))
    both = old.unionByName(new).groupBy(*keys).agg(
        F.max("_old").alias("_old"), F.max("_new").alias("_new"), F.count("_old").alias("_olds"), F.count("_new").alias("_news")
    )
    state = (
        F.when((F.col("_olds") > 1) | (F.col("_news") > 1), F.raise_error(F.lit("a key is repeated")).cast("string"))
        .when(F.col("_old").isNull(), F.lit("new"))
        .when(F.col("_new").isNull(), F.lit("deleted"))
        .when(F.col("_old").eqNullSafe(F.col("_new")), F.lit("identical"))
        .otherwise(F.lit("changed"))
    )
    kept = F.coalesce("_new", "_old")
    return both.select(*[kept[c].alias(c) for c in [*keys, *values]], state.alias(flag))


def exists_in(df: DataFrame, table: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows whose key is in ``table``."""
    return df.join(_key_set(table, list(keys.values())), _equal(list(keys), _names(keys)), "left_semi")


def not_exists_in(df: DataFrame, table: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows whose key is not in ``table``, NULL keys included."""
    return df.join(_key_set(table, list(keys.values())), _equal(list(keys), _names(keys)), "left_anti")


def union_streams(*streams: DataFrame) -> DataFrame:
    """Append streams by column name; a column missing from one is NULL there."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def split_to_rows(df: DataFrame, column: str, delimiter: str, output: str, regex: bool = False) -> DataFrame:
    """One row per piece of a delimited column; a NULL value stays one row."""
    pattern = delimiter if regex else literal_pattern(delimiter)
    return df.withColumn(output, F.explode_outer(F.split(column, pattern)))


@dataclass(frozen=True)
class Pivot:
    """``target`` = aggregation of ``field`` over the rows whose key has ``key_value``."""

    field: str
    key_value: object
    target: str
    aggregation: str = "-"
    type: T.DataType | None = None


def denormalise(
    df: DataFrame, key: str, group: Sequence[str], pivots: Sequence[Pivot], order: Sequence[str] = ()
) -> DataFrame:
    """Rows to columns. Without an aggregation the first value by ``order`` is taken."""
    rank = F.struct(*[F.col(c) for c in order]) if order else None
    aggregates = []
    for p in pivots:
        value = F.when(F.col(key) == F.lit(p.key_value), F.col(p.field))
        kinds = {
            "SUM": lambda v: F.sum(v), "AVERAGE": lambda v: F.avg(v), "MIN": lambda v: F.min(v),
            "MAX": lambda v: F.max(v), "COUNT": lambda v: F.count(v),
        }
        if p.aggregation in kinds:
            result = kinds[p.aggregation](value)
        elif p.aggregation == "-":
            if rank is None:
                raise ValueError(f"{p.target}: taking the first value needs an order")
            result = F.min_by(value, F.when(value.isNotNull(), rank))
        else:
            raise ValueError(f"unknown aggregation: {p.aggregation}")
        aggregates.append((result.try_cast(p.type) if p.type else result).alias(p.target))
    return df.groupBy(*group).agg(*aggregates)


def normalise(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns to rows."""
    return df.unpivot(list(ids), list(values), name, value)
