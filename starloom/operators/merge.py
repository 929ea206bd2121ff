"""Insert, update and delete as DataFrame results: target and source in, new target out.

The source is first reduced to one row per key by an aggregate, so both sides of an upsert are unique
on the key and no key can fill a task.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.intervals import interval_lookup
from starloom.operators.joins import LookupValue
from starloom.session import barrier


def _complete(keys: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def one_per_key(
    source: DataFrame, keys: Sequence[str], first: Sequence[str], last: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """One source row per complete key, as if its rows had been applied one after another by ``order``.

    ``first`` columns keep the value of the first row (set on insert only), ``last`` columns that of
    the last. Without an order a repeated key is an error.
    """
    rank = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    pick = lambda function, names: function(F.struct(*[F.col(c) for c in names]), rank)
    parts = []
    if first:
        parts.append(pick(F.min_by, first).alias("_first"))
    if last:
        parts.append(pick(F.max_by, last).alias("_last"))
    grouped = source.where(_complete(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *parts)
    if not order:
        message = F.lit(f"source has several rows for one key {list(keys)}; give an order")
        once = F.when(F.col("_rows") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        grouped = grouped.where(once)  # a filter, so that unused columns cannot drop the test
    return grouped.select(
        *keys, *[F.col(f"_first.{c}").alias(c) for c in first], *[F.col(f"_last.{c}").alias(c) for c in last]
    )


def incomplete(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a NULL in their key. They match nothing: an upsert inserts each source row of this
    kind and keeps each target row."""
    return source.where(~_complete(keys))


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str] | None = None,
    order: Sequence[str] = (),
    insert: bool = True,
) -> DataFrame:
    """Insert rows with new keys; on a match set only the ``update`` columns.

    ``update`` defaults to every non-key column the source has; an empty list inserts new keys and
    changes nothing else. Target columns the source lacks are NULL in inserted rows.
    """
    incoming = [c for c in source.columns if c not in keys]
    unknown = [c for c in source.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"source columns not in the target: {unknown}")
    update = incoming if update is None else list(update)
    reduced = one_per_key(source, keys, [c for c in incoming if c not in update], update, order)
    side = reduced.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"_s_{c}") for c in incoming],
        F.lit(True).alias("_source"),
    )
    on = functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    # Target rows with a NULL in their key cannot match and stay out of the join, where a full outer
    # join would bring them all to one task.
    have = target.where(_complete(keys)).withColumn("_target", F.lit(True))
    joined = have.join(side, on, "full_outer" if insert else "left")
    inserted, matched = F.col("_target").isNull(), F.col("_source").isNotNull()
    result = []
    for f in target.schema:
        old = F.col(f.name)
        if f.name in keys:
            value = F.when(inserted, F.col(f"_k_{f.name}")).otherwise(old)
        elif f.name in update:
            value = F.when(matched, F.col(f"_s_{f.name}")).otherwise(old)
        elif f.name in incoming:
            value = F.when(inserted, F.col(f"_s_{f.name}")).otherwise(old)
        else:
            value = old
        result.append(value.cast(f.dataType).alias(f.name))
    merged = joined.select(*result).unionByName(incomplete(target, keys))
    if not insert:
        return merged
    apart = incomplete(source, keys)
    return merged.unionByName(
        apart.select(
            *[
                (F.col(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in target.schema
            ]
        )
    )


def insert_new(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert rows with new keys and leave existing ones alone."""
    return upsert(target, source, keys, update=(), order=order)


def update_matching(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Update matching rows and never insert."""
    return upsert(target, source, keys, update, order, insert=False)


def delete_matching(
    target: DataFrame, source: DataFrame, keys: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Remove target rows for which some source row meets every ``(target, operator, source)`` test.

    * Equality tests and one other comparison: whether any source value of a key is larger, smaller or different shows in
      its minimum and maximum, so the source becomes one row per key.
    * ``>=`` one source value and ``<`` or ``<=`` another: the source rows are intervals, and each target row looks for one that
      holds it (:func:`~starloom.operators.intervals.interval_lookup`), with or without equality tests.
    * Other comparisons together need an equality test; distinct source rows of a key are compared with its target rows.
    """
    equal = [(t, s) for t, op, s in keys if op == "="]
    other = [(t, op, s) for t, op, s in keys if op != "="]
    if len(other) > 1:
        return _delete_by_several(target, source, equal, other)
    names = [f"_d{i}" for i in range(len(equal))]
    side = source.select(
        *[F.col(s).alias(n) for n, (_, s) in zip(names, equal)], *[F.col(s).alias("_v") for _, _, s in other]
    ).groupBy(*names).agg(*([F.min("_v").alias("_low"), F.max("_v").alias("_high")] if other else []), F.lit(1).alias("_one"))
    meets = F.lit(True)
    for name, (t, _) in zip(names, equal):
        meets = meets & (F.col(t) == F.col(name))
    for t, op, _ in other:
        value, low, high = F.col(t), F.col("_low"), F.col("_high")
        tests = {
            "<": value < high, "<=": value <= high, ">": value > low, ">=": value >= low,
            "<>": (value != low) | (value != high),
        }
        meets = meets & tests[op]
    if not equal:
        side = F.broadcast(side)  # a global aggregate: one row
    else:
        side = barrier(side, "delete")
    return target.join(side, meets, "left_anti")


def _delete_by_several(
    target: DataFrame, source: DataFrame, equal: Sequence[tuple[str, str]], other: Sequence[tuple[str, str, str]]
) -> DataFrame:
    by = {op: (t, s) for t, op, s in other}
    upper = "<" if "<" in by else "<="
    if len(other) == 2 and ">=" in by and upper in by and by[">="][0] == by[upper][0]:
        (column, low), (_, high) = by[">="], by[upper]
        # Fresh names, as source columns may be called like target columns.
        side = source.select(*[F.col(s).alias(f"_d{i}") for i, (_, s) in enumerate(equal)], F.col(low).alias("_low"), F.col(high).alias("_high"), F.lit(True).alias("_hit"))
        on = {t: f"_d{i}" for i, (t, _) in enumerate(equal)}
        found = interval_lookup(target, side, on, column, "_low", "_high", [LookupValue("_hit", "_deleted")], closed=upper == "<=")
        return found.where(F.col("_deleted").isNull()).select(*target.columns)
    if not equal:
        raise ValueError("several comparisons other than a range need an equality test")
    compare = {
        "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b,
    }
    side = source.select(
        *[F.col(s).alias(f"_d{i}") for i, (_, s) in enumerate(equal)], *[F.col(s).alias(f"_v{i}") for i, (_, _, s) in enumerate(other)]
    )
    side = barrier(side.distinct(), "delete")
    meets = [F.col(t) == F.col(f"_d{i}") for i, (t, _) in enumerate(equal)]
    meets += [compare[op](F.col(t), F.col(f"_v{i}")) for i, (t, op, _) in enumerate(other)]
    return target.join(side, functools.reduce(lambda a, b: a & b, meets), "left_anti")
