"""Ordered per-group operators that stay balanced when one group holds much of the table.

A plain window sends a whole group to one task. Here groups that a sample shows to be large are cut
into consecutive chunks of their order, the window runs per (group, chunk), and the few values that
cross a chunk edge are carried over from a small side table. The cut points only place rows, so a
sample that misses a group costs balance and never changes a result.

The order columns must be unique within a group; NULLs sort first.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK, _CUTS, _STEPS = "_chunk", "_cuts", "_steps"
_POINTS_PER_CHUNK = 20


@dataclass(frozen=True)
class SplitPolicy:
    """When to cut a group: above ``max_group_rows``, judged on a sample of ``sample_fraction``."""

    sample_fraction: float = 0.001
    max_group_rows: int = 2_000_000
    seed: int = 17


def _same_group(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def split_points(
    df: DataFrame, group: Sequence[str], order: Sequence[str], policy: SplitPolicy = SplitPolicy()
) -> DataFrame | None:
    """Cut points of the large groups as a small local table, or None when no group is large.

    At most ten chunks per shuffle partition are planned over all groups, so the table that is
    brought to the driver and broadcast has a fixed bound whatever the input size. Without a group the whole table is
    always cut, into as many chunks as there are shuffle partitions or more.
    """
    spark = df.sparkSession
    budget = 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_g{i}" for i in range(len(group))]
    sample = df.select(
        *[F.col(name).alias(key) for name, key in zip(group, keys)],
        F.struct(*[F.col(name) for name in order]).alias("_point"),
    )
    if policy.sample_fraction < 1:
        sample = sample.sample(policy.sample_fraction, policy.seed)
    threshold = policy.max_group_rows * min(policy.sample_fraction, 1.0) if group else 0
    large = (
        sample.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > threshold)
        .orderBy(F.col("_n").desc())
        .limit(budget)
        .collect()
    )
    point_type = T.StructType([T.StructField(name, df.schema[name].dataType) for name in order])
    schema = T.StructType(
        [
            *[T.StructField(name, df.schema[name].dataType) for name in group],
            T.StructField(_CUTS, T.ArrayType(point_type)),
        ]
    )
    if not large:
        return None if group else spark.createDataFrame([([],)], schema)
    sampled = sum(row["_n"] for row in large)
    per_chunk = max(threshold, sampled / budget)
    if not group:
        wanted = policy.max_group_rows * min(policy.sample_fraction, 1.0)
        per_chunk = max(per_chunk, min(wanted, 10 * sampled / budget))
    plan = [
        (*[row[key] for key in keys], chunks, min(1.0, chunks * _POINTS_PER_CHUNK / row["_n"]))
        for row in large
        for chunks in [math.ceil(row["_n"] / per_chunk)]
    ]
    key_fields = [T.StructField(key, df.schema[name].dataType) for name, key in zip(group, keys)]
    planned = spark.createDataFrame(
        plan,
        T.StructType([*key_fields, T.StructField("_k", T.IntegerType()), T.StructField("_p", T.DoubleType())]),
    )
    thinned = (
        sample.join(F.broadcast(planned), _same_group(sample, planned, keys))
        .where(F.rand(policy.seed) < F.col("_p"))
        .groupBy(*[planned[key] for key in keys], "_k")
        .agg(F.sort_array(F.collect_list("_point")).alias("_points"))
        .collect()
    )
    rows = []
    for row in thinned:
        points = row["_points"]
        cuts = [points[len(points) * i // row["_k"]] for i in range(1, row["_k"])]
        cuts = [tuple(cut) for i, cut in enumerate(cuts) if i == 0 or cut != cuts[i - 1]]
        rows.append((*[row[key] for key in keys], cuts))
    return spark.createDataFrame(rows, schema)


def _chunked(df: DataFrame, group: Sequence[str], order: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Add the chunk number of each row, how many cuts are not after it; NULL for rows of groups that are not cut."""
    # Halving steps, so that a row costs a logarithm of the cuts: the powers of two up to their number, largest first.
    powers = F.filter(F.transform(F.sequence(F.lit(30), F.lit(0)), lambda n: F.pow(F.lit(2.0), n).cast("int")), lambda p: p <= F.size(_CUTS))
    side = cuts.select(*[F.col(name).alias(f"_cut_{name}") for name in group], _CUTS, powers.alias(_STEPS))
    match = F.lit(True)
    for name in group:
        match = match & F.col(name).eqNullSafe(F.col(f"_cut_{name}"))
    here = F.struct(*[F.col(name) for name in order])
    # The side table is bounded by split_points.
    joined = df.join(F.broadcast(side), match, "left")

    def halve(passed: Column, step: Column) -> Column:
        # Cuts ascend: if the one at this step is not after the row, all before it are not either.
        beyond = (passed + step <= F.size(_CUTS)) & (F.get(_CUTS, passed + step - 1) <= here)
        return F.when(beyond, passed + step).otherwise(passed)

    chunk = F.when(F.col(_CUTS).isNotNull(), F.aggregate(_STEPS, F.lit(0), halve))
    return joined.withColumn(_CHUNK, chunk).drop(_CUTS, _STEPS, *[f"_cut_{name}" for name in group])


def _ordered(order: Sequence[str], reverse: bool = False) -> list[Column]:
    return [F.col(name).desc_nulls_last() if reverse else F.col(name).asc_nulls_first() for name in order]


def _auto(df: DataFrame, group, order, cuts) -> DataFrame | None:
    if isinstance(cuts, SplitPolicy):
        return split_points(df, group, order, cuts)
    return cuts


def lag_lead(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    fields: Sequence[tuple[str, str, str, int]],
    cuts: DataFrame | SplitPolicy | None = SplitPolicy(),
) -> DataFrame:
    """Add ``(result, subject, "LAG"|"LEAD", offset)`` columns over each group's order."""
    for _, _, kind, offset in fields:
        if kind not in ("LAG", "LEAD") or offset < 1:
            raise ValueError("use LAG or LEAD with a positive offset")
    move = {"LAG": F.lag, "LEAD": F.lead}
    cuts = _auto(df, group, order, cuts)
    if cuts is None:
        window = Window.partitionBy(*group).orderBy(*_ordered(order))
        return df.select("*", *[move[k](s, n).over(window).alias(r) for r, s, k, n in fields])

    reach = max(n for _, _, _, n in fields)
    window = Window.partitionBy(*group, _CHUNK).orderBy(*_ordered(order))
    whole = Window.partitionBy(*group, _CHUNK)
    rows = _chunked(df, group, order, cuts).select(
        "*",
        F.row_number().over(window).alias("_rn"),
        F.count(F.lit(1)).over(whole).alias("_size"),
        *[move[k](s, n).over(window).alias(r) for r, s, k, n in fields],
    )
    # The rows near a chunk edge, with all their neighbours up to the largest offset. Per group
    # that is at most 2 * reach rows per chunk, so one small window can finish them.
    near = rows.where(
        F.col(_CHUNK).isNotNull() & ((F.col("_rn") <= reach) | (F.col("_rn") > F.col("_size") - reach))
    )
    across = Window.partitionBy(*group).orderBy(_CHUNK, "_rn")
    edge = near.select(
        *[F.col(name).alias(f"_e_{name}") for name in group],
        F.col(_CHUNK).alias("_e_chunk"),
        F.col("_rn").alias("_e_rn"),
        *[move[k](s, n).over(across).alias(f"_e{i}") for i, (_, s, k, n) in enumerate(fields)],
    )
    match = (F.col(_CHUNK) == F.col("_e_chunk")) & (F.col("_rn") == F.col("_e_rn"))
    for name in group:
        match = match & F.col(name).eqNullSafe(F.col(f"_e_{name}"))
    joined = rows.join(F.broadcast(edge), match, "left")
    result = []
    for i, (name, _, kind, n) in enumerate(fields):
        inside = F.col("_rn") > n if kind == "LAG" else F.col("_rn") <= F.col("_size") - n
        result.append(F.when(F.col(_CHUNK).isNull() | inside, F.col(name)).otherwise(F.col(f"_e{i}")).alias(name))
    return joined.select(*df.columns, *result)


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    cuts: DataFrame | SplitPolicy | None = SplitPolicy(),
    reverse: bool = False,
    maxs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running sums, last-non-null values, minima and maxima from the start of each group to the row.

    ``reverse`` runs from the end of the group instead.
    """
    sums, lasts, mins, maxs = dict(sums or {}), dict(lasts or {}), dict(mins or {}), dict(maxs or {})
    base, added = df.columns, [*sums, *lasts, *mins, *maxs]
    prepared = df.select(
        "*",
        *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()],
        *[c.alias(f"_in_{n}") for n, c in [*lasts.items(), *mins.items(), *maxs.items()]],
    )
    cuts = _auto(df, group, order, cuts)
    parts = [*group] if cuts is None else [*group, _CHUNK]
    if cuts is not None:
        prepared = _chunked(prepared, group, order, cuts)

    def over(window) -> list[Column]:
        return [
            *[F.sum(f"_in_{n}").over(window).alias(n) for n in sums],
            *[F.last(f"_in_{n}", ignorenulls=True).over(window).alias(n) for n in lasts],
            *[F.min(f"_in_{n}").over(window).alias(n) for n in mins],
            *[F.max(f"_in_{n}").over(window).alias(n) for n in maxs],
        ]

    upto = Window.partitionBy(*parts).orderBy(*_ordered(order, reverse)).rowsBetween(Window.unboundedPreceding, 0)
    rows = prepared.select("*", *over(upto))
    if cuts is None:
        return rows.select(*base, *added)

    # One row per chunk: its total, last value, minimum and maximum, turned into what earlier chunks bring.
    here = F.struct(*[F.col(name) for name in order])
    latest = F.min_by if reverse else F.max_by
    totals = (
        prepared.where(F.col(_CHUNK).isNotNull())
        .groupBy(*group, _CHUNK)
        .agg(
            F.count(F.lit(1)).alias("_size"),
            *[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums],
            *[latest(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), here)).alias(f"_in_{n}") for n in lasts],
            *[F.min(f"_in_{n}").alias(f"_in_{n}") for n in mins],
            *[F.max(f"_in_{n}").alias(f"_in_{n}") for n in maxs],
        )
    )
    before = (
        Window.partitionBy(*group)
        .orderBy(*_ordered([_CHUNK], reverse))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *[F.col(name).alias(f"_c_{name}") for name in group], F.col(_CHUNK).alias("_c_chunk"), *over(before)
    )
    carry = carry.select(
        *[f"_c_{name}" for name in group], "_c_chunk", *[F.col(n).alias(f"_carried_{n}") for n in added]
    )
    match = F.col(_CHUNK) == F.col("_c_chunk")
    for name in group:
        match = match & F.col(name).eqNullSafe(F.col(f"_c_{name}"))
    joined = rows.join(F.broadcast(carry), match, "left")
    return joined.select(
        *base,
        *[(F.col(n) + F.coalesce(F.col(f"_carried_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(n), F.col(f"_carried_{n}")).alias(n) for n in lasts],
        *[F.least(F.col(n), F.col(f"_carried_{n}")).alias(n) for n in mins],
        *[F.greatest(F.col(n), F.col(f"_carried_{n}")).alias(n) for n in maxs],
    )
