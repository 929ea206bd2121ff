"""Consecutive numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.session import barrier

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def spread(df: DataFrame) -> Column:
    """A hash of the whole row, to place rows with equal keys.

    Taken from the content, not from the row's position or a random number: a task that runs again
    after a lost executor has to place each row where it was before.
    """
    return F.xxhash64(*[F.col(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)])


def with_index(df: DataFrame, order: Sequence[str | Column], output: str, start: int = 0) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` by ``order``, ascending with NULLs first.

    Rows are range-partitioned, sorted per partition and written out with their partition and
    position, because these must be the same in the two passes that count and number the rows. The
    only global step adds up one count per partition. Rows that tie in ``order`` are spread by a hash
    of their content, so a common value does not fill one task.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select(
        "*",
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, names)],
        spread(df).alias("_tie"),
    )
    sort = [F.col(n).asc_nulls_first() for n in [*names, "_tie"]]
    placed = barrier(
        keyed.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .select(*df.columns, F.monotonically_increasing_id().alias("_at")),
        "index",
    )
    part = F.shiftright("_at", _POSITION_BITS)
    position = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition of the written table.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    value = (F.lit(start) + F.col("_before") + position).cast("long")
    return placed.join(F.broadcast(offsets), part == F.col("_part")).select(*df.columns, value.alias(output))


def add_sequence(
    df: DataFrame,
    order: Sequence[str | Column],
    output: str = "sequence",
    start_at: int = 1,
    increment_by: int = 1,
    max_value: int | None = None,
    cycle: bool = False,
) -> DataFrame:
    """A counter column. Going past ``max_value`` is an error; with ``cycle`` it starts over at ``start_at``."""
    index = F.col("_index")
    if max_value is not None:
        numbers = F.lit((max_value - start_at) // increment_by + 1)
        over = F.raise_error(F.lit(f"the sequence is past {max_value}")).cast("long")
        index = index % numbers if cycle else F.when(index < numbers, index).otherwise(over)
    return with_index(df, order, "_index").select(
        *df.columns, (F.lit(start_at) + index * F.lit(increment_by)).cast("long").alias(output)
    )
