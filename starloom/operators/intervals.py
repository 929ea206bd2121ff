"""The interval that holds a point; of several the one that starts last, also where intervals lie inside each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.joins import LookupValue, _names, common_type
from starloom.operators.ordered import SplitPolicy, running
from starloom.operators.sequence import spread
from starloom.session import barrier

# A run of segments [_from, _to) is the union of at most two blocks of 2^n segments for each n. At size n the run's first
# whole block is _low, the block after its last one _high; a block is taken where its neighbour in a block of twice the
# size is outside the run.
_LOW = "shiftright(_from + shiftleft(1L, n) - 1, n)"
_HIGH = "shiftright(_to, n)"
_BLOCKS = f"""
array_compact(flatten(transform(sequence(0, int(log2(_to - _from)) + 1), n -> array(
  if({_LOW} < {_HIGH} AND {_LOW} % 2 = 1, struct(n AS level, {_LOW} AS block), NULL),
  if({_LOW} < {_HIGH} AND {_HIGH} % 2 = 1, struct(n AS level, {_HIGH} - 1 AS block), NULL)))))
"""


def last_started(side: DataFrame, keys: Sequence[str], closed: bool, cuts: SplitPolicy) -> DataFrame:
    """(keys, _at, _after, _values): where each stretch begins that one interval answers, or none (_values is NULL).

    ``side`` has the keys, ``_lower``, ``_upper``, ``_place`` (the largest wins) and ``_values``. All bounds of a key cut
    its axis into segments. Each interval is a run of segments, written as a few blocks of a power of two of them; each
    block keeps its winner, and a segment takes the best of the blocks it lies in. So an interval costs a logarithm of
    the segments it spans at most, one row if it spans a single one, and intervals are never paired with each other.
    """
    start = F.struct(F.col("_lower").alias("_at"), F.lit(0).alias("_after"))
    end = F.struct(F.col("_upper").alias("_at"), F.lit(int(closed)).alias("_after"))
    bounds = side.select(*keys, F.explode(F.array(start, end)).alias("_bound")).select(*keys, "_bound.*").distinct()
    ranked = barrier(running(bounds, keys, ["_at", "_after"], sums={"_rank": F.lit(1)}, cuts=cuts), "bounds")
    where = [*keys, "_at", "_after"]
    runs = side.select("*", F.col("_lower").alias("_at"), F.lit(0).alias("_after")).join(
        ranked.withColumnRenamed("_rank", "_from"), where
    )
    runs = runs.drop("_at", "_after").select("*", F.col("_upper").alias("_at"), F.lit(int(closed)).alias("_after")).join(
        ranked.withColumnRenamed("_rank", "_to"), where
    )
    blocks = runs.select(*keys, "_place", "_values", F.explode(F.expr(_BLOCKS)).alias("_b")).select(
        *keys, "_place", "_values", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")
    )
    winners = barrier(
        blocks.groupBy(*keys, "_level", "_block").agg(
            F.max("_place").alias("_place"), F.max_by("_values", "_place").alias("_values")
        ),
        "interval-blocks",
    )
    # The levels that a key's blocks have, 63 at most.
    used = winners.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    own = ranked.join(used, keys) if keys else ranked.crossJoin(F.broadcast(used))  # without keys: one row
    segments = own.select(*where, "_rank", F.explode("_levels").alias("_level"))
    segments = segments.withColumn("_block", F.expr("shiftright(_rank, _level)")).join(
        winners, [*keys, "_level", "_block"], "left"
    )
    return segments.groupBy(*where).agg(F.max_by("_values", "_place").alias("_values"))


def interval_lookup(
    stream: DataFrame,
    table: DataFrame,
    equal: Mapping[str, str],
    at: str,
    lower: str,
    upper: str,
    values: Sequence[LookupValue],
    closed: bool = False,
    tie: Sequence[str] = (),
    cuts: SplitPolicy = SplitPolicy(),
) -> DataFrame:
    """The interval that holds ``at``: ``lower <= at < upper``, or ``<= upper`` when ``closed``.

    Of several the one that starts last wins, then the largest ``tie``, then a hash of the row, so at most one row
    matches. An interval without an upper bound never matches. ``equal`` may be empty. Point and bounds are compared in the
    wider of their types.

    Rows are never paired with intervals. A sorted pass over the intervals finds the keys where one lies inside another.
    For the other keys rows and intervals are put in one order, and each row looks at the interval that started last. For
    those keys the intervals become consecutive stretches with one answer each, which take the intervals' place in that
    order. In both, a large key is cut into chunks.
    """
    names = list(dict.fromkeys(v.name for v in values))
    keys = _names(equal)
    kind = common_type((stream, at), (table, lower), (table, upper))
    low, high = F.col(lower).cast(kind), F.col(upper).cast(kind)
    holds = (low <= high) if closed else (low < high)
    side = table.where(holds).select(
        *[F.col(c).alias(k) for c, k in zip(equal.values(), keys)],
        low.alias("_lower"),
        high.alias("_upper"),
        F.struct(low.alias("lower"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)], spread(table).alias("hash")).alias("_place"),
        F.struct(*[F.col(n) for n in names]).alias("_values"),
    )
    for k in keys:
        side = side.where(F.col(k).isNotNull())
    side = barrier(side, "intervals")
    rows = stream.select(
        *[F.col(c).alias(k) for c, k in zip(equal, keys)],
        F.col(at).cast(kind).alias("_at"),
        F.lit(1).alias("_kind"),
        spread(stream).alias("_spread"),
        F.struct(*[F.col(c) for c in stream.columns]).alias("_row"),
    )
    nested = _nested_keys(side, keys, cuts)
    if nested is None:
        found = _last_started_answers(rows, side, keys, closed, cuts)
    elif not keys:
        found = _stretch_answers(rows, side, keys, closed, cuts)
    else:
        found = _last_started_answers(rows.join(nested, keys, "left_anti"), side.join(nested, keys, "left_anti"), keys, closed, cuts).unionByName(
            _stretch_answers(rows.join(nested, keys, "left_semi"), side.join(nested, keys, "left_semi"), keys, closed, cuts)
        )
    outputs = {v.output for v in values}
    answer = F.col("_answer")
    return found.select(
        *[F.col(f"_row.{c}").alias(c) for c in stream.columns if c not in outputs],
        *[
            F.when(answer.isNotNull(), answer[v.name])
            .otherwise(F.lit(v.default).cast(table.schema[v.name].dataType))
            .alias(v.output)
            for v in values
        ],
    )


def _nested_keys(side: DataFrame, keys: Sequence[str], cuts: SplitPolicy) -> DataFrame | None:
    """The keys with an interval that ends before one that started earlier; None without any."""
    reach = running(side.select(*keys, "_place", "_upper"), keys, ["_place"], maxs={"_reach": F.col("_upper")}, cuts=cuts)
    nested = barrier(reach.where("_reach > _upper").select(*(keys or [F.lit(True).alias("_any")])).distinct(), "nested-keys")
    return nested if nested.take(1) else None


def _last_started_answers(rows: DataFrame, side: DataFrame, keys: Sequence[str], closed: bool, cuts: SplitPolicy) -> DataFrame:
    """Rows with their ``_answer``, for keys whose intervals end in the order in which they start.

    There, once the interval that started last has ended, all earlier ones have, so it is the only candidate.
    """
    begins = side.select(*keys, F.col("_lower").alias("_at"), F.lit(0).alias("_kind"), "_place", F.struct("_upper", "_values").alias("_last"))
    both = begins.withColumn("_spread", F.lit(0).cast("long")).unionByName(rows, allowMissingColumns=True)
    carried = running(both, keys, ["_at", "_kind", "_place", "_spread"], lasts={"_found": F.col("_last")}, cuts=cuts)
    end = F.col("_found._upper")
    holds = (F.col("_at") <= end) if closed else (F.col("_at") < end)
    return carried.where(F.col("_kind") == 1).select("_row", F.when(holds, F.col("_found._values")).alias("_answer"))


def _stretch_answers(rows: DataFrame, side: DataFrame, keys: Sequence[str], closed: bool, cuts: SplitPolicy) -> DataFrame:
    """Rows with their ``_answer``, for any intervals: the last stretch that began before the row."""
    stretches = last_started(side, keys, closed, cuts)
    # A row at a bound comes after the stretch that begins with it, and before one that begins just after it.
    begins = stretches.select(
        *keys,
        "_at",
        F.when(F.col("_after") == 0, 0).otherwise(2).alias("_kind"),
        F.lit(0).cast("long").alias("_spread"),
        F.struct("_values").alias("_stretch"),
    )
    both = begins.unionByName(rows, allowMissingColumns=True)
    carried = running(both, keys, ["_at", "_kind", "_spread"], lasts={"_found": F.col("_stretch")}, cuts=cuts)
    return carried.where(F.col("_kind") == 1).select("_row", F.col("_found._values").alias("_answer"))
