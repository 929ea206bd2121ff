"""Split a table by a bitmap of a batch's keys, without shuffling the table.

A batch's keys set bits of a bitmap, one per key. A table row whose bit is clear has a key that the batch lacks for
certain; the others may have one of its keys. The bitmap has a fixed largest size, so it can be broadcast
whatever the batch holds: a larger batch makes more false hits, never a miss.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.session import barrier

#: Bits per distinct key, so that about one other key in sixty is a false hit.
BITS_PER_KEY = 64
#: The largest bitmap: 64 MB.
MOST_BITS = 1 << 29
#: Bits in one binary value of ``bitmap_construct_agg``.
_SEGMENT = 1 << 15


def _bit(keys: Sequence[str], bits: int) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys]).bitwiseAND(F.lit(bits - 1))


def key_bitmap(batch: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(segments (_segment, _bits) of at most 4 KB each, bits in all) for the complete keys of ``batch``."""
    present = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = batch.where(present).select(*keys)
    count = rows.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    bits = _SEGMENT
    while bits < MOST_BITS and bits < BITS_PER_KEY * count:
        bits *= 2
    bit = _bit(keys, bits)
    segments = rows.select(F.shiftright(bit, 15).alias("_segment"), bit.bitwiseAND(F.lit(_SEGMENT - 1)).alias("_at"))
    return barrier(segments.groupBy("_segment").agg(F.bitmap_construct_agg("_at").alias("_bits")), "key-bitmap"), bits


def split_by_keys(
    table: DataFrame, batch: DataFrame, keys: Sequence[str], batch_keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of ``batch``, rows that have none) of ``table``, each from one pass without a shuffle.

    Both key lists have the same types. Rows with a NULL in their key are in the second part.
    """
    own = batch.select(*[F.col(b).cast(table.schema[k].dataType).alias(k) for b, k in zip(batch_keys or keys, keys, strict=True)])
    segments, bits = key_bitmap(own, keys)
    bit = _bit(keys, bits)
    inside = bit.bitwiseAND(F.lit(_SEGMENT - 1))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    present = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    hit = F.coalesce(F.getbit(byte, inside.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False)) & present
    # At most MOST_BITS / 8 bytes.
    marked = table.withColumn("_segment_of", F.shiftright(bit, 15)).join(
        F.broadcast(segments), F.col("_segment_of") == F.col("_segment"), "left"
    )
    return marked.where(hit).select(*table.columns), marked.where(~hit).select(*table.columns)
