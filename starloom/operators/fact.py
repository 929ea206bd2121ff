"""Fact loads and currency conversion."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import DimContract
from starloom.functions.casting import literal, utc_now
from starloom.operators.dimension import dimension_lookup
from starloom.operators.intervals import interval_lookup
from starloom.operators.joins import LookupValue
from starloom.operators.merge import incomplete, one_per_key, upsert
from starloom.operators.quality import duplicate_keys


@dataclass(frozen=True)
class DimensionRef:
    """How a fact finds one dimension: key columns, the date that counts and the output column."""

    dim: DataFrame
    contract: DimContract
    on: Mapping[str, str]
    output: str
    ref_date: str | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)


def resolve_keys(stream: DataFrame, refs: Sequence[DimensionRef], run_time: dt.datetime | None = None) -> DataFrame:
    """Add one foreign key per dimension; a miss is the unknown member, never a lost row."""
    for ref in refs:
        stream = dimension_lookup(
            stream, ref.dim, ref.contract, ref.on, ref.ref_date, ref.output, ref.attributes, run_time
        )
    return stream


def load_fact(
    fact: DataFrame | None,
    stream: DataFrame,
    grain: Sequence[str],
    order: Sequence[str] = (),
    run_time: dt.datetime | None = None,
    loaded_at: str = "dwh_fecha_carga",
) -> DataFrame:
    """Upsert on the degenerate key of the declared grain, so loading a period twice changes nothing.

    With an ``order``, repeated keys in the stream act one after another. Without one, keys must be
    unique: an upsert fails if they are not, and a first load is checked with :func:`checked_grain`
    once it is written.
    """
    now = literal(run_time or utc_now())
    incoming = stream.withColumn(loaded_at, now)
    if fact is not None:
        return upsert(fact, incoming, grain, order=order)
    if not order:
        return incoming
    values = [c for c in incoming.columns if c not in grain]
    whole = one_per_key(incoming, grain, [], values, order).select(*incoming.columns)
    return whole.unionByName(incomplete(incoming, grain))


class GrainViolation(RuntimeError):
    pass


def checked_grain(fact: DataFrame, grain: Sequence[str]) -> DataFrame:
    """The written fact itself, after counting rows per key; reads the key columns only."""
    complete = fact.dropna(how="any", subset=list(grain))
    repeated = duplicate_keys(complete, grain).take(1)
    if repeated:
        raise GrainViolation(f"several rows for one key: {repeated[0].asDict()}")
    return fact


def convert_currency(
    df: DataFrame,
    amount: str,
    currency: str,
    at: str,
    rates: DataFrame,
    output: str,
    scale: int = 2,
) -> DataFrame:
    """Multiply by the latest rate not after ``at`` and keep the rate as ``tasa_cambio_aplicada``.

    ``rates`` has (currency, date, rate), unique per currency and date. Without a rate both columns
    are NULL.
    """
    name, date, rate = rates.columns
    # Open-ended: of the rates that hold, the lookup takes the one that starts last.
    spans = rates.select(
        name,
        date,
        literal(dt.datetime(9999, 12, 31)).cast(rates.schema[date].dataType).alias("_ends"),
        F.col(rate).cast(T.DecimalType(18, 8)).alias("_rate"),
    )
    found = interval_lookup(
        df, spans, {currency: name}, at, date, "_ends", [LookupValue("_rate", "tasa_cambio_aplicada")]
    )
    converted = F.try_multiply(F.col(amount).try_cast(T.DecimalType(18, 4)), F.col("tasa_cambio_aplicada"))
    return found.withColumn(output, converted.try_cast(T.DecimalType(20, scale)))
