"""The staging layer: a faithful copy of the source plus audit columns, without business filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.casting import literal
from starloom.operators.merge import upsert

# Audit columns and the default state.
AUDIT_COLUMNS = ("stg_fecha_carga", "stg_origen", "stg_estado")
ACTIVE = "ACTIVO"


def stage(df: DataFrame, origin: str, run_time: dt.datetime) -> DataFrame:
    """Add the audit columns."""
    return df.withColumns(
        {
            "stg_fecha_carga": literal(run_time),
            "stg_origen": F.lit(origin),
            "stg_estado": F.lit(ACTIVE),
        }
    )


def stage_incremental(
    target: DataFrame, df: DataFrame, origin: str, run_time: dt.datetime, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Upsert a batch into an existing staging table."""
    return upsert(target, stage(df, origin, run_time), keys, order=order)
