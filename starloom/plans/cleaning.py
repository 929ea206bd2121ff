"""Cleaning rules for a sales feed, from raw rows to rows ready to load."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.casting import to_utc
from starloom.functions.masking import mask_generic
from starloom.operators.rows import Condition, empty_as, filter_rows, if_null, latest_rows

# Fixed value: text that holds an e-mail address or a long number counts as personal.
PERSONAL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z]+|[0-9]{7,}"


def clean_sales(sales: DataFrame, year: int, zone: str) -> DataFrame:
    """``sales`` has id_venta, fecha, monto, id_cliente, descripcion and nro (a tie-breaker).

    Positive amounts of one year; unknown customers become -1; dates go to UTC; empty descriptions
    get a text and personal ones are masked; the latest row per sale is kept.
    """
    kept = filter_rows(
        sales,
        Condition("monto", ">", 0),
        Condition("fecha", ">=", dt.datetime(year, 1, 1)),
        Condition("fecha", "<", dt.datetime(year + 1, 1, 1)),
    )
    kept = if_null(kept, {"id_cliente": -1})
    kept = empty_as(kept, "descripcion", "SIN DESCRIPCION")
    kept = latest_rows(kept, ["id_venta"], ["fecha", "nro"])
    text = F.col("descripcion")
    return kept.withColumns(
        {
            "fecha": to_utc(F.col("fecha"), zone),
            "descripcion": F.when(text.rlike(PERSONAL), mask_generic(text)).otherwise(text),
        }
    )
