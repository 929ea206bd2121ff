"""Text-to-type conversion as column functions. Bad input gives NULL, never an error."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted date layouts and their Spark patterns.
DATE_LAYOUTS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "DD/MM/YYYY": "dd/MM/yyyy",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "YYYY/MM/DD": "yyyy/MM/dd",
    "DD-MM-YYYY": "dd-MM-yyyy",
    "YYYY-MM-DDTHH:MM:SS": "yyyy-MM-dd'T'HH:mm:ss",
    "YYYY-MM-DD HH:MM:SS": "yyyy-MM-dd HH:mm:ss",
}


def literal(value: object) -> Column:
    """A literal; a datetime is wall-clock time, whatever zone the session or the machine is in."""
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def parse_date(value: Column, layout: str = "YYYY-MM-DD") -> Column:
    """Text to date."""
    return F.try_to_date(F.trim(value), DATE_LAYOUTS[layout])


def parse_datetime(value: Column, layout: str = "YYYY-MM-DD HH:MM:SS") -> Column:
    """Text to a timestamp without time zone."""
    return F.try_to_timestamp(F.trim(value), F.lit(DATE_LAYOUTS[layout])).cast("timestamp_ntz")


def format_date(value: Column, layout: str = "YYYY-MM-DD") -> Column:
    """Date or timestamp to text."""
    return F.date_format(value, DATE_LAYOUTS[layout])


def parse_decimal_comma(
    value: Column, precision: int = 15, scale: int = 2, decimal: str = ",", group: str = ".", currency: str = "€"
) -> Column:
    """``"€ 1.234,56"`` to a decimal."""
    plain = F.trim(value)
    for noise in (currency, group):
        if noise:
            plain = F.replace(plain, F.lit(noise), F.lit(""))
    plain = F.replace(F.trim(plain), F.lit(decimal), F.lit("."))
    return plain.try_cast(T.DecimalType(precision, scale))


def parse_boolean(value: Column) -> Column:
    """Yes/no words and 1/0 to boolean."""
    word = F.lower(F.trim(value.cast("string")))
    return (
        F.when(word.isin("true", "yes", "y", "1", "si", "sí", "s"), F.lit(True))
        .when(word.isin("false", "no", "n", "0"), F.lit(False))
    )


def cast_to(value: Column, source: T.DataType, target: T.DataType, layout: str | None = None) -> Column:
    """Convert a column to ``target``; text dates follow ``layout``."""
    if source == target:
        return value
    if isinstance(source, T.StringType):
        if isinstance(target, T.DateType):
            return parse_date(value, layout or "YYYY-MM-DD")
        if isinstance(target, (T.TimestampType, T.TimestampNTZType)):
            return parse_datetime(value, layout or "YYYY-MM-DD HH:MM:SS")
        if isinstance(target, T.BooleanType):
            return parse_boolean(value)
        return F.trim(value).try_cast(target) if isinstance(target, T.NumericType) else value.try_cast(target)
    if isinstance(target, T.StringType) and layout:
        return format_date(value, layout)
    if isinstance(source, T.BooleanType) and isinstance(target, T.StringType):
        return value.cast(target)
    return value.try_cast(target)


def money(value: Column, target: T.DataType) -> Column:
    """Bring an amount to the precision and scale its target column declares."""
    if not isinstance(target, T.DecimalType):
        raise ValueError("a money column needs a decimal target with explicit scale")
    return value.try_cast(target)


def to_utc(value: Column, zone: str) -> Column:
    """Local wall-clock timestamp to UTC, both without time zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), value.cast("timestamp_ntz"))
