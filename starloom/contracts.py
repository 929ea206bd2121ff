"""Declared metadata: columns with constraints, foreign keys, dimension contracts, type names."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Validity range of an open version.
MIN_DATE = dt.datetime(1900, 1, 1)
MAX_DATE = dt.datetime(2199, 12, 31, 23, 59, 59, 999000)

# Table-name prefixes of the two layers.
STAGING_PREFIXES = ("stg_", "staging_", "tmp_", "temp_", "ods_", "raw_", "wrk_", "work_")
WAREHOUSE_PREFIXES = ("dim_", "fact_", "fct_", "hecho_", "ft_", "dwh_", "bridge_", "br_", "rel_")

# Attribute modes of a dimension load.
INSERT, UPDATE, PUNCH = "Insert", "Update", "Punch through"
ATTRIBUTE_MODES = (INSERT, UPDATE, PUNCH)
TECHNICAL_MODES = ("DateInserted", "DateUpdated", "DateInsertedOrUpdated", "LastVersion")

# Canonical and stream type names.
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "binary": T.BinaryType(),
    "unknown": T.StringType(),
    "bignumber": T.DecimalType(38, 10),
    "timestamp": T.TimestampNTZType(),
    "internet address": T.StringType(),
}


def spark_type(name: str, length: int | None = None, precision: int | None = None) -> T.DataType:
    """Spark type for a canonical or stream type name, e.g. ``spark_type("Number", 15, 2)``."""
    kind = name.strip().lower()
    if kind in ("number", "bignumber") and length is not None and length > 0:
        return T.DecimalType(length, max(precision or 0, 0))
    if kind not in SPARK_TYPES:
        raise ValueError(f"unknown type name: {name}")
    return SPARK_TYPES[kind]


def layer_of(table: str) -> str:
    """``staging``, ``dwh`` or ``unknown`` from a table name."""
    short = table.rsplit(".", 1)[-1].lower()
    if short.startswith(STAGING_PREFIXES):
        return "staging"
    return "dwh" if short.startswith(WAREHOUSE_PREFIXES) else "unknown"


@dataclass(frozen=True)
class Check:
    """A column constraint: an inclusive range, a value list, or both."""

    column: str
    minimum: float | int | None = None
    maximum: float | int | None = None
    values: tuple = ()

    @classmethod
    def compare(cls, column: str, op: str, bound: float | int, integer: bool = False) -> Check | None:
        """Constraint for ``column op bound``.

        A strict bound moves to the neighbouring integer; for other numbers there is no neighbour,
        so no constraint is produced.
        """
        if op in (">", "<") and not (integer and float(bound).is_integer()):
            return None
        if op in (">", ">="):
            return cls(column, minimum=int(bound) + 1 if op == ">" else bound)
        if op in ("<", "<="):
            return cls(column, maximum=int(bound) - 1 if op == "<" else bound)
        raise ValueError(f"unsupported comparison: {op}")


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    referenced: tuple[str, ...]


@dataclass(frozen=True)
class Column:
    """A declared column of a target table."""

    name: str
    type: T.DataType
    required: bool = False
    has_default: bool = False
    unique: bool = False
    role: str = "descriptive"


@dataclass(frozen=True)
class DimContract:
    """How one dimension table is keyed, versioned and updated."""

    table: str
    technical_key: str
    natural_keys: tuple[str, ...]
    scd_type: int = 1
    version_field: str = "version"
    date_from: str = "date_from"
    date_to: str = "date_to"
    unknown_key_value: int = 0
    attributes_scd1: tuple[str, ...] = ()
    attributes_scd2: tuple[str, ...] = ()
    attributes_punch: tuple[str, ...] = ()
    technical_columns: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.scd_type not in (0, 1, 2):
            raise ValueError(f"{self.table}: scd_type {self.scd_type} has no load behaviour")
        if not self.natural_keys:
            raise ValueError(f"{self.table}: a dimension needs a natural key")
        if self.scd_type != 2 and (self.attributes_scd2 or self.attributes_punch):
            raise ValueError(f"{self.table}: versioned attributes need scd_type 2")
        for column, mode in self.technical_columns.items():
            if mode not in TECHNICAL_MODES:
                raise ValueError(f"{self.table}.{column}: unknown technical mode {mode!r}")
        names = [*self.natural_keys, *self.attributes]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.table}: a column is declared twice")

    @classmethod
    def from_modes(
        cls, table: str, technical_key: str, natural_keys: Sequence[str], modes: Mapping[str, str], **rest
    ) -> DimContract:
        """Build a contract from ``{attribute: mode}``; an unknown mode is an error, never a default."""
        for name, mode in modes.items():
            if mode not in ATTRIBUTE_MODES:
                raise ValueError(f"{table}.{name}: unknown update mode {mode!r}")
        pick = lambda wanted: tuple(n for n, m in modes.items() if m == wanted)
        versioned = any(m != UPDATE for m in modes.values())
        return cls(
            table=table,
            technical_key=technical_key,
            natural_keys=tuple(natural_keys),
            scd_type=2 if versioned else 1,
            attributes_scd1=pick(UPDATE),
            attributes_scd2=pick(INSERT),
            attributes_punch=pick(PUNCH),
            **rest,
        )

    @property
    def attributes(self) -> tuple[str, ...]:
        return (*self.attributes_scd1, *self.attributes_scd2, *self.attributes_punch)

    @property
    def columns(self) -> tuple[str, ...]:
        return (
            self.technical_key,
            self.version_field,
            self.date_from,
            self.date_to,
            *self.natural_keys,
            *self.attributes,
            *self.technical_columns,
        )
