"""All registered queries."""

from starloom.queries import joins, loads, quality, rows, warehouse  # noqa: F401  (registers)
from starloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
