"""starloom: build star-schema warehouses with PySpark DataFrames."""

from starloom.contracts import Check, Column, DimContract, ForeignKey

__all__ = ["Check", "Column", "DimContract", "ForeignKey"]
