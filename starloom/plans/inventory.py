"""Inventory valuation: a mixed-mode product dimension, a read-only category lookup, a fact upsert."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import INSERT, PUNCH, DimContract
from starloom.functions.casting import literal
from starloom.operators.dimension import dimension_lookup, load_dimension
from starloom.operators.fact import load_fact
from starloom.operators.rows import Calculation, Condition, calculate, filter_rows, formula
from starloom.sinks.writers import written

PRODUCT = DimContract.from_modes(
    "dim_producto",
    "sk_producto",
    ["id_producto_origen"],
    {"nombre_producto": PUNCH, "precio_lista": INSERT, "precio_unitario": INSERT},
    date_from="fecha_inicio",
    date_to="fecha_fin",
)
CATEGORY = DimContract("dim_categoria", "sk_categoria", ("id_categoria_origen",), attributes_scd1=("nombre_categoria",))


def load_inventory(
    products: DataFrame,
    dim_product: DataFrame | None,
    dim_category: DataFrame,
    fact: DataFrame | None,
    at: dt.datetime,
    path: str,
) -> tuple[DataFrame, DataFrame]:
    """One run: ``products`` has cod_producto, nombre_producto, categoria, prices and stock.

    Writes the valued products, the new product dimension, then the new fact below ``path`` and
    returns the last two.
    """
    valid = filter_rows(
        products,
        Condition("precio_lista", ">=", 0),
        Condition("precio_unitario", ">=", 0),
        Condition("stock", ">=", 0),
    )
    keyed = formula(valid, "id_producto_origen", "concat(categoria, '-', cod_producto)")
    valued = calculate(
        keyed, [Calculation("valor_inventario", "MULTIPLY", "precio_unitario", "stock", type=T.DecimalType(15, 2))]
    )
    # Several steps below read these rows; they are computed once.
    valued = written(valued, f"{path}/stg_producto")
    dim = load_dimension(
        dim_product,
        valued.select("id_producto_origen", "nombre_producto", "precio_lista", "precio_unitario"),
        PRODUCT,
        at,
        at,
    )
    dim = written(dim, f"{path}/dim_producto")
    rows = valued.withColumn("_at", literal(at))
    rows = dimension_lookup(rows, dim, PRODUCT, {"id_producto_origen": "id_producto_origen"}, "_at", "fk_producto")
    rows = dimension_lookup(rows, dim_category, CATEGORY, {"categoria": "id_categoria_origen"}, "_at", "fk_categoria")
    stream = rows.select(
        F.col("id_producto_origen").alias("id_inventario_origen"), "fk_producto", "fk_categoria", "stock", "valor_inventario"
    )
    return dim, written(load_fact(fact, stream, ["id_inventario_origen"], run_time=at), f"{path}/fact_inventario")
