"""Sales star: staging, customer and product dimensions, calendar, fact, and a monthly mart."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import DimContract
from starloom.functions.casting import money
from starloom.functions.text import normalise
from starloom.operators.aggregate import frequency_segment
from starloom.operators.dimension import calendar_for, date_key, load_dimension, seed_unknown
from starloom.operators.fact import DimensionRef, checked_grain, load_fact, resolve_keys
from starloom.operators.joins import LookupValue, merge_join, stream_lookup
from starloom.operators.rows import Condition, filter_rows
from starloom.sinks.writers import written
from starloom.sources.staging import stage

CUSTOMER = DimContract(
    "dim_cliente", "sk_cliente", ("id_cliente_origen",), attributes_scd1=("nombre", "segmento", "pais", "frecuencia")
)
PRODUCT = DimContract(
    "dim_producto", "sk_producto", ("id_producto_origen",), attributes_scd1=("descripcion", "marca", "tipo")
)
AMOUNT, RATE = T.DecimalType(15, 2), T.DecimalType(5, 4)
# The source numbers lines more than once per order, so the grain needs all of these.
GRAIN = ("id_orden", "nro_linea", "id_producto", "id_proveedor", "fecha_envio")


@dataclass(frozen=True)
class SalesStar:
    customers: DataFrame
    products: DataFrame
    calendar: DataFrame
    fact: DataFrame


def build_sales_star(
    customer: DataFrame,
    nation: DataFrame,
    part: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    run_time: dt.datetime,
    path: str,
) -> SalesStar:
    """Run the whole process once and write the star below ``path``, dimensions before the fact."""
    staged = {
        name: stage(df, f"erp.{name}", run_time)
        for name, df in {"customer": customer, "nation": nation, "part": part, "orders": orders, "lineitem": lineitem}.items()
    }
    frequency = frequency_segment(staged["orders"], "o_custkey")
    people = stream_lookup(
        staged["customer"], staged["nation"], {"c_nationkey": "n_nationkey"},
        [LookupValue("n_name", "pais", "DESCONOCIDO")], ["n_name"],
    )
    people = stream_lookup(
        people, frequency, {"c_custkey": "o_custkey"}, [LookupValue("segment", "frecuencia", "REGULAR")], ["segment"]
    )
    people = people.select(
        F.col("c_custkey").alias("id_cliente_origen"),
        normalise(F.col("c_name"), case="title").alias("nombre"),
        normalise(F.col("c_mktsegment"), case="upper").alias("segmento"),
        F.upper("pais").alias("pais"),
        "frecuencia",
    )
    people = written(people, f"{path}/stg_cliente")
    goods = staged["part"].select(
        F.col("p_partkey").alias("id_producto_origen"),
        F.col("p_name").alias("descripcion"),
        F.col("p_brand").alias("marca"),
        F.col("p_type").alias("tipo"),
    )
    customers = load_dimension(None, people, CUSTOMER, run_time, run_time)
    customers = seed_unknown(customers, CUSTOMER, ["id_cliente_origen", "nombre", "segmento"])
    customers = written(customers, f"{path}/dim_cliente")
    products = load_dimension(None, goods, PRODUCT, run_time, run_time)
    products = seed_unknown(products, PRODUCT, ["id_producto_origen", "descripcion"])
    products = written(products, f"{path}/dim_producto")

    sold = filter_rows(
        staged["lineitem"], Condition("l_quantity", ">", 0), Condition("l_extendedprice", ">", 0)
    ).select(
        F.col("l_orderkey").alias("id_orden"),
        F.col("l_linenumber").alias("nro_linea"),
        F.col("l_partkey").alias("id_producto"),
        F.col("l_suppkey").alias("id_proveedor"),
        F.col("l_shipdate").alias("fecha_envio"),
        F.col("l_quantity").cast("decimal(12,2)").alias("cantidad"),
        money(
            F.col("l_extendedprice").cast(AMOUNT) * (F.lit(1).cast(RATE) - F.col("l_discount").cast(RATE)), AMOUNT
        ).alias("monto_total"),
    )
    headers = staged["orders"].select(
        F.col("o_orderkey").alias("orden"),
        F.col("o_custkey").alias("id_cliente"),
        F.col("o_orderdate").alias("fecha"),
        date_key("o_orderdate").alias("fk_tiempo"),
    )
    # The customer is looked up per order, before orders meet their lines.
    by_customer = DimensionRef(
        customers, CUSTOMER, {"id_cliente": "id_cliente_origen"}, "fk_cliente", "fecha", {"segmento": "segmento"}
    )
    by_product = DimensionRef(products, PRODUCT, {"id_producto": "id_producto_origen"}, "fk_producto", "fecha")
    headers = resolve_keys(headers, [by_customer]).drop("id_cliente")
    lines = merge_join(sold, headers, ["id_orden"], ["orden"]).drop("orden")
    keyed = resolve_keys(lines, [by_product])
    fact = written(load_fact(None, keyed, GRAIN, run_time=run_time), f"{path}/fact_ventas")
    return SalesStar(customers, products, calendar_for(orders, "o_orderdate"), checked_grain(fact, GRAIN))


def revenue_by_segment_and_month(star: SalesStar) -> DataFrame:
    """The mart: revenue, quantity and lines per customer segment and calendar month."""
    days = star.calendar.select(F.col("sk_tiempo").alias("fk_tiempo"), "anio", "mes")
    # Lines are summed per day and segment first, so the calendar joins a small table.
    daily = star.fact.groupBy("segmento", "fk_tiempo").agg(
        F.sum("monto_total").alias("monto"), F.sum("cantidad").alias("cantidad"), F.count(F.lit(1)).alias("n_lineas")
    )
    return (
        daily.join(days, "fk_tiempo")
        .groupBy("segmento", "anio", "mes")
        .agg(
            F.sum("monto").cast("double").alias("monto_total"),
            F.sum("cantidad").cast("double").alias("cantidad"),
            F.sum("n_lineas").alias("n_lineas"),
        )
    )
