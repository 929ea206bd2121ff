"""Queries for dimension and fact loads and the complete processes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from starloom.contracts import INSERT, PUNCH, UPDATE, DimContract
from starloom.functions.casting import literal
from starloom.operators import dimension, fact, profiling
from starloom.operators.joins import union_streams
from starloom.operators.sequence import with_index
from starloom.plans import cleaning, inventory, sales
from starloom.queries.registry import day, moment, query, table
from starloom.session import barrier, scratch_path
from starloom.sinks.writers import written

D1, D2, D3 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)
RUN1, RUN2 = dt.datetime(2024, 1, 1, 6, 0), dt.datetime(2024, 2, 1, 6, 0)
LOW, HIGH = "'1900-01-01 00:00:00.000'", "'2199-12-31 23:59:59.999'"
S2, S3 = "'2024-02-01 00:00:00.000'", "'2024-03-01 00:00:00.000'"


def _contract(**modes) -> DimContract:
    return DimContract.from_modes("dim_cliente", "sk_cliente", ["id_cliente"], modes)


def first_batch(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id_cliente"), F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("segmento")
    )


def second_batch(spark, sf):
    """All customers again: names and segments of some have changed. Suppliers are new keys."""
    balance = F.col("c_acctbal")
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id_cliente"),
        F.when((balance > 9000) | (balance < -500), F.upper("c_name")).otherwise(F.col("c_name")).alias("nombre"),
        F.when(balance < 0, F.lit("AT RISK")).otherwise(F.col("c_mktsegment")).alias("segmento"),
    )
    suppliers = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("id_cliente"),
        F.col("s_name").alias("nombre"),
        F.lit("SUPPLIER").alias("segmento"),
    )
    return union_streams(customers, suppliers)


BATCHES = """b1 AS (SELECT c_custkey AS id_cliente, c_name AS nombre, c_mktsegment AS segmento FROM customer),
  b2 AS (SELECT c_custkey AS id_cliente,
                CASE WHEN c_acctbal > 9000 OR c_acctbal < -500 THEN upper(c_name) ELSE c_name END AS nombre,
                CASE WHEN c_acctbal < 0 THEN 'AT RISK' ELSE c_mktsegment END AS segmento FROM customer
         UNION ALL SELECT s_suppkey + 1000000000, s_name, 'SUPPLIER' FROM supplier),
  n AS (SELECT count(*) AS n FROM customer)"""


def _shown(dim):
    return dim.withColumns(
        {"version": F.col("version").cast("int"), "date_from": moment("date_from"), "date_to": moment("date_to")}
    )


def _load(spark, dim, stage, contract, at, run_time):
    """Load and write the dimension, as the next step reads it."""
    return written(dimension.load_dimension(dim, stage, contract, at, run_time), scratch_path(spark, contract.table))


def _two_batches(spark, sf, contract):
    first = _load(spark, None, first_batch(spark, sf), contract, D1, RUN1)
    return dimension.load_dimension(first, second_batch(spark, sf), contract, D2, RUN2)


def _two_batch_sql(opens: str, old_name: str, extra: str = "") -> str:
    """Versions after two batches. ``opens`` tells when a key gets a second version, ``old_name``
    is the name its first version shows then."""
    return f"""WITH {BATCHES},
      merged AS (SELECT b2.*, b1.id_cliente IS NULL AS fresh, b1.nombre AS nombre1, b1.segmento AS segmento1,
                      b1.id_cliente IS NOT NULL AND ({opens}) AS opens
               FROM b2 LEFT JOIN b1 USING (id_cliente)),
      added AS (SELECT *, (SELECT n FROM n) + row_number() OVER (ORDER BY id_cliente) AS sk FROM merged WHERE fresh OR opens),
      kept AS (SELECT *, row_number() OVER (ORDER BY id_cliente) AS sk FROM merged WHERE NOT fresh)
      SELECT sk AS sk_cliente, CAST(1 AS INTEGER) AS version, {LOW} AS date_from,
             CASE WHEN opens THEN {S2} ELSE {HIGH} END AS date_to, id_cliente,
             CASE WHEN opens THEN {old_name} ELSE nombre END AS nombre,
             CASE WHEN opens THEN segmento1 ELSE segmento END AS segmento{extra.format(new='false')} FROM kept
      UNION ALL
      SELECT sk, CAST(CASE WHEN fresh THEN 1 ELSE 2 END AS INTEGER), CASE WHEN fresh THEN {LOW} ELSE {S2} END, {HIGH},
             id_cliente, nombre, segmento{extra.format(new='true')} FROM added"""


@query("dim_scd1", _two_batch_sql("false", "nombre"))
def dim_scd1(spark, sf):
    return _shown(_two_batches(spark, sf, _contract(nombre=UPDATE, segmento=UPDATE)))


@query("dim_scd2", _two_batch_sql("b2.nombre <> b1.nombre OR b2.segmento <> b1.segmento", "nombre1"))
def dim_scd2(spark, sf):
    return _shown(_two_batches(spark, sf, _contract(nombre=INSERT, segmento=INSERT)))


@query("dim_mixed", _two_batch_sql("b2.segmento <> b1.segmento", "nombre1"))
def dim_mixed(spark, sf):
    return _shown(_two_batches(spark, sf, _contract(nombre=UPDATE, segmento=INSERT)))


@query("dim_punch_through", _two_batch_sql("b2.segmento <> b1.segmento", "nombre"))
def dim_punch_through(spark, sf):
    return _shown(_two_batches(spark, sf, _contract(nombre=PUNCH, segmento=INSERT)))


STAMPS = """, '2024-01-01 06:00:00.000' AS inserted,
      CASE WHEN opens OR nombre <> nombre1 OR segmento <> segmento1 THEN '2024-02-01 06:00:00.000' END AS updated,
      CASE WHEN opens OR nombre <> nombre1 OR segmento <> segmento1 THEN '2024-02-01 06:00:00.000' ELSE '2024-01-01 06:00:00.000' END AS touched,
      NOT opens AS is_last"""
FRESH_STAMPS = ", '2024-02-01 06:00:00.000', NULL, '2024-02-01 06:00:00.000', true"


@query(
    "dim_tech_columns",
    _two_batch_sql("b2.segmento <> b1.segmento", "nombre1", "/*{new}*/")
    .replace("/*false*/", STAMPS)
    .replace("/*true*/", FRESH_STAMPS),
)
def dim_tech_columns(spark, sf):
    contract = DimContract.from_modes(
        "dim_cliente", "sk_cliente", ["id_cliente"], {"nombre": UPDATE, "segmento": INSERT},
        technical_columns={
            "inserted": "DateInserted", "updated": "DateUpdated", "touched": "DateInsertedOrUpdated", "is_last": "LastVersion",
        },
    )
    dim = _shown(_two_batches(spark, sf, contract))
    return dim.withColumns({n: moment(n) for n in ("inserted", "updated", "touched")})


@query(
    "dim_multi_batch",
    f"""WITH {BATCHES},
        stage AS (SELECT *, TIMESTAMP '2024-01-01' AS dia FROM b1 UNION ALL SELECT *, TIMESTAMP '2024-02-01' FROM b2
                  UNION ALL SELECT id_cliente, nombre, CASE WHEN nombre = upper(nombre) THEN 'UPPER' ELSE segmento END, TIMESTAMP '2024-03-01' FROM b2),
        flagged AS (SELECT *, CASE WHEN lag(segmento) OVER w IS NULL OR lag(segmento) OVER w <> segmento THEN 1 ELSE 0 END AS opens
                    FROM stage WINDOW w AS (PARTITION BY id_cliente ORDER BY dia)),
        numbered AS (SELECT *, sum(opens) OVER (PARTITION BY id_cliente ORDER BY dia) AS version FROM flagged),
        versions AS (SELECT id_cliente, CAST(version AS INTEGER) AS version, min(dia) AS dia, arg_max(nombre, dia) AS nombre,
                            any_value(segmento) AS segmento FROM numbered GROUP BY id_cliente, version)
        SELECT row_number() OVER (ORDER BY id_cliente, version) AS sk_cliente, version,
               CASE WHEN version = 1 THEN {LOW} ELSE strftime(dia, '%Y-%m-%d %H:%M:%S.%g') END AS date_from,
               coalesce(strftime(lead(dia) OVER (PARTITION BY id_cliente ORDER BY version), '%Y-%m-%d %H:%M:%S.%g'), {HIGH}) AS date_to,
               id_cliente, nombre, segmento FROM versions""",
)
def dim_multi_batch(spark, sf):
    """Three batches in one load; each key may open several versions at once."""
    second = second_batch(spark, sf)
    upper = F.when(F.col("nombre") == F.upper("nombre"), F.lit("UPPER")).otherwise(F.col("segmento"))
    dated = lambda df, at: df.withColumn("at", literal(at))
    stage = union_streams(
        dated(first_batch(spark, sf), D1), dated(second, D2), dated(second.withColumn("segmento", upper), D3)
    )
    return _shown(dimension.load_dimension(None, stage, _contract(nombre=UPDATE, segmento=INSERT), "at", RUN1))


# -- lookups and members -------------------------------------------------------------------------


def _history(spark, sf):
    """Customers in credit, with a version opened in 1998 for the large accounts."""
    customers = table(spark, sf, "customer").where("c_acctbal > 0")
    batch = lambda segment, at: customers.select(
        F.col("c_custkey").alias("id_cliente"), F.col("c_name").alias("nombre"), segment.alias("segmento"),
        literal(at).alias("at"),
    )
    old = batch(F.col("c_mktsegment"), dt.datetime(1995, 1, 1))
    new = batch(F.when(F.col("c_acctbal") > 5000, F.lit("LARGE")).otherwise(F.col("c_mktsegment")), dt.datetime(1998, 7, 1))
    contract = _contract(nombre=UPDATE, segmento=INSERT)
    return _load(spark, None, union_streams(old, new), contract, "at", RUN1), contract


HISTORY = """versions AS (
    SELECT c_custkey, 1 AS version, TIMESTAMP '1900-01-01' AS lo,
           CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '1998-07-01' ELSE TIMESTAMP '2199-12-31' END AS hi, c_mktsegment AS segmento
    FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT c_custkey, 2, TIMESTAMP '1998-07-01', TIMESTAMP '2199-12-31', 'LARGE' FROM customer WHERE c_acctbal > 5000),
  dim AS (SELECT *, row_number() OVER (ORDER BY c_custkey, version) AS sk FROM versions)"""


@query(
    "dim_lookup_asof",
    f"""WITH {HISTORY} SELECT o_orderkey, coalesce(sk, 0) AS sk_cliente, segmento FROM orders
        LEFT JOIN dim ON c_custkey = o_custkey AND o_orderdate >= lo AND o_orderdate < hi""",
)
def dim_lookup_asof(spark, sf):
    dim, contract = _history(spark, sf)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    found = dimension.dimension_lookup(
        orders, dim, contract, {"o_custkey": "id_cliente"}, "o_orderdate", attributes={"segmento": "segmento"}
    )
    return found.select("o_orderkey", "sk_cliente", "segmento")


@query(
    "dim_lookup_run_date",
    f"""WITH {HISTORY} SELECT o_orderkey, coalesce(sk, 0) AS sk_cliente FROM orders
        LEFT JOIN dim ON c_custkey = o_custkey AND hi = TIMESTAMP '2199-12-31'""",
)
def dim_lookup_run_date(spark, sf):
    dim, contract = _history(spark, sf)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return dimension.dimension_lookup(orders, dim, contract, {"o_custkey": "id_cliente"}, run_time=RUN1).select(
        "o_orderkey", "sk_cliente"
    )


@query(
    "seed_unknown",
    f"""SELECT row_number() OVER (ORDER BY c_custkey) AS sk_cliente, CAST(1 AS INTEGER) AS version, {LOW} AS date_from,
               {HIGH} AS date_to, c_custkey AS id_cliente, c_name AS nombre, c_mktsegment AS segmento FROM customer
        UNION ALL SELECT 0, 1, {LOW}, {HIGH}, 0, 'DESCONOCIDO', NULL""",
)
def seed_unknown(spark, sf):
    contract = _contract(nombre=UPDATE, segmento=UPDATE)
    dim = dimension.load_dimension(None, first_batch(spark, sf), contract, D1, RUN1)
    once = dimension.seed_unknown(dim, contract, ["id_cliente", "nombre"])
    return _shown(dimension.seed_unknown(once, contract, ["id_cliente", "nombre"]))


@query(
    "inferred_member",
    """WITH rows AS (
         SELECT c_custkey AS id_cliente, c_name AS nombre, 'N' AS inferred_member FROM customer WHERE c_acctbal > 0
         UNION ALL SELECT DISTINCT o_custkey, 'DESCONOCIDO', 'Y' FROM orders
         WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
       SELECT row_number() OVER (ORDER BY id_cliente) AS sk_cliente, * FROM rows""",
)
def inferred_member(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("id_cliente"), F.col("c_name").alias("nombre"), F.lit("N").alias("inferred_member")
    )
    orphans = dimension.inferred_members(
        table(spark, sf, "orders"), known, {"o_custkey": "id_cliente"}, {"nombre": F.lit("DESCONOCIDO")}
    )
    contract = _contract(nombre=UPDATE, inferred_member=UPDATE)
    dim = dimension.load_dimension(None, union_streams(known, orphans), contract, D1, RUN1)
    return dim.select("sk_cliente", "id_cliente", "nombre", "inferred_member")


@query(
    "junk_dim",
    """WITH combos AS (SELECT l_returnflag, l_linestatus, count(*) AS n_lines FROM lineitem GROUP BY ALL)
       SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus) AS sk_flags, * FROM combos""",
)
def junk_dim(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    keys = ["l_returnflag", "l_linestatus"]
    # Loaded in two steps; the second finds every combination already there.
    dim = written(dimension.load_junk_dimension(None, lines, keys, "sk_flags"), scratch_path(spark, "dim_flags"))
    dim = dimension.load_junk_dimension(dim, lines, keys, "sk_flags")
    per_key = dimension.lookup_junk_key(lines, dim, keys, "sk_flags").groupBy("sk_flags").agg(F.count("*").alias("n_lines"))
    return dim.join(per_key, "sk_flags")


@query(
    "surrogate_keys",
    "SELECT p_partkey, p_brand, 5000 + row_number() OVER (ORDER BY p_brand, p_partkey) AS sk_part FROM part",
)
def surrogate_keys(spark, sf):
    return with_index(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"], "sk_part", 5001)


@query(
    "dim_calendar",
    """WITH days AS (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders),
                                                        INTERVAL 1 DAY)) AS DATE) AS d)
       SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS sk_tiempo, strftime(d, '%Y-%m-%d') AS fecha, CAST(year(d) AS INTEGER) AS anio,
              CAST(quarter(d) AS INTEGER) AS trimestre, CAST(month(d) AS INTEGER) AS mes,
              ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][month(d)] AS nombre_mes,
              CAST(day(d) AS INTEGER) AS dia, CAST(isodow(d) AS INTEGER) AS dia_semana,
              ['lunes','martes','miércoles','jueves','viernes','sábado','domingo'][isodow(d)] AS nombre_dia_semana,
              isodow(d) >= 6 AS es_fin_de_semana FROM days""",
)
def dim_calendar(spark, sf):
    return dimension.calendar_for(table(spark, sf, "orders"), "o_orderdate").withColumn("fecha", day("fecha"))


# -- facts ---------------------------------------------------------------------------------------


@query(
    "fact_load",
    f"""WITH {HISTORY}
        SELECT l_orderkey AS id_orden, l_linenumber AS nro_linea, l_partkey AS id_producto, l_suppkey AS id_proveedor,
               strftime(l_shipdate, '%Y-%m-%d') AS fecha_envio, coalesce(sk, 0) AS fk_cliente, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS importe,
               CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN '2024-02-01 06:00:00.000' ELSE '2024-01-01 06:00:00.000' END AS dwh_fecha_carga
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        LEFT JOIN dim ON c_custkey = o_custkey AND o_orderdate >= lo AND o_orderdate < hi""",
)
def fact_load(spark, sf):
    """Two loads that overlap by a year: the second updates those lines and adds the later ones."""
    dim, contract = _history(spark, sf)
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id_orden"), F.col("l_linenumber").alias("nro_linea"),
        F.col("l_partkey").alias("id_producto"), F.col("l_suppkey").alias("id_proveedor"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("importe"), F.col("l_shipdate").alias("fecha_envio"),
    )
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id_orden"), "o_custkey", "o_orderdate")
    refs = [fact.DimensionRef(dim, contract, {"o_custkey": "id_cliente"}, "fk_cliente", "o_orderdate")]
    # The customer is looked up once per order that has lines and written, before orders meet the lines of either load.
    ordered = orders.join(lines.select("id_orden"), "id_orden", "left_semi")
    headers = barrier(fact.resolve_keys(ordered, refs).drop("o_custkey", "o_orderdate"), "headers")
    keyed = lines.join(headers, "id_orden")
    grain = ["id_orden", "nro_linea", "id_producto", "id_proveedor", "fecha_envio"]
    early = keyed.where("fecha_envio < TIMESTAMP_NTZ '1999-01-01'")
    late = keyed.where("fecha_envio >= TIMESTAMP_NTZ '1998-01-01'")
    first = written(fact.load_fact(None, early, grain, run_time=RUN1), scratch_path(spark, "fact"))
    first = fact.checked_grain(first, grain)
    loaded = fact.load_fact(first, late, grain, run_time=RUN2)
    return loaded.select(
        *grain[:-1], day("fecha_envio").alias("fecha_envio"), "fk_cliente", F.col("importe").cast("string").alias("importe"),
        moment("dwh_fecha_carga").alias("dwh_fecha_carga"),
    )


RATES = [
    ("USD", "1995-01-01", 1.0), ("USD", "1997-06-01", 1.05), ("USD", "1999-03-01", 1.1),
    ("EUR", "1996-01-01", 1.25), ("EUR", "1998-01-01", 1.125), ("EUR", "2000-01-01", 0.9375),
    ("BRL", "1995-01-01", 0.5), ("BRL", "1999-02-01", 0.25), ("BRL", "2000-06-01", 0.125),
    ("ARS", "1995-01-01", 0.75), ("ARS", "1996-01-01", 0.625), ("ARS", "2001-01-01", 0.375),
]
MONEDA = "CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'EUR' WHEN '3-MEDIUM' THEN 'BRL' WHEN '5-LOW' THEN 'ARS' ELSE 'JPY' END"


@query(
    "currency_convert",
    f"""WITH rates(moneda, fecha, tasa) AS (VALUES {', '.join(f"('{c}', TIMESTAMP '{d}', CAST({r} AS DECIMAL(18,8)))" for c, d, r in RATES)}),
        spans AS (SELECT *, lead(fecha) OVER (PARTITION BY moneda ORDER BY fecha) AS ends FROM rates),
        o AS (SELECT *, {MONEDA} AS m FROM orders)
        SELECT o_orderkey, m AS moneda_origen, CAST(tasa AS DOUBLE) AS tasa_cambio_aplicada,
               CAST(CAST(CAST(o_totalprice AS DECIMAL(18,4)) * tasa AS DECIMAL(20,2)) AS DOUBLE) AS importe_usd
        FROM o LEFT JOIN spans ON moneda = m AND o_orderdate >= fecha AND (ends IS NULL OR o_orderdate < ends)""",
)
def currency_convert(spark, sf):
    rates = spark.createDataFrame(RATES, "moneda string, fecha string, tasa double").withColumn(
        "fecha", F.col("fecha").cast("timestamp_ntz")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.expr(MONEDA).alias("moneda_origen"))
    out = fact.convert_currency(orders, "o_totalprice", "moneda_origen", "o_orderdate", rates, "importe_usd")
    return out.select(
        "o_orderkey", "moneda_origen", F.col("tasa_cambio_aplicada").cast("double").alias("tasa_cambio_aplicada"),
        F.col("importe_usd").cast("double").alias("importe_usd"),
    )


def _candidate_sql(name: str, key: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", 'undecided' AS verdict, '{c}' AS attribute, count(DISTINCT {c}) AS distinct_count,
            count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) < 0.95 * count(*) AS candidate FROM {name}"""
        for c in columns
    )


@query(
    "scd_candidates",
    _candidate_sql("customer", "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    + " UNION ALL "
    + _candidate_sql("part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
)
def scd_candidates(spark, sf):
    both = [
        profiling.history_candidates(table(spark, sf, name), name, [key])
        for name, key in (("customer", "c_custkey"), ("part", "p_partkey"))
    ]
    return union_streams(*both).drop("forced_scd_type", "evidence")


# -- processes -----------------------------------------------------------------------------------


@query(
    "sales_star",
    """SELECT upper(c_mktsegment) AS segmento, CAST(year(o_orderdate) AS INTEGER) AS anio, CAST(month(o_orderdate) AS INTEGER) AS mes,
              CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (CAST(1 AS DECIMAL(5,4)) - CAST(l_discount AS DECIMAL(5,4))) AS DECIMAL(15,2))) AS DOUBLE) AS monto_total,
              sum(l_quantity) AS cantidad, count(*) AS n_lineas
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY ALL""",
)
def sales_star(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("customer", "nation", "part", "orders", "lineitem")}
    star = sales.build_sales_star(**tables, run_time=RUN1, path=scratch_path(spark, "star"))
    return sales.revenue_by_segment_and_month(star)


@query(
    "inventory_star",
    """WITH lines AS (SELECT l_partkey, min(CAST(l_extendedprice AS DECIMAL(15,2))) AS unit, CAST(sum(l_quantity) AS BIGINT) AS stock FROM lineitem GROUP BY 1),
       base AS (SELECT p_partkey, p_brand, p_size, p_brand || '-' || CAST(p_partkey AS VARCHAR) AS id, CAST(p_retailprice AS DECIMAL(15,2)) AS price, unit, stock
                FROM part JOIN lines ON l_partkey = p_partkey),
       keys1 AS (SELECT id, row_number() OVER (ORDER BY id) AS sk FROM base WHERE p_size > 5),
       keys2 AS (SELECT id, (SELECT count(*) FROM keys1) + row_number() OVER (ORDER BY id) AS sk FROM base WHERE p_size <= 5 OR p_size > 40),
       cats AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS sk FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 50))
       SELECT base.id AS id_inventario_origen, coalesce(keys2.sk, keys1.sk) AS fk_producto, coalesce(cats.sk, 0) AS fk_categoria, stock,
              CAST(CAST(unit * stock AS DECIMAL(15,2)) AS DOUBLE) AS valor_inventario
       FROM base LEFT JOIN keys1 USING (id) LEFT JOIN keys2 USING (id) LEFT JOIN cats USING (p_brand)""",
)
def inventory_star(spark, sf):
    """Two runs: the first without the smallest parts, the second with all and new list prices for
    the largest, which opens a second version."""
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.min(F.col("l_extendedprice").cast("decimal(15,2)")).alias("precio_unitario"),
        F.sum("l_quantity").cast("long").alias("stock"),
    )
    part = table(spark, sf, "part")
    products = part.join(lines, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").cast("string").alias("cod_producto"),
        F.col("p_name").alias("nombre_producto"),
        F.col("p_brand").alias("categoria"),
        F.col("p_retailprice").cast("decimal(15,2)").alias("precio_lista"),
        "precio_unitario", "stock", "p_size",
    )
    categories = part.where("p_size < 50").select(
        F.col("p_brand").alias("id_categoria_origen"), F.col("p_brand").alias("nombre_categoria")
    ).distinct()
    dim_category = _load(spark, None, categories, inventory.CATEGORY, D1, RUN1)
    path = scratch_path(spark, "inventory")
    raised = F.when(F.col("p_size") > 40, F.col("precio_lista") + 10).otherwise(F.col("precio_lista")).cast("decimal(15,2)")
    dim, facts = inventory.load_inventory(products.where("p_size > 5"), None, dim_category, None, D1, f"{path}/1")
    _, facts = inventory.load_inventory(
        products.withColumn("precio_lista", raised), dim, dim_category, facts, D2, f"{path}/2"
    )
    return facts.drop("dwh_fecha_carga").withColumn("valor_inventario", F.col("valor_inventario").cast("double"))


@query(
    "cleaning_rules",
    """WITH sales AS (SELECT l_orderkey AS id_venta, l_shipdate AS fecha, CAST(l_extendedprice AS DECIMAL(15,2)) AS monto,
                             CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_suppkey END AS id_cliente,
                             CASE l_linestatus WHEN 'O' THEN '' ELSE 'write to supplier' || CAST(l_suppkey AS VARCHAR) || '@mail.example.com' END AS descripcion,
                             l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS nro FROM lineitem),
       kept AS (SELECT * FROM sales WHERE monto > 0 AND year(fecha) = 1999
                QUALIFY row_number() OVER (PARTITION BY id_venta ORDER BY fecha DESC, nro DESC) = 1)
       SELECT id_venta, strftime(fecha + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS fecha, CAST(monto AS DOUBLE) AS monto, coalesce(id_cliente, -1) AS id_cliente,
              CASE WHEN descripcion = '' THEN 'SIN DESCRIPCION'
                   ELSE regexp_replace(regexp_replace(descripcion, '[0-9]', '*', 'g'), '[A-Za-z]', 'X', 'g') END AS descripcion
       FROM kept""",
)
def cleaning_rules(spark, sf):
    key = F.col("l_suppkey").cast("string")
    feed = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id_venta"),
        F.col("l_shipdate").alias("fecha"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("monto"),
        F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("id_cliente"),
        F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(
            F.concat(F.lit("write to supplier"), key, F.lit("@mail.example.com"))
        ).alias("descripcion"),
        (F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("nro"),
    )
    out = cleaning.clean_sales(feed, 1999, "America/Bogota")
    return out.select(
        "id_venta", F.date_format("fecha", "yyyy-MM-dd HH:mm").alias("fecha"), F.col("monto").cast("double").alias("monto"),
        "id_cliente", "descripcion",
    )
