"""Queries for loads that rewrite a part of their target."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import INSERT, PUNCH, UPDATE, Check, DimContract
from starloom.contracts import Column as TargetColumn
from starloom.operators import dimension, keyblocks, merge, profiling, upkeep
from starloom.operators.joins import union_streams
from starloom.operators.ordered import lag_lead
from starloom.queries.registry import ORACLES, day, moment, query, table
from starloom.queries.rows import customer_changes
from starloom.queries.warehouse import D1, D2, RUN1, RUN2, _contract, _load, _shown, first_batch
from starloom.session import barrier, scratch_path
from starloom.sinks import checked, keyed

BUCKETS = 16


def _changed(spark, sf):
    """What is new in the second batch: the customers with other values, and the suppliers."""
    balance = F.col("c_acctbal")
    customers = table(spark, sf, "customer").where((balance > 9000) | (balance < 0)).select(
        F.col("c_custkey").alias("id_cliente"),
        F.when((balance > 9000) | (balance < -500), F.upper("c_name")).otherwise(F.col("c_name")).alias("nombre"),
        F.when(balance < 0, F.lit("AT RISK")).otherwise(F.col("c_mktsegment")).alias("segmento"),
    )
    suppliers = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("id_cliente"), F.col("s_name").alias("nombre"), F.lit("SUPPLIER").alias("segmento")
    )
    return union_streams(customers, suppliers)


def _keyed_customers(spark, sf):
    return keyed.create_keyed(table(spark, sf, "customer"), scratch_path(spark, "keyed-customer"), ["c_custkey"], BUCKETS)


@query("upsert_buckets", ORACLES["upsert"])
def upsert_buckets(spark, sf):
    """Insert and update in the buckets that the changes are in."""
    target = _keyed_customers(spark, sf)
    keyed.upsert_keyed(target, customer_changes(spark, sf), ["c_acctbal", "c_mktsegment"])
    return target.read(spark)


@query("update_buckets", ORACLES["update_only"])
def update_buckets(spark, sf):
    """Update, and rewrite no bucket that only has keys of the batch which the table lacks."""
    target = _keyed_customers(spark, sf)
    keyed.upsert_keyed(target, customer_changes(spark, sf), ["c_name", "c_mktsegment"], insert=False)
    return target.read(spark)


@query("delete_buckets", ORACLES["delete_matching"])
def delete_buckets(spark, sf):
    target = _keyed_customers(spark, sf)
    keyed.delete_keyed(target, customer_changes(spark, sf), [("c_custkey", "=", "c_custkey")])
    return target.read(spark).select("c_custkey", "c_name")


LINES = """SELECT l_orderkey AS id_orden, l_linenumber AS nro_linea, l_partkey AS id_producto, l_suppkey AS id_proveedor,
                  strftime(l_shipdate, '%Y-%m-%d') AS fecha_envio, l_quantity AS cantidad"""


@query(
    "fact_load_buckets",
    f"""WITH corrected AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 3 DAY FROM orders))
        {LINES} + CASE WHEN l_orderkey IN (SELECT o_orderkey FROM corrected) THEN 100 ELSE 0 END AS cantidad,
               CASE WHEN l_orderkey IN (SELECT o_orderkey FROM corrected) THEN '2024-02-01 06:00:00.000' ELSE '2024-01-01 06:00:00.000' END AS dwh_fecha_carga
        FROM lineitem""".replace("l_quantity AS cantidad +", "l_quantity +"),
)
def fact_load_buckets(spark, sf):
    """All lines, then corrections of the last days' orders into the buckets of these orders."""
    orders = table(spark, sf, "orders")
    grain = ["id_orden", "nro_linea", "id_producto", "id_proveedor", "fecha_envio"]
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id_orden"), F.col("l_linenumber").alias("nro_linea"), F.col("l_partkey").alias("id_producto"),
        F.col("l_suppkey").alias("id_proveedor"), F.col("l_shipdate").alias("fecha_envio"), F.col("l_quantity").alias("cantidad"),
    )
    last = F.broadcast(orders.agg(F.max("o_orderdate").alias("_last")))  # one row
    late = orders.join(last, F.col("o_orderdate") >= F.col("_last") - F.expr("INTERVAL 3 DAYS")).select(F.col("o_orderkey").alias("id_orden"))
    corrected = lines.join(late, "id_orden").withColumn("cantidad", F.col("cantidad") + 100).select(*lines.columns)
    fact = keyed.create_keyed(lines.withColumn("dwh_fecha_carga", F.lit(RUN1).cast("timestamp_ntz")), scratch_path(spark, "keyed-fact"), grain, BUCKETS)
    keyed.load_fact_keyed(fact, corrected, run_time=RUN2)
    return fact.read(spark).withColumns({"fecha_envio": day("fecha_envio"), "dwh_fecha_carga": moment("dwh_fecha_carga")})


def _changes(spark, sf, contract):
    first = _load(spark, None, first_batch(spark, sf), contract, D1, RUN1)
    return dimension.load_dimension_changes(first, _changed(spark, sf), contract, D2, RUN2)


@query("dim_changes_scd1", ORACLES["dim_scd1"])
def dim_changes_scd1(spark, sf):
    return _shown(_changes(spark, sf, _contract(nombre=UPDATE, segmento=UPDATE)))


@query("dim_changes_scd2", ORACLES["dim_scd2"])
def dim_changes_scd2(spark, sf):
    return _shown(_changes(spark, sf, _contract(nombre=INSERT, segmento=INSERT)))


@query("dim_changes_mixed", ORACLES["dim_mixed"])
def dim_changes_mixed(spark, sf):
    return _shown(_changes(spark, sf, _contract(nombre=UPDATE, segmento=INSERT)))


@query("dim_changes_punch", ORACLES["dim_punch_through"])
def dim_changes_punch(spark, sf):
    return _shown(_changes(spark, sf, _contract(nombre=PUNCH, segmento=INSERT)))


@query("dim_changes_tech_columns", ORACLES["dim_tech_columns"])
def dim_changes_tech_columns(spark, sf):
    contract = DimContract.from_modes(
        "dim_cliente", "sk_cliente", ["id_cliente"], {"nombre": UPDATE, "segmento": INSERT},
        technical_columns={
            "inserted": "DateInserted", "updated": "DateUpdated", "touched": "DateInsertedOrUpdated", "is_last": "LastVersion",
        },
    )
    dim = _shown(_changes(spark, sf, contract))
    return dim.withColumns({n: moment(n) for n in ("inserted", "updated", "touched")})


@query("dim_load_buckets", ORACLES["dim_mixed"])
def dim_load_buckets(spark, sf):
    """A dimension in buckets of its natural key; the second load rewrites those that it has keys in."""
    contract = _contract(nombre=UPDATE, segmento=INSERT)
    first = dimension.load_dimension(None, first_batch(spark, sf), contract, D1, RUN1)
    dim = keyed.create_keyed(first, scratch_path(spark, "keyed-dim"), ["id_cliente"], BUCKETS)
    keyed.load_dimension_keyed(dim, _changed(spark, sf), contract, D2, RUN2)
    return _shown(dim.read(spark))


TARGET = [
    TargetColumn("c_custkey", T.LongType(), required=True),
    TargetColumn("c_name", T.VarcharType(18)),
    TargetColumn("c_nationkey", T.IntegerType(), required=True),
    TargetColumn("c_acctbal", T.DecimalType(5, 2)),
    TargetColumn("c_mktsegment", T.VarcharType(9), required=True),
]


@query(
    "table_output_errors",
    """WITH judged AS (
         SELECT c_custkey, c_acctbal, c_nationkey, concat_ws(', ',
           CASE WHEN length(c_name) > 18 THEN 'c_name: longer than 18' END,
           CASE WHEN c_nationkey = 5 THEN 'c_nationkey: missing' WHEN c_nationkey > 20 THEN 'c_nationkey: outside its range' END,
           CASE WHEN abs(c_acctbal) >= 999.995 THEN 'c_acctbal: not a decimal(5,2)' END,
           CASE WHEN length(c_mktsegment) > 9 THEN 'c_mktsegment: longer than 9' END) AS errors FROM customer)
       SELECT c_custkey, CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS branch, errors,
              CASE WHEN errors = '' THEN CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) ELSE '-' END AS balance,
              (SELECT count(*) FROM judged WHERE errors = '') AS n_accepted, (SELECT count(*) FROM judged WHERE errors <> '') AS n_rejected FROM judged""",
)
def table_output_errors(spark, sf):
    """A load that keeps refused rows with their reasons."""
    path = scratch_path(spark, "checked")
    customers = table(spark, sf, "customer").withColumn("c_nationkey", F.when(F.col("c_nationkey") != 5, F.col("c_nationkey")))
    customers = customers.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)").cast("string"))
    counts = checked.load_checked(customers, path, TARGET, [Check("c_nationkey", 0, 20)])
    good = checked.accepted_rows(spark, path, TARGET).select(
        "c_custkey", F.lit("accepted").alias("branch"), F.lit("").alias("errors"), F.col("c_acctbal").cast("string").alias("balance")
    )
    bad = checked.rejected_rows(spark, path, TARGET).select(
        F.get_json_object("row", "$.c_custkey").cast("long").alias("c_custkey"), F.lit("rejected").alias("branch"),
        F.array_join("errors", ", ").alias("errors"), F.lit("-").alias("balance"),
    )
    return good.unionByName(bad).withColumns({"n_accepted": F.lit(counts.accepted).cast("long"), "n_rejected": F.lit(counts.rejected).cast("long")})


@query(
    "mart_refresh",
    """WITH late AS (SELECT max(o_orderdate) - INTERVAL 60 DAY AS d FROM orders),
       after AS (
         SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderdate >= d THEN 2 * CAST(o_totalprice AS DECIMAL(15,2)) ELSE CAST(o_totalprice AS DECIMAL(15,2)) END AS price
         FROM orders, late WHERE NOT (o_orderpriority = '5-LOW' AND CAST(o_totalprice AS DECIMAL(15,2)) > 400000)
         UNION ALL SELECT 'SUPPLIER', 'N', CAST(s_acctbal AS DECIMAL(15,2)) FROM supplier)
       SELECT o_orderpriority, o_orderstatus, count(*) AS n_rows, CAST(CAST(sum(price) AS DECIMAL(15,2)) AS VARCHAR) AS sum_price, count(price) AS n_price,
              CAST(CAST(min(price) AS DECIMAL(15,2)) AS VARCHAR) AS min_price, CAST(CAST(max(price) AS DECIMAL(15,2)) AS VARCHAR) AS max_price
       FROM after GROUP BY ALL""",
)
def mart_refresh(spark, sf):
    """A summary after corrections, new rows and deletions, from the changed rows alone."""
    price = F.col("o_totalprice").cast("decimal(15,2)").alias("price")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", price)
    last = F.broadcast(orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 60 DAYS")).alias("_d")))  # one row
    corrected = orders.join(last, F.col("o_orderdate") >= F.col("_d")).withColumn("price", (F.col("price") * 2).cast("decimal(15,2)")).drop("_d")
    new = table(spark, sf, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("o_orderkey"), F.lit("SUPPLIER").alias("o_orderpriority"), F.lit("N").alias("o_orderstatus"),
        F.lit(None).cast("timestamp_ntz").alias("o_orderdate"), F.col("s_acctbal").cast("decimal(15,2)").alias("price"),
    )
    batch = corrected.unionByName(new)
    mart = upkeep.Mart(("o_orderpriority", "o_orderstatus"), sums=("price",), extremes=("price",))
    state = barrier(mart.build(orders), "mart")
    after = barrier(merge.upsert(orders, batch, ["o_orderkey"]), "fact")
    state = mart.refresh(state, upkeep.upsert_changes(orders, batch, ["o_orderkey"]), after)
    # The large unhurried orders, by what they cost before the corrections.
    gone = orders.where("o_orderpriority = '5-LOW' AND price > 400000").select("o_orderkey")
    tests = [("o_orderkey", "=", "o_orderkey")]
    state = mart.refresh(state, upkeep.delete_changes(after, gone, tests), merge.delete_matching(after, gone, tests))
    return state.withColumns({n: F.col(n).cast("decimal(15,2)").cast("string") for n in ("sum_price", "min_price", "max_price")})


@query(
    "profile_merged",
    """WITH o AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority FROM orders),
       c AS (UNPIVOT (SELECT coalesce(o_orderkey, '') AS o_orderkey, coalesce(o_custkey, '') AS o_custkey, coalesce(o_orderstatus, '') AS o_orderstatus,
                             coalesce(o_orderpriority, '') AS o_orderpriority FROM o) ON COLUMNS(*) INTO NAME "column" VALUE v)
       SELECT "column", count(*) AS total_count, count(*) FILTER (v = '') AS null_count, min(length(nullif(v, '')))::INTEGER AS min_length,
              max(length(nullif(v, '')))::INTEGER AS max_length, true AS near_exact FROM c GROUP BY "column\"""",
)
def profile_merged(spark, sf):
    """The profile of three loads from what each of them left; the distinct counts are within 5 % of the exact ones."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderdate"
    )
    loads = [orders.where("o_orderdate < TIMESTAMP_NTZ '1997-01-01'"), orders.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '2000-01-01'"), orders.where("o_orderdate >= TIMESTAMP_NTZ '2000-01-01'")]
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    stored = [barrier(profiling.profile_sketches(load, names), "sketches") for load in loads]
    exact = profiling.population_stats(orders, names).select("column", "distinct_count")
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= 0.05 * F.col("distinct_count")
    return profiling.merged_profile(*stored).join(exact, "column").select(
        "column", "total_count", "null_count", "min_length", "max_length", near.alias("near_exact")
    )


@query(
    "keys_of_two_loads",
    """SELECT count(*) AS n_rows, count(*) AS n_keys, true AS rise_with_order FROM
       (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier)""",
)
def keys_of_two_loads(spark, sf):
    """Two loads that number their rows at the same time share no key."""
    blocks = keyblocks.KeyBlocks(scratch_path(spark, "key-blocks"), first=1000, size=64)
    one = blocks.number(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), ["id"], "sk")
    two = blocks.number(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), ["id"], "sk")
    both = barrier(one.withColumn("load", F.lit(1)).unionByName(two.withColumn("load", F.lit(2))), "numbered")
    follows = lag_lead(both, ["load"], ["id"], [("_before", "sk", "LAG", 1)])
    rise = F.bool_and(F.col("_before").isNull() | (F.col("_before") < F.col("sk")))
    return follows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sk").alias("n_keys"), rise.alias("rise_with_order"))
