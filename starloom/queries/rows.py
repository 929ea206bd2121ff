"""Queries for sources, sinks, projections, filters and computed columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions import masking, text
from starloom.functions.casting import format_date, literal, money, parse_date, parse_datetime, parse_decimal_comma, to_utc
from starloom.operators import merge, rows
from starloom.operators.joins import union_streams
from starloom.operators.rows import Calculation, Condition
from starloom.operators.sequence import add_sequence
from starloom.queries.registry import day, double, moment, query, table
from starloom.session import scratch_path
from starloom.sinks import writers
from starloom.sources import readers
from starloom.sources.readers import Field
from starloom.sources.staging import stage

RUN = dt.datetime(2024, 6, 1, 12, 0, 0)
MONEY = T.DecimalType(15, 2)

# -- sources -------------------------------------------------------------------------------------


@query(
    "table_input",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount > 0.05""",
)
def table_input(spark, sf):
    return readers.read_table(
        spark,
        f"{sf}/lineitem.parquet",
        ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
        "l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_discount > 0.05",
    )


@query(
    "sql_input",
    """SELECT c_mktsegment, count(*) AS n_customers, CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS balance
       FROM customer GROUP BY c_mktsegment""",
)
def sql_input(spark, sf):
    return readers.read_sql(
        spark,
        """SELECT c_mktsegment, count(*) AS n_customers,
                  CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS balance
           FROM {customer} GROUP BY c_mktsegment""",
        customer=table(spark, sf, "customer"),
    )


@query(
    "csv_input",
    """SELECT c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS DOUBLE) AS c_acctbal, c_mktsegment
       FROM customer""",
)
def csv_input(spark, sf):
    path = scratch_path(spark, "csv")
    comma = F.replace(F.col("c_acctbal").cast(MONEY).cast("string"), F.lit("."), F.lit(","))
    table(spark, sf, "customer").select("c_custkey", "c_name", comma.alias("c_acctbal"), "c_mktsegment").write.option(
        "header", "true"
    ).csv(path)
    fields = [
        Field("c_custkey", "Integer"),
        Field("c_name"),
        Field("c_acctbal", "BigNumber", length=15, precision=2),
        Field("c_mktsegment"),
    ]
    return readers.read_csv(spark, path, fields).withColumn("c_acctbal", double("c_acctbal"))


@query(
    "text_file_input",
    "SELECT s_suppkey, s_name, CAST(CAST(s_acctbal AS DECIMAL(15,2)) AS DOUBLE) AS s_acctbal FROM supplier",
)
def text_file_input(spark, sf):
    path = scratch_path(spark, "text")
    padded = F.concat(F.lit("  "), "s_name", F.lit(" "))
    table(spark, sf, "supplier").select("s_suppkey", padded.alias("s_name"), F.col("s_acctbal").cast(MONEY)).write.option(
        "header", "true"
    ).option("sep", ";").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    fields = [Field("s_suppkey", "Integer"), Field("s_name", trim="both"), Field("s_acctbal", "Number")]
    return readers.read_text(spark, path, fields)


@query(
    "json_input",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.gone') AS gone FROM events",
)
def json_input(spark, sf):
    fields = [Field("k", "Integer", path="$.k"), Field("gone", path="$.gone")]
    return readers.json_fields(table(spark, sf, "events"), "props", fields).select("event_id", "k", "gone")


@query("json_file_input", "SELECT event_id, event_type, value FROM events")
def json_file_input(spark, sf):
    path = scratch_path(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    fields = [Field("event_id", "Integer"), Field("event_type"), Field("value", "Number", path="$.value")]
    return readers.read_json(spark, path, fields)


@query("xml_input", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def xml_input(spark, sf):
    path = scratch_path(spark, "xml")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").write.format("xml").option(
        "rowTag", "customer"
    ).save(path)
    return readers.read_xml(spark, path, "customer", "c_custkey bigint, c_name string, c_nationkey int")


@query(
    "generate_rows",
    """SELECT s.p_size AS p_size, 'ACTIVO' AS state, count(p_partkey) AS n_parts
       FROM (SELECT CAST(range AS BIGINT) AS p_size FROM range(1, 61)) s LEFT JOIN part ON part.p_size = s.p_size
       GROUP BY s.p_size""",
)
def generate_rows(spark, sf):
    spine = readers.generate_rows(spark, 60, {"state": ("ACTIVO", "String")})
    spine = add_sequence(spine, ["state"], "p_size")
    parts = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("p_size"), "p_partkey")
    return spine.join(parts, "p_size", "left").groupBy("p_size", "state").agg(F.count("p_partkey").alias("n_parts"))


@query("source_sample")
def source_sample(spark, sf):
    return readers.sample_rows(table(spark, sf, "orders"), 20)[0]


@query("source_sample_property", "SELECT CAST(20 AS BIGINT) AS n_rows, CAST(20 AS BIGINT) AS n_from_table, 'fraction' AS drawn")
def source_sample_property(spark, sf):
    """A row sample is full, comes from the table, and says how it was drawn."""
    orders = table(spark, sf, "orders")
    rows, drawn = readers.sample_rows(orders, 20, 0.1)
    found = rows.select("o_orderkey").distinct().join(orders, "o_orderkey", "left_semi")
    counts = found.agg(F.count(F.lit(1)).alias("n_from_table"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(counts).withColumn("drawn", F.lit(drawn))


@query(
    "source_sample_pages",
    """SELECT 'file' AS drawn, count(DISTINCT o_custkey % 120) AS n_whole_blocks, CAST(0 AS BIGINT) AS n_broken_blocks FROM orders""",
)
def source_sample_pages(spark, sf):
    """Half of a table's files: each is there with all of its rows or with none."""
    path = scratch_path(spark, "pages")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 120).alias("part"))
    orders.repartition(8, "part").write.partitionBy("part").parquet(path)
    drawn, kind = readers.sample_blocks(spark, path, 0.5, seed=3)
    sizes = drawn.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("part"))
    parts = spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("all")).join(sizes, "part", "left")
    whole = F.coalesce("n", F.lit(0)).isin(F.lit(0), F.col("all"))
    return parts.agg(F.count_if(whole).alias("n_whole_blocks"), F.count_if(~whole).alias("n_broken_blocks")).withColumn("drawn", F.lit(kind))


@query(
    "text_header_lines",
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders",
)
def text_header_lines(spark, sf):
    """Three header lines go from each of several files."""
    path = scratch_path(spark, "headers")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    line = F.concat_ws(";", F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice"))
    # One row per file, whose lines are its header and its orders; a customer's orders are a small group.
    bodies = orders.repartitionByRange(8, "o_orderkey").select(F.spark_partition_id().alias("file"), "o_orderkey", line.alias("line"))
    heads = spark.range(8).select(F.col("id").cast("int").alias("file"), F.explode(F.array(*[F.lit(x) for x in ("Pedidos", "", "clave;prioridad;total")])).alias("line"), F.lit(None).cast("long").alias("o_orderkey"))
    heads = heads.withColumn("at", F.when(F.col("line") == "Pedidos", 0).when(F.col("line") == "", 1).otherwise(2)).join(bodies.select("file").distinct(), "file", "left_semi")
    both = bodies.withColumn("at", F.lit(3)).unionByName(heads)
    both.repartition(8, "file").sortWithinPartitions("file", "at", "o_orderkey").select("file", "line").write.partitionBy("file").text(path)
    fields = [Field("o_orderkey", "Integer"), Field("o_orderpriority"), Field("o_totalprice", "Number")]
    return readers.read_text(spark, path, fields, header_lines=3).select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query(
    "file_schema",
    """WITH c AS (
         SELECT count(*) AS n, unnest([
           {'name': 'o_orderkey', 'type': 'integer', 'd': count(DISTINCT o_orderkey), 'nulls': count(*) - count(o_orderkey), 'hint': NULL},
           {'name': 'o_custkey', 'type': 'integer', 'd': count(DISTINCT o_custkey), 'nulls': count(*) - count(o_custkey), 'hint': NULL},
           {'name': 'o_orderstatus', 'type': 'string', 'd': count(DISTINCT o_orderstatus), 'nulls': count(*) - count(o_orderstatus), 'hint': 'enum'},
           {'name': 'o_totalprice', 'type': 'number', 'd': count(DISTINCT o_totalprice), 'nulls': count(*) - count(o_totalprice), 'hint': NULL},
           {'name': 'o_orderdate', 'type': 'string', 'd': count(DISTINCT o_orderdate), 'nulls': count(*) - count(o_orderdate), 'hint': 'DD/MM/YYYY or MM/DD/YYYY'},
           {'name': 'o_orderpriority', 'type': 'string', 'd': count(DISTINCT o_orderpriority), 'nulls': count(*) - count(o_orderpriority), 'hint': 'enum'}]) AS x
         FROM orders)
       SELECT x.name AS "column", x.type AS canonical_type, 'default' AS layout, 100.0::DOUBLE * x.nulls / n AS null_pct, x.d AS distinct_count,
              CASE x.hint WHEN 'enum' THEN concat('enum-like (', x.d, ' distinct values)') ELSE x.hint END AS format_hint FROM c""",
)
def file_schema(spark, sf):
    path = scratch_path(spark, "infer")
    orders = table(spark, sf, "orders")
    orders.withColumn("o_orderdate", format_date(F.col("o_orderdate"), "DD/MM/YYYY")).write.option("header", "true").option(
        "sep", ";"
    ).csv(path)
    return readers.infer_file_schema(spark, path)


# -- sinks ---------------------------------------------------------------------------------------


@query("table_output", "SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders")
def table_output(spark, sf):
    path = scratch_path(spark, "stg_orders")
    orders = table(spark, sf, "orders")
    for _ in range(2):
        writers.write_table(orders, path, truncate=True, fields={"order_id": "o_orderkey", "total": "o_totalprice"})
    return spark.read.parquet(path)


@query(
    "table_output_append",
    "SELECT event_type, 2 * count(*) AS n_rows FROM events GROUP BY event_type",
)
def table_output_append(spark, sf):
    path = scratch_path(spark, "stg_events")
    events = table(spark, sf, "events").select("event_id", "event_type")
    for _ in range(2):
        writers.write_table(events, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n_rows"))


@query("text_file_output", "SELECT n_nationkey, n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def text_file_output(spark, sf):
    path = scratch_path(spark, "out")
    joined = table(spark, sf, "nation").join(
        table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    writers.write_text(joined.select("n_nationkey", "n_name", "c_custkey"), path)
    return spark.read.schema("n_nationkey int, n_name string, c_custkey bigint").csv(path, sep=";", header=True)


@query(
    "json_output_blocks",
    """SELECT (i // 10) AS block,
              '{"data":[' || string_agg('{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"}', ',' ORDER BY c_custkey) || ']}'
                AS json_output
       FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) GROUP BY i // 10""",
)
def json_output_blocks(spark, sf):
    return writers.json_blocks(
        table(spark, sf, "customer"), {"id": "c_custkey", "segment": "c_mktsegment"}, ["c_custkey"], 10
    )


CHANGES = """
    changes AS (
      SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, 'AT RISK' AS c_mktsegment
      FROM customer WHERE c_acctbal < 0
      UNION ALL
      SELECT s_suppkey + 1000000000, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier)"""


def customer_changes(spark, sf):
    """A change batch: customers in debt move to another segment, suppliers become customers."""
    changed = (
        table(spark, sf, "customer")
        .where("c_acctbal < 0")
        .select(
            "c_custkey", F.upper("c_name").alias("c_name"), "c_nationkey",
            (F.col("c_acctbal") + 100).alias("c_acctbal"), F.lit("AT RISK").alias("c_mktsegment"),
        )
    )
    added = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
    )
    return union_streams(changed, added)


@query(
    "upsert",
    f"""WITH {CHANGES}
        SELECT c.c_custkey, c.c_name, c.c_nationkey,
               coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(s.c_mktsegment, c.c_mktsegment) AS c_mktsegment
        FROM customer c LEFT JOIN changes s USING (c_custkey)
        UNION ALL SELECT s.* FROM changes s ANTI JOIN customer USING (c_custkey)""",
)
def upsert(spark, sf):
    return merge.upsert(
        table(spark, sf, "customer"), customer_changes(spark, sf), ["c_custkey"], ["c_acctbal", "c_mktsegment"]
    )


@query(
    "insert_new_only",
    f"""WITH {CHANGES}
        SELECT * FROM customer UNION ALL SELECT s.* FROM changes s ANTI JOIN customer USING (c_custkey)""",
)
def insert_new_only(spark, sf):
    return merge.insert_new(table(spark, sf, "customer"), customer_changes(spark, sf), ["c_custkey"])


@query(
    "update_only",
    f"""WITH {CHANGES}
        SELECT c.c_custkey, coalesce(s.c_name, c.c_name) AS c_name, c.c_nationkey, c.c_acctbal,
               coalesce(s.c_mktsegment, c.c_mktsegment) AS c_mktsegment
        FROM customer c LEFT JOIN changes s USING (c_custkey)""",
)
def update_only(spark, sf):
    return merge.update_matching(
        table(spark, sf, "customer"), customer_changes(spark, sf), ["c_custkey"], ["c_name", "c_mktsegment"]
    )


@query(
    "upsert_last_wins",
    """SELECT c_custkey, coalesce(o_orderstatus, '-') AS last_status, coalesce(CAST(o_orderkey AS VARCHAR), '-') AS last_order
       FROM customer LEFT JOIN (
         SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
       ) ON o_custkey = c_custkey""",
)
def upsert_last_wins(spark, sf):
    """Every order applied in turn to its customer's row."""
    target = table(spark, sf, "customer").select(
        "c_custkey", F.lit("-").alias("last_status"), F.lit("-").alias("last_order"),
        F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(None).cast("long").alias("tie"),
    )
    source = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("last_status"),
        F.col("o_orderkey").cast("string").alias("last_order"),
        F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("tie"),
    )
    return merge.upsert(target, source, ["c_custkey"], order=["at", "tie"]).drop("at", "tie")


@query("delete_matching", "SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal < 0)")
def delete_matching(spark, sf):
    return merge.delete_matching(
        table(spark, sf, "customer"), customer_changes(spark, sf), [("c_custkey", "=", "c_custkey")]
    ).select("c_custkey", "c_name")


@query("delete_older", "SELECT o_orderkey FROM orders WHERE NOT o_orderdate < (SELECT max(l_shipdate) - INTERVAL 1000 DAY FROM lineitem)")
def delete_older(spark, sf):
    """Orders older than some cut-off date: a comparison without an equality key."""
    cutoffs = table(spark, sf, "lineitem").select((F.col("l_shipdate") - F.expr("INTERVAL 1000 DAYS")).alias("cutoff"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return merge.delete_matching(orders, cutoffs, [("o_orderdate", "<", "cutoff")]).select("o_orderkey")


@query(
    "delete_range",
    """SELECT o_orderkey FROM orders o WHERE NOT EXISTS (
         SELECT 1 FROM orders u WHERE u.o_orderpriority = '1-URGENT' AND u.o_custkey = o.o_custkey
           AND o.o_orderdate >= u.o_orderdate + INTERVAL 1 DAY AND o.o_orderdate < u.o_orderdate + INTERVAL 60 DAY)""",
)
def delete_range(spark, sf):
    """Orders within two months after an urgent order of their customer: an equality and a range."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    at = F.col("o_orderdate")
    spans = orders.where("o_orderpriority = '1-URGENT'").select(
        "o_custkey", (at + F.expr("INTERVAL 1 DAY")).alias("low"), (at + F.expr("INTERVAL 60 DAYS")).alias("high")
    )
    tests = [("o_custkey", "=", "o_custkey"), ("o_orderdate", ">=", "low"), ("o_orderdate", "<", "high")]
    return merge.delete_matching(orders, spans, tests).select("o_orderkey")


# -- projection and casts ------------------------------------------------------------------------


@query("select_rename", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice FROM orders")
def select_rename(spark, sf):
    return rows.select_columns(
        table(spark, sf, "orders"), [("o_orderkey", "order_id"), ("o_custkey", "customer_id"), "o_totalprice"]
    )


@query("select_remove", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def select_remove(spark, sf):
    return rows.remove_columns(table(spark, sf, "orders"), ["o_orderdate", "o_orderpriority"])


@query(
    "cast_types",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(l_orderkey AS VARCHAR) AS order_text,
              coalesce(TRY_CAST(l_returnflag AS BIGINT), -1) AS flag_number, strftime(l_shipdate, '%Y-%m-%d') AS ship_day
       FROM lineitem""",
)
def cast_types(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_orderkey").alias("order_text"),
        F.col("l_returnflag").alias("flag_number"), F.col("l_shipdate").alias("ship_day"),
    )
    cast = rows.cast_columns(
        df, {"l_quantity": "Integer", "order_text": "String", "flag_number": "Integer", "ship_day": T.DateType()}
    )
    return rows.if_null(cast, {"flag_number": -1}).withColumn("ship_day", day("ship_day"))


@query(
    "parse_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS european,
              strftime(o_orderdate, '%Y-%m-%d') AS american, CAST(NULL AS VARCHAR) AS wrong FROM orders""",
)
def parse_dates(spark, sf):
    date = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        day(parse_date(format_date(date), "YYYY-MM-DD")).alias("iso"),
        day(parse_date(format_date(date, "DD/MM/YYYY"), "DD/MM/YYYY")).alias("european"),
        day(parse_datetime(format_date(date, "MM/DD/YYYY"), "MM/DD/YYYY")).alias("american"),
        day(parse_date(F.concat(F.lit("x"), format_date(date)), "YYYY-MM-DD")).alias("wrong"),
    )


@query("decimal_comma", "SELECT p_partkey, CAST(CAST(p_retailprice * 1000 AS DECIMAL(15,2)) AS VARCHAR) AS price FROM part")
def decimal_comma(spark, sf):
    shown = F.format_number((F.col("p_retailprice") * 1000).cast(MONEY), 2)
    european = F.concat(F.lit("€ "), F.translate(shown, ",.", ".,"))
    return table(spark, sf, "part").select(
        "p_partkey", parse_decimal_comma(european, 15, 2).cast("string").alias("price")
    )


@query(
    "money_decimal",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS importe,
              CAST(CAST(l_discount AS DECIMAL(18,8)) AS VARCHAR) AS tasa FROM lineitem""",
)
def money_decimal(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        money(F.col("l_extendedprice"), MONEY).cast("string").alias("importe"),
        money(F.col("l_discount"), T.DecimalType(18, 8)).cast("string").alias("tasa"),
    )


# -- filters -------------------------------------------------------------------------------------

FILTERS = {
    "filter_eq": (Condition("o_orderstatus", "=", "F"), "o_orderstatus = 'F'"),
    "filter_ne": (Condition("o_orderstatus", "<>", "F"), "o_orderstatus <> 'F'"),
    "filter_gt": (Condition("o_totalprice", ">", 250000.0), "o_totalprice > 250000"),
    "filter_lt": (Condition("o_totalprice", "<", 250000.0), "o_totalprice < 250000"),
    "filter_ge": (Condition("o_orderdate", ">=", dt.datetime(1998, 1, 1)), "o_orderdate >= TIMESTAMP '1998-01-01'"),
    "filter_le": (Condition("o_orderdate", "<=", dt.datetime(1998, 1, 1)), "o_orderdate <= TIMESTAMP '1998-01-01'"),
    "filter_contains": (Condition("o_orderpriority", "CONTAINS", "URGENT"), "contains(o_orderpriority, 'URGENT')"),
    "filter_is_null": (Condition("urgent_status", "IS NULL"), "urgent_status IS NULL"),
    "filter_is_not_null": (Condition("urgent_status", "IS NOT NULL"), "urgent_status IS NOT NULL"),
}
ORDERS_SQL = """SELECT o_orderkey, o_orderstatus, o_totalprice FROM (
    SELECT *, CASE WHEN contains(o_orderpriority, 'URGENT') THEN o_orderstatus END AS urgent_status FROM orders)"""


def _orders_for_filters(spark, sf):
    urgent = F.when(F.contains("o_orderpriority", F.lit("URGENT")), F.col("o_orderstatus"))
    return table(spark, sf, "orders").withColumn("urgent_status", urgent)


def _register_filter(name, condition, where):
    @query(name, f"{ORDERS_SQL} WHERE {where}")
    def run(spark, sf):
        return rows.filter_rows(_orders_for_filters(spark, sf), condition).select(
            "o_orderkey", "o_orderstatus", "o_totalprice"
        )


for _name, (_condition, _where) in FILTERS.items():
    _register_filter(_name, _condition, _where)


@query("filter_true", f"{ORDERS_SQL} WHERE urgent_status = 'F'")
def filter_true(spark, sf):
    kept, _ = rows.split_rows_by(_orders_for_filters(spark, sf), Condition("urgent_status", "=", "F"))
    return kept.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("filter_false", f"{ORDERS_SQL} WHERE NOT coalesce(urgent_status = 'F', false)")
def filter_false(spark, sf):
    _, rest = rows.split_rows_by(_orders_for_filters(spark, sf), Condition("urgent_status", "=", "F"))
    return rest.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "filter_all",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
       WHERE l_quantity >= 10 AND l_extendedprice >= 20000 AND l_tax >= 0""",
)
def filter_all(spark, sf):
    return rows.filter_rows(
        table(spark, sf, "lineitem"),
        Condition("l_quantity", ">=", 10),
        Condition("l_extendedprice", ">=", 20000),
        Condition("l_tax", ">=", 0),
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "filter_columns",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount > l_tax",
)
def filter_columns(spark, sf):
    return rows.filter_rows(table(spark, sf, "lineitem"), Condition("l_discount", ">", other="l_tax")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )


# -- order and duplicates ------------------------------------------------------------------------


@query(
    "sort_rows",
    """SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name) NULLS FIRST, p_partkey) AS position FROM part""",
)
def sort_rows(spark, sf):
    return rows.sorted_position(table(spark, sf, "part"), ["p_name", "p_partkey"]).select(
        "p_partkey", "p_name", "position"
    )


@query("sort_rows_plain", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY lower(o_orderpriority), o_orderkey DESC")
def sort_rows_plain(spark, sf):
    df = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey")
    return rows.sort_rows(df, ["o_orderpriority", ("o_orderkey", False)])


@query(
    "unique_rows",
    """SELECT p_name, p_brand, p_partkey FROM part
       QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1""",
)
def unique_rows(spark, sf):
    df = table(spark, sf, "part").select("p_name", "p_brand", "p_partkey")
    return rows.unique_rows(df, ["p_name", "p_brand"], ["p_partkey"])


UNIQUE_CI = """SELECT label, id FROM (
    SELECT CASE WHEN p_size > 25 THEN upper(p_type) ELSE lower(p_type) END AS label, p_partkey AS id FROM part)
    QUALIFY row_number() OVER (PARTITION BY lower(label) ORDER BY id) = 1"""


@query("unique_rows_ci", UNIQUE_CI)
def unique_rows_ci(spark, sf):
    label = F.when(F.col("p_size") > 25, F.upper("p_type")).otherwise(F.lower("p_type"))
    df = table(spark, sf, "part").select(label.alias("label"), F.col("p_partkey").alias("id"))
    return rows.unique_rows(df, ["label"], ["id"], ignore_case=["label"])


@query(
    "dedup_latest",
    """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def dedup_latest(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rows.latest_rows(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]).withColumn("o_orderdate", day("o_orderdate"))


# -- computed columns ----------------------------------------------------------------------------


@query(
    "calculator",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CAST(CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(15,2)) AS VARCHAR) AS revenue,
              year(l_shipdate) AS ship_year
       FROM lineitem""",
)
def calculator(spark, sf):
    rate = T.DecimalType(4, 2)
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.col("l_extendedprice").cast(MONEY).alias("price"), F.col("l_discount").cast(rate).alias("discount"),
        F.lit(1).cast(rate).alias("one"),
    )
    out = rows.calculate(
        df,
        [
            Calculation("factor", "SUBTRACT", "one", "discount", type=rate),
            Calculation("revenue", "MULTIPLY", "price", "factor", type=MONEY),
            Calculation("ship_year", "YEAR_OF_DATE", "l_shipdate", type=T.LongType()),
        ],
    )
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("revenue").cast("string").alias("revenue"), "ship_year"
    )


@query(
    "formula_concat_key",
    """SELECT p_partkey, p_brand || '-' || CAST(p_partkey AS VARCHAR) AS business_key,
              CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS BIGINT) AS is_large FROM part""",
)
def formula_concat_key(spark, sf):
    df = rows.formula(table(spark, sf, "part"), "business_key", "concat(p_brand, '-', cast(p_partkey as string))")
    return rows.formula(df, "is_large", "p_size > 25", boolean_as_int=True).select("p_partkey", "business_key", "is_large")


@query(
    "add_constants",
    """SELECT o_orderkey, 'WEB' AS channel, CAST(7 AS BIGINT) AS batch, CAST(1.5 AS DOUBLE) AS factor,
              CAST(NULL AS VARCHAR) AS note, '2024-01-31' AS closing FROM orders""",
)
def add_constants(spark, sf):
    df = rows.add_constants(
        table(spark, sf, "orders").select("o_orderkey"),
        {
            "channel": ("WEB", "String"), "batch": (7, "Integer"), "factor": (1.5, "Number"),
            "note": ("", "String"), "closing": ("2024-01-31", "Date"),
        },
    )
    return df.withColumn("closing", day("closing"))


@query(
    "string_ops",
    """SELECT c_custkey, upper(c_name) AS upper_name, lower(c_mktsegment) AS c_mktsegment,
              upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) AS title, c_name AS trimmed,
              '  ' || c_name AS right_trimmed FROM customer""",
)
def string_ops(spark, sf):
    padded = F.concat(F.lit("  "), "c_name", F.lit(" "))
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", padded.alias("trimmed"), padded.alias("right_trimmed")
    )
    df = rows.string_operations(df, "c_name", case="upper", output="upper_name")
    df = rows.string_operations(df, "c_mktsegment", case="title", output="title")
    df = rows.string_operations(df, "c_mktsegment", case="lower")
    df = rows.string_operations(df, "trimmed")
    return rows.string_operations(df, "right_trimmed", trim="right").drop("c_name")


@query(
    "replace_string",
    """SELECT p_partkey, regexp_replace(p_type, 'e', '_', 'gi') AS p_type, replace(p_brand, '#', '-') AS brand,
              regexp_replace(p_name, '[aeiou]+', '*', 'g') AS masked FROM part""",
)
def replace_string(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    df = rows.replace_in_string(df, "p_type", "e", "_")
    df = rows.replace_in_string(df, "p_brand", "#", "-", case_sensitive=True, output="brand")
    df = rows.replace_in_string(df, "p_name", "[aeiou]+", "*", regex=True, case_sensitive=True, output="masked")
    return df.drop("p_brand", "p_name")


@query(
    "concat_fields",
    """SELECT s_suppkey, s_name, '"' || CAST(s_suppkey AS VARCHAR) || '";"' || s_name || '";"' || CAST(s_nationkey AS VARCHAR) || '"' AS line
       FROM supplier""",
)
def concat_fields(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return rows.concat_fields(df, ["s_suppkey", "s_name", "s_nationkey"], "line", ";", '"').drop("s_nationkey")


@query(
    "value_mapper",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS state,
              CASE o_orderstatus WHEN 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'now' END AS speed FROM orders""",
)
def value_mapper(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    df = rows.map_values(df, "o_orderstatus", {"F": "finished", "O": "open"}, "state", "other")
    df = rows.map_values(df, "o_orderstatus", {"F": "X"})
    return rows.map_values(df, "o_orderpriority", {"1-URGENT": "now"}, "speed").drop("o_orderpriority")


@query(
    "if_null",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def if_null(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.if_null(joined, {"quality": -1, "toxic": -1})


@query("null_if", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_returnflag, 'N') AS l_returnflag FROM lineitem")
def null_if(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return rows.null_if(df, "l_returnflag", "N")


@query(
    "number_range",
    """SELECT p_partkey, p_size, CASE WHEN p_size >= 1 AND p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 30 THEN 'medium'
              WHEN p_size >= 30 AND p_size < 45 THEN 'large' ELSE 'huge' END AS size_band FROM part""",
)
def number_range(spark, sf):
    bands = [(1, 10, "small"), (10, 30, "medium"), (30, 45, "large"), (45, None, "left out")]
    return rows.number_range(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", bands, "size_band", "huge")


@query(
    "split_columns",
    """SELECT c_custkey, split_part(c_name, '#', 1) AS kind, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number FROM customer""",
)
def split_columns(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    return rows.split_columns(df, "c_name", "#", [("kind", "String", "both"), ("number", "Integer", "none")])


@query(
    "regex_eval",
    """SELECT s_suppkey, regexp_full_match(s_name, '(supplier)#0*([0-9]*[05])', 'i') AS matched,
              CASE WHEN regexp_full_match(s_name, '(supplier)#0*([0-9]*[05])', 'i')
                   THEN regexp_extract(s_name, '^(?:(supplier)#0*([0-9]*[05]))$', 2, 'i') END AS tail FROM supplier""",
)
def regex_eval(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    out = rows.regex_evaluation(
        df, "s_name", r"(supplier)#0*([0-9]*[05])", "matched", ["word", "tail"], case_insensitive=True
    )
    return out.select("s_suppkey", "matched", "tail")


@query(
    "add_sequence",
    """SELECT o_orderkey, 100 + 10 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS line_id FROM orders""",
)
def add_sequence_(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return add_sequence(df, ["o_orderdate", "o_orderkey"], "line_id", 100, 10).drop("o_orderdate")


@query("system_date", "SELECT count(*) AS n_rows, 1 AS n_dates, true AS recent FROM orders")
def system_date(spark, sf):
    stamped = rows.system_date(table(spark, sf, "orders").select("o_orderkey"), "loaded_at")
    return stamped.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("loaded_at").cast("int").alias("n_dates"),
        (F.max("loaded_at") > literal(dt.datetime(2024, 1, 1))).alias("recent"),
    )


@query(
    "stage_table",
    """SELECT *, '2024-06-01 12:00:00.000' AS stg_fecha_carga, 'crm.customer' AS stg_origen, 'ACTIVO' AS stg_estado FROM customer""",
)
def stage_table(spark, sf):
    path = scratch_path(spark, "stg_customer")
    writers.write_table(stage(table(spark, sf, "customer"), "crm.customer", RUN), path, truncate=True)
    return spark.read.parquet(path).withColumn("stg_fecha_carga", moment("stg_fecha_carga"))


@query(
    "udf_script",
    "SELECT doc_id, len(string_split(text, ' ')) AS n_words, length(text) AS n_chars FROM documents",
)
def udf_script(spark, sf):
    # Defined here so that it travels with the query and workers need not have this package.
    def lengths(batches):
        for batch in batches:
            text = batch["text"].str
            yield batch[["doc_id"]].assign(n_words=text.split(" ").str.len(), n_chars=text.len())

    documents = table(spark, sf, "documents").select("doc_id", "text")
    return rows.script(documents, lengths, "doc_id bigint, n_words bigint, n_chars bigint")


@query(
    "json_field",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type FROM events",
)
def json_field(spark, sf):
    return readers.json_fields(table(spark, sf, "events"), "props", [Field("k", "Number")]).select(
        "event_id", "k", "event_type"
    )


@query(
    "to_utc",
    """SELECT o_orderkey, strftime((o_orderdate + INTERVAL 22 HOUR) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS utc FROM orders""",
)
def to_utc_(spark, sf):
    local = F.col("o_orderdate") + F.expr("INTERVAL 22 HOURS")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(to_utc(local, "America/Bogota"), "yyyy-MM-dd HH:mm").alias("utc")
    )


# -- masking -------------------------------------------------------------------------------------

ADDRESS = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z.]+"


@query(
    "mask_email",
    f"""SELECT doc_id, CASE WHEN a = '' THEN '***' ELSE left(a, 1) || '***@' || repeat('*', least(3, length(d) - length(t) - 1)) || '.' || t END AS masked
        FROM (SELECT doc_id, a, split_part(a, '@', 2) AS d, regexp_extract(a, '[.]([^.]*)$', 1) AS t
              FROM (SELECT doc_id, regexp_extract(text, '{ADDRESS}') AS a FROM documents))""",
)
def mask_email(spark, sf):
    address = F.regexp_extract("text", ADDRESS, 0)
    return table(spark, sf, "documents").select("doc_id", masking.mask_value(address, F.lit("email")).alias("masked"))


@query("mask_phone", "SELECT c_custkey, regexp_replace(c_name, '[0-9]', '*', 'g') AS masked FROM customer")
def mask_phone(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", masking.mask_value(F.col("c_name"), F.lit("phone number")).alias("masked")
    )


@query("mask_date", "SELECT o_orderkey, 'XXXX-XX-XX' AS masked FROM orders")
def mask_date(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", masking.mask_value(day("o_orderdate"), F.lit("YYYY-MM-DD")).alias("masked")
    )


@query(
    "mask_generic",
    r"SELECT doc_id, regexp_replace(regexp_replace(text, '\p{Nd}', '*', 'g'), '\p{L}', 'X', 'g') AS masked FROM documents",
)
def mask_generic(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", masking.mask_value(F.col("text"), F.lit("enum-like")).alias("masked")
    )


@query(
    "email_or_null",
    f"""SELECT doc_id, CASE WHEN regexp_full_match(a, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_]{{2,}}') THEN a END AS email
        FROM (SELECT doc_id, regexp_extract(text, '{ADDRESS}') AS a FROM documents)""",
)
def email_or_null(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.email_or_null(F.regexp_extract("text", ADDRESS, 0)).alias("email")
    )
