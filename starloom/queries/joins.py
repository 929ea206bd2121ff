"""Queries for joins, lookups, row shape, aggregation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.operators import aggregate, bands, joins
from starloom.operators.aggregate import Aggregate
from starloom.operators.intervals import interval_lookup
from starloom.operators.joins import LookupValue, Pivot
from starloom.operators.rows import if_null
from starloom.queries.registry import day, double, query, table
from starloom.queries.rows import CHANGES, customer_changes

# Orders above a price and customers in credit, so that every join type has unmatched rows.
JOIN_SQL = """SELECT coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_custkey, -1) AS o_custkey,
    coalesce(c_custkey, -1) AS c_custkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 100000) o
    {how} JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey"""


def _register_join(name, how):
    @query(name, JOIN_SQL.format(how=how))
    def run(spark, sf):
        orders = table(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey")
        customers = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
        joined = joins.merge_join(orders, customers, ["o_custkey"], ["c_custkey"], how)
        return if_null(joined, {"o_orderkey": -1, "o_custkey": -1, "c_custkey": -1})


for _name, _how in {
    "merge_join_inner": "INNER", "merge_join_left": "LEFT OUTER", "merge_join_right": "RIGHT OUTER", "merge_join_full": "FULL OUTER",
}.items():
    _register_join(_name, _how)


@query(
    "merge_join_clash",
    """SELECT a.doc_id, a.lang, b.doc_id AS doc_id_1, b.quality FROM documents a JOIN labels b ON a.doc_id = b.doc_id""",
)
def merge_join_clash(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", "lang")
    return joins.merge_join(left, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], ["doc_id"])


@query(
    "join_rows_theta",
    "SELECT p_partkey, p_size, r_regionkey FROM part, region WHERE p_size > 10 * r_regionkey AND p_size <= 10 * r_regionkey + 12",
)
def join_rows_theta(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    regions = table(spark, sf, "region").select("r_regionkey")
    return bands.band_join(parts, regions, "p_size", "10 * r_regionkey", "10 * r_regionkey + 12", "p_size > 10 * r_regionkey")


@query(
    "join_rows_any",
    "SELECT a.n_nationkey, b.n_nationkey AS n_nationkey_1 FROM nation a, nation b WHERE (a.n_nationkey * b.n_nationkey) % 7 = 3",
)
def join_rows_any(spark, sf):
    """A condition without a range: all pairs are tried."""
    nations = table(spark, sf, "nation").select("n_nationkey")
    return joins.join_rows(nations, nations, "(n_nationkey * n_nationkey_1) % 7 = 3")


@query(
    "join_rows_dates",
    """SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem, orders
       WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 1 DAY AND l_quantity = 50 AND o_totalprice > 300 * l_extendedprice / l_quantity""",
)
def join_rows_dates(spark, sf):
    """Large lines with all costly orders of the day before or the same day: a range and another comparison."""
    lines = table(spark, sf, "lineitem").where("l_quantity = 50").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    found = bands.band_join(
        lines, orders, "l_shipdate", "o_orderdate", "o_orderdate + INTERVAL 1 DAY", "o_totalprice > 300 * l_extendedprice / l_quantity",
        by="300 * l_extendedprice / l_quantity",
    )
    return found.select("l_orderkey", "l_linenumber", "o_orderkey")


@query(
    "overlap_join",
    """WITH spans AS (SELECT o_orderkey, o_orderpriority AS p, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 3 AS INTEGER)) AS z FROM orders WHERE o_totalprice > 200000)
       SELECT x.o_orderkey, y.o_orderkey AS other FROM spans x JOIN spans y ON x.a <= y.z AND y.a <= x.z AND x.p = '1-URGENT' AND y.p = '5-LOW'""",
)
def overlap_join(spark, sf):
    """Large urgent orders with the large unhurried ones that were open on one of the same days."""
    spans = table(spark, sf, "orders").where("o_totalprice > 200000").select(
        "o_orderkey", "o_orderpriority", F.col("o_orderdate").alias("a"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 3).cast("int"))).alias("z"),
    )
    urgent = spans.where("o_orderpriority = '1-URGENT'").drop("o_orderpriority")
    other = spans.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("other"), F.col("a").alias("b"), F.col("z").alias("y"))
    return bands.overlap_join(urgent, other, ("a", "z"), ("b", "y")).select("o_orderkey", "other")


@query(
    "param_row",
    "SELECT p_partkey, 'USD' AS currency, CAST(CAST(CAST(p_retailprice AS DECIMAL(15,2)) * CAST(1.21 AS DECIMAL(4,2)) AS DECIMAL(15,2)) AS VARCHAR) AS gross FROM part",
)
def param_row(spark, sf):
    df = joins.with_parameters(table(spark, sf, "part").select("p_partkey", "p_retailprice"), currency="USD", factor=1.21)
    gross = F.col("p_retailprice").cast("decimal(15,2)") * F.col("factor").cast("decimal(4,2)")
    return df.select("p_partkey", "currency", gross.cast("decimal(15,2)").cast("string").alias("gross"))


@query(
    "stream_lookup",
    """SELECT c_custkey, coalesce(n_name, 'DESCONOCIDO') AS nation, coalesce(n_regionkey, -1) AS region_id
       FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON n_nationkey = c_nationkey""",
)
def stream_lookup(spark, sf):
    nations = table(spark, sf, "nation").where("n_regionkey <> 3")
    return joins.stream_lookup(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"),
        nations,
        {"c_nationkey": "n_nationkey"},
        [LookupValue("n_name", "nation", "DESCONOCIDO"), LookupValue("n_regionkey", "region_id", -1)],
        ["n_name"],
    ).drop("c_nationkey")


@query(
    "db_lookup_eq",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, first_order, coalesce(status, 'none') AS status FROM lineitem
       JOIN orders ON o_orderkey = l_orderkey
       LEFT JOIN (SELECT o_custkey AS k, o_orderkey AS first_order, o_orderstatus AS status FROM orders
                  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON k = o_custkey""",
)
def db_lookup_eq(spark, sf):
    """The first order ever of each line's customer; many candidates per key, one comes back."""
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    stream = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joins.stream_lookup(
        stream,
        orders,
        {"o_custkey": "o_custkey"},
        [LookupValue("o_orderkey", "first_order"), LookupValue("o_orderstatus", "status", "none")],
        ["o_orderdate", "o_orderkey"],
    ).drop("o_orderkey", "o_custkey")


@query(
    "db_lookup_compare",
    """SELECT c_custkey, coalesce(supplier, 'none') AS supplier FROM customer LEFT JOIN (
         SELECT c_custkey AS k, min_by(s_name, (s_acctbal, s_suppkey)) AS supplier FROM customer
         JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal GROUP BY c_custkey) ON k = c_custkey""",
)
def db_lookup_compare(spark, sf):
    """The supplier of the customer's nation with the next higher balance."""
    return joins.database_lookup(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"),
        table(spark, sf, "supplier"),
        {"c_nationkey": "s_nationkey"},
        ("c_acctbal", "<", "s_acctbal"),
        [LookupValue("s_name", "supplier", "none")],
        ["s_acctbal", "s_suppkey"],
    ).select("c_custkey", "supplier")


@query(
    "db_lookup_compare_any",
    """SELECT p_partkey, coalesce(first_order, -1) AS first_order FROM part LEFT JOIN (
         SELECT p_partkey AS k, min(o_orderkey) AS first_order FROM part JOIN orders ON o_totalprice <= 2 * p_retailprice GROUP BY 1) ON k = p_partkey""",
)
def db_lookup_compare_any(spark, sf):
    """The first order that costs no more than twice the part, over all orders: no equality key."""
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * 2).alias("limit"))
    return joins.database_lookup(
        parts, table(spark, sf, "orders"), {}, ("limit", ">=", "o_totalprice"),
        [LookupValue("o_orderkey", "first_order", -1)], ["o_orderkey"],
    ).select("p_partkey", "first_order")


@query(
    "db_lookup_between_values",
    """SELECT c_custkey, coalesce(next_order, -1) AS next_order FROM customer LEFT JOIN (
         SELECT c_custkey AS k, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS next_order FROM customer
         JOIN orders ON o_custkey = c_custkey AND o_totalprice BETWEEN 20 * c_acctbal AND 40 * c_acctbal GROUP BY 1) ON k = c_custkey""",
)
def db_lookup_between_values(spark, sf):
    """The customer's cheapest order between twenty and forty times the balance."""
    customers = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") * 20).alias("low"), (F.col("c_acctbal") * 40).alias("high")
    )
    return joins.database_lookup(
        customers, table(spark, sf, "orders"), {"c_custkey": "o_custkey"}, ("low", "BETWEEN", "o_totalprice", "high"),
        [LookupValue("o_orderkey", "next_order", -1)], ["o_orderkey"],
    ).select("c_custkey", "next_order")


@query(
    "db_lookup_between",
    """WITH bands AS (SELECT 100.0 * r_regionkey AS lo, 100.0 * r_regionkey + 50 AS hi, r_name FROM region)
       SELECT event_id, coalesce(r_name, 'none') AS band FROM events LEFT JOIN bands ON value BETWEEN lo AND hi""",
)
def db_lookup_between(spark, sf):
    bands = table(spark, sf, "region").select(
        (F.col("r_regionkey") * 100.0).alias("lo"), (F.col("r_regionkey") * 100.0 + 50).alias("hi"), "r_name"
    )
    return interval_lookup(
        table(spark, sf, "events").select("event_id", "value"),
        bands, {}, "value", "lo", "hi", [LookupValue("r_name", "band", "none")], closed=True,
    ).select("event_id", "band")


@query(
    "db_lookup_between_key",
    """WITH bands AS (SELECT o_custkey AS k, o_orderdate AS lo, o_orderdate + INTERVAL 90 DAY AS hi, max(o_orderkey) AS band
                      FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
       SELECT o_orderkey, coalesce(band, -1) AS urgent_before FROM orders LEFT JOIN bands ON k = o_custkey AND o_orderdate >= lo AND o_orderdate < hi
       QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY lo DESC) = 1""",
)
def db_lookup_between_key(spark, sf):
    """The customer's urgent order of the last 90 days, the latest where several qualify."""
    orders = table(spark, sf, "orders")
    bands = (
        orders.where("o_orderpriority = '1-URGENT'")
        .groupBy("o_custkey", F.col("o_orderdate").alias("lo"))
        .agg(F.max("o_orderkey").alias("band"))
        .withColumn("hi", F.col("lo") + F.expr("INTERVAL 90 DAYS"))
    )
    return interval_lookup(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"),
        bands, {"o_custkey": "o_custkey"}, "o_orderdate", "lo", "hi", [LookupValue("band", "urgent_before", -1)],
    ).select("o_orderkey", "urgent_before")


@query(
    "db_lookup_nested",
    """WITH spans AS (SELECT k, lo, band, lo + to_days(CASE WHEN band % 2 = 0 THEN 30 ELSE 900 END) AS hi
                      FROM (SELECT o_custkey AS k, o_orderdate AS lo, max(o_orderkey) AS band FROM orders GROUP BY 1, 2))
       SELECT o_orderkey, coalesce(band, -1) AS holding FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 45 DAY AS moment FROM orders)
       LEFT JOIN spans ON k = o_custkey AND moment >= lo AND moment < hi
       QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY lo DESC) = 1""",
)
def db_lookup_nested(spark, sf):
    """Short spans lie inside long ones; after a short one ends the long one answers again."""
    orders = table(spark, sf, "orders")
    spans = (
        orders.groupBy("o_custkey", F.col("o_orderdate").alias("lo"))
        .agg(F.max("o_orderkey").alias("band"))
        .withColumn("hi", F.expr("lo + make_dt_interval(if(band % 2 = 0, 30, 900))"))
    )
    stream = orders.select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 45 DAYS")).alias("moment"))
    return interval_lookup(
        stream, spans, {"o_custkey": "o_custkey"}, "moment", "lo", "hi", [LookupValue("band", "holding", -1)]
    ).select("o_orderkey", "holding")


@query(
    "db_lookup_mixed_types",
    """SELECT 'price' AS kind, o_orderkey AS id, coalesce(p_partkey, -1) AS band FROM orders
       LEFT JOIN part ON o_totalprice >= p_partkey * 100 AND o_totalprice <= p_partkey * 100 + 50
       UNION ALL
       SELECT 'day', event_id, coalesce(n, -1) FROM events
       LEFT JOIN (SELECT CAST(ts AS DATE) AS lo, count(*) AS n FROM events GROUP BY 1)
              ON day(lo) % 2 = 0 AND ts >= lo AND ts < lo + 1""",
)
def db_lookup_mixed_types(spark, sf):
    """Fractions against whole bounds that belong to the interval, and moments against days."""
    bands = table(spark, sf, "part").selectExpr("p_partkey", "p_partkey * 100 AS lo", "p_partkey * 100 + 50 AS hi")
    prices = interval_lookup(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
        bands, {}, "o_totalprice", "lo", "hi", [LookupValue("p_partkey", "band", -1)], closed=True,
    )
    events = table(spark, sf, "events").select("event_id", "ts")
    days = events.groupBy(F.col("ts").cast("date").alias("lo")).agg(F.count("*").alias("n")).where("day(lo) % 2 = 0")
    counts = interval_lookup(
        events, days.withColumn("hi", F.date_add("lo", 1)), {}, "ts", "lo", "hi", [LookupValue("n", "band", -1)]
    )
    return prices.select(F.lit("price").alias("kind"), F.col("o_orderkey").alias("id"), "band").unionByName(
        counts.select(F.lit("day").alias("kind"), F.col("event_id").alias("id"), "band")
    )


@query(
    "merge_rows_diff",
    f"""WITH {CHANGES}, now AS (SELECT * FROM changes UNION ALL SELECT * FROM customer WHERE c_acctbal >= 1000)
        SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey,
               CASE WHEN n.c_custkey IS NULL THEN c.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment,
               CASE WHEN c.c_custkey IS NULL THEN 'new' WHEN n.c_custkey IS NULL THEN 'deleted'
                    WHEN n.c_mktsegment IS NOT DISTINCT FROM c.c_mktsegment THEN 'identical' ELSE 'changed' END AS flagfield
        FROM customer c FULL JOIN now n ON n.c_custkey = c.c_custkey""",
)
def merge_rows_diff(spark, sf):
    before = table(spark, sf, "customer")
    after = joins.union_streams(customer_changes(spark, sf), before.where("c_acctbal >= 1000"))
    return joins.merge_rows(before, after, ["c_custkey"], ["c_mktsegment"])


@query("exists_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def exists_in(spark, sf):
    orders = table(spark, sf, "orders").where("o_totalprice > 400000")
    return joins.exists_in(table(spark, sf, "customer"), orders, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query("not_exists_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def not_exists_in(spark, sf):
    orders = table(spark, sf, "orders").where("o_totalprice > 400000")
    return joins.not_exists_in(table(spark, sf, "customer"), orders, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query(
    "union_streams",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def union_streams(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return joins.union_streams(customers, suppliers)


@query(
    "split_rows",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word",
)
def split_rows(spark, sf):
    words = joins.split_to_rows(table(spark, sf, "documents").select("text"), "text", " ", "word")
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query(
    "split_rows_regex",
    "SELECT p_partkey, unnest(string_split_regex(p_name, '[ae]')) AS piece FROM part",
)
def split_rows_regex(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    return joins.split_to_rows(df, "p_name", "[ae]", "piece", regex=True).drop("p_name")


@query(
    "pivot",
    """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_finished, count(*) FILTER (o_orderstatus = 'O') AS n_open,
              CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) FILTER (o_orderstatus = 'P') AS DOUBLE) AS pending,
              coalesce(min_by(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F'), -1) AS first_finished
       FROM orders GROUP BY o_custkey""",
)
def pivot(spark, sf):
    df = table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)"))
    out = joins.denormalise(
        df,
        "o_orderstatus",
        ["o_custkey"],
        [
            Pivot("o_orderkey", "F", "n_finished", "COUNT"),
            Pivot("o_orderkey", "O", "n_open", "COUNT"),
            Pivot("o_totalprice", "P", "pending", "SUM"),
            Pivot("o_orderkey", "F", "first_finished"),
        ],
        ["o_orderdate", "o_orderkey"],
    )
    return if_null(out, {"first_finished": -1}).withColumn("pending", double("pending"))


@query(
    "unpivot",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, measure, amount FROM lineitem
       UNPIVOT (amount FOR measure IN (l_quantity, l_extendedprice))""",
)
def unpivot(spark, sf):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return joins.normalise(table(spark, sf, "lineitem"), ids, ["l_quantity", "l_extendedprice"], "measure", "amount")


# -- aggregation ---------------------------------------------------------------------------------

D15 = T.DecimalType(15, 2)


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast(D15))


@query(
    "group_by_sum",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS price
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def group_by_sum(spark, sf):
    out = aggregate.group_by(
        _lines(spark, sf),
        ["l_returnflag", "l_linestatus"],
        [Aggregate("quantity", "SUM", "l_quantity"), Aggregate("price", "SUM", "l_extendedprice")],
    )
    return out.withColumn("price", double("price"))


@query(
    "group_by_count",
    "SELECT lang, count(quality) AS n_labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
)
def group_by_count(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return aggregate.group_by(joined, ["lang"], [Aggregate("n_labelled", "COUNT", "quality")])


@query(
    "group_by_avg",
    "SELECT l_suppkey, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY l_suppkey",
)
def group_by_avg(spark, sf):
    out = aggregate.group_by(table(spark, sf, "lineitem"), ["l_suppkey"], [Aggregate("mean_quantity", "AVG", "l_quantity")])
    return out.withColumn("mean_quantity", F.round("mean_quantity", 6))


@query(
    "group_by_min_max",
    """SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
       FROM orders GROUP BY o_custkey""",
)
def group_by_min_max(spark, sf):
    out = aggregate.group_by(
        table(spark, sf, "orders"),
        ["o_custkey"],
        [Aggregate("low", "MIN", "o_totalprice"), Aggregate("high", "MAX", "o_totalprice"), Aggregate("last_day", "MAX", "o_orderdate")],
    )
    return out.withColumn("last_day", day("last_day"))


@query("group_by_count_all", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id")
def group_by_count_all(spark, sf):
    return aggregate.group_by(table(spark, sf, "events"), ["event_type", "user_id"], [Aggregate("n", "COUNT_ALL")])


@query(
    "group_by_global",
    "SELECT count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, sum(l_quantity) AS total FROM lineitem",
)
def group_by_global(spark, sf):
    return aggregate.group_by(
        table(spark, sf, "lineitem"),
        [],
        [
            Aggregate("n", "COUNT_ALL"), Aggregate("low", "MIN", "l_quantity"),
            Aggregate("high", "MAX", "l_quantity"), Aggregate("total", "SUM", "l_quantity"),
        ],
    )


@query(
    "preaggregate",
    """SELECT o_orderkey, o_custkey, n_lines, CAST(amount AS DOUBLE) AS amount FROM orders JOIN (
         SELECT l_orderkey, count(*) AS n_lines, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS amount
         FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def preaggregate(spark, sf):
    """Lines brought to one row per order before they meet the order, so nothing is multiplied."""
    per_order = aggregate.group_by(
        _lines(spark, sf), ["l_orderkey"], [Aggregate("n_lines", "COUNT_ALL"), Aggregate("amount", "SUM", "l_extendedprice")]
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = joins.merge_join(orders, per_order, ["o_orderkey"], ["l_orderkey"])
    return joined.drop("l_orderkey").withColumn("amount", double("amount"))


@query(
    "distinct_counts",
    """SELECT 'l_orderkey' AS "column", count(*) AS total_count, count(DISTINCT l_orderkey) AS distinct_count FROM lineitem
       UNION ALL SELECT 'l_partkey', count(*), count(DISTINCT l_partkey) FROM lineitem
       UNION ALL SELECT 'l_returnflag', count(*), count(DISTINCT l_returnflag) FROM lineitem""",
)
def distinct_counts(spark, sf):
    return aggregate.distinct_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"])


@query(
    "segment_customers",
    """SELECT c_custkey, coalesce(n_rows, 0) AS n_orders, CASE WHEN n_rows > 3 THEN 'FRECUENTE' ELSE 'REGULAR' END AS segment
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1)
       ON o_custkey = c_custkey""",
)
def segment_customers(spark, sf):
    period = table(spark, sf, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1999-01-01'")
    segments = aggregate.frequency_segment(period, "o_custkey")
    return joins.stream_lookup(
        table(spark, sf, "customer").select("c_custkey"),
        segments,
        {"c_custkey": "o_custkey"},
        [LookupValue("n_rows", "n_orders", 0), LookupValue("segment", default="REGULAR")],
        ["n_rows"],
    )


@query(
    "lead_lag",
    """SELECT o_orderkey, coalesce(lag(o_orderkey, 1) OVER w, -1) AS previous, lag(o_totalprice, 2) OVER w AS price_before_last,
              strftime(lead(o_orderdate, 1) OVER w, '%Y-%m-%d') AS next_day
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def lead_lag(spark, sf):
    out = aggregate.analytic_query(
        table(spark, sf, "orders"),
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        [("previous", "o_orderkey", "LAG", 1), ("price_before_last", "o_totalprice", "LAG", 2), ("next_day", "o_orderdate", "LEAD", 1)],
    )
    shown = out.select("o_orderkey", "previous", "price_before_last", day("next_day").alias("next_day"))
    return if_null(shown, {"previous": -1})


@query(
    "lead_lag_global",
    """SELECT event_id, coalesce(lag(event_id, 1) OVER w, -1) AS previous, lead(value, 3) OVER w AS later
       FROM events WINDOW w AS (ORDER BY ts, event_id)""",
)
def lead_lag_global(spark, sf):
    """No grouping: the whole table is one group and is cut into chunks once it is large."""
    df = table(spark, sf, "events").select("event_id", "ts", "value")
    out = aggregate.analytic_query(df, [], ["ts", "event_id"], [("previous", "event_id", "LAG", 1), ("later", "value", "LEAD", 3)])
    return if_null(out.select("event_id", "previous", "later"), {"previous": -1})
