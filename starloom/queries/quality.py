"""Queries for data quality, profiling and summary marts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import Check, Column, DimContract
from starloom.operators import dimension, marts, profiling, quality
from starloom.operators.joins import union_streams
from starloom.operators.quality import Rule
from starloom.queries.registry import day, query, table
from starloom.queries.warehouse import HISTORY, _history

RULES = [
    Rule("p_name", "NAME_LONG", max_length=10),
    Rule("p_size", "SIZE_RANGE", minimum=5, maximum=45),
    Rule("p_type", "TYPE_VALUE", regex="[A-Z]+"),
    Rule("p_brand", "BRAND_FORMAT", regex="Brand#[0-9]{1,2}"),
    Rule("big_name", "NAME_MISSING", null_allowed=False),
]
RULES_SQL = """SELECT p_partkey, concat_ws(',', CASE WHEN length(p_name) > 10 THEN 'NAME_LONG' END,
    CASE WHEN p_size < 5 OR p_size > 45 THEN 'SIZE_RANGE' END, CASE WHEN NOT regexp_full_match(p_type, '[A-Z]+') THEN 'TYPE_VALUE' END,
    CASE WHEN NOT regexp_full_match(p_brand, 'Brand#[0-9]{1,2}') THEN 'BRAND_FORMAT' END,
    CASE WHEN p_size < 3 THEN 'NAME_MISSING' END) AS errors FROM part"""


def _parts(spark, sf):
    return table(spark, sf, "part").withColumn("big_name", F.when(F.col("p_size") >= 3, F.col("p_name")))


@query("validate_rows", f"SELECT p_partkey FROM ({RULES_SQL}) WHERE errors = ''")
def validate_rows(spark, sf):
    return quality.validate(_parts(spark, sf), RULES)[0].select("p_partkey")


@query("rejected_rows", f"SELECT p_partkey, errors FROM ({RULES_SQL}) WHERE errors <> ''")
def rejected_rows(spark, sf):
    return quality.validate(_parts(spark, sf), RULES)[1].select("p_partkey", "errors")


@query("rejected_rows_first", f"SELECT p_partkey, split_part(errors, ',', 1) AS errors FROM ({RULES_SQL}) WHERE errors <> ''")
def rejected_rows_first(spark, sf):
    return quality.validate(_parts(spark, sf), RULES, validate_all=False)[1].select("p_partkey", "errors")


POSITIVE = Rule("c_acctbal", "NEGATIVE", minimum=0.0)


@query("policy_reject", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def policy_reject(spark, sf):
    return quality.apply_policy(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), POSITIVE, "reject")


@query("policy_nullify", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def policy_nullify(spark, sf):
    return quality.apply_policy(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), POSITIVE, "nullify")


@query("policy_default", "SELECT c_custkey, greatest(c_acctbal, 0) AS c_acctbal FROM customer")
def policy_default(spark, sf):
    return quality.apply_policy(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), POSITIVE, "default", 0.0)


@query(
    "check_range",
    """SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity < 5) AS violations FROM lineitem
       UNION ALL SELECT 'l_discount', count(*) FILTER (l_discount > 0.08) FROM lineitem
       UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax < 0.01 OR l_tax > 0.05) FROM lineitem""",
)
def check_range(spark, sf):
    checks = [Check.compare("l_quantity", ">", 4, integer=True), Check("l_discount", maximum=0.08), Check("l_tax", 0.01, 0.05)]
    return quality.constraint_violations(table(spark, sf, "lineitem"), checks)


@query(
    "check_enum",
    """SELECT 'o_orderstatus' AS "column", count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS violations FROM orders
       UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) FROM orders""",
)
def check_enum(spark, sf):
    checks = [Check("o_orderstatus", values=("F", "O")), Check("o_orderpriority", values=("1-URGENT", "2-HIGH", "3-MEDIUM"))]
    return quality.constraint_violations(table(spark, sf, "orders"), checks)


@query("check_filter", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 5 AND l_tax BETWEEN 0.01 AND 0.05")
def check_filter(spark, sf):
    checks = [Check("l_quantity", minimum=5), Check("l_tax", 0.01, 0.05)]
    kept = quality.within_constraints(table(spark, sf, "lineitem"), checks)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "check_required",
    """SELECT 'quality' AS "column", count(*) FILTER (quality IS NULL) AS missing FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'author', count(*) FROM documents""",
)
def check_required(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    target = [
        Column("quality", T.IntegerType(), required=True),
        Column("lang", T.StringType(), required=True),
        Column("author", T.StringType(), required=True),
        Column("toxic", T.IntegerType(), required=True, has_default=True),
    ]
    return quality.required_violations(joined, target)


@query("check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def check_unique(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "check_orphans",
    """SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
       GROUP BY o_custkey""",
)
def check_orphans(spark, sf):
    customers = table(spark, sf, "customer").where("c_acctbal > 0")
    return quality.orphans(table(spark, sf, "orders"), customers, {"o_custkey": "c_custkey"})


@query(
    "check_unknown_share",
    f"""WITH {HISTORY} SELECT 'sk_cliente' AS "column", count(*) FILTER (sk IS NULL) AS unknown_rows FROM orders
        LEFT JOIN dim ON c_custkey = o_custkey AND o_orderdate >= lo AND o_orderdate < hi""",
)
def check_unknown_share(spark, sf):
    dim, contract = _history(spark, sf)
    found = dimension.dimension_lookup(table(spark, sf, "orders"), dim, contract, {"o_custkey": "id_cliente"}, "o_orderdate")
    return quality.unknown_share(found, ["sk_cliente"])


@query(
    "check_fanout",
    """SELECT o_custkey, count(DISTINCT o_orderkey) AS rows_before, count(l_orderkey) AS rows_after FROM orders
       LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) <> count(l_orderkey)""",
)
def check_fanout(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(table(spark, sf, "lineitem").select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.fan_out(orders, joined, ["o_custkey"])


@query(
    "check_intervals",
    """WITH v AS (SELECT o_custkey, o_orderkey AS version, o_orderdate AS lo,
                         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate + INTERVAL 40 DAY END AS hi FROM orders),
       n AS (SELECT *, lead(lo) OVER (PARTITION BY o_custkey ORDER BY lo, version) AS next_lo FROM v)
       SELECT o_custkey, version, strftime(lo, '%Y-%m-%d') AS lo, CASE WHEN hi IS NULL THEN 'open end is NULL' ELSE 'overlaps the next version' END AS problem
       FROM n WHERE hi IS NULL OR next_lo < hi""",
)
def check_intervals(spark, sf):
    """Orders read as versions of their customer that hold for forty days."""
    contract = DimContract(
        "versions", "sk", ("o_custkey",), version_field="version", date_from="lo", date_to="hi", unknown_key_value=-1
    )
    end = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS"))
    versions = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("sk"), F.col("o_orderkey").alias("version"),
        F.col("o_orderdate").alias("lo"), end.alias("hi"),
    )
    problems = quality.interval_problems(versions, contract, neighbours_only=True)
    return problems.select("o_custkey", "version", day("lo").alias("lo"), "problem")


@query(
    "check_intervals_nested",
    """WITH v AS (SELECT o_custkey, o_orderkey AS version, o_orderdate AS lo,
                         o_orderdate + to_days(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 700 ELSE 20 END) AS hi FROM orders),
       n AS (SELECT *, lead(lo) OVER w AS next_lo, lag(hi) OVER w AS last_hi,
                    max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
             FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY lo, version))
       SELECT o_custkey, version, strftime(lo, '%Y-%m-%d') AS lo,
              CASE WHEN next_lo < hi THEN 'overlaps the next version' ELSE 'lies in an earlier version' END AS problem
       FROM n WHERE next_lo < hi OR (reach > lo AND last_hi <= lo)""",
)
def check_intervals_nested(spark, sf):
    """Versions of very different lengths: short ones lie inside a long one that began several versions before."""
    contract = DimContract(
        "versions", "sk", ("o_custkey",), version_field="version", date_from="lo", date_to="hi", unknown_key_value=-1
    )
    days = F.when(F.col("o_orderpriority") == "5-LOW", 0).when(F.col("o_orderpriority") == "1-URGENT", 700).otherwise(20)
    versions = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("sk"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("lo"),
        (F.col("o_orderdate") + F.make_dt_interval(days)).alias("hi"),
    )
    return quality.interval_problems(versions, contract).select("o_custkey", "version", day("lo").alias("lo"), "problem")


@query(
    "cast_failures",
    """SELECT 'c_name' AS "column", count(*) FILTER (TRY_CAST(split_part(c_name, '#', 2) AS INTEGER) IS NULL) AS failures FROM customer
       UNION ALL SELECT 'c_mktsegment', count(*) FROM customer
       UNION ALL SELECT 'c_acctbal', count(*) FILTER (TRY_CAST(c_acctbal AS DECIMAL(5,2)) IS NULL) FROM customer""",
)
def cast_failures(spark, sf):
    df = table(spark, sf, "customer").select(
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("c_name"), "c_mktsegment", "c_acctbal"
    )
    return quality.cast_failures(
        df, {"c_name": T.LongType(), "c_mktsegment": T.DoubleType(), "c_acctbal": T.DecimalType(5, 2)}
    )


@query(
    "field_metadata",
    """WITH expected(name, want) AS (VALUES ('o_orderkey', 'bigint'), ('o_orderdate', 'date'), ('o_clerk', 'string')),
       actual AS (SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS have
                  FROM (DESCRIBE orders))
       SELECT coalesce(e.name, a.name) AS "column", want AS expected, have AS actual,
              CASE WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'unexpected' WHEN want <> have THEN 'type' ELSE 'ok' END AS state
       FROM expected e FULL JOIN actual a ON e.name = a.name""",
)
def field_metadata(spark, sf):
    expected = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_orderdate", T.DateType()),
            T.StructField("o_clerk", T.StringType()),
        ]
    )
    return quality.field_metadata(table(spark, sf, "orders"), expected)


# -- profiling -----------------------------------------------------------------------------------

# Tables and columns the profile queries look at.
PROFILED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "documents": ["doc_id", "text", "lang", "source"],
    "conversations": ["role", "text"],
    "pages": ["url"],
}


def _mixed_formats(spark, sf):
    """Text columns in the formats a profile recognises, made from the tables' own values."""
    orders = table(spark, sf, "orders")
    return orders.select(
        day("o_orderdate").alias("iso_day"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("slash_day"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@mail.example.com")).alias("address"),
        F.concat(F.lit("+54 11 "), F.format_string("%08d", F.col("o_orderkey"))).alias("phone"),
        F.concat(F.lit("SKU-"), F.col("o_orderkey").cast("string")).alias("code"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.lit("sí")).alias("flag"),
        F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("padded"),
        F.replace(F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("."), F.lit(",")).alias("comma"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_custkey")).alias("nullable_id"),
    )


FORMATS_SQL = """(SELECT strftime(o_orderdate, '%Y-%m-%d') AS iso_day, strftime(o_orderdate, '%d/%m/%Y') AS slash_day,
    'user' || CAST(o_custkey AS VARCHAR) || '@mail.example.com' AS address, '+54 11 ' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS phone,
    'SKU-' || CAST(o_orderkey AS VARCHAR) AS code, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'sí' END AS flag,
    ' ' || lower(o_orderpriority) AS padded,
    replace(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), '.', ',') AS comma,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS nullable_id FROM orders)"""
FORMATS = ["iso_day", "slash_day", "address", "phone", "code", "flag", "padded", "comma", "nullable_id"]


def _profile_sql(source: str, columns: list[str], select: str, prefix: str = "") -> list[str]:
    """The profile of each column, written out per column."""
    date = " OR ".join(f"regexp_matches(s, '{p}')" for p, _ in profiling.DATE_PATTERNS)
    parts = []
    for c in columns:
        cells = f"SELECT CAST({c} AS VARCHAR) AS v, nullif(regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g'), '') AS s FROM {source}"
        kinds = f"""SELECT *, regexp_replace(s, '[^\\p{{L}}]', '', 'g') AS l,
            CASE WHEN lower(s) IN ('true','false','yes','no','1','0','si','sí') THEN 'bool' WHEN {date} THEN 'date'
                 WHEN regexp_matches(s, '{profiling.INTEGER}') THEN 'int' WHEN regexp_matches(s, '{profiling.FLOAT}') THEN 'float' END AS kind
            FROM ({cells})"""
        share = lambda test: f"count(*) FILTER ({test}) / nullif(count(s), 0)"
        matches = lambda p: share(f"regexp_matches(s, '{p}')")
        layouts = " ".join(f"WHEN {matches(p)} >= 0.7 THEN '{label}'" for p, label in profiling.DATE_PATTERNS)
        facts = f"""SELECT '{prefix}{c}' AS "column", count(*) AS total_count, count(*) - count(v) AS null_count,
            count(DISTINCT v) AS distinct_count, CAST(min(length(v)) AS INTEGER) AS min_length, CAST(max(length(v)) AS INTEGER) AS max_length,
            round(coalesce((count(*) - count(v)) / nullif(count(*), 0), 0), 3) AS null_pct,
            round(coalesce(count(*) FILTER (v <> regexp_replace(v, '^\\s+|\\s+$', '', 'g')) / nullif(count(v), 0), 0), 3) AS spaces_pct,
            count(*) FILTER (l <> '') AS cased,
            count(*) FILTER (l <> '' AND l = upper(l)) AS uppers, count(*) FILTER (l <> '' AND l <> upper(l) AND l = lower(l)) AS lowers,
            count(*) FILTER (l <> '' AND l <> upper(l) AND l <> lower(l) AND l = upper(left(l, 1)) || lower(substr(l, 2))) AS titles,
            CASE WHEN count(s) = 0 THEN 'unknown' WHEN {share("kind = 'bool'")} >= 0.7 THEN 'bool' WHEN {share("kind = 'date'")} >= 0.7 THEN 'date'
                 WHEN {share("kind = 'int'")} >= 0.7 THEN 'int' WHEN {share("kind = 'float'")} >= 0.7 THEN 'float' ELSE 'string' END AS inferred_type,
            CASE {layouts} ELSE 'date (format unclear)' END AS layout,
            CASE WHEN {matches(profiling.EMAIL)} >= 0.7 THEN 'email' WHEN {matches(profiling.PHONE)} >= 0.7 THEN 'phone number'
                 WHEN count(DISTINCT v) <= 20 THEN 'enum-like (' || count(DISTINCT v) || ' distinct values)'
                 WHEN {matches(profiling.DIGITS)} >= 0.8 THEN 'numeric ID' WHEN {matches(profiling.CODE)} >= 0.8
                 THEN 'alphanumeric code (e.g., SKU, document number)' END AS wording,
            list_sort(list(DISTINCT s) FILTER (s IS NOT NULL))[1:3] AS smallest
            FROM ({kinds})"""
        parts.append(
            f"""SELECT {select} FROM (SELECT *, CASE inferred_type WHEN 'date' THEN layout WHEN 'string' THEN wording END AS format_hint,
                round(coalesce(uppers / nullif(cased, 0), 0), 3) AS upper_pct, round(coalesce(lowers / nullif(cased, 0), 0), 3) AS lower_pct,
                round(coalesce(titles / nullif(cased, 0), 0), 3) AS title_pct,
                round(coalesce((cased - uppers - lowers - titles) / nullif(cased, 0), 0), 3) AS mixed_pct FROM ({facts}))"""
        )
    return parts


def _all_sql(select: str) -> str:
    parts = _profile_sql(FORMATS_SQL, FORMATS, select)
    for name, columns in PROFILED.items():
        parts += _profile_sql(name, columns, select, f"{name}.")
    return " UNION ALL ".join(parts)


def _all_profiles(spark, sf):
    profiles = [profiling.profile(_mixed_formats(spark, sf))]
    for name, columns in PROFILED.items():
        p = profiling.profile(table(spark, sf, name), columns)
        profiles.append(p.withColumn("column", F.concat(F.lit(f"{name}."), "column")))
    return union_streams(*profiles)


def _register_profile(name, columns):
    @query(name, _all_sql(", ".join(f'"{c}"' for c in ["column", *columns])))
    def run(spark, sf):
        return _all_profiles(spark, sf).select("column", *columns)


for _name, _columns in {
    "profile_stats": ["total_count", "null_count", "null_pct", "distinct_count", "min_length", "max_length"],
    "infer_types": ["inferred_type"],
    "casing": ["upper_pct", "lower_pct", "title_pct", "mixed_pct"],
    "spaces_pct": ["spaces_pct"],
    "format_hint": ["format_hint"],
}.items():
    _register_profile(_name, _columns)


LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_PROFILE = [
    "column", "inferred_type", "total_count", "null_count", "null_pct", "distinct_count", "min_length", "max_length",
    "spaces_pct", "upper_pct", "lower_pct", "title_pct", "mixed_pct", "format_hint",
]


@query("profile_table", " UNION ALL ".join(_profile_sql("lineitem", LINE_COLUMNS, ", ".join(f'"{c}"' for c in LINE_PROFILE))))
def profile_table(spark, sf):
    """Everything about every column of the widest table, in one pass."""
    return profiling.profile(table(spark, sf, "lineitem"), LINE_COLUMNS).select(*LINE_PROFILE)


@query(
    "masked_examples",
    """WITH p AS (""" + " UNION ALL ".join(_profile_sql(FORMATS_SQL, FORMATS, '"column", format_hint, distinct_count, smallest')) + r""")
       SELECT "column", CASE WHEN distinct_count >= 10 AND regexp_matches(lower(format_hint), 'email|phone|tel|celular|fecha|date|yyyy|document|alphanumeric|numeric id')
           THEN array_to_string(list_transform(smallest, lambda x: CASE
             WHEN format_hint = 'email' THEN left(x, 1) || '***@***.com'
             WHEN format_hint = 'phone number' THEN regexp_replace(x, '[0-9]', '*', 'g')
             WHEN contains(format_hint, 'YYYY') THEN regexp_replace(x, '[0-9]', 'X', 'g')
             ELSE regexp_replace(regexp_replace(x, '[0-9]', '*', 'g'), '\p{L}', 'X', 'g') END), '|') END AS examples FROM p""",
)
def masked_examples(spark, sf):
    p = profiling.profile(_mixed_formats(spark, sf))
    return p.select("column", F.array_join("masked_examples", "|").alias("examples"))


@query(
    "semantic_types",
    "WITH columns AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS t, column_name AS name, column_type AS type FROM (DESCRIBE {t})" for t in ("customer", "orders", "lineitem", "events"))
    + r""")
       SELECT name AS "column", CASE WHEN name LIKE '%\_id' ESCAPE '\' THEN 'id' WHEN type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'metric'
                                    WHEN name LIKE '%date' THEN 'date' ELSE 'category' END AS semantic_type,
              NOT name LIKE '%\_id' ESCAPE '\' AS usable, t AS "table" FROM columns""",
)
def semantic_types(spark, sf):
    names = ["customer", "orders", "lineitem", "events"]
    return union_streams(
        *[profiling.semantic_types(table(spark, sf, n)).withColumn("table", F.lit(n)) for n in names]
    )


# -- marts ---------------------------------------------------------------------------------------


def _priced(spark, sf):
    return table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)"))


@query("kpi_total", "SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS value FROM orders")
def kpi_total(spark, sf):
    return marts.kpi_total(_priced(spark, sf), "o_totalprice").withColumn("value", F.col("value").cast("double"))


@query("kpi_count", "SELECT count(*) AS value FROM lineitem")
def kpi_count(spark, sf):
    return marts.kpi_total(table(spark, sf, "lineitem"))


@query(
    "time_series",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS value
       FROM orders GROUP BY orders.o_orderdate ORDER BY orders.o_orderdate""",
)
def time_series(spark, sf):
    out = marts.time_series(_priced(spark, sf), "o_orderdate", "o_totalprice")
    return out.select(day("o_orderdate").alias("o_orderdate"), F.col("value").cast("double").alias("value"))


@query(
    "by_category",
    """SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS value FROM customer
       GROUP BY c_mktsegment ORDER BY c_mktsegment""",
)
def by_category(spark, sf):
    customers = table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))
    return marts.by_category(customers, "c_mktsegment", "c_acctbal").withColumn("value", F.col("value").cast("double"))


@query(
    "distribution",
    """SELECT source, count(*) AS value, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents
       GROUP BY source ORDER BY value DESC, source""",
)
def distribution(spark, sf):
    return marts.distribution(table(spark, sf, "documents"), "source").withColumn("share", F.round("share", 9))


@query(
    "detail_table",
    "SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey",
)
def detail_table(spark, sf):
    return marts.detail_table(table(spark, sf, "orders"), "o_custkey")


@query("detail_table_raw", "SELECT c_acctbal FROM customer ORDER BY c_acctbal DESC")
def detail_table_raw(spark, sf):
    return marts.detail_table(table(spark, sf, "customer"), "c_acctbal", raw=True)


# -- control -------------------------------------------------------------------------------------


@query(
    "row_threshold",
    """SELECT CAST(10 AS BIGINT) AS threshold, count(*) > 10 AS exceeded FROM orders
       UNION ALL SELECT 1000000000, count(*) > 1000000000 FROM orders""",
)
def row_threshold(spark, sf):
    """Both outcomes of the same stream."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    limits = (10, 1_000_000_000)
    found = [(n, quality.abort_above(orders, n, with_error=False)) for n in limits]
    return spark.createDataFrame(found, "threshold long, exceeded boolean")


@query(
    "row_metrics",
    """SELECT count(*) AS n_rows, count(*) FILTER (quality IS NULL) AS null_quality, count(*) FILTER (lang IS NULL) AS null_lang
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def row_metrics(spark, sf):
    """Counted while the rows are written elsewhere."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    seen, metrics = quality.row_metrics(joined, "documents", ["quality", "lang"])
    seen.write.format("noop").mode("overwrite").save()
    counts = metrics.get
    row = (counts["rows"], counts["null_quality"], counts["null_lang"])
    return spark.createDataFrame([row], "n_rows long, null_quality long, null_lang long")
