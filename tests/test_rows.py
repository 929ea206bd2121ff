import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.casting import money, to_utc
from starloom.operators import rows
from starloom.operators.rows import Calculation, Condition


def test_null_goes_to_the_false_branch(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    kept, rest = rows.split_rows_by(df, Condition("v", ">", 2))
    assert [r["v"] for r in kept.collect()] == [5]
    assert sorted(map(str, [r["v"] for r in rest.collect()])) == ["1", "None"]
    with pytest.raises(ValueError):
        rows.filter_rows(df, Condition("v", "LIKE", 1))


def test_sort_is_case_insensitive_with_nulls_first(spark):
    df = spark.createDataFrame([("b",), ("A",), (None,), ("a",), ("C",)], "s string")
    got = [r["s"] for r in rows.sort_rows(df, ["s"]).collect()]
    assert got[0] is None and sorted(got[1:3]) == ["A", "a"] and got[3:] == ["b", "C"]
    got = [r["s"] for r in rows.sort_rows(df, [("s", False)]).collect()]
    assert got[0] == "C" and got[-1] is None


def test_unique_and_latest(spark):
    df = spark.createDataFrame([("x", 2), ("X", 1), ("x", 3)], "k string, n int")
    assert sorted(tuple(r) for r in rows.unique_rows(df, ["k"], ["n"]).collect()) == [("X", 1), ("x", 2)]
    assert [tuple(r) for r in rows.unique_rows(df, ["k"], ["n"], ["k"]).collect()] == [("X", 1)]
    assert sorted(tuple(r) for r in rows.latest_rows(df, ["k"], ["n"]).collect()) == [("X", 1), ("x", 3)]


def test_calculations_chain_and_do_not_fail(spark):
    df = spark.createDataFrame([(6, 3), (1, 0)], "a int, b int")
    out = rows.calculate(
        df,
        [Calculation("q", "DIVIDE", "a", "b"), Calculation("s", "ADD", "q", "a"), Calculation("m", "MULTIPLY", "a", "a", type=T.DecimalType(15, 2))],
    )
    assert [(r["q"], r["s"], str(r["m"])) for r in out.collect()] == [(2.0, 8.0, "36.00"), (None, None, "1.00")]


def test_date_constants_are_not_function_text(spark):
    with pytest.raises(ValueError):
        rows.add_constants(spark.range(1), {"d": ("NOW()", "Date")})
    got = rows.add_constants(spark.range(1), {"d": ("2024-01-31", "Date"), "e": ("", "String")}).first()
    assert (got["d"], got["e"]) == (dt.date(2024, 1, 31), None)


def test_literal_search_text(spark):
    df = spark.createDataFrame([("a.b[c]$A.B",)], "s string")
    assert rows.replace_in_string(df, "s", "a.b", "$1\\").first()["s"] == "$1\\[c]$$1\\"
    assert rows.replace_in_string(df, "s", "a.b", "-", case_sensitive=True).first()["s"] == "-[c]$A.B"


def test_value_mapper_defaults(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "s string")
    values = lambda out, c: [r[c] for r in out.collect()]
    assert values(rows.map_values(df, "s", {"a": "A"}), "s") == ["A", "z", None]
    assert values(rows.map_values(df, "s", {"a": "A"}, "t"), "t") == ["A", None, None]
    assert values(rows.map_values(df, "s", {"a": "A"}, "t", "?"), "t") == ["A", "?", "?"]


def test_ranges_are_half_open(spark):
    df = spark.createDataFrame([(0,), (10,), (20,), (None,)], "n int")
    out = rows.number_range(df, "n", [(0, 10, "low"), (10, 20, "mid"), (None, 5, "skipped")], "r", "none")
    assert [r["r"] for r in out.collect()] == ["low", "mid", "none", "none"]


def test_split_columns_and_regex(spark):
    df = spark.createDataFrame([("a| 7 |x",), ("b",)], "s string")
    out = rows.split_columns(df, "s", "|", [("p", "String", "none"), ("n", "Integer", "both")])
    assert [tuple(r) for r in out.collect()] == [("a", 7), ("b", None)]
    out = rows.regex_evaluation(df, "s", r"([a-z])\|.*", "ok", ["first"])
    assert [(r["ok"], r["first"]) for r in out.collect()] == [(True, "a"), (False, None)]


def test_money_needs_a_scale():
    with pytest.raises(ValueError):
        money(None, T.DoubleType())


def test_conform(spark):
    df = spark.createDataFrame([("1", 2.345, "extra")], "a string, m double, z string")
    out = rows.conform(df, T.StructType.fromDDL("m decimal(15,2), a int"))
    assert out.columns == ["m", "a"] and [str(v) for v in out.first()] == ["2.35", "1"]


def test_utc_follows_the_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 7, 1, 12),), (dt.datetime(2024, 1, 1, 12),)], "t timestamp_ntz")
    got = [r[0] for r in df.select(to_utc(F.col("t"), "Europe/Madrid")).collect()]
    assert got == [dt.datetime(2024, 7, 1, 10), dt.datetime(2024, 1, 1, 11)]
