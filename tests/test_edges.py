"""Answers at the edges that no given table reaches."""

import pytest
from pyspark.sql import functions as F

from starloom.operators import aggregate, marts, quality, rows
from starloom.operators.joins import merge_rows
from starloom.operators.sequence import add_sequence
from starloom.sinks.writers import json_blocks
from starloom.sources.readers import Field, read_csv


def test_series_are_whole_and_limits_take_the_newest(spark):
    days = spark.range(10_050).select(F.expr("date_add(DATE '1990-01-01', CAST(id AS INT))").alias("d"))
    assert marts.time_series(days, "d").count() == 10_050
    newest = marts.time_series(days, "d", limit=2).collect()
    assert [str(r.d) for r in newest] == ["2017-07-07", "2017-07-06"]


def test_sequence_past_its_maximum(spark):
    with pytest.raises(Exception, match="past 3"):
        add_sequence(spark.range(5), ["id"], "n", max_value=3).collect()
    assert sorted(r.n for r in add_sequence(spark.range(5), ["id"], "n").collect()) == [1, 2, 3, 4, 5]


def test_fan_out_takes_null_keys_as_equal(spark):
    before = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    after = spark.createDataFrame([(None,), (1,), (1,), (3,)], "k int")
    assert sorted(map(tuple, quality.fan_out(before, after, ["k"]).collect())) == [(1, 1, 2), (2, 1, 0)]


def test_full_match_stops_at_no_line_end(spark):
    df = spark.createDataFrame([("abc\n",), ("abc",)], "t string")
    assert [r.m for r in rows.regex_evaluation(df, "t", "abc", "m").collect()] == [False, True]


def test_value_mapper_on_numbers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert [r.n for r in rows.map_values(df, "n", {"1": "one"}).collect()] == ["one", "2", None]


def test_merge_rows_with_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(None, 1), (1, 1), (2, 1)], "k int, v int")
    new = spark.createDataFrame([(None, 1), (1, 2), (3, 1)], "k int, v int")
    got = {(r.k, r.v, r.flagfield) for r in merge_rows(old, new, ["k"], ["v"]).collect()}
    assert got == {(None, 1, "identical"), (1, 2, "changed"), (2, 1, "deleted"), (3, 1, "new")}
    with pytest.raises(Exception, match="repeated"):
        merge_rows(old, new.union(new), ["k"], ["v"]).collect()


def test_json_keeps_null_fields(spark):
    df = spark.createDataFrame([(1, None)], "id int, s string")
    assert json_blocks(df, {"id": "id", "s": "s"}, ["id"]).first().json_output == '{"data":[{"id":1,"s":null}]}'


def test_zero_has_no_sign_among_distinct_values(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (None,)], "x double")
    for approximate in (None, 0.05):
        assert [tuple(r) for r in aggregate.distinct_counts(df, ["x"], approximate).collect()] == [("x", 4, 2)]


def test_csv_groups_and_small_numbers(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a;b\n1.234;0,000000000012\n-12.345.678;1.234,5\n12.34;x\n7;\n")
    fields = [Field("a", "Integer"), Field("b", "Number")]
    got = [tuple(r) for r in read_csv(spark, str(path), fields, separator=";").collect()]
    assert got == [(1234, 0.000000000012), (-12345678, 1234.5), (None, None), (7, None)]
