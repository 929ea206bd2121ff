"""Sources and sinks on real files."""

import json

import pytest
from pyspark.sql import functions as F

from starloom.contracts import layer_of, spark_type
from starloom.operators import marts
from starloom.sinks import writers
from starloom.sources import readers
from starloom.sources.readers import Field


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_nulls_and_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,name,amount,active,day\n1,"Perez, ""Juan""","€ 1.234,56",sí,2024-01-31\n2,,"-0,5",no,\nx,Ñandú,abc,?,2024-13-01\n')
    fields = [Field("id", "Integer"), Field("name"), Field("amount", "Number", length=15, precision=2), Field("active", "Boolean"), Field("day", "Date")]
    got = [tuple(map(str, r)) for r in readers.read_csv(spark, path, fields).collect()]
    assert got == [
        ("1", 'Perez, "Juan"', "1234.56", "True", "2024-01-31"),
        ("2", "None", "-0.50", "False", "None"),
        ("None", "Ñandú", "None", "None", "None"),
    ]


def test_text_file_skips_blank_lines_and_trims(spark, tmp_path):
    path = write(tmp_path / "a.txt", "id;name;v\n1;  a  ;2.5\n\n ; ;\n2;b;x\n")
    fields = [Field("id", "Integer"), Field("name", trim="both"), Field("v", "Number")]
    assert [tuple(r) for r in readers.read_text(spark, path, fields).collect()] == [(1, "a", 2.5), (2, "b", None)]
    more = write(tmp_path / "b.txt", "list of ids\n\nid;name;v\n1;  a  ;2.5\n\n ; ;\n2;b;x\n")
    assert [tuple(r) for r in readers.read_text(spark, more, fields, header_lines=3).collect()] == [(1, "a", 2.5), (2, "b", None)]


def test_json_paths_and_nulls(spark, tmp_path):
    path = write(tmp_path / "a.json", '{"a": {"b": "7"}, "c": null}\n{"c": "x"}\n{"z": 1}\n')
    fields = [Field("b", "Integer", path="$.a.b"), Field("c")]
    assert [tuple(r) for r in readers.read_json(spark, path, fields).collect()] == [(7, None), (None, "x")]
    assert readers.read_json(spark, path, fields, include_nulls=True).count() == 3


def test_jdbc_options():
    whole = readers.jdbc_options("jdbc:postgresql://host/db", "SELECT 1")
    assert whole["query"] == "SELECT 1" and "dbtable" not in whole
    split = readers.jdbc_options("jdbc:sqlserver://host", "SELECT * FROM t", "id", (1, 100), 8)
    assert split["dbtable"] == "(SELECT * FROM t) source" and split["numPartitions"] == "8" and split["upperBound"] == "100"
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "SELECT 1", "id")


def test_generated_rows(spark):
    got = readers.generate_rows(spark, 3, {"a": ("x", "String"), "n": ("5", "Integer"), "e": ("", "String")}).collect()
    assert [tuple(r) for r in got] == [("x", 5, None)] * 3


def test_sample_is_bounded_and_falls_back(spark):
    sample, kind = readers.sample_rows(spark.range(10_000), 20, 0.1)
    assert kind == "fraction" and sample.count() == 20
    sample, kind = readers.sample_rows(spark.range(3), 20, 0.0)
    assert kind == "random" and sorted(r["id"] for r in sample.collect()) == [0, 1, 2]


COMMA = "id,name,amount,active,created_at\n1,Ana,10.5,true,2024-01-15\n2,Luis,,false,\n3,Eva,7.25,true,2024-03-01\n"


@pytest.mark.parametrize(
    "text, types",
    [
        (COMMA, {"id": "integer", "name": "string", "amount": "number", "active": "boolean", "created_at": "date"}),
        ("id;name;value\n1;a;2\n2;b;3\n", {"id": "integer", "name": "string", "value": "integer"}),
        ("nombre,valor\nÁngel,1\nÑandú,2\n", {"nombre": "string", "valor": "integer"}),
        ("d|n\n15-01-2024|1\n16-02-2024|2\n", {"d": "date", "n": "integer"}),
    ],
)
def test_file_schema(spark, tmp_path, text, types):
    got = readers.infer_file_schema(spark, write(tmp_path / "f.csv", text)).collect()
    assert {r["column"]: r["canonical_type"] for r in got} == types
    if text is COMMA:
        assert {r["column"]: r["null_pct"] for r in got}["amount"] == 0.333


def test_empty_file_has_no_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.infer_file_schema(spark, write(tmp_path / "e.csv", "\n"))


def test_text_output_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"'), (2, "ñ")], "id int, s string")
    path = str(tmp_path / "out")
    writers.write_text(df, path)
    writers.write_text(df, path, append=True)
    got = readers.read_text(spark, path, [Field("id", "Integer"), Field("s")]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 'a;"b"')] * 2 + [(2, "ñ")] * 2


def test_json_blocks(spark, tmp_path):
    df = spark.range(5).withColumn("n", F.when(F.col("id") != 1, F.col("id") * 10))
    path = str(tmp_path / "json")
    writers.write_json(df, path, {"key": "id", "value": "n"}, ["id"], 2, "rows")
    lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    lines.sort(key=lambda d: d["rows"][0]["key"])
    assert lines == [
        {"rows": [{"key": 0, "value": 0}, {"key": 1, "value": None}]},
        {"rows": [{"key": 2, "value": 20}, {"key": 3, "value": 30}]},
        {"rows": [{"key": 4, "value": 40}]},
    ]
    with pytest.raises(ValueError):
        writers.json_blocks(df, {"key": "id"}, ["id"], 0)


def test_publish_replaces_a_table_computed_from_itself(spark):
    writers.publish(spark.range(3), "dim_published")
    for _ in range(3):
        writers.publish(spark.table("dim_published").selectExpr("id + 1 as id"), "dim_published", ["id"], 2)
    assert sorted(r["id"] for r in spark.table("dim_published").collect()) == [3, 4, 5]
    assert writers.drop_old_versions(spark, "dim_published") == ["dim_published__v1", "dim_published__v2"]
    assert sorted(r["id"] for r in spark.table("dim_published").collect()) == [3, 4, 5]


def test_merge_into_needs_a_table_with_row_level_changes(spark):
    spark.range(3).selectExpr("id", "id as v").write.mode("overwrite").saveAsTable("plain_table")
    with pytest.raises(Exception, match="(?i)merge|unsupported|not support"):
        writers.merge_into(spark.range(5).selectExpr("id", "0 as v"), "plain_table", ["id"])


def test_layers_and_types():
    assert (layer_of("db.stg_x"), layer_of("FACT_VENTAS"), layer_of("other")) == ("staging", "dwh", "unknown")
    assert spark_type("Number", 15, 2).simpleString() == "decimal(15,2)"
    assert spark_type("Number").simpleString() == "double"
    with pytest.raises(ValueError):
        spark_type("tensor")


def test_marts_refuse_load_dates_and_share_the_whole(spark):
    df = spark.range(300).selectExpr("id % 150 as c", "current_date() as fecha_carga")
    with pytest.raises(ValueError):
        marts.time_series(df, "fecha_carga")
    got = marts.distribution(df, "c").collect()
    assert len(got) == 150 and abs(got[0]["share"] - 2 / 300) < 1e-12
    assert marts.chart_kind(15) == "pie" and marts.chart_kind(16) == "bar"
    assert marts.business_categories(["ciudad", "moneda", "id_x", "estado"]) == ["ciudad"]
