"""Loads that keep refused rows, files with several header lines, samples of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import Check, Column
from starloom.sinks.checked import accepted_rows, load_checked, rejected_rows
from starloom.sources import readers
from starloom.sources.readers import Field

TARGET = [Column("id", T.LongType(), required=True), Column("name", T.VarcharType(4)), Column("price", T.DecimalType(6, 2)), Column("stock", T.IntegerType(), required=True, has_default=True), Column("day", T.DateType())]
SCHEMA = "id string, name string, price string, stock double, day string, more string"


def test_rows_are_judged_by_every_column(spark, tmp_path):
    rows = [
        ("1", "abcd", "12.34", 3.0, "2024-02-29", "x"), ("x", "abcde", "12.345", 3.5, "2024-02-30", None), (None, None, None, None, None, None),
        ("2", "", "99999.99", -1.0, None, "x"), ("3", "é中文😀", "-9999.99", 0.0, None, "x"), ("3", "é中文😀", "-9999.99", 0.0, None, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = load_checked(df, f"{tmp_path}/t", TARGET, [Check("stock", minimum=0)])
    good = sorted(tuple(r) for r in accepted_rows(spark, f"{tmp_path}/t", TARGET).select("id", "name", F.col("price").cast("string"), "stock", F.col("day").cast("string")).collect())
    assert good == [(1, "abcd", "12.34", 3, "2024-02-29"), (3, "é中文😀", "-9999.99", 0, None), (3, "é中文😀", "-9999.99", 0, None)]
    bad = {json.loads(r.row)["id"]: (json.loads(r.row), r.errors) for r in rejected_rows(spark, f"{tmp_path}/t", TARGET).collect()}
    assert bad["x"][1] == ["id: not a bigint", "name: longer than 4", "price: more than 2 decimals", "stock: more than 0 decimals", "day: not a date"]
    assert bad["x"][0] == dict(zip(["id", "name", "price", "stock", "day", "more"], rows[1], strict=True))
    assert bad[None][1] == ["id: missing"] and bad["2"][1] == ["price: not a decimal(6,2)", "stock: outside its range"]
    assert (counts.accepted, counts.rejected) == (3, 3) and counts.by_column == {"id": 2, "name": 1, "price": 2, "stock": 2, "day": 1}


def test_loads_append_and_missing_columns_are_null(spark, tmp_path):
    path, few = f"{tmp_path}/t", spark.createDataFrame([(1,), (None,)], "id long")
    assert load_checked(few, path, TARGET).rejected == 1
    load_checked(few, path, TARGET)
    assert [tuple(r) for r in accepted_rows(spark, path, TARGET).collect()] == [(1, None, None, None, None)] * 2
    load_checked(few.where("id = 1"), path, TARGET, truncate=True)
    assert accepted_rows(spark, path, TARGET).count() == 1 and rejected_rows(spark, path, TARGET).count() == 0
    everything = load_checked(few.drop("id").withColumn("name", F.lit("a")), path, TARGET)
    assert everything.accepted == 0 and everything.by_column["id"] == 2


def test_one_scan(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/in")
    reads = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            reads.add(part.num_rows)
            yield part

    df = spark.read.parquet(f"{tmp_path}/in").mapInArrow(seen, "id long")
    load_checked(df, f"{tmp_path}/out", [Column("id", T.IntegerType())], [Check("id", maximum=49)])
    assert reads.value == 100


# -- header lines ----------------------------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write_files(folder, seed):
    """Files of many splits; the last has fewer lines than the header. Line 2 of a header is longer than a split."""
    rng, files = random.Random(seed), {}
    for name in "abcd":
        head = ["report é", "x" * rng.choice([1, 350]), "id;text"]
        files[name] = head + [f"{name}{i};{'t' * rng.randrange(60)}" if rng.random() < 0.9 else "" for i in range(rng.randrange(40, 80))]
    files["e"] = ["report", "short"]
    for name, lines in files.items():
        (folder / f"{name}.txt").write_text("\n".join(lines) + ("\n" if name != "b" else ""), encoding="utf-8")
    return files


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits, seed):
    files = write_files(tmp_path, seed)
    rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    assert len({r.file for r in rows}) == 5
    assert {(r.file.rsplit("/", 1)[1][0], r.line): r.value for r in rows} == {(n, i + 1): x for n, lines in files.items() for i, x in enumerate(lines)}
    top = readers.numbered_lines(spark, str(tmp_path), upto=3).where("line IS NOT NULL").collect()
    assert sorted((r.file.rsplit("/", 1)[1][0], r.line) for r in top) == sorted((n, i + 1) for n, lines in files.items() for i in range(min(3, len(lines))))


@pytest.mark.parametrize("seed", [1, 2])
def test_header_lines_go_from_every_file(spark, tmp_path, small_splits, seed):
    files = write_files(tmp_path, seed)
    out = readers.read_text(spark, str(tmp_path), [Field("id"), Field("text")], header_lines=3)
    assert out.rdd.getNumPartitions() > 5
    want = sorted(tuple((*x.split(";"), None)[:2]) for lines in files.values() for x in lines[3:] if x)
    assert sorted((r.id, r.text or "") for r in out.collect()) == want


# -- samples ---------------------------------------------------------------------------------------


def files_read(df):
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        metrics = node.metrics()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += metrics.apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_drawn_files_are_whole_and_the_others_unread(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(20_000).repartition(200).write.parquet(path)
    whole = {r.f: r["n"] for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}
    drawn, kind = readers.sample_blocks(spark, path, 0.1, seed=1)
    sizes = {r._file: r["n"] for r in drawn.groupBy("_file").agg(F.count("*").alias("n")).collect()}
    assert kind == "file" and 8 <= len(sizes) <= 35 and all(whole[f] == n for f, n in sizes.items())
    assert files_read(drawn.select("id")) == len(sizes)
    again = readers.sample_blocks(spark, path, 0.1, seed=1)[0]
    assert {r._file for r in again.select("_file").distinct().collect()} == set(sizes) != {r._file for r in readers.sample_blocks(spark, path, 0.1, seed=2)[0].select("_file").distinct().collect()}
    rows, bias = readers.sample_pages(spark, path, 20, 0.1)
    assert rows.count() == 20 and bias == "page_level"


def test_small_tables_fall_back_to_rows(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/t")
    drawn, kind = readers.sample_blocks(spark, f"{tmp_path}/t", 1e-6)
    assert kind == "block" and drawn.count() == 0
    rows, bias = readers.sample_pages(spark, f"{tmp_path}/t", 20, 1e-6)
    assert rows.count() == 20 and bias == "row_level"
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert readers.sample_pages(spark, f"{tmp_path}/none")[0].count() == 0
