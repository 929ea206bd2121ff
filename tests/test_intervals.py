"""Interval lookups against every pair: nested, tied and touching intervals, mixed types, cut keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from starloom.operators.intervals import interval_lookup
from starloom.operators.joins import LookupValue, database_lookup
from starloom.operators.ordered import SplitPolicy

VALUE = [LookupValue("v", default=-1)]


def intervals(seed, keys=3, count=60):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        low = rng.randrange(50)
        rows.append((rng.randrange(keys), low, low + rng.choice([0, 1, 2, 5, 20, 50, -3]), i))
    return [*rows, (None, 0, 90, 900), (0, None, 90, 901), (0, 3, None, 902)]


def brute(key, at, rows, closed):
    holding = [
        (low, v) for k, low, high, v in rows
        if None not in (k, low, high, key, at) and k == key and low <= at and (at <= high if closed else at < high)
    ]
    return max(holding)[1] if holding else -1


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("cuts", [SplitPolicy(), SplitPolicy(1.0, 10)])
def test_nested_and_tied(spark, closed, cuts):
    rows = intervals(5)
    points = [(i, k, at) for i, (k, at) in enumerate((k, at) for k in (0, 1, 2, 9, None) for at in [None, *[x / 2 for x in range(-4, 220)]])]
    stream = spark.createDataFrame(points, "id long, k int, at double")
    side = spark.createDataFrame(rows, "key int, lo int, hi int, v int")
    out = interval_lookup(stream, side, {"k": "key"}, "at", "lo", "hi", VALUE, closed, ["v"], cuts)
    assert {r.id: r.v for r in out.collect()} == {i: brute(k, at, rows, closed) for i, k, at in points}


def test_without_key(spark):
    side = spark.createDataFrame([(0, 100, 1), (10, 20, 2), (12, 14, 3)], "lo int, hi int, v int")
    stream = spark.range(0, 120).withColumnRenamed("id", "at")
    got = {r["at"]: r.v for r in interval_lookup(stream, side, {}, "at", "lo", "hi", VALUE).collect()}
    assert got == {x: 3 if 12 <= x < 14 else 2 if 10 <= x < 20 else 1 if x < 100 else -1 for x in range(120)}


def test_timestamps_in_days(spark):
    side = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 2), 7)], "lo date, hi date, v int")
    stream = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 0, 0)), (2, dt.datetime(2024, 1, 2, 0, 1))], "id int, at timestamp_ntz")
    got = {r.id: r.v for r in interval_lookup(stream, side, {}, "at", "lo", "hi", VALUE, closed=True).collect()}
    assert got == {1: 7, 2: -1}


def test_no_intervals_and_no_rows(spark):
    side = spark.createDataFrame([(0, 9, 1)], "lo int, hi int, v int")
    stream = spark.range(3).withColumnRenamed("id", "at")
    assert [r.v for r in interval_lookup(stream, side.limit(0), {}, "at", "lo", "hi", VALUE).collect()] == [-1] * 3
    assert interval_lookup(stream.limit(0), side, {}, "at", "lo", "hi", VALUE).collect() == []


def test_fractions_against_whole_numbers(spark):
    side = spark.createDataFrame([(10, 10), (11, 11)], "b int, v int")
    stream = spark.createDataFrame([(10.7,)], "a double")
    assert database_lookup(stream, side, {}, ("a", "<=", "b"), VALUE, ["v"]).first().v == 11
    assert database_lookup(stream, side, {}, ("a", ">", "b"), VALUE, ["v"]).first().v == 10


def test_no_single_task_without_a_group(spark):
    side = spark.range(50).select(F.col("id").alias("b"), F.col("id").alias("v"))
    stream = spark.range(5000).select((F.col("id") % 60).alias("a"))
    plan = database_lookup(stream, side, {}, ("a", "<=", "b"), VALUE, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_chunk" in plan


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("cuts", [SplitPolicy(), SplitPolicy(1.0, 10)])
def test_keys_without_nested_intervals(spark, closed, cuts):
    """Overlaps, gaps and ties whose ends rise with the starts: one pass answers, also beside keys with nested ones."""
    rng, rows = random.Random(6), []
    for key in (0, 1, 2):
        low = high = 0
        for i in range(60):
            low += rng.choice([0, 0, 1, 3, 9])
            high = max(high, low + rng.choice([0, 1, 6]))
            rows.append((key, low, high, 100 * key + i))
    nested = [(5, 0, 200, 900), (5, 7, 9, 901), (5, 8, 8, 902)]
    points = [(i, k, at) for i, (k, at) in enumerate((k, at) for k in (0, 1, 2, 5, 9, None) for at in [None, *[x / 2 for x in range(-4, 500)]])]
    stream = spark.createDataFrame(points, "id long, k int, at double")
    for side in (rows, rows + nested):
        table = spark.createDataFrame(side, "key int, lo int, hi int, v int")
        out = interval_lookup(stream, table, {"k": "key"}, "at", "lo", "hi", VALUE, closed, ["v"], cuts)
        assert {r.id: r.v for r in out.collect()} == {i: brute(k, at, side, closed) for i, k, at in points}


def test_one_deep_key_does_not_widen_the_others(spark):
    """Levels are a key's own: a key with thousands of bounds leaves the rows of shallow keys as they are."""
    from starloom.operators.intervals import last_started

    deep = [(0, i, 9_000 - i, i) for i in range(4_000)]
    shallow = [(k, 0, 10, k) for k in range(1, 500)] + [(k, 2, 5, k) for k in range(1, 500)]
    side = spark.createDataFrame(deep + shallow, "key int, _lower int, _upper int, p int").select("key", "_lower", "_upper", F.struct("_lower", "p").alias("_place"), F.struct("p").alias("_values"))
    assert last_started(side, ["key"], False, SplitPolicy()).where("key > 0").count() == 499 * 4
