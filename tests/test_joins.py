"""Joins and lookups against brute force, also with large keys cut into chunks and spread by Spark."""

import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import intervals, joins
from starloom.operators.joins import LookupValue, Pivot
from starloom.operators.ordered import SplitPolicy

CUT = SplitPolicy(sample_fraction=1.0, max_group_rows=20)
PLAIN = SplitPolicy(sample_fraction=1.0, max_group_rows=10**9)


def skewed(rnd, n):
    """Keys of which one has half the rows, and some NULLs."""
    return [rnd.choice([1] * 5 + [2, 3, 4, 5, None]) for _ in range(n)]


@pytest.mark.parametrize("policy", [PLAIN, CUT], ids=["plain", "cut"])
@pytest.mark.parametrize("keyed", [True, False], ids=["key", "no key"])
@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "BETWEEN"])
def test_database_lookup(spark, policy, keyed, op):
    rnd = random.Random(hash((keyed, op)) % 1000)
    stream = [(i, k, rnd.choice([None, *range(30)]), rnd.randint(20, 40)) for i, k in enumerate(skewed(rnd, 150))]
    table = [(i, k, rnd.choice([None, *range(30)]), rnd.randint(0, 5)) for i, k in enumerate(skewed(rnd, 150))]
    left = spark.createDataFrame(stream, "id int, k int, x int, hi int")
    right = spark.createDataFrame(table, "tid int, tk int, y int, r int")
    comparison = ("x", op, "y", "hi") if op == "BETWEEN" else ("x", op, "y")
    got = joins.database_lookup(
        left, right, {"k": "tk"} if keyed else {}, comparison, [LookupValue("tid", "hit", -1)], ["r", "tid"], policy
    ).collect()
    test = {
        "<": lambda x, y, h: x < y, "<=": lambda x, y, h: x <= y, ">": lambda x, y, h: x > y,
        ">=": lambda x, y, h: x >= y, "BETWEEN": lambda x, y, h: x <= y <= h,
    }[op]
    best = (lambda t: (t[2], t[3], t[0])) if op == "BETWEEN" else (lambda t: (t[3], t[0]))
    want = {}
    for i, k, x, h in stream:
        matches = [
            t for t in table
            if x is not None and t[2] is not None and (not keyed or (k is not None and t[1] == k)) and test(x, t[2], h)
        ]
        want[i] = min(matches, key=best)[0] if matches else -1
    assert {r["id"]: r["hit"] for r in got} == want


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("policy", [PLAIN, CUT], ids=["join", "ordered"])
@pytest.mark.parametrize("keyed", [True, False], ids=["key", "no key"])
def test_interval_lookup(spark, policy, keyed, closed):
    """Overlapping intervals, open ends and NULLs: of those that hold the point, the one that starts last."""
    rnd = random.Random(7)
    stream = [(i, k, rnd.randint(0, 60)) for i, k in enumerate(skewed(rnd, 200))]
    starts = rnd.sample(range(200), 150)
    table = [
        (i, k, starts[i] % 60 * 1000 + starts[i], None if rnd.random() < 0.1 else starts[i] % 60 * 1000 + rnd.randint(0, 9000))
        for i, k in enumerate(skewed(rnd, 150))
    ]
    stream = [(i, k, x * 1000 + 7) for i, k, x in stream]
    got = intervals.interval_lookup(
        spark.createDataFrame(stream, "id int, k int, x int"),
        spark.createDataFrame(table, "tid int, tk int, lo int, hi int"),
        {"k": "tk"} if keyed else {}, "x", "lo", "hi", [LookupValue("tid", "hit", -1)], closed, ["tid"], policy,
    ).collect()
    want = {}
    for i, k, x in stream:
        holding = [
            t for t in table
            if t[3] is not None and t[2] <= x and (x <= t[3] if closed else x < t[3]) and (not keyed or (k is not None and t[1] == k))
        ]
        want[i] = max(holding, key=lambda t: (t[2], t[0]), default=[-1])[0]
    assert {r["id"]: r["hit"] for r in got} == want


def test_stream_lookup_first_by_order_and_defaults(spark):
    stream = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    table = spark.createDataFrame([("a", 5, "late"), ("a", 1, "early"), (None, 0, "null")], "k string, n int, v string")
    got = joins.stream_lookup(stream, table, {"k": "k"}, [LookupValue("v", "found", "none")], ["n"]).collect()
    assert sorted((r["id"], r["found"]) for r in got) == [(1, "early"), (2, "none"), (3, "none")]


def test_a_matched_null_is_not_a_miss(spark):
    stream = spark.createDataFrame([(1,), (2,)], "k int")
    table = spark.createDataFrame([(1, None)], "k int, v string")
    got = joins.stream_lookup(stream, table, {"k": "k"}, [LookupValue("v", default="none")], ["v"]).collect()
    assert sorted((r["k"], r["v"] or "") for r in got) == [(1, ""), (2, "none")]


def test_full_join_keeps_null_keys_of_both_sides(spark):
    left = spark.createDataFrame([(1, "l1"), (None, "l0"), (2, "l2")], "k int, l string")
    right = spark.createDataFrame([(1, "r1"), (1, "r1b"), (None, "r0"), (3, "r3")], "k int, r string")
    got = joins.merge_join(left, right, ["k"], ["k"], "FULL OUTER JOIN")
    assert got.columns == ["k", "l", "k_1", "r"]
    assert sorted(map(str, ((r["l"], r["r"]) for r in got.collect()))) == sorted(
        map(str, [("l1", "r1"), ("l1", "r1b"), ("l0", None), ("l2", None), (None, "r0"), (None, "r3")])
    )


def test_empty_side_empties_the_product(spark):
    empty = spark.createDataFrame([], "b int")
    assert joins.join_rows(spark.range(3), empty, "id >= b").count() == 0


def test_merge_rows_flags(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "b"), (5, "e"), (4, None)], "k int, v string")
    got = {r["k"]: (r["v"], r["flagfield"]) for r in joins.merge_rows(before, after, ["k"], ["v"]).collect()}
    assert got == {1: ("a", "identical"), 2: ("b", "changed"), 3: ("c", "deleted"), 4: (None, "identical"), 5: ("e", "new")}


def test_pivot_needs_an_order_for_first(spark):
    df = spark.createDataFrame([("g", "a", 2, 20), ("g", "a", 1, 10), ("g", "b", 3, None)], "g string, k string, o int, v int")
    got = joins.denormalise(df, "k", ["g"], [Pivot("v", "a", "a"), Pivot("v", "b", "b")], ["o"]).collect()
    assert [tuple(r) for r in got] == [("g", 10, None)]
    with pytest.raises(ValueError):
        joins.denormalise(df, "k", ["g"], [Pivot("v", "a", "a")])


def test_frequent_stream_key_is_split_at_run_time(spark):
    """A lookup against a table too large to broadcast, with a third of the rows on one key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10000",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
        stream = spark.range(60_000, numPartitions=8).select(F.col("id"), key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        table = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        out = joins.stream_lookup(stream, table, {"k": "k"}, [LookupValue("v")], ["v"])
        assert out.where("v = 2 * k").count() == 60_000
        out = joins.stream_lookup(stream, table, {"k": "k"}, [LookupValue("v")], ["v"])
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
