import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from starloom.contracts import Check, Column, DimContract
from starloom.operators import quality
from starloom.operators.ordered import SplitPolicy
from starloom.operators.quality import Rule


def test_rules(spark):
    df = spark.createDataFrame(
        [(1, "abc", "12", "2024-01-31"), (2, "toolong", "1x", "31/01/2024"), (3, None, None, None), (4, "", "5", "2024-02-30")],
        "id int, name string, n string, d string",
    )
    rules = [
        Rule("name", "LEN", min_length=1, max_length=5),
        Rule("name", "NULL", null_allowed=False),
        Rule("n", "NUM", only_numeric=True),
        Rule("n", "RANGE", type=T.LongType(), minimum=10),
        Rule("d", "DATE", mask="YYYY-MM-DD"),
    ]
    got = {r["id"]: r["errors"] for r in quality.with_errors(df, rules).collect()}
    assert got == {1: None, 2: "LEN,NUM,RANGE,DATE", 3: "NULL", 4: "LEN,RANGE,DATE"}
    valid, rejected = quality.validate(df, rules, validate_all=False)
    assert [r["id"] for r in valid.collect()] == [1]
    assert {r["id"]: r["errors"] for r in rejected.collect()} == {2: "LEN", 3: "NULL", 4: "LEN"}


def test_policies(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, v int")
    rule = Rule("v", "POSITIVE", minimum=0)
    values = lambda policy, **k: {r["id"]: r["v"] for r in quality.apply_policy(df, rule, policy, **k).collect()}
    assert values("reject") == {1: 5, 3: None}
    assert values("nullify") == {1: 5, 2: None, 3: None}
    assert values("default", default=0) == {1: 5, 2: 0, 3: None}
    with pytest.raises(ValueError):
        quality.apply_policy(df, rule, "ignore")


def test_check_bounds():
    assert Check.compare("n", ">", 0, integer=True) == Check("n", minimum=1)
    assert Check.compare("n", "<", 10, integer=True) == Check("n", maximum=9)
    assert Check.compare("n", ">=", 0.5) == Check("n", minimum=0.5)
    assert Check.compare("n", ">", 0.5) is None


def test_constraint_counts(spark):
    df = spark.createDataFrame([(-1, "A"), (5, "Z"), (200, None), (None, "B")], "n int, s string")
    checks = [Check("n", 0, 120), Check("s", values=("A", "B", "C"))]
    assert {r["column"]: r["violations"] for r in quality.constraint_violations(df, checks).collect()} == {"n": 2, "s": 1}
    assert [r["n"] for r in quality.within_constraints(df, checks).collect()] == [None]


def test_required(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    target = [
        Column("a", T.IntegerType(), required=True), Column("b", T.IntegerType(), required=True, has_default=True),
        Column("c", T.IntegerType(), required=True),
    ]
    assert {r["column"]: r["missing"] for r in quality.required_violations(df, target).collect()} == {"a": 1, "c": 2}


def test_field_metadata(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, z double")
    expected = T.StructType.fromDDL("a int, b date, c string")
    got = {r["column"]: r["state"] for r in quality.field_metadata(df, expected).collect()}
    assert got == {"a": "ok", "b": "type", "c": "missing", "z": "unexpected"}


def test_abort(spark):
    assert quality.abort_above(spark.range(3), 3) is False
    with pytest.raises(quality.RowThresholdExceeded, match="too many"):
        quality.abort_above(spark.range(4), 3, "too many")
    assert quality.abort_above(spark.range(4), 3, with_error=False) is True


def test_row_metrics(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    seen, metrics = quality.row_metrics(df, "stage", ["b"])
    assert seen.count() == 2
    assert metrics.get == {"rows": 2, "null_b": 1}


def test_interval_problems(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    dim = spark.createDataFrame(
        [(1, 1, 1, at(1), at(5)), (2, 1, 2, at(4), at(9)), (3, 2, 1, at(1), None), (4, 3, 1, at(7), at(6)), (5, 4, 1, at(1), at(2)), (6, 4, 2, at(2), at(3))],
        "sk int, k int, version int, date_from timestamp_ntz, date_to timestamp_ntz",
    )
    contract = DimContract("d", "sk", ("k",), attributes_scd1=())
    got = {(r["k"], r["version"]): r["problem"] for r in quality.interval_problems(dim, contract).collect()}
    assert got == {(1, 1): "overlaps the next version", (2, 1): "open end is NULL", (3, 1): "ends before it starts"}


@pytest.mark.parametrize("policy", [SplitPolicy(), SplitPolicy(1.0, 8)])
def test_nested_and_chained_intervals(spark, policy):
    contract = DimContract("d", "sk", ("k",), attributes_scd1=())
    rng, rows = random.Random(9), [(1, 0, 1, 1, 100), (2, 0, 2, 2, 3), (3, 0, 3, 50, 60), (4, 0, 4, 100, 200)]
    for sk in range(10, 400):
        low = rng.randrange(1, 300)
        rows.append((sk, rng.randrange(1, 9), sk, low, rng.choice([None, low + rng.choice([-2, 0, 1, 4, 30, 150])])))
    at = lambda n: None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    dim = spark.createDataFrame([(sk, k, v, at(a), at(b)) for sk, k, v, a, b in rows], "sk int, k int, version int, date_from timestamp_ntz, date_to timestamp_ntz")
    want = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[3], r[2]))
        for i, (_, _, version, low, high) in enumerate(own):
            ends = [r[4] for r in own[:i] if r[4] is not None and r[4] > r[3]]
            last = own[i - 1][4] if i else None
            if high is None:
                want[key, version] = "open end is NULL"
            elif high < low:
                want[key, version] = "ends before it starts"
            elif i + 1 < len(own) and own[i + 1][3] < high:
                want[key, version] = "overlaps the next version"
            elif ends and max(ends) > low and not (last is not None and last > low):
                want[key, version] = "lies in an earlier version"
    got = {(r["k"], r["version"]): r["problem"] for r in quality.interval_problems(dim, contract, policy).collect()}
    assert got == want and got[0, 1] == "overlaps the next version" and got[0, 3] == "lies in an earlier version" and (0, 4) not in got
    near = quality.interval_problems(dim, contract, policy, neighbours_only=True)
    assert {(r["k"], r["version"]) for r in near.collect()} == {k for k, v in want.items() if v != "lies in an earlier version"}


def test_fan_out_and_orphans(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,)], "k2 int")
    joined = left.join(right, left.k == right.k2)
    got = {r["k"]: (r["rows_before"], r["rows_after"]) for r in quality.fan_out(left.where("k is not null"), joined, ["k"]).collect()}
    assert got == {1: (1, 2), 2: (2, 0)}
    assert [tuple(r) for r in quality.orphans(left, right, {"k": "k2"}).collect()] == [(2, 2)]
