import datetime as dt

import pytest

from starloom.operators import merge
from starloom.operators.fact import GrainViolation, checked_grain, convert_currency, load_fact

TARGET = "k int, a string, b string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "a1", "b1"), (2, "a2", "b2"), (None, "a0", "b0")], TARGET)


def test_upsert_sets_only_update_columns(spark, target):
    source = spark.createDataFrame([(2, "A", "B"), (3, "A", "B"), (None, "A", "B")], TARGET)
    got = merge.upsert(target, source, ["k"], ["b"])
    assert rows(got) == rows(
        spark.createDataFrame(
            [(1, "a1", "b1"), (2, "a2", "B"), (3, "A", "B"), (None, "a0", "b0"), (None, "A", "B")], TARGET
        )
    )


def test_repeated_keys_act_in_order(spark, target):
    source = spark.createDataFrame([(9, "third", "z", 3), (9, "first", "x", 1), (1, "p", "q", 2)], TARGET + ", n int")
    target = target.selectExpr("*", "0 as n")
    got = {r["k"]: (r["a"], r["b"]) for r in merge.upsert(target, source, ["k"], ["b", "n"], ["n"]).collect()}
    # Inserted by the first row, then updated by the third.
    assert got[9] == ("first", "z") and got[1] == ("a1", "q")


def test_repeated_keys_without_order_are_an_error(spark, target):
    source = spark.createDataFrame([(9, "x", "y"), (9, "x", "z")], TARGET)
    with pytest.raises(Exception, match="several rows for one key"):
        merge.upsert(target, source, ["k"]).select("k").count()
    with pytest.raises(GrainViolation):
        checked_grain(load_fact(None, source, ["k"]), ["k"])


def test_a_null_in_the_source_overwrites(spark, target):
    source = spark.createDataFrame([(1, None, None)], TARGET)
    assert (1, None, "b1") in rows(merge.upsert(target, source, ["k"], ["a"]))


def test_insert_new_and_update_only(spark, target):
    source = spark.createDataFrame([(2, "A", "B"), (3, "A", "B")], TARGET)
    assert {r["k"]: r["a"] for r in merge.insert_new(target, source, ["k"]).collect()} == {1: "a1", 2: "a2", 3: "A", None: "a0"}
    assert {r["k"]: r["a"] for r in merge.update_matching(target, source, ["k"]).collect()} == {1: "a1", 2: "A", None: "a0"}


def test_null_keys_in_the_target_stay(spark):
    target = spark.createDataFrame([(None, "x", str(i)) for i in range(50)] + [(1, "y", "1")], TARGET)
    source = spark.createDataFrame([(1, "z", "2"), (2, "z", "3")], TARGET)
    got = merge.upsert(target, source, ["k"])
    assert got.where("k is null and a = 'x'").count() == 50 and got.count() == 52
    assert merge.update_matching(target, source, ["k"]).count() == 51


def test_missing_source_columns_are_null_on_insert(spark, target):
    source = spark.createDataFrame([(2, "B"), (3, "B")], "k int, b string")
    assert (3, None, "B") in rows(merge.upsert(target, source, ["k"]))
    with pytest.raises(ValueError, match="not in the target"):
        merge.upsert(target, source.withColumnRenamed("b", "z"), ["k"])


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("keyed", [True, False])
def test_delete(spark, op, keyed):
    data = [(i, i % 3, i % 5 if i % 7 else None) for i in range(40)]
    target = spark.createDataFrame(data, "id int, k int, v int")
    cuts = [(0, 1), (0, 3), (1, 2), (None, 4), (1, None)] if keyed else [(0, 2), (0, 3)]
    source = spark.createDataFrame(cuts, "sk int, sv int")
    compare = {
        "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    }[op]
    keys = [("k", "=", "sk")] * keyed + [("v", op, "sv")]
    got = {r["id"] for r in merge.delete_matching(target, source, keys).collect()}
    hit = lambda k, v: any(
        v is not None and b is not None and (not keyed or (a is not None and a == k)) and compare(v, b) for a, b in cuts
    )
    assert got == {i for i, k, v in data if not hit(k, v)}


def test_delete_by_an_empty_source_keeps_all(spark):
    target = spark.range(5)
    empty = spark.createDataFrame([], "v bigint")
    assert merge.delete_matching(target, empty, [("id", "<", "v")]).count() == 5


def test_loading_a_fact_twice_changes_nothing(spark):
    stream = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "o int, l int, v int")
    run = dt.datetime(2024, 1, 1)
    once = load_fact(None, stream, ["o", "l"], run_time=run)
    assert rows(load_fact(once, stream, ["o", "l"], run_time=run)) == rows(once)


def test_currency_uses_the_latest_rate(spark):
    rates = spark.createDataFrame(
        [("EUR", dt.date(2024, 1, 1), 1.1), ("EUR", dt.date(2024, 2, 1), 1.2)], "c string, d date, r double"
    )
    df = spark.createDataFrame(
        [(1, "EUR", dt.date(2023, 12, 31)), (2, "EUR", dt.date(2024, 1, 31)), (3, "EUR", dt.date(2024, 2, 1)), (4, "XXX", dt.date(2024, 2, 1))],
        "id int, cur string, at date",
    ).selectExpr("*", "cast(10 as decimal(15,2)) as amount")
    got = {r["id"]: r["usd"] for r in convert_currency(df, "amount", "cur", "at", rates, "usd").collect()}
    assert {k: v if v is None else float(v) for k, v in got.items()} == {1: None, 2: 11.0, 3: 12.0, 4: None}


@pytest.mark.parametrize("tests", [
    [("k", "=", "k"), ("v", ">=", "low"), ("v", "<", "high")], [("v", ">=", "low"), ("v", "<=", "high")], [("k", "=", "k"), ("v", ">=", "low"), ("v", "<=", "high")],
    [("k", "=", "k"), ("v", ">", "low"), ("v", "<>", "high")], [("k", "=", "k"), ("v", ">", "low"), ("w", "<", "high")], [("k", "=", "k"), ("v", ">=", "low"), ("w", "<=", "high"), ("v", "<>", "k")],
])
def test_delete_by_several_comparisons(spark, tests):
    import operator
    import random

    rng = random.Random(7)
    some = lambda n: rng.choice([None, *range(n)])
    target = [(i, some(4), some(30), some(30)) for i in range(200)] + [(7, 1, 5, 5)] * 2
    source = [(some(4), low, None if low is None else low + rng.randrange(-2, 6)) for low in (some(30) for _ in range(25))]
    ops = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "<>": operator.ne}

    def meets(t, s):
        t, s = dict(zip(("id", "k", "v", "w"), t)), dict(zip(("k", "low", "high"), s))
        return all(t[a] is not None and s[b] is not None and ops[op](t[a], s[b]) for a, op, b in tests)

    want = [t for t in target if not any(meets(t, s) for s in source)]
    df = merge.delete_matching(spark.createDataFrame(target, "id int, k int, v int, w int"), spark.createDataFrame(source, "k int, low int, high int"), tests)
    assert df.columns == ["id", "k", "v", "w"] and sorted(map(str, df.collect())) == sorted(f"Row(id={a}, k={b}, v={c}, w={d})" for a, b, c, d in want)
    assert 0 < len(want) < len(target)


def test_delete_by_comparisons_that_need_an_equality(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="equality"):
        merge.delete_matching(df, df, [("a", "<", "a"), ("b", ">", "b")])


def test_second_fact_load_looks_up_no_key_again(spark, tmp_path):
    from starloom.queries import QUERIES

    spark.sql("SELECT 0L AS c_custkey, 'n' AS c_name, 6000D AS c_acctbal, 's' AS c_mktsegment UNION ALL SELECT 1, 'm', -5D, 't'").write.parquet(f"{tmp_path}/customer.parquet")
    orders = "SELECT id AS o_orderkey, id % 3 AS o_custkey, TIMESTAMP_NTZ '1997-12-30' + make_dt_interval(int(id * 90)) AS o_orderdate FROM range(6)"
    # An order without lines and without a date is never looked up.
    spark.sql(f"{orders} UNION ALL SELECT 99, 0, NULL").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        "SELECT id % 6 AS l_orderkey, int(id) AS l_linenumber, 1L AS l_partkey, 2L AS l_suppkey, 1.5D AS l_extendedprice,"
        " TIMESTAMP_NTZ '1997-12-31' + make_dt_interval(int(id % 6 * 91)) AS l_shipdate FROM range(12)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["fact_load"](spark, str(tmp_path))
    keys = {r.id_orden: r.fk_cliente for r in out.collect()}
    assert out.count() == 12 and keys == {0: 1, 1: 0, 2: 0, 3: 2, 4: 0, 5: 0}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
