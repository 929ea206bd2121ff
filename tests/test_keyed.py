"""Loads that rewrite a part of their target: what they change, what they leave alone, and what a dead driver leaves."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from starloom.contracts import INSERT, UPDATE, DimContract
from starloom.operators import dimension, keyfilter, merge
from starloom.session import claim
from starloom.sinks import keyed

SCHEMA = "id long, name string, value double"


def rows(ids, mark=""):
    return [(i, f"{mark}{i}", float(i)) for i in ids]


def files(path):
    """(size, time) of every data file."""
    found = {}
    for folder, _, names in os.walk(f"{path}/data"):
        found |= {f"{folder}/{n}": (os.path.getsize(f"{folder}/{n}"), os.stat(f"{folder}/{n}").st_mtime_ns) for n in names if n.endswith(".parquet")}
    return found


@pytest.fixture
def target(spark, tmp_path):
    df = spark.createDataFrame([*rows(range(2000)), (None, "none", 1.0), (None, "none", 2.0)], SCHEMA)
    return keyed.create_keyed(df, f"{tmp_path}/t", ["id"], 64)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def held(df):
    """The rows as they are now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_upsert_rewrites_touched_buckets_alone(spark, target):
    batch = spark.createDataFrame([*rows([5, 17], "new"), *rows([99_999], "added")], SCHEMA)
    target.read(spark).cache().count()  # a cached table is read anew after the load
    want = content(merge.upsert(target.read(spark), batch, ["id"]))
    before = files(target.path)
    done = keyed.upsert_keyed(target, batch)
    after = files(target.path)
    assert content(target.read(spark)) == want and done.batch_rows == 3 and 1 <= len(done.touched) <= 3
    of = lambda name: int(name.split("_bucket=")[1].split("/")[0])
    same = {n for n in before if of(n) not in done.touched}
    assert len(same) > 50 and all(after[n] == before[n] for n in same)
    assert not {n for n in before if of(n) in done.touched} & set(after)
    reopened = keyed.open_keyed(spark, target.path)
    assert reopened == target and content(reopened.read(spark)) == want
    assert not os.path.exists(f"{target.path}/lock") and not os.path.exists(f"{target.path}/pending.json")


def test_null_keys_of_table_and_batch(spark, target):
    batch = spark.createDataFrame([(None, "x", 0.0), (None, "x", 0.0)], SCHEMA)
    want = content(merge.upsert(target.read(spark), batch, ["id"]))
    keyed.upsert_keyed(target, batch)
    assert content(target.read(spark)) == want and sum(r[0] is None for r in want) == 4


def test_update_and_delete_leave_buckets_without_a_match(spark, target):
    strange = spark.createDataFrame(rows(range(10_000, 10_200)), SCHEMA)
    before = files(target.path)
    assert keyed.upsert_keyed(target, strange, insert=False).touched == ()
    assert keyed.delete_keyed(target, strange, [("id", "=", "id")]).touched == ()
    assert files(target.path) == before
    assert len(keyed.upsert_keyed(target, strange.union(spark.createDataFrame([(3, "three", 0.0)], SCHEMA)), insert=False).touched) == 1


def test_emptied_buckets_go(spark, target):
    everything = held(target.read(spark).where("id IS NOT NULL").select("id", (F.col("value") + 1).alias("limit")))
    keyed.delete_keyed(target, everything, [("id", "=", "id"), ("value", "<", "limit")])
    assert content(target.read(spark)) == [(None, "none", 1.0), (None, "none", 2.0)]
    keyed.upsert_keyed(target, spark.createDataFrame(rows([1]), SCHEMA))
    assert target.read(spark).count() == 3


def test_repeated_load_changes_nothing_and_order_decides(spark, target):
    batch = spark.createDataFrame([(7, "b", 2.0), (7, "c", 3.0), (7, "a", 1.0)], SCHEMA)
    for _ in range(2):
        keyed.upsert_keyed(target, batch, order=["value"])
        assert target.read(spark).where("id = 7").collect()[0].name == "c" and target.read(spark).count() == 2002
    with pytest.raises(Exception, match="several rows"):
        keyed.upsert_keyed(target, batch)
    assert not os.path.exists(f"{target.path}/lock") and target.read(spark).count() == 2002


def test_one_load_at_a_time(spark, target):
    batch = spark.createDataFrame(rows([1], "x"), SCHEMA)
    assert claim(spark, f"{target.path}/lock") and not claim(spark, f"{target.path}/lock")
    with pytest.raises(RuntimeError, match="another load"):
        keyed.upsert_keyed(target, batch)
    assert not keyed.recover(spark, target.path)
    keyed.upsert_keyed(target, batch)
    assert target.read(spark).where("name = 'x1'").count() == 1


@pytest.mark.parametrize("moved", [0, 1, 2, 5])
def test_a_swap_that_died_is_finished(spark, target, monkeypatch, moved):
    batch = spark.createDataFrame([*rows(range(0, 200, 20), "new")], SCHEMA)
    # All of one bucket goes, so one folder is to be removed and not replaced.
    bucket = target.read(spark).where("id = 1").select(target.bucket(target.read(spark))).first()[0]
    gone = held(target.read(spark, [bucket]))
    change = lambda old, new: merge.upsert(old, new.where("name LIKE 'new%'"), ["id"]).join(gone.select("id"), "id", "left_anti").select(*old.columns)
    source = batch.union(gone)
    want = content(change(target.read(spark), source))
    swap = keyed._swap

    def dies(spark, path, staged, touched, filled):
        swap(spark, path, staged, touched[:moved], filled)
        raise KeyboardInterrupt

    monkeypatch.setattr(keyed, "_swap", dies)
    with pytest.raises(KeyboardInterrupt):
        keyed.rewrite(target, source, change)
    monkeypatch.setattr(keyed, "_swap", swap)
    with pytest.raises(RuntimeError, match="recover"):
        keyed.upsert_keyed(target, batch)
    assert keyed.recover(spark, target.path) and content(target.read(spark)) == want
    assert not keyed.recover(spark, target.path)


def test_a_change_that_makes_other_keys_is_refused(spark, target):
    batch = spark.createDataFrame(rows([1]), SCHEMA)
    with pytest.raises(ValueError, match="other buckets"):
        keyed.rewrite(target, batch, lambda old, new: old.withColumn("id", F.col("id") + 1))
    assert target.read(spark).count() == 2002 and not os.path.exists(f"{target.path}/lock")


def test_keys_of_another_type_find_their_buckets(spark, target):
    keyed.upsert_keyed(target, spark.createDataFrame([(5, "int", 0.0)], "id int, name string, value double"))
    assert target.read(spark).where("id = 5").collect()[0].name == "int" and target.read(spark).count() == 2002


def test_split_by_keys(spark, monkeypatch):
    rng = random.Random(4)
    data = [(rng.randrange(5000), rng.choice("abc")) for _ in range(4000)] + [(None, "a"), (1, None)]
    df = spark.createDataFrame(data, "k long, t string")
    batch = spark.createDataFrame(rng.sample(data, 40) + [(10**12, "z"), (None, "a")], "k int, t string".replace("int", "long"))
    keys = {tuple(r) for r in batch.collect() if None not in tuple(r)}
    for most in (keyfilter.MOST_BITS, 1 << 15):
        monkeypatch.setattr(keyfilter, "MOST_BITS", most)
        some, none = keyfilter.split_by_keys(df, batch, ["k", "t"])
        some, none = some.collect(), none.collect()
        assert sorted(map(str, [*some, *none])) == sorted(map(str, df.collect()))
        assert not [r for r in none if tuple(r) in keys] and len(some) < 300
    split = keyfilter.split_by_keys(df, batch, ["k", "t"])[1]
    assert "hashpartitioning" not in split._jdf.queryExecution().executedPlan().toString()
    empty = keyfilter.split_by_keys(df, batch.limit(0), ["k", "t"])
    assert empty[0].count() == 0 and empty[1].count() == len(data)


def test_dimension_changes_equal_the_whole_load(spark):
    contract = DimContract.from_modes("dim", "sk", ["id", "site"], {"name": INSERT, "note": UPDATE}, technical_columns={"last": "LastVersion", "ins": "DateInserted"})
    rng, run = random.Random(8), dt.datetime(2024, 1, 1)
    schema = "id long, site string, name string, note string, at timestamp_ntz"
    batch = lambda ids, day: spark.createDataFrame([(i, rng.choice(["x", "y"]), rng.choice("abc"), rng.choice("de"), dt.datetime(2024, 1, day)) for i in ids], schema)
    first = dimension.load_dimension(None, batch(range(3000), 2), contract, "at", run)
    dim = dimension.seed_unknown(first, contract).withColumn("extra", F.lit("e"))
    for day in (3, 4):
        stage = batch([*rng.sample(range(3000), 30), *range(5000, 5005)], day).unionByName(batch([1], day).withColumn("site", F.lit(None).cast("string"))).cache()
        whole = dimension.load_dimension(dim, stage, contract, "at", run)
        part = dimension.load_dimension_changes(dim, stage, contract, "at", run)
        assert part.columns == whole.columns and content(part) == content(whole)
        dim = held(whole)
    concerned, _ = keyfilter.split_by_keys(dim, stage, ["id", "site"])
    assert concerned.count() < 200


def test_dimension_in_buckets(spark, tmp_path):
    contract = DimContract.from_modes("dim", "sk", ["id"], {"name": INSERT, "note": UPDATE})
    run, day = dt.datetime(2024, 1, 1), lambda n: dt.datetime(2024, 1, n)
    schema = "id long, name string, note string"
    first = dimension.seed_unknown(dimension.load_dimension(None, spark.createDataFrame([(i, "a", "b") for i in range(500)], schema), contract, day(1), run), contract, ["id"])
    first = held(first)
    table = keyed.create_keyed(first, f"{tmp_path}/dim", ["id"], 128)
    stage = spark.createDataFrame([(3, "z", "b"), (4, "a", "q"), (777, "n", "n"), (None, "n", "n")], schema)
    before = files(table.path)
    done = keyed.load_dimension_keyed(table, stage, contract, day(2), run)
    assert content(table.read(spark)) == content(dimension.load_dimension(first, stage, contract, day(2), run))
    assert len(done.touched) <= 3 and len(set(before) & set(files(table.path))) >= len(before) - 3
    with pytest.raises(ValueError, match="keyed by"):
        keyed.load_dimension_keyed(table, stage, DimContract.from_modes("dim", "sk", ["name"], {"note": UPDATE}), day(3))
