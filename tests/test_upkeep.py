"""Summaries kept up from changes, merged profiles, and keys and versions of loads that run at once."""

import decimal
import random
import threading

import pytest
from pyspark.sql import functions as F

from starloom.contracts import INSERT, DimContract
from starloom.operators import keyblocks, merge, profiling, upkeep
from starloom.operators.dimension import load_dimension
from starloom.sinks.writers import publish

SCHEMA = "id long, kind string, area int, price decimal(12,2), size int"


def fact_rows(rng, ids):
    price = lambda: rng.choice([None, *[decimal.Decimal(n) / 4 for n in range(-20, 20)]])
    return [(i, rng.choice(["a", "b", None]), rng.randrange(3), price(), rng.choice([None, *range(6)])) for i in ids]


def held(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def content(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("mart", [upkeep.Mart(("kind", "area"), ("price", "size"), ("price", "size")), upkeep.Mart(("kind",), ("size",)), upkeep.Mart(("area",), (), ("size",)), upkeep.Mart(("kind",))])
def test_refreshed_marts_equal_new_ones(spark, mart):
    rng = random.Random(3)
    fact = spark.createDataFrame(fact_rows(rng, range(60)), SCHEMA)
    state = held(mart.build(fact))
    for turn in range(4):
        batch = spark.createDataFrame(fact_rows(rng, [*rng.sample(range(60), 12), *range(100 * turn + 100, 100 * turn + 103)]), SCHEMA)
        changes, after = upkeep.upsert_changes(fact, batch, ["id"]), held(merge.upsert(fact, batch, ["id"]))
        state, fact = held(mart.refresh(state, changes, after)), after
        assert content(state) == content(mart.build(fact).select(*mart.columns))
        gone = fact.where("kind = 'b' AND area = 1" if turn == 1 else f"id % 7 = {turn}").select("id", (F.col("size") + 1).alias("limit"))
        tests = [("id", "=", "id")] + ([("size", "<", "limit")] if turn % 2 else [])
        changes, after = upkeep.delete_changes(fact, gone, tests), held(merge.delete_matching(fact, gone, tests))
        state, fact = held(mart.refresh(state, changes, after)), after
        assert content(state) == content(mart.build(fact).select(*mart.columns))
    changes = upkeep.delete_changes(fact, fact.select("id"), [("id", "=", "id")])
    assert mart.refresh(state, changes, fact.limit(0)).count() == 0


def test_profiles_of_loads_add_up(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.randrange(40_000), rng.choice(["x", "yy", "", None])) for _ in range(30_000)], "n long, t string").cache()
    loads = [df.where(f"n % 3 = {i}") for i in range(3)] + [df.limit(0)]
    for empty in (False, True):
        merged = {r.column: r for r in profiling.merged_profile(*[profiling.profile_sketches(x, empty_is_null=empty) for x in loads]).collect()}
        whole = {r.column: r for r in profiling.merged_profile(profiling.profile_sketches(df, empty_is_null=empty)).collect()}
        exact = {r.column: r for r in profiling.population_stats(df, df.columns, empty).collect()}
        for name in df.columns:
            for field in ("total_count", "null_count", "min_length", "max_length"):
                assert merged[name][field] == whole[name][field] == exact[name][field]
            for got in (merged, whole):
                assert abs(got[name].distinct_estimate - exact[name].distinct_count) <= 0.05 * exact[name].distinct_count
    in_steps = profiling.merge_sketches(profiling.merge_sketches(*[profiling.profile_sketches(x) for x in loads[:2]]), profiling.profile_sketches(loads[2]))
    again = {r.column: r.distinct_estimate for r in profiling.merged_profile(in_steps).collect()}
    assert all(abs(again[n] - exact_n) <= 0.05 * exact_n for n, exact_n in ((n, df.select(n).distinct().where(f"{n} IS NOT NULL").count()) for n in df.columns))


def test_loads_at_once_share_no_number(spark, tmp_path):
    got, lock = [], threading.Lock()

    def take():
        for _ in range(30):
            number = keyblocks.claim_next(spark, f"{tmp_path}/numbers")
            with lock:
                got.append(number)

    threads = [threading.Thread(target=take) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 121))


def test_interleaved_dimension_loads_share_no_key(spark, tmp_path):
    contract = DimContract.from_modes("dim", "sk", ["id"], {"name": INSERT})
    blocks = keyblocks.KeyBlocks(f"{tmp_path}/keys", first=1, size=10)
    batch = lambda ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")
    import datetime as dt

    # Both are planned before either is written.
    loads = [load_dimension(None, batch(ids), contract, dt.datetime(2024, 1, 1), blocks=blocks) for ids in (range(25), range(100, 142), range(0))]
    keys = [[r.sk for r in load.orderBy("id").collect()] for load in reversed(loads)]
    assert [len(k) for k in keys] == [0, 42, 25] and all(k == sorted(k) for k in keys)
    assert len({x for k in keys for x in k}) == 67
    with pytest.raises(ValueError, match="other loads"):
        keyblocks.KeyBlocks(f"{tmp_path}/keys", first=1, size=20).reserve(spark, 1)


def test_published_versions_at_once(spark):
    failed = []

    def run(i):
        try:
            publish(spark.range(i), "published_at_once")
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(i,)) for i in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    tables = sorted(t.name for t in spark.catalog.listTables(pattern="published_at_once__v*"))
    assert not failed and len(tables) == 3 and sorted(spark.table(t).count() for t in tables) == [1, 2, 3]
    assert spark.table("published_at_once").count() in (1, 2, 3)


def test_many_blocks_are_one_file(spark, tmp_path):
    blocks = keyblocks.KeyBlocks(f"{tmp_path}/keys", first=5, size=4)
    assert blocks.reserve(spark, 0) is None
    starts = [blocks.reserve(spark, n) for n in (200_000, 1, 9)]
    assert starts == [5, 200_005, 200_009]
    assert len([p for p in (tmp_path / "keys").iterdir() if p.name[0].isdigit()]) == 3


def test_runs_reserved_at_once_share_no_key(spark, tmp_path):
    got, lock = [], threading.Lock()
    blocks = keyblocks.KeyBlocks(f"{tmp_path}/keys", first=1, size=10)

    def take(n):
        for count in (n, 1, 3 * n):
            start = blocks.reserve(spark, count)
            with lock:
                got.extend(range(start, start + count))

    threads = [threading.Thread(target=take, args=(n,)) for n in (7, 25, 40, 101)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == sum(4 * n + 1 for n in (7, 25, 40, 101)) and len(set(got)) == len(got)


def test_a_run_that_another_load_took_meanwhile_is_left(spark, tmp_path, monkeypatch):
    blocks = keyblocks.KeyBlocks(f"{tmp_path}/keys", first=0, size=10)
    real, other = keyblocks.claim, []

    def claim(spark, path):
        # A load that read the folder at the same time takes three blocks from the same place.
        if path.endswith("/0-2"):
            other.append(real(spark, f"{tmp_path}/keys/0-3"))
        return real(spark, path)

    monkeypatch.setattr(keyblocks, "claim", claim)
    assert blocks.reserve(spark, 20) >= 30 and other == [True]
