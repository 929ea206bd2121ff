"""Ordered operators against brute force, with and without cutting groups into chunks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import ordered
from starloom.operators.ordered import SplitPolicy, lag_lead, running, split_points
from starloom.operators.sequence import add_sequence, with_index

CUT = SplitPolicy(sample_fraction=1.0, max_group_rows=15)
WHOLE = SplitPolicy(sample_fraction=1.0, max_group_rows=10**9)


def _rows(seed):
    """One group with two thirds of the rows, some small ones, and a NULL group; NULLs in the values."""
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        group = rnd.choice(["hot"] * 6 + ["a", "b", None])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 20)) if rnd.random() > 0.05 else None
        rows.append((group, at, i, rnd.choice([None, 1, 2, 3, 4]), f"v{rnd.randint(0, 9)}"))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "g string, at timestamp_ntz, id int, n int, v string").repartition(5)


def _groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("policy", [CUT, WHOLE], ids=["cut", "whole"])
@pytest.mark.parametrize("seed", [1, 2])
def test_lag_lead(spark, policy, seed):
    rows = _rows(seed)
    df = _frame(spark, rows)
    assert (split_points(df, ["g"], ["at", "id"], policy) is None) == (policy is WHOLE)
    fields = [("l1", "v", "LAG", 1), ("l3", "id", "LAG", 3), ("n1", "v", "LEAD", 1), ("n17", "id", "LEAD", 17)]
    got = {r["id"]: tuple(r)[5:] for r in lag_lead(df, ["g"], ["at", "id"], fields, policy).collect()}
    assert len(got) == len(rows)
    for group in _groups(rows).values():
        at = lambda i, c: group[i][c] if 0 <= i < len(group) else None
        for i, r in enumerate(group):
            assert got[r[2]] == (at(i - 1, 4), at(i - 3, 2), at(i + 1, 4), at(i + 17, 2))


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("policy", [CUT, WHOLE], ids=["cut", "whole"])
def test_running(spark, policy, reverse):
    rows = _rows(3)
    out = running(
        _frame(spark, rows), ["g"], ["at", "id"],
        sums={"s": F.col("n")}, lasts={"k": F.col("n")}, mins={"m": F.struct("n", "id")},
        cuts=policy, reverse=reverse,
    )
    got = {r["id"]: (r["s"], r["k"], r["m"]["n"] if r["m"] else None) for r in out.collect()}
    assert len(got) == len(rows)
    for group in _groups(rows).values():
        seen = []
        for r in reversed(group) if reverse else group:
            seen.append(r[3])
            known = [n for n in seen if n is not None]
            smallest = None if None in seen else min(known)  # a NULL field sorts first in a struct
            assert got[r[2]] == (sum(known), known[-1] if known else None, smallest)


def test_no_group_is_one_group(spark):
    rows = _rows(4)
    df = _frame(spark, rows)
    got = {r["id"]: r["p"] for r in lag_lead(df, [], ["at", "id"], [("p", "id", "LAG", 2)], CUT).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert got == {r[2]: ordered[i - 2][2] if i >= 2 else None for i, r in enumerate(ordered)}


def test_chunks_are_bounded(spark):
    """A third of the rows in one group ends up in many chunks of similar size."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id"))
    cuts = split_points(df, ["g"], ["id"], SplitPolicy(1.0, 100))
    sizes = {r["g"]: len(r["_cuts"]) for r in cuts.collect()}
    assert sizes == {0: 9, 1: 9, 2: 9}


def test_split_points_keeps_its_budget(spark):
    df = spark.range(5000).select((F.col("id") % 500).alias("g"), F.col("id"))
    cuts = split_points(df, ["g"], ["id"], SplitPolicy(1.0, 1))
    planned = cuts.agg(F.count("*"), F.sum(F.size("_cuts"))).first()
    assert planned[0] <= 80 and planned[1] <= 160  # ten chunks for each of eight partitions


def test_with_index_is_the_global_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("pad")).repartition(7)
    got = with_index(df, ["k"], "i", 5).collect()
    assert sorted((r["k"], r["i"]) for r in got) == [(k, k + 5) for k in range(1000)]


def test_with_index_on_ties_is_gapless(spark):
    df = spark.range(500).select(F.lit(1).alias("same"), "id")
    assert sorted(r["i"] for r in with_index(df, ["same"], "i").collect()) == list(range(500))


def test_with_index_keeps_copies(spark):
    df = spark.range(300).select(F.lit(1).alias("same"))
    assert sorted(r["i"] for r in with_index(df, ["same"], "i").collect()) == list(range(300))


def test_sequence_starts_over_past_its_maximum(spark):
    got = add_sequence(spark.range(7), ["id"], "s", start_at=10, increment_by=5, max_value=22, cycle=True).orderBy("id").collect()
    assert [r["s"] for r in got] == [10, 15, 20, 10, 15, 20, 10]


def test_offsets_must_be_positive(spark):
    with pytest.raises(ValueError):
        lag_lead(spark.range(2), [], ["id"], [("x", "id", "LAG", 0)])


def test_chunks_are_found_by_halving(spark):
    """Each row is compared with a few cuts, not with all of them."""
    rnd = random.Random(4)
    ats = sorted({rnd.randrange(5000) for _ in range(1500)})
    cuts = spark.createDataFrame([("a", [(x,) for x in ats]), ("b", [(7,)]), ("c", [])], "g string, _cuts array<struct<at:int>>")
    rows = [(g, at) for g in ("a", "b", "c", "d", None) for at in [None, -1, *range(0, 5100, 3)]]
    out = ordered._chunked(spark.createDataFrame(rows, "g string, at int"), ["g"], ["at"], cuts)
    have = {"a": ats, "b": [7], "c": []}
    for r in out.collect():
        expected = sum(r.at is not None and x <= r.at for x in have[r.g]) if r.g in have else None
        assert r._chunk == expected, r
    assert out.columns == ["g", "at", "_chunk"]
    assert "filter(_cuts" not in out._jdf.queryExecution().optimizedPlan().toString()
