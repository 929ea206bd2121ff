"""Dimension loads against a row-by-row simulation, and hand-made lookup cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from starloom.contracts import INSERT, MAX_DATE, MIN_DATE, PUNCH, UPDATE, DimContract
from starloom.operators import dimension
from starloom.operators.ordered import SplitPolicy
from starloom.sinks.writers import written
from starloom.session import scratch_path

CUT = SplitPolicy(sample_fraction=1.0, max_group_rows=6)
RUN = dt.datetime(2024, 5, 1)
MODES = {"a": INSERT, "b": UPDATE, "p": PUNCH}
CONTRACT = DimContract.from_modes(
    "dim_x", "sk", ["k"], MODES, technical_columns={"ins": "DateInserted", "upd": "DateUpdated", "last": "LastVersion"}
)
STAGE = "k int, a string, b string, p string, at timestamp_ntz"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


class Simulated:
    """The dimension, one staged row after another."""

    def __init__(self):
        self.versions = {}

    def load(self, rows, now):
        for k, a, b, p, at in sorted(rows, key=lambda r: (r[0] if r[0] is not None else -1, r[4])):
            if k is None:
                continue
            history = self.versions.setdefault(k, [])
            if not history:
                history.append(dict(v=1, f=MIN_DATE, t=MAX_DATE, a=a, b=b, p=p, ins=now, upd=None))
                continue
            current = history[-1]
            punch = current["p"] != p
            if current["a"] != a:
                current.update(t=at, upd=now)
                history.append(dict(v=current["v"] + 1, f=at, t=MAX_DATE, a=a, b=b, p=p, ins=now, upd=None))
            elif (current["b"], current["p"]) != (b, p):
                current.update(b=b, p=p, upd=now)
            if punch:
                for version in history:
                    if version["p"] != p or version is not history[-1]:
                        version["upd"] = now
                    version["p"] = p

    def rows(self):
        return sorted(
            (k, x["v"], x["f"], x["t"], x["a"], x["b"], x["p"], x["t"] == MAX_DATE)
            for k, h in self.versions.items()
            for x in h
        )

    def stamps(self):
        return {(k, x["v"]): (x["ins"], x["upd"]) for k, h in self.versions.items() for x in h}


def loaded(dim):
    return sorted(
        (r["k"], r["version"], r["date_from"], r["date_to"], r["a"], r["b"], r["p"], r["last"])
        for r in dim.where("sk <> 0").collect()
    )


def batch(rnd, first, days, keys=(1, 2, 3, 4, 5, 6, 7)):
    """Rows on distinct days per key; key 1 has most of them."""
    rows = []
    for k in keys:
        for d in sorted(rnd.sample(range(days), min(days, 9 if k == 1 else rnd.randint(0, 3)))):
            rows.append((k, rnd.choice("xy"), rnd.choice("mn"), rnd.choice("qr"), day(first + d)))
    return rows + [(None, "x", "m", "q", day(first))]


@pytest.mark.parametrize("policy", [SplitPolicy(), CUT], ids=["whole", "cut"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loads_match_row_by_row(spark, policy, seed):
    rnd = random.Random(seed)
    simulated, dim = Simulated(), None
    for i in range(3):
        rows, now = batch(rnd, 20 * i, 15), RUN + dt.timedelta(days=i)
        dim = dimension.load_dimension(dim, spark.createDataFrame(rows, STAGE), CONTRACT, "at", now, policy)
        dim = written(dim, scratch_path(spark, "dim"))
        simulated.load(rows, now)
        assert loaded(dim) == simulated.rows()
        keys = [r["sk"] for r in dim.collect()]
        assert sorted(keys) == list(range(1, len(keys) + 1))
    inserted = {(r["k"], r["version"]): r["ins"] for r in dim.collect()}
    assert inserted == {key: stamps[0] for key, stamps in simulated.stamps().items()}


def test_one_batch_equals_several(spark):
    rows = batch(random.Random(9), 0, 15)
    at_once = dimension.load_dimension(None, spark.createDataFrame(rows, STAGE), CONTRACT, "at", RUN)
    dim = None
    for d in sorted({r[4] for r in rows}):
        part = spark.createDataFrame([r for r in rows if r[4] == d], STAGE)
        dim = written(dimension.load_dimension(dim, part, CONTRACT, "at", RUN), scratch_path(spark, "dim"))
    assert loaded(dim) == loaded(at_once)


def test_loading_the_same_batch_twice_changes_nothing(spark):
    rows = [r for r in batch(random.Random(5), 0, 15) if r[0] is not None]
    last = {r[0]: r for r in sorted(rows, key=lambda r: r[4])}
    dim = written(
        dimension.load_dimension(None, spark.createDataFrame(rows, STAGE), CONTRACT, "at", RUN), scratch_path(spark, "dim")
    )
    again = dimension.load_dimension(dim, spark.createDataFrame(list(last.values()), STAGE), CONTRACT, "at", RUN)
    assert loaded(again) == loaded(dim)
    assert sorted(r["sk"] for r in again.collect()) == sorted(r["sk"] for r in dim.collect())


def test_type_one_keeps_one_row_per_key(spark):
    contract = DimContract("d", "sk", ("k",), attributes_scd1=("a", "b", "p"))
    first = spark.createDataFrame([(1, "x", "m", "q", day(0)), (2, "x", "m", "q", day(0))], STAGE)
    second = spark.createDataFrame([(1, "y", "m", "r", day(5)), (3, "z", "m", "q", day(5))], STAGE)
    dim = dimension.load_dimension(dimension.load_dimension(None, first, contract, "at", RUN), second, contract, "at", RUN)
    got = sorted((r["sk"], r["k"], r["version"], r["a"], r["p"], r["date_from"], r["date_to"]) for r in dim.collect())
    assert got == [
        (1, 1, 1, "y", "r", MIN_DATE, MAX_DATE),
        (2, 2, 1, "x", "q", MIN_DATE, MAX_DATE),
        (3, 3, 1, "z", "q", MIN_DATE, MAX_DATE),
    ]


def test_null_attributes_are_compared(spark):
    first = spark.createDataFrame([(1, None, "m", "q", day(0))], STAGE)
    same = spark.createDataFrame([(1, None, "m", "q", day(1))], STAGE)
    changed = spark.createDataFrame([(1, "x", "m", "q", day(2))], STAGE)
    dim = dimension.load_dimension(None, first, CONTRACT, "at", RUN)
    dim = dimension.load_dimension(dim, same, CONTRACT, "at", RUN)
    assert dim.count() == 1
    dim = dimension.load_dimension(dim, changed, CONTRACT, "at", RUN)
    assert [(r["version"], r["a"]) for r in dim.orderBy("version").collect()] == [(1, None), (2, "x")]


@pytest.mark.parametrize(
    "rows, message",
    [
        ([(1, "y", "m", "q", day(0))], "older than a loaded version"),
        ([(2, "x", "m", "q", day(9)), (2, "y", "m", "q", day(9))], "share a date"),
        ([(2, "x", "m", "q", None)], "no effective date"),
    ],
)
def test_bad_rows_are_errors(spark, rows, message):
    first = spark.createDataFrame([(1, "x", "m", "q", day(1)), (1, "y", "m", "q", day(5))], STAGE)
    dim = written(dimension.load_dimension(None, first, CONTRACT, "at", RUN), scratch_path(spark, "dim"))
    with pytest.raises(Exception, match=message):
        dimension.load_dimension(dim, spark.createDataFrame(rows, STAGE), CONTRACT, "at", RUN).collect()


def test_contract_errors():
    with pytest.raises(ValueError, match="update mode"):
        DimContract.from_modes("d", "sk", ["k"], {"a": "Overwrite"})
    with pytest.raises(ValueError, match="natural key"):
        DimContract("d", "sk", ())
    with pytest.raises(ValueError, match="no load behaviour"):
        DimContract("d", "sk", ("k",), scd_type=6)
    with pytest.raises(ValueError, match="need scd_type 2"):
        DimContract("d", "sk", ("k",), scd_type=1, attributes_scd2=("a",))


# -- members -------------------------------------------------------------------------------------


def test_unknown_member_is_seeded_once_and_survives_loads(spark):
    first = spark.createDataFrame([(0, "x", "m", "q", day(0))], STAGE)  # a real key that equals the default
    dim = dimension.seed_unknown(dimension.load_dimension(None, first, CONTRACT, "at", RUN), CONTRACT, ["k", "a"])
    dim = written(dimension.seed_unknown(dim, CONTRACT, ["k", "a"]), scratch_path(spark, "dim"))
    unknown = dim.where("sk = 0").collect()
    assert [(r["version"], r["k"], r["a"], r["b"], r["date_from"], r["date_to"]) for r in unknown] == [
        (1, 0, "DESCONOCIDO", None, MIN_DATE, MAX_DATE)
    ]
    again = dimension.load_dimension(dim, spark.createDataFrame([(0, "y", "m", "q", day(3))], STAGE), CONTRACT, "at", RUN)
    assert sorted((r["sk"], r["version"], r["a"]) for r in again.collect()) == [
        (0, 1, "DESCONOCIDO"), (1, 1, "x"), (2, 2, "y"),
    ]


def test_inferred_member_becomes_real(spark):
    contract = DimContract("d", "sk", ("k",), attributes_scd1=("a", "inferred_member"))
    known = spark.createDataFrame([(1, "x", "N")], "k int, a string, inferred_member string")
    facts = spark.createDataFrame([(1,), (7,), (7,), (None,)], "fk int")
    orphans = dimension.inferred_members(facts, known, {"fk": "k"}, {"a": F.lit("?")})
    dim = written(
        dimension.load_dimension(None, known.unionByName(orphans), contract, day(0), RUN), scratch_path(spark, "dim")
    )
    assert sorted((r["sk"], r["k"], r["a"], r["inferred_member"]) for r in dim.collect()) == [(1, 1, "x", "N"), (2, 7, "?", "Y")]
    real = spark.createDataFrame([(7, "seven", "N")], "k int, a string, inferred_member string")
    dim = dimension.load_dimension(dim, real, contract, day(1), RUN)
    assert sorted((r["sk"], r["a"], r["inferred_member"]) for r in dim.collect()) == [(1, "x", "N"), (2, "seven", "N")]


def test_junk_dimension_treats_null_as_a_value(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "x string, y int")
    dim = written(dimension.load_junk_dimension(None, rows, ["x", "y"], "sk"), scratch_path(spark, "junk"))
    more = spark.createDataFrame([("a", None), ("c", 2)], "x string, y int")
    dim = dimension.load_junk_dimension(dim, more, ["x", "y"], "sk")
    assert sorted((r["sk"], r["x"], r["y"]) for r in dim.collect()) == [(1, "a", None), (2, "b", 1), (3, "c", 2)]
    found = dimension.lookup_junk_key(rows, dim, ["x", "y"], "sk").collect()
    assert sorted(r["sk"] for r in found) == [1, 1, 2]


# -- lookups -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def history(spark):
    rows = [(1, "x", "m", "q", day(0)), (1, "y", "m", "q", day(10)), (2, "z", "m", "q", day(0))]
    dim = dimension.load_dimension(None, spark.createDataFrame(rows, STAGE), CONTRACT, "at", RUN)
    return written(dimension.seed_unknown(dim, CONTRACT, ["k"]), scratch_path(spark, "dim"))


@pytest.mark.parametrize("policy", [SplitPolicy(0.01, 20_000), SplitPolicy(1.0, 1)], ids=["join", "ordered"])
def test_lookup_is_half_open(spark, history, policy):
    cases = {
        "start": (1, day(10), 2), "before": (1, day(10) - dt.timedelta(microseconds=1), 1), "far": (1, dt.datetime(2199, 12, 31), 2),
        "end": (1, MAX_DATE, 0), "first": (1, MIN_DATE, 1), "missing": (9, day(5), 0), "null": (None, day(5), 0), "other": (2, day(5), 3),
    }
    stream = spark.createDataFrame([(n, k, at) for n, (k, at, _) in cases.items()], "name string, fk int, at timestamp_ntz")
    got = dimension.dimension_lookup(
        stream, history, CONTRACT, {"fk": "k"}, "at", "sk", {"a": "attribute"}, policy=policy
    ).collect()
    assert {r["name"]: r["sk"] for r in got} == {n: sk for n, (_, _, sk) in cases.items()}
    assert {r["name"]: r["attribute"] for r in got}["start"] == "y"


def test_lookup_without_date_uses_the_run(spark, history):
    stream = spark.createDataFrame([(1,), (8,)], "fk int")
    got = dimension.dimension_lookup(stream, history, CONTRACT, {"fk": "k"}, run_time=day(3)).collect()
    assert sorted((r["fk"], r["sk"]) for r in got) == [(1, 1), (8, 0)]


def test_null_reference_date_is_an_error(spark, history):
    stream = spark.createDataFrame([(1, None)], "fk int, at timestamp_ntz")
    with pytest.raises(Exception, match="NULL in at"):
        dimension.dimension_lookup(stream, history, CONTRACT, {"fk": "k"}, "at").collect()


def test_calendar(spark):
    rows = dimension.calendar(spark, dt.date(2024, 2, 28), dt.date(2024, 3, 3)).orderBy("fecha").collect()
    assert [r["sk_tiempo"] for r in rows] == [20240228, 20240229, 20240301, 20240302, 20240303]
    assert [(r["nombre_mes"], r["dia_semana"], r["nombre_dia_semana"], r["es_fin_de_semana"]) for r in rows[2:]] == [
        ("marzo", 5, "viernes", False), ("marzo", 6, "sábado", True), ("marzo", 7, "domingo", True),
    ]


def test_columns_the_contract_does_not_name_stay(spark):
    contract = DimContract.from_modes("dim_x", "sk", ["k"], {"a": INSERT})
    first = dimension.load_dimension(None, spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), contract, day(0), RUN)
    dim = written(first.withColumn("email", F.concat(F.lit("m"), "k")), scratch_path(spark, "dim"))
    stage = spark.createDataFrame([(1, "z"), (3, "n")], "k int, a string")
    out = dimension.load_dimension(dim, stage, contract, day(3), RUN)
    assert out.columns == dim.columns
    got = {(r.k, r.a): r.email for r in out.collect()}
    assert got == {(1, "x"): "m1", (1, "z"): None, (2, "y"): "m2", (3, "n"): None}
