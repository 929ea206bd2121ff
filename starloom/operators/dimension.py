"""Dimension loads (types 1, 2 and mixed), lookups, unknown and inferred members, calendars."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import MAX_DATE, MIN_DATE, DimContract
from starloom.functions.casting import literal, utc_now
from starloom.operators.intervals import interval_lookup
from starloom.operators.joins import LookupValue, not_exists_in
from starloom.operators.keyblocks import KeyBlocks
from starloom.operators.keyfilter import split_by_keys
from starloom.operators.ordered import SplitPolicy, lag_lead, running, split_points
from starloom.operators.sequence import with_index
from starloom.session import barrier

NTZ = T.TimestampNTZType()



def _any(tests: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def _all(tests: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, tests, F.lit(True))


def load_dimension(
    dim: DataFrame | None,
    stage: DataFrame,
    contract: DimContract,
    ref_date: str | dt.datetime,
    run_time: dt.datetime | None = None,
    policy: SplitPolicy = SplitPolicy(),
    highest_key: int | None = None,
    blocks: KeyBlocks | None = None,
) -> DataFrame:
    """Apply staged rows to a dimension and return the new dimension.

    ``highest_key`` is the highest technical key in use where ``dim`` is only a part of the dimension. New versions are
    numbered from there on without gaps, or from ``blocks`` where several loads may run at once.

    ``ref_date`` is the stage column with the date each row takes effect, or one date for the batch.
    A key may have several rows with different dates; they act in date order. Rows with a NULL
    natural key belong to the unknown member and are not loaded. A row dated before the open version
    of its key, or a second row with the same date, is an error.

    Either branch of the load writes every attribute, so after each staged row the open version
    equals that row. Comparing a row with the one before it is therefore enough to tell a new version
    (a type 2 attribute changed) from an overwrite, and the whole load is one pass over dimension and
    stage, partitioned by natural key.
    """
    c = contract
    keys, attributes = list(c.natural_keys), list(c.attributes)
    if not attributes:
        raise ValueError(f"{c.table}: no attributes; use load_junk_dimension")
    at = F.col(ref_date) if isinstance(ref_date, str) else literal(ref_date)
    now = literal(run_time or utc_now())
    earliest, latest = literal(MIN_DATE), literal(MAX_DATE)
    written = {c.technical_key, c.version_field, c.date_from, c.date_to, *keys, *attributes, *c.technical_columns}
    # Columns the contract does not name stay as they are; new versions have NULL there.
    extra = [] if dim is None else [n for n in dim.columns if n not in written]
    technical = {n: T.BooleanType() if m == "LastVersion" else NTZ for n, m in c.technical_columns.items()}

    rows = stage.where(_all([F.col(k).isNotNull() for k in keys])).select(
        *keys,
        *attributes,
        at.cast(NTZ).alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast("long").alias("_sk"),
        F.lit(None).cast("int").alias("_version"),
        F.lit(None).cast(NTZ).alias("_to"),
        *[F.lit(None).cast(t).alias(n) for n, t in technical.items()],
    )
    unknown, highest = None, c.unknown_key_value
    if dim is not None:
        unknown = dim.where(F.col(c.technical_key) == c.unknown_key_value)
        known = dim.where(F.col(c.technical_key) != c.unknown_key_value)
        last = dim.agg(F.max(c.technical_key)).first()[0] if highest_key is None else highest_key
        highest = max(last or 0, highest)
        rows = known.select(
            *keys,
            *attributes,
            F.col(c.date_from).cast(NTZ).alias("_at"),
            F.lit(0).alias("_kind"),
            F.col(c.technical_key).cast("long").alias("_sk"),
            F.col(c.version_field).cast("int").alias("_version"),
            F.col(c.date_to).cast(NTZ).alias("_to"),
            *[F.col(n).cast(t).alias(n) for n, t in technical.items()],
            *([F.struct(*extra).alias("_extra")] if extra else []),
        ).unionByName(rows, allowMissingColumns=True)

    order = ["_at", "_kind"]
    cuts = split_points(rows, keys, order, policy)

    # 1. What each staged row changes, compared with the row before it.
    seen = ["_kind", "_at", *attributes]
    carried = ["_extra"] if extra else []
    rows = lag_lead(rows, keys, order, [(f"_before_{n}", n, "LAG", 1) for n in seen], cuts)
    staged, follows = F.col("_kind") == 1, F.col("_before__kind").isNotNull()
    after_staged = follows & (F.col("_before__kind") == 1)
    differs = lambda names: _any([~F.col(n).eqNullSafe(F.col(f"_before_{n}")) for n in names])
    problem = (
        F.when(F.col("_at").isNull(), F.lit(f"{c.table}: a row has no effective date"))
        .when(~staged & after_staged, F.lit(f"{c.table}: a staged row is older than a loaded version of its key"))
        .when(
            staged & after_staged & (F.col("_before__at") == F.col("_at")),
            F.lit(f"{c.table}: two staged rows of one key share a date"),
        )
    )
    opens = ~staged | ~follows | differs(c.attributes_scd2)
    rows = rows.select(
        *keys, *attributes, *technical, *order, *carried, "_sk", "_version", "_to",
        F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(opens).alias("_opens"),
        (staged & ~follows).alias("_new_key"),
        (staged & follows & differs(attributes)).alias("_changed"),
        (staged & follows & differs(c.attributes_punch)).alias("_punched"),
    )

    # 2. A version runs from the row that opens it to the row before the next one that does. Its
    #    last row holds the final attributes, its first row where it starts and what it was.
    rows = running(
        rows, keys, order,
        sums={"_added": F.col("_opens") & staged, "_overwrites": F.col("_changed") & ~F.col("_opens")},
        lasts={"_base": F.col("_version")},
        cuts=cuts,
    )
    first = F.struct("_at", "_kind", "_sk", "_version", "_to", "_new_key", "_overwrites", *technical, *carried)
    rows = running(rows, keys, order, lasts={"_first": F.when(F.col("_opens"), first)}, cuts=cuts)
    following = [("_next_opens", "_opens", "LEAD", 1), ("_next_at", "_at", "LEAD", 1), ("_next_kind", "_kind", "LEAD", 1)]
    rows = lag_lead(rows, keys, order, following, cuts)

    # 3. A punched attribute takes its last staged value in every version of the key.
    final = {n: F.col(n) for n in attributes}
    if c.attributes_punch:
        rows = _with_punch(rows, keys, c.attributes_punch, F.struct(*order), cuts is None)
        hit = F.col("_punch").isNotNull()
        for n in c.attributes_punch:
            final[n] = F.when(hit, F.col(f"_punch.{n}")).otherwise(F.col(n))
    else:
        hit = F.lit(False)

    fresh = F.col("_first._kind") == 1
    old_end = F.col("_first._to")
    closed = F.coalesce((F.col("_next_kind") == 1) & (fresh | (old_end >= latest)), F.lit(False))
    versions = rows.where(F.coalesce(F.col("_next_opens"), F.lit(True))).select(
        *keys,
        *[v.alias(n) for n, v in final.items()],
        *[F.col(f"_first.{n}").alias(n) for n in technical],
        *[F.col("_first._extra")[n].alias(n) for n in extra],
        F.col("_first._sk").alias("_sk"),
        F.coalesce("_first._version", F.coalesce("_base", F.lit(0)) + F.col("_added").cast("int")).alias("_version"),
        F.when(F.col("_first._new_key"), earliest).otherwise(F.col("_first._at")).alias("_from"),
        F.when(closed, F.col("_next_at")).when(fresh, latest).otherwise(old_end).alias("_to"),
        fresh.alias("_fresh"),
        closed.alias("_closed"),
        ((F.col("_overwrites") > F.col("_first._overwrites")) | (hit & ~fresh)).alias("_updated"),
    )

    touched = F.col("_updated") | F.col("_closed")
    stamps = {
        "DateInserted": lambda old: F.when(F.col("_fresh"), now).otherwise(old),
        "DateUpdated": lambda old: F.when(touched, now).otherwise(old),
        "DateInsertedOrUpdated": lambda old: F.when(F.col("_fresh") | touched, now).otherwise(old),
        "LastVersion": lambda old: F.coalesce(F.col("_to") >= latest, F.lit(False)),
    }
    result = versions.select(
        F.col("_sk").alias(c.technical_key),
        F.col("_version").alias(c.version_field),
        F.col("_from").alias(c.date_from),
        F.col("_to").alias(c.date_to),
        *keys,
        *attributes,
        *[stamps[m](F.col(n)).alias(n) for n, m in c.technical_columns.items()],
        *extra,
    )
    if dim is None:
        return _number(result.drop(c.technical_key), c, highest, blocks).select(*result.columns)
    # Written once: the rows that keep their key and the rows that get one come from the same pass.
    result = barrier(result, c.table)
    kept = result.where(F.col(c.technical_key).isNotNull())
    added = _number(result.where(F.col(c.technical_key).isNull()).drop(c.technical_key), c, highest, blocks)
    apart = unknown.select(*[F.col(n).cast(result.schema[n].dataType).alias(n) for n in result.columns])
    return apart.unionByName(kept).unionByName(added)


def load_dimension_changes(
    dim: DataFrame,
    stage: DataFrame,
    contract: DimContract,
    ref_date: str | dt.datetime,
    run_time: dt.datetime | None = None,
    policy: SplitPolicy = SplitPolicy(),
    highest_key: int | None = None,
    blocks: KeyBlocks | None = None,
) -> DataFrame:
    """:func:`load_dimension` for a batch that is small beside the dimension.

    A bitmap of the staged keys tells the versions that the batch can't concern; these pass through without a
    shuffle. Only the others, and the few that share a bit with a staged key, are shuffled and compared. The result is that
    of :func:`load_dimension`; versions that pass through are not looked at for errors.
    """
    c = contract
    if highest_key is None:
        highest_key = dim.agg(F.max(c.technical_key)).first()[0] or 0
    known = dim.where(F.col(c.technical_key) != c.unknown_key_value)
    unknown = dim.where(F.col(c.technical_key) == c.unknown_key_value)
    concerned, apart = split_by_keys(known, stage, list(c.natural_keys))
    loaded = load_dimension(barrier(concerned, f"{c.table}-concerned"), stage, c, ref_date, run_time, policy, highest_key, blocks)
    still = {n: F.coalesce(F.col(c.date_to) >= literal(MAX_DATE), F.lit(False)) for n, m in c.technical_columns.items() if m == "LastVersion"}
    same = [still.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in loaded.schema]
    # The unknown member keeps what it has.
    kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in loaded.schema]
    return unknown.select(*kept).unionByName(apart.select(*same)).unionByName(loaded)


def _with_punch(rows: DataFrame, keys: list[str], names: Sequence[str], place: Column, whole_groups: bool) -> DataFrame:
    """Add ``_punch``: the last values of ``names`` where a staged row of the key changed one."""
    values = F.struct(*names)
    if whole_groups:
        group = Window.partitionBy(*keys)
        return rows.withColumn("_punch", F.when(F.max("_punched").over(group), F.max_by(values, place).over(group)))
    # Some key is too large for one task: find its last values by an aggregate.
    punched = (
        rows.groupBy(*keys)
        .agg(F.max("_punched").alias("_any"), F.max_by(values, place).alias("_punch"))
        .where("_any")
        .select(*[F.col(k).alias(f"_p_{k}") for k in keys], "_punch")
    )
    return rows.join(punched, _all([F.col(k) == F.col(f"_p_{k}") for k in keys]), "left")


def _number(new: DataFrame, c: DimContract, highest: int, blocks: KeyBlocks | None = None) -> DataFrame:
    """Technical keys after the highest one in use, or from reserved blocks, by natural key and version."""
    if blocks is not None:
        return blocks.number(new, [*c.natural_keys, c.version_field], c.technical_key)
    return with_index(new, [*c.natural_keys, c.version_field], c.technical_key, start=highest + 1)


def seed_unknown(dim: DataFrame, contract: DimContract, required: Sequence[str] = ()) -> DataFrame:
    """Add the unknown member unless it is there: version 1, open range, and 0 or DESCONOCIDO in
    required columns."""
    c = contract
    fixed = {
        c.technical_key: F.lit(c.unknown_key_value),
        c.version_field: F.lit(1),
        c.date_from: literal(MIN_DATE),
        c.date_to: literal(MAX_DATE),
    }

    def value(f: T.StructField) -> Column:
        if f.name in fixed:
            return fixed[f.name]
        if f.name not in required:
            return F.lit(None)
        if isinstance(f.dataType, T.NumericType):
            return F.lit(0)
        if isinstance(f.dataType, T.BooleanType):
            return F.lit(False)
        return literal(MIN_DATE) if isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)) else F.lit("DESCONOCIDO")

    row = dim.sparkSession.range(1).select(*[value(f).cast(f.dataType).alias(f.name) for f in dim.schema])
    have = dim.where(F.col(c.technical_key) == c.unknown_key_value).select(c.technical_key)
    return dim.unionByName(row.join(have, c.technical_key, "left_anti").select(*dim.columns))


def inferred_members(
    facts: DataFrame,
    known: DataFrame,
    keys: Mapping[str, str],
    defaults: Mapping[str, Column],
    flag: str = "inferred_member",
) -> DataFrame:
    """Stage rows for keys that facts use and the dimension's source lacks, marked Y.

    ``keys`` maps fact columns to natural keys. The distinct keys are merged per task before they
    are shuffled. Union the result with the real stage rows and load both together.
    """
    present = _all([F.col(f).isNotNull() for f in keys])
    used = facts.where(present).select(*[F.col(f).alias(k) for f, k in keys.items()]).distinct()
    orphans = not_exists_in(used, known, {k: k for k in keys.values()})
    return orphans.select(
        *keys.values(), *[v.alias(n) for n, v in defaults.items()], F.lit("Y").alias(flag)
    )


def load_junk_dimension(
    dim: DataFrame | None, stream: DataFrame, keys: Sequence[str], technical_key: str, first_key: int = 1
) -> DataFrame:
    """A technical key for each combination of ``keys`` seen so far; keeps key columns only."""
    seen = stream.select(*keys).distinct()
    start = first_key
    if dim is not None:
        same = _all([F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys])
        seen = seen.join(dim.select(*[F.col(k).alias(f"_d_{k}") for k in keys]), same, "left_anti")
        start = max((dim.agg(F.max(technical_key)).first()[0] or 0) + 1, first_key)
    added = with_index(seen, keys, technical_key, start=start).select(technical_key, *keys)
    return added if dim is None else dim.select(technical_key, *keys).unionByName(added)


def lookup_junk_key(stream: DataFrame, dim: DataFrame, keys: Sequence[str], technical_key: str) -> DataFrame:
    """The technical key of each row's combination; NULL parts match NULL parts."""
    side = dim.select(*[F.col(k).alias(f"_d_{k}") for k in keys], technical_key)
    same = _all([F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys])
    # Written, so that Spark knows its size and can split a combination that many rows have.
    side = barrier(side, "junk")
    return stream.join(side, same, "left").select(*stream.columns, technical_key)


def dimension_lookup(
    stream: DataFrame,
    dim: DataFrame,
    contract: DimContract,
    on: Mapping[str, str],
    ref_date: str | None = None,
    output: str | None = None,
    attributes: Mapping[str, str] = {},
    run_time: dt.datetime | None = None,
    policy: SplitPolicy = SplitPolicy(),
) -> DataFrame:
    """The technical key valid at ``ref_date`` (``date_from <= ref < date_to``), read-only.

    No match gives the unknown key. Without ``ref_date`` the run's date counts; a NULL in a given
    ``ref_date`` column is an error. ``attributes`` maps dimension columns to output names.
    """
    c = contract
    if ref_date is None:
        moment = literal(run_time or utc_now())
    else:
        moment = F.when(F.col(ref_date).isNull(), F.raise_error(F.lit(f"{c.table}: NULL in {ref_date}"))).otherwise(
            F.col(ref_date)
        )
    out = output or c.technical_key
    values = [
        LookupValue(c.technical_key, out, c.unknown_key_value),
        *[LookupValue(n, r) for n, r in attributes.items()],
    ]
    known = dim.where(F.col(c.technical_key) != c.unknown_key_value)
    found = interval_lookup(
        stream.withColumn("_ref", moment.cast(NTZ)),
        known.withColumns({c.date_from: F.col(c.date_from).cast(NTZ), c.date_to: F.col(c.date_to).cast(NTZ)}),
        on,
        "_ref",
        c.date_from,
        c.date_to,
        values,
        tie=[c.version_field],
        cuts=policy,
    )
    return found.drop("_ref")


def date_key(column: str | Column) -> Column:
    """A date as the number yyyymmdd, the calendar's key."""
    return (F.year(column) * 10_000 + F.month(column) * 100 + F.dayofmonth(column)).cast("long")


def calendar(
    spark: SparkSession,
    first: dt.date,
    last: dt.date,
    languages: tuple[Sequence[str], Sequence[str]] | None = None,
) -> DataFrame:
    """One row per day. ``languages`` gives month and weekday names (Monday first)."""
    months, weekdays = languages or (MONTHS, WEEKDAYS)
    days = (last - first).days + 1
    date = F.date_add(F.lit(first), F.col("id").cast("int"))
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i)
    weekday = F.weekday("fecha") + 1
    return spark.range(days).select(date.alias("fecha")).select(
        date_key("fecha").alias("sk_tiempo"),
        "fecha",
        F.year("fecha").alias("anio"),
        F.quarter("fecha").alias("trimestre"),
        F.month("fecha").alias("mes"),
        pick(months, F.month("fecha")).alias("nombre_mes"),
        F.dayofmonth("fecha").alias("dia"),
        weekday.alias("dia_semana"),
        pick(weekdays, weekday).alias("nombre_dia_semana"),
        (weekday >= 6).alias("es_fin_de_semana"),
    )


# Names used in the calendar.
MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
WEEKDAYS = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")


def calendar_for(df: DataFrame, column: str) -> DataFrame:
    """The calendar from the first to the last date of a column."""
    low, high = df.agg(F.min(F.to_date(column)), F.max(F.to_date(column))).first()
    if low is None:
        raise ValueError(f"no dates in {column}")
    return calendar(df.sparkSession, low, high)
