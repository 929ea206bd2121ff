"""Tables in folders by the hash of their key, so that a load rewrites only the folders its keys are in.

A keyed table is a folder::

    meta.json      keys, number of buckets, schema
    data/_bucket=17/part-....parquet
    lock           there while a load runs
    pending.json   what to swap, once the new buckets are complete

A load finds the buckets of its batch, reads those, writes their new content to the shared folder and then moves it into
place, bucket by bucket. Files of all other buckets are not opened. If the driver dies while it moves
folders, :func:`recover` goes on from ``pending.json``; if it dies before, the table is as it was. A load is meant to
run while nobody reads; where readers must never see a load half done, use :func:`starloom.sinks.writers.publish`.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import DimContract
from starloom.functions.casting import literal, utc_now
from starloom.operators.dimension import load_dimension_changes
from starloom.operators.merge import delete_matching, one_per_key, upsert
from starloom.operators.sequence import spread
from starloom.session import barrier, claim, hadoop_path, scratch_path

_BUCKET = "_bucket"


@dataclass(frozen=True)
class Rewritten:
    """What a load did: buckets it read and wrote anew, of how many, and rows of the batch."""

    touched: tuple[int, ...]
    buckets: int
    batch_rows: int


@dataclass(frozen=True)
class KeyedTable:
    path: str
    keys: tuple[str, ...]
    buckets: int
    schema: T.StructType

    def bucket(self, df: DataFrame) -> Column:
        """The bucket of each row. Rows with a NULL in their key match nothing, so they are spread by their whole content."""
        # Cast, so that batch and table hash alike.
        keys = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        complete = functools.reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
        return F.pmod(F.when(complete, F.xxhash64(*keys)).otherwise(spread(df)), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or the given buckets of it; folders of others are not opened."""
        stored = T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        rows = spark.read.schema(stored).parquet(f"{self.path}/data")
        if buckets is not None:
            rows = rows.where(F.col(_BUCKET).isin(list(buckets)))
        return rows.select(*self.schema.names)

    def _write(self, df: DataFrame, path: str) -> None:
        placed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn(_BUCKET, self.bucket(df))
        placed.repartition(F.col(_BUCKET)).write.mode("errorifexists").partitionBy(_BUCKET).parquet(path)


def create_keyed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> KeyedTable:
    """Write ``df`` as a new keyed table. Take so many buckets that one is a few hundred MB.

    Keys are meant to be unique or nearly so (rows of a key share a bucket).
    """
    spark = df.sparkSession
    table = KeyedTable(path.rstrip("/"), tuple(keys), buckets, df.schema)
    fs, at = hadoop_path(spark, table.path)
    if fs.exists(at):
        raise FileExistsError(path)
    table._write(df, f"{table.path}/data")
    _put(spark, f"{table.path}/meta.json", {"keys": list(keys), "buckets": buckets, "schema": df.schema.jsonValue()})
    return table


def open_keyed(spark: SparkSession, path: str) -> KeyedTable:
    path = path.rstrip("/")
    meta = json.loads(spark.read.text(f"{path}/meta.json", wholetext=True).first()[0])
    return KeyedTable(path, tuple(meta["keys"]), meta["buckets"], T.StructType.fromJson(meta["schema"]))


def _put(spark: SparkSession, path: str, content: dict) -> None:
    """A small file that is either there whole or not at all."""
    fs, part = hadoop_path(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not fs.rename(part, hadoop_path(spark, path)[1]):
        raise OSError(f"cannot write {path}")


def _swap(spark: SparkSession, path: str, staged: str, touched: Sequence[int], filled: Sequence[int]) -> None:
    """Move each staged bucket over the old one; what is moved already is left alone, so this can start again."""
    fs, _ = hadoop_path(spark, path)
    full = set(filled)
    fs.mkdirs(hadoop_path(spark, f"{path}/data")[1])
    for bucket in touched:
        _, old = hadoop_path(spark, f"{path}/data/{_BUCKET}={bucket}")
        _, new = hadoop_path(spark, f"{staged}/{_BUCKET}={bucket}")
        if bucket in full and not fs.exists(new):
            continue
        fs.delete(old, True)
        if bucket in full and not fs.rename(new, old):
            raise OSError(f"cannot move {new} to {old}")
    # What a session has cached of the table is of the old files.
    spark.catalog.refreshByPath(f"{path}/data")


def recover(spark: SparkSession, path: str) -> bool:
    """Finish or undo a load whose driver died, and unlock the table. True if there was anything to finish.

    Call it only when no other load runs.
    """
    path = path.rstrip("/")
    fs, pending = hadoop_path(spark, f"{path}/pending.json")
    found = bool(fs.exists(pending))
    if found:
        todo = json.loads(spark.read.text(f"{path}/pending.json", wholetext=True).first()[0])
        _swap(spark, path, todo["staged"], todo["touched"], todo["filled"])
        fs.delete(pending, False)
    fs.delete(hadoop_path(spark, f"{path}/lock")[1], False)
    return found


def rewrite(
    table: KeyedTable, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], matched_only: bool = False
) -> Rewritten:
    """Replace the buckets of ``batch`` (which has the key columns) by ``change(their rows, batch)``.

    ``change`` must not make rows of other buckets' keys. With ``matched_only`` the batch's keys are first looked for in
    the key columns of their buckets, and only buckets that have one are rewritten.
    """
    spark = batch.sparkSession
    if not claim(spark, f"{table.path}/lock"):
        raise RuntimeError(f"{table.path}: another load is running, or one died: call recover")
    fs, lock = hadoop_path(spark, f"{table.path}/lock")
    _, pending = hadoop_path(spark, f"{table.path}/pending.json")
    try:
        batch = barrier(batch, "batch")
        placed = batch.withColumn(_BUCKET, table.bucket(batch))
        # One row per bucket at most.
        found = {r[_BUCKET]: r["n"] for r in placed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = sorted(found)
        if matched_only and touched:
            keys = list(table.keys)
            wanted = placed.select(*[F.col(k).cast(table.schema[k].dataType).alias(k) for k in keys]).distinct()
            have = table.read(spark, touched).select(*keys).join(wanted, keys, "left_semi")
            touched = sorted(r[0] for r in have.select(table.bucket(have)).distinct().collect())
        if touched:
            staged = scratch_path(spark, "staged")
            table._write(change(table.read(spark, touched), batch), staged)
            _, root = hadoop_path(spark, staged)
            filled = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.isDirectory() and "=" in s.getPath().getName()]
            strange = set(filled) - set(touched)
            if strange:
                raise ValueError(f"{table.path}: the change made rows of other buckets: {sorted(strange)[:5]}")
            _put(spark, f"{table.path}/pending.json", {"staged": staged, "touched": touched, "filled": filled})
            _swap(spark, table.path, staged, touched, filled)
            fs.delete(pending, False)
    finally:
        # A load that failed half-way through the swap stays locked until recover() has finished it.
        if not fs.exists(pending):
            fs.delete(lock, False)
    return Rewritten(tuple(touched), table.buckets, sum(found.values()))


def upsert_keyed(
    table: KeyedTable, source: DataFrame, update: Sequence[str] | None = None, order: Sequence[str] = (), insert: bool = True
) -> Rewritten:
    """:func:`~starloom.operators.merge.upsert` on the table's key, of the touched buckets alone."""
    keys = list(table.keys)
    return rewrite(table, source, lambda old, batch: upsert(old, batch, keys, update, order, insert), matched_only=not insert)


def delete_keyed(table: KeyedTable, source: DataFrame, keys: Sequence[tuple[str, str, str]]) -> Rewritten:
    """:func:`~starloom.operators.merge.delete_matching` of the touched buckets; the tests hold an equality for every column of the key."""
    named = {t: s for t, op, s in keys if op == "="}
    if not set(table.keys) <= set(named):
        raise ValueError(f"deleting by bucket needs equality on {table.keys}")
    columns = [F.col(named[k]).alias(k) for k in table.keys]
    rest = [F.col(s).alias(f"_s{i}") for i, (_, _, s) in enumerate(keys)]
    tests = [(t, op, f"_s{i}") for i, (t, op, _) in enumerate(keys)]
    return rewrite(table, source.select(*columns, *rest), lambda old, batch: delete_matching(old, batch, tests), matched_only=True)


def first_of_keyed(source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``; what a keyed table is first filled with."""
    values = [c for c in source.columns if c not in keys]
    return one_per_key(source, keys, [], values, order).select(*source.columns)


def load_fact_keyed(
    table: KeyedTable, stream: DataFrame, order: Sequence[str] = (), run_time: dt.datetime | None = None, loaded_at: str = "dwh_fecha_carga"
) -> Rewritten:
    """:func:`~starloom.operators.fact.load_fact` into a fact that is keyed by its grain."""
    return upsert_keyed(table, stream.withColumn(loaded_at, literal(run_time or utc_now())), order=order)


def load_dimension_keyed(
    table: KeyedTable, stage: DataFrame, contract: DimContract, ref_date: str | dt.datetime, run_time: dt.datetime | None = None
) -> Rewritten:
    """:func:`~starloom.operators.dimension.load_dimension` into a dimension that is keyed by its natural key.

    Only buckets with a staged key are read and rewritten, and in these only versions that may have a staged key are
    shuffled. Of the rest one column is read, for the highest technical key.
    """
    spark = stage.sparkSession
    if set(table.keys) != set(contract.natural_keys):
        raise ValueError(f"{contract.table} is keyed by {table.keys}")
    highest = table.read(spark).agg(F.max(contract.technical_key)).first()[0] or 0
    run_time = run_time or utc_now()

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        return load_dimension_changes(old, batch, contract, ref_date, run_time, highest_key=highest)

    return rewrite(table, stage.dropna(how="any", subset=list(table.keys)), change)
