"""Run a query and its SQL on the same files and compare names, types, and rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

FAMILIES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}") + 0.0
    return value


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=repr)


def differences(spark, con, name: str, run, sql: str, sf_dir: str) -> str | None:
    """None when both agree, otherwise what differs."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(r[n] for n in names) for r in df.collect()]
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} vs {sorted(theirs_names)}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    for field in df.schema:
        want = FAMILIES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if types[field.name].upper() not in (want, "NULL", '"NULL"'):
            return f"type of {field.name}: {field.dataType.simpleString()} vs {types[field.name]}"
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    for a, b in zip(_sorted(ours), _sorted(theirs)):
        if a != b:
            return f"{names}: {a} vs {b}"
    return None if ours else "no rows"
