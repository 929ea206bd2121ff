"""Sinks: tables, versioned tables, delimited text and JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.keyblocks import claim_next
from starloom.operators.sequence import with_index


def write_table(
    df: DataFrame,
    path: str,
    truncate: bool = False,
    fields: Mapping[str, str] | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Append to a Parquet table, or empty it first. ``fields`` maps table columns to stream columns.

    Never point this at a path the same DataFrame reads; use :func:`publish` for that.
    """
    out = df.select(*[F.col(s).alias(c) for c, s in fields.items()]) if fields else df
    writer = out.write.mode("overwrite" if truncate else "append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a new table at ``path`` and read it back: a barrier between the steps of a process."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def publish(df: DataFrame, name: str, bucket_by: Sequence[str] = (), buckets: int = 0) -> str:
    """Write ``df`` as the next version of table ``name`` and repoint the view ``name`` at it.

    The new version may be computed from the current one: readers see the old table until the view
    is replaced. Bucketing on the natural key lets later loads and lookups skip a shuffle. The version number is reserved
    in the warehouse, so of two drivers that publish at once none fails; the view shows what the later one wrote.
    """
    spark = df.sparkSession
    numbers = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_versions/{name}"
    version = claim_next(spark, numbers, max([0, *_versions(spark, name)]) + 1)
    table = f"{name}__v{version}"
    writer = df.write.mode("errorifexists").format("parquet")
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(table)
    _repoint(spark, name, table)
    return table


def _repoint(spark: SparkSession, name: str, table: str) -> None:
    """Let the view show ``table``. Of drivers that make or change a view at once, some have to try again."""
    for tries in reversed(range(5)):
        try:
            spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {table}")
            return
        except AnalysisException:
            if not tries:
                raise


def _versions(spark: SparkSession, name: str) -> list[int]:
    database, _, short = name.rpartition(".")
    tables = spark.catalog.listTables(database or spark.catalog.currentDatabase(), f"{short}__v*")
    return [int(t.name.rsplit("__v", 1)[1]) for t in tables if t.name.rsplit("__v", 1)[1].isdigit()]


def drop_old_versions(spark: SparkSession, name: str, keep: int = 2) -> list[str]:
    """Drop all but the newest ``keep`` versions of a published table."""
    if keep < 1:
        raise ValueError("the current version has to stay")
    dropped = [f"{name}__v{v}" for v in sorted(_versions(spark, name))[:-keep]]
    for table in dropped:
        spark.sql(f"DROP TABLE {table}")
    return dropped


def merge_into(df: DataFrame, table: str, keys: Sequence[str], update: Sequence[str] | None = None) -> None:
    """Upsert in place, for catalogs whose tables support row-level changes."""
    values = [c for c in df.columns if c not in keys]
    update = values if update is None else list(update)
    on = F.expr(" AND ".join(f"target.{k} = source.{k}" for k in keys))
    merge = df.alias("source").mergeInto(f"{table}", on)
    if update:
        merge = merge.whenMatched().update({c: F.col(f"source.{c}") for c in update})
    merge.whenNotMatched().insert({c: F.col(f"source.{c}") for c in df.columns}).merge()


def write_text(
    df: DataFrame, path: str, separator: str = ";", header: bool = True, append: bool = False, enclosure: str = '"'
) -> None:
    """Delimited text files."""
    (
        df.write.mode("append" if append else "overwrite")
        .option("sep", separator)
        .option("quote", enclosure)
        .option("escape", enclosure)
        .option("header", str(header).lower())
        .csv(path)
    )


def json_blocks(
    df: DataFrame,
    elements: Mapping[str, str],
    order: Sequence[str],
    rows_per_block: int = 1,
    block: str = "data",
    output: str = "json_output",
) -> DataFrame:
    """JSON documents ``{"data": [{...}, ...]}`` of ``rows_per_block`` rows taken in ``order``.

    ``elements`` maps element names to columns. A block is as large as asked for and no larger.
    """
    if rows_per_block < 1:
        raise ValueError("a block needs at least one row")
    numbered = with_index(df, order, "_index")
    item = F.struct("_index", F.struct(*[F.col(c).alias(e) for e, c in elements.items()]).alias("_item"))
    blocks = numbered.groupBy(F.floor(F.col("_index") / rows_per_block).alias("block")).agg(
        F.sort_array(F.collect_list(item)).alias("_items")
    )
    document = F.struct(F.transform("_items", lambda i: i["_item"]).alias(block))
    return blocks.select("block", F.to_json(document, {"ignoreNullFields": "false"}).alias(output))


def write_json(
    df: DataFrame,
    path: str,
    elements: Mapping[str, str],
    order: Sequence[str],
    rows_per_block: int = 1,
    block: str = "data",
) -> None:
    """One JSON document per line."""
    json_blocks(df, elements, order, rows_per_block, block).select("json_output").write.mode("overwrite").text(path)
