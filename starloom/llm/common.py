"""What the operators of this subpackage share: sessions, Arrow passes over texts, learned rows, links to components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.session import barrier

#: Rows in an Arrow batch: a thousand texts stay a few MB, also when some are very long.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python tasks get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_pass(df: DataFrame, columns: list[str | Column], schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Run ``work`` on every Arrow batch of the given columns; ``schema`` names what it returns."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield work(part)

    return df.select(*columns).mapInArrow(batches, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo five; rows with 0 are held out of every training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def smallest_ids(known: DataFrame, count: int, by: str | None = None) -> DataFrame:
    """The rows of ``known`` (doc_id, ...) with the ``count`` smallest md5 of their id, for each value of ``by`` if given.

    Digests spread evenly, so of n rows only those below ``2 * count / n`` of their range are sorted: a window gets about
    twice the rows that are picked, however many there are. ``by`` is a class that the caller learns: it has few values.
    """
    own = [by] if by else []
    digest = F.md5(F.col("doc_id").cast("string"))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    sizes = known.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    sizes = F.broadcast(sizes)
    near = (known.join(sizes, by) if by else known.crossJoin(sizes)).filter(place * F.col("_n") <= 2.0 * count + 100)
    order = Window.partitionBy(*(own or [F.lit(0)])).orderBy(digest, "doc_id")
    return near.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= count).select(*known.columns)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, label) of at most ``per_class`` labelled documents of each class outside the held-out fold.

    The rows with the smallest md5 of their id are taken, so that the choice is the same on every run. The ids are
    picked from ``labels`` alone; the pick has a fixed bound and is the broadcast side of the join with the texts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id", F.col(label).alias("label")).distinct()
    picked = smallest_ids(known, per_class, "label")
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that can be reached.

    Alternates the large-star and the small-star step: neighbours above a node move to its smallest neighbour, then those
    below do, until every link ends in a root. Steps are grouped minima and equality joins, so a node that is linked with
    a third of all nodes is pre-aggregated and its join partition can be split; every step is a written table.
    """
    stars = barrier(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        deep = stars.select(F.col("v").alias("mid")).join(stars.select(F.col("u").alias("mid")), "mid", "left_semi").limit(1)
        if not deep.take(1):
            # No root is below another node, but a node may still have several roots above it.
            if not stars.groupBy("u").count().filter("count > 1").limit(1).take(1):
                return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = barrier(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = barrier(small.filter("u <> v").distinct(), name)
