"""Sources: tables, SQL, delimited text, JSON, XML, generated rows, samples, schema inference."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.contracts import spark_type
from starloom.functions.casting import DATE_LAYOUTS, cast_to, parse_decimal_comma
from starloom.functions.text import normalise
from starloom.operators.profiling import profile
from starloom.session import barrier


@dataclass(frozen=True)
class Field:
    """A declared file or JSON field."""

    name: str
    type: str = "String"
    layout: str | None = None
    length: int | None = None
    precision: int | None = None
    trim: str = "none"
    path: str | None = None

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.type, self.length, self.precision)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """A Parquet table; projection and filter reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A SELECT over DataFrames named in braces, e.g. ``SELECT * FROM {orders}``."""
    return spark.sql(sql, **tables)


def jdbc_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC read, split over ``partitions`` ranges of a column when one is given."""
    options = {"url": url, "fetchsize": str(fetch_size), "pushDownAggregate": "true", "pushDownLimit": "true"}
    if partition_column is None:
        return {**options, "query": query}
    if bounds is None:
        raise ValueError("a partitioned read needs bounds")
    return {
        **options,
        "dbtable": f"({query}) source",
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Rows of a SELECT in a PostgreSQL or SQL Server database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()


def _ungrouped(text: Column, group: str) -> Column:
    """Whole numbers without the marks between groups of three digits; other text as it is."""
    mark = re.escape(group)
    return F.when(text.rlike(rf"\A[+-]?\d{{1,3}}({mark}\d{{3}})+\z"), F.replace(text, F.lit(group), F.lit(""))).otherwise(text)


def _plain(text: Column, decimal: str, group: str, currency: str) -> Column:
    """A number with ``decimal`` as its mark, written with a point."""
    for mark in (currency, group):
        text = F.replace(text, F.lit(mark), F.lit("")) if mark else text
    return F.trim(F.replace(text, F.lit(decimal), F.lit(".")))


def _typed(raw: DataFrame, fields: Sequence[Field], decimal: str, group: str, currency: str) -> DataFrame:
    """Text columns to their declared types; empty text is NULL."""
    out = []
    for f in fields:
        text = F.nullif(normalise(F.col(f.name), f.trim), F.lit(""))
        if isinstance(f.spark, T.IntegralType) and group:
            value = cast_to(_ungrouped(text, group), T.StringType(), f.spark)
        elif isinstance(f.spark, T.DoubleType) and decimal != ".":
            # Not by way of a decimal, which has no room for very small or large numbers.
            value = _plain(text, decimal, group, currency).try_cast("double")
        elif isinstance(f.spark, T.DecimalType) and decimal != ".":
            value = parse_decimal_comma(text, f.spark.precision, f.spark.scale, decimal, group, currency).cast(f.spark)
        else:
            value = cast_to(text, T.StringType(), f.spark, f.layout)
        out.append(value.alias(f.name))
    return raw.select(*out)


def _delimited(
    spark: SparkSession, path, fields, separator, enclosure, header, encoding, multiline=False
) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    return (
        spark.read.schema(schema)
        .option("sep", separator)
        .option("quote", enclosure)
        .option("escape", enclosure)
        .option("header", str(header).lower())
        .option("encoding", encoding)
        .option("multiLine", str(multiline).lower())
        .option("enforceSchema", "true")
        .csv(path)
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    fields: Sequence[Field],
    separator: str = ",",
    enclosure: str = '"',
    header: bool = True,
    encoding: str = "UTF-8",
    decimal: str = ",",
    group: str = ".",
    currency: str = "€",
) -> DataFrame:
    """A CSV file with a declared schema; numbers use the decimal comma unless told otherwise."""
    raw = _delimited(spark, path, fields, separator, enclosure, header, encoding)
    return _typed(raw, fields, decimal, group, currency)


def read_text(
    spark: SparkSession,
    path: str | list[str],
    fields: Sequence[Field],
    separator: str = ";",
    enclosure: str = '"',
    header_lines: int = 1,
    skip_empty: bool = True,
    encoding: str = "UTF-8",
    decimal: str = ".",
    group: str = ",",
) -> DataFrame:
    """A delimited text file; blank lines are left out and fields are trimmed as declared.

    ``header_lines`` lines go from the top of every file; files stay splittable, also if they have several.
    """
    if header_lines in (0, 1):
        raw = _delimited(spark, path, fields, separator, enclosure, bool(header_lines), encoding)
    else:
        lines = numbered_lines(spark, path, encoding, upto=header_lines)
        body = lines.where(F.col("line").isNull() & (F.trim("value") != ""))
        schema = ", ".join(f"`{f.name}` string" for f in fields)
        parsed = F.from_csv("value", schema, {"sep": separator, "quote": enclosure, "escape": enclosure})
        raw = body.select(parsed.alias("_fields")).select("_fields.*")
    if skip_empty:
        blank = F.lit(True)
        for f in fields:
            blank = blank & (F.trim(F.coalesce(F.col(f.name), F.lit(""))) == "")
        raw = raw.where(~blank)
    return _typed(raw, fields, decimal, group, "")


def numbered_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", upto: int | None = None) -> DataFrame:
    """(value, file, line): the lines of text files, numbered from 1 within each file, read in splits.

    With ``upto`` only the first so many lines of a file have a number, the others NULL.

    Lines of a split come one after another, so a line's number is that of the split's first line plus its distance.
    A first pass counts the lines of every split, which reads no line's text; the counts before a split are added up per
    file. Both passes plan the same splits of the same list of files.
    """
    read = spark.read.option("encoding", encoding).text(path)
    at = F.monotonically_increasing_id()
    placed = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), at.alias("_at"))
    splits = barrier(placed.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines")), "splits")
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    if upto is not None:
        # Hardly more than the first split of each file.
        starts = starts.where(F.col("_before") < upto)
    starts = barrier(starts, "split-starts")
    joined = placed.join(starts, ["file", "_split"], "left")
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return joined.select("value", "file", (number if upto is None else F.when(number <= upto, number)).alias("line"))


def json_fields(df: DataFrame, source: str, fields: Sequence[Field], remove: bool = False) -> DataFrame:
    """Typed columns from JSON paths of a text column; a missing leaf is NULL."""
    added = {
        f.name: cast_to(normalise(F.get_json_object(source, f.path or f"$.{f.name}"), f.trim), T.StringType(), f.spark, f.layout)
        for f in fields
    }
    out = df.withColumns(added)
    return out.drop(source) if remove else out


def read_json(spark: SparkSession, path: str | list[str], fields: Sequence[Field], include_nulls: bool = False) -> DataFrame:
    """JSON objects, one per line. Unless ``include_nulls``, an object without any of the fields
    gives no row."""
    raw = spark.read.text(path).withColumnRenamed("value", "_json")
    out = json_fields(raw, "_json", fields, remove=True)
    return out if include_nulls else out.dropna(how="all")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Elements ``row_tag`` of XML files."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def generate_rows(spark: SparkSession, limit: int = 1, constants: Mapping[str, tuple[object, str]] = {}) -> DataFrame:
    """``limit`` equal rows of typed constants."""
    columns = [F.lit(None if v == "" else v).cast(spark_type(t)).alias(n) for n, (v, t) in constants.items()]
    return spark.range(limit).select(*columns)


def sample_rows(df: DataFrame, limit: int = 20, fraction: float = 0.01, seed: int = 0) -> tuple[DataFrame, str]:
    """At most ``limit`` rows and how they were drawn: by fraction, or at random from a table so
    small that the fraction gave none."""
    # In random order, as the first rows drawn would all come from the first files.
    drawn = df.sample(fraction, seed).orderBy(F.rand(seed)).limit(limit)
    if not drawn.isEmpty():
        return drawn, "fraction"
    return df.orderBy(F.rand(seed)).limit(limit), "random"


#: Whole files are drawn where that gives so many at least; otherwise their blocks are.
DRAWN_FILES = 8
_GRAIN = 1 << 30


def sample_blocks(spark: SparkSession, path: str, fraction: float = 0.01, seed: int = 0) -> tuple[DataFrame, str]:
    """All rows of about ``fraction`` of a Parquet table's blocks, with ``_file`` and ``_block``, and what a block is.

    Like a sample of pages: cheap, and biased where neighbouring rows are alike. The draw is a hash of the block's place, so
    it is the same each time. A table of many files is drawn by ``file``, and the files that are not drawn
    are not opened; one of few files by ``block``, the stretch of a file that one task reads, which saves the work
    after the scan but not the reading.
    """
    df = spark.read.parquet(path)
    drawn = lambda *place: F.pmod(F.xxhash64(*place, F.lit(seed)), F.lit(_GRAIN)) < int(fraction * _GRAIN)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    named = df.select("*", file.alias("_file"), start.alias("_block"))
    if len(df.inputFiles()) * fraction >= DRAWN_FILES:
        return named.where(drawn(file)), "file"
    return named.where(drawn(file, start)), "block"


def sample_pages(spark: SparkSession, path: str, limit: int = 20, fraction: float = 0.01, seed: int = 0) -> tuple[DataFrame, str]:
    """At most ``limit`` rows of drawn blocks and the sample's bias: page_level, or row_level for a table so small that no block was drawn."""
    rows, _ = sample_blocks(spark, path, fraction, seed)
    rows = rows.drop("_file", "_block").limit(limit)
    if not rows.isEmpty():
        return rows, "page_level"
    return spark.read.parquet(path).orderBy(F.rand(seed)).limit(limit), "row_level"


# -- schema inference ----------------------------------------------------------------------------

# Delimiters that are recognised, and lines looked at to recognise them.
DELIMITERS = (",", ";", "\t", "|")
HEAD_LINES = 1_000


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The delimiter that splits the first lines into the same, largest number of fields."""
    lines = [r[0] for r in spark.read.option("encoding", encoding).text(path).limit(HEAD_LINES).collect() if r[0].strip()]
    if not lines:
        raise ValueError(f"{path} is empty")

    def score(delimiter: str) -> tuple[float, int]:
        counts = [line.count(delimiter) for line in lines]
        return (sum(c == counts[0] for c in counts) / len(counts) if counts[0] else 0.0, counts[0])

    best = max(DELIMITERS, key=score)
    return best if score(best)[1] else ","


def infer_file_schema(spark: SparkSession, path: str, encoding: str = "UTF-8", fraction: float = 1.0) -> DataFrame:
    """``(column, canonical_type, layout, null_pct, distinct_count, format_hint)`` of a CSV file.

    Types are inferred by Spark over the file, or over a fraction of it; text columns that hold one
    date layout become dates.
    """
    reader = spark.read.option("sep", detect_delimiter(spark, path, encoding)).option("header", "true").option("encoding", encoding)
    typed = reader.option("inferSchema", "true").option("samplingRatio", str(fraction)).csv(path)
    text = reader.csv(path)
    canonical = {
        "int": "integer", "bigint": "integer", "double": "number", "boolean": "boolean", "date": "date",
        "timestamp": "datetime", "timestamp_ntz": "datetime", "string": "string",
    }
    types = [
        (n, canonical.get(t.split("(")[0], "number" if t.startswith("decimal") else "unknown")) for n, t in typed.dtypes
    ]
    declared = spark.createDataFrame(types, "column string, canonical_type string")
    p = profile(text, empty_is_null=True)
    hint, dated = F.col("format_hint"), (F.col("canonical_type") == "string") & (F.col("inferred_type") == "date")
    known = hint.isin(*DATE_LAYOUTS)
    return declared.join(p, "column", "left").select(
        "column",
        F.when(dated & known, F.lit("date")).otherwise(F.col("canonical_type")).alias("canonical_type"),
        F.when(known, hint).when(F.col("canonical_type").isin("date"), F.lit("YYYY-MM-DD")).otherwise(F.lit("default")).alias("layout"),
        "null_pct",
        "distinct_count",
        "format_hint",
    )
