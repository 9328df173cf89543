"""Readers. Every one returns a lazy frame with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clinote import schemas
from clinote.functions.text import CSV_NULL, with_lines


def read_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """Parquet table; only the named columns are scanned. With a schema no file is opened yet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_query(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Result of a SQL text whose ``{name}`` placeholders are the given frames."""
    return spark.sql(query, **tables)


def jdbc_options(
    url: str,
    *,
    query: str,
    driver: str | None = None,
    user: str | None = None,
    password: str | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    options = {"url": url, "query": query, "fetchsize": str(fetch_size)}
    options.update({k: v for k, v in {"driver": driver, "user": user, "password": password}.items() if v})
    return options


def partitioned_jdbc_options(
    url: str,
    *,
    query: str,
    id_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **connection,
) -> dict[str, str]:
    """Options for a parallel read: one range of ``id_column`` per partition.

    The range bounds only place the partition edges; rows outside them are read too.
    """
    options = jdbc_options(url, query=query, **connection)
    options["dbtable"] = f"({options.pop('query')}) source_rows"
    options.update(
        partitionColumn=id_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)
    )
    return options


def read_jdbc(spark: SparkSession, url: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, **options)).load()


def read_jdbc_partitioned(spark: SparkSession, url: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**partitioned_jdbc_options(url, **options)).load()


def read_csv(spark: SparkSession, path: str, schema: StructType, *, one_line: bool = False) -> DataFrame:
    """CSV with a header; quoted fields may double their quotes, and span lines.

    A file with fields over several lines cannot be split: each file is one task. Files
    written with ``one_line`` hold a row per line and are split like any other.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", not one_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", CSV_NULL)
        .option("emptyValue", "")
        .option("enforceSchema", False)
        .csv(path)
    )
    return with_lines(df) if one_line else df


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents as downloaded, before they become notes."""
    return read_csv(spark, path, schemas.RAW_DOCUMENT)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_corpus(
    spark: SparkSession, path: str, style: str | None = None, split: str | None = None
) -> DataFrame:
    """Annotated corpus; style and split are partition folders, so other ones are not read."""
    partitions = [StructField("style", StringType()), StructField("split", StringType())]
    df = spark.read.schema(StructType([*schemas.CORPUS.fields, *partitions])).parquet(path)
    if style is not None:
        df = df.filter(F.col("style") == style)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df
