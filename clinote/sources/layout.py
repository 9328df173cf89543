"""Stored layouts that later queries profit from: buckets whose joins need no shuffle, and files that filters skip."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# A bucket is read by one task. Beyond this many bytes of files in one, the table is read without its buckets.
MAX_BUCKET_BYTES = 1 << 30
_FOLDER = re.compile(r"buckets=(\d+)-(.+)")
_BUCKET_FILE = re.compile(r"_(\d{5})\.c\d+")


def _children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes in a folder; none where it is absent."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    return [(status.getPath().getName(), status.getLen()) for status in system.listStatus(folder)]


def _qualified(spark: SparkSession, path: str) -> str:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def _table_of(folder: str) -> str:
    return "bucketed_" + hashlib.md5(folder.encode()).hexdigest()


def write_bucketed(df: DataFrame, path: str, key: str, n_buckets: int, *, splits: int = 1) -> None:
    """Store ``df`` in ``n_buckets`` buckets by ``key``; a path that holds a table is an error.

    Key and number stand in the folder's name, so a reader cannot mistake them. Each task writes one file of one
    bucket; ``splits`` deals a bucket to that many tasks, so that a key that holds many rows is not written by one.
    """
    if any(_FOLDER.fullmatch(name) for name, _ in _children(df.sparkSession, path)):
        raise ValueError(f"{path} holds a bucketed table")
    if splits == 1:
        dealt = df.repartition(n_buckets, F.col(f"`{key}`"))
    else:
        bucket = F.pmod(F.hash(F.col(f"`{key}`")), F.lit(n_buckets))
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(splits))
        dealt = df.repartition(n_buckets * splits, bucket, salt)
    folder = _qualified(df.sparkSession, f"{path}/buckets={n_buckets}-{key}")
    writer = dealt.write.format("parquet").option("path", folder).bucketBy(n_buckets, key).sortBy(key)
    writer.saveAsTable(_table_of(folder))


def bucket_bytes(spark: SparkSession, path: str) -> dict[int, int]:
    """Bytes of files per bucket of a stored table; empty buckets are not listed."""
    sizes: dict[int, int] = {}
    for folder, _ in _children(spark, path):
        if _FOLDER.fullmatch(folder):
            for name, size in _children(spark, f"{path}/{folder}"):
                if found := _BUCKET_FILE.search(name):
                    sizes[int(found[1])] = sizes.get(int(found[1]), 0) + size
    return sizes


def read_bucketed(
    spark: SparkSession, path: str, schema: StructType, *, max_bucket_bytes: int = MAX_BUCKET_BYTES
) -> DataFrame:
    """A table of ``write_bucketed``, also of another session; joins and groups on its key need no shuffle.

    Where a bucket is larger than ``max_bucket_bytes``, as with a key that holds much of the rows, the files are read
    without their buckets, so that adaptive execution can split the large side of a join. The rows are the same.
    """
    layouts = [(name, _FOLDER.fullmatch(name)) for name, _ in _children(spark, path)]
    layouts = [(name, found) for name, found in layouts if found]
    if not layouts:
        raise ValueError(f"{path} holds no bucketed table")
    name, found = layouts[0]
    folder = _qualified(spark, f"{path}/{name}")
    if max(bucket_bytes(spark, path).values(), default=0) > max_bucket_bytes:
        return spark.read.schema(schema).parquet(folder)
    table = _table_of(folder)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    key = found[2]
    spark.sql(
        f"create table if not exists {table} ({columns}) using parquet location '{folder}' "
        f"clustered by (`{key}`) sorted by (`{key}`) into {found[1]} buckets"
    )
    return spark.table(table).select(*[f"`{f.name}`" for f in schema.fields])


def write_clustered(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    *,
    bloom: dict[str, int] | None = None,
    row_group_bytes: int | None = None,
    mode: str = "error",
) -> None:
    """Store ``df`` in ranges of ``by``, sorted in each file, so that a filter on its first columns skips most row groups.

    Ranges are cut by all rows' digests too, so rows that share the values of ``by`` are dealt to many files.
    ``bloom`` gives columns of scattered values a Bloom filter per row group, for so many distinct values in one.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keys = [F.col(f"`{c}`") for c in by]
    writer = df.repartitionByRange(*keys, spread).sortWithinPartitions(*keys).write.mode(mode)
    for column, values in (bloom or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True)
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", values)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
