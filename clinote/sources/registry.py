"""Numbers that go on over loads, as a database sequence gives them, and loads that can be repeated.

A registry is a folder with one folder per load, named after the last number that it gives; a load counts once its
success mark is there. So the high-water mark is read from names, a load that failed is
written anew, and a load of known keys adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from clinote.functions import ranking
from clinote.session import store

MARK, BUCKETS = "upto", 64


def _loads(spark: SparkSession, path: str) -> dict[int, str]:
    """Folders of the finished loads by the last number of each."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARK}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    folders = [status.getPath().getParent() for status in found]
    return {int(folder.getName().split("=")[1]): folder.toString() for folder in folders}


def high_water_mark(spark: SparkSession, path: str) -> int:
    """The last number given, 0 before the first load."""
    return max(_loads(spark, path), default=0)


def known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All keys of a registry with their numbers."""
    folders = sorted(_loads(spark, path).values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def number_keys(rows: DataFrame, key: Sequence[str], path: str, name: str) -> DataFrame:
    """Add ``name``: the number of each row's key, 1..n without gaps over all loads of the registry at ``path``.

    Keys that the registry knows keep their number; new ones go on behind the last one, in the order of a digest, so that
    ranking stays parallel. Rows that share a key share its number; null parts are values like others. Loads
    into one registry come one after the other.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key) + f", `{name}` long"
    before = known(spark, path, schema)
    old = before.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in key], F.col(f"`{name}`").alias("__number"))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in key]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key]))
    fresh = rows.select(*[f"`{k}`" for k in key]).distinct().join(old, same, "left_anti")
    fresh = store(spark, fresh.withColumn("__digest", digest), "new-keys")
    n, last = fresh.count(), high_water_mark(spark, path)
    if n:
        ranked = ranking.with_position(fresh, "__digest", "__position", tie_break=list(key))
        numbered = ranked.select(*[f"`{k}`" for k in key], (F.col("__position") + last + 1).alias(name))
        # The folder is replaced as a whole: what an interrupted load left there does not count.
        numbered.write.mode("overwrite").parquet(f"{path}/{MARK}={last + n}")
    numbers = known(spark, path, schema)
    given = numbers.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in key], F.col(f"`{name}`"))
    return rows.join(given, same).drop(*[f"__{k}" for k in key])


def hash_collisions(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``hash, n_keys``: 64-bit hashes of ``key`` that several keys share, for which the hashed id is not one."""
    keys = rows.select(*[f"`{k}`" for k in key]).distinct()
    return keys.groupBy(F.xxhash64(*[f"`{k}`" for k in key]).alias("hash")).agg(F.count("*").alias("n_keys")).filter("n_keys > 1")


def replace_notes(
    rows: DataFrame, notes: DataFrame, path: str, *, key: str = "note_id", n_buckets: int = BUCKETS
) -> None:
    """Load the rows of whole notes into the table at ``path``; what it held of these notes goes.

    ``notes`` has the key of every note that was read, also of those without a row now. Running a load twice equals running
    it once. The table lies in folders by a hash of the key; those that the load touches are staged and then
    swapped in, the others stay. Rows without a key belong to no note and are left out.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(n_buckets)).cast("int")
    incoming = rows.filter(F.col(key).isNotNull()).withColumn("bucket", bucket)
    read = notes.select(F.col(key).alias("__note")).filter(F.col("__note").isNotNull()).distinct()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        touched = [r[0] for r in read.select(F.pmod(F.xxhash64("__note"), F.lit(n_buckets)).cast("int")).distinct().collect()]
        held = spark.read.schema(incoming.schema).parquet(path).filter(F.col("bucket").isin(touched))
        kept = held.join(read, held[key] == F.col("__note"), "left_anti")
        # An empty folder is not swapped in: a touched one keeps a marker row until the rows are read.
        incoming = incoming.unionByName(kept)
        empty = spark.createDataFrame([(b,) for b in touched], "bucket int")
        incoming = incoming.unionByName(empty, allowMissingColumns=True)
    staged = store(spark, incoming, "staged-notes")
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket"
    ).parquet(path)


def read_notes(spark: SparkSession, path: str, schema: str, key: str = "note_id") -> DataFrame:
    """The rows of a table that ``replace_notes`` keeps."""
    return spark.read.schema(schema).parquet(path).filter(F.col(key).isNotNull()).drop("bucket")
