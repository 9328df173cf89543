"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def build_session(app_name: str = "clinote", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on; extra settings override."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed partition even where that costs the reuse of its partitioning.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # A filter of the wanted keys may reach the scan of a text table from up to this size of keys.
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in a folder that all executors reach; it is deleted when the session's JVM ends.

    The folder is ``spark.checkpoint.dir``, or where that is unset, one inside the warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def store(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several branches read, and return the written table.

    The table survives the loss of executors and cuts the plan at this point.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_counted(
    spark: SparkSession, df: DataFrame, name: str, parts: dict[str, Column] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """``store``, and the rows that the write saw: all of them under ``name``, those of each condition under its name.

    The counts stand on top of what is written, thus in the last stage: its tasks count once even where one is
    repeated after the loss of an executor, which does not hold for a stage before a shuffle.
    """
    seen = Observation()
    counts = {name: F.count(F.lit(1))} | {part: F.count_if(condition) for part, condition in (parts or {}).items()}
    watched = df.observe(seen, *[count.alias(f"c{i}") for i, count in enumerate(counts.values())])
    stored = store(spark, watched, name.replace(" ", "-"))
    found = seen.get
    return stored, {stage: int(found.get(f"c{i}") or 0) for i, stage in enumerate(counts)}
