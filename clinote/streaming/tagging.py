"""Tagging of notes as they arrive. Tagging keeps no state, so it runs on a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clinote import schemas
from clinote.plans.tagging import tag_notes


def read_notes(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Note files appearing under a folder."""
    reader = spark.readStream.schema(schemas.NOTE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def start(notes: DataFrame, lexicon: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Tag everything available and stop; the next start goes on where this one ended.

    Mention ids are hashes of the mention, so a replayed batch writes the same ids.
    """
    return (
        tag_notes(notes, lexicon, **options)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
