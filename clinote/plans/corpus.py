"""Mentions to annotated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clinote import schemas
from clinote.operators import ner
from clinote.sources import readers, sinks


def build_corpus(
    mentions: DataFrame,
    concepts: DataFrame,
    style: str,
    *,
    exclude_ids: list[int],
    cap: int | None = None,
) -> DataFrame:
    """Annotated documents of one style, straight from mentions; ValueError where a column is absent."""
    schemas.require_columns(mentions, schemas.NOTE_NLP, schemas.MENTION_COLUMNS)
    schemas.require_columns(concepts, schemas.CONCEPT)
    located = ner.prepare(mentions, exclude_ids=exclude_ids, cap=cap)
    return ner.corpus(ner.first_variants(located), concepts, style)


def store_corpus(
    spark: SparkSession,
    documents: DataFrame,
    style: str,
    work_path: str,
    target_path: str,
    *,
    test_fraction: float = ner.TEST_FRACTION,
    seed: str = "0",
    mode: str = "error",
) -> DataFrame:
    """Write a corpus with its split and read it back.

    The exact split looks at the keys several times, so the documents are computed once
    into ``work_path`` (shared storage) and split from there. By default a target that
    exists is an error, so that a rerun cannot double the corpus.
    """
    sinks.write_table(documents, work_path)
    stored = readers.read_table(spark, work_path, schema=documents.schema)
    placed = ner.split(stored, test_fraction=test_fraction, seed=seed).withColumn("style", F.lit(style))
    sinks.write_corpus(placed, target_path, mode)
    return readers.read_corpus(spark, target_path, style)
