"""Records for annotation tools, as rows that the JSON writer can store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clinote.functions import ranking, text

AGENT = "clinote.dictionary"


def token_records(corpus: DataFrame, *, agent: str = AGENT, limit: int | None = None) -> DataFrame:
    """Token classification: text, tokens, predicted spans, agent, metadata.

    ``limit`` keeps the first documents by SHA-1.
    """
    chosen = corpus if limit is None else corpus.orderBy("sha1").limit(limit)
    return chosen.select(
        "text",
        text.tokens(F.col("text")).alias("tokens"),
        F.transform(
            "ents",
            lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")),
        ).alias("prediction"),
        F.lit(agent).alias("prediction_agent"),
        F.create_map(F.lit("sha1"), F.col("sha1")).alias("metadata"),
    )


# Names of the metadata fields.
METADATA_COLUMNS = (
    "patient_id", "mapped_document_type", "document_type", "service_delivery_location", "encounter_id"
)


def text_records(notes: DataFrame, *, metadata_columns: tuple[str, ...] = METADATA_COLUMNS) -> DataFrame:
    """Text classification with several labels allowed: id, inputs, metadata."""
    entries = [part for c in metadata_columns for part in (F.lit(c), F.col(c).cast("string"))]
    return notes.select(
        F.col("document_id").alias("id"),
        F.create_map(F.lit("text"), F.col("file_text")).alias("inputs"),
        F.create_map(*entries).alias("metadata"),
        F.lit(True).alias("multi_label"),
    )


def with_batch_id(records: DataFrame, size: int = 50, *, key: str = "id") -> DataFrame:
    """Number the records into batches of ``size``; only the last batch may be smaller.

    Records are dealt out in order of a digest of their key, so no task sorts them all. The
    keys, which are to be unique, are numbered alone; texts meet their number in one join.
    """
    if size < 1:
        raise ValueError("size must be positive")
    placed = ranking.with_key_position(records, [key], F.md5(F.col(key).cast("string")), "_position")
    return placed.withColumn("batch_id", F.expr(f"_position div {int(size)}")).drop("_position")
